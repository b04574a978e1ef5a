import json
import random
import re

from pyspark.sql import functions as F

from quillmesh.llm import threads

COLUMNS = "rid string, namespace string, reference string, contents string, updated_at int, thread_id string, node string"


def row(thread, n, content="hello there", sender="o", ts="2025-01-01T00:00:00Z", reply=None, kind="text", updated=1, raw=None):
    ref = f"tg:{thread}:{n}"
    body = {"content": content, "sender_id": sender, "platform_ts": ts, "reply_to": reply, "content_type": kind}
    return (f"orn:x-message:{ref}", "x-message", ref, raw if raw is not None else json.dumps(body), updated, "clash", "clash")


def run(spark, rows, own=("me",)):
    senders = spark.createDataFrame([(s, "tg", "clash") for s in own], "sender_id string, platform string, role string")
    got = threads.conversations(spark.createDataFrame(rows, COLUMNS), senders).orderBy("thread_id", "turn_no").collect()
    return [(r.thread_id, r.turn_no, r.reference.rsplit(":", 1)[1], r.role) for r in got]


def good(thread, **kw):
    return [row(thread, 1, sender="me", **kw), row(thread, 2, **kw)]


def test_order_roles_and_notations_of_time(spark):
    rows = [
        row("a", 5, ts="2025-01-01T01:00:00+01:00"), row("a", 1, sender="me", ts=1735689599), row("a", 2, ts="1735689600000"), row("a", 3, ts="2025-01-01 00:00:00"),
        row("a", 4, kind="service", ts="2025-01-01T00:00:00.900Z"), row("a", 6, content=" ​ ".replace("​", ""), ts="n/a"), row("a", 7, content=None, ts=None),
    ]
    assert run(spark, rows) == [("a", 1, "1", "self"), ("a", 2, "2", "other"), ("a", 3, "3", "other"), ("a", 4, "4", "system"), ("a", 5, "5", "other")]


def test_dropped_threads(spark):
    rows = [
        *good("json"), row("json", 3, raw='{"content": "x'),
        *good("lost"), row("lost", 3, reply="tg:lost:9"),
        *good("far"), row("far", 3, reply="tg:json:1"),
        *good("time"), row("time", 3, ts="yesterday"),
        *good("zero"), row("zero", 3, ts="0000-00-00T00:00:00"),
        row("alone", 1, sender="me"), row("never", 1), row("never", 2, kind="service"), row("mute", 1, sender="me"), row("mute", 2, content="  "),
        *good("kept"), row("kept", 3, content=" ", ts="n/a"), row("kept", 4, reply="tg:kept:3"), row("kept", 5, reply=""),
        ("orn:x-message:odd", "x-message", "odd", "{}", 1, "", ""), ("orn:x-message:null", "x-message", None, None, 1, "", ""),
    ]
    assert {t for t, *_ in run(spark, rows)} == {"kept"}


def test_only_current_rows_count(spark):
    rows = [*good("a"), row("a", 2, raw="{broken", updated=0), row("a", 1, sender="me"), row("a", 1, sender="me")]
    assert run(spark, rows) == [("a", 1, "1", "self"), ("a", 2, "2", "other")]


def test_a_thread_over_many_partitions(spark):
    rows = [row("hot", i, sender="me" if i % 7 == 0 else "o", ts=1_700_000_000 + i // 2, reply=f"tg:hot:{i - 3}" if i % 5 == 0 and i > 3 else None) for i in range(1, 700)]
    got = run(spark, rows)
    assert [(t, int(n)) for _, t, n, _ in got] == [(i, i) for i in range(1, 700)]


def test_links_and_trees(spark):
    rows = [
        row("a", 1, "the parser fails on dates", "me", ts=0), row("a", 2, "what about lunch today", ts=10), row("a", 3, "dates broke the parser again", "p", ts=5000), row("a", 4, "no idea", ts=10**6, reply="tg:a:1"), row("a", 5, "@me really", "q", ts=5100),
    ]
    senders = spark.createDataFrame([("me", "tg")], "sender_id string, platform string")
    c = threads.conversations(spark.createDataFrame(rows, COLUMNS), senders)
    ref = c.select(F.col("node").alias("p"), F.col("reference").alias("parent_ref"))
    got = {r.reference[-1]: (r.parent_ref or "")[-1:] for r in c.join(ref, c["parent"] == ref["p"], "left").collect()}
    assert got["1"] == "" and got["3"] == "1" and got["4"] == "1" and got["5"] in "13"
    assert c.where("parent is null").count() == c.select("root").distinct().count()


def every_pair(turns):
    """The best parent of each turn among all earlier turns of its thread, by a plain program."""
    words = [{w for w in re.split(r"[\W_]+", t.content.lower()) if len(w) > 2} for t in turns]
    parents = {}
    for i, q in enumerate(turns):
        best = (0.0, -1)
        for j, c in enumerate(turns[:i]):
            who = re.search("([^:@]*)$", c.sender_id)[1].lower()
            common = len(words[i] & words[j]) / max(1, min(len(words[i]), len(words[j])))
            score = 0.5 * 0.5 ** ((q.ts - c.ts) / 900) + 0.4 * common + 0.6 * (len(who) > 1 and f"@{who}" in q.content.lower()) + 0.1 * (q.sender_id != c.sender_id)
            best = max(best, (round(score, 9), j))
        parents[q.node] = turns[best[1]].node if best[0] >= threads.LEAST_SCORE else None
    return parents


def links(spark, rows):
    senders = spark.createDataFrame([("me", "tg")], "sender_id string, platform string")
    roles = threads.with_roles(threads.messages(spark.createDataFrame(rows, COLUMNS)), senders)
    turns = threads.ordered(roles, threads.kept_threads(roles))
    return sorted(turns.collect(), key=lambda t: t.turn_no), {r.node: r.parent for r in threads.reply_links(turns).collect()}


def test_parents_far_back(spark):
    rows = [row("a", 1, "the parser fails on dates", "me", ts=0), row("a", 2, "where is zoë", "zoë", ts=1)]
    rows += [row("a", n, f"chatter{n} filler{n}", "p", ts=n * 10) for n in range(3, 300)]
    rows += [row("a", 300, "dates broke the parser", "q", ts=10**6), row("a", 301, "@Zoë really", "q", ts=2 * 10**6), row("a", 302, "unheard of", "q", ts=4 * 10**6)]
    turns, got = links(spark, rows)
    assert [got[turns[i].node] for i in (299, 300, 301)] == [turns[0].node, turns[1].node, None]


def test_links_equal_those_of_all_pairs(spark):
    draw = random.Random(5)
    names, vocabulary = ["me", "tg:ann", "tg:bob", "x:ann"], [f"word{i}" for i in range(25)]
    rows, ts = [], 0
    for n in range(1, 620):
        ts += draw.choice([0, 1, 40, 400, 2000, 9000])
        mention = f" @{draw.choice(['ann', 'BOB', 'nobody', 'a'])}" if draw.random() < 0.1 else ""
        sender = names[1] if 200 < n < 500 and draw.random() < 0.995 else draw.choice(names)
        rows.append(row("a", n, " ".join(draw.choices(vocabulary, k=draw.randint(0, 6))) + " ok" + mention, sender, ts=ts))
    turns, got = links(spark, rows)
    assert got == every_pair(turns)


def test_interleaved_talk_is_parted(spark):
    """Three conversations in one thread, whose turns take up words of what they answer: nine in ten told replies are
    found without their reply_to, and hardly a link leads from one talk to another."""
    draw = random.Random(8)
    talks = [[f"{kind}{i}" for i in range(60)] for kind in ("garden", "engine", "ledger")]
    people = [["me", "tg:ann"], ["tg:bob", "tg:cleo"], ["tg:dora", "tg:emil"]]
    rows, last, ts = [], [None] * 3, 1_700_000_000
    for n in range(1, 500):
        k = draw.randrange(3)
        ts += draw.choice([5, 30, 90])
        sender, words = people[k][n % 2], draw.sample(talks[k], 4)
        if last[k]:
            words[:2] = draw.sample(last[k][2], 2)
        text = " ".join(words) + (f" @{last[k][1].rsplit(':', 1)[-1]}" if last[k] and draw.random() < 0.2 else "")
        rows.append(row("a", n, text, sender, ts=ts, reply=f"tg:a:{last[k][0]}" if last[k] else None))
        last[k] = (n, sender, words)
    senders = spark.createDataFrame([("me", "tg")], "sender_id string, platform string")
    turns = threads.spoken_turns(spark.createDataFrame(rows, COLUMNS), senders)
    told, found = threads.reply_recall(turns).first()
    assert told == 496 and found >= 0.9 * told
    talk = {t.node: t.content[:6] for t in turns.collect()}
    got = threads.reply_links(turns, hidden=True).where("parent is not null").collect()
    assert len(got) > 480 and sum(talk[r.node] == talk[r.parent] for r in got) >= 0.95 * len(got)


def test_weights_follow_the_choices():
    import numpy as np

    draw = np.random.default_rng(4)
    x = draw.random((4000, 4))
    group = np.repeat(np.arange(400), 10)
    best = x.reshape(400, 10, 4)[:, :, 1].argmax(axis=1) + np.arange(400) * 10
    chosen = np.zeros(4000)
    chosen[best] = 1
    w = threads.fit_weights(chosen, group, x)
    assert w[1] == max(w) > 0.8 and abs(sum(w) - sum(threads.WEIGHTS)) < 1e-9
    assert threads.fit_weights(np.empty(0), np.empty(0), np.empty((0, 4))) == threads.WEIGHTS
    assert threads.least_score(threads.WEIGHTS)[0] == threads.LEAST_SCORE


def test_link_trees_match_a_walk(spark):
    links = [(i, None if i % 10 == 0 else i - 1 if i % 3 else i // 10 * 10, 1.0) for i in range(200)]
    got = {r.node: r.root for r in threads.link_trees(spark.createDataFrame(links, "node long, parent long, score double")).collect()}
    assert got == {i: i // 10 * 10 for i in range(200)}


def test_empty_tables(spark):
    assert run(spark, []) == []

import json

import numpy as np

from quillmesh.llm import cutoff

COLUMNS = "rid string, namespace string, contents string, search_text string, updated_at int, body string, word string"
NAMES = "cursor ledger index manifest backlog gateway feed shard journal queue vector archive".split()


def sentence(i):
    a, b = NAMES[i % 12], NAMES[i * 7 % 11]
    return f"Nothing in the {a} explains why the {b} number {i} was restored before the weekly review."


def text(*ns):
    return " ".join(sentence(n) for n in ns)


def plan(rid, body, kept=None, made=None, at=1):
    contents = json.dumps({"title": "T", "goal": "g", "body": body if made is None else made})
    return (rid, "x-plan", contents, f"T g {body if kept is None else kept}", at, "clash", "clash")


def found(spark, rows):
    return {r.rid: r.how for r in cutoff.truncated(spark.createDataFrame(rows, COLUMNS)).collect()}


BASE = [plan(f"base{i}", text(*range(i, i + 4))) for i in range(60)]


def test_own_contents_and_padding(spark):
    whole = text(100, 101, 102)
    rows = [*BASE, plan("cut", whole, whole[:100]), plan("atstop", whole, text(100, 101)), plan("padded", whole, whole + "  \n"), plan("same", whole), plan("broken", whole, whole[:90] + "�")]
    rows += [("short", "x-message", '{"content": "can you check the feed"}', "can you check the", 1, "", "")]
    assert found(spark, rows) == {"cut": "copy", "atstop": "copy", "broken": "copy", "short": "contents"}


def test_copies_of_other_rows(spark):
    whole = text(*range(200, 212))
    cut = whole[: len(whole) // 2]
    rows = [*BASE, plan("whole", whole), plan("cut", cut[: cut.rindex(" was")]), plan("other", text(*range(300, 312)))]
    near = cut.replace("number 201", "number  201", 1)
    rows.append(plan("near", near[: near.rindex("before")]))
    got = found(spark, rows)
    assert set(got) == {"cut", "near"} and got["cut"] == "copy"


def test_many_copies_of_a_text(spark):
    whole = text(*range(400, 406))
    rows = [*BASE, *(plan(f"w{i}", whole) for i in range(300)), plan("cut", whole[:250])]
    assert set(found(spark, rows)) == {"cut"}


def test_a_longer_text_that_only_begins_alike(spark):
    whole = text(*range(450, 460))
    cut = whole[:500]
    cut = cut[: cut.rindex(" was")]
    other = cut[: cut.rindex("Nothing")] + text(*range(470, 490))
    rows = [*BASE, plan("whole", whole), plan("longest", other), plan("cut", cut), plan("longer", other + " " + text(491))]
    assert found(spark, rows) == {"cut": "copy"}


def test_scripts_without_blanks_and_short_earlier_versions(spark):
    texts = {"zh": "每个仪表板保留二十六份捆绑包的副本而园丁希望更少因为磁盘已经满了", "th": "แดชบอร์ดแต่ละตัวเก็บสำเนาของชุดข้อมูลไว้ยี่สิบหกชุดแต่คนสวนต้องการน้อยกว่านั้น"}
    bare = lambda rid, body, at=1: (rid, "x-web", None, body, at, "", "")
    rows = [*BASE, *(bare(k, v) for k, v in texts.items()), *(bare(k + "-cut", v[: len(v) * 3 // 4]) for k, v in texts.items())]
    rows += [bare("v", "can you check the feed and the ledger"), bare("v", "can you check the feed", 2), bare("done", "Look at the feed. Then stop"), bare("done", "Look at the feed.", 2)]
    assert found(spark, rows) == {"zh-cut": "copy", "th-cut": "copy", "v": "copy"}


def test_endings(spark):
    ends = {"midword": "Nothing in the curs", "open": "Nothing in the cursor explains why the", "mark": "Nothing in the cursor,", "quote": "He wrote “Nothing in the cursor"}
    rows = [*BASE, *(plan(k, text(500) + " " + v) for k, v in ends.items())]
    rows += [plan("nostop", text(500)[:-1]), plan("list", text(501) + "\n- [x] ask the weekly review"), plan("url", text(502) + " https://x.example/ab/17"), plan("dots", text(503) + " To be continued...")]
    rows += [("short", "x-message", '{"content": "ok"}', "ok", 1, "", ""), ("bad", "x-message", '{"content": "yes", "cont', "yes", 1, "", "")]
    assert set(found(spark, rows)) == set(ends)


def test_null_empty_and_earlier_versions(spark):
    whole = text(600, 601)
    rows = [*BASE, ("n", "x-plan", None, None, 1, "", ""), ("e", "x-plan", "{}", "", 1, "", ""), ("b", "x-plan", "{}", " \n", 1, "", ""), (None, "x-plan", "{}", whole[:50], 1, "", "")]
    rows += [plan("v", whole, whole[:60], at=1), plan("v", whole, at=2), plan("w", whole, at=1), plan("w", whole, whole[:60], at=2), plan("w", whole, whole[:60], at=2)]
    assert found(spark, rows) in ({"w": "copy"}, {"w": "contents"})


def test_shares(spark):
    whole = text(700, 701)
    rows = [*BASE[:6], plan("cut", whole, whole[:60]), plan("ok", whole), ("n", "x-task", None, None, 1, "", "")]
    got = cutoff.shares(spark.createDataFrame(rows, COLUMNS)).collect()
    assert [(r.namespace, r.bundles, r.truncated, r.share) for r in got] == [("x-plan", 8, 1, 0.125)]


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_signatures_share_prefixes():
    long = text(*range(800, 830))
    whole, cut = cutoff.signatures([long, long[: len(long) // 2]])
    assert len(cut) < len(whole) and (whole[: len(cut)] == cut).all()
    assert len(cutoff.signatures(["a b c"])[0]) == 0 and cutoff.signatures([]) == [] and len(cutoff.signatures([""])[0]) == 0
    assert whole.dtype == np.int64


def test_alignment():
    whole = text(900, 901, 902)
    assert cutoff.ends_early(whole[:120], whole) and not cutoff.ends_early(whole, whole) and not cutoff.ends_early(whole, whole[:100])
    assert not cutoff.ends_early("", whole) and not cutoff.ends_early(text(950), whole)


def test_a_long_open_quotation_and_long_words():
    text_ = "He wrote “" + text(*range(20)) + " Nothing in the cursor"
    assert len(text_) > 1000 and cutoff.closing(text_)[0]
    assert cutoff.closing("see " + "ab-" * 400 + "ab")[1] == "ab-" * 400 + "ab"


def test_the_classifier_of_endings():
    known = np.asarray([[6.0, 0.0, 1, 1]] * 200 + [[0.0, 0.0, 0, 1]] * 2000 + [[0.0, -4.0, 1, 1]] * 60)
    bias, longer, closing = cutoff.fit_endings(known)
    assert bias + 6 * longer > 0 > bias and bias + 4 * closing > 0
    assert tuple(cutoff.fit_endings(np.empty((0, 4)))) == cutoff.PRIOR

"""Source mappings, event groups, JSON updates, safe swaps, the stored index, pipelines and fuzzy matches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmesh import runtime
from quillmesh.functions import text as T
from quillmesh.operators import entities, evaluation, fulltext, graph, ingest, retrieval
from quillmesh.sources import files, sinks
from quillmesh.streaming import events


def put(folder, **texts):
    for name, text in texts.items():
        path = folder / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(folder)


def test_plans_and_skills(spark, tmp_path):
    d = put(tmp_path / "plans", **{"2026-01-02-big_dot_md": "# Big plan\n\n**Goal:** ship it\n", "calm-agent-a0123abcd_dot_md": "# Sub\n"})
    got = {r.reference: (r.title, r.goal, r.plan_type, r.parent_slug) for r in files.plan_bundles(spark, d, "x-").collect()}
    assert got == {"2026-01-02-big": ("Big plan", "ship it", "dated", None), "calm-agent-a0123abcd": ("Sub", None, "subagent", "calm")}
    d = put(tmp_path / "skills", **{"a__one_dot_md": "A", "a___dot_version": "version: 3\nsource: web\n", "a___dot_analyzed": "", "b__two_dot_md": "B"})
    got = {r.text: (r.version, r.analyzed) for r in files.skill_bundles(spark, d).collect()}
    assert got == {"A": ({"version": "3", "source": "web"}, True), "B": (None, False)}


def test_persona_chat_exports_and_cache(spark, tmp_path):
    d = put(tmp_path / "p", **{"memory_dot_md": "I like tea", "facts_dot_json": '{"a": 1}', "log_dot_jsonl": '{"x": 1}\nbroken\n\n{"x": 2}\n'})
    got = sorted((r.item_type, r.reference) for r in files.persona_items(spark, d, {"memory.md": "memory"}).collect())
    assert got == [("fact", "facts"), ("memory", "memory"), ("observation", "log#0"), ("observation", "log#2")]
    talks = [{"uuid": "u1", "name": "Tea", "summary": "", "created_at": "2026-01-02T03:04:05Z", "chat_messages": [{"sender": "human", "text": "hi"}, {"sender": "assistant", "text": "ho"}]}]
    projects = [{"uuid": "u2", "name": "P", "description": "d", "docs": [{"filename": "f", "content": "c"}]}, {"name": "no id", "docs": []}]
    d = put(tmp_path / "chat", conversations_dot_json=json.dumps(talks), projects_dot_json=json.dumps(projects), memories_dot_json=json.dumps([{"conversations_memory": "m", "project_memories": {"u2": "pm"}}]))
    got = {r.namespace: (r.search_text, str(r.created_at)[:10]) for r in files.chat_exports(spark, d, "x-").collect()}
    assert got["x-web.conversation"] == ("Tea\nhi\nho", "2026-01-02") and got["x-web.project"][0] == "P\nd\nf\nc" and got["x-web.memory"][0] == "m\npm"
    d = put(tmp_path / "cache", a_dot_json='{"rid": "orn:x-a:1", "contents": {"k": 1}}', b_dot_json='{"rid": "orn:x-a:2", "contents": [1, 2]}', c_dot_json='{"rid": "orn:x-a:3", "contents": "say \\"x\\""}', e_dot_json="{broken", f_dot_json='{"contents": {}}')
    got = {r.reference: json.loads(r.contents) for r in files.cached_bundles(spark, d).collect()}
    assert got == {"1": {"k": 1}, "2": {"raw": [1, 2]}, "3": {"raw": 'say "x"'}}


def test_recordings_and_contacts(spark, tmp_path):
    d = put(tmp_path / "t", **{"talk one_dot_txt": "[00:01] hello\n[00:02]\n[00:03] there"})
    rows = spark.createDataFrame([(1,), (2,)], "recording_id int")
    told = spark.createDataFrame([(1, "/elsewhere/talk one.txt")], "recording_id int, path string")
    got = {r.recording_id: r.transcript_text for r in files.recordings(rows, told, files.text_files(spark, d, "*.txt")).collect()}
    assert got == {1: "hello\nthere", 2: None}
    scores = spark.createDataFrame([(1, 0.5, "2026-01-01"), (2, 0.7, "2026-02-01"), (3, 0.1, "2026-03-01")], "identity_id int, score double, computed_at string")
    who = spark.createDataFrame([(1, "A"), (2, "B")], "identity_id int, display_name string")
    assert [r.display_name for r in files.contacts(scores, who, "2026-01-15").collect()] == ["B"] and files.contacts(scores, who).count() == 2


def test_front_matter_lists(spark):
    head = "title: x\ntags: [a, 'b c', ]\nmore:\n  - one\n  - \"two\"\nempty: []\nplain: y"
    got = spark.createDataFrame([(head,)], "h string").select(T.front_lists(F.col("h")).alias("m")).first().m
    assert got == {"tags": ["a", "b c"], "more": ["one", "two"], "empty": []}


def test_event_group(spark):
    e = spark.createDataFrame([(i, float(i), "k") for i in range(6)], "id int, at double, kind string")
    none = spark.createDataFrame([], "id int, tries int, given double, acked boolean")
    first = events.pull(e, none, 10.0, 4)
    assert [(r.id, r.tries) for r in first.collect()] == [(0, 1), (1, 1), (2, 1), (3, 1)]
    state = events.acknowledge(none, first, spark.createDataFrame([(0,), (2,)], "id int"), 10.0)
    assert [r.id for r in events.pull(e, state, 12.0, 9).collect()] == [4, 5]  # what is out isn't idle long enough
    assert [(r.id, r.tries) for r in events.pull(e, state, 16.0, 3).collect()] == [(1, 2), (3, 2), (4, 1)]
    for now in (16.0, 22.0):
        state = events.acknowledge(state, events.pull(e, state, now, 2), spark.createDataFrame([], "id int"), now)
    assert {r.id for r in events.dead_letters(state, 30.0).collect()} == {1, 3}
    lag = events.group_lag(e, state, "kind").first()
    assert (lag.length, lag.pending, lag.undelivered) == (6, 2, 2)


def test_set_field(spark):
    rows = ['{"a": 1}', "{}", '{"x": null, "a": 2}', '{"x": "kept"}', "broken", None, "[1]", ' {"n": {"x": 1}} ']
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    got = [r.c for r in df.select(ingest.set_field(F.col("c"), "x", F.lit('q"é')).alias("c")).collect()]
    assert [json.loads(g) for g in got[:4]] == [{"a": 1, "x": 'q"é'}, {"x": 'q"é'}, {"x": 'q"é', "a": 2}, {"x": "kept"}]
    assert got[4:7] == ["broken", None, "[1]"] and json.loads(got[7]) == {"n": {"x": 1}, "x": 'q"é'}


def test_swaps_states_and_configs(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        sinks.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    (tmp_path / "t").rename(tmp_path / "t.old")  # a swap that was broken off
    assert sinks.table_path(spark, path) == f"{path}.old" and sinks.table_path(spark, str(tmp_path / "u")) is None
    sinks.save_state(spark, str(tmp_path / "s"), {"mark": "7"})
    sinks.save_state(spark, str(tmp_path / "s"), {"mark": "8", "b": "x"})
    assert sinks.load_state(spark, str(tmp_path / "s")) == {"mark": "8", "b": "x"} and sinks.load_state(spark, str(tmp_path / "none")) == {}
    configs = spark.createDataFrame([("a", 4), ("b", 8)], "config_id string, dimensions int")
    chunks = spark.createDataFrame([("a", 1), ("b", 2)], "config_id string, n int")
    new, left = sinks.register_config(configs, chunks, {"config_id": "a", "dimensions": 4})
    assert new.count() == 2 and left.count() == 2
    new, left = sinks.register_config(configs, chunks, {"config_id": "b", "dimensions": 9})
    assert {(r.config_id, r.dimensions) for r in new.collect()} == {("a", 4), ("b", 9)} and [r.config_id for r in left.collect()] == ["a"]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Gone:
        def isEmpty(self):
            return True

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return self

        def get(self, *a):
            return None

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    getCheckpointDir = staticmethod(Gone)

                return S

    class Session:
        sparkContext = Context()
        conf = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.scratch_dir(Session())


def test_stored_index(spark, tmp_path):
    rows = [("a", "x-note", "red apple pie"), ("b", "x-task", "green apple"), ("c", "x-note", None), ("d", "x-note", "..."), ("e", "x-note", "apple apple red")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "rid string, namespace string, search_text string").write.parquet(path)
    docs = spark.read.parquet(path)
    index, size = fulltext.stored_index(docs)
    again, _ = fulltext.stored_index(spark.read.parquet(path))
    assert index.inputFiles() == again.inputFiles()  # made once
    fresh = {(r.rid, round(r.rank, 9)) for r in fulltext.search(fulltext.postings(docs), fulltext.corpus_size(docs), "apple red").collect()}
    assert {(r.rid, round(r.rank, 9)) for r in fulltext.search(index, size, "apple red").collect()} == fresh and {r for r, _ in fresh} == {"a", "e"}
    assert [r.rid for r in fulltext.search(index, size, "apple", where=F.col("namespace") == "x-task").collect()] == ["b"]
    asked = spark.createDataFrame([(1, "apple red"), (2, "pear")], "query_id int, query string")
    assert {(r.query_id, r.rid) for r in fulltext.search_many(index, size, asked).collect()} == {(1, "a"), (1, "e")}


def test_routes_and_passages(spark):
    fts = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "rid string, rank double")
    near = spark.createDataFrame([("c", 0.9)], "rid string, similarity double")
    order = lambda df: [r.rid for r in df.collect()]
    assert order(retrieval.routed("keyword", fts, near)) == order(retrieval.routed("hybrid", fts, None)) == ["a", "b"]
    assert order(retrieval.routed("hybrid", fts, near)) == ["a", "c", "b"] and order(retrieval.routed("conceptual", fts, near))[:2] == ["a", "c"]
    rows = spark.createDataFrame([("a chunk of some words", "h", "f"), ("short", "a headline of more than twenty", "f"), (None, "short one", "first chunk")], "c string, h string, f string")
    got = [r.p for r in rows.select(retrieval.passages(F.col("c"), F.col("h"), F.col("f")).alias("p")).collect()]
    assert got == ["a chunk of some words", "a headline of more than twenty", "first chunk"]
    hits = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "rid string, pos int, score double")
    by = spark.createDataFrame([("b", 1), ("z", 2)], "rid string, entity_pos int")
    assert {r.rid: r.score for r in retrieval.with_entity_bonus(hits, by).collect()} == {"a": 0.5, "b": round(1 / 62 + 0.01, 9), "z": 0.005}


def test_pipelines(spark):
    long = "Filler words go on. " * 200 + "See https://a.example/x. On 2026-01-02 it was v1.2.3. " + "More words follow. " * 100
    docs = spark.createDataFrame([("a", "x-plan", "see /srv/data/notes.md!, 2026-01-02 and 2026-01-02"), ("l", "x-plan", long), ("n", "x-plan", None), ("e", "x-plan", "")], "rid string, namespace string, search_text string")
    for name in ("default", "fast"):
        got = {(r.rid, r.entity_type, r.name, r.supertype, r.confidence) for r in entities.run_pipeline(docs, name, namespace="namespace").collect()}
        assert got == {
            ("a", "Path", "/srv/data/notes.md", "place", 0.9), ("a", "Date", "2026-01-02", "temporal", 1.0),
            ("l", "URL", "https://a.example/x", "place", 1.0), ("l", "Date", "2026-01-02", "temporal", 1.0), ("l", "Version", "1.2.3", "artifact", 0.9),
        } or {g[:3] for g in got} >= {("l", "URL", "https://a.example/x"), ("a", "Date", "2026-01-02")}
    many = "".join(f" 2026-01-{i:02d}" for i in range(1, 29)) + "".join(f" 2025-01-{i:02d}" for i in range(1, 29))
    assert entities.run_pipeline(docs.limit(1).select("rid", F.lit(many).alias("search_text")), "fast").count() == entities.MOST_PER_CHUNK
    with pytest.raises(ValueError, match="no pipeline"):
        entities.run_pipeline(docs, "other")
    found = spark.createDataFrame([("a", "Ｘ", "T", "s", 0.5), ("a", "x", "T", "s", 0.9), ("a", "X", "T", "s", 0.9)], "rid string, name string, entity_type string, supertype string, confidence double")
    assert [(r.name, r.name_normalized) for r in entities.merge(found).collect()] == [("X", "x")]


def greedy(predicted, gold):
    used, out = set(), []
    for p in predicted:
        for j, g in enumerate(gold):
            if j not in used and T.indel_ratio(p.lower(), g.lower()) >= 85:
                used.add(j)
                out.append((p, g))
                break
    return out


def test_fuzzy_matches_equal_a_plain_walk(spark):
    draw = random.Random(2)
    rows, want, gold_rows = [], set(), []
    for doc in range(12):
        base = ["".join(draw.choices("abcde", k=8)) for _ in range(4)]
        predicted = sorted(draw.choices(base, k=3) + [b[:-1] + "x" for b in base[:2]])
        gold = sorted(base + [base[0] + "y"])
        rows += [(doc, "T", p) for p in predicted]
        gold_rows += [(doc, "T", g) for g in gold]
        want |= {(doc, *m) for m in greedy(predicted, gold)}
    kind = "rid int, entity_type string, name string"
    p, g = spark.createDataFrame(rows, kind), spark.createDataFrame(gold_rows, kind)
    got = {(r.rid, r.predicted, r.gold) for r in evaluation.matched_entities(p, g).collect()}
    assert got == want
    one = {r.rid: (r.precision, r.recall) for r in evaluation.fuzzy_extraction_scores(p, g).collect()}
    hits = {d: len(greedy(sorted(n for x, _, n in rows if x == d), sorted(n for x, _, n in gold_rows if x == d))) for d in range(12)}
    assert one == {d: (round(hits[d] / 5, 6), round(hits[d] / 5, 6)) for d in range(12)}


def test_quantiles_and_deep_folders(spark):
    draw = random.Random(4)
    for values in ([draw.random() * 1000 for _ in range(997)], [5.0] * 10, [1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        r, s = evaluation.latency(df, "v").first(), sorted(values)
        assert (r.p50, r.p95, r.max) == (s[int(len(s) * 0.5)], s[int(len(s) * 0.95)], s[-1])
    assert evaluation.latency(spark.createDataFrame([], "v double"), "v").count() == 0
    chain = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(26)], "id int, parent int, title string")
    paths = {r.id: r.path for r in graph.folder_paths(chain).collect()}
    assert paths[25] == "/" + "/".join(f"n{i}" for i in range(26))

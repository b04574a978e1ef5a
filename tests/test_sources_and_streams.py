import json
import sqlite3

import pytest

from quillmesh.sources import files, sinks, sqlite
from quillmesh.streaming import events as S


def test_markdown_bundles(spark, tmp_path):
    (tmp_path / "2026/01/02").mkdir(parents=True)
    (tmp_path / "2026/01/02/note one.md").write_text("---\ntitle: First\n---\nBody")
    (tmp_path / "2026/readme.md").write_text("# not dated")
    got = files.markdown_bundles(spark, str(tmp_path), "journal", "x-").collect()
    assert [(r.rid, r.title, r.body, r.frontmatter) for r in got] == [("orn:x-journal:2026-01-02/note one", "First", "Body", {"title": "First"})]
    (tmp_path / "tasks").mkdir()
    (tmp_path / "tasks/task-7 - Do it.md").write_text("---\nid: task-77\n---\n# Do it\n")
    (tmp_path / "tasks/task-8 - Then.md").write_text("# Then\n")
    got = files.markdown_bundles(spark, str(tmp_path / "tasks"), "task", "x-").collect()
    assert {(r.reference, r.title) for r in got} == {("task-77", "Do it"), ("task-8", "Then")}


def test_json_and_changelogs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.json").write_text('{"rid": "r",\n "contents": "c"}')
    assert files.json_documents(spark, str(tmp_path / "d"), "rid string, contents string").first().rid == "r"
    log = spark.createDataFrame([("## 2.0\n- Added a\n- x\n\n## 1.0\n- Fixed `BigHook`\n",)], "text string")
    from pyspark.sql import functions as F

    got = files.changelog_versions(log, F.lit("o/r")).collect()
    assert [(r.reference, r.bullet_count, r.features, r.is_latest) for r in got] == [("o/r/2.0", 2, ["Added a"], True), ("o/r/1.0", 1, [], False)]
    assert got[1].names == ["BigHook"]


def test_session_logs_and_profiles(spark, tmp_path):
    lines = [
        {"type": "user", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": "hello"}}, {"type": "assistant", "sessionId": "s", "timestamp": "2026-01-01T00:01:00Z", "message": {"content": [{"type": "tool_use", "name": "Read"}, {"type": "text", "text": "ok"}]}},
        {"type": "user", "cwd": "/w", "timestamp": "2026-01-01T00:02:00Z", "message": {"content": [{"type": "text", "text": "more"}]}},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    r = files.session_logs(spark, str(tmp_path)).first()
    assert (r.session_id, r.cwd, r.user_messages, r.assistant_messages, r.tools_used, r.summary) == ("s", "/w", 2, 1, ["Read"], "hello | more")
    (tmp_path / "p.ini").write_text("[Profile0]\nName=main\nIsRelative=1\nPath=abc\n[Install1]\nDefault=x\n")
    assert files.profiles(str(tmp_path / "p.ini")) == [("main", str(tmp_path / "abc"))]


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "m.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE messages (id TEXT, n INTEGER)")
    con.executemany("INSERT INTO messages VALUES (?, ?)", [(f"m{i}", i) for i in range(100)])
    con.commit()
    yield path, con
    con.close()


def test_sqlite_batches_and_streams(spark, database, tmp_path):
    path, con = database
    sqlite.register(spark)
    read = lambda r: r.format("sqlite").schema("id string, n long").option("path", path).option("query", "messages")
    got = read(spark.read).option("partitions", "3").load()
    assert got.rdd.getNumPartitions() == 3 and sorted(r.n for r in got.collect()) == list(range(100))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        S.run_once(read(spark.readStream).load(), out, check)
    assert spark.read.parquet(out).count() == 100
    con.execute("INSERT INTO messages VALUES ('new', 100)")
    con.commit()
    S.run_once(read(spark.readStream).load(), out, check)
    assert spark.read.parquet(out).count() == 101


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(5), path)
    sinks.replace_table(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]
    sinks.write_json_lines(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_event_stream_resumes(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "2026-01-01"), ("r2", "2026-01-02")], "rid string, at string")
    made = S.envelope(rows, "bundle.created", "test", "rid", {"rid": "rid"}, "at")
    box = str(tmp_path / "box")
    made.write.json(box)
    seen = []
    for _ in range(2):
        S.run_batches(S.read_events(spark, box), lambda batch, n: seen.extend(r.subject for r in batch.collect()), str(tmp_path / "c"))
    assert sorted(seen) == ["r1", "r2"]
    made.limit(1).write.mode("append").json(box)
    S.run_batches(S.read_events(spark, box), lambda batch, n: seen.extend(r.subject for r in batch.collect()), str(tmp_path / "c"))
    assert len(seen) == 3


def test_failures_are_retried_then_set_aside(spark):
    tried = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "x")], "id string, tries int, error string")
    done, again, dead = S.split_failures(tried)
    assert ([r.id for r in done.collect()], [r.id for r in again.collect()], [r.id for r in dead.collect()]) == (["a"], ["b"], ["c"])


def test_breaker_steps():
    state = ("closed", 0, 0.0)
    seen = []
    for at, ok in [(1, False), (2, False), (3, True), (4, False), (5, False), (6, False), (10, True), (37, False), (70, True)]:
        *state, event = S.breaker_step(*state, at, ok)
        seen.append((state[0], event))
    assert seen == [("closed", None)] * 5 + [("open", "service.degraded"), ("open", None), ("open", "service.down"), ("closed", None)]


def test_breaker_stream(spark, tmp_path):
    box = str(tmp_path / "b")
    spark.createDataFrame([("s", float(i), False) for i in range(3)] + [("t", 1.0, True)], "service string, at double, ok boolean").coalesce(1).write.parquet(box)
    stream = spark.readStream.schema("service string, at double, ok boolean").parquet(box)
    out = str(tmp_path / "o")
    S.run_once(S.breaker(stream), out, str(tmp_path / "c"))
    got = {(r.service, r["at"]): (r.state, r.event) for r in spark.read.parquet(out).collect()}
    assert got[("s", 2.0)] == ("open", "service.degraded") and got[("t", 1.0)] == ("closed", None)

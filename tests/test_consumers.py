from pyspark.sql import functions as F

from __spark_entry__ import queries
from quillmesh.functions import ontology
from quillmesh.streaming import consumers

QUERIES = queries()
COLUMNS = "rid string, namespace string, reference string, contents string, search_text string, sha256_hash string, created_at int, updated_at int"


def bundle(rid, text, at=1, ns="x-plan"):
    return (rid, ns, rid, '{"title": "T"}', text, str(hash(text)), at, at)


def test_merge_embed_and_extract(spark, tmp_path):
    first = spark.createDataFrame([bundle("a", "see https://a.example/x on 2026-01-02"), bundle("b", "old"), bundle("b", "newer text here", 2), bundle("m", "short", ns="x-message")], COLUMNS)
    table, chunks, found = str(tmp_path / "t"), str(tmp_path / "c"), str(tmp_path / "e")
    steps = [consumers.merge_consumer(table), consumers.embed_consumer(chunks, "cfg", context=True), consumers.extract_consumer(found)]
    for _ in range(2):  # a batch that runs twice changes nothing
        steps[0](first, 0)
        current = spark.read.parquet(table)
        steps[1](current, 0)
        steps[2](current, 0)
    assert {r.rid: r.search_text for r in spark.read.parquet(table).collect()}["b"] == "newer text here"
    assert sorted((r.rid, r.chunk_index) for r in spark.read.parquet(chunks).collect()) == [("a", 0), ("b", 0)]
    assert {(r.entity_type, r.name) for r in spark.read.parquet(found).collect()} == {("URL", "https://a.example/x"), ("Date", "2026-01-02")}
    steps[1](spark.createDataFrame([bundle("a", "y " * 2000, 3)], COLUMNS), 1)
    assert spark.read.parquet(chunks).where("rid = 'a'").count() > 1 and spark.read.parquet(chunks).where("rid = 'b'").count() == 1
    steps[0](spark.createDataFrame([bundle("b", "newer text here", 9)], COLUMNS), 1)
    assert spark.read.parquet(table).where("rid = 'b'").first().updated_at == 2  # an unchanged text is left alone


def test_all_namespaces_are_embedded(spark, tmp_path):
    kinds = ["plan", "task", "message", "transcript", "recording", "web", "code", "youtube", "journal", "research"]
    rows = [bundle(k, f"a {k} that is long enough " * 100, ns=f"x-{k}") for k in kinds] + [bundle("short", "ok", ns="x-message"), bundle("note", "ok", ns="x-journal"), bundle("none", None)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "bundles.parquet"))
    got = QUERIES["stm05_embed_consumer"](spark, str(tmp_path)).collect()
    assert {r.rid for r in got} == {*kinds, "note"}
    assert all(sum(r.rid == k for r in got) > 1 for k in kinds) and {r.dimensions for r in got} == {64}


def test_ontology(spark):
    assert ontology.types_of("message") == ["Person", "Topic", "Organization", "Tool"]
    assert len(ontology.types_of("unknown")) == len(ontology.type_map())
    rows = spark.createDataFrame([("message", "Person"), ("message", "Decision"), ("unknown", "Belief"), ("plan", "Nothing")], "kind string, t string")
    got = rows.select(ontology.allowed(F.col("kind"), F.col("t")).alias("ok"), ontology.supertype(F.col("t")).alias("s")).collect()
    assert [r.ok for r in got] == [True, False, True, False] and [r.s for r in got] == ["agent", "event", "concept", None]

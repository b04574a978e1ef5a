import math

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import entities, evaluation, fulltext, graph, ingest, retrieval
from quillmesh.operators.components import connected_components
from quillmesh.plans import catalog

BUNDLE = "rid string, namespace string, reference string, hash string, created_at int, updated_at int"


def test_upserts(spark):
    old = spark.createDataFrame([("a", "n", "r", "1", 1, 1), ("b", "n", "r", "1", 1, 1)], BUNDLE)
    new = spark.createDataFrame([("b", "m", "q", "2", 9, 9), ("c", "m", "q", "3", 9, 9), ("a", "m", "q", "1", 9, 9)], BUNDLE)
    got = {r.rid: tuple(r)[1:] for r in ingest.upsert(old, new, ["rid"], ingest.BUNDLE_KEPT).collect()}
    assert got == {"a": ("n", "r", "1", 1, 9), "b": ("n", "r", "2", 1, 9), "c": ("m", "q", "3", 9, 9)}
    same = {r.rid: r.updated_at for r in ingest.upsert(old, new, ["rid"], ingest.BUNDLE_KEPT, changed="hash").collect()}
    assert same == {"a": 1, "b": 9, "c": 9}
    assert ingest.upsert(old, new.limit(0), ["rid"]).count() == 2 and ingest.upsert(old.limit(0), new, ["rid"]).count() == 3


def test_changes_and_feed(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "1")], "rid string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "rid string, hash string")
    assert {r.rid: r.change for r in ingest.changes(state, new).collect()} == {"a": "same", "b": "update", "c": "new"}
    assert {r.rid: r.event for r in ingest.change_feed(state, new, digest="hash").collect()} == {"b": "bundle.updated", "c": "bundle.created"}


def test_deletions_and_renames(spark):
    t = spark.createDataFrame([("orn:a-x:1", "a-x", 0), ("orn:a-y:1:2", "a-y", 1), ("odd", None, 2)], "rid string, namespace string, chunk_index int")
    assert ingest.without(t, t.where("chunk_index = 0"), "rid").count() == 2
    assert {n: x.count() for n, x in ingest.cascade({"p": t, "q": t.limit(0)}, t.limit(1)).items()} == {"p": 2, "q": 0}
    got = [tuple(r)[:2] for r in ingest.rename_namespaces(t, {"a-y": "b-y"}).orderBy("chunk_index").collect()]
    assert got == [("orn:a-x:1", "a-x"), ("orn:b-y:1:2", "b-y"), ("odd", None)]
    counts = spark.createDataFrame([("odd", 2), ("orn:a-x:1", 1)], "rid string, n int")
    assert {r.rid for r in ingest.without_stale_chunks(t, counts).collect()} == {"orn:a-x:1", "orn:a-y:1:2"}
    assert ingest.since(t, "chunk_index", 0, 1).collect()[0].chunk_index == 1


def test_batch_and_snapshots(spark):
    b = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {r.k: r.v for r in ingest.last_of_batch(b, ["k"], ["o"]).collect()} == {"a": "y", "b": "z"}
    s = spark.createDataFrame([("u", 1, 5, 1, "old", ["a", "b"], "e"), ("u", 2, 3, 9, None, ["b", "c"], None)], "k string, at int, visit_count int, frecency int, title string, visits array<string>, engagement string")
    r = ingest.merge_snapshots(s, "k", "at").first()
    assert tuple(r)[1:] == (5, 9, "old", ["a", "b", "c"], "e")


def test_visits_rollup(spark):
    v = spark.createDataFrame([("p", i, "typed" if i % 3 else "link") for i in range(250)] + [("q", 1, "link")], "k string, at int, kind string")
    r = {x.k: x for x in ingest.visits_rollup(v, "k", "at", "kind").collect()}
    assert (r["p"].visits, r["p"].first_visit, r["p"].last_visit) == (250, 0, 249) and r["p"].kinds == {"link": 84, "typed": 166}
    assert [x["at"] for x in r["p"].recent] == list(range(249, 149, -1)) and len(r["q"].recent) == 1


DOCS = [("a", "The quick brown fox jumps"), ("b", "the brown bear, the quick hare"), ("c", "lazy dog"), ("d", None), ("e", "")]


@pytest.mark.parametrize(
    ("query", "want"),
    [("quick brown", {"a", "b"}), ('"quick brown"', {"a"}), ("fox or dog", {"a", "c"}), ("brown -fox", {"b"}), ('the -"brown bear"', {"a"}), ("missing", set()), ("", set()), ("-fox", set()), ("or fox", {"a"})],
)
def test_web_queries(spark, query, want):
    docs = spark.createDataFrame(DOCS, "rid string, search_text string")
    assert {r.rid for r in fulltext.search(fulltext.postings(docs), fulltext.corpus_size(docs), query).collect()} == want


def test_bm25_and_headline(spark):
    docs = spark.createDataFrame(DOCS, "rid string, search_text string")
    got = {r.rid: r.rank for r in fulltext.search(fulltext.postings(docs), fulltext.corpus_size(docs), "quick").collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    mean = (5 + 6 + 2) / 3
    assert got["a"] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / mean)))
    h = docs.select(fulltext.headline(F.col("search_text"), ["fox"]).alias("h")).collect()
    assert "**fox**" in h[0].h and h[3].h is None


def fused(spark, fts, near, alpha):
    f = spark.createDataFrame(fts, "rid string, rank double")
    n = spark.createDataFrame(near, "rid string, similarity double, chunk_text string")
    return [(r.rid, r.score) for r in retrieval.fuse(f, n, alpha).orderBy(F.desc("score"), "rid").collect()]


def test_fusion(spark):
    assert fused(spark, [("a", 1.0), ("b", 0.5)], [("c", 0.9, ""), ("d", 0.8, "")], 1.0)[0] == ("a", 1.0)
    assert fused(spark, [("a", 1.0)], [("b", 0.9, ""), ("c", 0.3, "")], 0.0)[0] == ("b", 0.9)
    assert fused(spark, [("o", 1.0)], [("o", 0.9, "")], 0.5) == [("o", 0.95)]
    assert fused(spark, [("x", 0.8), ("y", 0.2)], [], 1.0) == [("x", 1.0), ("y", 0.0)]
    assert fused(spark, [("x", 0.5), ("y", 0.5)], [], 1.0) == [("x", 1.0), ("y", 1.0)]
    assert fused(spark, [], [], 0.5) == []


def test_best_chunk_rerank_and_bonus(spark):
    hits = spark.createDataFrame([("a", 0.5, 1, 1, "x"), ("a", 0.7, 2, 2, "y"), ("a", 0.7, 1, 3, "z"), ("b", 0.6, 0, 4, "w")], "rid string, similarity double, chunk_index int, vec_id long, chunk_text string")
    assert {r.rid: r.chunk_text for r in retrieval.best_chunk(hits).collect()} == {"a": "z", "b": "w"}
    docs = spark.createDataFrame([("a", ["no", "fox dog"] + ["no"] * 9), ("b", ["fox"])], "rid string, c array<string>")
    got = retrieval.rerank_chunked(docs, retrieval.RERANKERS.create("overlap", "fox"), F.col("c")).collect()
    assert got[0].rid == "b" and retrieval.EMBEDDERS.names() == ["hashing"]
    with pytest.raises(ValueError, match="no reranker named x"):
        retrieval.RERANKERS.create("x")
    n = spark.range(1).select(retrieval.sample_chunks(F.array(*[F.lit(str(i)) for i in range(11)])).alias("s")).first().s
    assert n == ["0", "3", "5", "8", "10"]
    h = spark.createDataFrame([("a", 1, 0.5)], "rid string, pos int, score double")
    e = spark.createDataFrame([("a", 2), ("z", 1)], "rid string, entity_pos int")
    assert {r.rid: r.score for r in retrieval.with_entity_bonus(h, e).collect()} == {"a": 0.505, "z": 0.01}  # no hit, so nothing but its bonus
    emb = docs.select(retrieval.EMBEDDERS.create("hashing", 16)(F.lit("some words")).alias("e")).first().e
    assert sum(x * x for x in emb) == pytest.approx(1)


def test_pattern_entities(spark):
    text = "On 2026-03-11 and 2026-03-11 see https://example.com/docs, (/home/user/.config/app.json) v3.2.1 orn:ns.kind:2026-03-11."
    got = {(r.entity_type, r.name) for r in entities.extract(spark.createDataFrame([("r", text), ("n", None)], "rid string, search_text string")).collect()}
    assert {("Date", "2026-03-11"), ("URL", "https://example.com/docs"), ("Path", "/home/user/.config/app.json"), ("Version", "3.2.1"), ("RID", "orn:ns.kind:2026-03-11")} <= got


def test_merged_entities(spark):
    f = spark.createDataFrame([("r", "Alpha", "Tool", "artifact", 0.7), ("r", "alpha ", "Tool", "artifact", 0.95), ("r", "Alpha", "Person", "agent", 0.5)], "rid string, name string, entity_type string, supertype string, confidence double")
    assert sorted((r.entity_type, r.confidence) for r in entities.merge(f).collect()) == [("Person", 0.5), ("Tool", 0.95)]


def test_cooccurrence(spark):
    e = spark.createDataFrame([(1, "graph memory", "graph memory", "Topic", 5), (2, "other", "other", "Topic", 1), (3, "third", "third", "Tool", 2)], "entity_id long, name string, name_normalized string, entity_type string, mention_count int")
    links = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 2), ("y", 3), ("z", 3)], "rid string, entity_id long")
    assert [(r.entity_id, r.shared) for r in entities.cooccurring(e, links, "graph memory").collect()] == [(2, 2), (3, 1)]


def walk(edges, seeds, d=0.85, rounds=30):
    nodes = {n for s, t, _ in edges for n in (s, t)}
    total = {}
    for s, _, w in edges:
        total[s] = total.get(s, 0) + (w or 1.0)
    base = {n: (1 / len([x for x in seeds if x in nodes]) if n in seeds else 0.0) for n in nodes}
    score = dict(base)
    for _ in range(rounds):
        score = {n: (1 - d) * base[n] + d * sum(score[s] * (w or 1.0) / total[s] for s, t, w in edges if t == n) for n in nodes}
    return score


def test_pagerank(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", None), ("c", "a", 0.0), ("a", "b", 1.0), ("d", "dangling", 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    got = {r.node: r.score for r in graph.pagerank(df, spark.createDataFrame([("a",), ("gone",)], "node string"), epsilon=0.0).collect()}
    assert got == pytest.approx(walk(edges, {"a"}))
    assert graph.pagerank(df, spark.createDataFrame([("gone",)], "node string")).count() == 0
    assert graph.pagerank(df.limit(0), spark.createDataFrame([("a",)], "node string")).count() == 0


def test_triples_seeds_and_paths(spark):
    t = spark.createDataFrame([("a", "t", "b", "s1", 1), ("a", "t", "b", "s0", 2), ("a", "t", "c", "s1", 1)], "src string, type string, dst string, source string, at int")
    got = {(r.src, r.dst): (r.weight, r.source, r.last_accessed) for r in graph.merge_triples(t).collect()}
    assert got == {("a", "b"): (1.1, "s1", 2), ("a", "c"): (1.0, "s1", 1)}
    n = spark.createDataFrame([(1, "Graph"), (2, "graph memory"), (3, "other")], "node long, name string")
    assert {r.node for r in graph.find_seeds(n, ["graph", "oth"]).collect()} == {1, 3}
    i = spark.createDataFrame([(1, None, "root"), (2, 1, "a"), (3, 2, "b"), (8, 9, "x"), (9, 8, "y")], "id long, parent long, title string")
    paths = {r.id: r.path for r in graph.folder_paths(i, 5).collect()}
    assert paths[3] == "/root/a/b" and paths[1] == "/root" and set(paths) == {1, 2, 3, 8, 9}


def test_components(spark):
    e = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 100), (None, 3), (50, 45), (3, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got[i] == i // 10 * 10 for i in range(40)) and got[50] == got[45] == 45 and 100 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_retrieval_metrics(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3), ("q", "b", 9), ("e", "x", 1), ("n", "y", 1)], "query_id string, rid string, pos int")
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 1), ("e", "z", 1)], "query_id string, rid string, grade int")
    got = {r.query_id: r for r in evaluation.retrieval_metrics(run, qrels, 10).collect()}
    dcg, ideal = 1 + 2 / math.log2(4), 2 + 1 / math.log2(3) + 1 / 2
    assert (got["q"].recall, got["q"].mrr, got["q"].ndcg, got["q"].ap) == pytest.approx((2 / 3, 1.0, dcg / ideal, (1 + 2 / 3) / 3), abs=1e-6)
    assert tuple(got["e"])[1:] == tuple(got["n"])[1:] == (0, 0, 0, 0)


def test_quantiles_alpha_and_extraction(spark):
    t = spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double")
    assert tuple(evaluation.latency(t, "v").first()) == (10.5, 11.0, 20.0, 20.0)
    assert tuple(evaluation.quantile_elements(t, "v").first()) == (11.0, 20.0)
    f = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 1.0)], "query_id string, rid string, rank double")
    n = spark.createDataFrame([("q", "c", 0.9)], "query_id string, rid string, similarity double")
    g = evaluation.alpha_grid(f, n, spark.createDataFrame([("q", "c", 1)], "query_id string, rid string, grade int"), steps=2).orderBy("alpha").collect()
    assert [(r.alpha, r.mrr) for r in g] == [(0.0, 1.0), (0.5, 0.5), (1.0, round(1 / 3, 6))]
    k = "rid string, name_normalized string, entity_type string"
    p = spark.createDataFrame([("a", "x", "T"), ("a", "y", "T"), ("b", "z", "T")], k)
    s = {r.rid: tuple(r)[1:] for r in evaluation.extraction_scores(p, spark.createDataFrame([("a", "x", "T"), ("c", "q", "T")], k)).collect()}
    assert s == {"a": (0.5, 1.0, 0.666667), "b": (0.0, 1.0, 0.0), "c": (0.0, 0.0, 0.0)}
    r = spark.createDataFrame([("base", 1, 0.5), ("new", 2, 0.75)], "label string, at int, ndcg double")
    assert {x.label: x.d_ndcg for x in evaluation.against_first(r, "label", "at", ("ndcg",)).collect()} == {"base": 0.0, "new": 0.25}


def test_many_queries(spark):
    docs = spark.createDataFrame(DOCS, "rid string, search_text string")
    words = fulltext.tokenised(docs)
    q = spark.createDataFrame([("1", "quick brown"), ("2", "lazy"), ("3", "quick missing"), ("4", None), ("5", "The THE the")], "query_id string, query string")
    got = fulltext.search_many(fulltext.frequencies(words), fulltext.corpus_size(words), q).collect()
    assert {(r.query_id, r.rid) for r in got} == {("1", "a"), ("1", "b"), ("2", "c"), ("5", "a"), ("5", "b")}
    one = {r.rid: round(r["rank"], 5) for r in fulltext.search(fulltext.postings(words), fulltext.corpus_size(words), "quick brown").collect()}
    assert {r.rid: r["rank"] for r in got if r.query_id == "1"} == one


def shuffled(spark):
    """Rows that all stages so far wrote to shuffles."""
    jvm = spark._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_candidates_of_many_queries_are_no_rows(spark):
    heads = [f"h{i:02}" for i in range(12)]
    docs = fulltext.tokenised(spark.createDataFrame([(f"d{i:03}", f"common often {heads[i % 12]} {heads[i % 5]}") for i in range(600)], "rid string, search_text string"))
    asked = spark.createDataFrame([(i, f"common often {heads[i % 12]} {heads[i // 12 % 12]}") for i in range(600)], "query_id int, query string")
    index, size = fulltext.frequencies(docs), fulltext.corpus_size(docs)
    before = shuffled(spark)
    got = fulltext.search_many(index, size, asked).collect()
    written = sum(n for stage, n in shuffled(spark).items() if stage not in before)
    assert len(got) > 600 and written < 30_000  # 600 queries have 30,000 candidates at their rarest word, and meet each with three words


def test_many_queries_in_blocks_and_chunks(spark, monkeypatch):
    rows = [(f"d{i:03}", " ".join(w for n, w in ((2, "two"), (3, "three"), (5, "five"), (7, "seven"), (49, "rare")) if i % n == 0)) for i in range(1, 400)]
    docs = fulltext.tokenised(spark.createDataFrame(rows, "rid string, search_text string"))
    texts = ["two three", "three TWO three", "five", "two three five seven", "rare two", "rare seven", "five none", "..."]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    index, size = fulltext.frequencies(docs), fulltext.corpus_size(docs)
    for block, chunk in ((1 << 18, 1 << 16), (50, 2)):
        monkeypatch.setattr(fulltext, "BLOCK", block)
        monkeypatch.setattr(fulltext, "CHUNK", chunk)
        got = {}
        for r in fulltext.search_many(index, size, asked, most=9).orderBy("query_id", "pos").collect():
            got.setdefault(r.query_id, []).append((r.rid, r["rank"]))
        assert set(got) == {0, 1, 2, 3, 4, 5} and got[0] == got[1]
        for n, hits in got.items():
            one = fulltext.search(fulltext.postings(docs), size, texts[n]).select("rid", F.round("rank", 5).alias("rank")).orderBy(F.desc("rank"), "rid").limit(9).collect()
            assert hits == [tuple(r) for r in one]


def test_whole_texts_are_embedded(spark):
    embed = retrieval.EMBEDDERS.create("hashing", 16)
    r = spark.createDataFrame([("word " * 1000, "word " * 1000 + "others at the end " * 300)], "a string, b string").select(embed("a").alias("a"), embed("b").alias("b")).first()
    assert r.a != r.b


def test_names_of_many_lengths_are_found(spark, tmp_path):
    names = [" ".join(["alpha"] + ["beta"] * n) for n in range(20)]
    spark.createDataFrame([("Topic", n) for n in names], "entity_type string, name_normalized string").write.parquet(str(tmp_path / "entities.parquet"))
    spark.createDataFrame([("a", 1, f"See {names[-1]}.")], "rid string, updated_at int, search_text string").write.parquet(str(tmp_path / "bundles.parquet"))
    assert {r.name for r in catalog.QUERIES["join13_cross_references"](spark, str(tmp_path)).collect()} == set(names)

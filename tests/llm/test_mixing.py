import numpy as np
import pandas as pd
import pytest

from quillmesh.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, namespace string, copies string, topic string"
TARGETS = "source string, target_share double, max_repeats int, tokens string"


def docs(spark, spec):
    rows, i = [], 0
    for source, n, lang in spec:
        for _ in range(n):
            rows.append((i, f"some words of document {i} go here and there", lang, source, "ns", "x", "x"))
            i += 1
    return spark.createDataFrame(rows, DOCS)


def test_shares_and_caps(spark):
    d = docs(spark, [("a", 1500, "en"), ("a", 500, "de"), ("b", 900, "EN-x"), ("c", 60, None), (None, 300, "en"), ("z", 200, "en")])
    t = spark.createDataFrame([("a", 0.5, 1, ""), ("b", 0.3, 2, ""), ("c", 0.15, 3, ""), ("gone", 0.05, 2, ""), (None, 0.5, 1, "")], TARGETS)
    drawn = mixing.mix(d, t)
    got = {r.source: r for r in mixing.shares(drawn, t).collect()}
    total = sum(r.n_tokens for r in mixing.counted(d, t).collect())
    assert set(got) == {"a", "b", "c", "gone"}
    assert got["a"].tokens == pytest.approx(0.5 * total, rel=0.02)
    assert got["b"].tokens == pytest.approx(0.3 * total, rel=0.02)
    assert got["c"].copies == 180 and got["c"].most_repeats == 3  # all that it has
    assert got["gone"].tokens == 0
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1)
    assert all(r.copies <= {"a": 1, "b": 2, "c": 3}[r.source] for r in drawn.collect())
    again = sorted((r.doc_id, r.copies) for r in mixing.mix(d, t).collect())
    assert again == sorted((r.doc_id, r.copies) for r in drawn.collect())


def test_raking_meets_marginals():
    r = np.random.default_rng(1)
    cells = pd.DataFrame([(s, lang, t, float(r.integers(50, 500))) for s in "ab" for lang in ("de", "en", "fr") for t in "xy"], columns=["source", "lang", "topic", "tokens"])
    goal = pd.DataFrame({"source": ["a", "b"], "target_share": [0.7, 0.3], "max_repeats": [9, 9]})
    got = mixing.rake(cells, goal)
    drawn = got["weight"] * got["tokens"]
    total = cells["tokens"].sum()
    assert drawn.groupby(got["source"]).sum().to_dict() == pytest.approx({"a": 0.7 * total, "b": 0.3 * total})
    assert drawn.groupby(got["lang"]).sum().to_dict() == pytest.approx(cells.groupby("lang")["tokens"].sum().to_dict(), rel=1e-3)


def test_odd_rows_and_empty_tables(spark):
    d = spark.createDataFrame([(1, None, "en", "a", "ns", "", ""), (2, "", "en", "a", None, "", ""), (3, "words here", "en", "a", None, "", ""), (3, "words here", "en", "a", None, "", "")], DOCS)
    t = spark.createDataFrame([("a", 1.0, 1, ""), ("a", None, None, ""), ("b", -1.0, None, "")], TARGETS)
    assert sorted((r.doc_id, r.copies) for r in mixing.mix(d, t).collect()) == [(3, 1), (3, 1)]
    assert mixing.mix(d, t.limit(0)).count() == 0
    assert mixing.mix(d.limit(0), t).count() == 0
    assert [r.actual_share for r in mixing.shares(mixing.mix(d.limit(0), t), t).orderBy("source").collect()] == [0.0, 0.0]


def test_languages(spark):
    rows = spark.createDataFrame([("EN",), ("en-x",), ("und",), (None,), (" de ",), ("fr_FR",), ("???",)], "lang string")
    assert [r.l for r in rows.select(mixing.language(rows["lang"]).alias("l")).collect()] == ["en", "en", "und", "und", "de", "fr", "und"]

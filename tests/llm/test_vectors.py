import numpy as np
import pytest

from quillmesh.llm import vectors

CHUNKS = "vec_id long, config_id string, embedding array<float>, dimensions string, leaf string"
CONFIGS = "config_id string, dimensions int, vec_id string"


def configs(spark, *rows):
    return spark.createDataFrame([(c, n, "clash") for c, n in rows], CONFIGS)


def chunks(spark, rows):
    return spark.createDataFrame([(i, c, e, "clash", "clash") for i, c, e in rows], CHUNKS)


def clustered(n, dims, seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dims))
    for i in range(0, n - 3, 4):
        base[i + 1] = base[i] + r.normal(size=dims) * 0.2
    return (base * r.uniform(0.2, 6, size=(n, 1))).astype("float32")


def brute(matrix, least):
    u = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    s = u.astype("float64") @ u.astype("float64").T
    return {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i, j] >= least}


@pytest.mark.parametrize(("leaf", "block"), [(8192, 8192), (64, 8192), (64, 40)])
def test_pairs_match_brute_force(spark, leaf, block):
    m = clustered(400, 24)
    got = vectors.similar_pairs(chunks(spark, [(i, "a", v.tolist()) for i, v in enumerate(m)]), configs(spark, ("a", 24)), 0.9, factor=4.0, leaf=leaf, block=block)
    found = {(r.vec_id_a, r.vec_id_b) for r in got.collect()}
    want = brute(m, 0.9)
    assert found <= want
    assert len(found) >= 0.98 * len(want)


def test_factor_one_is_exact(spark):
    m = clustered(300, 16, 3)
    c = chunks(spark, [(i, "a", v.tolist()) for i, v in enumerate(m)])
    found = {(r.vec_id_a, r.vec_id_b) for r in vectors.similar_pairs(c, configs(spark, ("a", 16)), 0.9, factor=1.0, leaf=64).collect()}
    assert found == brute(m, 0.9)
    near = vectors.nearest(c, configs(spark, ("a", 16)), k=5, every=1, factor=1.0, leaf=64).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    for i in range(len(m)):
        assert {r.neighbour for r in near if r.vec_id == i} == set(np.argsort(-s[i])[:5].tolist())


def test_recall_of_the_relaxed_search(spark):
    m = clustered(1500, 32, 5)
    c = chunks(spark, [(i, "a", v.tolist()) for i, v in enumerate(m)])
    near = vectors.nearest(c, configs(spark, ("a", 32)), k=10, every=20, leaf=256).toPandas()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert sorted(near.vec_id.unique()) == list(range(0, 1500, 20))
    hit = sum(len(set(near[near.vec_id == i].neighbour) & set(np.argsort(-s[i])[:10].tolist())) for i in range(0, 1500, 20))
    assert hit / (75 * 10) >= 0.9


def test_unusable_vectors_and_configurations(spark):
    nan = float("nan")
    rows = [
        (1, "a", [1.0, 0.0]), (2, "a", [2.0, 0.0]), (3, "a", None), (4, "a", []), (5, "a", [0.0, 0.0]), (6, "a", [nan, 1.0]), (7, "a", [1.0, 0.0, 0.0]),
        (8, "b", [1.0, 0.0]), (9, None, [1.0, 0.0]), (10, "x", [1.0, 0.0]), (None, "a", [1.0, 0.0]), (11, "a", [None, 1.0]), (12, "a", [float("inf"), 0.0]), (2, "a", [2.0, 0.0]),
    ]
    got = vectors.similar_pairs(chunks(spark, rows), configs(spark, ("a", 2), ("b", 2))).collect()
    assert {(r.vec_id_a, r.vec_id_b) for r in got} == {(1, 2)}


def test_very_small_and_large_norms(spark):
    got = vectors.similar_pairs(chunks(spark, [(1, "a", [1e-30, 0.0]), (2, "a", [1e30, 0.0])]), configs(spark, ("a", 2))).collect()
    assert [(r.vec_id_a, r.vec_id_b) for r in got] == [(1, 2)]


def test_a_third_of_equal_vectors_is_split(spark):
    m = clustered(200, 8, 9)
    rows = [(i, "a", (m[0] if i % 3 == 0 else m[i]).tolist()) for i in range(200)]
    got = vectors.similar_pairs(chunks(spark, rows), configs(spark, ("a", 8)), 0.999, leaf=16, block=16)
    same = {i for i in range(200) if i % 3 == 0}
    found = {(r.vec_id_a, r.vec_id_b) for r in got.collect()}
    assert {(i, j) for i in same for j in same if i < j} <= found


def test_empty_tables(spark):
    assert vectors.similar_pairs(chunks(spark, []), configs(spark)).count() == 0
    assert vectors.nearest(chunks(spark, []), configs(spark, ("a", 2))).count() == 0

"""Nearest vectors for every vector, through vantage-point trees with relaxed triangle-inequality pruning.

Vectors are scaled to length 1, so a cosine c is a distance sqrt(2 - 2c). Per configuration a vantage-point tree is
fitted on a bounded sample of its vectors; its leaves are the shards. Every vector is stored in one leaf, its home. A
search of radius r enters both sides of a node where |d(q, vantage) - median| <= r / factor: with factor 1 that is
the triangle inequality and the search is exact, a larger factor leaves out more. Inside a leaf all distances are
computed, in blocks. The nearest-neighbour search takes two passes: the first looks into a query's home leaf, and the
distance of the k-th neighbour found there is the query's own radius in the second.

Shards of more rows than ``block`` are cut into blocks, and their searching rows into parts, which meet one by one; so
no task holds more than about ``block`` stored and four times as many searching rows, even if a third of all vectors
are equal. The numbers of blocks and parts follow from the sample's shares, with a quarter to spare.

Usable vectors have exactly the configuration's dimensions, no null, NaN or infinite element, and aren't all zero.
Others, null and empty ones, and rows of an unknown configuration take no part. Rows with a null vec_id take none.
Equal vectors are ordinary partners of each other (cosine 1). Ties of a cosine go to the smaller vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmesh.runtime import durable

#: The tree of a configuration is fitted on about so many of its vectors for each leaf, within these bounds.
SAMPLE_PER_LEAF = 128
SAMPLE = (2048, 65_536)
#: Bytes that the samples of all configurations have together at most.
SAMPLE_BYTES = 256 << 20
#: Rows that a leaf should hold, and most stored rows that one group compares.
LEAF = 8192
BLOCK = 8192
#: A leaf needs so many sample rows for its border to mean anything; this bounds the depth whatever the input.
LEAST_SAMPLE = 32
#: Pruning factor of the range search; the searches of random pairs at cosine 0.9 lose under 1 in 100.
FACTOR = 7.0
_TILE = 2048


class VantageTree:
    """Nodes in heap order: vantage point and median distance, or a leaf."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 7):
        self.points: dict[int, np.ndarray] = {}
        self.median: dict[int, float] = {}
        self.share: dict[int, float] = {}
        random = np.random.default_rng(seed)
        todo = [(0, np.arange(len(sample)), 0)]
        while todo:
            node, rows, level = todo.pop()
            best = None
            if level < depth and len(rows) >= 2 * LEAST_SAMPLE:
                for v in sample[random.choice(rows, size=min(8, len(rows)), replace=False)]:
                    d = distance(sample[rows], v)
                    m = float(np.median(d))
                    left = d <= m
                    if 0.25 < left.mean() < 0.75 and (best is None or d.std() > best[0]):
                        best = (d.std(), v, m, left)
            if best is None:
                self.share[node] = len(rows) / max(1, len(sample))
                continue
            self.points[node], self.median[node] = best[1], best[2]
            todo += [(2 * node + 1, rows[best[3]], level + 1), (2 * node + 2, rows[~best[3]], level + 1)]

    def visit(self, vectors: np.ndarray, margin: float | np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows that enter it, which of them live there); the margin is one for all or one for each row."""
        todo = [(0, np.arange(len(vectors)), np.ones(len(vectors), dtype=bool))]
        while todo:
            node, rows, home = todo.pop()
            if node not in self.points:
                if len(rows):
                    yield node, rows, home
                continue
            d = distance(vectors[rows], self.points[node])
            m = self.median[node]
            wide = margin[rows] if isinstance(margin, np.ndarray) else margin
            left, right = d <= m + wide, d > m - wide
            todo += [(2 * node + 1, rows[left], home[left] & (d <= m)[left]), (2 * node + 2, rows[right], home[right] & (d > m)[right])]


def distance(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (vectors @ point)))


def unit_rows(column: pa.Array, dims: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Row numbers of the usable vectors, and by length the matrix of their unit vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(column.offsets)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(ends)
    valid = np.asarray(column.is_valid()) & (size == dims) & (size > 0)
    kept, made = [], {}
    for n in np.unique(size[valid]):
        rows = np.flatnonzero(valid & (size == n))
        matrix = values[ends[rows][:, None] + np.arange(n)[None, :]]
        with np.errstate(all="ignore"):
            norm = np.sqrt((matrix * matrix).sum(axis=1))
            scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
            norm = np.where(np.isfinite(norm) & (norm > 1e-150), norm, np.nan)
            odd = np.isnan(norm)
            if odd.any():  # very large or small values: scale first
                again = np.sqrt((scaled * scaled).sum(axis=1))
                matrix = np.where(odd[:, None], scaled / again[:, None], matrix / norm[:, None])
            else:
                matrix = matrix / norm[:, None]
        good = np.isfinite(matrix).all(axis=1)
        kept.append(rows[good])
        made[int(n)] = (rows[good], matrix[good].astype(np.float32))
    return (np.concatenate(kept) if kept else np.empty(0, dtype=np.int64)), made


def _usable(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    return (
        chunks.select("vec_id", "config_id", "embedding")
        .join(configs.select("config_id", "dimensions").where("config_id is not null").groupBy("config_id").agg(F.max("dimensions").alias("dimensions")), "config_id")
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") == F.col("dimensions")) & (F.col("dimensions") > 0))
    )


def fit_trees(usable: DataFrame, leaf: int = LEAF, sample: tuple[int, int] = SAMPLE, k: int = 10) -> dict[str, tuple[VantageTree, int, float, np.ndarray]]:
    """Per configuration: tree, number of rows, a radius within which the k nearest of nearly every vector lie, and
    the sample.

    Fitted on the vectors with the least hashes of their ids: ``SAMPLE_PER_LEAF`` for each leaf, at least and at most
    ``sample`` of a configuration, and no more than fit in ``SAMPLE_BYTES`` for all configurations together.
    """
    counts, most = {}, {}
    for r in usable.groupBy("config_id").agg(F.count(F.lit(1)).alias("n"), F.max("dimensions").alias("d")).collect():
        counts[r.config_id], most[r.config_id] = r.n, r.d
    if not counts:
        return {}
    room = {c: max(1, min(sample[1], SAMPLE_BYTES // len(counts) // (4 * d))) for c, d in most.items()}
    share = F.create_map(*[F.lit(x) for c, n in sorted(counts.items()) for x in (c, min(1.0, min(room[c], max(sample[0], SAMPLE_PER_LEAF * n // leaf)) / n))])
    picked = usable.where((F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)) < share[F.col("config_id")])
    got = picked.select("config_id", "embedding").toArrow()
    trees = {}
    names = np.asarray(got.column("config_id").to_pylist(), dtype=object)
    for config, n in counts.items():
        rows = np.flatnonzero(names == config)
        column = got.column("embedding").combine_chunks().take(pa.array(rows))
        dims = np.diff(np.asarray(column.offsets))
        _, made = unit_rows(column, dims)
        points = max((m for _, m in made.values()), key=len, default=np.empty((0, 1), dtype=np.float32))
        radius = 2.0
        if len(points) > k:
            some = points[:512] @ points.T
            kth = -np.partition(-some, k, axis=1)[:, k]
            radius = float(np.sqrt(max(0.0, 2 - 2 * np.percentile(kth, 5))))
        depth = max(0, math.ceil(math.log2(max(1.0, n / leaf))))
        trees[config] = (VantageTree(points, depth), n, radius, points)
    return trees


def _plan(trees: dict, margins: dict[str, float], block: int, every: int | None) -> dict[str, tuple[VantageTree, dict[int, tuple[int, int]]]]:
    """Per configuration and leaf the numbers of blocks and of searching parts."""
    out = {}
    for config, (tree, n, _, points) in trees.items():
        enter = {node: len(rows) / max(1, len(points)) for node, rows, _ in tree.visit(points, margins[config])}
        sizes = {}
        for node, share in tree.share.items():
            searching = enter.get(node, 0.0) * n / (every or 1)
            sizes[node] = tuple(1 if x <= most else math.ceil(1.25 * x / most) for x, most in ((share * n, block), (searching, 4 * block)))
        out[config] = (tree, sizes)
    return out


_ROUTED = "config_id string, leaf int, block int, part int, stored boolean, searching boolean, vec_id long, unit binary"


def _scatter(ids: np.ndarray, shift: int, n: int) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(shift)).astype(np.int64) % n


def _router(plan: dict, margins: dict[str, float], every: int | None):
    """Rows for the groups they take part in. every None: pairs, all rows search; else those with vec_id % every == 0.

    A stored row goes to every part of its block, a searching row to its part of every block. For pairs, the rows of a
    block meet each other in part 0, and search the later blocks of their leaf.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.asarray(batch.column(1).to_pylist(), dtype=object)
            ids_all = batch.column(0).to_numpy(zero_copy_only=False)
            _, made = unit_rows(batch.column(2), batch.column(3).to_numpy(zero_copy_only=False))
            for rows, matrix in made.values():
                for config in set(names[rows].tolist()):
                    own = np.flatnonzero(names[rows] == config)
                    ids, units = ids_all[rows[own]], matrix[own]
                    tree, sizes = plan[config]
                    held: list[list[np.ndarray]] = [[], [], [], [], [], []]

                    def add(leaf, block, part, stored, searching, which):
                        full = (np.full(len(which), x, dtype=np.int32) if np.isscalar(x) else x.astype(np.int32) for x in (leaf, block, part))
                        for column, x in zip(held, (*full, np.full(len(which), stored), np.full(len(which), searching), which), strict=True):
                            column.append(x)

                    for leaf, who, home in tree.visit(units, margins[config]):
                        blocks, parts = sizes[leaf]
                        at, part = _scatter(ids[who], 40, blocks), _scatter(ids[who], 20, parts)
                        for p in range(parts):
                            add(leaf, at[home], p, True, every is None and p == 0, who[home])
                        asks = ~home if every is None else ids[who] % every == 0
                        for b in range(blocks):
                            ask = asks | (home & (at < b)) if every is None else asks
                            add(leaf, b, part[ask], False, True, who[ask])
                    which = np.concatenate(held[5])
                    raw, width = units.tobytes(), units.shape[1] * 4
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([config] * len(which), type=pa.string()),
                            *(pa.array(np.concatenate(p)) for p in held[:5]),
                            pa.array(ids[which], type=pa.int64()),
                            pa.array([raw[i * width : (i + 1) * width] for i in which.tolist()], type=pa.binary()),
                        ],
                        names=["config_id", "leaf", "block", "part", "stored", "searching", "vec_id", "unit"],
                    )

    return run


def _matrix(table: pa.Table, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    part = table.filter(pa.array(mask))
    ids = part.column("vec_id").to_numpy()
    raw = b"".join(part.column("unit").to_pylist())
    return ids, np.frombuffer(raw, dtype=np.float32).reshape(len(ids), -1) if len(ids) else np.empty((0, 1), dtype=np.float32)


def _pairs_in_group(least: float):
    def run(table: pa.Table) -> pa.Table:
        stored = table.column("stored").to_numpy(zero_copy_only=False).astype(bool)
        ids, home = _matrix(table, stored)
        other_ids, other = _matrix(table, ~stored)
        among = bool(pc.any(pc.and_(table.column("stored"), table.column("searching"))).as_py())
        left, right, cosines = [], [], []
        for s in range(0, len(ids), _TILE):
            data = home[s : s + _TILE]
            for who, queries, own in ((ids, home, True), (other_ids, other, False))[not among :]:
                for q in range(s if own else 0, len(who), _TILE):
                    dots = queries[q : q + _TILE] @ data.T
                    a, b = np.nonzero(dots >= least - 1e-6)
                    if own and q == s:
                        a, b = a[a > b], b[a > b]
                    exact = np.einsum("ij,ij->i", queries[q + a].astype(np.float64), data[b].astype(np.float64)) if len(a) else np.empty(0)
                    keep = exact >= least - 1e-9
                    left.append(who[q + a][keep])
                    right.append(ids[s + b][keep])
                    cosines.append(exact[keep])
        a, b = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (left, right))
        keep = a != b
        return pa.table({"vec_id_a": np.minimum(a, b)[keep], "vec_id_b": np.maximum(a, b)[keep], "cosine": np.concatenate(cosines)[keep] if cosines else np.empty(0)})

    return run


def _nearest_in_group(k: int):
    def run(table: pa.Table) -> pa.Table:
        stored = table.column("stored").to_numpy(zero_copy_only=False).astype(bool)
        ids, home = _matrix(table, stored)
        asking_ids, asking = _matrix(table, ~stored)
        out = ([], [], [])
        if len(ids):
            order = np.argsort(ids, kind="stable")
            ids, home = ids[order], home[order]
            for q in range(0, len(asking_ids), 512):
                dots = asking[q : q + 512] @ home.T
                dots[asking_ids[q : q + 512, None] == ids[None, :]] = -2
                near = min(k, dots.shape[1])
                # the k-th value, then everything at least as near, so that ties are kept for the final order
                border = -np.partition(-dots, near - 1, axis=1)[:, near - 1]
                a, b = np.nonzero((dots >= border[:, None]) & (dots > -2))
                rank = np.lexsort((b, -dots[a, b], a))
                a, b = a[rank], b[rank]
                first = np.searchsorted(a, a, side="left")
                keep = np.arange(len(a)) - first < k
                for held, x in zip(out, (asking_ids[q + a[keep]], ids[b[keep]], dots[a[keep], b[keep]].astype(np.float64)), strict=True):
                    held.append(x)
        a, b, c = (np.concatenate(x) if x else np.empty(0) for x in out)
        return pa.table({"vec_id": a.astype(np.int64), "neighbour": b.astype(np.int64), "cosine": c})

    return run


def similar_pairs(chunks: DataFrame, configs: DataFrame, least: float = 0.9, factor: float = FACTOR, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """``(vec_id_a, vec_id_b, cosine)`` of all pairs of one configuration whose cosine is at least ``least``."""
    usable = _usable(chunks, configs)
    trees = fit_trees(usable, leaf)
    margins = {c: math.sqrt(2 - 2 * least) / factor for c in trees}
    routed = usable.select("vec_id", "config_id", "embedding", "dimensions").mapInArrow(_router(_plan(trees, margins, block, None), margins, None), _ROUTED)
    pairs = routed.groupBy("config_id", "leaf", "block", "part").applyInArrow(_pairs_in_group(least), "vec_id_a long, vec_id_b long, cosine double")
    return pairs.groupBy("vec_id_a", "vec_id_b").agg(F.max("cosine").alias("cosine"))


def _query_router(plan: dict, factor: float):
    """Rows for the groups they take part in: a row without a radius is stored in its home, one with a radius asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.asarray(batch.column(1).to_pylist(), dtype=object)
            ids_all = batch.column(0).to_numpy(zero_copy_only=False)
            radii = batch.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
            _, made = unit_rows(batch.column(2), batch.column(3).to_numpy(zero_copy_only=False))
            for rows, matrix in made.values():
                for config in set(names[rows].tolist()):
                    own = np.flatnonzero(names[rows] == config)
                    ids, units, radius = ids_all[rows[own]], matrix[own], radii[rows[own]]
                    tree, sizes = plan[config]
                    asks = ~np.isnan(radius)
                    margin = np.where(asks, radius / factor + (1e-6 if factor <= 1 else 0.0), 0.0)
                    held: list[list[np.ndarray]] = [[], [], [], [], []]

                    def add(leaf, block, part, stored, which):
                        for column, x in zip(held, (np.full(len(which), leaf), block, part, np.full(len(which), stored), which), strict=True):
                            column.append(x)

                    for leaf, who, home in tree.visit(units, margin):
                        blocks, parts = sizes[leaf]
                        lives, seeks = who[home & ~asks[who]], who[asks[who]]
                        for p in range(parts):
                            add(leaf, _scatter(ids[lives], 40, blocks), np.full(len(lives), p), True, lives)
                        for b in range(blocks):
                            add(leaf, np.full(len(seeks), b), _scatter(ids[seeks], 20, parts), False, seeks)
                    which = np.concatenate(held[4])
                    raw, width = units.tobytes(), units.shape[1] * 4
                    stored = np.concatenate(held[3]).astype(bool)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([config] * len(which), type=pa.string()),
                            *(pa.array(np.concatenate(x).astype(np.int32)) for x in held[:3]),
                            pa.array(stored), pa.array(~stored), pa.array(ids[which], type=pa.int64()),
                            pa.array([raw[i * width : (i + 1) * width] for i in which.tolist()], type=pa.binary()),
                        ],
                        names=["config_id", "leaf", "block", "part", "stored", "searching", "vec_id", "unit"],
                    )

    return run


def nearest(chunks: DataFrame, configs: DataFrame, k: int = 10, every: int = 20, factor: float = 4.0, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest rows ``(vec_id, rank, neighbour, cosine)`` of every row whose id is divisible by ``every``.

    A query's radius is the distance of the k-th neighbour in its home leaf, an upper bound of that of its true k-th
    one (2, which is everything, where the leaf has fewer); it is divided by ``factor`` for the pruning, so with factor
    1 the result is exact by the triangle inequality.
    """
    usable = _usable(chunks, configs)
    trees = fit_trees(usable, leaf, k=k)
    rows = usable.select("vec_id", "config_id", "embedding", "dimensions")
    asking = rows.where(F.col("vec_id") % every == 0)
    order = W.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour")

    def search(queries: DataFrame, factor: float, margins: dict[str, float]) -> DataFrame:
        both = rows.withColumn("radius", F.lit(None).cast("double")).unionByName(queries)
        routed = both.mapInArrow(_query_router(_plan(trees, margins, block, every), factor), _ROUTED)
        found = routed.groupBy("config_id", "leaf", "block", "part").applyInArrow(_nearest_in_group(k), "vec_id long, neighbour long, cosine double")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = search(asking.withColumn("radius", F.lit(0.0)), 1.0, dict.fromkeys(trees, 0.0))
    kth = durable(first.where(F.col("rank") == k).select("vec_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cosine"))).alias("radius")))
    queries = asking.join(kth, "vec_id", "left").select("vec_id", "config_id", "embedding", "dimensions", F.coalesce("radius", F.lit(2.0)).alias("radius"))
    return search(queries, max(1.0, factor), {c: r / max(1.0, factor) for c, (_, _, r, _) in trees.items()}).select("vec_id", "rank", "neighbour", "cosine")

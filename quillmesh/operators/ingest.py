"""Tables kept up to date: change detection, upserts, deletions, renames. All take and give whole tables.

Nothing here needs a table format: a merge is an outer join on the key, so it can be written to a new folder and put
in place of the old one, or be replaced by a MERGE where the format has it. Rows with a null key never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BUNDLE_KEPT = ("namespace", "reference", "created_at")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def record_hash(*columns: str) -> Column:
    """A hash of some fields in a fixed order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def last_of_batch(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last of the batch in the given order. A max over a struct, combined on the map side."""
    rest = [c for c in batch.columns if c not in keys and c not in order]
    return batch.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in batch.columns])


def changes(state: DataFrame, incoming: DataFrame, key: str = "rid", digest: str = "hash") -> DataFrame:
    """``incoming`` with ``change``: new, update or same, against the last known hashes."""
    known = state.select(F.col(key), F.col(digest).alias("_old"))
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col(digest), "update").otherwise("same")
    return incoming.join(known, key, "left").withColumn("change", kind).drop("_old")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], kept: tuple[str, ...] = (), changed: str | None = None) -> DataFrame:
    """Rows of both tables by key; those of ``updates`` win except in the ``kept`` columns.

    With ``changed`` a known row is replaced only where that column differs.
    """
    new = updates.select(*[F.col(c).alias(f"_n_{c}") if c not in keys else F.col(c) for c in target.columns], F.lit(True).alias("_new"))
    old = target.withColumn("_old", F.lit(True))
    both = old.join(new, keys, "full_outer")
    take = F.coalesce("_new", F.lit(False))
    if changed:
        take = take & (F.col("_old").isNull() | ~F.col(changed).eqNullSafe(F.col(f"_n_{changed}")))
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in kept:
            out.append(F.when(F.col("_old").isNotNull(), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
        else:
            out.append(F.when(take, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
    return both.select(*out)


def change_feed(before: DataFrame, after: DataFrame, key: str = "rid", digest: str = "sha256_hash") -> DataFrame:
    """``(key, event)``: bundle.created and bundle.updated between two states of a table."""
    old = before.select(F.col(key), F.col(digest).alias("_old"), F.lit(True).alias("_known"))
    kind = F.when(F.col("_known").isNull(), "bundle.created").when(~F.col("_old").eqNullSafe(F.col(digest)), "bundle.updated")
    return after.join(old, key, "left").select(key, kind.alias("event")).where("event is not null")


def without(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key isn't among ``gone``."""
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "rid") -> dict[str, DataFrame]:
    """A deletion carried through every table that holds the key."""
    return {name: without(t, gone, key) for name, t in tables.items()}


def without_stale_chunks(chunks: DataFrame, counts: DataFrame, key: str = "rid") -> DataFrame:
    """Chunks whose index is below the new number of chunks; keys without a new number keep all."""
    return chunks.join(counts.select(key, F.col("n").alias("_n")), key, "left").where(F.col("_n").isNull() | (F.col("chunk_index") < F.col("_n"))).drop("_n")


def fill_from(table: DataFrame, source: DataFrame, keys: list[str], column: str, where: Column) -> DataFrame:
    """``column`` taken from ``source`` for the rows that meet a condition and have a counterpart there."""
    new = source.select(*keys, F.col(column).alias("_new"))
    return table.join(new, keys, "left").withColumn(column, F.when(where & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(column))).drop("_new")


def set_field(contents: Column, field: str, value: Column) -> Column:
    """JSON objects with a text field put in where it is missing or null; what isn't an object stays as it is.

    A null that is there is replaced, other fields keep their notation.
    """
    bare = F.trim(contents)
    is_object = F.get_json_object(contents, "$").isNotNull() & bare.startswith("{")
    text = F.to_json(F.struct(value.cast("string").alias("v")))  # {"v":"..."}: the value with its escapes
    shown = F.substring(text, F.lit(6), F.length(text) - 6)
    held = rf'"{field}"\s*:\s*null(?=\s*[,}}])'
    put = F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), F.when(bare.rlike(r"^\{\s*\}$"), "").otherwise(", "), F.lit(f'"{field}": '), shown, F.lit("}"))
    replaced = F.concat(F.regexp_extract(bare, rf"(?s)^(.*?){held}", 1), F.lit(f'"{field}": '), shown, F.regexp_extract(bare, rf"(?s)^.*?{held}(.*)$", 1))
    missing = F.get_json_object(contents, f"$.{field}").isNull()
    return F.when(is_object & missing & value.isNotNull(), F.when(bare.rlike(held), replaced).otherwise(put)).otherwise(contents)


def rename_namespaces(table: DataFrame, names: dict[str, str], columns: tuple[str, ...] = ("rid", "namespace")) -> DataFrame:
    """Namespaces renamed in the id and in their own column."""
    out = table
    if "namespace" in columns and "namespace" in table.columns:
        m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        out = out.withColumn("namespace", F.coalesce(m[F.col("namespace")], F.col("namespace")))
    if "rid" in columns and "rid" in table.columns:
        parts = F.split("rid", ":", 3)
        m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        out = out.withColumn("rid", F.when(F.size(parts) == 3, F.concat_ws(":", parts[0], F.coalesce(m[parts[1]], parts[1]), parts[2])).otherwise(F.col("rid")))
    return out


def orphans(children: DataFrame, parents: DataFrame, key: str = "rid") -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def since(table: DataFrame, column: str, mark, most: int | None = None) -> DataFrame:
    """Rows behind a high-water mark, in order, at most so many."""
    rows = table.where(F.col(column) > mark).orderBy(column)
    return rows.limit(most) if most else rows


def high_water(table: DataFrame, column: str) -> DataFrame:
    return table.agg(F.max(column).alias("high_water"))


def merge_snapshots(snapshots: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key over snapshots: greatest counts, newest title, union of visits, first known engagement."""
    newest = F.max_by("title", F.when(F.col("title").isNotNull(), F.col(order)))
    return snapshots.groupBy(key).agg(
        F.max("visit_count").alias("visit_count"),
        F.max("frecency").alias("frecency"),
        newest.alias("title"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("visits")))).alias("visits"),
        F.max_by("engagement", F.when(F.col("engagement").isNotNull(), F.col(order))).alias("engagement"),
    )


def newest(table: DataFrame, key: str, order: str) -> DataFrame:
    return last_of_batch(table, [key], [order])


def visits_rollup(visits: DataFrame, key: str, when: str, kind: str, most: int = 100) -> DataFrame:
    """Per key: count, first and last visit, a histogram of kinds and the last visits.

    The histogram counts per (key, kind) first. The list of last visits ranks within (key, salt) before it ranks
    within the key, so a key with very many visits is cut down in many tasks.
    """
    per_kind = visits.groupBy(key, kind).agg(F.count(F.lit(1)).alias("n"))
    histogram = per_kind.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("kinds"))
    sums = visits.groupBy(key).agg(F.count(F.lit(1)).alias("visits"), F.min(when).alias("first_visit"), F.max(when).alias("last_visit"))
    salted = visits.select(key, F.col(when).alias("_t"), F.col(kind).alias("_k"), F.pmod(F.xxhash64(when, kind), F.lit(16)).alias("_s"))
    part = salted.withColumn("_r", F.row_number().over(W.partitionBy(key, "_s").orderBy(F.desc("_t"), "_k"))).where(F.col("_r") <= most)
    last = part.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_t"), "_k"))).where(F.col("_r") <= most)
    recent = last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_t", "_k"))), lambda x: F.struct(x["_t"].alias("at"), x["_k"].alias("kind"))).alias("recent"))
    return sums.join(histogram, key).join(recent, key)

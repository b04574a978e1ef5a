"""Folders of documents as tables: Markdown with front matter, JSON, JSON lines, change logs, session logs."""

from __future__ import annotations

import configparser
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import bundles as B
from quillmesh.functions import text as T
from quillmesh.functions.rids import make

#: Kind of bundle, files that belong to it, and its reference: from groups of the path, or a field of the front matter.
MARKDOWN_KINDS: dict[str, tuple[str, str, str | None]] = {
    "journal": ("*.md", r"(\d{4})/(\d{2})/(\d{2})/([^/]+)\.md$", None),
    "venture": ("*.md", r"([^/]+)/([^/]+)\.md$", None),
    "research": ("*.md", r"([^/]+)\.md$", None),
    "task": ("task-*.md", r"(task-[^/ ]+)[^/]*\.md$", "id"),
    "plan": ("*.md", r"([^/]+)\.md$", None),
}


def text_files(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """``(path, text)`` of every file below a folder that matches; one row a file, read in parallel."""
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _reference(kind: str, path: Column, head: Column) -> Column:
    _, pattern, field = MARKDOWN_KINDS[kind]
    group = lambda i: F.regexp_extract(path, pattern, i)
    if kind == "journal":
        ref = F.concat(group(1), F.lit("-"), group(2), F.lit("-"), group(3), F.lit("/"), group(4))
    elif kind == "venture":
        ref = F.concat(group(1), F.lit("/"), group(2))
    else:
        ref = group(1)
    ref = F.when(path.rlike(pattern), ref)
    return F.coalesce(T.front_fields(head)[field], ref) if field else ref


def markdown_bundles(spark: SparkSession, folder: str, kind: str, prefix: str) -> DataFrame:
    """Bundles of a folder of one kind: rid, namespace, reference, frontmatter, body, title, hash, path.

    Files whose path gives no reference are left out. ``prefix`` is what the namespace begins with.
    """
    glob = MARKDOWN_KINDS[kind][0]
    parts = T.front_matter(F.col("text"))
    rows = text_files(spark, folder, glob).select("path", F.sha2("text", 256).alias("hash"), parts["head"].alias("head"), parts["body"].alias("body"))
    rows = rows.withColumn("reference", _reference(kind, F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), F.col("head"))).where("reference <> ''")
    fields = T.front_fields(F.coalesce("head", F.lit("")))
    return rows.select(
        make(F.lit(prefix + kind), F.col("reference")).alias("rid"), F.lit(prefix + kind).alias("namespace"), "reference", fields.alias("frontmatter"), "body",
        F.coalesce(fields["title"], T.first_heading(F.col("body"))).alias("title"), "hash", "path",
    )


def json_lines(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """Rows of JSON lines; what doesn't parse is left out."""
    reader = spark.readStream if stream else spark.read
    kind = schema if "_bad" in schema else f"{schema}, _bad string"
    rows = reader.schema(kind).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, or a list of them."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def changelog_versions(files: DataFrame, repo: Column) -> DataFrame:
    """``(reference, version, body, bullet_count, features, fixes, names, is_latest)`` of the sections of change logs."""
    rows = files.select(repo.alias("repo"), F.posexplode(T.changelog_sections(F.col("text"))).alias("pos", "s"))
    body = F.col("s.body")
    return rows.select(
        F.concat("repo", F.lit("/"), F.col("s.version")).alias("reference"), F.col("s.version").alias("version"), body.alias("body"), F.size(T.bullets(body)).alias("bullet_count"),
        T.bullets(body, "Added").alias("features"), T.bullets(body, "Fixed").alias("fixes"), T.quoted_names(body).alias("names"), (F.col("pos") == 0).alias("is_latest"),
    )


def session_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per session file of JSON lines: first known fields, times, counts, names of used tools, a summary.

    Lines stay apart until they are combined per file, on the map side; the summary takes the first five user texts.
    """
    raw = spark.read.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("n"), F.try_parse_json("value").alias("v"))
    rows = raw.where("v is not null")
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    content = F.coalesce(get("$.message.content"), F.lit(""))
    blocks = F.coalesce(F.from_json(get("$.message.content"), "array<struct<type:string,text:string,name:string>>"), F.array().cast("array<struct<type:string,text:string,name:string>>"))
    said = F.when(content.startswith("["), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), " ")).otherwise(content)
    rows = rows.select("path", "n", get("$.sessionId").alias("session_id"), get("$.cwd").alias("cwd"), get("$.timestamp").alias("at"), get("$.type").alias("kind"), said.alias("said"), F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: b["name"]).alias("tools"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c)
    users = rows.where("kind = 'user' and said <> ''").select("path", "n", F.substring("said", 1, 200).alias("said"))
    from pyspark.sql import Window as W

    lead = users.withColumn("i", F.row_number().over(W.partitionBy("path").orderBy("n"))).where("i <= 5").groupBy("path").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "said"))), lambda x: x["said"]), " | "), 1, 500).alias("summary"))
    sums = rows.groupBy("path").agg(first("session_id"), first("cwd"), F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.count_if(F.col("kind") == "user").alias("user_messages"), F.count_if(F.col("kind") == "assistant").alias("assistant_messages"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tools")))).alias("tools_used"))
    return sums.join(lead, "path", "left")


def plan_bundles(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """Plans: Markdown bundles with title (first heading), goal (the bold field), kind and parent of their file names."""
    rows = markdown_bundles(spark, folder, "plan", prefix)
    kind = T.plan_kind(F.col("reference"))
    return rows.select("*", T.bold_field(F.col("body"), "Goal").alias("goal"), kind["kind"].alias("plan_type"), kind["parent"].alias("parent_slug"))


def _beside(sidecar: str, flag: str):
    """Text of a hidden sidecar and presence of a flag file in each folder; listings leave hidden files out, so they
    are opened by name, from a folder that every executor sees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = [Path(unquote(urlsplit(f).path)) for f in batch["folder"]]
            texts = [(p / sidecar).read_text(encoding="utf-8", errors="replace") if (p / sidecar).is_file() else None for p in places]
            yield pd.DataFrame({"folder": batch["folder"], "side": texts, "analyzed": [(p / flag).is_file() for p in places]})

    return run


def skill_bundles(spark: SparkSession, folder: str, sidecar: str = ".version", flag: str = ".analyzed") -> DataFrame:
    """Markdown files of generated skills with the key: value pairs of the sidecar in their folder (null if there is
    none) and whether the folder holds the flag file."""
    docs = text_files(spark, folder, "*.md").withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]+$", 1))
    side = docs.select("folder").distinct().mapInPandas(_beside(sidecar, flag), "folder string, side string, analyzed boolean")
    lines = F.filter(F.split("side", "\n"), lambda x: x.rlike(r"^[^:#]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)).alias("v")))
    rows = docs.join(side, "folder", "left")
    return rows.select("path", "text", F.map_from_entries(F.array_distinct(pairs)).alias("version"), "analyzed", F.sha2("text", 256).alias("hash"))


def persona_items(spark: SparkSession, folder: str, items: dict[str, str] | None = None) -> DataFrame:
    """Items of a persona's files (item_type, reference, body, file_hash): a Markdown or JSON file is one item, every
    line of a JSON lines file is one; file_hash tells whether a file has changed at all.

    ``items`` maps file names to item types; other JSON files hold facts, everything else observations.
    """
    parts = [text_files(spark, folder, g).withColumn("form", F.lit(g[2:])) for g in ("*.md", "*.json", "*.jsonl")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("file_hash", F.sha2("text", 256)).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    split = rows.select("path", "name", F.regexp_replace("name", r"\.[^.]+$", "").alias("stem"), "form", "file_hash", F.posexplode(F.when(F.col("form") == "jsonl", lines).otherwise(F.array("text"))).alias("n", "body"))
    item = F.when(F.col("form") == "json", "fact").otherwise("observation")
    for name, kind in (items or {}).items():
        item = F.when(F.col("name") == name, kind).otherwise(item)
    reference = F.when(F.col("form") == "jsonl", F.concat("stem", F.lit("#"), F.col("n").cast("string"))).otherwise(F.col("stem"))
    valid = (F.col("form") == "md") | F.get_json_object("body", "$").isNotNull()
    return split.where(valid).select(item.alias("item_type"), reference.alias("reference"), "body", "file_hash")


def contacts(scores: DataFrame, identities: DataFrame, since: str | None = None) -> DataFrame:
    """Contact scores with their identities (inner join on identity_id), computed after a high-water mark."""
    rows = scores if since is None else scores.where(F.col("computed_at") > F.lit(since))
    return rows.join(identities, "identity_id")


def recordings(rows: DataFrame, transcripts: DataFrame, files: DataFrame) -> DataFrame:
    """Recordings with the text of their transcript files, without time marks; those without one have null.

    ``rows`` has recording_id, ``transcripts`` (recording_id, path), ``files`` the ``text_files`` of the folder, matched
    by the end of their path.
    """
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    texts = files.select(name(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).alias("_name"), T.strip_time_marks(F.col("text")).alias("transcript_text"))
    told = transcripts.select("recording_id", name(F.col("path")).alias("_name")).join(texts, "_name").groupBy("recording_id").agg(F.max("transcript_text").alias("transcript_text"))
    return rows.join(told, "recording_id", "left")


CHAT_EXPORT = "uuid string, name string, summary string, description string, prompt_template string, created_at string, updated_at string, chat_messages array<struct<sender:string,text:string,created_at:string>>, docs array<struct<filename:string,content:string>>, conversations_memory string, project_memories map<string,string>"


def chat_exports(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """Conversations, projects and memories of a chat export (lists of JSON objects) as bundles.

    What an object is shows in its fields: messages make a conversation, documents or a prompt a project, memories a
    memory; others and those without an id (memories are one for each file) are left out.
    """
    rows = json_documents(spark, folder, CHAT_EXPORT).withColumn("path", F.col("_metadata.file_path"))
    kind = F.when(F.col("chat_messages").isNotNull(), "web.conversation").when(F.col("docs").isNotNull() | F.col("prompt_template").isNotNull(), "web.project").when(F.col("conversations_memory").isNotNull() | F.col("project_memories").isNotNull(), "web.memory")
    fields = [f.name for f in rows.schema.fields if f.name != "path"]
    reference = F.coalesce("uuid", F.when(kind == "web.memory", F.sha2("path", 256)))
    out = rows.select(kind.alias("_kind"), reference.alias("reference"), F.to_json(F.struct(*fields)).alias("contents"), F.col("created_at").alias("_created")).where("_kind is not null and reference is not null")
    out = out.withColumn("namespace", F.concat(F.lit(prefix), F.col("_kind")))
    return out.select(make(F.col("namespace"), F.col("reference")).alias("rid"), "namespace", "reference", "contents", F.coalesce(F.try_to_timestamp("_created"), F.current_timestamp()).alias("created_at"), B.search_text().alias("search_text"))


def cached_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Bundles of a cache of JSON files (one object with rid and contents each); contents that are no object are wrapped
    as {"raw": ...}, files that don't parse or have no rid are left out."""
    rows = text_files(spark, folder, "*.json").select(F.get_json_object("text", "$.rid").alias("rid"), F.get_json_object("text", "$.contents").alias("contents")).where("rid is not null")
    bare = F.trim("contents")
    parsed = F.get_json_object("contents", "$").isNotNull() & (bare.startswith("[") | bare.rlike(r"^-?\d"))
    raw = F.when(parsed, F.concat(F.lit('{"raw":'), F.col("contents"), F.lit("}"))).otherwise(F.to_json(F.struct(F.col("contents").alias("raw"))))
    parts = F.split("rid", ":", 3)
    return rows.select("rid", parts[1].alias("namespace"), parts[2].alias("reference"), F.when(bare.startswith("{"), F.col("contents")).when(F.col("contents").isNotNull(), raw).alias("contents"))


def profiles(ini: str) -> list[tuple[str, str]]:
    """(name, folder) of the profiles of a browser's INI file; relative folders lie beside the file."""
    parser = configparser.ConfigParser()
    parser.read(ini)
    out = []
    for section in parser.sections():
        if section.lower().startswith("profile") and parser.has_option(section, "Path"):
            path = parser.get(section, "Path")
            if parser.get(section, "IsRelative", fallback="1") == "1":
                path = str(Path(ini).parent / path)
            out.append((parser.get(section, "Name", fallback=section), path))
    return out

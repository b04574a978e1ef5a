"""Texts derived from a bundle's contents, as column expressions chosen by the kind of its namespace.

The kind is what follows the first hyphen of the namespace. A layout lists the fields that make up a text and how they
are joined; fields are read from the JSON with the built-in functions, so the projection stays inside code generation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest search text, and longest description taken from a video.
MAX_TEXT = 500_000
MAX_DESCRIPTION = 1_000


def kind(namespace: str | Column = "namespace") -> Column:
    col = F.col(namespace) if isinstance(namespace, str) else namespace
    return F.regexp_replace(col, "^[^-]*-", "")


def field(path: str, contents: str = "contents") -> Column:
    """Text at a JSON path; missing and null are the empty string."""
    return F.coalesce(F.get_json_object(contents, f"$.{path}"), F.lit(""))


def first_of(*paths: str) -> Column:
    return F.coalesce(*[F.nullif(field(p), F.lit("")) for p in paths], F.lit(""))


def words_of(path: str) -> Column:
    """A JSON list of texts joined by blanks."""
    return F.coalesce(F.array_join(F.from_json(F.get_json_object("contents", f"$.{path}"), "array<string>"), " "), F.lit(""))


def texts_of(path: str, *names: str) -> Column:
    """The non-empty named fields of a JSON list of objects, in order, as an array."""
    row = F.from_json(F.get_json_object("contents", f"$.{path}"), "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>")
    flat = F.flatten(F.transform(row, lambda r: F.array(*[r[n] for n in names])))
    return F.filter(F.coalesce(flat, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))


@dataclass(frozen=True)
class Layout:
    """How the text of one kind is put together; ``sparse`` leaves out empty parts."""

    parts: tuple[Column, ...]
    between: str = " "
    sparse: bool = False
    capped: bool = True

    def column(self) -> Column:
        if self.sparse:
            kept = F.filter(F.array(*self.parts), lambda t: t != "")
            text = F.array_join(kept, self.between)
        else:
            text = F.concat_ws(self.between, *self.parts)
        return F.substring(text, 1, MAX_TEXT) if self.capped else text


def layouts() -> dict[str, Layout]:
    front = "frontmatter."
    return {
        "journal": Layout((field(front + "title"), field("body")), capped=False),
        "venture": Layout((field(front + "title"), field(front + "description"), field("body"), words_of(front + "tags")), capped=False),
        "logging": Layout((field("cwd"), field("summary")), capped=False),
        "recording": Layout(tuple(field(p) for p in ("filename", "source", "title", "notes", "date_recorded", "transcript_text"))),
        "message": Layout((field("content"),)),
        "plan": Layout((field("title"), field("goal"), field("body"))),
        "pageindex": Layout((field("tree_path"), field("node_title"), field("summary"), field("body"))),
        "research": Layout((field(front + "title"), words_of(front + "tags"), field(front + "prompted_by"), field("body"))),
        "contact": Layout((field("display_name"), F.when(field("dunbar_layer") != "", F.concat(F.lit("dunbar:"), field("dunbar_layer"))).otherwise(""), F.when(F.get_json_object("contents", "$.composite").isNotNull(), F.concat(F.lit("score:"), field("composite"))).otherwise("")), sparse=True, capped=False),
        "task": Layout((field(front + "title"), field(front + "status"), field(front + "milestone"), field("body"))),
        "browser-history": Layout((first_of("title", "page_title"), field("domain"), field("url"), words_of("tags"), field("folder_path"), field("type"))),
        "web.conversation": Layout((field("name"), field("summary"), F.array_join(texts_of("chat_messages", "text"), "\n")), "\n", sparse=True),
        "web.project": Layout((field("name"), field("description"), field("prompt_template"), F.array_join(texts_of("docs", "filename", "content"), "\n")), "\n", sparse=True),
        "web.memory": Layout((field("conversations_memory"), F.array_join(F.map_values(F.coalesce(F.from_json(F.get_json_object("contents", "$.project_memories"), "map<string,string>"), F.create_map().cast("map<string,string>"))), "\n")), "\n", sparse=True),
        "code": Layout((field("cwd"), field("summary")), "\n", sparse=True),
        "github": Layout((field("name"), field("description"), words_of("topics"), field("readme_content")), "\n", sparse=True),
        "youtube": Layout((field("title"), first_of("channel_handle", "channel"), words_of("tags"), F.substring(field("description"), 1, MAX_DESCRIPTION)), "\n", sparse=True),
    }


def search_text(namespace: str = "namespace") -> Column:
    """The searchable text of ``contents``; kinds without a layout take the contents as they are."""
    chosen, out = kind(namespace), None
    for name, layout in layouts().items():
        out = F.when(chosen == name, layout.column()) if out is None else out.when(chosen == name, layout.column())
    return out.otherwise(F.substring("contents", 1, MAX_TEXT))


def _sentence(*parts: Column) -> Column:
    kept = F.filter(F.array(*parts), lambda p: p != "")
    return F.concat(F.array_join(kept, ". "), F.lit("."))


def _named(label: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(label + ": "), value)).otherwise("")


def preamble(namespace: str = "namespace") -> Column:
    """A line on where a text comes from, put before its chunks; empty where the leading field is missing."""
    front = "frontmatter."
    kinds: dict[str, tuple[Column, Column]] = {
        "journal": (field(front + "title"), _sentence(_named("Journal", field(front + "title")), _named("Date", field(front + "created")))),
        "recording": (first_of("title", "filename"), _sentence(_named("Recording", first_of("title", "filename")), _named("Source", field("source")), _named("Date", field("date_recorded")))),
        "web.conversation": (field("name"), _sentence(_named("Conversation", field("name")))),
        "web.project": (field("name"), F.concat(_sentence(_named("Project", field("name"))), F.when(field("description") != "", F.concat(F.lit(" "), F.substring(field("description"), 1, 100))).otherwise(""))),
        "code": (field("cwd"), _sentence(_named("Code session", field("cwd")), _named("Date", field("date")))),
        "venture": (field(front + "title"), _sentence(_named("Venture", field(front + "title")))),
        "message": (field("chat_title"), _sentence(_named("Message", field("chat_title")), _named("Date", F.substring(field("platform_ts"), 1, 10)))),
        "plan": (field("title"), F.concat(_sentence(_named("Plan", field("title"))), F.lit(" Type: "), first_of("plan_type"), F.when(first_of("plan_type") == "", "auto").otherwise(""), F.lit("."))),
        "contact": (field("display_name"), _sentence(_named("Contact", field("display_name")), _named("Layer", field("dunbar_layer")))),
        "task": (field(front + "title"), _sentence(_named("Task", field(front + "title")), _named("Status", field(front + "status")))),
        "research": (field(front + "title"), _sentence(_named("Research", field(front + "title")), _named("Date", field(front + "created")), _named("Status", field(front + "status")))),
        "logging": (field("cwd"), _sentence(_named("Session", field("cwd")))),
        "github": (first_of("full_name", "name"), _sentence(_named("Repository", first_of("full_name", "name")))),
        "youtube": (field("title"), _sentence(_named("YouTube", field("title")), _named("Channel", first_of("channel_handle", "channel")), _named("Date", field("upload_date")))),
    }
    chosen, out = kind(namespace), None
    for name, (lead, text) in kinds.items():
        value = F.when(lead != "", text).otherwise("")
        out = F.when(chosen == name, value) if out is None else out.when(chosen == name, value)
    return out.otherwise(F.concat(F.lit("Document from "), F.col(namespace), F.lit(".")))


#: Lengths of previews.
SHORT, MEDIUM = 150, 200


def summary(namespace: str = "namespace", text: str = "search_text") -> Column:
    """One line on a hit: sender, day and words of a message, title of a journal or recording, else its text; at most
    ``MEDIUM`` characters and dots."""
    front = "frontmatter."
    talk = F.concat(F.lit("["), field("sender_id"), F.lit("] "), F.substring(field("platform_ts"), 1, 10), F.lit(": "), F.substring(field("content"), 1, SHORT))
    chosen = kind(namespace)
    line = F.when(chosen == "message", talk).when(chosen == "journal", first_of(front + "title", front + "description")).when(chosen == "recording", first_of("title", "filename")).otherwise(F.substring(F.coalesce(F.col(text), F.lit("")), 1, MEDIUM))
    return F.when(F.length(line) > MEDIUM, F.concat(F.substring(line, 1, MEDIUM), F.lit("..."))).otherwise(line)


def with_preamble(lead: Column, chunk: Column) -> Column:
    return F.when(lead == "", chunk).otherwise(F.concat(lead, F.lit("\n---\n"), chunk))

"""Resource ids ``orn:<namespace>:<reference>`` and the references of each kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "orn"

#: How the reference of a kind is taken apart: at the first, the last or every separator, into how many parts, and
#: whether a part may be empty. Kinds that aren't listed take the reference whole.
RULES: dict[str, tuple[str, str, int, bool]] = {
    "browser-history": ("first", "/", 2, False),
    "changelog": ("last", "/", 2, True),
    "dock": ("first", "/", 2, False),
    "journal": ("first", "/", 2, False),
    "persona": ("first", ":", 3, False),
    "recording": ("first", "/", 2, False),
    "venture": ("first", "/", 2, False),
    "youtube": ("first", "/", 2, True),
}
WHOLE = ("contact", "message", "plan", "research", "logging", "task", "transcript", "voice", "code", "github")


def make(namespace: Column, reference: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}:"), namespace, F.lit(":"), reference)


def parse(rid: Column) -> Column:
    """struct(namespace, reference), null if the id has fewer than three parts."""
    parts = F.split(rid, ":", 3)
    return F.when(F.size(parts) == 3, F.struct(parts[1].alias("namespace"), parts[2].alias("reference")))


def parts(kind: Column, reference: Column) -> Column:
    """The reference's parts as an array, null where it is malformed for its kind."""
    out = F.when(F.length(reference) > 0, F.array(reference))
    chosen = None
    for name, (side, mark, most, empty) in RULES.items():
        if side == "last":
            head = F.regexp_extract(reference, f"(?s)^(.*){mark}([^{mark}]*)$", 1)
            tail = F.regexp_extract(reference, f"(?s)^(.*){mark}([^{mark}]*)$", 2)
            value = F.when((F.instr(reference, mark) > 0) & (head != ""), F.array(head, tail))
        else:
            split = F.split(reference, mark, most)
            ok = F.size(split) == most
            value = F.when(ok if empty else ok & ~F.exists(split, lambda x: x == ""), split)
        chosen = F.when(kind == name, value) if chosen is None else chosen.when(kind == name, value)
    return chosen.otherwise(out)


def is_valid(kind: Column, reference: Column) -> Column:
    return F.coalesce(parts(kind, reference).isNotNull(), F.lit(False))

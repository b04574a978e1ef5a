"""Which types of entities each kind of bundle has, and the supertype of each type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Supertypes, and per domain its kinds of bundles and its types with their supertypes.
SUPERTYPES = ("agent", "artifact", "concept", "event", "place", "action", "temporal")
DOMAINS: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "journal": (("journal",), {"Person": "agent", "Tool": "artifact", "Concept": "concept", "Project": "artifact", "Decision": "event", "Organization": "agent", "Location": "place"}),
    "messages": (("message",), {"Person": "agent", "Topic": "concept", "Organization": "agent", "Tool": "artifact"}),
    "recordings": (("recording",), {"Speaker": "agent", "Topic": "concept", "Project": "artifact", "Decision": "event", "Organization": "agent"}),
    "code": (("code", "github"), {"Tool": "artifact", "Project": "artifact", "Person": "agent", "Concept": "concept"}),
    "web": (("web.conversation",), {"Person": "agent", "Tool": "artifact", "Concept": "concept", "Organization": "agent", "Project": "artifact"}),
    "plans": (("plan",), {"Project": "artifact", "Decision": "event", "Goal": "action", "Milestone": "event", "Tool": "artifact"}),
    "ventures": (("venture",), {"Person": "agent", "Organization": "agent", "Project": "artifact", "Milestone": "event", "Financial": "concept"}),
    "logging": (("logging",), {"Tool": "artifact", "Error": "event", "Pattern": "concept"}),
    "youtube": (("youtube",), {"Person": "agent", "Tool": "artifact", "Concept": "concept", "Project": "artifact", "Organization": "agent", "Decision": "event"}),
    "persona": (("persona",), {"Person": "agent", "Belief": "concept", "Concept": "concept", "Project": "artifact", "Relationship": "concept", "Decision": "event", "Skill": "concept", "Organization": "agent"}),
}


def type_map() -> dict[str, str]:
    """Type to supertype over all domains; a later domain decides."""
    return {t: s for _, types in DOMAINS.values() for t, s in types.items()}


def types_of(kind: str) -> list[str]:
    """The types of a kind of bundle; all types for a kind without a domain."""
    own = [t for kinds, types in DOMAINS.values() if kind in kinds for t in types]
    return list(dict.fromkeys(own)) or sorted(type_map())


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def supertype(entity_type: Column) -> Column:
    return _literal_map(type_map())[entity_type]


def allowed(kind: Column, entity_type: Column) -> Column:
    """Whether a type belongs to a kind of bundle."""
    out, known = None, []
    for kinds, types in DOMAINS.values():
        known += kinds
        hit = entity_type.isin(*types)
        out = F.when(kind.isin(*kinds), hit) if out is None else out.when(kind.isin(*kinds), hit)
    return out.otherwise(entity_type.isin(*type_map()))

"""Cleaning of web addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import glob_pattern

#: Query parameters that only track.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_source_platform utm_creative_format utm_marketing_tactic "
    "fbclid gclid gclsrc dclid gbraid wbraid mc_cid mc_eid msclkid twclid igshid s_kwcid ef_id _ga _gl _hsenc _hsmi yclid ref ref_src ref_url si"
).split()
#: Schemes of pages inside a browser.
INTERNAL = "about chrome moz-extension resource data blob javascript".split()
#: Hosts of sign-in pages, left out where no list is given.
SIGN_IN = "accounts.google.com login.microsoftonline.com login.live.com auth0.com signin.aws.amazon.com id.atlassian.com".split()


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def is_internal(url: Column) -> Column:
    return scheme(url).isin(*INTERNAL)


def domain(url: Column) -> Column:
    """Host with port and user, in lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def pairs(url: Column) -> Column:
    """array<struct(name, value)> of the query, blank values left out."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    raw = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.+"))
    return F.transform(raw, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)=", 1).alias("name"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("value")))


def sanitise(url: Column, dropped: list[str] | None = None, kept: list[str] | None = None) -> Column:
    """Lower-case scheme and host, no tracking or blank parameters, repeated names together, no fragment, no last slash.

    Addresses inside a browser stay as they are. ``kept`` names the only parameters to keep, else ``dropped`` (the
    tracking ones by default) are left out, whatever their case.
    """
    bad = [d.lower() for d in (TRACKING if dropped is None else dropped)]
    keep = (lambda p: F.lower(p["name"]).isin(*[k.lower() for k in kept])) if kept is not None else (lambda p: ~F.lower(p["name"]).isin(*bad)) if bad else (lambda p: F.lit(True))
    good = F.filter(pairs(url), keep)
    names = F.array_distinct(F.transform(good, lambda p: p["name"]))
    grouped = F.flatten(F.transform(names, lambda n: F.transform(F.filter(good, lambda p: p["name"] == n), lambda p: F.concat(n, F.lit("="), p["value"]))))
    query = F.array_join(grouped, "&")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    whole = F.concat(scheme(url), F.lit("://"), domain(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(is_internal(url) | ~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(whole)


def stripped(url: Column, dropped: list[str] | None = None) -> Column:
    """Names of the parameters that cleaning leaves out, sorted."""
    bad = [d.lower() for d in (TRACKING if dropped is None else dropped)]
    return F.array_sort(F.array_distinct(F.filter(F.transform(pairs(url), lambda p: p["name"]), lambda n: F.lower(n).isin(*bad))))


def url_hash(url: Column, length: int = 12) -> Column:
    """The first digits of the hash of the address, cleaned by the default rules."""
    return F.substring(F.sha2(sanitise(url), 256), 1, length)


def suppressed(url: Column, globs: list[str] = SIGN_IN) -> Column:
    """Inside a browser, or of a domain that matches one of the wild cards."""
    any_of = "|".join(f"(?:{glob_pattern(g)})" for g in globs)
    return is_internal(url) | (domain(url).rlike(any_of) if globs else F.lit(False))


def with_policy(url: Column, policies: dict[str, tuple[str, list[str]]]) -> Column:
    """struct(url, policy): an exact domain before the first wild card; keep, strip_only, strip, else the default."""
    ordered = sorted(policies.items(), key=lambda p: any(c in p[0] for c in "*?["))
    clean, name = None, None
    for host, (mode, params) in ordered:
        hit = domain(url).rlike(glob_pattern(host))
        value = sanitise(url, kept=params) if mode == "keep" else sanitise(url, dropped=params) if mode == "strip_only" else sanitise(url, dropped=[*TRACKING, *params])
        clean = F.when(hit, value) if clean is None else clean.when(hit, value)
        name = F.when(hit, F.lit(mode)) if name is None else name.when(hit, F.lit(mode))
    if clean is None:
        return F.struct(sanitise(url).alias("url"), F.lit("default").alias("policy"))
    return F.struct(clean.otherwise(sanitise(url)).alias("url"), name.otherwise("default").alias("policy"))

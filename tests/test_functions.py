import random
import re
import unicodedata
from urllib.parse import urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.functions import bundles as B
from quillmesh.functions import rids
from quillmesh.functions import text as T
from quillmesh.functions import urls as U
from quillmesh.functions import vectors as V


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<double>' if isinstance(v, list) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("query", "want"),
    [("sqlite", "keyword"), ("two words", "keyword"), ('find "exact phrase" in notes', "keyword"), ("what happened yesterday in the log", "temporal"), ("how does the parser work", "conceptual"), ("one two three four five six seven", "conceptual"), ("vector index tuning notes", "hybrid"), ("  ", "hybrid"), (None, "hybrid")],
)
def test_routes(spark, query, want):
    assert one(spark, T.route(F.col("q")), q=query) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Ex.Example/Path/?utm_source=x&id=3#frag", "https://ex.example/Path?id=3"), ("https://ex.example/", "https://ex.example/"), ("https://ex.example/a?b=&c=1&b=2&c=3", "https://ex.example/a?c=1&c=3&b=2"),
        ("https://u@ex.example:8080/a/", "https://u@ex.example:8080/a"), ("about:config", "about:config"), ("https://ex.example/a?UTM_Source=x", "https://ex.example/a"), ("https://ex.example?q=1", "https://ex.example?q=1"), (None, None),
    ],
)
def test_sanitised_addresses(spark, url, want):
    assert one(spark, U.sanitise(F.col("u")), u=url) == want


def test_policies_and_suppression(spark):
    policy = {"keep.example": ("keep", ["v"]), "*.example": ("strip_only", ["a"]), "all.test": ("strip", ["z"])}
    f = U.with_policy(F.col("u"), policy)
    assert one(spark, f, u="https://keep.example/x?v=1&b=2").asDict() == {"url": "https://keep.example/x?v=1", "policy": "keep"}
    assert one(spark, f, u="https://other.example/x?a=1&utm_id=2").asDict() == {"url": "https://other.example/x?utm_id=2", "policy": "strip_only"}
    assert one(spark, f, u="https://all.test/x?z=1&utm_id=2&k=3").asDict() == {"url": "https://all.test/x?k=3", "policy": "strip"}
    assert one(spark, f, u="https://none.org/x?utm_id=2").asDict() == {"url": "https://none.org/x", "policy": "default"}
    assert one(spark, U.suppressed(F.col("u"), ["*bank*"]), u="https://my.bank.example/") is True
    assert one(spark, U.suppressed(F.col("u"), ["*bank*"]), u="https://river.example/") is False
    assert one(spark, U.suppressed(F.col("u")), u="chrome://settings") is True
    assert one(spark, U.stripped(F.col("u")), u="https://a.b/?utm_id=1&x=2&gclid=3") == ["gclid", "utm_id"]
    assert len(one(spark, U.url_hash(F.col("u")), u="https://a.b/")) == 12


def chunked(spark, texts, **sizes):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return {r.i: list(r.c) for r in df.select("i", T.chunks(F.col("t"), **sizes).alias("c")).collect()}


def test_chunker(spark):
    words, paragraphs = "word " * 1000, "\n\n".join(f"Paragraph {i} " + "text " * 60 for i in range(12))
    got = chunked(spark, [None, " \n", "x" * 1999, words, "y" * 10_000, paragraphs, "a" * 1500 + ". " + "b" * 1500 + ". c"])
    assert got[0] == got[1] == [] and got[2] == ["x" * 1999]
    assert all(len(c) <= 2400 for c in got[3]) and got[3][0].startswith("word") and len(got[3]) > 2
    assert got[4][0] == "y" * 1600 and got[4][1] == "y" * 1600
    assert all(c.strip() for c in got[5]) and got[5][1].startswith(got[5][0][-400:].strip()[:50])
    assert got[6] == ["a" * 1500 + ".", "a" * 399 + ". " + "b" * 1500 + ".", "b" * 399 + ". c"]


def test_chunks_keep_every_word(spark):
    draw = random.Random(6)
    texts = ["".join(draw.choices("ab .!?\n#", k=draw.randint(0, 600))) for _ in range(200)]
    for i, got in chunked(spark, texts, size=40, overlap=0, floor=50).items():
        assert "".join("".join(got).split()) == "".join(texts[i].split())
    for i, got in chunked(spark, texts, size=40, overlap=10, floor=50).items():  # every chunk is led by the end of the last
        assert len("".join("".join(got).split())) >= len("".join(texts[i].split())) and all(len(c) <= 140 for c in got)


def test_paragraph_chunks_and_settings(spark):
    texts = ["short", "a" * 1500 + "\n\n" + "b" * 900 + "\n\n" + "c" * 100, "p" * 300 + "\n\n" + "q" * 1900, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", T.paragraph_chunks(F.col("t")).alias("c")).collect()}
    assert got[0] == ["short"] and got[3] is None
    assert got[1] == ["a" * 1500, "a" * 400 + "\n\n" + "b" * 900 + "\n\n" + "c" * 100] and got[2] == ["p" * 300, "p" * 300 + "\n\n" + "q" * 1900]
    env = one(spark, T.settings(F.col("t")), t="# comment\nA=1\n B = two words \nA='3'\nnothing\nC=x=y\n")
    assert env == {"A": "3", "B": "two words", "C": "x=y"}


def test_slugs_and_names(spark):
    assert one(spark, T.slug(F.col("t")), t="  Hello, World_of  Things!  ") == "hello-world-of-things"
    assert one(spark, T.slug(F.col("t")), t="!!!") == one(spark, T.slug(F.col("t")), t=None) == "untitled"
    assert one(spark, T.dated_slug(F.lit("2026-01-02"), F.col("t"), F.lit("id")), t="A (B) c") == "2026-01-02-a-b-c"
    assert one(spark, T.normalise_name(F.col("t")), t="  Foo \t BAR\n") == "foo bar"
    assert one(spark, T.nfkc(F.col("t")), t="ﬁle Ａ") == unicodedata.normalize("NFKC", "ﬁle Ａ")


def test_files_and_plans(spark):
    got = one(spark, T.front_matter(F.col("t")), t="---\nid: 7\ntitle: 'A b'\n---\n\n# Head\nbody --- x")
    assert got.body == "# Head\nbody --- x"
    assert one(spark, T.front_fields(F.col("t")), t=got["head"]) == {"id": "7", "title": "A b"}
    assert one(spark, T.front_matter(F.col("t")), t="no front").asDict() == {"head": None, "body": "no front"}
    assert one(spark, T.first_heading(F.col("t")), t="## no\n# Yes it is\n# two") == "Yes it is"
    assert one(spark, T.bold_field(F.col("t"), "Goal"), t="x\n**goal:** win it\ny") == "win it"
    assert one(spark, T.plan_kind(F.col("t")), t="big-plan-agent-a0123456789").asDict() == {"kind": "subagent", "parent": "big-plan"}
    assert one(spark, T.plan_kind(F.col("t")), t="2026-01-01-x").kind == "dated"
    sections = one(spark, T.changelog_sections(F.col("t")), t="# Log\n\n## 2.0.0\n\n- Added `PreHook` x\n- Fixed y\n\n## 1.0.0\n- z\n")
    assert [s.version for s in sections] == ["2.0.0", "1.0.0"]
    assert one(spark, T.bullets(F.col("t")), t=sections[0].body) == ["Added `PreHook` x", "Fixed y"]
    assert one(spark, T.bullets(F.col("t"), "Added"), t=sections[0].body) == ["Added `PreHook` x"]
    assert one(spark, T.quoted_names(F.col("t")), t=sections[0].body) == ["PreHook"]
    assert one(spark, T.strip_time_marks(F.col("t")), t="[0.00s -> 5.00s] a\n[00:16] b\n\n c") == "a\nb\nc"
    assert one(spark, T.repair_json(F.col("t")), t='```json\n{"a": [1,],}\n```') == '{"a": [1]}'


def test_durations_and_junk(spark):
    assert one(spark, T.duration(F.col("s")), s=3723) == "1h02m03s"
    assert one(spark, T.duration(F.col("s")), s=123) == "2m03s"
    assert one(spark, T.is_junk(F.col("t")), t="A" * 80) is True
    assert one(spark, T.is_junk(F.col("t")), t="fine text") is False
    assert one(spark, T.is_junk(F.col("t")), t=None) is True


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc*?[]!.", max_size=8), st.text(alphabet="abc.", max_size=6))
def test_globs_match_as_fnmatch(glob, name):
    import fnmatch

    try:
        want = fnmatch.fnmatchcase(name, glob)
        got = bool(re.match(T.glob_pattern(glob), name))
    except re.error:
        return
    if "[" not in glob:
        assert got == want


def test_similarity(spark):
    assert one(spark, T.trigram_similarity(F.col("a"), F.col("b")), a="word", b="word") == 1.0
    assert round(one(spark, T.trigram_similarity(F.col("a"), F.col("b")), a="word", b="two words"), 6) == round(4 / 11, 6)
    assert one(spark, T.trigram_similarity(F.col("a"), F.col("b")), a="", b="") == 0.0
    assert T.indel_ratio("abcd", "abxd") == 75.0 and T.indel_ratio("", "") == 100.0


def test_vectors(spark):
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[2.0, 0.0]) == 1.0
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[2.0, 0.0]) is None
    assert one(spark, V.normalised(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8] and one(spark, V.normalised(F.col("a")), a=[0.0]) == [0.0]
    assert one(spark, V.literal(F.col("a")), a=[0.1, 2.0]) == "[0.10000000,2.00000000]"


@pytest.mark.parametrize(
    ("kind", "ref", "want"),
    [("journal", "2026-01-01/x/y", ["2026-01-01", "x/y"]), ("journal", "/x", None), ("journal", "x", None), ("changelog", "o/r/1.0", ["o/r", "1.0"]), ("changelog", "o/", ["o", ""]), ("persona", "a:b:c:d", ["a", "b", "c:d"]), ("persona", "a:b", None), ("message", "t:1:2", ["t:1:2"]), ("message", "", None), ("youtube", "/", ["", ""]), ("youtube", "x", None)],
)
def test_references(spark, kind, ref, want):
    assert one(spark, rids.parts(F.col("k"), F.col("r")), k=kind, r=ref) == want
    assert one(spark, rids.is_valid(F.col("k"), F.col("r")), k=kind, r=ref) is (want is not None)


def test_rids(spark):
    assert one(spark, rids.parse(F.col("r")), r="orn:a.b:c:d").asDict() == {"namespace": "a.b", "reference": "c:d"}
    assert one(spark, rids.parse(F.col("r")), r="orn:a") is None
    assert one(spark, rids.make(F.lit("n"), F.col("r")), r="x") == "orn:n:x"


def test_search_text_and_preamble(spark):
    rows = [
        ("x-journal", '{"frontmatter": {"title": "T", "created": "2026"}, "body": "B"}', "T B", "Journal: T. Date: 2026."),
        ("x-web.conversation", '{"name": "N", "chat_messages": [{"text": "a"}, {"text": ""}, {"text": "b"}]}', "N\na\nb", "Conversation: N."),
        ("x-web.project", '{"name": "N", "docs": [{"filename": "f", "content": "c"}]}', "N\nf\nc", "Project: N."),
        ("x-web.memory", '{"conversations_memory": "m", "project_memories": {"a": "p"}}', "m\np", "Document from x-web.memory."),
        ("x-contact", '{"display_name": "D", "dunbar_layer": "five", "composite": 0.5}', "D dunbar:five score:0.5", "Contact: D. Layer: five."),
        ("x-youtube", '{"title": "T", "channel_handle": "@c", "tags": ["a", "b"], "description": "d"}', "T\n@c\na b\nd", "YouTube: T. Channel: @c."),
        ("x-venture", '{"frontmatter": {"title": "T", "tags": ["q"]}, "body": "B"}', "T  B q", "Venture: T."),
        ("x-other", '{"a": 1}', '{"a": 1}', "Document from x-other."),
        ("x-plan", '{"goal": "g"}', " g ", ""),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "namespace string, contents string")
    got = df.select(B.search_text().alias("t"), B.preamble().alias("p")).collect()
    assert [(r.t, r.p) for r in got] == [r[2:] for r in rows]
    assert one(spark, B.with_preamble(F.col("a"), F.col("b")), a="", b="c") == "c"
    assert one(spark, B.with_preamble(F.col("a"), F.col("b")), a="p", b="c") == "p\n---\nc"
    assert urlsplit("x").path == "x"

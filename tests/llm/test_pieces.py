from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import pieces


def check(text, size, overlap):
    got = pieces.cut(text, size, overlap)
    overlap = min(overlap, (size - 1) // 2)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(0 < b - a < size for a, b in got)
    assert all(c[0] == p[1] - overlap for p, c in zip(got, got[1:], strict=False))
    assert all(c[1] > p[1] for p, c in zip(got, got[1:], strict=False))
    return got


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n,é̈", min_size=3, max_size=300), st.integers(2, 60), st.integers(0, 80))
def test_pieces_cover_the_text(text, size, overlap):
    if len(text) > size:
        check(text, size, overlap)


def test_snaps_to_the_strongest_boundary():
    text = "a" * 70 + ".\n\n" + "b " * 40
    first = check(text, 110, 0)[0]
    assert text[first[1] - 2 : first[1]] == "\n\n"


def test_fewest_balanced_pieces():
    got = check("word " * 400, 1000, 100)
    assert len(got) == 3 and max(b - a for a, b in got) - min(b - a for a, b in got) < 60


def test_one_long_word_and_combining_marks():
    check("x" * 5000, 800, 200)
    text = "é" * 1000
    assert all(text[a] != "́" for a, _ in pieces.cut(text, 101, 0))


def test_overlap_is_a_share_or_a_number():
    assert pieces.overlap_chars(1600, 0.25) == 400
    assert pieces.overlap_chars(3000, 300.0) == 300
    assert pieces.overlap_chars(800, None) == pieces.overlap_chars(800, float("nan")) == pieces.overlap_chars(800, -1.0) == 0
    assert pieces.overlap_chars(100, 300.0) == 50


def test_table(spark):
    cols = "rid string, updated_at int, search_text string, body string, config_id string"
    long = "One sentence of it. " * 10
    rows = [("a", 1, "old " * 100, "x", "x"), ("a", 2, f" \n{long}\t", "x", "x"), ("a", 2, f" \n{long}\t", "x", "x"), ("b", 1, None, "x", "x"), ("c", 1, "", "x", "x"), ("d", 1, " \n ", "x", "x"), ("e", 1, "x" * 50, "x", "x"), ("f", 1, "y" * 51 + " ", "x", "x"), (None, 1, long, "x", "x"), ("g", None, long, "x", "x")]
    conf = spark.createDataFrame([("s", 50, 0.1, "x"), ("big", 5000, 0.0, "x"), ("none", None, 0.1, "x"), (None, 50, 0.1, "x")], "config_id string, chunk_size int, chunk_overlap double, rid string")
    got = pieces.split_oversized(spark.createDataFrame(rows, cols), conf).collect()
    assert {(r.rid, r.config_id) for r in got} == {("a", "s"), ("f", "s"), ("g", "s")}
    own = sorted((r for r in got if r.rid == "a"), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in own] == list(range(len(own)))
    whole = own[0].chunk_text + "".join(r.chunk_text[5:] for r in own[1:])
    assert whole == long.strip()
    assert all(own[i + 1].chunk_text.startswith(own[i].chunk_text[-5:]) for i in range(len(own) - 1))


def test_empty_tables(spark):
    texts = spark.createDataFrame([], "rid string, updated_at int, search_text string")
    conf = spark.createDataFrame([], "config_id string, chunk_size int, chunk_overlap double")
    assert pieces.split_oversized(texts, conf).count() == 0


def test_a_boundary_outside_the_near_window_is_used():
    text = "x" * 180 + " " + "y" * 240
    for a, b in pieces.cut(text, 260, 0)[:-1]:
        assert text[b - 1] == " " or text[b : b + 1] == " ", (a, b)

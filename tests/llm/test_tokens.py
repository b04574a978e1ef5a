import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmesh.llm import tokens

PATH = tokens.vocabulary_path()


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TRICKY = ["", " ", "  \n\n x", "don't 'tis it's", "<|endoftext|> a", "文字列  と　空白", "ก ข  ค", "a  b c", "é'll ñ's …'s", "🎉🎉 ok 👍", "\r\n\tx", "é" * 50, "v3.5行！（x）", "हिन्दी ।  पाठ", "​﻿ x", "a" * 3000]


@pytest.mark.parametrize("text", TRICKY)
def test_equals_the_public_tokenizer(text, reference):
    assert tokens.encode(text, PATH).tolist() == reference(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=("Cs",)), st.sampled_from("  \n\t'’.,。、ก่あ漢é  s")), max_size=60))
def test_equals_the_public_tokenizer_on_any_text(reference, text):
    assert tokens.encode(text, PATH).tolist() == reference(text)


def test_forced_cuts_are_used():
    raw = "私は昨日、図書館で本を読みました。".encode()
    assert len(tokens.forced_cuts(raw, tokens.encoder(PATH)[1])) > 0


def test_table(spark):
    rows = [(1, None, "clash"), (2, "", "clash"), (3, "hello <|endoftext|>", "clash"), (3, "hello <|endoftext|>", "clash"), (None, "x", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0), list(r.ids)) for r in tokens.token_ids(df).collect())
    assert got[1:3] == [(1, []), (2, [])] and got[3] == got[4] and len(got[3][1]) > 3
    assert [r.n_tokens for r in tokens.token_counts(df.where("doc_id = 2")).collect()] == [0]
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_all_texts_of_a_table_equal_plain_encoding(spark, small_dir, reference):
    docs = spark.read.parquet(f"{small_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: reference(r.text) if r.text else [] for r in docs.collect()}
    assert {r.doc_id: list(r.ids) for r in tokens.token_ids(docs).collect()} == want and len(want) > 900

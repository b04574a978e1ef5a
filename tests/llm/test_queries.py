import pytest

from quillmesh.llm import queries

COLUMNS = {
    "p1_found": [("vec_id_a", "bigint"), ("vec_id_b", "bigint")],
    "p2_found": [("rid", "string"), ("config_id", "string")],
    "p3_found": [("rid", "string"), ("turn_no", "bigint"), ("speaker_no", "bigint")],
    "p4_found": [("thread_id", "string"), ("turn_no", "bigint"), ("reference", "string"), ("role", "string")],
    "p5_found": [("entity_id_a", "bigint"), ("entity_id_b", "bigint")],
    "p6_found": [("rid", "string")],
    "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p9_found": [("doc_id", "bigint"), ("start_pos", "bigint"), ("end_pos", "bigint")],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_distinct_rows(spark, small_dir, name):
    df = queries.QUERIES[name](spark, small_dir)
    assert df.dtypes == COLUMNS[name]
    rows = df.count()
    assert rows > 0
    if name != "p7_ids":
        assert df.distinct().count() == rows


def test_pieces_repeat_the_overlap(spark, small_dir):
    sizes = {r.config_id: (r.chunk_size, r.chunk_overlap) for r in spark.read.parquet(f"{small_dir}/embedding_configs.parquet").collect()}
    rows = queries.QUERIES["p2_pieces"](spark, small_dir).orderBy("config_id", "rid", "chunk_index").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        size, overlap = sizes[b.config_id]
        chars = int(size * overlap) if overlap < 1 else int(overlap)
        assert len(b.chunk_text) < size
        if (a.config_id, a.rid) == (b.config_id, b.rid):
            assert b.chunk_index == a.chunk_index + 1 and (chars == 0 or b.chunk_text.startswith(a.chunk_text[-chars:]))


def test_every_document_has_ids(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert queries.QUERIES["p7_ids"](spark, small_dir).count() == docs.count()


def test_shares_add_up(spark, small_dir):
    got = queries.QUERIES["p8_shares"](spark, small_dir).collect()
    assert sum(r.actual_share for r in got) == pytest.approx(1)
    assert all(r.most_repeats <= r.max_repeats for r in got)

"""The registered queries give the columns that their consumers expect, over whole tables."""

import pytest

from lexspark.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": [("field_name", "string"), ("item_id", "bigint"), ("label", "string")],
    "p2_found": [("field_name", "string"), ("id_1", "bigint"), ("id_2", "bigint")],
    "p3_found": [("chunk_id_1", "bigint"), ("chunk_id_2", "bigint")],
    "p4_found": [("page_id", "bigint"), ("body_hash", "string")],
    "p5_found": [("tbl", "string"), ("record_id", "bigint"), ("piece", "string"), ("val", "string")],
    "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p9_found": [("doc_id", "bigint"), ("restored_hash", "string")],
}


@pytest.mark.parametrize("name", sorted(queries()))
def test_runs(spark, name):
    df = queries()[name](spark, DATA)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    rows = df.collect()
    assert rows and len(set(map(tuple, rows))) == len(rows)


def test_sql_is_of_queries():
    assert set(oracle_sql()) <= set(queries())

"""Registered pN_ queries on the smallest tables, against their SQL where there is one."""

import os

import pytest

from plumbline.llm import bpe, oracle, queries

NAMES = sorted(queries.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, data_dir):
    from compare import agree, duck

    if name[:3] in ("p7_", "p8_") and not os.path.exists(bpe.DEFAULT_VOCAB):
        pytest.skip("no vocabulary file here")
    df = queries.queries()[name](spark, data_dir)
    sql = oracle.oracle_sql().get(name)
    if sql:
        agree(df, duck(data_dir).sql(sql))
    else:
        assert df.count() > 0


def test_fixed_columns(spark, data_dir):
    want = {
        "p1_found": ["chunk_id", "noise"], "p2_found": ["first_id", "id"], "p3_found": ["chunk_id", "boundary"], "p4_found": ["chunk_id_a", "chunk_id_b"],
        "p5_found": ["chunk_id", "line_no"], "p6_found": ["id", "defect"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
    }
    for name, columns in want.items():
        assert queries.queries()[name](spark, data_dir).columns == columns

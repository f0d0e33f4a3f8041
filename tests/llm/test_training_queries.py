import pytest
from oracle import compare

from strandmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    if name in ORACLES:
        compare(spark, data, QUERIES[name], ORACLES[name])
    else:
        df = QUERIES[name](spark, data)
        assert df.columns and df.count() > 0


def test_found_columns(spark, data):
    want = {"p1_found": ["read_idx_a", "read_idx_b"], "p2_found": ["read_idx"], "p4_found": ["seq"], "p6_found": ["doc_id", "item_id"], "p7_found": ["source"], "p8_found": ["doc_id", "kind", "lang"]}
    for name, columns in want.items():
        assert QUERIES[name](spark, data).columns == columns

"""The queries of the problems run with their columns on the given tables."""

import pytest

from symloom.llm import entry

COLUMNS = {
    "p1_found": ["function_id"],
    "p3_found": ["file_id"],
    "p4_found": ["origin", "record_key", "line_no"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id", "pii_type"],
}


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, data, name):
    df = entry.queries()[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert len(rows) > 0 and (not name.endswith("_found") or len(rows) == len(set(rows)))

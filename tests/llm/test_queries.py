"""The registered queries run over the small tables with the columns they must have."""

import pytest

from memlake.llm.queries import QUERIES
from tests.helpers import DATA

COLUMNS = {
    "p1_found": ["key_a", "key_b"], "p2_found": ["drawer_id", "lang"], "p3_found": ["id_a", "id_b"], "p5_found": ["tab", "rec_key", "kind", "pii"],
    "p7_found": ["doc_id", "question_id"], "p8_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows and (name not in COLUMNS or df.columns == COLUMNS[name])
    if name in COLUMNS:
        assert len(rows) == len(set(rows))
        if df.columns[1][-2:] == "_b":
            assert all(r[0] < r[1] for r in rows)

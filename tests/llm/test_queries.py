import pytest

from leafmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    assert df.count() >= 0 and set(queries.SQL) <= set(queries.QUERIES)


def test_columns_of_the_found_queries(spark, folder):
    want = {"p2_found": ["doc_id_a", "doc_id_b"], "p3_found": ["doc_id", "element", "seq"], "p4_found": ["tab", "rec_id", "seg_no", "lang"], "p5_found": ["doc_id", "line_no", "noise"], "p7_ids": ["doc_id", "ids"]}
    assert {name: queries.QUERIES[name](spark, folder).columns for name in want} == want

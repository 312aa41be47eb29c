"""A sample of queries against DuckDB on the smallest tables; `tools/compare.py` runs all of them."""

import pytest

import __spark_entry__ as entry
from tools.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [
    "parse_items", "summary_card", "split", "curate_evaluate", "checkpoint_join", "summary_progress", "knn_join",
    "running_error", "deal_digest", "best_deal", "map_with_checkpoint", "strip_codes",
])
def test_query_matches_sql(spark, name):
    ok, message = compare(spark, duck(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert {r["model"] for r in entry.entry(spark).collect()} == {"constant", "random", "text"}

"""Physical plans: no cross joins, and pushdown reaches the scan."""

import pytest
from pyspark.sql import functions as F

from pricelens.operators import curate, evaluate, order
from pricelens.plans import views
from pricelens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "parse_items", "dedupe", "seen_anti", "pending_anti", "best_deal", "deal_source", "discount", "sample_per_category",
])
def test_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_stored_items_are_pruned_and_filtered_at_the_scan(spark, tmp_path):
    views.items(spark, SF).write.parquet(str(tmp_path / "items"))
    stored = spark.read.parquet(str(tmp_path / "items"))
    text = plan(stored.where("price > 100").select("id"))
    assert "ReadSchema: struct<id:bigint,price:double>" in text and "GreaterThan(price,100.0)" in text


def test_only_bounded_rows_meet_in_one_task(spark):
    """The one-task steps of a global order see bucket totals, never the rows."""
    rows = spark.range(100_000).select("id", F.lit("x" * 50).alias("full"))
    text = order.shuffle_order(rows)._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in text.splitlines() if "Window [sum(_n" in line)
    below = text[text.index(window):]
    assert "Aggregate [_bucket" in below and "full" not in below


def test_sample_shuffles_only_the_near_buckets(spark, items):
    drawn = curate.weighted_sample(items, 20)
    text = plan(drawn)
    assert "_before_n" in text and text.index("(_before_n") < text.rindex("BroadcastHashJoin")


def test_prediction_table_reads_the_test_rows_once(spark, items):
    rows = order.ordinal_by_id(items).select("ord", "title", "price")
    table = evaluate.predict_table(rows, a=F.lit(1.0), b=F.lit(2.0), c=F.lit(3.0))
    assert table.count() == 900
    assert plan(table).count("BroadcastHashJoin") <= 2

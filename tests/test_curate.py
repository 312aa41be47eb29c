import pytest
from pyspark.sql import functions as F

from pricelens import config
from pricelens.operators import curate, order
from pricelens.schemas import RAW

LONG = ["A sturdy kitchen appliance. " * 40]


def raw(spark, *rows):
    return spark.createDataFrame([(i, "Appliances", *r) for i, r in enumerate(rows)],
                                 "id bigint, category string, " + ", ".join(f.simpleString().replace(":", " ", 1) for f in RAW))


def test_parse_rejects_bad_rows(spark):
    rows = raw(
        spark,
        ("good", "19.99", LONG, ["f"], '{"Item Weight": "2 pounds", "Part Number": "P"}'),
        ("none", "None", LONG, [], None), ("null", None, LONG, [], None), ("high", "1500.00", LONG, [], None),
        ("low", "0.10", LONG, [], None), ("x", "5", [], [], None), ("bad", "5", LONG, [], "{broken"),
        ("edge", "999.49", LONG, None, ""), (None, "0.5", LONG, [], "{}"),
    )
    kept = {r["id"]: r for r in curate.parse_items(rows).collect()}
    assert set(kept) == {0, 7, 8}
    assert kept[0]["weight"] == 2.0 and kept[7]["weight"] == 0.0
    assert kept[0]["full"].startswith("good\n['A sturdy") and "Part Number" not in kept[0]["full"]
    assert len(kept[0]["full"]) <= config.MAX_TEXT_TOTAL
    assert [r["id"] for r in curate.rejected_details(rows).collect()] == [6]


def test_filter_does_not_repeat_the_text_work(spark):
    plan = curate.parse_items(raw(spark, ("a", "5", LONG, [], None)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_entries") == 1


def test_dedupe_title_then_text(spark):
    rows = [(1, "T", "A"), (2, "U", "A"), (3, "T", "B")]
    kept = curate.deduplicate(spark.createDataFrame(rows, "id bigint, title string, full string")).collect()
    # 1 and 3 share a title, so one of them goes; the survivor may still share the text of 2
    assert len(kept) in (1, 2)
    assert len({r["title"] for r in kept}) == len(kept) == len({r["full"] for r in kept})


def test_dedupe_hot_title(spark):
    rows = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("title"),
        F.concat(F.lit("x"), F.col("id").cast("string")).alias("full"),
    )
    deduped = curate.deduplicate(rows)
    assert deduped.count() == 6001
    text = deduped._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") >= 4 and "Partial" in text


def test_weights_and_sample(spark, items):
    weights = curate.sample_weights(items)
    assert weights.agg(F.sum("w")).first()[0] == pytest.approx(1.0)
    sample = curate.weighted_sample(items, 100)
    assert sample.count() == 100 == sample.select("id").distinct().count()
    assert sample.agg(F.avg("price")).first()[0] > items.agg(F.avg("price")).first()[0]
    assert sample.where("category = 'Automotive'").count() < 50
    lowest = items.orderBy("price").first()["price"]
    everything = curate.weighted_sample(items, 10_000)
    assert everything.count() == items.where(F.col("price") > lowest).count()
    equal = items.withColumn("price", F.lit(5.0))
    assert curate.weighted_sample(equal, 10).count() == 0


def test_sample_follows_the_weights(spark):
    """Over many seeds, how often a row is drawn first is in proportion to its weight."""
    rows = spark.createDataFrame([(0, "a", 0.0), (1, "a", 1.0), (2, "a", 2.0)], "id bigint, category string, price double")
    first = [curate.weighted_sample(rows, 1, seed=s).first()["id"] for s in range(40)]
    assert 0 not in first and first.count(2) > first.count(1)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_same_result_in_any_partitioning(spark, items, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = curate.split(curate.shuffled(curate.weighted_sample(curate.deduplicate(items.repartition(partitions)), 200)), (120, 40, 40))
        got = {(r["id"], r["split"], r["ord"]) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    again = curate.split(curate.shuffled(curate.weighted_sample(curate.deduplicate(items), 200)), (120, 40, 40))
    assert got == {(r["id"], r["split"], r["ord"]) for r in again.collect()} and len(got) == 200


@pytest.mark.parametrize("sizes, expected", [((100, 10, 10), (100, 10, 10)), ((800_000, 10_000, 10_000), (294, 3, 3))])
def test_split_sizes(spark, items, sizes, expected):
    rows = curate.split(order.ordinal_by_id(items), sizes)
    counts = {r["split"]: (r["n"], r["top"]) for r in rows.groupBy("split").agg(F.count("*").alias("n"), F.max("ord").alias("top")).collect()}
    assert tuple(counts[s][0] for s in config.SPLITS) == expected
    assert all(top == n - 1 for n, top in counts.values())
    assert curate.split_leakage(rows, F.col("title")).count() == 0


def test_lite_holdout_and_category_sample(spark, items):
    rows = curate.split(order.ordinal_by_id(items), (200, 50, 50))
    assert curate.lite_subset(rows, (10, 5, 5)).count() == 20
    assert curate.holdout(items).where("holdout").count() == 3
    per = curate.sample_per_category(items, 30).groupBy("category").count().collect()
    assert {r["count"] for r in per} == {30}
    assert curate.sample_per_category(items, 1000).count() == 300


def test_ordinal_and_take_first_match_a_sort(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("id"), F.pmod(F.hash("id"), F.lit(3)).alias("g"))
    got = [r["id"] for r in order.ordinal_by_id(rows).orderBy("ord").collect()]
    assert got == sorted(got)
    ords = sorted(r["ord"] for r in order.shuffle_order(rows).collect())
    assert ords == list(range(5000))
    keyed = rows.withColumn("k", order.hash_key(F.col("id"), 1)).withColumn("_b", order.hash_bucket(F.col("k")))
    mine = {r["id"] for r in order.take_first(keyed, 123, ["k", "id"], "_b").collect()}
    assert mine == {r["id"] for r in keyed.orderBy("k", "id").limit(123).collect()}
    plan = order.shuffle_order(rows).select("id", "ord")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_prefix_sums_across_chunks(spark):
    rows = spark.range(1000).select(F.lit("m").alias("model"), F.col("id").alias("ord"), (F.col("id") % 7).cast("double").alias("error"))
    got = order.prefix_sums(rows, "model", "ord", chunk=90, s=F.col("error")).orderBy("ord").collect()
    total = 0.0
    for r in got:
        total += r["ord"] % 7
        assert r["s"] == total

"""Headline queries, seconds each. Prints one JSON line.

BENCH_SF_DIR   folder with the tables (default sf 0.1)
BENCH_CPUS     local cores (default 8)
BENCH_SCALE    "1" also times the curation path on four times the rows (self-union with shifted ids)
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "parse_items", "dedupe", "weighted_sample", "split", "curate_evaluate", "summary_card", "prompt_pairs",
    "checkpoint_join", "map_with_checkpoint", "bag_of_words", "linear_price", "log_target_price", "knn_join", "knn_lsh",
    "knn_price", "running_error", "leaderboard", "deal_digest", "best_deal", "stream_deals",
]


def drain(df):
    """Run the whole plan and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def scaled(spark, sf, times):
    from pyspark.sql import functions as F

    from pricelens.operators import curate
    from pricelens.plans import views
    from pricelens.session import materialize

    raw = views.raw_items(spark, sf)
    copies = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    rows = raw.withColumn("copy", copies).withColumn("id", F.col("id") + F.col("copy") * 10_000_000).withColumn(
        "title", F.concat("title", F.lit(" "), F.col("copy").cast("string"))
    ).withColumn("description", F.transform("description", lambda d: F.concat(F.col("copy").cast("string"), d)))
    rows = materialize(rows.drop("copy").repartition(spark.sparkContext.defaultParallelism), "scaled")
    started = time.time()
    sample = materialize(curate.weighted_sample(materialize(curate.deduplicate(curate.parse_items(rows)), "d")), "s")
    drain(curate.split(curate.shuffled(sample), views.SPLIT_SHARES, total=curate.row_count(sample), proportional=True))
    return round(time.time() - started, 3)


def main():
    from pricelens.plans.catalog import QUERIES
    from pricelens.session import get_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", cores=cpus, **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "pricelens.spread.partitions": cpus,  # the test tables are one row group each
    })
    spark.sparkContext.setLogLevel("ERROR")
    drain(QUERIES["parse_items"](spark, sf))  # start the session and the code generator once
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        drain(QUERIES[name](spark, sf))
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }
    if os.environ.get("BENCH_SCALE") == "1":
        one, four = scaled(spark, sf, 1), scaled(spark, sf, 4)
        result["scaling"] = {"rows_x1": one, "rows_x4": four, "ratio": round(four / one, 2)}
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()

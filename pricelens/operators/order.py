"""Reproducible order at scale: hash keys, exact ordinals, exact first-n and prefix sums.

All of these need a global order, and none of them sorts the data in one task. Rows are put into
buckets by a monotone function of the sort key; the buckets are counted with a partial aggregate;
the running bucket totals (one row per bucket, so bounded by the bucket count whatever the data
size) are broadcast; the exact position inside a bucket comes from a window partitioned by bucket.
Every step is a deterministic function of the rows, so a re-run task gives the same answer. The input
is read twice, once for the counts (key column only): pass a stored frame when it is costly to make.
"""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricelens import config

KEY_BITS = 52
HASH_BUCKET_BITS = 16


def hash_key(id_: Column, seed) -> Column:
    """A 52-bit pseudo-random integer per row id, the same in every partitioning and engine."""
    text = F.concat(id_.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def uniform(key: Column) -> Column:
    """The hash key as a number strictly between 0 and 1."""
    return (key + F.lit(0.5)) / F.lit(float(2**KEY_BITS))


def hash_bucket(key: Column) -> Column:
    """65,536 equally likely buckets in key order."""
    return F.shiftright(key, KEY_BITS - HASH_BUCKET_BITS).cast("int")


def log_bucket(key: Column, steps: int = 64) -> Column:
    """Buckets of equal ratio for a positive key (1.6 % wide): about 90,000 at most, for any double."""
    return F.floor(F.ln(key) * steps).cast("int")


def range_bucket(df: DataFrame, column: str, name: str = "_bucket") -> DataFrame:
    """Buckets of about equal row counts for an arbitrary numeric column.

    The limits are approximate quantiles (a bounded list, fixed before the plan runs); positions
    computed from the buckets are exact whatever the limits are.
    """
    buckets = max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    value = df.withColumn("_value", F.col(column).cast("double"))
    steps = [i / buckets for i in range(1, buckets)]
    limits = sorted(set(value.approxQuantile("_value", steps, 1 / (4 * buckets))))
    splits = [float("-inf"), *limits, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="_value", outputCol=name).transform(value)
    return bucketed.withColumn(name, F.col(name).cast("int")).drop("_value")


def _bucket_totals(df: DataFrame, within, bucket: str, **sums) -> DataFrame:
    """Per bucket: the totals of all buckets before it. One row per (group, bucket)."""
    aggs = [F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(name) for name, c in sums.items()]]
    before = W.partitionBy(*within).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*within, bucket).agg(*aggs)
    zero = lambda name: F.coalesce(F.sum(name).over(before), F.lit(0))
    return totals.select(*within, bucket, *[zero(n).alias(f"_before{n}") for n in ("_n", *sums)])


def _with_totals(df: DataFrame, within, bucket: str) -> DataFrame:
    """Join every row with the total of the buckets before its own.

    Without groups the totals have one row per bucket (65,536 hash buckets, about 90,000 log buckets
    or two range buckets per shuffle partition), a few megabytes at most, so they are broadcast. With
    groups their number depends on the data, and the planner decides from the measured size; a
    shuffle by group and bucket is then the one the window needs anyway.
    """
    totals = _bucket_totals(df, within, bucket)
    return df.join(totals if within else F.broadcast(totals), [*within, bucket])


def with_ordinal(df: DataFrame, order, bucket: str, name: str = "ord", within=()) -> DataFrame:
    """Add the exact 0-based position of every row in `order` (inside each `within` group)."""
    local = F.row_number().over(W.partitionBy(*within, bucket).orderBy(*order))
    placed = _with_totals(df, within, bucket)
    return placed.withColumn(name, F.col("_before_n") + local - 1).drop("_before_n", bucket)


def take_first(df: DataFrame, n: int, order, bucket: str, within=()) -> DataFrame:
    """The exact first `n` rows in `order` (of each `within` group).

    Buckets wholly behind position `n` are dropped before anything is shuffled, so the sort and the
    shuffle only see about `n` rows per group.
    """
    local = F.row_number().over(W.partitionBy(*within, bucket).orderBy(*order))
    near = _with_totals(df, within, bucket).where(F.col("_before_n") < n)
    return near.withColumn("_at", F.col("_before_n") + local).where(F.col("_at") <= n).drop("_at", "_before_n", bucket)


def ordinal_by_id(df: DataFrame, id_: str = "id", name: str = "ord") -> DataFrame:
    """Position in id order."""
    return with_ordinal(range_bucket(df, id_), [id_], "_bucket", name)


def shuffle_order(df: DataFrame, seed=config.SEED, id_: str = "id", name: str = "ord") -> DataFrame:
    """Position in a seeded random order."""
    keyed = df.withColumn("_key", hash_key(F.col(id_), seed))
    keyed = keyed.withColumn("_bucket", hash_bucket(F.col("_key")))
    return with_ordinal(keyed, ["_key", id_], "_bucket", name).drop("_key")


def prefix_sums(df: DataFrame, group: str, ord_: str, chunk: int = 50_000, **sums) -> DataFrame:
    """Inclusive running sums over a dense position column, for groups of any size.

    A group is cut into chunks of consecutive positions: running sums inside a chunk, plus the
    totals of the chunks before it. No window ever holds more than one chunk.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(ord_) / chunk).cast("bigint"))
    for name, value in sums.items():
        chunked = chunked.withColumn(name, value)
    totals = _bucket_totals(chunked, (group,), "_chunk", **{n: F.col(n) for n in sums})
    # one row per group and 50,000 rows: left to the planner, which broadcasts it only when small
    placed = chunked.join(totals, [group, "_chunk"])
    inside = W.partitionBy(group, "_chunk").orderBy(ord_).rowsBetween(W.unboundedPreceding, 0)
    run = {n: F.col(f"_before{n}") + F.sum(n).over(inside) for n in sums}
    return placed.withColumns(run).drop("_chunk", "_before_n", *[f"_before{n}" for n in sums])

"""Resumable text enrichment: checkpoint and batch joins, progress, prompt pairs."""

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from pricelens import config
from pricelens.functions import prompts
from pricelens.functions.hooks import REWRITE_SCHEMA, rewriter
from pricelens.session import discard, materialize
from pricelens.sources.tables import read_table

# What a rewriting job counts.
USAGE = ("calls", "input_tokens", "output_tokens", "cost")

filled = lambda c: F.nullif(F.col(c), F.lit(""))


def last_per_key(rows: DataFrame, key: str, value: str, ord_: str = "ord") -> DataFrame:
    """The last value of each key.

    The rank filter becomes a group limit on both sides of the shuffle, so of a hot key each map task
    sends one row; a maximum over text would sort whole rows on both sides instead.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(ord_)))
    return rows.select(key, value, rank.alias("_rank")).where("_rank = 1").drop("_rank")


def apply_checkpoint(items: DataFrame, done: DataFrame) -> DataFrame:
    """Fill missing summaries by content key; an existing summary wins and '' counts as missing.

    `done` has one row per key. A key shared by many items makes a large left partition, which the
    adaptive skew join splits.
    """
    known = done.select(F.col("key").alias("_key"), F.col("summary").alias("_done"))
    keyed = items.withColumn("_key", prompts.content_key(F.col("full")))
    return keyed.join(known, "_key", "left").withColumn("summary", F.coalesce(filled("summary"), filled("_done"))).drop(
        "_key", "_done"
    )


def pending(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items without a summary of their own and without a non-empty one in the checkpoint."""
    known = done.where(filled("summary").isNotNull()).select(F.col("key").alias("_key"))
    open_ = items.where(filled("summary").isNull()).withColumn("_key", prompts.content_key(F.col("full")))
    return open_.join(known, "_key", "left_anti").drop("_key")


def apply_batch_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """Attach the answer with the item's position; the last answer wins, the text is not stripped."""
    answers = results.select(F.col("ord"), F.col("content").alias("_content"))
    return items.join(answers, "ord", "left").withColumn("summary", F.coalesce("_content", "summary")).drop("_content")


def map_with_checkpoint(
    items: DataFrame, fn, store: str, waves: int = 10, run: int = 0, parallelism: int = None, progress=None, **options
) -> DataFrame:
    """Rewrite the text of pending items once per distinct content key and keep every result.

    What is pending is found once a run and written as narrow rows of key and text, in `waves` by the hash of
    the key. Each wave is appended to the store before the next starts, so a broken job loses one wave at most
    and a rerun picks up where it stopped. The slow calls of a wave run in `parallelism` tasks, however
    small its texts are. `progress` is called behind each wave with the totals of the run so far, which the
    job observes as it writes: nothing is read again for them.
    """
    spark = items.sparkSession
    parallelism = parallelism or spark.sparkContext.defaultParallelism
    empty = spark.createDataFrame([], "key string, summary string, run bigint")
    done = checkpoint_state(read_table(spark, store), empty)
    key = prompts.content_key(F.col("full")).alias("key")
    todo = pending(items, done).select(key, "full").dropDuplicates(["key"])
    todo = materialize(todo.withColumn("wave", F.pmod(F.xxhash64("key"), F.lit(waves)).cast("int")), "pending")
    totals = dict.fromkeys(USAGE, 0) | {"cost": 0.0}
    for wave in range(waves):
        own = todo.where(F.col("wave") == wave).select("key", "full").repartition(parallelism, "key")
        seen = Observation()
        results = own.mapInPandas(rewriter(fn, **options), REWRITE_SCHEMA).observe(seen, *usage_columns())
        results.withColumn("run", F.lit(run).cast("bigint")).write.mode("append").parquet(store)
        totals = {n: totals[n] + (seen.get[n] or 0) for n in USAGE}
        if progress:
            progress(dict(totals))
    discard(todo)
    return apply_checkpoint(items, checkpoint_state(read_table(spark, store), empty))


def checkpoint_state(stored, empty: DataFrame) -> DataFrame:
    """Newest non-failed summary per key of a checkpoint table."""
    rows = empty if stored is None else stored.where("summary is not null")
    return last_per_key(rows, "key", "summary", "run")


def usage_columns():
    """What a rewriting job counts: calls, tokens and cost."""
    return [F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in USAGE[1:]]]


def usage_totals(results: DataFrame) -> DataFrame:
    """Tokens and cost of the rewriting job per model."""
    return results.groupBy("model").agg(*usage_columns())


def batch_of(ord_: Column, size: int = config.BATCH_SIZE) -> Column:
    return F.floor(ord_ / size).cast("bigint")


def batch_progress(items: DataFrame, batches: DataFrame, size: int = config.BATCH_SIZE) -> DataFrame:
    """Per batch: range, requested and answered counts, done, and what still has to happen.

    `batches` holds `batch, batch_id` for submitted batches; `items` holds `ord, summary`.
    """
    per = items.groupBy(batch_of(F.col("ord"), size).alias("batch")).agg(
        F.min("ord").alias("start"),
        (F.max("ord") + 1).alias("end"),
        F.count(F.lit(1)).alias("requested"),
        F.count_if(filled("summary").isNotNull()).alias("answered"),
    )
    done = F.col("answered") == F.col("requested")
    state = F.when(F.col("batch_id").isNull(), "submit").when(~done, "fetch").otherwise("done")
    return per.join(batches, "batch", "left").withColumns({"done": done, "state": state})


def prompt_pairs(splits: DataFrame, cutoff: int = config.TOKEN_CUTOFF, cut: Column = None) -> DataFrame:
    """Prompt and completion from the summary; prices are rounded except in the test split."""
    text = prompts.truncate(F.col("summary"), cutoff) if cut is None else cut
    return splits.withColumns({
        "prompt": prompts.inference_prompt(text),
        "completion": prompts.completion(F.col("price"), F.col("split")),
    })


def truncation_rate(items: DataFrame, cutoff: int = config.TOKEN_CUTOFF, count: Column = None) -> DataFrame:
    count = prompts.token_count(F.col("summary")) if count is None else count
    return items.agg(F.avg((count > cutoff).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))

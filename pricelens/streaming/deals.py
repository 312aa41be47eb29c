"""Polling for deals as a stream, with what was alerted as keyed state on disk."""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricelens import config
from pricelens.operators.deals import as_opportunity, best_deal, opportunities, top_deals, unseen
from pricelens.session import discard, materialize
from pricelens.sources.memory import alert_stream, read_memory, remember

DEAL = "product_description string, price double, url string, category string"
# Rows that the state is asked about: deals, and alerts that it is to remember.
_ROW = f"{DEAL}, poll bigint, alert boolean"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Else each of the many stores sets aside some megabytes for its logs before it holds a row.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
ALERTED = "alerted"


def read_polls(spark: SparkSession, path: str, files_per_poll: int = None) -> DataFrame:
    """Deal files as they arrive: a poll takes all that is there, or `files_per_poll` of them in a replay."""
    reader = spark.readStream.schema(DEAL)
    return (reader.option("maxFilesPerTrigger", files_per_poll) if files_per_poll else reader).json(path)


class Unalerted(StatefulProcessor):
    """Lets deals pass whose url has not been alerted. State: one flag for each alerted url, without expiry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alerted = handle.getValueState(ALERTED, "alerted boolean")

    def handleInputRows(self, key, rows, timerValues):
        known = self.alerted.exists()
        offered = []
        for part in rows:  # the rows of one url in one batch; alerts may come behind the deals they stop
            told = part["alert"].to_numpy(bool)
            if key[0] is None:  # never alerted, and possibly very many
                yield part[~told]
                continue
            if told.any() and not known:
                self.alerted.update((True,))
                known = True
            offered.append(part[~told])
        if not known:
            yield from offered

    def close(self) -> None:
        pass


def poll(deals: DataFrame, memory: DataFrame, estimate, threshold: float = config.DEAL_THRESHOLD) -> DataFrame:
    """One poll: new priced deals, the five most detailed, their estimates, the best above the threshold.

    Only alerted urls are in the memory, so a deal that was scanned and passed over comes back.
    """
    return pick(unseen(deals, memory), estimate, threshold)


def pick(deals: DataFrame, estimate, threshold: float = config.DEAL_THRESHOLD) -> DataFrame:
    """What a poll alerts of deals that were not alerted before."""
    # five rows at most, so their order needs no partitioning
    order = W.orderBy(F.length("product_description").desc(), "url")
    picked = top_deals(deals).withColumn("pos", F.row_number().over(order))
    return best_deal(opportunities(estimate(picked), F.col("estimate")), threshold=threshold)


class Polling:
    """A running query. `awaitTermination` works off all that has arrived, then stops it; a service goes on by `query`."""

    def __init__(self, query):
        self.query = query

    def awaitTermination(self) -> None:
        try:
            self.query.processAllAvailable()
        finally:
            self.query.stop()


def stream_deals(
    deals: DataFrame, memory_path: str, checkpoint: str, estimate, every: int = None,
    threshold: float = config.DEAL_THRESHOLD,
):
    """Start the polling query.

    Deals and alerts are one stream into a state that is keyed by url and kept on disk beside the
    checkpoint, so what was alerted is neither joined nor held in memory. Alerts come from the memory table
    itself: what a poll has written there, the next batch reads as new files, each once. A query with a new
    checkpoint reads the whole memory with its first batch and so knows every older alert.

    The memory is written per poll, under the id that the query keeps with its checkpoint. The checkpoint
    fixes which files belong to a batch before it runs, so one that is replayed after a failure finds the
    state as it was and replaces its row instead of alerting twice.

    A batch is a poll, unless the deals have a column `poll`: then it may hold several, which are worked
    off in their order.
    """
    spark = deals.sparkSession
    number = F.col("poll").cast("bigint") if "poll" in deals.columns else F.lit(None).cast("bigint")
    offers = deals.select("product_description", "price", "url", "category", number.alias("poll"), F.lit(False).alias("alert"))
    told = alert_stream(spark, memory_path).select(
        *[F.lit(None).cast(kind).alias(name) if name != "url" else F.col("deal")["url"].alias("url") for name, kind in (f.split(" ") for f in DEAL.split(", "))],
        F.lit(None).cast("bigint").alias("poll"), F.lit(True).alias("alert"),
    )
    open_ = offers.unionByName(told).groupBy("url").transformWithStateInPandas(Unalerted(), _ROW, "Append", "None")

    def run(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        held = materialize(batch, "poll")  # the state is asked once, though several jobs read the answer
        alerted = []  # by the polls of this batch, one each at the most; later ones must not repeat it
        for of_batch in held.select("poll").distinct().orderBy("poll").collect():
            mine = held.where(F.col("poll").eqNullSafe(F.lit(of_batch["poll"])))
            mine = mine.where(F.col("url").isNull() | ~F.col("url").isin(alerted)) if alerted else mine
            best = materialize(as_opportunity(pick(mine, estimate, threshold)), "alert")
            remember(best, memory_path, batch_id if of_batch["poll"] is None else of_batch["poll"], query)
            alerted += [r["url"] for r in best.select("deal.url").collect() if r["url"] is not None]
            discard(best)
        discard(held)

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        trigger = f"{every or 0} seconds"
        query = open_.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
    finally:  # a query keeps the settings it was started with
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return query if every else Polling(query)


def alerted_urls(spark: SparkSession, checkpoint: str) -> DataFrame:
    """`url` of everything that the state of a stopped query knows to be alerted."""
    state = spark.read.format("statestore").option("stateVarName", ALERTED).load(checkpoint)
    return state.select(F.col("key.url").alias("url"))


def start(spark: SparkSession, path: str, memory_path: str, checkpoint: str, estimate):
    """The service form: poll every five minutes until stopped."""
    return stream_deals(read_polls(spark, path), memory_path, checkpoint, estimate, every=config.POLL_SECONDS)

"""The table of opportunities that were alerted."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelens import schemas
from pricelens.sources.tables import read_table

_STORED = schemas.OPPORTUNITY + ", run string, batch_id bigint"


def read_memory(spark: SparkSession, path: str, but: tuple = None) -> DataFrame:
    """Remembered opportunities of all runs, without those of the poll `but` = (run, batch id)."""
    stored = read_table(spark, path, _STORED)
    memory = spark.createDataFrame([], _STORED) if stored is None else stored
    if but is None:
        return memory
    run, batch_id = but
    return memory.where(~((F.col("run") == run) & (F.col("batch_id") == batch_id)))


def alert_stream(spark: SparkSession, path: str) -> DataFrame:
    """The memory as a stream: what is there, then what is remembered from now on, each row once, however old."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    return spark.readStream.schema(_STORED).option("maxFileAge", "36500d").parquet(path)


def import_memory(spark: SparkSession, path: str) -> DataFrame:
    """A memory file written as one JSON array."""
    return spark.read.schema(schemas.OPPORTUNITY).option("multiLine", "true").json(path)


def remember(opportunities: DataFrame, path: str, batch_id: int, run: str = "0") -> None:
    """Write the opportunities of one poll; writing the same poll of the same run again replaces it.

    Polls are numbered from 0 in each run of a stream, so the run is part of the key: a new run never
    hides or replaces what an earlier one remembered.
    """
    poll = {"run": F.lit(run), "batch_id": F.lit(batch_id).cast("bigint")}
    rows = opportunities.select("deal", "estimate", "discount").withColumns(poll)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run", "batch_id").parquet(path)


def compact(spark: SparkSession, path: str, into: str) -> None:
    """The whole memory in few files at a new place, under one finished run; a stream goes on from there."""
    rows = read_memory(spark, path)
    remember(rows.coalesce(1 + rows.sparkSession.sparkContext.defaultParallelism), into, 0, "compacted")


def trim_memory(memory: DataFrame, keep: int = 2) -> DataFrame:
    """The first remembered opportunities: a bounded top-n by poll and url."""
    return memory.orderBy("batch_id", F.col("deal")["url"]).limit(keep)

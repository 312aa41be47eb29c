"""Session helpers: where intermediate tables live and how lineage is cut."""

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app="pricelens", cores=None, **conf):
    """A session with the settings the package is tuned for; any of them can be overridden.

    The master is the one that spark-submit or the settings name (Spark's own default is local); only
    `cores` asks for a local session of so many threads.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if cores:
        builder = builder.master(f"local[{cores}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder named by `spark.checkpoint.dir`.

    The setting is read, never written. Only where no shared folder is configured (plain local
    runs such as tests) does a temporary folder stand in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="pricelens-")
    return f"{base.rstrip('/')}/pricelens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as parquet in the shared folder and read it back.

    Used where a frame is read more than once. The written table cuts the lineage, so a lost
    executor re-reads files instead of re-running the plan, and later reads prune columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*frames: DataFrame) -> None:
    """Remove tables that `materialize` wrote, once nothing reads them any more."""
    for frame in frames:
        path = getattr(frame, "_stored_at", None)
        if path:
            spark = frame.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have texts sent to Python in batches of 4 MB: a task holds a batch on both sides several times over."""
    spark.conf.set(BATCH_BYTES, "4m")


SPREAD = "pricelens.spread.partitions"


def spread(scan: DataFrame, partitions: int = None) -> DataFrame:
    """Deal the rows of few unsplittable files (gzip, one row group) out to `partitions` tasks before text work.

    How files are cut is known to whoever lays them out, so this is a parameter, by default the setting
    `pricelens.spread.partitions`. With 0 or no setting the scan stays as it is and nothing is shuffled.
    """
    wanted = int(scan.sparkSession.conf.get(SPREAD, "0")) if partitions is None else partitions
    return scan.repartition(wanted) if wanted else scan


def once_per_session(build):
    """Keep what `build()` returns for the running Spark application.

    Column objects are immutable, and a large expression takes thousands of calls to the JVM to put
    together; building it once makes later plans cheap.
    """
    kept = {}

    @functools.wraps(build)
    def get(*args):
        key = (SparkSession.active().sparkContext.applicationId, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get

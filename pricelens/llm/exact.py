"""Exact deduplication as a stateful stream.

Documents arrive as a stream. Keyed state on disk (RocksDB) holds, for every digest ever seen and
without expiry, the number of arrivals, the stable identifier that stays (the largest so far) and
the locator of its content (file and identifier). Nothing of a text is kept in the state.

A digest that is hit again is checked on full bytes: the texts of hit digests are brought together
and compared; a class whose texts differ is divided by text.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelens.llm.common import batches_of, bounded, materialize, scratch_path

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": STATE_PROVIDER,
    # Else each of the many stores sets aside some megabytes for its logs before it holds a row.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
# Digests (of about 100 bytes) sent to every task when rows are picked by them; more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
# Files of a micro-batch: bounds what a failed batch repeats.
FILES_PER_BATCH = 10_000


def normal(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def with_digest(rows: DataFrame, *, text="text", keep_text=False, bytes_too=False) -> DataFrame:
    """The other columns of `rows`, `digest` (SHA-256 of the normal text, in hexadecimal) and, if asked for, the text and `normal`."""
    kept = [f for f in rows.schema.fields if keep_text or f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "digest string", *(["normal binary"] if bytes_too else [])])

    def run(batches):
        for batch in batches_of(batches, text, 4 << 20):
            texts = [normal(t) for t in batch.column(text).to_pylist()]
            columns = [batch.column(f.name) for f in kept] + [pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            if bytes_too:
                columns.append(pa.array(texts, pa.binary()))
            names = [f.name for f in kept] + ["digest"] + ["normal"] * bytes_too
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def arrivals(spark: SparkSession, path: str, *, text="text", key="doc_id", files_per_batch=FILES_PER_BATCH) -> DataFrame:
    """The parquet files under `path` as a stream of `id, text, file`."""
    schema = spark.read.parquet(path).select(key, text).schema
    # As a pattern, the path may also be that of a single file, which a stream refuses otherwise.
    pattern = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    return stream.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col("_metadata.file_path").alias("file"))


def classes(stream: DataFrame, name="exact") -> DataFrame:
    """Run the stream over all that has arrived; `digest, keep_id, file, n` of every digest.

    The stream has `id, file` and `text`, or `digest` where that is known already.

    The state outlives the micro-batches. Each writes the digests that it has changed into a folder of
    its own, so a repeated batch replaces its own rows; the row with the most arrivals is the last.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    last = F.max(F.struct("id", "file")).alias("last")
    state = (stream if "digest" in stream.columns else with_digest(stream)).groupBy("digest").agg(last, F.count(F.lit(1)).alias("n"))

    def put(changed, batch_id):
        changed.select("digest", "last.id", "last.file", "n").write.mode("overwrite").parquet(f"{base}/classes/batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(put)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    id_type = stream.schema["id"].dataType.simpleString()
    written = spark.read.schema(f"digest string, id {id_type}, file string, n long, batch int").parquet(f"{base}/classes")
    if query.lastProgress is None or query.lastProgress.batchId > 0:
        newest = F.max(F.struct("n", "id", "file")).alias("newest")
        written = written.groupBy("digest").agg(newest).select("digest", "newest.id", "newest.file", "newest.n")
    return written.select("digest", F.col("id").alias("keep_id"), "file", "n")


def differing(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Digests hit more than once whose texts are not all the same bytes.

    Least and greatest bytes of a class are equal just if every text equals the located one. Of a class,
    however hot, each task sends on two texts. Few hit digests are broadcast, so that no other text moves.
    """
    hits = bounded(known.where("n > 1").select("digest"), BROADCAST_DIGESTS)
    texts = with_digest(docs, bytes_too=True).join(hits, "digest")
    return texts.groupBy("digest").agg(F.min("normal").alias("least"), F.max("normal").alias("most")).where("least <> most").select("digest")


def deduplicate(docs: DataFrame, stream: DataFrame, *, text="text", key="doc_id") -> DataFrame:
    """`key, keep_id, group_size, kept, text_sha256` of every row of `docs`, dropped ones too.

    `stream` delivers the same rows (`arrivals`). Texts are equal when identical after lower-casing A-Z;
    null counts as empty. Of equal texts the row with the largest key stays; rows repeated with that key
    all stay, for they can't be told apart. A null key stays only where no other has the text. An empty table gives no rows. Other
    columns are not read.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    known = classes(stream)
    odd = materialize(differing(rows, known), "exact-differing")
    whole = with_digest(rows).join(known, "digest", "left")
    found = whole.select("id", "keep_id", F.col("n").alias("group_size"), "digest")
    if not odd.isEmpty():
        split = with_digest(rows, bytes_too=True).join(odd, "digest")
        by_text = split.groupBy("digest", "normal").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        divided = split.join(by_text, ["digest", "normal"]).select("id", "keep_id", "group_size", "digest")
        found = found.join(odd, "digest", "left_anti").select(*divided.columns).unionByName(divided)
    return found.select(
        F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )

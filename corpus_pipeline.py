"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Every stage but the last returns rows with the columns of `documents`. What an operator adds stays
apart from them: all columns but key and text travel in one struct, so extra columns of any name
pass through. Null texts count as empty; the first stage rejects them, since they have no letter.
"""

import functools

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pricelens.llm import exact, language, mixing, packing, shingles, simhash
from pricelens.llm.common import bounded, materialize, small_batches, table, tokenizer_path
from pricelens.llm.queries import MIXTURE, SEQUENCE_TOKENS, domains, held_out

# Training of a language model and its rejection, streaming state and the fit of rates have no SQL form.
ORACLE_SQL = None
# Keys of dropped documents sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def boxed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))


def unboxed(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in columns])


def one_of_each(rows: DataFrame, keys: DataFrame, mark: str) -> DataFrame:
    """Boxed rows with one of each `doc_id, mark`; `keys` has these two of every row, and is narrow.

    Only what is there more than once is moved, of a hot key one row per task.
    """
    again = keys.groupBy(F.col("doc_id").alias("_id"), F.col(mark).alias("_mark")).count().where("count > 1").drop("count")
    again = bounded(materialize(again, "pipeline-repeated"), BROADCAST_IDS)
    if again.isEmpty():
        return rows
    same = (F.col(mark) == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    place = F.row_number().over(Window.partitionBy("doc_id", mark).orderBy(F.to_json("_row")))
    first = rows.join(again, same, "left_semi").withColumn("_place", place).where("_place = 1").drop("_place")
    return rows.join(again, same, "left_anti").unionByName(first)


def stage(function):
    """A stage in a session with small batches."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return function(spark, docs, sf_dir)

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; the model learns from the labels of `docs`."""
    model = language.fit(docs.where(~held_out()))
    told = language.identify(boxed(docs), model, carry=("_row", "text"))
    return unboxed(told.where(~F.col("rejected")), docs.columns)


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest doc_id. Digests land in a folder that the stream reads."""
    landed = exact.scratch_path(spark, "pipeline-digests")
    exact.with_digest(docs.select(F.col("doc_id").alias("id"), "text")).write.parquet(landed)
    arrived = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
    found = exact.deduplicate(docs, arrived.select("id", "digest", F.col("_metadata.file_path").alias("file")))
    found = materialize(found.select("doc_id", "text_sha256", "kept"), "pipeline-found")
    goes = found.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")).distinct()
    goes = bounded(materialize(goes, "pipeline-copies"), exact.BROADCAST_DIGESTS)
    rows = exact.with_digest(boxed(docs), keep_text=True)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    left = rows.join(goes, same, "left_anti")
    stays = found.where("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    return unboxed(one_of_each(left, stays, "digest"), docs.columns)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """`a, b`: each text with a SimHash neighbour, tied to the first node of its component; as many links as texts at the most."""
    return prints.where("part <> node").select(F.col("part").alias("a"), F.col("node").alias("b"))


def text_prints(docs: DataFrame) -> DataFrame:
    """`node, fp, part`: the fingerprint of each text, and the first node of the component it links to."""
    found = simhash.near_duplicates(docs.select(shingles.node().alias("node"), "text"), key="node")
    fp = F.conv("fingerprint", 16, -10).cast("long").alias("fp")
    return materialize(found.select("node", fp, F.col("component_id").alias("part")).distinct(), "pipeline-prints")


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id.

    Links come from SimHash, where fingerprints are at most three bits apart, and from minimum hashes, as similarity 0.8 is
    often more bits than that. All of them are confirmed on whole sets of shingles: at first those to the first text of a
    component, then all pairs that these have not brought together.
    """
    rows, prints = boxed(docs).withColumn("node", shingles.node()), text_prints(docs)
    # Equal texts are one node, also where nothing else is near.
    ids = rows.select("doc_id", "node").distinct().join(shingles.groups(docs, fingerprint_links(prints), prints), "node", "left")
    ids = materialize(ids.select("doc_id", "node", F.coalesce("component", "node").alias("component")), "pipeline-near-ids")
    # A null key stays only where the group has no other.
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("node").alias("of"))).alias("first")
    stays = ids.groupBy("component").agg(first)
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("node") == F.col("first.of")))
    goes = ids.join(stays, "component").where(other).select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    goes = bounded(materialize(goes, "pipeline-near"), BROADCAST_IDS)
    same = (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    left = rows.join(goes, same, "left_anti")
    return unboxed(one_of_each(left, left.select("doc_id", "node"), "node"), docs.columns)


@stage
def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, so that domains meet their target shares of tokens."""
    mixed = mixing.mix(boxed(docs), domains(spark, sf_dir), MIXTURE, carry=("doc_id", "_row", "text"))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return unboxed(mixed.where("copies > 0").withColumn("_copy", copies), docs.columns)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), limit=SEQUENCE_TOKENS)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

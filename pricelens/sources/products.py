"""Raw product lines, per category, plain or gzip."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelens import config
from pricelens.operators.curate import parse_items
from pricelens.schemas import RAW_LINE
from pricelens.sources.tables import read_table

# `meta_Toys.jsonl`, `meta_Toys.jsonl.gz` or a folder `meta=Toys`
_CATEGORY = r"meta[_=]([^/.]+)"
# What `parse_items` makes of a raw row.
_PARSED = "id bigint, title string, price double, full string, weight double, category string"


def read_raw(spark: SparkSession, *paths: str, partitions: int = 0) -> DataFrame:
    """Non-blank lines parsed with the fixed schema; the category comes from the file name.

    A gzip file is one task; `partitions` spreads its rows before the text work. The id is a hash of
    the line, so it does not depend on file order or partitioning.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(list(paths))
    lines = lines.select("value", F.regexp_extract("_metadata.file_path", _CATEGORY, 1).alias("category"))
    lines = lines.where(F.trim("value") != "")
    if partitions:
        lines = lines.repartition(partitions)
    row = F.from_json("value", RAW_LINE)
    rows = lines.select(F.xxhash64("category", "value").alias("id"), "category", row.alias("r")).select("id", "category", "r.*")
    # A list becomes an array; a single text stays apart from it, since it isn't shown as a list.
    texts = ("description", "features")
    plain = F.struct(*[
        F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")).alias(c) for c in texts
    ])
    return rows.withColumns({"plain": plain, **{c: F.try_variant_get(c, "$", "array<string>") for c in texts}})


def read_products(spark: SparkSession, *paths: str, partitions: int = 0) -> DataFrame:
    return parse_items(read_raw(spark, *paths, partitions=partitions))


def write_raw(raw: DataFrame, path: str) -> None:
    """Raw rows as JSON lines in one folder per category."""
    line = F.to_json(F.struct("title", "price", "description", "features", "details"))
    raw.select(F.col("category").alias("meta"), line.alias("value")).write.partitionBy("meta").text(path)


def category_path(path: str, category: str) -> str:
    return f"{path}/meta={category}"


def load_categories(spark: SparkSession, path: str, categories=config.CATEGORIES) -> DataFrame:
    """Several categories in one read; files of other categories are never opened."""
    return read_products(spark, *[category_path(path, c) for c in categories])


def category_cache(spark: SparkSession, path: str, cache: str, categories=config.CATEGORIES, force=()) -> DataFrame:
    """Parsed categories as parquet, one folder each; only missing or forced ones are parsed.

    What has been parsed is noted beside the cache once its rows are there, so a category of which no row was
    kept isn't parsed again, and one whose writing broke off is.
    """
    noted = f"{cache.rstrip('/')}-parsed"
    done = read_table(spark, noted, "category string")
    present = set() if done is None else {r[0] for r in done.distinct().collect()}
    wanted = [c for c in categories if c not in present or c in force]
    if wanted:
        writer = load_categories(spark, path, wanted).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("category").parquet(cache)
        spark.createDataFrame([(c,) for c in wanted], "category string").coalesce(1).write.mode("append").parquet(noted)
    return spark.read.schema(_PARSED).parquet(cache).where(F.col("category").isin(*categories))

"""Parquet tables that may not exist yet."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, path: str, schema: str = None):
    """The table at `path`, or None when nothing was written there yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key the table does not hold yet, each key once; safe to repeat in any input order."""
    spark = rows.sparkSession
    stored = read_table(spark, path)
    fresh = rows.dropDuplicates([key])
    fresh = fresh if stored is None else fresh.join(stored.select(key), key, "left_anti")
    fresh.select(*rows.columns).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def document_id(position):
    return F.concat(F.lit("doc_"), position.cast("string"))


def index_rows(items: DataFrame) -> DataFrame:
    """Rows of the vector index: document id, text, vector and metadata."""
    return items.select(document_id(F.col("id")).alias("doc"), "id", "document", "embedding", "category", "price")

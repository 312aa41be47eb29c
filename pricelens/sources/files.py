"""Split files, chat lines, batch requests and answers, checkpoints and guesses."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pricelens import config, schemas
from pricelens.functions import prompts
from pricelens.operators.enrich import batch_of, last_per_key


def save_splits(splits: DataFrame, path: str, kind: str = "items") -> None:
    """JSON lines in one folder per split; kind `items_prompts` keeps only the prompt pair."""
    names = schemas.DATAPOINT.names if kind == "items_prompts" else schemas.ITEM.names
    columns = [n if n in splits.columns else F.lit(None).alias(n) for n in names]
    splits.select(*columns, "split").write.partitionBy("split").json(path)


def load_splits(spark: SparkSession, path: str, kind: str = "items") -> DataFrame:
    schema = schemas.DATAPOINT if kind == "items_prompts" else schemas.ITEM
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("split", T.StringType())])).json(path)


def write_chat(splits: DataFrame, path: str) -> None:
    """Fine-tuning lines: the user instruction and the price as the answer."""
    messages = prompts.training_messages(F.col("summary"), F.col("price"))
    line = F.to_json(F.struct(messages.alias("messages")))
    splits.select("split", line.alias("value")).write.partitionBy("split").text(path)


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.schema("value string, split string").text(path)
    return lines.select("split", F.from_json("value", schemas.CHAT_LINE)["messages"].alias("messages"))


def batch_requests(items: DataFrame, size: int = config.BATCH_SIZE) -> DataFrame:
    """One request line per item with its batch number and the name of the batch file."""
    batch = batch_of(F.col("ord"), size)
    total = items.agg(F.count(F.lit(1))).scalar()
    name = F.concat_ws("_", batch * size, F.least((batch + 1) * size, total))
    return items.select(
        "ord", batch.alias("batch"), F.concat(name, F.lit(".jsonl")).alias("file"),
        prompts.batch_request(F.col("ord"), F.col("full")).alias("value"),
    )


def write_batch_requests(requests: DataFrame, path: str) -> None:
    """One file per batch (a folder of one part), its lines in the order of the items."""
    rows = requests.repartition("file").sortWithinPartitions("file", "ord")
    rows.select("file", "value").write.partitionBy("file").text(path)


def parse_batch_results(lines: DataFrame) -> DataFrame:
    """Response lines to `ord, content`; the last line of an item wins when `line` numbers exist."""
    row = F.from_json("value", schemas.BATCH_RESPONSE)
    answer = F.get(row["response"]["body"]["choices"], 0)["message"]["content"]
    parsed = lines.select(row["custom_id"].try_cast("bigint").alias("ord"), answer.alias("content"), "line")
    return last_per_key(parsed.where("ord is not null"), "ord", "content", "line")


def parse_checkpoint(lines: DataFrame) -> DataFrame:
    """Checkpoint lines to one summary per key: bad lines are skipped, the last line of a key wins."""
    row = F.from_json("value", schemas.CHECKPOINT_LINE)
    parsed = lines.select(row["key"].alias("key"), row["summary"].alias("summary"), "ord")
    return last_per_key(parsed.where("key is not null and summary is not null"), "key", "summary")


def write_guess_sheet(test: DataFrame, path: str, size: int = 100) -> None:
    """The first summaries with a guess of 0, to be filled in by hand."""
    sheet = test.where(F.col("ord") < size).select("summary", F.lit(0.0).alias("guess"))
    sheet.write.option("quoteAll", "true").option("escape", '"').csv(path)


def read_guesses(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(schemas.GUESS).option("multiLine", "true").option("quote", '"').option("escape", '"')
    return reader.csv(path)

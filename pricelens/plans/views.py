"""Pipeline inputs derived from the driver tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelens import config
from pricelens.functions import markup, prompts, scoring
from pricelens.operators import curate, deals as deal_ops, enrich, evaluate, models
from pricelens.operators.order import ordinal_by_id
from pricelens.session import discard, materialize, once_per_session, small_batches, spread

# Shares of training, validation and test rows.
SPLIT_SHARES = (800_000, 100_000, 100_000)
# Batch size used on the test tables.
BATCH_ROWS = 100

_UNITS = ("pounds", "ounces", "grams", "kilograms", "hundredths pounds", "heavy")


@once_per_session
def _schema(path: str):
    return SparkSession.active().read.parquet(path).schema


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of a query, whose session gets small batches: what a Python worker holds follows neither rows nor pages."""
    small_batches(spark)
    path = f"{sf}/{name}.parquet"
    return spark.read.schema(_schema(path)).parquet(path)


def _pick(values, position):
    return F.get(F.array(*[F.lit(v) for v in values]), position)


@once_per_session
def _raw_columns():
    line = lambda n: F.split_part("text", F.lit("\n"), F.lit(n))
    price = F.when(F.col("id") % 97 == 13, "None").otherwise(F.bround(F.col("value") * 3, 2).cast("string"))
    details = F.concat(
        F.lit('{"Item Weight": "'), F.col("p_size").cast("string"), F.lit(" "), _pick(_UNITS, (F.col("id") % 6).cast("int")),
        F.lit('", "Part Number": "'), F.upper(F.substring(F.md5(F.col("id").cast("string")), 1, 10)),
        F.lit('", "Brand": "'), F.col("p_brand"), F.lit('"}'),
    )
    return (
        "id", line(1).alias("title"), _pick(config.CATEGORIES, (F.col("id") % 8).cast("int")).alias("category"),
        price.alias("price"), F.array("text").alias("description"), F.array(line(2), line(3)).alias("features"),
        details.alias("details"),
    )


def raw_items(spark, sf) -> DataFrame:
    """Documents as raw product rows, with prices from events and details from parts."""
    d = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "value")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_brand")
    return d.join(e, "id").join(p, "id").select(*_raw_columns())


def items(spark, sf) -> DataFrame:
    return curate.parse_items(raw_items(spark, sf))


def items_summary(spark, sf) -> DataFrame:
    return curate.parse_items(raw_items(spark, sf), cards=True)


def deduplicated(spark, sf) -> DataFrame:
    return materialize(curate.deduplicate(items(spark, sf)), "deduplicated")


def splits(spark, sf, shares=SPLIT_SHARES) -> DataFrame:
    """All curated items of nonzero weight with `split` and `ord`, written once: everything downstream reads them often.

    Duplicates are found and positions are given on narrow rows, with a digest for the text. The texts
    join them at the end; what was written on the way is dropped.
    """
    whole = materialize(items_summary(spark, sf), "items")
    narrow = whole.select("id", "title", "category", "price", F.sha2("full", 256).alias("full"))
    unique = materialize(curate.deduplicate(narrow), "unique")
    drawn = materialize(curate.weighty(unique), "drawn")
    parts = curate.split(curate.shuffled(drawn), shares, total=curate.row_count(drawn), proportional=True)
    out = materialize(whole.join(parts.select("id", "split", "ord"), "id"), "splits")
    discard(whole, unique, drawn)
    return out


def part_of(frame: DataFrame, name: str) -> DataFrame:
    return frame.where(F.col("split") == name)


def positioned(spark, sf) -> DataFrame:
    """Items with their position in id order."""
    return ordinal_by_id(materialize(items(spark, sf), "items"))


def checkpoint_lines(spark, sf) -> DataFrame:
    """Checkpoint text: one line per item of known weight; two for Electronics, cut short for Toys."""
    known = items(spark, sf).where("weight > 0")
    line = lambda prefix: F.to_json(
        F.struct(prompts.content_key(F.col("full")).alias("key"), F.concat(F.lit(prefix), F.col("title")).alias("summary"))
    )
    first = F.when(F.col("category") == "Toys_and_Games", F.substring(line("Card: "), 1, 12)).otherwise(line("Draft: "))
    rows = known.select(
        F.col("id"), F.when(F.col("category") == "Electronics", F.array(first, line("Card: "))).otherwise(F.array(first)).alias("v")
    )
    return rows.select("id", F.posexplode("v").alias("pos", "value")).select(
        "value", (F.col("id") * 2 + F.col("pos")).alias("ord")
    )


def batch_responses(spark, sf) -> DataFrame:
    """One response line per positioned item except Appliances, which have no answer yet."""
    content = F.concat(F.lit(" Card: "), F.col("title"), F.lit("\n"))
    message = F.struct(F.struct(content.alias("content")).alias("message"))
    body = F.struct(F.struct(F.array(message).alias("choices")).alias("body"))
    line = F.to_json(F.struct(F.col("ord").cast("string").alias("custom_id"), body.alias("response")))
    return positioned(spark, sf).where("category <> 'Appliances'").select(line.alias("value"), F.col("ord").alias("line"))


def index_items(spark, sf) -> DataFrame:
    """Vectors with a category, a price and a document text."""
    e = table(spark, sf, "embeddings")
    v = table(spark, sf, "events").select(F.col("event_id").alias("vec_id"), "value")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("vec_id"), "p_name")
    return e.join(v, "vec_id").join(p, "vec_id", "left").select(
        F.col("vec_id").alias("id"), "embedding", _pick(config.CATEGORIES, F.col("label") % 8).alias("category"),
        F.bround(F.col("value") * 3, 2).alias("price"),
        F.coalesce("p_name", F.concat(F.lit("vector "), F.col("vec_id").cast("string"))).alias("document"),
    )


def text_answer(price):
    """A price answer in words."""
    return F.concat(F.lit("It costs about $"), F.bround(price + 12.5, 2).cast("string"), F.lit(" or so"))


def predictions(spark, sf, frame=None) -> DataFrame:
    """Test predictions of a constant, a random and a text-answering model."""
    frame = splits(spark, sf) if frame is None else frame
    return evaluate.predict_table(
        part_of(frame, "test"),
        constant=models.mean_price(part_of(frame, "train")),
        random=models.random_price(F.col("id")),
        text=scoring.extract_price(text_answer(F.col("price"))),
    )


def feed_entries(spark, sf) -> DataFrame:
    """Pages as feed entries by host; entries whose link has a fragment count as broken."""
    url = F.when(F.contains("url", F.lit("#")), None).otherwise(F.col("url"))
    return table(spark, sf, "pages").select(
        F.split_part("url", F.lit("/"), F.lit(3)).alias("feed"), F.col("page_id").alias("pos"),
        markup.page_title(F.col("html")).alias("title"), url.alias("url"),
    )


def scraped(spark, sf) -> DataFrame:
    from pricelens.sources.feeds import deal_source

    return deal_source(feed_entries(spark, sf), table(spark, sf, "pages"))


def page_offers(spark, sf) -> DataFrame:
    """What each page offers, by its number: an advertised price, and the category of the deal."""
    offer = F.concat(F.lit(" Now $"), F.col("value").cast("string"), F.lit(" after $20 off"))
    category = _pick(config.CATEGORIES, (F.col("event_id") % 8).cast("int"))
    return table(spark, sf, "events").select(F.col("event_id").alias("pos"), offer.alias("offer"), category.alias("category"))


def deal_pages(spark, sf) -> DataFrame:
    """Pages with an offer, as entries of a feed."""
    rows = table(spark, sf, "pages").withColumnRenamed("page_id", "pos").join(page_offers(spark, sf), "pos")
    return rows.select(F.split_part("url", F.lit("/"), F.lit(3)).alias("feed"), "pos", F.lit(None).cast("string").alias("title"), "url", "html", "offer", "category")


def deals(spark, sf) -> DataFrame:
    """Pages as deals: the article text with an advertised price at the end."""
    text = F.concat(markup.page_section(F.col("html")), F.col("offer"))
    rows = deal_pages(spark, sf).select("pos", "feed", "url", "category", text.alias("product_description"))
    return rows.withColumn("price", deal_ops.advertised_price(F.col("product_description")))


def estimated(rows: DataFrame, item_rows: DataFrame) -> DataFrame:
    """Value estimate of a deal: the mean price of its category (one row per category)."""
    means = item_rows.groupBy("category").agg(F.round(F.avg("price"), 6).alias("estimate"))
    return rows.join(means, "category", "left")


def priced_deals(spark, sf) -> DataFrame:
    return deal_ops.opportunities(estimated(deals(spark, sf), items(spark, sf)), F.col("estimate"))


def memory(spark, sf) -> DataFrame:
    """Remembered opportunities: the best deal of every feed."""
    return deal_ops.as_opportunity(deal_ops.best_deal(priced_deals(spark, sf), "feed"))


def open_summaries(spark, sf) -> DataFrame:
    """Items where only heavy ones carry a summary yet; for very cheap ones it is empty."""
    summary = F.when(F.col("weight") > 10, F.concat(F.lit("Own: "), F.col("title"))).when(F.col("price") < 5, "")
    return items(spark, sf).withColumn("summary", summary)


def batch_state(spark, sf):
    """Items with answers attached and the submitted batches (all but the last)."""
    from pricelens.sources.files import parse_batch_results

    rows = positioned(spark, sf).withColumn("summary", F.lit(None).cast("string"))
    answered = enrich.apply_batch_results(rows, parse_batch_results(batch_responses(spark, sf)))
    batches = answered.select(enrich.batch_of(F.col("ord"), BATCH_ROWS).alias("batch")).distinct()
    last = batches.agg(F.max("batch")).scalar()
    batches = batches.withColumn("batch_id", F.when(F.col("batch") < last, F.concat(F.lit("batch_"), F.col("batch"))))
    return answered, batches

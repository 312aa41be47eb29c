"""Deals: price reading, selection, estimates, the best opportunity and its texts."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricelens import config
from pricelens.functions import markup

# Fixed patterns: amounts that are a reduction, and an advertised price.
_OFF = r"(?i)(\$[\d,]+(\.\d+)? off|(reduced|cut) by \$[\d,]+(\.\d+)?)"
_PRICE = r"\$([\d,]+(?:\.\d+)?)"


def advertised_price(text: Column) -> Column:
    """First dollar amount that is not a reduction; null when no price is clear."""
    clean = F.regexp_replace(text, _OFF, "")
    return F.translate(F.regexp_extract(clean, _PRICE, 1), ",", "").try_cast("double")


def positive_price(deals: DataFrame) -> DataFrame:
    return deals.where(F.col("price") > 0)


def unseen(deals: DataFrame, memory: DataFrame) -> DataFrame:
    """Deals whose url was not alerted before."""
    seen = memory.select(F.col("deal")["url"].alias("url")).distinct()
    return deals.join(seen, "url", "left_anti")


def top_deals(deals: DataFrame, n: int = config.DEALS_PER_SCAN) -> DataFrame:
    """The most detailed deals with a clear price above 0."""
    return positive_price(deals).orderBy(F.length("product_description").desc(), "url").limit(n)


def opportunities(deals: DataFrame, estimate: Column) -> DataFrame:
    """Deals with their estimated value and the discount against it."""
    return deals.withColumn("estimate", estimate).withColumn("discount", F.col("estimate") - F.col("price"))


def best_deal(opps: DataFrame, *keys: str, threshold: float = config.DEAL_THRESHOLD, tie: str = "pos") -> DataFrame:
    """Per group the largest discount, the first on ties, if it is above the threshold.

    With keys, the rank filter becomes a group limit before and behind the shuffle: a hot group sends one
    row per task, and no whole rows are sorted but those of a partition. Without keys it is a top-1.
    """
    order = [F.desc_nulls_last("discount"), F.col(tie)]
    if not keys:
        return opps.orderBy(*order).limit(1).where(F.col("discount") > threshold)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    best = opps.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return best.where(F.col("discount") > threshold)


def as_opportunity(rows: DataFrame) -> DataFrame:
    """Nested rows as they are remembered."""
    return rows.select(F.struct("product_description", "price", "url").alias("deal"), "estimate", "discount")


def deal_digest(scraped: DataFrame) -> DataFrame:
    """One prompt per feed from its deals in order; a feed has ten entries at most."""
    text = markup.deal_text(*[F.col(c) for c in ("title", "details", "features", "url")])
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))), lambda b: b["text"])
    prompt = F.concat(F.lit(config.DEAL_PROMPT_PREFIX), F.array_join(blocks, "\n\n"), F.lit(config.DEAL_PROMPT_SUFFIX))
    return scraped.groupBy("feed").agg(prompt.alias("prompt"), F.count(F.lit(1)).alias("deals"))

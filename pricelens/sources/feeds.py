"""Feed entries joined with their pages."""

from pyspark.sql import DataFrame, Window as W, functions as F

from pricelens import config
from pricelens.functions import markup


def first_entries(entries: DataFrame, n: int = config.ENTRIES_PER_FEED) -> DataFrame:
    """The first `n` entries of every feed by position; the limit also runs before the shuffle."""
    rank = F.row_number().over(W.partitionBy("feed").orderBy("pos"))
    return entries.withColumn("rank", rank).where(F.col("rank") <= n)


def deal_source(entries: DataFrame, pages: DataFrame, n: int = config.ENTRIES_PER_FEED) -> DataFrame:
    """Scraped deals of the first entries; entries without a link or a page are skipped."""
    joined = first_entries(entries, n).where("url is not null").join(pages.select("url", "html"), "url")
    content = markup.page_section(F.col("html"))
    return joined.select("feed", "rank", "url", *markup.deal_fields(F.col("title"), content))

"""Raw products to a deduplicated, weighted, split set of items."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricelens import config
from pricelens.functions import cleaning, prompts
from pricelens.operators.order import (
    hash_bucket, hash_key, log_bucket, shuffle_order, take_first, uniform,
)
from pricelens.session import once_per_session


def computed(df: DataFrame, *columns) -> DataFrame:
    """A projection that is evaluated once per row even if a filter on its results follows.

    A filter is normally pushed below the projection by copying the expressions into it; a generator
    of exactly one row keeps it above.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


@once_per_session
def _priced_columns():
    price = cleaning.number(F.col("price"))
    title = F.coalesce("title", F.lit("")).alias("title")
    details = cleaning.details_map(F.col("details")).alias("details")
    return cleaning.in_price_range(price), ("id", title, "category", price.alias("price"), "description", "features", details)


@once_per_session
def _item_columns(plain: bool):
    clean = cleaning.drop_noise_keys(F.col("details"))
    full = cleaning.scrub(F.col("title"), F.col("description"), F.col("features"), clean, F.col("plain") if plain else None)
    weight = cleaning.weight_pounds(cleaning.detail_text(F.col("details"), "Item Weight"))
    return "id", "title", "category", "price", full.alias("full"), weight.alias("weight")


@once_per_session
def _card():
    return prompts.summary_card(*[F.col(c) for c in ("title", "category", "description", "features", "details")])


def parse_items(raw: DataFrame, cards: bool = False) -> DataFrame:
    """Price filter first, then details, weight and cleaned text, then the minimum-length filter.

    A column `plain`, as `read_raw` makes it, holds descriptions and features that aren't lists. With `cards`
    items get a `summary` from their columns; one that `raw` has already is kept, unless it is empty.
    """
    in_range, columns = _priced_columns()
    plain = "plain" in raw.columns
    own = ["summary"] if cards and "summary" in raw.columns else []
    priced = computed(raw.where(in_range), *columns, *(["plain"] if plain else []), *own).where(F.col("details").isNotNull())
    if not cards:
        return computed(priced, *_item_columns(plain)).where(F.length("full") >= config.MIN_CHARS)
    whole = computed(priced, *_item_columns(plain), "description", "features", "details", *own)
    long = whole.where(F.length("full") >= config.MIN_CHARS)
    summary = F.coalesce(F.nullif(F.col("summary"), F.lit("")), _card()) if own else _card()
    return long.select("id", "title", "category", "price", "full", "weight", summary.alias("summary"))


def rejected_details(raw: DataFrame) -> DataFrame:
    """Rows whose details are not valid JSON; `parse_items` leaves them out."""
    return raw.where(cleaning.bad_details(F.col("details")))


def first_per_key(df: DataFrame, key: str, order) -> DataFrame:
    """One row per key, the first in `order`.

    The rank filter becomes a group limit that runs before the shuffle too, so of a key shared by a
    third of all rows each map task sends a single row.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def deduplicate(items: DataFrame, seed=config.SEED) -> DataFrame:
    """In seeded random order keep the first row per title, then the first per text among those."""
    keyed = items.withColumn("_key", hash_key(F.col("id"), seed))
    order = ["_key", "id"]
    return first_per_key(first_per_key(keyed, "title", order), "full", order).drop("_key")


def price_range(items: DataFrame) -> DataFrame:
    return items.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))


def _raw_weight(items: DataFrame) -> Column:
    lo = items.agg(F.min("price")).scalar()
    hi = items.agg(F.max("price")).scalar()
    factors = F.create_map(*[F.lit(x) for pair in config.CATEGORY_FACTORS.items() for x in pair])
    spread = F.pow((F.col("price") - lo) / (hi - lo + F.lit(1e-9)), F.lit(2.0))
    return spread * F.coalesce(F.try_element_at(factors, F.col("category")), F.lit(1.0))


def sample_weights(items: DataFrame) -> DataFrame:
    """Squared position in the price range, damped for two categories, summing to one."""
    raw = items.withColumn("w", _raw_weight(items))
    total = raw.agg(F.sum("w")).scalar()
    return raw.withColumn("w", F.try_divide(F.col("w"), total))


def weighty(items: DataFrame) -> DataFrame:
    """All rows of nonzero weight: what a weighted sample of any size can draw from."""
    return items.where(_raw_weight(items) > 0)


def weighted_sample(items: DataFrame, size: int = config.SAMPLE_SIZE, seed=config.SEED) -> DataFrame:
    """Draw `size` rows without replacement, each draw in proportion to its weight.

    Exponential keys -ln(u)/w (Efraimidis and Spirakis): the `size` smallest keys have the same
    distribution as successive draws. Rows of weight 0 are never drawn. The draw uses its own seed
    text, so that it does not depend on which copy the deduplication kept. `items` is read twice
    (price range and rows): pass a materialised frame.
    """
    keyed = items.withColumn("_w", _raw_weight(items)).where("_w > 0")
    u = uniform(hash_key(F.col("id"), f"{seed}:sample"))
    keyed = keyed.withColumn("_draw", -F.ln(u) / F.col("_w"))
    keyed = keyed.withColumn("_bucket", log_bucket(F.col("_draw")))
    return take_first(keyed, size, ["_draw", "id"], "_bucket").drop("_w", "_draw")


def split_bounds(total: Column, sizes, proportional: bool = False) -> tuple[Column, Column, Column]:
    """Train, validation and test sizes; scaled down in proportion when there are too few rows.

    If `proportional`, the sizes are shares of whatever there is, and no row is a surplus.
    """
    wanted = sum(sizes)
    short = F.lit(True) if proportional else total < wanted
    part = lambda size: F.when(
        short, F.greatest(F.lit(1), (F.lit(float(size)) * (total / F.lit(float(wanted)))).cast("bigint"))
    ).otherwise(F.lit(size))
    val, test = part(sizes[1]), part(sizes[2])
    return F.when(short, total - val - test).otherwise(F.lit(sizes[0])), val, test


def row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def split(
    items: DataFrame, sizes=config.FULL_SIZES, ord_: str = "ord", total: Column = None, proportional: bool = False
) -> DataFrame:
    """Consecutive slices by position; surplus rows go. `ord` restarts at 0 in every split.

    `total` can pass the number of rows when it is cheaper to count them elsewhere.
    """
    train, val, test = split_bounds(row_count(items) if total is None else total, sizes, proportional)
    sized = items.withColumns({"_train": train, "_val": val, "_test": test})
    at = F.col(ord_)
    name = (
        F.when(at < F.col("_train"), "train")
        .when(at < F.col("_train") + F.col("_val"), "validation")
        .when(at < F.col("_train") + F.col("_val") + F.col("_test"), "test")
    )
    start = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", F.col("_train")).otherwise(
        F.col("_train") + F.col("_val")
    )
    return (
        sized.withColumn("split", name).where(F.col("split").isNotNull())
        .withColumn(ord_, at - start).drop("_train", "_val", "_test")
    )


def shuffled(items: DataFrame, seed=config.SEED) -> DataFrame:
    """Position of the drawn rows in a second seeded order (independent of the draw)."""
    return shuffle_order(items, f"{seed}:split")


def lite_subset(splits: DataFrame, sizes=config.LITE_SIZES) -> DataFrame:
    """The first rows of each split."""
    limits = F.create_map(*[F.lit(x) for pair in zip(config.SPLITS, sizes) for x in pair])
    return splits.where(F.col("ord") < F.try_element_at(limits, F.col("split")))


def head_clip(df: DataFrame, size: int, ord_: str = "ord") -> DataFrame:
    """The first `size` rows by position; a plain filter, as positions are dense."""
    return df.where(F.col(ord_) < size)


def sample_per_category(items: DataFrame, n: int, seed=config.SEED) -> DataFrame:
    """Exactly `n` random rows of each category, all rows of smaller ones."""
    keyed = items.withColumn("_key", hash_key(F.col("id"), f"{seed}:category"))
    keyed = keyed.withColumn("_bucket", hash_bucket(F.col("_key")))
    return take_first(keyed, n, ["_key", "id"], "_bucket", within=("category",)).drop("_key")


def holdout(items: DataFrame, fraction: float = 0.01, seed=config.SEED) -> DataFrame:
    """Mark a random `fraction` (rounded up) as validation rows."""
    ranked = shuffle_order(items, f"{seed}:holdout", name="_at")
    size = F.ceil(row_count(items) * F.lit(fraction))
    return ranked.withColumn("holdout", F.col("_at") < size).drop("_at")


def resplit(train: DataFrame, validation: DataFrame, test: DataFrame) -> DataFrame:
    """Three separate inputs as one frame with a `split` column, to be processed once."""
    parts = [df.withColumn("split", F.lit(name)) for df, name in zip((train, validation, test), config.SPLITS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def split_leakage(splits: DataFrame, key: Column) -> DataFrame:
    """Test rows whose key also occurs in training; must be empty."""
    keyed = splits.withColumn("_k", key)
    train = keyed.where("split = 'train'").select("_k").distinct()
    return keyed.where("split = 'test'").join(train, "_k", "left_semi").drop("_k")


def clear_columns(items: DataFrame) -> DataFrame:
    """After enrichment the long text and the id are no longer needed."""
    return items.withColumns({"full": F.lit(None).cast("string"), "id": F.lit(None).cast("bigint")})

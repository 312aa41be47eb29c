"""Price answers, features, errors and labels as column expressions."""

from pyspark.sql import Column, functions as F

from pricelens import config
from pricelens.functions.pytext import money

# Fixed pattern: a sign counts only in front of a number with a decimal point.
_PRICE = r"[-+]?\d*\.\d+|\d+"


def extract_price(answer: Column) -> Column:
    """First number in a text answer, 0 when there is none."""
    return F.coalesce(F.regexp_extract(F.translate(answer, "$,", ""), _PRICE, 0).try_cast("double"), F.lit(0.0))


def price_features(weight: Column, summary: Column):
    known = F.coalesce(weight, F.lit(0.0))
    return [
        known.alias("weight"),
        (known == 0).cast("int").alias("weight_unknown"),
        F.length(F.coalesce(summary, F.lit(""))).alias("text_length"),
    ]


def clip_title(title: Column) -> Column:
    return F.when(F.length(title) > 40, F.concat(F.substring(title, 1, 40), F.lit("..."))).otherwise(title)


def prompt_title(prompt: Column) -> Column:
    """Title line of a prompt: the text after the first `Title: `, or everything when there is none."""
    pieces = F.split(prompt, "Title: ")
    first = F.substring_index(F.get(pieces, 1), "\n", 1)
    return clip_title(F.coalesce(first, F.get(pieces, 0)))


def error_band(error: Column, truth: Column) -> Column:
    share = F.try_divide(error, truth)
    below = lambda dollars, part: (error < dollars) | F.coalesce(share < part, F.lit(False))
    return F.when(below(40, 0.2), "green").when(below(80, 0.4), "orange").otherwise("red")


def clamp_price(price: Column) -> Column:
    return F.greatest(F.lit(config.MIN_PRICE), F.least(F.lit(config.MAX_PRICE), price))


def nonneg(price: Column) -> Column:
    return F.greatest(F.lit(0.0), price)


def model_label(name: Column) -> Column:
    """`gpt__4o_mini` -> `GPT.4O Mini`: every letter after a non-letter is a capital."""
    spaced = F.replace(F.replace(F.lower(name), F.lit("__"), F.lit(".")), F.lit("_"), F.lit(" "))
    runs = F.regexp_extract_all(spaced, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.replace(F.array_join(F.transform(runs, F.initcap), ""), F.lit("Gpt"), F.lit("GPT"))


def metrics_text(title: Column, error: Column, ci: Column, mse: Column, r2: Column) -> Column:
    return F.format_string(
        "%s: error=$%,.2f ±$%,.2f mse=%,.0f r²=%.1f%%",
        title, F.bround(error, 2), F.bround(ci, 2), F.bround(mse, 0), F.bround(r2, 1),
    )


def alert_text(description: Column, price: Column, estimate: Column, discount: Column, url: Column) -> Column:
    return F.concat(
        F.lit("Deal Alert! Price="), money(price), F.lit(", Estimate="), money(estimate), F.lit(", Discount="),
        money(discount), F.lit(" :"), F.substring(description, 1, 10), F.lit("... "), url,
    )


def notice_text(text: Column, url: Column) -> Column:
    return F.concat(F.substring(text, 1, 200), F.lit("... "), url)

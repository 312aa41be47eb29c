"""Prompts, chat messages and product cards as column expressions."""

from pyspark.sql import Column, functions as F

from pricelens import config
from pricelens.functions.cleaning import strip_codes
from pricelens.functions.pytext import bind, money, rstrip


def inference_prompt(text: Column) -> Column:
    return F.concat(F.lit(config.PRICE_QUESTION + "\n\n"), text, F.lit("\n\n" + config.PRICE_PREFIX))


def whole_dollars(price: Column) -> Column:
    """Rounded half-even to the dollar, shown with `.00`."""
    return F.concat(F.bround(price, 0).cast("bigint").cast("string"), F.lit(".00"))


def training_prompt(text: Column, price: Column) -> Column:
    return F.concat(inference_prompt(text), whole_dollars(price))


def open_prompt(prompt: Column) -> Column:
    """A training prompt cut after the first price prefix."""
    return F.concat(F.substring_index(prompt, config.PRICE_PREFIX, 1), F.lit(config.PRICE_PREFIX))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def truncate(text: Column, cutoff: int = config.TOKEN_CUTOFF) -> Column:
    """The first `cutoff` white-space tokens, only when there are more; else the text as it is."""
    words = tokens(text)
    return F.when(F.size(words) > cutoff, rstrip(F.array_join(F.slice(words, 1, cutoff), " "))).otherwise(text)


def completion(price: Column, split: Column) -> Column:
    """Rounded for training and validation, the plain price for test."""
    return F.when(split == "test", price.cast("string")).otherwise(whole_dollars(price))


def content_key(full: Column) -> Column:
    return F.substring(F.sha1(full), 1, 16)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def card_messages(text: Column) -> Column:
    return F.array(message("system", F.lit(config.CARD_PROMPT)), message("user", text))


def price_messages(text: Column) -> Column:
    return F.array(message("user", F.concat(F.lit(config.PRICE_INSTRUCTION + "\n\n"), text)))


def training_messages(text: Column, price: Column) -> Column:
    return F.concat(price_messages(text), F.array(message("assistant", money(price))))


def context_text(neighbours: Column) -> Column:
    """Blocks for an ordered array of struct<document, price>."""
    blocks = F.transform(
        neighbours,
        lambda n: F.concat(
            F.lit("Potentially related product:\n"), n["document"], F.lit("\nPrice is "), money(n["price"]), F.lit("\n\n")
        ),
    )
    return F.concat(F.lit(config.CONTEXT_INTRO), F.array_join(blocks, ""))


def context_messages(text: Column, neighbours: Column) -> Column:
    return price_messages(F.concat(text, F.lit("\n\n"), context_text(neighbours)))


def _sentences(texts: Column) -> Column:
    """The first sentence of each text that isn't blank, on one line; a text without an end is one sentence."""
    lines = F.transform(texts, lambda t: F.trim(F.regexp_replace(t, "[\t-\r ]+", " ")))
    sentence = lambda t: F.regexp_extract(t, r"^[^.!?]*[.!?]", 0)
    cut = lambda t: F.when(sentence(t) == "", t).otherwise(sentence(t))
    return F.coalesce(F.transform(F.filter(lines, lambda t: t != ""), cut), F.array().cast("array<string>"))


def summary_card(title: Column, category: Column, description: Column, features: Column, details: Column) -> Column:
    """A five-line product card selected from the columns of a product, without product codes.

    The description is the first sentence of the description, or of the features where there is none; the
    details are that of the next feature, or the first entry of the details behind brand and noise keys. `details`
    is a map as `details_map` makes it. What no column has is `Unknown`.
    """
    noise = ("Brand", *config.NOISE_KEYS)
    entry = lambda e: F.concat(e["key"], F.lit(": "), e["value"]["text"])
    entries = F.transform(F.filter(F.map_entries(details), lambda e: ~e["key"].isin(*noise) & (F.trim(e["value"]["text"]) != "")), entry)

    def lines(found):
        described, featured = found["described"], found["featured"]
        rest = F.when(F.size(described) > 0, featured).otherwise(F.slice(featured, 2, 1))
        return (
            F.coalesce(F.get(described, 0), F.get(featured, 0), F.lit("Unknown")),
            F.coalesce(F.get(rest, 0), F.get(found["entries"], 0), F.lit("Unknown")),
        )

    def card(found):
        about, detail = lines(found)
        brand = F.trim(F.try_element_at(details, F.lit("Brand"))["text"])
        return F.concat_ws(
            "\n",
            F.concat(F.lit("Title: "), F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("Unknown"))),
            F.concat(F.lit("Category: "), F.translate(category, "_", " ")),
            F.concat(F.lit("Brand: "), F.coalesce(F.nullif(brand, F.lit("")), F.lit("Unknown"))),
            F.concat(F.lit("Description: "), about),
            F.concat(F.lit("Details: "), detail),
        )

    found = F.struct(_sentences(description).alias("described"), _sentences(features).alias("featured"), F.coalesce(entries, F.array().cast("array<string>")).alias("entries"))
    return strip_codes(bind(found, card))


def batch_request(ord_: Column, full: Column, model: str = config.BATCH_MODEL) -> Column:
    """One JSON request line."""
    body = F.struct(
        F.lit(model).alias("model"), card_messages(full).alias("messages"), F.lit("low").alias("reasoning_effort")
    )
    return F.to_json(
        F.struct(
            ord_.cast("string").alias("custom_id"),
            F.lit("POST").alias("method"),
            F.lit("/v1/chat/completions").alias("url"),
            body.alias("body"),
        )
    )

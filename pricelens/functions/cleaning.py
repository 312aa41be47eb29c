"""Column expressions that turn a raw product into an item."""

from pyspark.sql import Column, functions as F

from pricelens import config
from pricelens.functions.pytext import bind, json_string, list_literal, spaced_json, strip

# What a text must look like to be read as a decimal number ('12d' would pass a plain cast).
_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"

# Fixed pattern: a token of 7 or more capitals and digits with a capital and a digit between the
# token start and the end of the line. Word edges are spelled out so that the result does not
# depend on how the JDK defines \b; (?d) makes \n the only line end.
PRODUCT_CODE = (
    r"(?d)(?=[A-Z0-9]{7,}(?![\p{L}\p{N}_]))(?<![\p{L}\p{N}_])(?=.*[A-Z])(?=.*\p{Nd})"
    r"[A-Z0-9]+(?![\p{L}\p{N}_])"
)


def number(text: Column) -> Column:
    """The number a text spells, else null."""
    clean = strip(text)
    return F.when(clean.rlike(_NUMBER), F.regexp_replace(clean, "_", "").try_cast("double"))


def in_price_range(price: Column) -> Column:
    return price.between(config.MIN_PRICE, config.MAX_PRICE)


def simplify(values: Column, plain: bool = False) -> Column:
    """Printed list, or a plain text as it is, on one line: one pass of double-space removal, stripped and cut."""
    text = F.replace(values if plain else list_literal(values), F.lit("\n"), F.lit(" "))
    text = F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\t"), F.lit(""))
    text = F.replace(text, F.lit("  "), F.lit(" "))
    return F.substring(strip(text), 1, config.MAX_TEXT_EACH)


def details_map(details: Column) -> Column:
    """Details as a map of key to (text, quoted); null when the JSON is bad.

    The text of a value is as written: numbers keep their digits, objects their key order. `quoted` tells
    a string from other values. Keys keep the order of their first occurrence, and the last value counts.
    """
    given = F.when(F.length(F.coalesce(details, F.lit(""))) > 0, details).otherwise("{}")
    typed, written = F.from_json(given, "map<string,variant>"), F.from_json(given, "map<string,string>")
    quoted = F.transform(F.map_values(typed), lambda v: F.schema_of_variant(v) == "STRING")
    entry = lambda k, text: F.struct(k.alias("key"), text.alias("text"))
    pairs = F.zip_with(F.map_keys(typed), F.map_values(written), entry)
    value = lambda pair, q: F.struct(pair["key"].alias("key"), pair["text"].alias("text"), F.coalesce(q, F.lit(False)).alias("quoted"))
    entries = F.zip_with(pairs, quoted, value)
    keys = F.array_distinct(F.map_keys(typed))
    last = lambda k: bind(
        F.element_at(F.filter(entries, lambda e: e["key"] == k), -1),
        lambda e: F.struct(e["text"].alias("text"), e["quoted"].alias("quoted")),
    )
    return F.map_from_arrays(keys, F.transform(keys, last))


def bad_details(details: Column) -> Column:
    return details_map(details).isNull()


def detail_text(details: Column, key: str) -> Column:
    return F.try_element_at(details, F.lit(key))["text"]


def drop_noise_keys(details: Column) -> Column:
    return F.map_filter(details, lambda k, _: ~k.isin(*config.NOISE_KEYS))


def details_json(details: Column) -> Column:
    """The map as JSON text with `, ` and `: ` separators, inside nested values too, ASCII only."""
    value = lambda v: F.when(v["quoted"], json_string(v["text"])).otherwise(spaced_json(v["text"]))
    entries = F.transform(
        F.map_entries(details),
        lambda e: F.concat(json_string(e["key"]), F.lit(": "), F.coalesce(value(e["value"]), F.lit("null"))),
    )
    return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))


def strip_codes(text: Column) -> Column:
    """Most texts hold no run of seven capitals and digits; a plain scan keeps those off the slow path."""
    return bind(text, lambda t: F.when(t.rlike("[A-Z0-9]{7}"), F.regexp_replace(t, PRODUCT_CODE, "")).otherwise(t))


def scrub(title: Column, description: Column, features: Column, details: Column, plain=None) -> Column:
    """Title, description, features and details (noise keys gone), one per line, without codes.

    `plain` is a struct with a `description` and `features` that came as one text instead of a list.
    """
    line = lambda present, text: F.when(present, F.concat(text, F.lit("\n"))).otherwise("")
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    given = lambda c, name: line(filled(c), simplify(c)) if plain is None else F.when(
        F.length(plain[name]) > 0, F.concat(simplify(plain[name], plain=True), F.lit("\n"))
    ).otherwise(line(filled(c), simplify(c)))
    text = F.concat(
        title,
        F.lit("\n"),
        given(description, "description"),
        given(features, "features"),
        line(filled(details), details_json(details)),
    )
    return F.substring(strip(strip_codes(text)), 1, config.MAX_TEXT_TOTAL)


def weight_pounds(item_weight: Column) -> Column:
    """`2 pounds`, `250 hundredths pounds`, ... in pounds; anything else is 0."""
    parts = F.split(F.coalesce(item_weight, F.lit("")), " ")
    amount = number(F.get(parts, 0))
    unit = F.lower(F.get(parts, 1))
    factors = F.create_map(*[F.lit(x) for pair in config.POUNDS_PER_UNIT.items() for x in pair])
    hundredths = (unit == "hundredths") & (F.lower(F.get(parts, 2)) == "pounds")
    return F.coalesce(
        F.when(hundredths, amount / 100).otherwise(amount * F.try_element_at(factors, unit)), F.lit(0.0)
    )

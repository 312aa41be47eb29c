"""Text primitives whose results must equal those of common scripting-language string rules."""

from pyspark.sql import Column, functions as F

# Every character that counts as white space when a text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Characters a list rendering shows as an escape, and those JSON text escapes.
_UNPRINTABLE = r"[[\p{C}\p{Z}]&&[^ ]]"
_NOT_PLAIN_ASCII = r"[^ -~]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def bind(value: Column, use) -> Column:
    """`use(value)` with `value` computed once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def _hex(code: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(code), digits, "0"))


def _map_chars(text: Column, pattern: str, escape) -> Column:
    """Rewrite the single characters that match."""
    chars = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(pattern), escape(F.ascii(c))).otherwise(c))
    return F.array_join(chars, "")


def quoted(text: Column) -> Column:
    """One list element as it appears in a printed list: quote choice plus escapes."""
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, name in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        body = F.replace(body, F.lit(char), F.lit("\\" + name))
    code_escape = lambda code: (
        F.when(code <= 0xFF, F.concat(F.lit("\\x"), _hex(code, 2)))
        .when(code <= 0xFFFF, F.concat(F.lit("\\u"), _hex(code, 4)))
        .otherwise(F.concat(F.lit("\\U"), _hex(code, 8)))
    )
    printable = lambda b: F.when(b.rlike(_UNPRINTABLE), _map_chars(b, _UNPRINTABLE, code_escape)).otherwise(b)
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    quote = F.when(double, '"').otherwise("'")
    single = lambda b: F.when(double, b).otherwise(F.replace(b, F.lit("'"), F.lit("\\'")))
    return F.concat(quote, bind(bind(body, printable), single), quote)


def list_literal(values: Column) -> Column:
    """A list of texts as printed text: `['a', "b's"]`; a null element prints as None."""
    items = F.transform(values, lambda v: F.coalesce(quoted(v), F.lit("None")))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def json_string(text: Column) -> Column:
    """A JSON string literal in plain ASCII; characters beyond the BMP become surrogate pairs."""
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    body = F.replace(body, F.lit('"'), F.lit('\\"'))
    for char, name in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        body = F.replace(body, F.lit(char), F.lit("\\" + name))
    return F.concat(F.lit('"'), bind(body, json_ascii), F.lit('"'))


def json_ascii(text: Column) -> Column:
    """Escapes for all but plain ASCII; characters beyond the BMP become surrogate pairs."""
    unit = lambda code: F.concat(F.lit("\\u"), _hex(code, 4))
    code_escape = lambda code: F.when(code <= 0xFFFF, unit(code)).otherwise(
        F.concat(
            unit(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)),
            unit(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))),
        )
    )
    return F.when(text.rlike(_NOT_PLAIN_ASCII), _map_chars(text, _NOT_PLAIN_ASCII, code_escape)).otherwise(text)


def spaced_json(text: Column) -> Column:
    """Compact JSON text with a space behind each `,` and `:` that separates, and in plain ASCII."""
    tokens = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"|[,:]|[^",:]+'), 0)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(json_ascii(t))), "")


def money(amount: Column) -> Column:
    """`$` and two decimals; rounded half-even first, since format_string rounds half-up."""
    return F.concat(F.lit("$"), F.format_string("%.2f", F.bround(amount, 2)))

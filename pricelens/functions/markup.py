"""Feed and page markup reduced to text, in Arrow batches where elements have to be matched."""

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

from pricelens.functions.pytext import strip

# Sections by tag and class attribute.
SNIPPET = ("div", "snippet summary")
ARTICLE = ("article", None)
TITLE = ("title", None)
# Elements whose content is no text, and those that never have an end tag.
_NO_TEXT = {"script", "style", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Section(HTMLParser):
    """Text pieces of the first element with a tag and class; without a tag, of everything."""

    def __init__(self, tag, class_):
        super().__init__(convert_charrefs=True)
        self.wanted, self.class_ = tag, class_
        self.depth, self.mute, self.done = 0 if tag else 1, 0, False
        self.pieces = [] if tag is None else None

    def handle_starttag(self, tag, attrs):
        if tag in _NO_TEXT:
            self.mute += 1
        if self.done or tag in _VOID:
            return
        if self.depth:
            self.depth += tag == self.wanted
        elif tag == self.wanted and (self.class_ is None or dict(attrs).get("class") == self.class_):
            self.depth, self.pieces = 1, []

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in _NO_TEXT:
            self.mute = max(0, self.mute - 1)
        if self.depth and tag == self.wanted:
            self.depth -= 1
            self.done = self.done or not self.depth

    def handle_data(self, data):
        if self.depth and not self.mute:
            self.pieces.append(data)


def section_pieces(html: str, tag=None, class_=None):
    """Texts between the tags of a section, references decoded; None if the section is missing."""
    parser = _Section(tag, class_)
    parser.feed(html)
    parser.close()
    return parser.pieces


def _pieces(html: Column, section) -> Column:
    @F.pandas_udf("array<string>")
    def find(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: None if page is None else section_pieces(page, *section))

    return find(html)


def _plain(text: Column) -> Column:
    """A text that may hold escaped markup: read once more, and what still looks like a tag removed."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: None if text is None else "".join(section_pieces(text)))

    return F.regexp_replace(read(text), "<[^<]+?>", "")


def clean_html(html: Column, section=SNIPPET) -> Column:
    """Text of the chosen section on one line; without that section the input on one line."""
    pieces = F.transform(_pieces(html, section), lambda p: strip(p))
    text = F.array_join(F.filter(pieces, lambda p: p != ""), " ")
    return F.replace(F.coalesce(strip(_plain(text)), html), F.lit("\n"), F.lit(" "))


def page_section(html: Column, section=ARTICLE) -> Column:
    """Text of a page section with tags removed and nothing put in their place; empty if missing."""
    return F.coalesce(F.array_join(_pieces(html, section), ""), F.lit(""))


def page_title(html: Column) -> Column:
    return page_section(html, TITLE)


def deal_fields(title: Column, content: Column):
    """Title, details and features of a deal page; features start at the first `Features`."""
    text = F.replace(F.replace(content, F.lit("\nmore"), F.lit("")), F.lit("\n"), F.lit(" "))
    at = F.instr(text, "Features")
    details = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    features = F.when(at > 0, F.substring(text, at + 8, F.lit(500))).otherwise("")
    return [
        F.substring(title, 1, 100).alias("title"),
        F.substring(details, 1, 500).alias("details"),
        features.alias("features"),
    ]


def deal_text(title: Column, details: Column, features: Column, url: Column) -> Column:
    return F.concat(
        F.lit("Title: "), title, F.lit("\nDetails: "), strip(details),
        F.lit("\nFeatures: "), strip(features), F.lit("\nURL: "), url,
    )

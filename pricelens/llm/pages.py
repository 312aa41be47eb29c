"""Main text of web pages by a minimum cut.

A page is read into blocks: the text between two borders of block-level elements, with the elements
around it. A classifier gives each block a cost of being content and a cost of being boilerplate.
These are capacities to the two terminals of a graph. Edges between neighbours in the page and
between neighbours under one parent, stronger the closer they are in the tree, are what it costs to
tear two blocks apart. The minimum cut, found by maximum flow, is the cheapest labelling.

Two things speak for a cost. One is what elements are called: the innermost element around a block that
is known as content or boilerplate, by its tag, or else by a whole word of its class, id or role. It is
worth less than the edges that a block can have, so neighbours may outvote it. The other is how the text
looks, judged by a logistic model, which learns from blocks of a bounded sample of pages whose elements are
known. Text made of links counts against a block wherever it stands.
"""

import html as references
import math
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import arrow_of, batches_of, carried, renamed, schema_of

# Elements and words in class, id and role that say what a part of a page is.
BOILER_TAGS = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "button", "fieldset", "label"}
CONTENT_TAGS = {"article", "main"}
BOILER_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "banner", "billboard", "breadcrumb",
    "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog", "discussion", "disqus", "dropdown", "footer",
    "form", "gdpr", "header", "legal", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "outbrain", "overlay", "pager", "pagination", "popup", "privacy", "promo", "promoted", "promotion", "promotions", "recommended", "related", "replies", "reply", "respond", "search", "share",
    "sharing", "sidebar", "signin", "signup", "skyscraper", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription", "taboola", "teaser", "toolbar", "topbar", "widget",
    "widgets", "alert", "complementary", "disclaimer", "feedback", "rail", "toc", "trending", "warning",
}
CONTENT_NAMES = {"article", "articlebody", "body", "content", "entry", "main", "maincontent", "post", "story", "text"}
# Words that may stand behind a name in the same class (`ad-slot`, `comment-list`), and words in front of one that say
# how or what about, not what a part is (`with-sidebar`, `category-legal`).
ABOUT_WORDS = {
    "author", "cat", "category", "format", "has", "have", "hide", "in", "is", "layout", "no", "not", "off", "on", "show", "tag", "template", "term", "theme", "topic",
    "type", "with", "without",
}
BACK_WORDS = {
    "area", "articles", "bar", "block", "blocks", "box", "button", "buttons", "container", "group", "icon", "icons", "inner", "item", "items", "link", "links", "list",
    "outer", "panel", "posts", "row", "section", "slot", "stories", "unit", "wrap", "wrapper",
}
HIDDEN_TAGS = {"script", "style", "noscript", "template", "head", "title", "textarea", "select", "option", "iframe", "svg", "canvas", "audio", "video", "object", "datalist", "noframes", "noembed"}
RAW_TAGS = {"script", "style", "title", "textarea", "iframe", "noframes", "noembed", "xmp"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE_TAGS = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# An element of these kinds ends an open one of these.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "body", "html", "div", "article", "section", "main"}

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|</?[a-zA-Z][^>]*+>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""",
    re.S,
)
NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SENTENCE = re.compile(r"[.!?…。](?:\s|$)")

# Costs: what a known element and links are worth, the most that looks are worth against a known element, and the
# edges between neighbours in the page and under one parent. A block has two of either kind at the most.
KNOWN, LINKS, LOOKS, NEXT, SIBLING = 2.0, 3.0, 1.75, 0.5, 0.75
# Bounds of the training sample.
SAMPLE_PAGES, SAMPLE_CHARS, SEED = 300, 1 << 17, 9
# The model before it has seen a page: headings, and text in sentences and without links, are content.
START = np.array([-0.7, 0.5, 1.0, -3.0, 0.8, 1.0, -0.5])


@dataclass
class Block:
    text: str
    path: tuple  # numbers of the elements around it, from the root
    known: int  # 1 content, -1 boilerplate, 0 unknown
    tag: str
    linked: int  # characters in links


def _says(token: str) -> int:
    """What a whole class token says: its last word counts, behind those that may follow a name."""
    words = [w.lower() for w in WORDS.findall(token) if not w.isdigit()]
    if not words or not ABOUT_WORDS.isdisjoint(words):
        return 0
    end = len(words)
    while end > 1 and words[end - 1] not in BOILER_NAMES and words[end - 1] in BACK_WORDS | CONTENT_NAMES:
        end -= 1
    if words[end - 1] in BOILER_NAMES:
        # `entry-header` holds the title of an entry.
        return 0 if words[end - 1] == "header" and words[0] in CONTENT_NAMES else -1
    while len(words) > 1 and words[-1] in BACK_WORDS:
        words.pop()
    return int(words[-1] in CONTENT_NAMES and BOILER_NAMES.isdisjoint(words))


def kind_of(tag: str, rest: str) -> int:
    if tag in CONTENT_TAGS:
        return 1
    if tag in BOILER_TAGS:
        return -1
    if "=" not in rest or tag in ("body", "html"):
        return 0
    tokens = [t for m in NAMED.finditer(rest) for t in (m[1] or m[2] or m[3] or "").split()]
    said = [_says(t) for t in tokens]
    return -1 if -1 in said else max(said, default=0)


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    found: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = []  # tag, number, kind, hidden
    texts: list[str] = []
    state = [0, 0]  # characters in links of the current block; elements so far

    def close():
        if texts:
            text = " ".join(references.unescape("".join(texts)).split())
            if text:
                found.append(Block(text, tuple(e[1] for e in stack if e[0] not in INLINE_TAGS), _known(stack), _tag(stack), state[0]))
            texts.clear()
        state[0] = 0

    def pop_to(index):
        if any(e[0] not in INLINE_TAGS for e in stack[index:]):
            close()
        del stack[index:]

    at = 0
    length = len(page)
    while at < length:
        m = TAG.search(page, at)
        stop = m.start() if m else length
        if stop > at and not (stack and stack[-1][3]):
            texts.append(page[at:stop])
            if any(e[0] == "a" for e in stack):
                state[0] += stop - at
        if not m:
            break
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
                # An inline end tag doesn't reach over a block.
                if name in INLINE_TAGS and stack[i][0] not in INLINE_TAGS:
                    break
            else:
                if name not in INLINE_TAGS and not (stack and stack[-1][3]):
                    close()
            continue
        if name == "br" or name == "wbr":
            texts.append(" " if name == "br" else "")
            continue
        if name in VOID_TAGS:
            if name not in INLINE_TAGS and not (stack and stack[-1][3]):
                close()
            continue
        if name not in INLINE_TAGS and not (stack and stack[-1][3]):
            _imply_ends(name, stack, pop_to)
            close()
        hidden = bool(stack and stack[-1][3]) or name in HIDDEN_TAGS
        if name in RAW_TAGS:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else length
            continue
        if name == "body" and hidden:  # a head that was never closed
            stack[:] = [e for e in stack if not e[3]]
            hidden = False
        if not m["rest"].endswith("/") or name not in ("svg", "path"):
            state[1] += 1
            stack.append((name, state[1], kind_of(name, m["rest"]), hidden))
    close()
    return found


def _imply_ends(name, stack, pop_to):
    ended = ENDS.get(name, ())
    for i in range(len(stack) - 1, -1, -1):
        tag = stack[i][0]
        if tag == "p" or tag in ended:
            pop_to(i)
            if tag == "p":
                continue
            return
        if tag in SCOPES:
            return


def _tag(stack):
    return next((e[0] for e in reversed(stack) if e[0] not in INLINE_TAGS), "")


def _known(stack) -> int:
    for i in range(len(stack) - 1, -1, -1):
        tag, _, kind, _ = stack[i]
        if kind:
            # The title of an article may stand in a header of its own.
            if tag == "header" and _tag(stack) in HEADINGS and any(e[0] == "article" for e in stack[:i]):
                continue
            return kind
    return 0


def looks(block: Block):
    """What a block looks like, whatever its elements are called."""
    n = len(block.text)
    words = block.text.count(" ") + 1
    return (
        1.0, math.log1p(words) - 2.0, min(len(SENTENCE.findall(block.text)), 3) / 1.5, min(1.0, block.linked / max(n, 1)),
        float(block.tag == "p"), float(block.tag in HEADINGS), float(block.tag in ("li", "td", "th", "dt", "dd")),
    )


def train(pages: list[str], seed=SEED):
    """Weights of `looks`: logistic regression on blocks of known elements, drawn towards START."""
    rows = [(looks(b), b.known) for page in sorted(pages) for b in blocks(page) if b.known]
    x, y = np.array([r for r, _ in rows]).reshape(-1, len(START)), np.array([k > 0 for _, k in rows], float)
    weights = START.copy()
    if not len(y) or y.min() == y.max():
        return weights
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(300):
        wrong = 1 / (1 + np.exp(-(x @ weights))) - y
        weights -= 0.5 * (x.T @ (wrong * balance) / len(y) + 0.1 * (weights - START))
    return weights


def _edges(found: list[Block]):
    """Neighbours in the page and under one parent, with what it costs to tear them apart."""
    last: dict = {}
    for i, block in enumerate(found):
        if i:
            shared = 0
            before = found[i - 1].path
            for a, b in zip(before, block.path):
                if a != b:
                    break
                shared += 1
            yield i - 1, i, NEXT / (1 + len(before) + len(block.path) - 2 * shared)
        parent = block.path[:-1]
        if parent in last:
            yield last[parent], i, SIBLING
        last[parent] = i


def label(found: list[Block], weights) -> list[bool]:
    """Whether each block is content: the source side of the minimum cut."""
    if not found:
        return []
    return cut(costs(found, weights), list(_edges(found)))


def costs(found: list[Block], weights) -> list[float]:
    """What each block is worth as content: its name, its looks and, but for headings, what it has of links."""
    looked = np.array([looks(b) for b in found]) @ weights
    out = []
    for block, look in zip(found, looked.tolist()):
        most = LOOKS if block.known else 3.0
        linked = 0.0 if block.tag in HEADINGS else min(1.0, block.linked / len(block.text))
        out.append(KNOWN * block.known + min(max(look, -most), most) - LINKS * max(0.0, 2 * linked - 1))
    return out


def cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: a positive cost ties a node to content, a negative one to boilerplate.

    A node tied more strongly than all its edges together keeps its side in every minimum cut; its edges
    then tie its neighbours. Only what stays open goes through maximum flow.
    """
    near: list[dict[int, float]] = [{} for _ in cost]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    tie, side = list(cost), [None] * len(cost)
    waiting = deque(range(len(cost)))
    while waiting:
        i = waiting.popleft()
        if side[i] is None and abs(tie[i]) >= sum(near[i].values()):
            side[i] = tie[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                tie[j] += w if side[i] else -w
                waiting.append(j)
            near[i] = {}
    rest = [i for i, s in enumerate(side) if s is None]
    if rest:
        reached = _source_side({i: tie[i] for i in rest}, {i: dict(near[i]) for i in rest})
        for i in rest:
            side[i] = i in reached
    return side


def _source_side(tie: dict[int, float], room: dict[int, dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow along shortest paths."""
    supply = {i: t for i, t in tie.items() if t > 0}
    demand = {i: -t for i, t in tie.items() if t < 0}
    tiny = 1e-9
    while True:
        level = {i: 0 for i, s in supply.items() if s > tiny}
        waiting = deque(level)
        ends = False
        while waiting:
            i = waiting.popleft()
            ends = ends or demand.get(i, 0) > tiny
            for j, r in room[i].items():
                if r > tiny and j not in level:
                    level[j] = level[i] + 1
                    waiting.append(j)
        if not ends:
            return set(level)
        untried = {i: list(room[i]) for i in level}
        for start in [i for i in level if not level[i]]:
            path = [start]
            while path and supply[start] > tiny:
                i = path[-1]
                if demand.get(i, 0) > tiny:
                    flow = min([supply[start], demand[i], *(room[a][b] for a, b in zip(path, path[1:]))])
                    supply[start] -= flow
                    demand[i] -= flow
                    for a, b in zip(path, path[1:]):
                        room[a][b] -= flow
                        room[b][a] = room[b].get(a, 0.0) + flow
                    path = [start]
                    continue
                while untried[i]:
                    j = untried[i][-1]
                    if room[i].get(j, 0) > tiny and level.get(j) == level[i] + 1:
                        path.append(j)
                        break
                    untried[i].pop()
                else:
                    path.pop()
                    if path:
                        untried[path[-1]].pop()


def main_text(page: str | None, weights) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, content in zip(found, label(found, weights)) if content)


def fit(pages: DataFrame, *, html="html", key="page_id"):
    """Weights from a bounded sample: of all pages the ones with the smallest hashes of the key, none too long."""
    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).where(F.length("html").between(1, SAMPLE_CHARS))
    total = rows.count()
    if not total:
        return train([])
    mark = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    near = rows.withColumn("mark", mark).where(F.col("mark") < min(1 << 30, (4 * SAMPLE_PAGES << 30) // total))
    return train([r.html for r in near.orderBy("mark", "key").limit(SAMPLE_PAGES).collect()])


def extract(pages: DataFrame, *, html="html", key="page_id", carry=("url",)) -> DataFrame:
    """`key`, the columns `carry`, `text` and `n_chars` of every row, on the map side.

    Null, empty and textless pages have an empty text. Broken markup is read as far as it can be; pages
    are read whole, however long. Repeated rows are read each, an empty table gives no rows, and other
    columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, html=html, key=key))
    rows, held = carried(pages, html, (key, *carry))

    def run(batches):
        for batch in batches_of(batches, "_text", 16 << 20):
            texts = [main_text(p, shared.value) for p in batch.column("_text").to_pylist()]
            yield arrow_of(batch, held, {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return renamed(rows.mapInArrow(run, schema_of(held, "text string, n_chars long")), held, "text", "n_chars")

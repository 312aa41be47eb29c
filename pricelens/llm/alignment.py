"""Alignment of two tokenizations of the same text by their common byte offsets.

Both tokenizations of a text give ascending lists of byte offsets where a token ends. The shorter list
drives a galloping search into the longer one: from the place of the one before, steps double until the
wanted offset is passed, and a binary search ends in the last step. Blocks of wanted offsets do so
together. Offsets found in both lists cut the tokens into groups, the differences of their ranks give how
many tokens of either side overlap in a group, and the pair of tokens that end there is a link.

Neither tokenizer joins characters across a border between a character that is no white space and a
following space or line feed, so chunks between such borders are tokenized, aligned and remembered once
by each worker, and a text adds up its chunks. `check_vocabularies` raises for others.

Linked tokens end together, so the bytes of one are the end of the other's. All pairs of ids of which that
holds follow from the vocabularies (324,300 for the files of the query, whatever the corpus). A link is the
number of its pair in that list; links are kept compressed with their text, each task counts them in an
array as long as the list, and the counts of the whole corpus, no longer either, go to every task.
"""

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import batches_of, materialize, once

# A chunk starts at a space or line feed behind other than white space; every text gets a space in front.
# Fixed value: the pattern by which byte-level vocabularies of this kind cut texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
# Wanted offsets that gallop together; bounds of a worker's cache, in chunks, and of the chunks it keeps, in characters.
BLOCK, CACHE_ROWS, CACHE_CHARS = 4096, 1 << 18, 64
# Chunks tokenized one behind the other.
TOGETHER = 4096
# Bytes of texts handled at once.
BATCH_BYTES = 2 << 20


def galloping(wanted, ends):
    """For each of the ascending `wanted` its place in the ascending `ends`: the first end that is not less."""
    places = np.empty(len(wanted), np.int64)
    start = 0
    for at in range(0, len(wanted), BLOCK):
        part = wanted[at: at + BLOCK]
        low, high = np.full(len(part), start), np.full(len(part), start)
        step, open_ = 1, np.arange(len(part))
        while len(open_):  # ends[low - 1] < wanted; high is where the next step looks
            short = ends[np.minimum(high[open_], len(ends) - 1)] < part[open_]
            open_ = open_[short & (high[open_] < len(ends))]
            low[open_] = high[open_] + 1
            high[open_] += step
            step *= 2
        np.minimum(high, len(ends), out=high)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            less = ends[middle] < part[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        places[at: at + len(part)] = low
        start = int(low[-1])
    return places


def common(a, b):
    """Positions in `a` and in `b` of the values that both ascending lists hold."""
    if len(a) > len(b):
        y, x = common(b, a)
        return x, y
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = galloping(a, b)
    inside = np.flatnonzero(places < len(b))
    inside = inside[b[places[inside]] == a[inside]]
    return inside, places[inside]


def groups(a_ids, a_ends, b_ids, b_ends):
    """`(ids of A, ids of B, first byte, byte behind)` of each group of one text, and its links."""
    x, y = common(np.asarray(a_ends), np.asarray(b_ends))
    out, i, j, begin = [], 0, 0, 0
    for p, q in zip((x + 1).tolist(), (y + 1).tolist()):  # the rank differences are p - i and q - j
        out.append((list(a_ids[i:p]), list(b_ids[j:q]), begin, int(a_ends[p - 1])))
        i, j, begin = p, q, int(a_ends[p - 1])
    return out, [(int(a_ids[p]), int(b_ids[q])) for p, q in zip(x, y)]


def _byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece: U+2581 is a space, <0xHH> a byte."""
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode("utf-8")


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, all pairs that can be linked, and the chunks that this worker remembers."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            model = json.load(file)
        of = _byte_level()
        ranks = {bytes(of[c] for c in token): i for token, i in model["model"]["vocab"].items() if all(c in of for c in token)}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        check_vocabularies(model, ranks, pieces)
        # A file whose ids are the ranks of its merges can be run by the faster of the libraries.
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [piece_bytes(p) for p in pieces]
        self.size_a, self.size_b = (np.array([len(t) for t in v]) for v in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        # Every id as text with what may follow it: for A within a group and at its end, for B also at the end of a chunk.
        self.texts = [b"%d%s" % (i, then) for v, marks in ((self.bytes_a, b",|"), (self.bytes_b, b",;.")) for then in (bytes([m]).strip(b".") for m in marks) for i in range(len(v))]
        self.pairs = self.possible_pairs()
        self.young, self.old = {}, {}

    def possible_pairs(self):
        """`A id * size of B + B id` of all pairs of which one's bytes end the other's, ascending."""
        spelled_a, spelled_b = {}, {}
        for spelled, tokens in ((spelled_a, self.bytes_a), (spelled_b, self.bytes_b)):
            for i, t in enumerate(tokens):
                spelled.setdefault(t, []).append(i)
        ends = lambda t, others, first: (x for i in range(first, len(t)) for x in others.get(t[i:], ()))
        size = len(self.bytes_b)
        codes = [a * size + b for t, own in spelled_a.items() for b in ends(t, spelled_b, 0) for a in own]
        codes += [a * size + b for t, own in spelled_b.items() for a in ends(t, spelled_a, 1) for b in own]
        return np.unique(np.array(codes, np.int64))

    def aligned(self, chunks: list[str]):
        """For each chunk: ids of its groups as text, tokens of A and of B, links; an empty tuple where the bytes differ.

        Chunks are tokenized one behind the other, but for those with white space at their end, which could
        join the next one. If the bytes of all are not given back, either half is looked at on its own.
        """
        joined = [i for i, c in enumerate(chunks) if not c[-1].isspace()]
        parts = [[i] for i, c in enumerate(chunks) if c[-1].isspace()]
        parts += [joined[at: at + TOGETHER] for at in range(0, len(joined), TOGETHER)]
        out = [()] * len(chunks)
        while parts:
            part = parts.pop()
            found = self._aligned([chunks[i] for i in part])
            if found is not None:
                for i, f in zip(part, found):
                    out[i] = f
            elif len(part) > 1:
                parts += [part[: len(part) // 2], part[len(part) // 2:]]
        return out

    def _aligned(self, chunks: list[str]):
        text = "".join(chunks)
        # The processor puts a space in front, which stands for the first one of a text that begins with a space.
        b = self.b.encode(text[1:] if text[0] == " " else text, num_threads=1)
        b = (b or [self.space]) if text[0] == " " else b[1:]
        a = self.a.encode_ordinary(text)
        whole = text.encode("utf-8", "surrogatepass")
        if not b"".join([self.bytes_a[i] for i in a]) == whole == b"".join([self.bytes_b[i] for i in b]):
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        x, y = common(ends_a, ends_b)
        sizes = [len(c) for c in chunks] if text.isascii() else [len(c.encode("utf-8", "surrogatepass")) for c in chunks]
        # Chunks end where tokens of both end: the last token of either, and the last group, of each.
        last = np.searchsorted(ends_a[x], np.cumsum(sizes))
        links = np.searchsorted(self.pairs, a[x] * len(self.bytes_b) + b[y]).astype("<u4").tobytes()
        # Ids with what follows them, in the order of groups; ranks in one list add to places in the other.
        of_a, of_b = np.searchsorted(x, np.arange(len(a))), np.searchsorted(y, np.arange(len(b)))
        then_a, then_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        then_a[x], then_b[y] = 1, 1
        then_b[y[last]] = 2
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.r_[0, y + 1][of_a]] = a + then_a * len(self.bytes_a)
        order[np.arange(len(b)) + x[of_b] + 1] = 2 * len(self.bytes_a) + b + then_b * len(self.bytes_b)
        texts = [self.texts[i] for i in order.tolist()]
        last_a, last_b, links_to = (x[last] + 1).tolist(), (y[last] + 1).tolist(), (4 * last + 4).tolist()
        found, i, j, k = [], 0, 0, 0
        for p, q, r in zip(last_a, last_b, links_to):
            found.append((b"".join(texts[i + j: p + q]), p - i, q - j, links[k:r]))
            i, j, k = p, q, r
        return found

    def look_up(self, chunks) -> dict:
        """What is known of these distinct chunks. What is asked for again stays in the cache; long chunks never do."""
        known, missing = {}, []
        for c in chunks:
            found = self.young.get(c)
            if found is None:
                found = self.old.get(c)
                if found is None:
                    missing.append(c)
                    continue
                self.young[c] = found
            known[c] = found
        new = dict(zip(missing, self.aligned(missing))) if missing else {}
        self.young.update((c, v) for c, v in new.items() if len(c) <= CACHE_CHARS)
        if len(self.young) > CACHE_ROWS // 2:
            self.young, self.old = {}, self.young
        return known | new


def check_vocabularies(model, ranks, pieces) -> None:
    """Raise where chunks can't be tokenized each on its own, or ids are not the ranks of their merges."""
    kind = model["pre_tokenizer"] or {}
    if kind.get("type") != "ByteLevel" or model.get("normalizer") or not kind.get("use_regex", True) or kind.get("add_prefix_space"):
        raise ValueError("the first tokenizer must be byte-level, split by its own pattern, without a normalizer")
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["model"]["merges"]]
    vocabulary = model["model"]["vocab"]
    if len(ranks) - len(merged) != 256 or [vocabulary[m] for m in merged] != list(range(256, 256 + len(merged))):
        raise ValueError("ids of the first tokenizer don't follow its merges")
    for t in ranks:  # parts of characters can't be white space of one byte
        if re.search(r"\S[ \n]", t.decode("utf-8", "ignore")):
            raise ValueError(f"token {t!r} crosses chunks")
    for p in pieces:
        if "\n" in p or "▁" in p.lstrip("▁"):
            raise ValueError(f"piece {p!r} crosses chunks")


@once
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def chunks_of(text: str | None) -> list[str]:
    """Chunks of the text with a space in front; none for a text that is empty or can't be given back."""
    return CHUNK.findall(" " + text) if text and "▁" not in text else []


def tokenized(docs: DataFrame, path_a: str, path_b: str, *, text="text", key="doc_id", with_groups=False) -> DataFrame:
    """`key, n_a, n_b, n_links, links, groups_sha256` and, if asked for, `groups` of every row.

    `links` are the numbers of the pairs, as compressed 32-bit numbers.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = ["key", "n_a", "n_b", "n_links", "links", "groups_sha256"] + ["groups"] * with_groups

    def run(batches):
        own, pack = tokenizers(path_a, path_b), zstandard.ZstdCompressor(level=1)
        for batch in batches_of(batches, "text", BATCH_BYTES):
            split = [chunks_of(t) for t in batch.column("text").to_pylist()]
            known = own.look_up(dict.fromkeys(c for chunks in split for c in chunks))
            odd = {c for c, v in known.items() if not v}
            counts, links, digests, groups = [], [], [], []
            for chunks in split:
                if not chunks or odd and not odd.isdisjoint(chunks):
                    n_a, n_b, linked, whole = 0, 0, b"", b""
                else:
                    whole, n_a, n_b, linked = zip(*[known[c] for c in chunks])
                    n_a, n_b, linked, whole = sum(n_a), sum(n_b), b"".join(linked), b";".join(whole)
                counts.append((n_a, n_b, len(linked) // 4))
                links.append(pack.compress(linked))
                digests.append(hashlib.sha256(whole).hexdigest() if whole else "")
                groups.append(whole if with_groups else None)
            columns = [batch.column("key"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(links, pa.binary()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(groups, pa.binary()).cast(pa.string())] * with_groups, names)

    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_a long, n_b long, n_links long, links binary, groups_sha256 string" + ", groups string" * with_groups
    return rows.mapInArrow(run, schema)


def unpacked(links: bytes):
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(links), "<u4")


def pair_counts(found: DataFrame, pairs: int) -> DataFrame:
    """`pair, n`: how many links of the whole corpus hold each of the `pairs` possible pairs; those that none holds are left out."""

    def run(batches):
        counts = np.zeros(pairs, np.int64)
        for batch in batches:
            for links in batch.column("links").to_pylist():
                counts += np.bincount(unpacked(links), minlength=pairs) if len(links) > pairs else 0
                if len(links) <= pairs:
                    np.add.at(counts, unpacked(links), 1)
        held = np.flatnonzero(counts)
        for start in range(0, len(held), 1 << 16):
            part = held[start: start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], ["pair", "n"])

    return found.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def best_of(codes, counts, size_b: int):
    """Whether each pair's count is the highest of its B id."""
    most = np.zeros(size_b, np.int64)
    np.maximum.at(most, codes % size_b, counts)
    return counts == most[codes % size_b]


def align(docs: DataFrame, path_a: str, path_b: str, *, text="text", key="doc_id", with_groups=False) -> DataFrame:
    """`key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256` and, if asked for, `groups` of every row.

    A is a byte-level BPE file of `tokenizers`, which gets a space and the text, B a sentencepiece model
    with byte fallback, which gets the text; special strings in texts are plain text. `groups` is
    `a1,a2|b1;a3|b2,b3`, the ids between offsets where tokens of both end. A link is a pair of tokens that
    end together; its count is how many links of all rows hold the same two ids. Null and empty texts, and
    those whose tokens don't give back the bytes (U+2581 in a text, say), have zeros and ''. Repeated rows
    are counted each; a null key stays null; other columns are not read; an empty table gives no rows.
    """
    own = tokenizers(path_a, path_b)
    found = materialize(tokenized(docs, path_a, path_b, text=text, key=key, with_groups=with_groups), "alignment")
    counted = pair_counts(found, len(own.pairs)).toArrow()  # 16 bytes for each possible pair at the most
    counts = np.zeros(len(own.pairs), np.int64)
    counts[counted.column("pair").to_numpy()] = counted.column("n").to_numpy()
    table = docs.sparkSession.sparkContext.broadcast((counts, best_of(own.pairs, counts, len(own.bytes_b)) & (counts > 0)))
    kept = ["key", "n_a", "n_b", "n_links", "groups_sha256"] + ["groups"] * with_groups
    schema = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in kept) + ", n_best long, count_sum long"

    def run(batches):
        counts, best = table.value
        for batch in batches:
            links = [unpacked(x) for x in batch.column("links").to_pylist()]
            sums = [pa.array([int(of[x].sum()) for x in links], pa.int64()) for of in (best, counts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *sums], [*kept, "n_best", "count_sum"])

    # Every common offset ends one group and is one link.
    out = found.mapInArrow(run, schema).withColumn("n_groups", F.col("n_links"))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * with_groups
    return out.select(F.col("key").alias(key), *columns)

"""Best-fit packing with certified bin counts.

Pieces of documents are spread over bounded partitions, and each is packed by best-fit decreasing.
Dual feasible functions give a lower bound of the bins that its pieces need. Where a partition's
bins are more than the bound, or the sum over partitions is more than the bound over all pieces,
the documents of bins with room left are exchanged: they meet those of other partitions and are
packed again, until the total is certified, a single partition has held all that was left, or an
exchange has closed the bins of less than half of its pieces.
"""

import json
import os
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import batches_of, materialize, once

# Pieces packed in one task.
PARTITION_PIECES = 1 << 16
# A bin with more room than this is open: its pieces are exchanged.
OPEN_SHARE = 1 / 256
# Runs of anything but ASCII white space; the tokenizer drops white space and joins nothing across it.
CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")
# Texts of ASCII and Latin-1 letters only; these the tokenizer's normaliser merely lower-cases.
PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*+")
# How the tokenizer of this vocabulary divides a text, and the same for plain texts in lower case.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9ß-öø-ÿ]+")
# Entries of either half of a cache, and the longest key it keeps.
CACHE_ROWS, CACHE_CHARS = 1 << 18, 64


class Halves:
    """A cache of bounded size: when the young half is full it becomes the old one, and what is used again moves back."""

    def __init__(self, rows=CACHE_ROWS):
        self.young, self.old, self.rows = {}, {}, rows

    def missing(self, keys: set) -> set:
        """Those of `keys` that neither half has; the others are in the young half then."""
        absent = keys.difference(self.young)
        back = [k for k in absent if k in self.old]
        self.young.update((k, self.old[k]) for k in back)
        return absent.difference(back)

    def turn(self, new):
        """After use: forget the long ones among the new keys, and age a full half."""
        for key in new:
            if len(key) > CACHE_CHARS:
                del self.young[key]
        if len(self.young) > self.rows:
            self.young, self.old = {}, self.young


@once
def encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@once
def _plain(path: str) -> bool:
    """Whether plain chunks may be lower-cased and divided here, in front of the tokenizer."""
    stages = json.loads(encoder(path).to_str())
    steps = (stages["normalizer"] or {}).get("normalizers", [])
    cuts = (stages["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    return [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern") == {"Regex": PATTERN}


@once
def _added(path: str):
    """Finds the added tokens, which the tokenizer takes out of a text before anything else."""
    added = [t.content for t in encoder(path).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, added)) or "(?!)")


@once
def _caches(path: str) -> tuple[Halves, Halves]:
    """Ids of the parts of plain texts, and of the chunks of others."""
    return Halves(), Halves(CACHE_ROWS // 8)


def token_bytes(path: str, texts: list[str], end_id: int) -> list[bytes]:
    """Ids of each text and the end id, as little-endian unsigned 32-bit numbers.

    A plain text is divided here as the tokenizer divides it, and the ids of each part are asked for
    once. Of other texts the ids are asked for once per chunk between white space, which separates
    tokens and is dropped.
    """
    parts_of, chunks_of = _caches(path)
    added, plain = _added(path), _plain(path)
    end = struct.pack("<I", end_id)
    simple = [plain and PLAIN.fullmatch(t) is not None and not added.search(t) for t in texts]
    split = [PARTS.findall(t.lower()) if s else CHUNK.findall(t) for s, t in zip(simple, texts)]
    new = parts_of.missing(set(chain.from_iterable(x for s, x in zip(simple, split) if s)))
    parts_of.young.update(_ids_of_words(path, sorted(new)))
    odd = chunks_of.missing(set(chain.from_iterable(x for s, x in zip(simple, split) if not s)))
    encode = encoder(path).encode
    chunks_of.young.update((c, np.array(encode(c, add_special_tokens=False).ids, "<u4").tobytes()) for c in odd)
    of_part, of_chunk = parts_of.young.__getitem__, chunks_of.young.__getitem__
    out = [b"".join(map(of_part if s else of_chunk, x)) + end for s, x in zip(simple, split)]
    parts_of.turn(new)
    chunks_of.turn(odd)
    return out


def _ids_of_words(path: str, words: list[str]):
    """Ids of each part; between spaces, each is a word of its own to the tokenizer."""
    for start in range(0, len(words), 1 << 12):
        some = words[start: start + (1 << 12)]
        encoded = encoder(path).encode(" ".join(some), add_special_tokens=False)
        ids, numbers = np.array(encoded.ids, "<u4").tobytes(), np.array(encoded.word_ids)
        ends = np.searchsorted(numbers, np.arange(len(some) + 1)).tolist()
        for word, a, b in zip(some, ends, ends[1:]):
            yield word, ids[4 * a: 4 * b]


PIECE_COLUMNS = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, *, text="text", key="doc_id", limit=4096, end_id=1) -> DataFrame:
    """`id, piece, start, length, ids_crc32` of each piece of at most `limit` tokens; only longer documents are cut."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    key_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches_of(batches, "text", 4 << 20):
            owner, cut = [], []
            for i, ids in enumerate(token_bytes(path, [t or "" for t in batch.column("text").to_pylist()], end_id)):
                count = len(ids) // 4
                for n, start in enumerate(range(0, count, limit)):
                    part = ids[4 * start: 4 * (start + limit)]
                    owner.append(i)
                    cut.append((n, start, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*cut))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(owner)), pa.array(columns[0], pa.int32()),
                    *(pa.array(c, pa.int64()) for c in columns[1:]),
                ],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(run, f"id {key_type}, {PIECE_COLUMNS}")


def best_fit(sizes, capacity: int):
    """Bin and offset of each size by best-fit decreasing, and the room left in each bin.

    Open bins are stacked by their room; a bit set over rooms gives the least one that fits.
    """
    bins, offsets, room = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = some >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = stacks[left].pop()
            if not stacks[left]:
                some ^= 1 << left
        else:
            left, b = capacity, len(room)
            room.append(0)
        bins[i], offsets[i], room[b] = b, capacity - left, left - size
        if left > size:
            stacks[left - size].append(b)
            some |= 1 << (left - size)
    return bins, offsets, np.array(room, np.int64)


def lower_bound(counts, capacity: int) -> int:
    """Bins that pieces need at least; `counts[s]` of size s.

    Two families of dual feasible functions: one lifts sizes over capacity - e to a whole bin and drops
    those under e, the other rounds multiples of 1 / (k + 1). Each keeps any full bin within one.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    counts = np.asarray(counts, np.int64)
    mass = np.r_[0, np.cumsum(counts * size)]
    number = np.r_[0, np.cumsum(counts)]
    e = np.arange(1, capacity // 2 + 1)
    lifted = (number[-1] - number[capacity - e + 1]) * capacity + (mass[capacity - e + 1] - mass[e])
    best = max(int(-(-mass[-1] // capacity)), int((-(-lifted // capacity)).max(initial=0)))
    for k in range(1, 64):
        whole = (k + 1) * size % capacity == 0
        # In units of 1 / (k * capacity), which keeps the arithmetic exact.
        value = np.where(whole, k * size, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def pack(items: DataFrame, capacity: int, *, partition_pieces=PARTITION_PIECES) -> DataFrame:
    """`items` (id, piece, start, length, ids_crc32) with `sequence_id, offset`: gapless sequences of at most `capacity`.

    An empty table gives no sequences. The largest task packs about `partition_pieces` pieces; rows are
    dealt out by their position, so no key, however frequent, makes a partition larger.
    """
    histogram = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[r.length] = r["count"]
    wanted, left = lower_bound(histogram, capacity), int(histogram.sum())
    done, settled, turn, current = [], 0, 0, items
    while True:
        parts = max(1, -(-left // partition_pieces))
        packed = materialize(_pack_once(current, capacity, parts, turn), f"packing-{turn}")
        closed = packed.where(~F.col("open"))
        totals = packed.groupBy("part", "open").agg(
            F.count_distinct("sequence_id").alias("bins"), F.count(F.lit(1)).alias("n"), F.first("bound").alias("bound")
        ).groupBy("open").agg(F.sum("bins").alias("bins"), F.sum("n").alias("n")).collect()
        bins = {r.open: r.bins for r in totals}
        left = sum(r.n for r in totals if r.open)
        if parts == 1 or settled + sum(bins.values()) <= wanted or turn and left > before / 2:
            done.append(packed)
            break
        done.append(closed)
        settled += bins.get(False, 0)
        before, turn = left, turn + 1
        current = packed.where("open").select(items.columns)
        if not left:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*items.columns, "sequence_id", "offset")


def _pack_once(items: DataFrame, capacity: int, parts: int, turn: int) -> DataFrame:
    """Each partition packed on its own; `open` marks pieces of bins with room in a partition that may be improved."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields]
    # The stored table is read in the same order at each try, so a repeated task deals out alike.
    dealt = items.withColumn("part", (F.monotonically_increasing_id() % parts).cast("int"))
    schema = ", ".join([*fields, "part int", "sequence_id long", "offset long", "open boolean", "bound int"])

    def run(frame):
        sizes = frame["length"].to_numpy()
        bins, offsets, room = best_fit(sizes, capacity)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        part = int(frame["part"].iat[0])
        return frame.assign(
            sequence_id=(turn << 56) + (part << 24) + bins, offset=offsets, open=room[bins] > capacity * OPEN_SHARE, bound=bound
        )

    return dealt.groupBy("part").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, *, text="text", key="doc_id", limit=4096, end_id=1) -> DataFrame:
    """One row per piece: `key, piece, start, length, ids_crc32, sequence_id, offset`.

    Null and empty texts are the end token alone. Repeated rows are packed each; other columns are not read.
    """
    cut = materialize(pieces(docs, path, text=text, key=key, limit=limit, end_id=end_id), "packing-pieces")
    return pack(cut, limit).withColumnRenamed("id", key)

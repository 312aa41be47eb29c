"""Line deduplication by ranges of hashes, answered with bitmaps instead of texts.

Of each document every distinct line key sends one narrow row: 128 bits of hash, the document and the
places of its lines. Rows are range-partitioned by hash and document, so a line that a third of all
documents share is dealt to as many tasks as it needs, and sorted by hash, then document (largest
first), then text. A task streams over its range: the first document of a hash keeps its lines, those of
the others go once a third document has been seen.

A hash may go on in the next range. Only the first and the last hash of a task can; of these the task
sends a summary, and what the summaries of all tasks have to settle stays open until they are added up.

The result is one compressed bitmap of kept lines for each document that loses some. Texts are read
again to apply it, and are shuffled only where the bitmaps are too large to be broadcast.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import batches_of, materialize

LEAST_CHARS, LEAST_DOCUMENTS = 20, 3
# Bytes of all bitmaps with their keys up to which they are sent to every task.
BROADCAST_BYTES = 32 << 20
# Rows of a streamed partition: lines that go, lines left open, and summaries of the outer hashes.
GOES, OPEN, SUMMARY = 0, 1, 2
_NULL_KEY = -(1 << 63)
ROW = "high long, low long, doc long, crc long, places binary"


def line_key(line: bytes) -> bytes | None:
    """What lines are compared by; None where it has too few code points."""
    key = line.strip().lower()
    if len(key) < LEAST_CHARS:
        return None
    if key.isascii() or len(key) >= 4 * LEAST_CHARS:
        return key
    return key if len(key.decode("utf-8", "replace")) >= LEAST_CHARS else None


def places(text: bytes) -> dict[bytes, list[int]]:
    """The places of the lines of each key, by its hash."""
    found = {}
    for i, line in enumerate(text.split(b"\n")):
        key = line_key(line) if len(line) >= LEAST_CHARS else None
        if key is not None:
            found.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
    return found


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL_KEY)).alias("doc"), F.crc32(whole).alias("crc"), whole.cast("binary").alias("text"))


def line_rows(docs: DataFrame, *, text="text", key="doc_id") -> DataFrame:
    """`high, low, doc, crc, places` of every distinct line key of every document."""

    def run(batches):
        for batch in batches_of(batches, "text", 4 << 20):
            hashes, at, held = [], [], []
            for i, value in enumerate(batch.column("text").to_pylist()):
                found = places(value)
                hashes.extend(found)
                at.extend([i] * len(found))
                held.extend(np.array(x, "<u4").tobytes() for x in found.values())
            halves = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            own = batch.select(["doc", "crc"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), own.column("doc"), own.column("crc"), pa.array(held, pa.binary())], ["high", "low", "doc", "crc", "places"])

    return _rows(docs, text, key).mapInArrow(run, ROW)


def stream(batches, least=LEAST_DOCUMENTS):
    """Decisions on the rows of one sorted range, with the memory of one batch and of one document's lines.

    What is held from batch to batch is the last hash: its number of documents so far, its first and last
    document, and while these are too few to decide, the rows of all but the first.
    """
    names = ["high", "low", "doc", "crc", "places"]
    tail = None  # of the last hash: [high, low, first document, last document, documents, is the outermost, rows held]

    def out(rows, kind, count=None):
        n = rows.num_rows
        more = [pa.array(np.full(n, kind, np.int32)), pa.array(np.zeros(n, np.int64) if count is None else count)]
        return pa.RecordBatch.from_arrays([*rows.columns, *more], [*names, "kind", "n"])

    def summary(of):
        row = pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in of[:3]] + [pa.array([0], pa.int64()), pa.array([b""], pa.binary())], names)
        return out(row, SUMMARY, pa.array([of[4]], pa.int64()))

    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.select(names)
        high, low, doc = (batch.column(c).to_numpy() for c in names[:3])
        begins = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
        fresh = begins | np.r_[True, doc[1:] != doc[:-1]]
        goes_on = tail is not None and (tail[0], tail[1]) == (high[0], low[0])
        if goes_on and tail[3] == doc[0]:
            fresh[0] = False
        before = tail[4] if goes_on else 0
        group = np.cumsum(begins) - 1
        starts = np.flatnonzero(begins)
        seen = np.cumsum(fresh)
        # The document's place among those of its hash, from 0.
        nth = seen - (seen[starts] - fresh[starts])[group] - 1
        nth[group == 0] += before
        documents = np.maximum.reduceat(nth, starts) + 1
        outermost = np.zeros(len(starts), bool)
        outermost[0] = tail is None or goes_on and tail[5]
        last = len(starts) - 1
        decided = documents >= least
        if tail is not None and not (goes_on and last == 0 and not decided[0]):
            # The hash held so far ends here, or has documents enough now.
            if tail[6] and goes_on and decided[0]:
                yield from (out(rows, GOES) for rows in tail[6])
            if tail[5] and not goes_on:
                yield summary(tail)
            tail[6] = []
        of_outermost = outermost[group]
        yield out(batch.filter(pa.array(of_outermost)), OPEN)
        later = (nth > 0) & ~of_outermost
        yield out(batch.filter(pa.array(later & decided[group])), GOES)
        waits = batch.filter(pa.array(later & ~decided[group] & (group == last)))
        first = tail[2] if goes_on and last == 0 else int(doc[starts[last]])
        held = tail[6] if goes_on and last == 0 else []
        if outermost[0] and last > 0:
            yield summary([int(high[0]), int(low[0]), tail[2] if goes_on else int(doc[0]), None, int(documents[0])])
        tail = [int(high[-1]), int(low[-1]), first, int(doc[-1]), int(documents[last]), bool(outermost[last]), held + [waits] * (waits.num_rows > 0)]
    if tail is not None:
        yield from (out(rows, OPEN) for rows in tail[6])
        yield summary(tail)


def keep_bitmaps(docs: DataFrame, *, text="text", key="doc_id") -> DataFrame:
    """`doc, crc, n_dropped, keep` of every text that loses lines.

    `keep` is the zlib-compressed bitmap of its lines, first line in the highest bit, 1 for kept; lines
    behind its end are kept. `crc` tells rows of one key with different texts apart.
    """
    ordered = line_rows(docs, text=text, key=key).repartitionByRange("high", "low", F.desc("doc"))
    ordered = ordered.sortWithinPartitions("high", "low", F.desc("doc"), "crc")
    found = materialize(ordered.mapInArrow(stream, f"{ROW}, kind int, n long"), "lines-streamed")
    # Two rows of each task at the most.
    outer = found.where(F.col("kind") == SUMMARY).groupBy("high", "low").agg(F.sum("n").alias("n"), F.max("doc").alias("first"))
    outer = F.broadcast(outer.where(F.col("n") >= LEAST_DOCUMENTS).drop("n"))
    settled = found.where(F.col("kind") == OPEN).join(outer, ["high", "low"]).where("doc < first")
    columns = ["doc", "crc", "places"]
    goes = found.where(F.col("kind") == GOES).select(*columns).unionByName(settled.select(*columns))
    # A repeated row names the same places again; a set holds them once.
    of_text = goes.groupBy("doc", "crc").agg(F.collect_set("places").alias("places"))

    def run(batches):
        for batch in batches:
            counts, maps = [], []
            for parts in batch.column("places").to_pylist():
                dropped = np.unique(np.concatenate([np.frombuffer(p, "<u4") for p in parts]))
                keep = np.ones(int(dropped[-1]) // 8 * 8 + 8, np.uint8)
                keep[dropped] = 0
                counts.append(len(dropped))
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("crc"), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], ["doc", "crc", "n_dropped", "keep"])

    return materialize(of_text.mapInArrow(run, "doc long, crc long, n_dropped long, keep binary"), "lines-bitmaps")


def kept_lines(text: bytes, keep: bytes) -> bytes:
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    dropped = set(np.flatnonzero(bits == 0).tolist())
    return b"\n".join([line for i, line in enumerate(lines) if i not in dropped])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, text="text", key="doc_id", with_text=False) -> DataFrame:
    """`key, n_lines, n_dropped, kept_sha256` and, if asked for, the remaining `kept_text` of every row."""
    size = bitmaps.agg(F.sum(F.length("keep") + 48)).first()[0] or 0
    few = F.broadcast(bitmaps) if size <= BROADCAST_BYTES else bitmaps
    rows = _rows(docs, text, key).withColumn("key", F.when(F.col("doc") != _NULL_KEY, F.col("doc"))).join(few, ["doc", "crc"], "left")
    names = ["key", "n_lines", "n_dropped", "kept_sha256"] + ["kept_text"] * with_text

    def run(batches):
        for batch in batches_of(batches, "text", 4 << 20):
            texts, counts = batch.column("text").to_pylist(), batch.column("n_dropped").fill_null(0)
            left = [kept_lines(t, k) if n else t for t, n, k in zip(texts, counts.to_pylist(), batch.column("keep").to_pylist())]
            columns = [batch.column("key"), pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()), counts, pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(left, pa.binary()).cast(pa.string())] * with_text, names)

    schema = "key long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
    found = rows.select("key", "text", "n_dropped", "keep").mapInArrow(run, schema)
    return found.select(F.col("key").alias(key), *names[1:])


def drop_lines(docs: DataFrame, *, text="text", key="doc_id", with_text=False) -> DataFrame:
    """Every row with the count of its lines, of those dropped and the digest (or the text) of what stays.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least 20
    code points in at least 3 documents lose their lines in all but the document with the largest key.
    Lines without such a key stay. Null and empty texts are one empty line. Rows of one key are one
    document, whether repeated or with different texts; a null key is the smallest document. Other
    columns are not read; an empty table gives no rows. Keys are whole numbers.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, text=text, key=key), text=text, key=key, with_text=with_text)

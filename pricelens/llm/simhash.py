"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a 64-bit fingerprint gets a vector m(i) of radius + 1 bits. For every nonzero vector v the
mask of v keeps the bits with an odd product <m(i), v>. Where two fingerprints differ in at most
`radius` bits, the vectors of those bits leave room for a v orthogonal to all of them: in the table
of that v both have the same key. So 2^(radius+1) - 1 tables find every pair within the radius, and
a comparison of the fingerprints removes the others.

Equal fingerprints are one node. A bucket sends on the links of a spanning star for each connected
part of it, never its pairs, and links become components in `graph`.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pricelens.llm import graph
from pricelens.llm.common import batches_of, materialize

RADIUS, SHINGLE_WORDS, SEED, BITS = 3, 3, 42, 64
# Shingles whose bits are counted at once.
BLOCK = 1 << 16
# Members of a bucket compared directly; a larger one is covered again by its own tables.
DIRECT = 2048


def fingerprint(text: str | None, words=SHINGLE_WORDS) -> int:
    """Majority of the bits of the shingles' XXH64; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words)))))
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(shingles), BLOCK):
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[start: start + BLOCK]], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text="text", key="doc_id") -> DataFrame:
    """`id, fp` of every row; the fingerprint is a signed long."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches_of(batches, "text", 16 << 20):
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found)], ["id", "fp"])

    return rows.mapInArrow(run, "id long, fp long")


def masks(bits: list[int], radius: int) -> list[int]:
    """One mask for each nonzero vector, over the given bit positions."""
    vectors = 1 << (radius + 1)
    of_bit = {bit: 1 + i % (vectors - 1) for i, bit in enumerate(bits)}
    return [sum(1 << bit for bit, m in of_bit.items() if bin(m & v).count("1") % 2) for v in range(1, vectors)]


def _distance(a, b):
    return np.bitwise_count(a ^ b)


def spanning(fps, groups, radius: int, free: int = (1 << BITS) - 1):
    """Pairs of positions that span every linked part of each group. `groups` is ascending.

    Members at a fixed step from each other are compared at once, so the work is that of all pairs
    inside a group but only links are kept. `free` are the bits in which members may differ.
    """
    left, right = [], []
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    small = np.repeat(sizes <= DIRECT, sizes)
    where = np.flatnonzero(small & np.repeat(sizes > 1, sizes))
    step = 1
    while len(where):
        where = where[where + step < len(groups)]
        where = where[groups[where] == groups[where + step]]
        near = where[_distance(fps[where], fps[where + step]) <= radius]
        left.append(near)
        right.append(near + step)
        step += 1
    for at, size in zip(starts[sizes > DIRECT], sizes[sizes > DIRECT]):
        for a, b in _covered(fps[at: at + size], radius, free):
            left.append(a + at)
            right.append(b + at)
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))


def _covered(fps, radius, free):
    """Links of a large bucket: the bits that may still differ are covered again."""
    differ = int(np.bitwise_or.reduce(fps ^ fps[0])) & free
    bits = [i for i in range(BITS) if differ >> i & 1]
    for mask in masks(bits, radius):
        kept = fps & np.uint64(mask)
        order = np.argsort(kept, kind="stable")
        if not mask or kept[order[0]] == kept[order[-1]]:
            # Nothing is divided any more: compare one by one with the rest.
            for i in range(len(fps) - 1):
                near = i + 1 + np.flatnonzero(_distance(fps[i], fps[i + 1:]) <= radius)
                yield np.full(len(near), i), near
            return
        a, b = spanning(fps[order], kept[order], radius, differ & ~mask)
        yield order[a], order[b]


def buckets(nodes: DataFrame, radius=RADIUS, *carry) -> DataFrame:
    """`node, fp, bucket` and the columns `carry`: each node in its bucket of every table."""
    tables = masks(list(range(BITS)), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in tables]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)])
    return nodes.select("node", "fp", *carry, F.explode(keys).alias("bucket"))


def links(nodes: DataFrame, radius=RADIUS) -> DataFrame:
    """`a, b`: links between nodes `node, fp` that join all fingerprints within the radius."""
    spread = buckets(nodes, radius).repartition("bucket")

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        bucket, fps, node = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("bucket", "fp", "node"))
        order = np.argsort(bucket, kind="stable")
        bucket, fps, node = bucket[order], fps[order].view(np.uint64), node[order]
        a, b = spanning(fps, bucket, radius)
        a, b = star(len(node), a, b)
        ends = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])]), axis=1)
        for start in range(0, ends.shape[1], 1 << 16):
            part = ends[:, start: start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1])], ["a", "b"])

    return spread.mapInArrow(run, "a long, b long").distinct()


def star(count: int, a, b):
    """Fewer links with the same connected parts: each position but the first of a part to that first one."""
    label = np.arange(count)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (a, b):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        while True:
            deeper = label[label]
            if np.array_equal(deeper, label):
                break
            label = deeper
        if np.array_equal(before, label):
            break
    tied = np.flatnonzero(label != np.arange(count))
    return label[tied], tied


def near_duplicates(docs: DataFrame, *, text="text", key="doc_id", radius=RADIUS) -> DataFrame:
    """`key, fingerprint, component_id` of every row; a component is the smallest key reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows and equal
    fingerprints are one node. An empty table gives no rows; other columns are not read. Keys are whole
    numbers; rows with a null key get the smallest key of their component as well, or null.
    """
    found = materialize(fingerprints(docs, text=text, key=key), "simhash-fingerprints")
    nodes = materialize(found.groupBy("fp").agg(F.min("id").alias("node")).where("node is not null"), "simhash-nodes")
    parts = graph.components(links(nodes, radius), "simhash")
    of_fp = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    of_fp = materialize(of_fp, "simhash-components")
    return found.join(of_fp, "fp", "left").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

"""Near copies by the similarity of word shingles.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of at least
`SIMILAR`. A set gets `BANDS * ROWS` minimum hashes; texts that agree in all rows of a band meet in a
bucket, which two texts of similarity 0.8 miss with a probability of 0.0004. In a bucket low bytes of
the minima estimate the similarity; the links that pass are confirmed on whole sets.

Texts are told apart by 64 bits of hash. A bucket of more than `DIRECT` texts is not compared in pairs at
first: a leader takes the texts near it out of the queue, and each later leader is linked to one near text
of every earlier one, so the links grow with the texts. What the confirmed links have not brought together
is then compared in pairs after all (`unsettled`), in tiles of bounded size, each in its turn of a task.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pricelens.llm import graph
from pricelens.llm.common import batches_of, bounded, materialize
from pricelens.llm.simhash import RADIUS, buckets as print_buckets

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS, SEED = 20, 5, 58
# Estimates (standard error 0.04) that are looked at on whole sets, and those that settle a text of a large bucket.
MAYBE, NEAR = 0.6, 0.78
# Texts of a bucket compared in pairs; shingles hashed at once; nodes sent to every task.
DIRECT, BLOCK, BROADCAST_NODES = 64, 1 << 12, 500_000
# Texts on each side of a tile, and pairs of a tile whose sketches are compared at once.
TILE, AT_ONCE = 2_048, 1 << 16
_random = np.random.default_rng(SEED)
_FLIP = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def node(text="text"):
    """What stands for a text: null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def shingles(text: str | None):
    """Hashes of the distinct five-word shingles, ascending; one of all words where there are fewer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    parts = zip(*(found[i:] for i in range(WORDS))) if len(found) > WORDS else [found]
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts], np.uint64))


def minima(hashes):
    """The minimum of each hash function over a set."""
    out = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for start in range(0, len(hashes), BLOCK):
        part = (hashes[start: start + BLOCK, None] ^ _FLIP) * _TIMES
        np.minimum(out, (part ^ (part >> np.uint64(31))).min(axis=0), out=out)
    return out


def similarity(a, b) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketches(docs: DataFrame, text: str) -> DataFrame:
    """`node, sketch, keys` of every row: a byte of each minimum, and the bucket of each band."""

    def run(batches):
        for batch in batches_of(batches, "text", 16 << 20):
            found = np.array([minima(shingles(t)) for t in batch.column("text").to_pylist()], np.uint64).reshape(-1, BANDS, ROWS)
            keys = [[xxhash.xxh64_intdigest(band.tobytes(), i) >> 1 for i, band in enumerate(bands)] for bands in found]
            low = [(bands & np.uint64(255)).astype(np.uint8).tobytes() for bands in found]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(low, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["node", "sketch", "keys"])

    rows = docs.select(node(text).alias("node"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "node long, sketch binary, keys array<long>")


def pairs(groups, sketch):
    """Positions of texts in one bucket that may be near copies. `groups` is ascending."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    left, right = [], []
    where = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= DIRECT), sizes))
    step = 1
    while len(where):
        where = where[where + step < len(groups)]
        where = where[groups[where] == groups[where + step]]
        for part in np.array_split(where, len(where) // BLOCK + 1):
            near = part[(sketch[part] == sketch[part + step]).mean(axis=1) >= MAYBE]
            left.append(near)
            right.append(near + step)
        step += 1
    for at, size in zip(starts[sizes > DIRECT], sizes[sizes > DIRECT]):
        a, b = _led(sketch[at: at + size])
        left.append(a + at)
        right.append(b + at)
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))


def _led(sketch):
    """Links of a large bucket: leaders to the texts near them."""
    leader = np.full(len(sketch), -1)
    left, right = [], []
    for i in range(len(sketch)):
        if leader[i] >= 0:
            continue
        alike = np.concatenate([(sketch[s: s + 65536] == sketch[i]).mean(axis=1) for s in range(0, len(sketch), 65536)])
        leader[i], alike[i] = i, 0
        near = np.flatnonzero(alike >= NEAR)
        near = near[np.argsort(-alike[near], kind="stable")]
        fresh, settled = near[leader[near] < 0], near[leader[near] >= 0]
        settled = settled[np.unique(leader[settled], return_index=True)[1]]
        leader[fresh] = i
        for found in (fresh, settled):
            left.append(np.full(len(found), i))
            right.append(found)
    return np.concatenate(left), np.concatenate(right)


def candidates(nodes: DataFrame) -> DataFrame:
    """`a, b`: distinct pairs of nodes that may be near copies. `nodes` is read several times.

    Buckets are counted first, on numbers alone: sketches move only to those that two nodes share.
    """
    keys = nodes.select("node", F.explode("keys").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = keys.join(shared, "bucket", "left_semi")
    spread = nodes.select("node", "sketch").join(members, "node").repartition("bucket").select("node", "sketch", "bucket")

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        bucket, node = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("bucket", "node"))
        sketch = np.concatenate([np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8) for b in held]).reshape(len(node), -1)
        order = np.lexsort((node, bucket))
        # Only texts that share a bucket are laid out in order.
        again = bucket[order][1:] == bucket[order][:-1]
        order = order[np.r_[False, again] | np.r_[again, False]]
        a, b = pairs(bucket[order], sketch[order]) if len(order) else (order, order)
        a, b = node[order][a], node[order][b]
        ends = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        for start in range(0, ends.shape[1], 1 << 16):
            part = ends[:, start: start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1])], ["a", "b"])

    return spread.mapInArrow(run, "a long, b long").distinct()


def alike(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the links `a, b` whose sketches estimate that the sets may be similar."""
    nodes = nodes.select("node", "sketch")
    both = links.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    both = both.join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= MAYBE))

    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def confirmed(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Those of the links `a, b` whose whole sets are similar."""
    ends = bounded(materialize(found.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "shingles-ends"), BROADCAST_NODES)

    def sets(batches):
        for batch in batches_of(batches, "text", 4 << 20):
            found = pa.array([shingles(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), found], ["node", "held"])

    texts = docs.select(node(text).alias("node"), F.col(text).alias("text")).join(ends, "node", "left_semi")
    # Equal texts have equal sets: a task sends on one of them.
    held = materialize(texts.mapInArrow(sets, "node long, held binary").groupBy("node").agg(F.max("held").alias("held")), "shingles-sets")

    def run(batches):
        for batch in batches_of(batches, "held_a", 4 << 20):
            columns = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("held_a", "held_b"))
            similar = pa.array([similarity(a, b) >= SIMILAR for a, b in zip(*columns)], pa.bool_())
            yield batch.select(["a", "b"]).filter(similar)

    both = found.join(held.select(F.col("node").alias("a"), F.col("held").alias("held_a")), "a")
    both = both.join(held.select(F.col("node").alias("b"), F.col("held").alias("held_b")), "b")
    return both.select("a", "b", "held_a", "held_b").mapInArrow(run, "a long, b long")


def unsettled(nodes: DataFrame, labels: DataFrame, prints: DataFrame = None) -> DataFrame:
    """`a, b`: pairs of nodes under different `label` that may be near copies and that no star or leader has tied.

    Looked at are all pairs of the buckets that `candidates` doesn't compare in pairs, and, with `prints` (`node, fp, part`;
    `part` joins all fingerprints within the radius), all pairs of fingerprints within it. A bucket of n texts is cut into
    tiles of `TILE` texts a side.
    """
    label = F.coalesce("label", "node").alias("label")
    labelled = lambda rows, *columns: rows.join(labels, "node", "left").select("node", *columns, label)
    mixed = F.min("label") < F.max("label")
    keys = labelled(nodes, "keys").select("node", "label", F.lit(0).cast("long").alias("fp"), F.explode("keys").alias("bucket"))
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), mixed.alias("mixed")).where(F.col("mixed") & (F.col("n") > DIRECT))
    members = keys.join(sizes.select("bucket", "n"), "bucket")
    if prints is not None:
        of_print = labelled(prints, "fp", "part")
        several = of_print.groupBy("part").agg(mixed.alias("mixed")).where("mixed").select("part")
        spread = materialize(of_print.join(several, "part", "left_semi").select("node", "fp", "label"), "shingles-prints")
        spread = print_buckets(spread, RADIUS, "label").select("node", "label", "fp", "bucket")
        sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), mixed.alias("mixed")).where("mixed")
        members = members.unionByName(spread.join(sizes.select("bucket", "n"), "bucket"))
    members = materialize(members, "shingles-members")
    parts = F.ceil(F.col("n") / TILE).cast("int")
    dealt = members.join(nodes.select("node", "sketch"), "node").withColumn("own", F.pmod(F.xxhash64(F.lit(1), "node"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    tile = ["bucket", "i", "j"]
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    dealt = dealt.select(*tile, "own", "node", "label", "fp", "sketch").repartition(*tile).sortWithinPartitions(*tile)

    def run(batches):
        for rows in _tiles(batches):
            found = [np.zeros((2, 0), np.int64), *_apart(*rows)]
            ends = np.unique(np.concatenate(found, axis=1), axis=1)
            for start in range(0, ends.shape[1], 1 << 16):
                part = ends[:, start: start + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _tiles(batches):
    """The rows of each tile as arrays: number of the side, node, label, fingerprint, sketch. Batches are in the order of the tiles."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")])
        cuts = np.r_[0, 1 + np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if held and (held[0][0] != key[:, start]).any():
                yield _joined(held)
                held = []
            held.append((key[:, start], batch.slice(start, end - start)))
    if held:
        yield _joined(held)


def _joined(held):
    own, node, label, fp = (np.concatenate([b.column(c).to_numpy() for _, b in held]) for c in ("own", "node", "label", "fp"))
    sketch = np.concatenate([np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8) for _, b in held]).reshape(len(node), -1)
    return held[0][0], own, node, label, fp.view(np.uint64), sketch


def _apart(key, own, node, label, fp, sketch):
    """Pairs of one tile, the smaller node first, that differ in label, are within the radius and whose sketches are alike."""
    left, right = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
    step = max(1, AT_ONCE // max(1, len(right)))
    for at in range(0, len(left), step):
        of = left[at: at + step]
        near = (label[of, None] != label[right]) & (np.bitwise_count(fp[of, None] ^ fp[right]) <= RADIUS)
        if key[1] == key[2]:
            near &= of[:, None] < right
        i, j = np.divmod(np.flatnonzero(near), max(1, len(right)))
        a, b = of[i], right[j]
        for start in range(0, len(a), AT_ONCE):
            x, y = a[start: start + AT_ONCE], b[start: start + AT_ONCE]
            alike = (sketch[x] == sketch[y]).mean(axis=1) >= MAYBE
            x, y = node[x[alike]], node[y[alike]]
            yield np.stack([np.minimum(x, y), np.maximum(x, y)])


def groups(docs: DataFrame, links: DataFrame = None, prints: DataFrame = None, *, text="text") -> DataFrame:
    """`node, component` of every text that has a near copy; null and wordless texts are copies of each other.

    `links`, pairs `a, b` of nodes that another method has found, are looked at in the same way as those of the buckets;
    `prints` are the fingerprints of `unsettled`.
    """
    nodes = sketches(docs, text).groupBy("node").agg(F.max("sketch").alias("sketch"), F.max("keys").alias("keys"))
    nodes = materialize(nodes, "shingles-nodes")
    found = candidates(nodes) if links is None else candidates(nodes).unionByName(alike(links, nodes)).distinct()
    found = materialize(found, "shingles-candidates")
    parts = graph.components(materialize(confirmed(found, docs, text), "shingles-links"), "shingles")
    more = unsettled(nodes, parts.withColumnRenamed("component", "label"), prints)
    more = materialize(more.join(found, ["a", "b"], "left_anti"), "shingles-unsettled")
    if more.isEmpty():
        return parts
    tied = parts.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    more = materialize(confirmed(more, docs, text), "shingles-more")
    return parts if more.isEmpty() else graph.components(tied.unionByName(more), "shingles-all")

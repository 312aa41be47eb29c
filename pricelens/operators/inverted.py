"""Approximate nearest neighbours by an inverted file of learned centroids with residual codes.

After Jegou, Douze and Schmid, "Product Quantization for Nearest Neighbor Search" (PAMI 2011), with a
scalar code for each entry. Centroids are learned on a bounded sample; an index row goes to the list of
its nearest centroid and keeps, in four bits an entry, what the centroid leaves of it. A query probes the
lists whose centroid is not much farther than its nearest one (few where vectors are clustered, many
where nothing tells the lists apart), and more while these hold too few rows. It scans their codes, and
the best are looked at on whole vectors.

All decisions up to that are made on whole numbers (entries times a scale that the sample gives), so they
come out alike on every machine and in any order. No setting follows the number of rows.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelens import config
from pricelens.operators.order import hash_key
from pricelens.operators.retrieve import (
    BLOCK_ROWS, FULL_ROWS, TILE_ROWS, _answers, _by_slices, _distinct_queries, _squared, _stack, _top, _without_copies, rerank,
)
from pricelens.session import materialize

# Lists, rounds of learning, and rows of the sample.
LISTS, ROUNDS, SAMPLE_ROWS = 64, 3, 16_384
# Whole numbers that the largest entry of the sample is cut into.
LEVELS = 2_048
# Lists are probed up to this many per cent of the nearest centroid's squared distance.
MARGIN = 180
# Candidates of a query that are looked at on whole vectors.
CANDIDATES = 32
# Visitors of a block of lists that one task holds, with their vectors and what they find; and those compared with a tile at once.
VISIT_ROWS, VISITORS = 8_192, 256


@dataclass(frozen=True)
class Lists:
    """What was learned: `scale` of entries, centroids as whole numbers, `step` of the residual codes."""

    scale: float
    centroids: np.ndarray
    step: int

    def whole(self, vectors) -> np.ndarray:
        return np.floor(vectors * self.scale + 0.5)

    def decoded(self, codes) -> np.ndarray:
        """Middles of the steps that four-bit codes stand for."""
        return (codes.astype(float) - 8) * self.step + self.step // 2


def pack(codes) -> np.ndarray:
    """Two four-bit codes in a byte; an odd last one has a byte of its own."""
    even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return even[:, ::2] << 4 | even[:, 1::2]


def unpack(packed, dims: int) -> np.ndarray:
    return np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, :dims]


def learn(index: DataFrame, lists: int = LISTS, rounds: int = ROUNDS, sample_rows: int = SAMPLE_ROWS) -> Lists | None:
    """Learn from the rows with the smallest hashes of their id, at most `sample_rows`; None without a row."""
    key = hash_key(F.col("id"), "lists")
    rows = index.select("id", "embedding").orderBy(key, "id").limit(sample_rows).collect()
    if not rows:
        return None
    vectors = np.array([r["embedding"] for r in rows], float)
    scale = LEVELS / (np.abs(vectors).max() or 1.0)
    own = Lists(scale, np.zeros((0, vectors.shape[1])), 1)
    points = own.whole(vectors)
    centroids = points[:lists].copy()
    for _ in range(rounds):
        nearest = _nearest(points, centroids)
        for c in range(len(centroids)):
            members = points[nearest == c]
            if len(members):
                centroids[c] = np.floor(members.sum(axis=0) / len(members))
    left = points - centroids[_nearest(points, centroids)]
    return Lists(scale, centroids, max(1, math.floor(math.sqrt((left * left).sum() / left.size) / 2)))


def _nearest(points, centroids):
    """Numbers of the nearest centroids (the first of equal ones), for a bounded block of points."""
    parts = [_squared(points[at : at + 4_096], centroids).argmin(1) for at in range(0, len(points), 4_096)]
    return np.concatenate(parts) if parts else np.zeros(0, int)


def _entries(lists: Lists):
    def compute(vectors):
        if vectors.empty:
            return pd.DataFrame({"cell": pd.Series(dtype="int32"), "code": pd.Series(dtype=object)})
        points = lists.whole(_stack(vectors))
        cell = _nearest(points, lists.centroids)
        codes = np.clip(np.floor((points - lists.centroids[cell]) / lists.step), -8, 7).astype(np.int8) + 8
        return pd.DataFrame({"cell": cell.astype("int32"), "code": [c.tobytes() for c in pack(codes.astype(np.uint8))]})

    @F.pandas_udf("struct<cell:int,code:binary>")
    def entry(vectors: pd.Series) -> pd.DataFrame:
        return _by_slices(compute, vectors)

    return entry


def encode(rows: DataFrame, lists: Lists) -> DataFrame:
    """`id, cell, code` of index rows: what is stored beside the table."""
    return rows.withColumn("_e", _entries(lists)("embedding")).select("id", "_e.cell", "_e.code")


def sizes(entries: DataFrame, lists: Lists) -> np.ndarray:
    """Rows of each list; there are as many as centroids, so this is a bounded table."""
    counts = np.zeros(len(lists.centroids), int)
    for r in entries.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    return counts


def _probes(lists: Lists, counts, margin: int, least: int):
    """The lists within the margin, and in any case the nearest ones that hold `least` rows together."""

    def compute(vectors):
        if vectors.empty:
            return pd.Series([], dtype=object)
        d = _squared(lists.whole(_stack(vectors)), lists.centroids)
        order = np.argsort(d, axis=1, kind="stable")
        held = counts[order]
        near = np.empty(d.shape, bool)
        np.put_along_axis(near, order, np.cumsum(held, axis=1) - held < least, axis=1)
        near |= d * 100 <= d.min(axis=1, keepdims=True) * margin
        return pd.Series([np.flatnonzero(row & (counts > 0)).astype("int32") for row in near])

    @F.pandas_udf("array<int>")
    def probes(vectors: pd.Series) -> pd.Series:
        return _by_slices(compute, vectors)

    return probes


def _scan(lists: Lists, count: int):
    """The best `count` codes of one block, of the lists that a query visits, for every query of one block.

    All distances are whole numbers. They are made in single precision first, with a bound on what that loses, and
    again in full for what may be among the best of those seen so far.
    """

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"rep": [], "id": [], "distance": []})
        cell = rows["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        cell, ids = cell[order], rows["id"].to_numpy()[order]
        packed = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)[order]
        asked, reps = lists.whole(_stack(queries["embedding"])), queries["rep"].to_numpy()
        visits = np.zeros((len(asked), len(lists.centroids)), bool)
        visits[np.repeat(np.arange(len(asked)), queries["cells"].map(len)), np.concatenate(queries["cells"].to_numpy())] = True
        best = [(np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))]  # query, id, distance
        edge = np.full(len(asked), np.inf)
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], len(cell)]):
            centre = lists.centroids[cell[start]]
            come = np.flatnonzero(visits[:, cell[start]])
            own = asked[come] - centre
            for at in range(start, end if len(come) else start, TILE_ROWS):
                tile = slice(at, min(at + TILE_ROWS, end))
                points = lists.decoded(unpack(packed[tile], len(centre)))
                for x in range(0, len(come), VISITORS):
                    part = slice(x, x + VISITORS)
                    q, i, d = _near(own[part], points, edge[come[part]], count)
                    best.append((come[part][q], ids[i + at], d))
                if np.isinf(edge).any() or sum(len(x) for x, _, _ in best[1:]) > len(best[0][0]) // 2:
                    best = [_best(best, count, edge)]
        q, found, d = _best(best, count, edge)
        return pd.DataFrame({"rep": reps[q], "id": found, "distance": d})

    return run


def _near(own, points, edge, count):
    """Query, row and whole distance of the pairs that are no farther than `edge`; at first of the `count` nearest."""
    own_square, square = (own * own).sum(1), (points * points).sum(1)
    long = np.sqrt(own_square) + math.sqrt(square.max())
    single = long.max() < 1e15
    loss = (own.shape[1] + 4) * (2.0**-23 if single else 2.0**-52) * long**2
    kind = np.float32 if single else float
    left, right = np.column_stack([-2.0 * own, np.ones(len(own)), own_square]).astype(kind), np.column_stack([points, square, np.ones(len(points))]).astype(kind)
    apart = left @ right.T
    open_ = np.isinf(edge)
    if open_.any() and len(points) >= count:
        first = np.partition(apart[open_], count - 1, axis=1)[:, count - 1] + 2 * loss[open_]
        edge = edge.copy()
        edge[open_] = first
    q, i = np.divmod(np.flatnonzero(apart <= (edge + loss).astype(kind)[:, None]), len(points))
    d = np.concatenate([((own[q[x : x + FULL_ROWS]] - points[i[x : x + FULL_ROWS]]) ** 2).sum(1) for x in range(0, max(1, len(q)), FULL_ROWS)])
    may = d <= edge[q]
    return q[may], i[may], d[may]


def _best(found, count, edge):
    """Of each query the `count` nearest (ties to the smaller id) of what was found; `edge` becomes the last one's distance."""
    q, ids, d = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, d, q))
    q, ids, d = q[order], ids[order], d[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    edge[q[place == count - 1]] = d[place == count - 1]
    return q[place < count], ids[place < count], d[place < count]


def _blocks_of(counts) -> np.ndarray:
    """The block of each list: lists that follow each other share one while they fit, one that does not fit has its own."""
    block, held, out = 0, 0, []
    for n in counts:
        if held and held + n > BLOCK_ROWS:
            block, held = block + 1, 0
        out.append(block)
        held += n
    return np.array(out, int)


def scanned(visits: DataFrame, entries: DataFrame, lists: Lists, count: int) -> DataFrame:
    """`rep, id, distance`: the best codes, of each block that a query visits, in the lists that it visits.

    Lists share blocks of bounded size, and a very long one is cut into several; of very many visitors of a block,
    parts of bounded size meet it, each in a task of its own. There are as many lists as centroids, so their sizes
    are a bounded table.
    """
    spark = visits.sparkSession
    counts = sizes(entries, lists)
    of_list = _blocks_of(counts)
    rows_of = np.bincount(of_list, counts, minlength=of_list.max() + 1)
    block_of = lambda cell: F.element_at(F.array(*[F.lit(int(b)) for b in of_list]), cell + 1)
    visits = visits.select("rep", "embedding", "cells", F.explode(F.array_distinct(F.transform("cells", block_of))).alias("block"))
    visitors = {r["block"]: r["count"] for r in visits.groupBy("block").count().collect()}
    blocks = [(b, math.ceil(n / VISIT_ROWS), max(1, math.ceil(rows_of[b] / BLOCK_ROWS))) for b, n in visitors.items()]
    if not blocks:
        return spark.createDataFrame([], "rep bigint, id bigint, distance double")
    blocks = F.broadcast(spark.createDataFrame(blocks, "block int, nq int, ni int"))
    part = lambda column, n: F.pmod(F.xxhash64(column), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = F.filter("cells", lambda c: block_of(c) == F.col("block")).alias("cells")
    left = visits.select("rep", "embedding", inside, "block").join(blocks, "block").withColumn("qb", part("rep", F.col("nq"))).withColumn("ib", every("ni"))
    right = entries.withColumn("block", block_of(F.col("cell"))).join(blocks, "block").withColumn("ib", part("id", F.col("ni"))).withColumn("qb", every("nq"))
    keys = ["block", "qb", "ib"]
    left, right = left.select(*keys, "rep", "embedding", "cells"), right.select(*keys, "id", "cell", "code")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_scan(lists, count), "rep bigint, id bigint, distance double")


def search(
    queries: DataFrame, index: DataFrame, entries: DataFrame, lists: Lists, k: int = config.NEIGHBOURS, exclude_self: bool = False,
    margin: int = MARGIN, candidates: int = CANDIDATES,
) -> DataFrame:
    """`query_id, rank, id, distance` of the nearest rows found; distances are exact. `entries` are those of `index`.

    A list visited moves its codes (half a byte an entry) and the query's vector; whole index vectors are
    only joined for the candidates.
    """
    wanted = k + 1 if exclude_self else k
    least = max(candidates, wanted)
    probes = _probes(lists, sizes(entries, lists), margin, least)
    visits = materialize(_distinct_queries(queries).withColumn("cells", probes("embedding")), "visits")
    best = _top(scanned(visits, entries, lists, least), least)
    hits = rerank(best, visits.select(F.col("rep").alias("id"), "embedding"), index, wanted)
    return _answers(queries, visits.select("rep", "embedding"), hits, k, exclude_self)


def share_scanned(queries: DataFrame, entries: DataFrame, lists: Lists, margin: int = MARGIN, candidates: int = CANDIDATES) -> float:
    """The share of all (query, index row) pairs whose codes a search compares."""
    counts = sizes(entries, lists)
    visits = queries.select(F.explode(_probes(lists, counts, margin, candidates)("embedding")).alias("cell")).groupBy("cell").count().collect()
    return sum(int(counts[r["cell"]]) * r["count"] for r in visits) / max(1, queries.count() * int(counts.sum()))


def nearest_listed(queries: DataFrame, index: DataFrame, k: int = config.NEIGHBOURS, exclude_self: bool = False, **settings) -> DataFrame:
    """Learn, encode and search in one go. Of equal index vectors only those that can be answers are encoded."""
    lists = learn(index)
    if lists is None:
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, distance double")
    entries = materialize(encode(_without_copies(index, k + 1 if exclude_self else k), lists), "entries")
    return search(queries, index, entries, lists, k, exclude_self, **settings)


_STORED = "scale double, step int, dims int, centroids array<double>"


def save(lists: Lists, spark: SparkSession, path: str) -> None:
    row = (float(lists.scale), lists.step, lists.centroids.shape[1], lists.centroids.ravel().tolist())
    spark.createDataFrame([row], _STORED).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Lists:
    row = spark.read.schema(_STORED).parquet(path).first()
    return Lists(row["scale"], np.array(row["centroids"]).reshape(-1, row["dims"]), row["step"])

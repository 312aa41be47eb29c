"""Nearest-neighbour joins on vectors, without pairing everything with everything in one place.

Exact search is a filter on short codes and a re-rank on whole vectors. A vector's code holds each entry
in 16 bits of its own largest one; what that loses is known as one number, so the distance of two codes
bounds the true distance from both sides. Codes lie in blocks by the length of their points, a block in one
row of a stored table. Blocks of queries and of index rows meet by reading these tables, so what is written
grows with the vectors alone: first each block of queries with the index block of the nearest lengths, then
with the others that what was found leaves in reach. A task keeps what may be among a query's k nearest of all
blocks it reads. Of all these, what the bounds of all tasks still allow (little more than k) is looked at on
whole vectors, which are joined by id.

Copies are handled before the search: of equal index vectors only the k smallest ids can be among
the answers (ties go to the smaller id), and equal queries are searched once.
"""

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricelens import config
from pricelens.session import materialize, small_batches

# Rows of one block: both sides of a block search fit a Python worker, whatever the cell size.
BLOCK_ROWS = 32_768
# Bytes of codes in a block, where vectors are very long, and codes compared in full at once.
BLOCK_BYTES, FULL_ROWS = 8 << 20, 8_192
SLICE_ROWS = 256
# Rows below which a block is not cut to occupy more tasks, and tasks wanted for each core.
LEAST_BLOCK_ROWS, TASKS_PER_CORE = 512, 2
# Queries compared with a whole block at once.
SEARCH_ROWS = 64
# Queries and rows of a block whose codes are compared at once.
TILE_QUERIES, TILE_ROWS = 256, 2_048
# Signatures: tables, bits of each, and bits by which table a group of cells is told from others of the table.
TABLES, BITS, GROUP_BITS = 6, 10, 4
HITS = "rep bigint, id bigint, distance double"
# What rounding may add to a distance, relative to the vectors' lengths (equal vectors come out at the square root of
# the rounding error of a product); squared distances that differ by less than TIE may be equal once rounded.
SLACK, TIE = 3e-7, 2e-9


def _squared(a, b):
    """All squared distances of two small blocks."""
    cross = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(cross, 0.0)


def _stack(series):
    return np.stack(series.to_numpy()).astype(float)


def _by_slices(compute, *series):
    """Concatenate `compute` over row slices, so that a distance matrix stays small in any batch."""
    starts = range(0, max(len(series[0]), 1), SLICE_ROWS)
    return pd.concat([compute(*[s.iloc[at : at + SLICE_ROWS] for s in series]) for at in starts], ignore_index=True)


def coded(vectors: Column) -> Column:
    """Entries as 16-bit multiples of `unit`, the length of what is `lost` by that, and the `length` of the code's point."""

    def compute(part):
        if part.empty:
            return pd.DataFrame({"code": pd.Series(dtype=object)} | {c: pd.Series(dtype=float) for c in ("unit", "lost", "length")})
        v = _stack(part)
        unit = np.abs(v).max(axis=1, initial=0.0) / 32767
        code = np.rint(v / np.where(unit > 0, unit, 1.0)[:, None])
        point = code * unit[:, None]
        lost, length = np.sqrt(((v - point) ** 2).sum(axis=1)), np.sqrt((point**2).sum(axis=1))
        return pd.DataFrame({"code": [c.tobytes() for c in code.astype("<i2")], "unit": unit, "lost": lost, "length": length})

    @F.pandas_udf("struct<code:binary,unit:double,lost:double,length:double>")
    def code(vectors: pd.Series) -> pd.DataFrame:
        return _by_slices(compute, vectors)

    return code(vectors)


class _Block:
    """Codes of one block by the length of their points; points are made for a few rows at once."""

    def __init__(self, rows: pd.DataFrame, name: str):
        code = np.frombuffer(b"".join(rows["code"]), "<i2").reshape(len(rows), -1)
        unit = rows["unit"].to_numpy()
        length = np.concatenate([np.sqrt(((code[at : at + TILE_ROWS] * unit[at : at + TILE_ROWS, None]) ** 2).sum(1)) for at in range(0, len(rows), TILE_ROWS)])
        order = np.argsort(length, kind="stable")
        order = order[np.isfinite(length + rows["lost"].to_numpy())[order]]  # what is no point is near nothing
        self._hold(code[order], unit[order], length[order], rows["lost"].to_numpy()[order], rows[name].to_numpy()[order])

    @classmethod
    def unpacked(cls, row: dict):
        """The block that one row of `_packed` holds."""
        block, wide = cls.__new__(cls), lambda c, kind: np.frombuffer(row[c], kind)
        unit = wide("unit", "<f8")
        block._hold(wide("code", "<i2").reshape(len(unit), -1), unit, wide("length", "<f8"), wide("lost", "<f8"), wide("ids", "<i8"))
        return block

    def _hold(self, code, unit, length, lost, ids):
        self.code, self.unit, self.length, self.lost, self.ids, self._tiles = code, unit, length, lost, ids, {}

    def points(self, at: int, to: int):
        return self.code[at:to] * self.unit[at:to, None]

    def tile(self, at: int, kind):
        """Rows that give squared distances when multiplied with those of `_Search.own`."""
        if (at, kind) not in self._tiles:
            to = min(at + TILE_ROWS, len(self.ids))
            self._tiles[at, kind] = np.column_stack([self.points(at, to), self.length[at:to] ** 2, np.ones(to - at)]).astype(kind)
        return self._tiles[at, kind]


class _Search:
    """What may be among the k nearest rows, of the blocks looked at, for every query of one block; with bounds on its squared distance.

    Points are no nearer than their lengths differ. So queries of like length look at the rows of the nearest
    lengths first, a tile at a time, and stop where no length is in reach of what they have found. `edge` is what
    is known of the squared distance of each query's last neighbour.
    """

    def __init__(self, asked: _Block, k: int, edge=None):
        self.asked, self.k, count = asked, k, len(asked.ids)
        self.edge = np.full(count, np.inf) if edge is None else np.array(edge)
        self.best, self.found = np.full((count, k), np.inf), [(np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]

    def look(self, held: _Block) -> None:
        count = len(held.ids)
        starts = np.arange(0, count, TILE_ROWS)
        for at in range(0, len(self.asked.ids) if count else 0, TILE_QUERIES):
            self._look(held, at, min(at + TILE_QUERIES, len(self.asked.ids)), starts, held.length[starts], held.length[np.minimum(starts + TILE_ROWS, count) - 1])
        self._drop_far()

    def _look(self, held, at, to, starts, first, last):
        length, lost, own = self.asked.length[at:to], self.asked.lost[at:to], self.asked.points(at, to)
        longest = length[-1] + held.length[-1]
        # Products are made in single precision, with a bound on what that loses, where they stay far from its limits.
        kind, unit = (np.float32, 2.0**-23) if longest < 1e15 else (np.float64, 2.0**-52)
        off = (own.shape[1] + 4) * unit * (length + held.length[-1]) ** 2 + 1e-30
        rows = np.column_stack([-2.0 * own, np.ones(len(own)), length**2]).astype(kind)
        most_off = lost + held.lost.max() + SLACK * (length + held.length[-1])
        edge = self.edge[at:to]
        gaps = np.maximum(0.0, np.maximum(first - length[-1], length[0] - last))
        for t in np.argsort(gaps, kind="stable"):
            reach = np.sqrt(edge + TIE) + most_off
            if gaps[t] > reach.max():
                break
            near = np.flatnonzero(np.maximum(first[t] - length, length - last[t]) <= reach)
            if not len(near):
                continue
            reach, tile = reach[near], held.tile(starts[t], kind)
            square = (rows if len(near) == len(rows) else rows[near]) @ tile.T
            if np.isinf(edge[near]).any() and square.shape[1] >= self.k:  # at first the k nearest of a tile set the reach
                nearest_k = np.sqrt(np.maximum(np.partition(square, self.k - 1, axis=1)[:, self.k - 1] + off[near], 0.0))
                reach = np.minimum(reach, nearest_k + 2 * most_off[near] + TIE**0.5)
            hit = np.flatnonzero(square <= (reach**2 + off[near]).astype(kind)[:, None])
            if not len(hit):
                continue
            q, i = np.divmod(hit, square.shape[1])
            q, i = near[q], i + starts[t]
            d = np.concatenate([self._distance(held, own, q[x : x + FULL_ROWS], i[x : x + FULL_ROWS]) for x in range(0, len(q), FULL_ROWS)])
            apart = lost[q] + held.lost[i] + SLACK * (length[q] + held.length[i])
            low, high = np.maximum(d - apart, 0.0) ** 2, (d + apart) ** 2
            may = low <= edge[q] + TIE
            q, i, low, high = q[may], i[may], low[may], high[may]
            self.found.append((q + at, held.ids[i], low, high))
            self.best[at:to], last_of = _least(self.best[at:to], q, high, self.k)
            np.minimum(edge, last_of, out=edge)

    @staticmethod
    def _distance(held, own, q, i):
        return np.sqrt(((held.code[i] * held.unit[i, None] - own[q]) ** 2).sum(axis=1))

    def _drop_far(self):
        q, ids, low, high = (np.concatenate(x) for x in zip(*self.found))
        may = low <= self.edge[q] + TIE
        self.found = [(q[may], ids[may], low[may], high[may])]

    def hits(self):
        """Numbers of the queries in their block, ids of rows, bounds."""
        return self.found[0]


def _bounded_search(k):
    """What may be among the k nearest rows of one block for every query of one block, with bounds on its squared distance."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"rep": [], "id": [], "low": [], "high": []})
        search = _Search(_Block(queries, "rep"), k)
        search.look(_Block(rows, "id"))
        q, ids, low, high = search.hits()
        return pd.DataFrame({"rep": search.asked.ids[q], "id": ids, "low": low, "high": high})

    return run


def _least(best, q, values, k):
    """The k least of `best` (k a row) and of `values` of the rows `q`; and the last of them."""
    row, value = np.concatenate([np.repeat(np.arange(len(best)), k), q]), np.concatenate([best.ravel(), values])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    start = np.searchsorted(row, np.arange(len(best)))
    best = value[start[:, None] + np.arange(k)[None, :]]
    return best, best[:, k - 1]


def grid(queries: int, rows: int, cores: int) -> tuple[int, int]:
    """Blocks of queries and of index rows: small enough for a worker, and enough of them to occupy all cores.

    Where a x b blocks meet, each index row is read a times and each query b times. So the cut that is made
    for the sake of parallelism is always the one of the longer blocks.
    """
    a, b = max(1, math.ceil(queries / BLOCK_ROWS)), max(1, math.ceil(rows / BLOCK_ROWS))
    while a * b < TASKS_PER_CORE * cores and max(queries / a, rows / b) > LEAST_BLOCK_ROWS:
        a, b = (2 * a, b) if queries / a > rows / b else (a, 2 * b)
    return a, b


def exact_distance(a: Column, b: Column) -> Column:
    """Squared distances, rounded so that equal ones tie."""

    def compute(x, y):
        return pd.Series(np.round(((_stack(x) - _stack(y)) ** 2).sum(axis=1), 9) if len(x) else [], dtype=float)

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return _by_slices(compute, x, y)

    return distance(a, b)


def _block_search(k):
    """Top k index rows of one block for every query of one block, cell by cell."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        held = {cell: part for cell, part in rows.groupby("cell", sort=False)}
        out = [_search(part, held[cell], k) for cell, part in queries.groupby("cell", sort=False) if cell in held]
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "id": [], "distance": []})

    return run


def _search(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    vectors, ids, out = _stack(rows["embedding"]), rows["id"].to_numpy(), []
    for at in range(0, len(queries), SEARCH_ROWS):
        part = queries.iloc[at : at + SEARCH_ROWS]
        d = np.round(_squared(_stack(part["embedding"]), vectors), 9)
        edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        q, i = np.nonzero(d <= edge[:, None])
        hits = pd.DataFrame({"rep": part["rep"].to_numpy()[q], "id": ids[i], "distance": d[q, i]})
        out.append(hits.sort_values(["rep", "distance", "id"]).groupby("rep").head(k))
    return pd.concat(out)


def _top(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("rep").orderBy("distance", "id"))
    return hits.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def search_cells(visits: DataFrame, index: DataFrame, k: int, group_shift: int = 0) -> DataFrame:
    """Top k per query over the cells it visits.

    `visits` has rep, embedding and an array of cells; `index` has id, embedding and cell. The number
    of cells is bounded by construction (pivots or signatures), so the per-cell counts are small. Cells
    that agree but for their last `group_shift` bits are searched in one task, each on its own.
    """
    spark = visits.sparkSession
    group = F.shiftright("cell", group_shift).alias("group")
    visits = visits.select("rep", "embedding", F.explode("cells").alias("cell")).select("*", group)
    index = index.select("id", "embedding", "cell", group)
    visitors = visits.groupBy("group").agg(F.count("*").alias("nq"))
    members = index.groupBy("group").agg(F.count("*").alias("ni"))
    blocks = visitors.join(members, "group").select(
        "group", *[F.ceil(F.col(n) / BLOCK_ROWS).cast("int").alias(n) for n in ("nq", "ni")]
    )
    blocks = F.broadcast(spark.createDataFrame(blocks.collect(), blocks.schema))
    parts = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = visits.join(blocks, "group")
    left = left.withColumn("qb", F.pmod(F.xxhash64("rep"), "nq").cast("int")).withColumn("ib", F.explode(parts("ni")))
    right = index.join(blocks, "group")
    right = right.withColumn("ib", F.pmod(F.xxhash64("id"), "ni").cast("int")).withColumn("qb", F.explode(parts("nq")))
    keys = ["group", "qb", "ib"]
    left, right = left.select(*keys, "cell", "rep", "embedding"), right.select(*keys, "cell", "id", "embedding")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_block_search(k), HITS)
    return hits


def _distinct_queries(queries: DataFrame) -> DataFrame:
    return queries.groupBy("embedding").agg(F.min("id").alias("rep"))


def _without_copies(index: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("embedding").orderBy("id"))
    return index.select("id", "embedding").withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def _answers(queries: DataFrame, reps: DataFrame, hits: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Give every query the neighbours of its vector."""
    own = queries.select(F.col("id").alias("query_id"), "embedding").join(reps, "embedding").select("query_id", "rep")
    return _ranked(own, hits, k, exclude_self)


def _ranked(own: DataFrame, hits: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The neighbours of `query_id, rep` in rank order, the query itself left out if asked."""
    found = hits.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("found"))
    own = own.join(found, "rep")
    if exclude_self:
        own = own.withColumn("found", F.filter("found", lambda n: n["id"] != F.col("query_id")))
    ranked = own.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("pos", "n"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), "n.id", "n.distance")


def _coded_rows(frame: DataFrame, keep: int, name: str) -> DataFrame:
    """`id, h1, h2, code, unit, lost, length` of the rows with the `keep` smallest ids of each vector, told apart by 128 bits of hash.

    Only codes and hashes are moved, of a vector that very many rows share a few from each task.
    """
    rows = frame.select("id", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), coded(F.col("embedding")).alias("c"))
    rank = F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))
    kept = rows.select("id", "h1", "h2", "c.*").withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")
    return materialize(kept, name)


def rerank(pairs: DataFrame, queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The k nearest of the candidate `rep, id` pairs of each query by the exact distance of whole vectors."""
    of_index = index.select("id", F.col("embedding").alias("_b"))
    of_query = queries.select(F.col("id").alias("rep"), F.col("embedding").alias("_a"))
    whole = pairs.select("rep", "id").join(of_index, "id").join(of_query, "rep")
    return _top(whole.select("rep", "id", exact_distance(F.col("_a"), F.col("_b")).alias("distance")), k)


PACKED = "block bigint, least double, most double, ids binary, code binary, unit binary, lost binary, length binary"
CANDIDATES = "rep bigint, id bigint, low double, high double"


def _packed(rows: DataFrame, parts: int, name: str) -> DataFrame:
    """Blocks of rows of like length, a block in one row; `least` and `most` bound the lengths of its whole vectors.

    What is no point is near nothing, and in no block; rows without an id cannot be found either.
    """
    most_rows, most_bytes = BLOCK_ROWS, BLOCK_BYTES
    rows = rows.where(F.col("id").isNotNull() & (F.col("length") + F.col("lost") < F.lit(float("inf")))).select("id", "code", "unit", "lost", "length")
    rows = rows.repartitionByRange(parts, "length", "id").sortWithinPartitions("length", "id")

    def run(batches):
        held, count, number = [], 0, 0
        for batch in batches:
            while batch.num_rows:
                # As many rows as the block has room for; vectors are of one length.
                size = max(1, min(most_rows, most_bytes // max(1, len(batch.column("code")[0].as_py()))))
                held.append(batch.slice(0, size - count))
                count, batch = count + held[-1].num_rows, batch.slice(size - count)
                if count >= size:
                    yield _pack(held, number)
                    held, count, number = [], 0, number + 1
        if held:
            yield _pack(held, number)

    return materialize(rows.mapInArrow(run, PACKED), name)


def _pack(batches, number: int):
    wide = lambda c, kind: np.concatenate([b.column(c).to_numpy() for b in batches]).astype(kind)
    ids, (unit, lost, length) = wide("id", "<i8"), (wide(c, "<f8") for c in ("unit", "lost", "length"))
    row = {
        "block": (TaskContext.get().partitionId() << 20) + number, "least": float((length * (1 - SLACK) - lost).min()), "most": float((length * (1 + SLACK) + lost).max()),
        "ids": ids.tobytes(), "code": b"".join(c for b in batches for c in b.column("code").to_pylist()),
        "unit": unit.tobytes(), "lost": lost.tobytes(), "length": length.tobytes(),
    }
    return _arrow_row(row)


def _arrow_row(row: dict):
    kinds = {int: pa.int64(), float: pa.float64(), bytes: pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[type(v)]) for v in row.values()], list(row))


def _block_pairs(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of packed blocks that meet, of the right side as `of_...`: both tables are read where they meet, nothing is shuffled or broadcast."""
    return left.join(right.select(*[F.col(c).alias(f"of_{c}") for c in right.columns]).hint("shuffle_replicate_nl"), on)


def _of_right(row: dict) -> dict:
    return {c[3:]: v for c, v in row.items() if c.startswith("of_")}


def _hits_of(search: _Search):
    q, ids, low, high = search.hits()
    for at in range(0, len(q), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(search.asked.ids[q[part]]), pa.array(ids[part]), pa.array(low[part]), pa.array(high[part])], ["rep", "id", "low", "high"])


def _first_search(k: int):
    """Each block of queries with what its first block of rows has for it, and the lengths in reach of that."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                search = _Search(_Block.unpacked(row), k)
                search.look(_Block.unpacked(_of_right(row)))
                asked = search.asked
                reach = np.sqrt(search.edge + TIE) + asked.lost + SLACK * asked.length
                q, ids, low, high = search.hits()
                yield _arrow_row({c: row[c] for c in ("block", "first", "ids", "code", "unit", "lost", "length")} | {
                    "from": float((asked.length - reach).min()), "to": float((asked.length + reach).max()), "edge": search.edge.astype("<f8").tobytes(),
                    "reps": asked.ids[q].tobytes(), "rows": ids.tobytes(), "low": low.tobytes(), "high": high.tobytes(),
                })

    return run


def _other_search(k: int):
    """The same for all blocks of rows that a task reads for a block of queries, together."""

    def run(batches):
        block = search = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    if search:
                        yield from _hits_of(search)
                    block, search = row["block"], _Search(_Block.unpacked(row), k, np.frombuffer(row["edge"], "<f8"))
                search.look(_Block.unpacked(_of_right(row)))
        if search:
            yield from _hits_of(search)

    return run


def _unpacked_hits(batches):
    for batch in batches:
        for row in batch.to_pylist():
            wide = [np.frombuffer(row[c], kind) for c, kind in (("reps", "<i8"), ("rows", "<i8"), ("low", "<f8"), ("high", "<f8"))]
            for at in range(0, len(wide[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in wide], ["rep", "id", "low", "high"])


def _candidates(reps: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """`rep, id, low, high`: what may be among the k nearest `rows` of each of `reps`, with bounds on its squared distance."""
    spark = reps.sparkSession
    small_batches(spark)  # a batch holds the blocks of one meeting
    a, b = grid(reps.count(), rows.count(), spark.sparkContext.defaultParallelism)
    asked, held = _packed(reps, a, "query-blocks"), _packed(rows, b, "row-blocks")
    # One row for each block, with the bounds of its lengths.
    lengths = [[(r["block"], r["least"], r["most"]) for r in blocks.select("block", "least", "most").collect()] for blocks in (asked, held)]
    if not all(lengths):
        return spark.createDataFrame([], CANDIDATES)
    number, least, most = (np.array(x) for x in zip(*lengths[1]))
    middle = [(low + high) / 2 for _, low, high in lengths[0]]
    first = [number[np.argmin(np.maximum(np.maximum(least - m, m - most), 0.0) + 1e-9 * np.abs((least + most) / 2 - m))] for m in middle]
    chosen = spark.createDataFrame([(block, int(f)) for (block, _, _), f in zip(lengths[0], first)], "block bigint, first bigint")
    asked = asked.join(F.broadcast(chosen), "block").select("block", "first", "ids", "code", "unit", "lost", "length")
    schema = "block bigint, first bigint, ids binary, code binary, unit binary, lost binary, length binary, `from` double, `to` double, edge binary, reps binary, rows binary, low binary, high binary"
    begun = _block_pairs(asked, held, F.col("first") == F.col("of_block")).mapInArrow(_first_search(k), schema)
    begun = materialize(begun, "begun")
    found = begun.select("reps", "rows", "low", "high").mapInArrow(_unpacked_hits, CANDIDATES)
    if len(number) > 1:
        left = begun.select("block", "first", "from", "to", "ids", "code", "unit", "lost", "length", "edge")
        in_reach = (F.col("of_block") != F.col("first")) & (F.col("of_least") <= F.col("to")) & (F.col("of_most") >= F.col("from"))
        found = found.unionByName(_block_pairs(left, held, in_reach).mapInArrow(_other_search(k), CANDIDATES))
    return found


def nearest(queries: DataFrame, index: DataFrame, k: int = config.NEIGHBOURS, exclude_self: bool = False) -> DataFrame:
    """The exact k nearest index rows (squared L2, ties to the smaller id) of every query.

    Cost, with q queries, n index rows, d dimensions and a x b blocks of `grid`: q * n * d multiplications, less
    what lengths put out of reach; written are (2 d + 32 bytes) * (n + 2 q) as codes, candidates (a query has
    little more than k of each task that reads index blocks for it, and of those k in the end), and d * 4 bytes
    for each of the last as whole vectors. Blocks are read a and b times, and not written again.
    """
    wanted = k + 1 if exclude_self else k
    rows = _coded_rows(index, wanted, "coded")
    reps = _coded_rows(queries, 1, "coded-queries")
    met = materialize(_candidates(reps, rows, wanted), "candidates")
    rank = F.row_number().over(W.partitionBy("rep").orderBy("high"))
    edge = met.select("rep", "high").withColumn("_rank", rank).where(F.col("_rank") <= wanted).groupBy("rep").agg(F.max("high").alias("edge"))
    pairs = met.join(edge, "rep").where(F.col("low") <= F.col("edge") + TIE)
    hits = rerank(pairs, queries, index, wanted)
    of_vector = reps.select("h1", "h2", F.col("id").alias("rep"))
    own = queries.select("id", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")).join(of_vector, ["h1", "h2"])
    return _ranked(own.select(F.col("id").alias("query_id"), "rep"), hits, k, exclude_self)


def sign_planes(tables: int, bits: int, dims: int, seed) -> np.ndarray:
    """Planes of signs, each from a digest of its place, so that they can be made anew anywhere."""
    sign = lambda *place: 1.0 if hashlib.md5(":".join(map(str, (seed, *place))).encode()).hexdigest()[0] < "8" else -1.0
    return np.array([[[sign(t, b, d) for d in range(dims)] for b in range(bits)] for t in range(tables)])


def _signatures(planes, probe: bool = False):
    """Cell numbers of a vector: in each table the signs of its projections; with `probe` also those one sign away."""
    tables, bits, _ = planes.shape
    weights = 1 << np.arange(bits)
    flips = np.r_[0, weights] if probe else np.zeros(1, dtype=int)

    def compute(vectors):
        if vectors.empty:
            return pd.Series([], dtype=object)
        signs = np.einsum("nd,tbd->ntb", _stack(vectors), planes) > 0
        codes = (signs @ weights)[:, :, None] ^ flips[None, None, :]
        cells = codes + (np.arange(tables) << bits)[None, :, None]
        return pd.Series(list(cells.reshape(len(cells), -1).astype("int32")))

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        return _by_slices(compute, vectors)

    return cells


def nearest_approx(
    queries: DataFrame, index: DataFrame, k: int = config.NEIGHBOURS, exclude_self: bool = False,
    tables: int = TABLES, bits: int = BITS, seed=config.SEED,
) -> DataFrame:
    """Approximate neighbours: hyperplane signatures (Charikar 2002) as cells, probed with their neighbours.

    An index row is in one cell of each table; a query visits its own cell and those whose signature
    differs in one bit. The settings never depend on the number of rows: a neighbour is found with a
    probability that its angle alone decides, and about tables * (bits + 1) / 2^bits of the index is
    compared (6 % by default). More bits compare less, more tables find more. The block search is the
    exact one, so hot signatures are cut into blocks, not dropped.
    """
    wanted = k + 1 if exclude_self else k
    rows = _without_copies(index, wanted)
    some = index.select("embedding").first()
    if some is None:
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, distance double")
    planes = sign_planes(tables, bits, len(some["embedding"]), seed)
    celled = materialize(rows.withColumn("cell", F.explode(_signatures(planes)("embedding"))), "signed")
    visits = materialize(_distinct_queries(queries).withColumn("cells", _signatures(planes, probe=True)("embedding")), "visits")
    hits = search_cells(visits, celled, wanted, group_shift=max(0, bits - GROUP_BITS)).dropDuplicates(["rep", "id"])
    return _answers(queries, visits.select("rep", "embedding"), _top(hits, wanted), k, exclude_self)


def neighbour_price(neighbours: DataFrame) -> DataFrame:
    """Inverse-distance mean of the neighbours' prices per query."""
    w = 1 / (F.col("distance") + F.lit(1e-9))
    return neighbours.groupBy("query_id").agg((F.sum(w * F.col("price")) / F.sum(w)).alias("guess"))


def neighbour_lists(neighbours: DataFrame) -> DataFrame:
    """Per query the ordered array of struct<document, price>; k entries at most."""
    entries = F.array_sort(F.collect_list(F.struct("rank", "document", "price")))
    ordered = F.transform(entries, lambda e: F.struct(e["document"].alias("document"), e["price"].alias("price")))
    return neighbours.groupBy("query_id").agg(ordered.alias("neighbours"))


def category_color(category):
    """Plot colour of a category by its position."""
    colors = F.create_map(*[F.lit(x) for pair in zip(config.CATEGORIES, config.CATEGORY_COLORS) for x in pair])
    return F.try_element_at(colors, category)

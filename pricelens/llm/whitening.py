"""Whitening of vectors along their leading principal components, found by spectrum slicing.

The counts of positive pivots in an LDL^T factorisation of V - s*I tell how many eigenvalues of V lie
above s (Sylvester's law of inertia). Bisection by such counts isolates the k-th largest eigenvalue in an
interval of its own; Rayleigh quotient iteration, which converges cubically, takes it to double
precision; and two more counts, just below and just above the result, certify that it is the k-th. The
matrix has a row per dimension, whatever the number of vectors, so this part runs on the driver.

Everything that grows with the table is a Spark job: the distinct vectors, their sums, the centred
products and the projections.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import materialize

COMPONENTS, STEPS = 4, 256
EPS = float(np.finfo(float).eps)
# Vectors multiplied at once.
BLOCK = 1 << 14


def inertia(matrix) -> tuple[int, int, int]:
    """Positive, negative and zero pivots of LDL^T with the pivots of Bunch and Kaufman (1977)."""
    rest, counts = np.array(matrix, float), [0, 0, 0]
    alpha = (1 + math.sqrt(17)) / 8
    while len(rest):
        column = np.abs(rest[1:, 0])
        most = column.max() if len(column) else 0.0
        own, pair, swap = abs(rest[0, 0]), False, 0
        if own < alpha * most:
            r = 1 + int(column.argmax())
            across = np.abs(rest[r]).copy()
            across[r] = 0
            if own * across.max() < alpha * most * most:
                swap = r
                pair = abs(rest[r, r]) < alpha * across.max()
        at = 1 if pair else 0
        if swap and swap != at:
            rest[[at, swap]] = rest[[swap, at]]
            rest[:, [at, swap]] = rest[:, [swap, at]]
        if pair:  # such a block has one eigenvalue of either sign
            counts[0] += 1
            counts[1] += 1
            below = rest[2:, :2]
            rest = rest[2:, 2:] - below @ np.linalg.solve(rest[:2, :2], below.T)
        else:
            pivot = rest[0, 0]
            counts[0 if pivot > 0 else 1 if pivot < 0 else 2] += 1
            below = rest[1:, 0]
            rest = rest[1:, 1:] - np.outer(below, below / pivot) if pivot else rest[1:, 1:]
    return tuple(counts)


def above(matrix, shift: float) -> int:
    """How many eigenvalues are greater than `shift`."""
    return inertia(matrix - shift * np.eye(len(matrix)))[0]


def _refined(matrix, shift, found, scale):
    """Two steps of inverse iteration at `shift`, then Rayleigh quotient iteration: value, vector, residual."""
    d = len(matrix)
    known = np.array(found).reshape(-1, d)
    vector = np.cos(1.0 + np.arange(d) ** 2)  # of no direction in particular
    best = (math.inf, 0.0, vector)
    for turn in range(40):
        vector = vector - known.T @ (known @ vector)
        vector = vector / np.linalg.norm(vector)
        value = float(vector @ matrix @ vector)
        residual = float(np.linalg.norm(matrix @ vector - value * vector))
        if residual < best[0]:
            best = (residual, value, vector)
        elif turn > 4:
            break
        at = shift if turn < 2 else value
        for nudge in (0.0, EPS * scale, 16 * EPS * scale):
            try:
                after = np.linalg.solve(matrix - (at + nudge) * np.eye(d), vector)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(after).all() and np.linalg.norm(after):
                vector = after
                break
        else:
            break
    return best[1], best[2], best[0]


def leading(matrix, count: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """The `count` largest eigenvalues above rounding error with their unit vectors, by falling eigenvalue.

    Equal eigenvalues can't be isolated: where an interval has shrunk to rounding error, the vectors inside
    it are any that are orthogonal to those found before. The largest entry of a vector is positive.
    """
    matrix = (matrix + matrix.T) / 2
    d = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    rounding = 8 * d * EPS * scale
    counts = {}

    def count_above(shift):
        if shift not in counts:
            counts[shift] = above(matrix, shift)
        return counts[shift]

    out = []
    for k in range(1, min(count, d) + 1):
        if not scale or count_above(rounding) < k:
            break
        lo, hi = rounding, scale * (1 + EPS) + rounding
        for s, n in counts.items():  # what is known from the components before
            lo, hi = (max(lo, s), hi) if n >= k else (lo, min(hi, s))
        for _ in range(STEPS):
            alone = count_above(lo) == k and (hi >= scale or count_above(hi) == k - 1)
            close = hi - lo <= 2 * rounding
            if alone or close:
                value, vector, residual = _refined(matrix, (lo + hi) / 2, [v for _, v in out], scale)
                margin = max(4 * residual, rounding)
                if residual <= rounding and count_above(value - margin) >= k and count_above(value + margin) <= k - 1:
                    out.append((value, vector * np.sign(vector[np.abs(vector).argmax()])))
                    break
                if close and residual > rounding:
                    raise ArithmeticError(f"component {k} does not converge")
            middle = (lo + hi) / 2
            lo, hi = (middle, hi) if count_above(middle) >= k else (lo, middle)
        else:
            raise ArithmeticError(f"component {k} can't be certified")
    return out


def quantised(rows: DataFrame, *, vector="embedding", key="vec_id") -> DataFrame:
    """`key, x` of the rows that remain: x = floor(256 * entry) as long."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))
    entries = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = rows.select(F.col(key).alias("key"), entries.alias("entries")).where(F.forall("entries", finite) & (F.size("entries") > 0))
    good = good.select("key", F.transform("entries", lambda c: F.floor(c * 256)).alias("x"))
    sizes = good.groupBy(F.size("x").alias("d")).count()
    d = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return good.where(F.size("x") == (d["d"] if d else 0))


def matrix_of(column) -> np.ndarray:
    values = column.flatten().to_numpy()
    return values.reshape(len(column), -1)


def _blocks(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            if part.num_rows:
                yield part, matrix_of(part.column("x"))


def _wide(values, rows: int) -> bool:
    """Whether sums of `rows` of these longs may leave 63 bits."""
    return float(np.abs(values.astype(float)).max(initial=0.0)) * max(rows, 1) >= 2.0**62


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def run(batches):
        n, total = 0, None
        for _, x in _blocks(batches):
            part = x.astype(object).sum(axis=0) if _wide(x, len(x)) else x.sum(axis=0).astype(object)
            n, total = n + len(x), part if total is None else total + part
        if total is not None:
            dims = pa.array(range(-1, len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([dims, pa.array([str(n), *map(str, total)])], ["dim", "total"])

    parts = fit.select("x").mapInArrow(run, "dim int, total string")
    rows = parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {r["dim"]: int(r["total"]) for r in rows}
    return found.get(-1, 0), [found[i] for i in range(len(found) - 1)]


def products(fit: DataFrame, transform) -> dict[tuple[int, int], float]:
    """Sums over all vectors of the products of the entries i <= j of `transform(x)`, which are centred."""

    def run(batches):
        total = None
        for _, x in _blocks(batches):
            y = transform(x)
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "total"])

    parts = fit.select("x").mapInArrow(run, "i int, j int, total double")
    return {(r["i"], r["j"]): r["total"] for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}


def covariance(fit: DataFrame, n: int, d: int, transform) -> np.ndarray:
    out = np.zeros((d, d))
    for (i, j), total in products(fit, transform).items():
        out[i, j] = out[j, i] = total / n
    return out


def deviations(x, n: int, total: list[int]) -> pa.Array:
    """Sum over dimensions of (n * x - S)^2, exact; null where that is no long."""
    most = max((n * int(np.abs(x.astype(float)).max(initial=0.0)) + max(map(abs, total), default=0)), 1)
    if most * most * x.shape[1] < 1 << 62:
        off = n * x - np.array(total, np.int64)
        return pa.array((off * off).sum(axis=1), pa.int64())
    off = n * x.astype(object) - np.array(total, object)
    return pa.array([v if v < 1 << 63 else None for v in (off * off).sum(axis=1)], pa.int64())


def whiten(rows: DataFrame, *, vector="embedding", key="vec_id", components=COMPONENTS) -> DataFrame:
    """`key, component, n, deviation, whitened, explained, identity_error` of every remaining row and component.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are those
    of another length than most vectors have (ties: the longer). The model is fitted on each distinct
    quantised vector once; every remaining row is projected, repeated ones and null keys too.
    Components without variance beyond rounding error are left out; a table with none (no row, or all
    vectors equal) gives no rows. Entries too large for a long count as the largest long; `deviation` is
    null where it is no long. Other columns are not read.
    """
    spark = rows.sparkSession
    good = quantised(rows, vector=vector, key=key)
    key_type = good.schema["key"].dataType.simpleString()
    schema = f"key {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    # A vector that very many rows share leaves each map task once.
    fit = materialize(good.select("x").distinct(), "whitening-fit")
    n, total = sums(fit)
    d = len(total)
    mean = np.array([s / n for s in total])
    spread = covariance(fit, n, d, lambda x: x - mean)
    found = leading(spread, components) if d else []
    if not found:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    values = np.array([e for e, _ in found])
    basis = np.stack([v for _, v in found], axis=1) / np.sqrt(values)
    error = covariance(fit, n, len(values), lambda x: (x - mean) @ basis) - np.eye(len(values))
    identity_error, explained = float(np.abs(error).max()), values / np.trace(spread)

    def run(batches):
        m = len(values)
        for part, x in _blocks(batches):
            again = pa.array(np.repeat(np.arange(len(x)), m))
            columns = [
                part.column("key").take(again), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * m, n, np.int64)), deviations(x, n, total).take(again),
                pa.array(((x - mean) @ basis).ravel()), pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(x) * m, identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.mapInArrow(run, schema).withColumnRenamed("key", key)

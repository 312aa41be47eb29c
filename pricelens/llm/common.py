"""What several operators of this package share."""

import functools

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelens.session import materialize, scratch_path, small_batches

__all__ = ["materialize", "scratch_path", "small_batches"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of a query, whose session gets small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; every machine has the library installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def bounded(frame: DataFrame, rows: int) -> DataFrame:
    """`frame` for one side of a join: broadcast if its rows, counted first, are no more than `rows`; else left to be shuffled."""
    return F.broadcast(frame) if frame.count() <= rows else frame


def batches_of(batches, column: str, most_bytes: int):
    """Arrow batches cut so that `column` (strings or binaries) holds at most `most_bytes`, or one row."""
    for batch in batches:
        total, rows = batch.column(column).nbytes, batch.num_rows
        if total <= most_bytes or rows <= 1:
            if rows:
                yield batch
            continue
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held + n > most_bytes and i > start:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def gathered(batches, column: str, bytes_held: int):
    """Arrow batches put together up to about `bytes_held` of `column`, or cut down to it."""
    held, size = [], 0
    for batch in batches_of(batches, column, bytes_held):
        n = batch.column(column).nbytes
        if held and size + n > bytes_held:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.concat_batches(held)


def carried(rows: DataFrame, text: str, carry):
    """`rows` as `_text` and `_carry_i` for a function over Arrow batches: the frame, and for each of `carry` the
    column it is in (a text that is carried is sent once), with its type."""
    at = {c: "_text" if c == text else f"_carry_{i}" for i, c in enumerate(carry)}
    frame = rows.select(F.col(text).alias("_text"), *[F.col(c).alias(a) for c, a in at.items() if a != "_text"])
    return frame, [(c, a, frame.schema[a].dataType.simpleString()) for c, a in at.items()]


def renamed(out: DataFrame, held, *more):
    """The carried columns under their own names, and those of `more`."""
    return out.select(*[F.col(f"_out_{i}").alias(c) for i, (c, _, _) in enumerate(held)], *more)


def schema_of(held, more: str) -> str:
    return ", ".join([*(f"_out_{i} {kind}" for i, (_, _, kind) in enumerate(held)), more])


def arrow_of(batch, held, columns: dict):
    """An Arrow batch of the carried columns and `columns`."""
    arrays = [batch.column(a) for _, a, _ in held] + list(columns.values())
    return pa.RecordBatch.from_arrays(arrays, [f"_out_{i}" for i in range(len(held))] + list(columns))


def once(build):
    """Keep what `build(*args)` returns in this Python process: models and tokenizers are loaded once a worker."""
    return functools.cache(build)

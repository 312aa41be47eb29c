"""Token counts by a two-tier lookup on the map side.

A tokenizer that never joins characters across a space can be asked once per pre-token. The lengths
of the most frequent pre-tokens are worked out once and broadcast as a compact hash table; what it
lacks is encoded and remembered in a cache of each Python worker. Pre-tokens are never shuffled:
the first pass sends a bounded summary per task, the second pass only counts.
"""

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import batches_of, once

# A pre-token is a run of spaces with what follows up to the next space or line feed, or a line
# feed with what follows. Neither a space behind another character nor a line feed is inside any
# piece of the vocabulary (`check_vocabulary`), so no merge crosses these borders.
PRE_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")
# Bounds of the broadcast table: 65,536 pre-tokens of at most 64 characters, 17 MB at the very most.
TABLE_ROWS, TABLE_CHARS = 1 << 16, 64
# Bounds of a task's summary and of a worker's cache, in pre-tokens.
SUMMARY_ROWS, COUNTER_ROWS, CACHE_ROWS, CACHE_CHARS = 1 << 13, 1 << 18, 1 << 19, 256


@once
def processor(path: str):
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    check_vocabulary(found)
    return found


def check_vocabulary(found) -> None:
    """Raise where a piece crosses a pre-token border, for then lengths of pre-tokens don't add up."""
    for i in range(found.vocab_size()):
        piece = found.id_to_piece(i)
        if "\n" in piece or "▁" in piece.lstrip("▁"):
            raise ValueError(f"piece {piece!r} crosses pre-tokens; this lookup can't be used with the vocabulary")


def split(text: str) -> list[str]:
    # The processor writes a space as U+2581 and puts one in front of the text.
    return PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


def lengths(path: str, pre_tokens: list[str]) -> list[int]:
    """Tokens of each pre-token. The processor adds a space in front: it stands for the first one of a
    pre-token that begins with a space, and is one token more before a line feed."""
    texts = [p[1:] if p[0] == " " else p for p in pre_tokens]
    encoded = processor(path).encode(texts, num_threads=1)
    # An empty text gets no space in front, but a lone space is one token.
    return [(len(e) or 1) if p[0] == " " else len(e) - 1 for p, e in zip(pre_tokens, encoded)]


def frequent(docs: DataFrame, path: str, text="text") -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of all rows.

    Every task keeps a bounded counter (the rarer half goes when it is full) and reports its top
    entries; only these are added up. The choice steers speed alone, never a count.
    """

    def summarise(batches):
        counts = Counter()
        for batch in batches_of(batches, "text", 32 << 20):
            for value in batch.column("text"):
                counts.update(split(value.as_py() or ""))
                if len(counts) > COUNTER_ROWS:
                    counts = Counter(dict(counts.most_common(COUNTER_ROWS // 4)))
        top = [(k, n) for k, n in counts.most_common(SUMMARY_ROWS) if n > 1 and len(k) <= TABLE_CHARS]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["pre", "n"]
        )

    def measure(batches):
        for batch in batches:
            pre = batch.column("pre")
            yield pa.RecordBatch.from_arrays([pre, pa.array(lengths(path, pre.to_pylist()), pa.int32())], ["pre", "tokens"])

    seen = docs.select(F.col(text).alias("text")).mapInArrow(summarise, "pre string, n long")
    top = seen.groupBy("pre").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pre").limit(TABLE_ROWS)
    return {r.pre: r.tokens for r in top.select("pre").mapInArrow(measure, "pre string, tokens int").collect()}


def count_tokens(docs: DataFrame, path: str, *, text="text", key="doc_id", limit=4096) -> DataFrame:
    """`key, n_bytes, n_tokens, over_limit` of every row, in one map-side pass behind the table's own.

    `path` is a sentencepiece model. Null and empty texts have no bytes and no tokens. Repeated rows
    are counted each; other columns of `docs`, whatever their names, are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text))
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).alias("text"),
    )
    key_type = rows.schema["key"].dataType.simpleString()

    def count(batches):
        table, cache = known.value, _cache(path)
        for batch in batches_of(batches, "text", 32 << 20):
            found = []
            for value in batch.column("text"):
                pre_tokens = split(value.as_py() or "")
                try:
                    found.append(sum([table[p] if p in table else cache[p] for p in pre_tokens]))
                except KeyError:
                    found.append(_with_misses(path, table, cache, pre_tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n_bytes"), pa.array(found, pa.int64())], ["key", "n_bytes", "n_tokens"]
            )

    counted = rows.mapInArrow(count, f"key {key_type}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


@once
def _cache(path: str) -> dict[str, int]:
    return {}


def _with_misses(path, table, cache, pre_tokens) -> int:
    """Encode what neither tier has; pre-tokens too long to be kept are encoded where they stand."""
    misses = list({p for p in pre_tokens if p not in table and p not in cache})
    own = dict(zip(misses, lengths(path, misses)))
    total = sum([table[p] if p in table else cache[p] if p in cache else own[p] for p in pre_tokens])
    if len(cache) + len(own) > CACHE_ROWS:
        cache.clear()
    cache.update((p, n) for p, n in own.items() if len(p) <= CACHE_CHARS)
    return total

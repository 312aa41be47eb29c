"""Removal of repeated byte strings by suffix arrays of shards.

A byte goes where a string of `LENGTH` bytes that covers it also starts earlier. Equal strings have to
meet, wherever they stand, without shipping every string: a window of LENGTH bytes is represented by
the smallest hash among the K-byte strings inside it. Equal windows have the same one at the same
place, and neighbouring windows mostly share it, so each run of windows with one representative is
sent once, as a segment of bytes, to the route of that representative. Within a batch of documents,
equal segments are sent once; the later ones are known to be repeated.

A route cuts its segments into shards. Each shard gets a suffix array (Larsson-Sadakane: suffixes are
sorted by eight bytes, then groups of equals are sorted by the rank of what follows, doubling the
depth) and common prefixes (Kasai). Neighbours with LENGTH bytes in common are equal windows. Where
the segments of one representative fill more than a shard, the sorted windows of its shards are
merged by binary search.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import gathered, once

LENGTH, K = 100, 32
SPAN = LENGTH - K + 1  # K-byte strings in a window
# Bytes of documents in a batch, of texts hashed at once, and of a shard.
BATCH_BYTES, BLOCK_BYTES, SHARD_BYTES = 16 << 20, 1 << 20, 2 << 20
# Text of all documents for each route; the segments that a route is dealt of it are held at once.
ROUTE_BYTES = 8 << 20
PLACE_BITS = np.uint64(24)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_TABLE = np.random.default_rng(6).integers(1, 1 << 63, (2, 256), np.uint64)
END = 0xFF  # no byte of UTF-8


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def segments(codes, ends):
    """Runs of windows with one representative: start of each, number of windows, hash of the representative.

    `codes` are the bytes of documents one after another, `ends` where each ends. No window crosses an end.
    A place has PLACE_BITS, so longer bytes are taken in blocks that overlap by all but one byte of a window:
    each window is in one block.
    """
    ends = np.asarray(ends, np.int64)
    size = 1 << int(PLACE_BITS)
    if len(codes) <= size:
        return _block_segments(codes, ends)
    parts = []
    for low in range(0, len(codes) - LENGTH + 1, size - LENGTH + 1):
        high = min(low + size, len(codes))
        inside = ends[(ends > low) & (ends < high)]
        starts, windows, h = _block_segments(codes[low:high], np.r_[inside, high] - low)
        parts.append((starts + low, windows, h))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _block_segments(codes, ends):
    count = len(codes) - LENGTH + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    h = _TABLE[0][codes]
    step = 1
    while step < K:  # the hash of 2n bytes from those of n
        h = h[:-step] * (_A + np.uint64(2 * step)) + h[step:]
        step *= 2
    h = _mixed(h)
    ranked = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    least, step = ranked, 1
    while 2 * step <= SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[:count], least[SPAN - step: SPAN - step + count])
    owner_end = np.repeat(ends, np.diff(np.r_[0, ends]))[:count]
    valid = np.arange(count) + LENGTH <= owner_end
    changes = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]) | (owner_end[1:] != owner_end[:-1])])
    windows = np.diff(np.r_[changes, count])
    held = valid[changes]
    starts = changes[held]
    at = (least[starts] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    return starts, windows[held], h[at]


def content_hashes(codes, starts, lengths):
    """Two 64-bit hashes of each byte string, from running sums of byte values times powers.

    Strings are ascending by start and taken in blocks, which bounds the sums held at once.
    """
    out = [np.zeros(len(starts), np.uint64) for _ in range(2)]
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK_BYTES)))
        low, high = int(starts[at]), int((starts[at:stop] + lengths[at:stop]).max())
        begin, size = starts[at:stop] - low, lengths[at:stop]
        for k, base in enumerate((_A, _B)):
            powers, inverses = _powers(int(base), high - low)
            sums = np.r_[np.uint64(0), np.add.accumulate(_TABLE[k][codes[low:high]] * powers)]
            out[k][at:stop] = _mixed((sums[begin + size] - sums[begin]) * inverses[begin])
        at = stop
    return out


def _powers(base: int, count: int):
    held = _powers_of(base)
    while len(held[0]) < count:
        held[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(2 * count - 1, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64))]
    return held[0][:count], held[1][:count]


@once
def _powers_of(base: int) -> list:
    return [np.ones(1, np.uint64)] * 2


def gather(codes, starts, lengths):
    """The byte strings one behind another."""
    lengths = np.asarray(lengths, np.int64)
    begin = np.cumsum(lengths) - lengths
    return codes[np.repeat(starts - begin, lengths) + np.arange(int(lengths.sum()))]


def same(*columns):
    """For sorted columns: whether each row equals the one before it."""
    equal = np.ones(len(columns[0]), bool)
    equal[:1] = False
    for c in columns:
        equal[1:] &= c[1:] == c[:-1]
    return equal


def settle_copies(doc, key, start, windows, first, second):
    """Of equal segments: rows that are later copies, and rows that must be looked at further.

    A row is a later copy if an equal segment starts earlier. Rows of the same place and text (repeated
    rows) are looked at once.
    """
    order = np.lexsort((key, start, doc, windows, second, first))
    equal = same(first[order], second[order], windows[order])
    head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))
    later = (doc[order] != doc[order[head]]) | (start[order] != start[order[head]])
    repeated = equal & same(doc[order], start[order], key[order]) & ~later
    return order[later], order[~later & ~repeated]


def suffix_array(codes):
    """Positions of all suffixes in order."""
    n = len(codes)
    x = np.zeros(n + 8, np.uint64)
    x[:n] = codes
    for width in (1, 2, 4):
        x = (x[:-width] << np.uint64(8 * width)) | x[width:]
    x = x[:n]
    order = np.argsort(x)
    heads = np.where(same(x[order]), 0, np.arange(n))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(heads)
    depth = 8
    while depth < 2 * n:
        ranked = rank[order]
        new = ~same(ranked)
        alone = new & np.r_[new[1:], True]
        slots = np.flatnonzero(~alone)  # groups of equals; the others are in place for good
        if not len(slots):
            break
        places = order[slots]
        beyond = places + depth
        next_rank = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        both = (rank[places].astype(np.uint64) << np.uint64(32)) | next_rank.astype(np.uint64)
        turn = np.argsort(both)
        places, both = places[turn], both[turn]
        order[slots] = places
        rank[places] = np.maximum.accumulate(np.where(same(both), 0, slots))
        depth *= 2
    return order


def common_prefixes(codes, order, lanes):
    """Bytes that each suffix has in common with the one before it in `order`, by position.

    Kasai: a suffix keeps all but one of the bytes of the suffix that starts one byte before it. The
    lanes (starts of stretches that cover `codes`) go forward together, one byte at a time.
    """
    n = len(codes)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    padded = np.r_[codes, np.zeros(1, np.uint8)]
    out = np.zeros(n, np.int64)
    sizes = np.diff(np.r_[lanes, n])
    by_size = np.argsort(-sizes, kind="stable")
    lanes, sizes = lanes[by_size], sizes[by_size]
    length = np.zeros(len(lanes), np.int64)
    for j in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -j))  # lanes longer than j
        here = lanes[:live] + j
        there = before[here]
        length = np.where(there >= 0, np.maximum(length[:live] - 1, 0), 0)
        grow = np.flatnonzero(there >= 0)
        while len(grow):
            a, b = here[grow] + length[grow], there[grow] + length[grow]
            inside = (a < n) & (b < n)
            grow = grow[inside & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])]
            length[grow] += 1
        out[here] = length
    return out


def window_classes(codes, lanes, is_window):
    """Windows of a shard in order, and the number of the class of equal windows of each."""
    order = suffix_array(codes)
    prefix = common_prefixes(codes, order, lanes)[order]
    # A suffix that has LENGTH bytes in common with a window is a window too, as no window holds END.
    fresh = np.cumsum(prefix < LENGTH)
    held = is_window[order]
    places, numbers = order[held], fresh[held]
    return places, np.cumsum(~same(numbers)) - 1


def compare(codes, a, b):
    """Order of the windows at `a` and `b`: negative, zero or positive."""
    out = np.zeros(len(a), np.int8)
    open_ = np.arange(len(a))
    for j in range(LENGTH):
        x, y = codes[a[open_] + j], codes[b[open_] + j]
        out[open_] = np.sign(x.astype(np.int16) - y)
        open_ = open_[x == y]
        if not len(open_):
            break
    return out


def find(codes, ordered, wanted):
    """Binary search of the windows at `wanted` among the distinct windows at `ordered`: place, and whether equal."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(ordered))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        middle = (low[open_] + high[open_]) // 2
        less = compare(codes, ordered[middle], wanted[open_]) < 0
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
    equal = np.zeros(len(wanted), bool)
    inside = np.flatnonzero(low < len(ordered))
    equal[inside] = compare(codes, ordered[low[inside]], wanted[inside]) == 0
    return low, equal


def merged_classes(codes, shards):
    """Classes over the windows of several shards [(places, numbers)], numbered across them."""
    ordered, class_of, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    places_out, numbers_out = [], []
    for places, numbers in shards:
        heads = places[~same(numbers)]
        at, equal = find(codes, ordered, heads)
        numbered = np.empty(len(heads), np.int64)
        numbered[equal] = class_of[at[equal]]
        fresh = np.flatnonzero(~equal)
        numbered[fresh] = total + np.arange(len(fresh))
        total += len(fresh)
        ordered = np.insert(ordered, at[fresh], heads[fresh])
        class_of = np.insert(class_of, at[fresh], numbered[fresh])
        places_out.append(places)
        numbers_out.append(numbered[numbers])
    return np.concatenate(places_out), np.concatenate(numbers_out)


def repeated_windows(group, doc, start, windows, codes, begins, shard_bytes=SHARD_BYTES):
    """(row, window) of every window that also starts earlier, among distinct segments.

    Segments of one `group` (representative) are together in a shard, or in shards merged with each other.
    """
    order = np.argsort(group, kind="stable")
    head = np.flatnonzero(~same(group[order]))
    sizes = np.diff(np.r_[head, len(order)])
    lengths = windows + LENGTH - 1
    rows_out, windows_out = [], []

    def settle(rows, pieces):
        """Rows in pieces of one or more shards."""
        data, lanes = _laid_out(codes, begins[rows], lengths[rows])
        is_window = np.zeros(len(data), bool)
        is_window[gather(np.arange(len(data)), lanes, windows[rows])] = True
        owner = np.repeat(np.arange(len(rows)), lengths[rows] + 1)
        if len(pieces) == 1:
            places, numbers = window_classes(data, lanes, is_window)
        else:
            parts = []
            for a, b in pieces:
                low, high = lanes[a], lanes[b] if b < len(lanes) else len(data)
                found, own = window_classes(data[low:high], lanes[a:b] - low, is_window[low:high])
                parts.append((found + low, own))
            places, numbers = merged_classes(data, parts)
        row = rows[owner[places]]
        window = places - lanes[owner[places]]
        turn = np.lexsort((start[row] + window, doc[row], numbers))
        row, window, numbers = row[turn], window[turn], numbers[turn]
        head = np.maximum.accumulate(np.where(same(numbers), 0, np.arange(len(row))))
        later = (doc[row] != doc[row[head]]) | (start[row] + window != start[row[head]] + window[head])
        rows_out.append(row[later])
        windows_out.append(window[later])

    weight = np.add.reduceat(lengths[order] + 1, head) if len(head) else head
    usual = (sizes > 1) & (weight <= shard_bytes)
    shard_of = np.repeat(np.where(usual, np.cumsum(weight * usual) // shard_bytes, -1), sizes)
    rows = order[shard_of >= 0]
    cuts = np.flatnonzero(~same(shard_of[shard_of >= 0]))
    for low, high in zip(cuts, [*cuts[1:], len(rows)]):
        settle(rows[low:high], [None])
    for g in np.flatnonzero((sizes > 1) & (weight > shard_bytes)):
        rows = order[head[g]: head[g] + sizes[g]]
        part = (np.cumsum(lengths[rows] + 1) - 1) // shard_bytes
        marks = [*np.flatnonzero(~same(part)), len(rows)]
        settle(rows, list(zip(marks, marks[1:])))
    none = np.zeros(0, np.int64)
    return np.concatenate(rows_out or [none]), np.concatenate(windows_out or [none])


def _laid_out(codes, begins, lengths):
    """Segments one behind another, each closed by END, and where each begins."""
    lanes = np.cumsum(lengths + 1) - (lengths + 1)
    data = np.full(int((lengths + 1).sum()), END, np.uint8)
    data[gather(np.arange(len(data)), lanes, lengths)] = gather(codes, begins, lengths)
    return data, lanes


FIELDS = (("group", np.uint32), ("doc", np.int64), ("key", np.int64), ("start", np.int64), ("windows", np.int64))
# Level of compression of what is shuffled.
LEVEL = 6


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed_columns(columns: dict, spans) -> bytes:
    """Columns of segments, and spans already known, of one batch and route."""
    parts = [np.array([len(columns["doc"]), len(spans[0])], np.int64).tobytes()]
    parts += [np.ascontiguousarray(columns[name].astype(kind)).tobytes() for name, kind in FIELDS]
    parts += [np.ascontiguousarray(s, np.int64).tobytes() for s in spans]
    return packed(b"".join(parts))


def unpacked_columns(row: bytes):
    whole = unpacked(row)
    count, known = np.frombuffer(whole, np.int64, 2).tolist()
    at, columns = 16, {}
    for name, kind in FIELDS:
        columns[name] = np.frombuffer(whole, kind, count, at)
        at += columns[name].nbytes
    return columns, [np.frombuffer(whole, np.int64, known, at + i * 8 * known) for i in range(3)]


def batch_segments(ids, keys, texts: list[bytes]):
    """Segments of a batch of documents, copies within the batch settled: columns, bytes, and spans (key, from, to) known to go."""
    parts, blocks = [], []
    for docs in _blocks(texts):
        codes = np.frombuffer(b"".join(texts[i] for i in docs), np.uint8)
        sizes = np.array([len(texts[i]) for i in docs])
        ends = np.cumsum(sizes)
        starts, windows, h = segments(codes, ends)
        if not len(starts):
            continue
        local = np.searchsorted(ends, starts, "right")
        owner = np.asarray(docs)[local]
        first, second = content_hashes(codes, starts, windows + LENGTH - 1)
        parts.append((ids[owner], keys[owner], starts - (ends - sizes)[local], windows, h, first, second, starts, np.full(len(starts), len(blocks))))
        blocks.append(codes)
    if not parts:
        return None
    doc, key, start, windows, h, first, second, at, block = (np.concatenate(c) for c in zip(*parts))
    later, rest = settle_copies(doc, key, start, windows, first, second)
    spans = key[later], start[later], start[later] + windows[later] + LENGTH - 1
    rest = np.sort(rest)
    offset = np.cumsum([0] + [len(b) for b in blocks[:-1]])
    begins = at[rest] + offset[block[rest]]
    return {"doc": doc[rest], "key": key[rest], "start": start[rest], "windows": windows[rest], "hash": _mixed(h[rest] + _B)}, np.concatenate(blocks), begins, spans


def _blocks(texts):
    held, size = [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        if len(text) >= LENGTH:
            held.append(i)
            size += len(text)
    if held:
        yield held


def routed(rows: DataFrame, routes: int) -> DataFrame:
    """`route, columns, data`: of each batch of `rows` (key, id, text) what goes to each route."""

    def run(batches):
        for batch in gathered(batches, "text", BATCH_BYTES):
            ids = batch.column("id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            texts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in batch.column("text").to_pylist()]
            found = batch_segments(ids, keys, texts)
            if found is None:
                continue
            columns, codes, begins, spans = found
            route = ((columns["hash"] >> np.uint64(32)) % np.uint64(routes)).astype(np.int64)
            columns["group"] = columns.pop("hash").astype(np.uint32)
            of_span = spans[0].astype(np.uint64) % np.uint64(routes)
            order, span_order = np.argsort(route, kind="stable"), np.argsort(of_span, kind="stable")
            cuts = np.searchsorted(route[order], np.arange(routes + 1))
            span_cuts = np.searchsorted(of_span[span_order], np.arange(routes + 1, dtype=np.uint64))
            numbers, bodies, datas = [], [], []
            for r in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(span_cuts) > 0)).tolist():
                own, known = order[cuts[r]: cuts[r + 1]], span_order[span_cuts[r]: span_cuts[r + 1]]
                data = gather(codes, begins[own], columns["windows"][own] + LENGTH - 1)
                numbers.append(r)
                bodies.append(packed_columns({n: c[own] for n, c in columns.items()}, [s[known] for s in spans]))
                datas.append(packed(data.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(bodies, pa.binary()), pa.array(datas, pa.binary())], ["route", "columns", "data"])

    return rows.mapInArrow(run, "route long, columns binary, data binary")


def settle_route(bodies: list[tuple[bytes, bytes]], shard_bytes=SHARD_BYTES):
    """Spans (key, from, to) to remove, from all that one route has got: (columns, bytes) of each batch."""
    parts = [unpacked_columns(columns) for columns, _ in bodies]
    group, doc, key, start, windows = (np.concatenate([p[0][n] for p in parts]) for n, _ in FIELDS)
    spans = [[p[1][i] for p in parts] for i in range(3)]
    # Most representatives stand in one place only: their segments are left behind at once.
    order = np.argsort(group, kind="stable")
    equal = same(group[order])
    several = np.zeros(len(group), bool)
    several[order] = equal | np.r_[equal[1:], False]
    if several.any():
        data, at = [], 0
        for columns, body in bodies:
            count = np.frombuffer(unpacked(columns), np.int64, 1)[0]
            held, sizes = several[at: at + count], windows[at: at + count] + LENGTH - 1
            if held.any():
                data.append(gather(np.frombuffer(unpacked(body), np.uint8), (np.cumsum(sizes) - sizes)[held], sizes[held]))
            at += count
        data = np.concatenate(data)
        group, doc, key, start, windows = (x[several] for x in (group, doc, key, start, windows))
        lengths = windows + LENGTH - 1
        begins = np.cumsum(lengths) - lengths
        later, rest = settle_copies(doc, key, start, windows, *content_hashes(data, begins, lengths))
        for out, found in zip(spans, (key[later], start[later], start[later] + lengths[later])):
            out.append(found)
        row, window = repeated_windows(group[rest], doc[rest], start[rest], windows[rest], data, begins[rest], shard_bytes)
        turn = np.lexsort((window, row))
        row, window = row[turn], window[turn]
        # Neighbouring windows make one span.
        head = np.flatnonzero(~(same(row) & np.r_[False, window[1:] == window[:-1] + 1])) if len(row) else row
        tail = np.r_[head[1:], len(row)] - 1 if len(row) else row
        at = rest[row[head]]
        for out, found in zip(spans, (key[at], start[at] + window[head], start[at] + window[tail] + LENGTH)):
            out.append(found)
    return [np.concatenate(s) for s in spans]


def spans_to_remove(rows: DataFrame, routes: int) -> DataFrame:
    """`route, body`: places to remove, as packed numbers (key, from, to), dealt out by key."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for route, *body in zip(*(batch.column(c).to_pylist() for c in ("route", "columns", "data"))):
                held.setdefault(route, []).append(body)
        while held:
            spans = np.stack(settle_route(held.popitem()[1]))
            yield from dealt(spans[0], routes, lambda own: packed(spans[:, own].tobytes()))

    return routed(rows, routes).repartitionById(routes, F.col("route").cast("int")).mapInArrow(run, "route long, body binary")


def dealt(key, routes: int, body):
    """An Arrow batch with a row for each route: `body` of the positions whose key belongs to it."""
    route = (key.astype(np.uint64) % np.uint64(routes)).astype(np.int64)
    order = np.argsort(route, kind="stable")
    cuts = np.flatnonzero(~same(route[order]))
    if len(cuts):
        bodies = [body(order[a:b]) for a, b in zip(cuts, [*cuts[1:], len(order)])]
        yield pa.RecordBatch.from_arrays([pa.array(route[order[cuts]]), pa.array(bodies, pa.binary())], ["route", "body"])


def dealt_documents(rows: DataFrame, routes: int) -> DataFrame:
    """`route, body`: documents packed with others of their batch and route, as Arrow streams."""

    def run(batches):
        for batch in gathered(batches, "text", BATCH_BYTES):
            def body(own, batch=batch):
                sink = pa.BufferOutputStream()
                part = batch.take(pa.array(own))
                with pa.ipc.new_stream(sink, part.schema) as stream:
                    stream.write_batch(part)
                return packed(sink.getvalue().to_pybytes())

            yield from dealt(batch.column("key").to_numpy(), routes, body)

    return rows.mapInArrow(run, "route long, body binary")


def cut(text: bytes, ends) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs removed, and what is left; `ends` are rows (from, to)."""
    if not len(ends):
        return 0, 0, text
    ends = ends[np.argsort(ends[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ends[:, 1])
    fresh = np.r_[True, ends[1:, 0] > reach[:-1]]
    low, high = ends[fresh, 0], reach[np.r_[np.flatnonzero(fresh)[1:], len(ends)] - 1]
    kept = [text[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(text)])]
    return int((high - low).sum()), len(low), b"".join(kept)


def routes_of(docs: DataFrame, text: str) -> int:
    """As many routes as keep each at about ROUTE_BYTES of text, and no fewer than the shuffle partitions.

    The size of stored files is in the plan's statistics, and texts are about twice as long unpacked; rows of which
    the plan knows no size are added up.
    """
    size = 2 * int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // ROUTE_BYTES))


def remove_repeats(docs: DataFrame, *, text="text", key="doc_id", routes: int | None = None, with_text=False) -> DataFrame:
    """One row per row of `docs`: `key, n_bytes, n_removed, n_spans, kept_sha256`, and `kept` if asked for.

    Removed is every byte covered by LENGTH equal bytes that also start at a smaller key, or earlier in the
    same document. Null and empty texts and those under LENGTH bytes lose nothing by themselves. Keys are
    whole numbers, null the smallest; rows repeated with the same key and text are one document, and of
    different texts with one key neither is earlier at the same start. An empty table gives no rows; other
    columns are not read. `routes` (by default `routes_of`) sets how finely segments are dealt, a task for each.
    """
    routes = routes or routes_of(docs, text)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("id", "text").alias("key"), "id", "text")
    spans = spans_to_remove(rows, routes).withColumn("of_spans", F.lit(True))
    texts = dealt_documents(rows, routes).withColumn("of_spans", F.lit(False))
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches):
        spans: list[bytes] = []
        texts: list[bytes] = []
        for batch in batches:
            for of_spans, body in zip(batch.column("of_spans").to_pylist(), batch.column("body").to_pylist()):
                (spans if of_spans else texts).append(body)
        places = np.concatenate([np.frombuffer(unpacked(b), np.int64).reshape(3, -1) for b in spans] or [np.zeros((3, 0), np.int64)], axis=1)
        places = places[:, np.argsort(places[0], kind="stable")]
        for body in texts:
            part = pa.ipc.open_stream(unpacked(body)).read_all()
            keys = part.column("key").to_numpy()
            low, high = np.searchsorted(places[0], keys), np.searchsorted(places[0], keys, "right")
            out = []
            for t, a, b in zip(part.column("text").to_pylist(), low, high):
                data = t.encode("utf-8", "surrogatepass")
                removed, runs, kept = cut(data, places[1:, a:b].T)
                out.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [part.column("id").combine_chunks(), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    met = spans.unionByName(texts).repartitionById(routes, F.col("route").cast("int")).select("of_spans", "body")
    found = met.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return found.select(
        F.col("id").cast(key_type).alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])
    )

"""Exact, suffix-array and SimHash deduplication, and components."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pricelens.llm import exact, graph, simhash, suffix

from .conftest import HARD, documents, prose


def landed(docs, tmp_path, parts=3):
    path = str(tmp_path / "docs")
    docs.repartition(parts).write.parquet(path)
    return docs.sparkSession.read.parquet(path), path


def exact_truth(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    out = []
    for i, t, *_ in rows:
        norm = (t or "").encode().lower()
        keep = max([x for x in groups[norm] if x is not None], default=None)
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm).hexdigest()))
    return sorted(out, key=str)


def test_exact(spark, hard, tmp_path):
    docs, path = landed(hard, tmp_path)
    got = exact.deduplicate(docs, exact.arrivals(spark, path)).collect()
    assert sorted(map(tuple, got), key=str) == exact_truth(HARD)


def test_exact_over_many_batches(spark, tmp_path):
    rows = [(i, prose(i % 17), "en") for i in range(120)]
    docs, path = landed(documents(spark, rows), tmp_path, 6)
    got = exact.deduplicate(docs, exact.arrivals(spark, path, files_per_batch=1)).collect()
    assert sorted(map(tuple, got), key=str) == exact_truth(rows)


def test_exact_divides_a_collision(spark, tmp_path, monkeypatch):
    """With a digest that collides, full bytes tell the texts apart."""
    rows = [(i, f"text {i % 3}", "en") for i in range(12)]
    docs, path = landed(documents(spark, rows), tmp_path)
    flat = exact.with_digest
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact, "with_digest", lambda *a, **k: flat(*a, **k).withColumn("digest", F.lit("same")))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.deduplicate(docs, exact.arrivals(spark, path)).collect()}
    assert got == {i: (9 + i % 3, 4, i >= 9) for i in range(12)}


def test_exact_empty(spark, none, tmp_path):
    docs, path = landed(none, tmp_path, 1)
    assert exact.deduplicate(docs, exact.arrivals(spark, path)).collect() == []


def covered(docs, length=suffix.LENGTH):
    """Bytes to remove, string by string."""
    first = {}
    for d, t in docs:
        for p in range(len(t) - length + 1):
            w = t[p:p + length]
            first[w] = min(first.get(w, (d, p)), (d, p))
    out = []
    for d, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p:p + length]] < (d, p):
                gone[p:p + length] = True
        out.append(gone)
    return out


def expected_row(d, t, gone):
    kept = bytes(np.frombuffer(t, np.uint8)[~gone])
    return d, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()


def tangled(seed, count=60):
    r = random.Random(seed)
    rnd = lambda n: "".join(r.choice("abcdefé ") for _ in range(n))
    passages = [rnd(r.randint(60, 400)) for _ in range(5)] + ["ab" * r.randint(60, 300), "a" * r.randint(101, 400)]
    texts = ["".join(r.choice(passages)[r.randint(0, 20):] if r.random() < 0.5 else rnd(r.randint(1, 200)) for _ in range(r.randint(0, 6))) for _ in range(count)]
    return texts + [r.choice(texts) for _ in range(count // 6)]


def test_suffix_against_brute_force(spark):
    texts = tangled(4)
    docs = [(i, t.encode()) for i, t in enumerate(texts)]
    truth = sorted(expected_row(d, t, g) for (d, t), g in zip(docs, covered(docs)))
    frame = documents(spark, [(i, t, "en") for i, t in enumerate(texts)]).repartition(5)
    for routes in (1, 7):
        assert sorted(map(tuple, suffix.remove_repeats(frame, routes=routes).collect())) == truth


def test_suffix_routes_follow_the_bytes(spark, monkeypatch, tmp_path):
    """A phrase in a third of all texts; as many routes as bytes want, and a task for each of them."""
    phrase = "a phrase of more than a hundred bytes that stands in a third of all of the texts, whatever else they may be made of; "
    texts = [t + phrase * (i % 3 == 0) + t[::-1] for i, t in enumerate(tangled(9, 60))]
    frame = documents(spark, [(i, t, "en") for i, t in enumerate(texts)]).repartition(5)
    size = sum(len(t.encode()) for t in texts)
    unknown = spark.createDataFrame(frame.rdd, frame.schema)
    monkeypatch.setattr(suffix, "ROUTE_BYTES", size // 40)
    assert 40 <= suffix.routes_of(unknown, "text") <= 41
    frame.write.parquet(str(tmp_path / "stored"))
    stored = sum(f.stat().st_size for f in (tmp_path / "stored").glob("*.parquet"))
    assert suffix.routes_of(spark.read.parquet(str(tmp_path / "stored")), "text") == max(4, -(-2 * stored // (size // 40)))
    frame = spark.read.parquet(str(tmp_path / "stored"))
    docs = [(i, t.encode()) for i, t in enumerate(texts)]
    assert sorted(map(tuple, suffix.remove_repeats(frame).collect())) == sorted(expected_row(d, t, g) for (d, t), g in zip(docs, covered(docs)))
    tasks = spark.range(400).selectExpr("id % 40 as route").repartitionById(40, F.col("route").cast("int")).rdd.glom().map(lambda rows: {r.route for r in rows}).collect()
    assert sorted(map(len, tasks)) == [1] * 40


def test_suffix_small_batches_and_merged_shards(spark, monkeypatch):
    """One representative for all, in shards of 1,500 bytes: every shard is merged with the others."""
    texts = [t.encode() for t in tangled(11, 40)]
    ids = np.arange(len(texts))
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 500)
    bodies = []
    for at in range(0, len(texts), 9):
        found = suffix.batch_segments(ids[at:at + 9], ids[at:at + 9], texts[at:at + 9])
        columns, codes, begins, spans = found
        columns["group"] = np.ones(len(begins), np.uint32)
        columns.pop("hash")
        data = suffix.gather(codes, begins, columns["windows"] + suffix.LENGTH - 1)
        bodies.append((suffix.packed_columns(columns, spans), suffix.packed(data.tobytes())))
    spans = {}
    for k, a, b in zip(*suffix.settle_route(bodies, shard_bytes=1500)):
        spans.setdefault(int(k), []).append((a, b))
    docs = list(enumerate(texts))
    for (d, t), gone in zip(docs, covered(docs)):
        assert suffix.cut(t, np.array(spans.get(d, [])))[2] == bytes(np.frombuffer(t, np.uint8)[~gone])


def test_suffix_of_texts_longer_than_a_place_holds(spark, monkeypatch):
    """Passages beyond the places that a ranked hash can hold meet those of other texts."""
    r = random.Random(8)
    rnd = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passages = [rnd(r.randint(100, 300)) for _ in range(12)]
    long = "".join(rnd(r.randint(50, 300)) + p for p in passages)
    texts = [t.encode() for t in [*(rnd(40) + p + rnd(40) for p in passages), long, rnd(900) + long[700:2500], *tangled(3, 20)]]
    ends = np.cumsum([len(t) for t in texts])
    whole = np.frombuffer(b"".join(texts), np.uint8)
    of_window = lambda found: {int(s) + i: int(h) for s, n, h in zip(*found) for i in range(n)}
    truth = of_window(suffix.segments(whole, ends))
    docs = list(enumerate(texts))
    for bits in (9, 10):
        monkeypatch.setattr(suffix, "PLACE_BITS", np.uint64(bits))
        found = of_window(suffix.segments(whole, ends))
        assert found.keys() == truth.keys()
        by_window = {}
        for at, h in found.items():
            assert by_window.setdefault(whole[at:at + suffix.LENGTH].tobytes(), h) == h
        columns, codes, begins, spans = suffix.batch_segments(np.arange(len(texts)), np.arange(len(texts)), texts)
        columns["group"] = columns.pop("hash").astype(np.uint32)
        data = suffix.gather(codes, begins, columns["windows"] + suffix.LENGTH - 1)
        gone = {}
        for k, a, b in zip(*suffix.settle_route([(suffix.packed_columns(columns, spans), suffix.packed(data.tobytes()))])):
            gone.setdefault(int(k), []).append((a, b))
        for (d, t), truly in zip(docs, covered(docs)):
            assert suffix.cut(t, np.array(gone.get(d, [])))[2] == bytes(np.frombuffer(t, np.uint8)[~truly])


def test_suffix_array_and_prefixes():
    for seed in range(5):
        codes = np.random.default_rng(seed).integers(97, 99 + seed, 400).astype(np.uint8)
        text = bytes(codes)
        order = suffix.suffix_array(codes)
        assert list(order) == sorted(range(400), key=lambda i: text[i:])
        prefix = suffix.common_prefixes(codes, order, np.array([0, 150, 151, 390]))
        for a, b in zip(order, order[1:]):
            n = 0
            while b + n < 400 and a + n < 400 and text[a + n] == text[b + n]:
                n += 1
            assert prefix[b] == n


def test_suffix_edges(spark, hard, none):
    rows = suffix.remove_repeats(hard).collect()
    keyed = sorted(((-(1 << 63) if i is None else i), (t or "").encode()) for i, t, _ in HARD if i not in (11, 12, 13))
    truth = {(d, hashlib.sha256(t).hexdigest()): expected_row(d, t, g) for (d, t), g in zip(keyed, covered(keyed))}
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(HARD)
    for (d, _), expected in truth.items():
        r = got[None if d < 0 else d]
        assert tuple(r)[1:] == expected[1:]
    # Periodic texts keep their first 100 bytes and one period at most.
    assert got[13].n_bytes == 150_000 and got[13].n_removed == 149_999 and got[13].n_spans == 1
    assert got[11].n_removed == 5 * 30_000 - 5
    assert suffix.remove_repeats(none).collect() == []


def test_suffix_earlier_is_by_key_not_by_order(spark):
    text = prose(3, sentences=6)
    frame = documents(spark, [(9, text, "en"), (2, text + "!", "en"), (5, "? " + text, "en")])
    assert {r.doc_id: r.n_removed for r in suffix.remove_repeats(frame).collect()} == {2: 0, 5: len(text), 9: len(text)}


def fingerprint_truth(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def linked(pairs):
    """Components of (id, fingerprint) by comparing all pairs."""
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(pairs))]


def test_simhash_against_all_pairs(spark, hard, none, small):
    for docs in (hard, spark.read.parquet(f"{small}/documents.parquet")):
        pairs = [(r.doc_id, fingerprint_truth(r.text)) for r in docs.collect()]
        truth = sorted([(d, f"{f:016x}", c) for (d, f), c in zip(pairs, linked(pairs))], key=str)
        assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == truth
    assert simhash.near_duplicates(none).collect() == []


def crowded(seed, centres=6, members=60):
    """Fingerprints that lie close together, some in chains."""
    r = random.Random(seed)
    out = []
    for _ in range(centres):
        f = r.getrandbits(64)
        for _ in range(members):
            for b in r.sample(range(64), r.randint(0, 4)):
                f ^= 1 << b
            out.append(f)
    return sorted({*out, 0, 1, (1 << 64) - 1})


def test_links_find_every_pair_within_the_radius(spark):
    fps = crowded(2)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node bigint, fp bigint")
    parts = {r.node: r.component for r in graph.components(simhash.links(nodes)).collect()}
    assert [parts.get(i, i) for i in range(len(fps))] == linked(list(enumerate(fps)))


def test_large_buckets_are_covered_again(monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 8)
    fps = crowded(5, centres=2, members=120)
    a, b = simhash.spanning(np.array(fps, np.uint64), np.zeros(len(fps), np.int64), 3)
    found = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    truth = {(j, i) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3}
    assert found == truth


def test_masks_cover():
    tables = simhash.masks(list(range(64)), 3)
    r = random.Random(0)
    for _ in range(2000):
        bits = sum(1 << b for b in r.sample(range(64), r.randint(0, 3)))
        assert any(bits & m == 0 for m in tables)


def test_components(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 400)] + [(7, 9), (9, 3), (3, 3), (7, 9), (900, 3)] + [(5000, 6000 + i) for i in range(50)]
    r.shuffle(edges)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    truth = {i: 100 for i in range(100, 401)} | {3: 3, 7: 3, 9: 3, 900: 3, 5000: 5000} | {6000 + i: 5000 for i in range(50)}
    assert got == truth
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []

"""Embedding whitening, cross-tokenizer alignment and line dedup against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pricelens.llm import alignment, lines, queries, whitening
from pricelens.llm.common import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


# ---------------------------------------------------------------- whitening


def symmetric(seed, values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("seed", range(8))
def test_inertia_counts_signs(seed):
    r = np.random.default_rng(seed)
    matrix = symmetric(seed, r.normal(size=17))
    values = np.linalg.eigvalsh(matrix)
    assert whitening.inertia(matrix) == ((values > 0).sum(), (values < 0).sum(), 0)
    for shift in r.normal(size=10):
        assert whitening.above(matrix, shift) == (values > shift).sum()
    zero_diagonal = np.array([[0, 1.0, 2], [1, 0, 3], [2, 3, 0]])
    assert whitening.inertia(zero_diagonal)[:2] == ((np.linalg.eigvalsh(zero_diagonal) > 0).sum(), (np.linalg.eigvalsh(zero_diagonal) < 0).sum())
    assert whitening.inertia(np.zeros((3, 3))) == (0, 0, 3)


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 30), np.r_[5, 4.999999, 4.99, 3, np.zeros(20)], 10.0 ** -np.arange(12), 1e9 * np.r_[np.ones(5), 3, 2], [4, 4, 4, 4, 1], [7.0], [2, 0, 0], [1, 1 - 1e-13, 0.5],
])
def test_leading_components(values):
    matrix = symmetric(3, np.array(values, float))
    found = whitening.leading(matrix, 4)
    wanted = np.sort(values)[::-1][:4]
    wanted = wanted[wanted > 1e-13 * max(wanted)]
    np.testing.assert_allclose([e for e, _ in found], wanted, rtol=1e-10, atol=1e-13 * wanted[0])
    basis = np.array([v for _, v in found])
    np.testing.assert_allclose(basis @ basis.T, np.eye(len(found)), atol=1e-9)
    np.testing.assert_allclose(matrix @ basis.T, basis.T * [e for e, _ in found], atol=1e-12 * wanted[0])


def whitened(vectors):
    """The plain version: every distinct vector once, LAPACK's eigenvectors."""
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in kept}), float)
    n, total = len(fit), [sum(x[j] for x in {x for _, x in kept}) for j in range(fit.shape[1])]
    values, basis = np.linalg.eigh(np.cov(fit.T, bias=True))
    out = {}
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, total))
        for k in range(1, 5):
            out[i, k] = (n, deviation, (np.array(x) - fit.mean(0)) @ basis[:, -k] / math.sqrt(values[-k]), values[-k] / values.sum())
    return out


def test_whitening_equals_plain_version(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(c) for c in r.normal(size=9) * np.arange(1, 10) / 9]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(50)] + [(400, None), (401, [None] * 9), (402, [1.0] * 8 + [math.nan]), (403, [1.0] * 8 + [-math.inf]), (404, []), (405, [0.5] * 3)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "'x' as key", "1 as n", "2 as x", "3 as component")
    wanted = whitened([r for r in rows if r[0] != 405])
    found = whitening.whiten(frame).collect()
    assert sorted((f.vec_id, f.component) for f in found) == sorted(wanted)
    sign = {f.component: 1 if f.whitened * wanted[0, f.component][2] > 0 else -1 for f in found if f.vec_id == 0}
    for f in found:
        n, deviation, value, explained = wanted[f.vec_id, f.component]
        assert (f.n, f.deviation) == (n, deviation)
        assert f.whitened == pytest.approx(sign[f.component] * value, rel=1e-9, abs=1e-9)
        assert f.explained == pytest.approx(explained, rel=1e-9)
        assert 0 <= f.identity_error < 1e-9
    assert len({f.identity_error for f in found}) == 1


def test_whitening_without_variance(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(9)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)] + [(None, [1.0, 2.0])], schema)).collect()
    assert {f.component for f in line} == {1} and len(line) == 10 and line[0].explained == pytest.approx(1)
    big = whitening.whiten(spark.createDataFrame([(i, [3e38 * (i % 2), float(i)]) for i in range(9)], schema)).collect()
    assert len(big) >= 9 and all(f.deviation is None for f in big if f.component == 1)


def test_deviation_is_exact_at_any_size():
    x, total = np.array([[2**40, -(2**40)], [7, -9]]), [2**45 + 1, 3]
    exact = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, total)) for row in x]
    assert whitening.deviations(x, 3, total).to_pylist() == [v if v < 1 << 63 else None for v in exact]
    assert whitening.deviations(np.array([[5, -6]]), 1000, [77, 12]).to_pylist() == [(5000 - 77) ** 2 + 6012**2]


def test_op11_on_given_table(spark, small):
    found = queries.op11_embedding_whitening(spark, small).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    wanted = whitened(rows)
    assert len(found) == len(wanted) == 4 * len(rows)
    for f in found:
        n, deviation, value, explained = wanted[f.vec_id, f.component]
        assert (f.n, f.deviation) == (n, deviation) and abs(f.whitened) == pytest.approx(abs(value), rel=1e-7, abs=1e-7)
        assert f.explained == pytest.approx(explained, rel=1e-9) and f.identity_error < 1e-9


# ---------------------------------------------------------------- alignment


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def aligned(texts):
    """The plain version on whole texts, with the libraries of either file and sets of offsets."""
    a, b = libraries()
    own = alignment.tokenizers(A, B)
    out, counts = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [own.bytes_a[i] for i in ids_a]
        bytes_b = [alignment.piece_bytes(b.id_to_piece(i)) for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out.append(None)
            continue
        ends_a, ends_b = ({e: i + 1 for i, e in enumerate(np.cumsum([len(t) for t in x]).tolist())} for x in (bytes_a, bytes_b))
        i = j = 0
        groups, links = [], []
        for e in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a[e], ends_b[e]
            groups.append(f"{','.join(map(str, ids_a[i:p]))}|{','.join(map(str, ids_b[j:q]))}")
            links.append((ids_a[p - 1], ids_b[q - 1]))
            i, j = p, q
        counts.update(links)
        out.append((len(ids_a), len(ids_b), ";".join(groups), links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (0,) * 6 + ("",) if o is None else
        (o[0], o[1], len(o[3]), len(o[3]), sum(counts[x] == best[x[1]] for x in o[3]), sum(counts[x] for x in o[3]), hashlib.sha256(o[2].encode()).hexdigest())
        for o in out
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PARTS = [
    "a", "b", "the", "'s", "'", "  ", " ", "\n", "\t", "\n\n", "\x1c", "\x85", "\xa0", " ", "　", "é", "漢", "😀", "<s>", "<|endoftext|>", "<unk>", "<0x41>",
    "12", "345", ".", "!!", "▁", "\x00", "﻿", "́", "ﬁ", "①", "\r", "​", "\x0b", "Ⅷ", "ab­c",
]


def test_alignment_of_odd_texts(spark):
    r = random.Random(4)
    texts = ["".join(r.choices(PARTS, k=r.randint(1, 20))) for _ in range(2_500)] + ["", None, " ", "  ", "\n", " \n ", "\t", "a ", "x" * 20_000, "word " * 3_000] * 2
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    found = {f.doc_id: tuple(f[c] for c in COLUMNS) for f in alignment.align(frame, A, B).collect()}
    assert [found[i] for i in range(len(texts))] == aligned(texts)


def test_alignment_with_a_small_cache(spark, small, monkeypatch):
    """Chunks that fall out of the cache, short blocks of the search and of tokenization."""
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(30).collect()]
    for name, value in (("CACHE_ROWS", 100), ("CACHE_CHARS", 6), ("BLOCK", 3), ("TOGETHER", 7)):
        monkeypatch.setattr(alignment, name, value)
    own = alignment.Tokenizers(A, B)
    for text in texts:
        chunks = alignment.chunks_of(text)
        known = own.look_up(dict.fromkeys(chunks))
        assert "".join(chunks) == " " + text
        whole = own._aligned([" " + text])[0]
        assert (b";".join(known[c][0] for c in chunks), b"".join(known[c][3] for c in chunks)) == (whole[0], whole[3])
        assert len(own.young) + len(own.old) <= 100 + 2 * max(map(len, map(alignment.chunks_of, texts)))  # a batch may overfill either half


def test_galloping_finds_lower_bounds():
    r = np.random.default_rng(2)
    for n, m in ((1, 1), (5, 1000), (1000, 5), (300, 300), (5000, 90_000)):
        wanted, ends = (np.unique(r.integers(0, 100_000, k)) for k in (n, m))
        assert (alignment.galloping(wanted, ends) == np.searchsorted(ends, wanted)).all()
        x, y = alignment.common(wanted, ends)
        assert (wanted[x] == ends[y]).all() and sorted(set(wanted.tolist()) & set(ends.tolist())) == wanted[x].tolist()
    assert all(len(v) == 0 for v in alignment.common(np.zeros(0, int), np.arange(3)))


def test_groups_cover_both_sides():
    found, links = alignment.groups([1, 2, 3, 4], [2, 5, 6, 9], [7, 8, 9], [5, 6, 9])
    assert found == [([1, 2], [7], 0, 5), ([3], [8], 5, 6), ([4], [9], 6, 9)] and links == [(2, 7), (3, 8), (4, 9)]


def test_every_link_is_a_possible_pair():
    own = alignment.tokenizers(A, B)
    r, size = random.Random(1), len(own.bytes_b)
    for code in r.choices(own.pairs.tolist(), k=2_000):
        a, b = own.bytes_a[code // size], own.bytes_b[code % size]
        assert a.endswith(b) or b.endswith(a)
    possible = set(own.pairs.tolist())
    for b in r.sample(range(size), 30):
        for a, t in enumerate(own.bytes_a):
            assert ((t.endswith(own.bytes_b[b]) or own.bytes_b[b].endswith(t)) and t != b"") == (a * size + b in possible)


def test_op12_on_given_table_and_hard_rows(spark, small, hard, none):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    found = {f.doc_id: tuple(f[c] for c in COLUMNS) for f in queries.op12_cross_tokenizer_alignment(spark, small).collect()}
    assert [found[r.doc_id] for r in rows] == aligned([r.text for r in rows])
    texts = [r.text for r in hard.collect()]
    found = alignment.align(hard, A, B, with_groups=True).collect()
    assert sorted(tuple(f[c] for c in COLUMNS) for f in found) == sorted(aligned(texts))
    assert all(hashlib.sha256(f.groups.encode()).hexdigest() == f.groups_sha256 for f in found if f.groups_sha256)
    assert alignment.align(none, A, B).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        alignment.Tokenizers(tokenizer_path("word_bpe_49k.json"), B)


# ---------------------------------------------------------------- line dedup


def deduplicated(rows):
    """The plain version: (doc_id, text) to (doc_id, lines, dropped, digest)."""
    def key(line):
        stripped = line.strip(" \t\n\x0b\x0c\r")
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)
        return lowered if len(lowered) >= 20 else None

    order = lambda i: -math.inf if i is None else i
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if key(line) is not None:
                holders[key(line)].add(order(i))
    out = []
    for i, text in rows:
        split = (text or "").split("\n")
        left = [x for x in split if key(x) is None or len(holders[key(x)]) < 3 or max(holders[key(x)]) == order(i)]
        out.append((i, len(split), len(split) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def shown(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in frame.collect()), key=str)


def texts_with_shared_lines(seed, n=400):
    r = random.Random(seed)
    pool = [f"shared line number {k} of the pool" for k in range(60)] + ["É" * 19, "É" * 20, "x" * 19, "x" * 20, "  " + "y" * 20 + "\t\r", "Y" * 20]
    rows = [(i, "\n".join(r.choices(pool, weights=[1 / (k + 1) for k in range(len(pool))], k=r.randint(0, 12)) + [f"own line of document {i} and no other"] * r.randint(0, 3))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, pool[0] + "\n" + pool[1]), (None, pool[2]), (5, rows[5][1]), (6, pool[3])]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_line_dedup_equals_plain_version(spark, partitions, monkeypatch):
    rows = texts_with_shared_lines(partitions)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        wanted = deduplicated(rows)
        assert shown(lines.drop_lines(frame)) == wanted
        monkeypatch.setattr(lines, "BROADCAST_BYTES", 0)
        assert shown(lines.drop_lines(frame)) == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_streaming_in_batches_of_any_size(size):
    """Ranges cut anywhere, batches cut anywhere: decisions and summaries together give the same rows."""
    r = random.Random(size)
    rows = sorted({(r.randint(0, 9), 0, -r.randint(0, 8), r.randint(0, 1)) for _ in range(150)})
    rows = [(h, low, -doc, crc, bytes([i])) for i, (h, low, doc, crc) in enumerate(rows)]
    names = ["high", "low", "doc", "crc", "places"]
    cuts = sorted(r.sample(range(len(rows)), 5))
    cuts = [c for c in cuts if c == 0 or rows[c][:3] != rows[c - 1][:3]]  # a document of a hash is in one range
    goes, opened, outer = set(), [], defaultdict(list)
    for start, end in zip([0, *cuts], [*cuts, len(rows)]):
        own = rows[start:end]
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in own[i: i + size]]) for i in range(0, len(own), size)]
        for out in lines.stream(batches):
            for x in out.to_pylist():
                if x["kind"] == lines.SUMMARY:
                    outer[x["high"]].append((x["n"], x["doc"]))
                elif x["kind"] == lines.GOES:
                    goes.add(x["places"])
                else:
                    opened.append(x)
    for x in opened:
        of = outer[x["high"]]
        if sum(n for n, _ in of) >= 3 and x["doc"] < max(d for _, d in of):
            goes.add(x["places"])
    holders = defaultdict(set)
    for h, _, doc, _, _ in rows:
        holders[h].add(doc)
    assert goes == {p for h, _, doc, _, p in rows if len(holders[h]) >= 3 and doc < max(holders[h])}
    assert all(len(v) <= 2 * (len(cuts) + 1) for v in outer.values())


def test_bitmaps_of_long_documents(spark):
    """Places beyond many bytes of the bitmap, and texts back instead of digests."""
    common = "a line that stands in all of the documents"
    rows = [(i, "\n".join([f"own line {i} {k}" for k in range(20_000)] + [common] + ["tail"] * i)) for i in range(4)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    maps = lines.keep_bitmaps(frame).collect()
    assert sorted((m.doc, m.n_dropped) for m in maps) == [(0, 1), (1, 1), (2, 1)] and all(len(m.keep) < 100 for m in maps)
    found = {r.doc_id: r.kept_text for r in lines.drop_lines(frame, with_text=True).collect()}
    assert found == {i: t if i == 3 else t.replace("\n" + common, "") for i, t in rows}


def test_op13_on_given_table_and_hard_rows(spark, small, hard, none):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert shown(queries.op13_line_dedup(spark, small)) == deduplicated(rows)
    assert shown(lines.drop_lines(hard)) == deduplicated([(r.doc_id, r.text) for r in hard.collect()])
    assert lines.drop_lines(none).count() == 0

"""The pipeline stage by stage, and the contract of the queries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricelens.llm import language, mixing
from pricelens.llm.oracle import ORACLES
from pricelens.llm.queries import MIXTURE, QUERIES, domains, held_out
from tools.compare import compare, duck

from .conftest import WORDS, documents, prose
from .test_pages_and_packing import check_packing

STAGES = dict(corpus_pipeline.STAGES)


def first_of_groups(rows):
    """Of texts joined by pairs of five-word shingle similarity 0.8 or more, the one with the smallest id."""
    sets = sorted((i, shingle_truth(t)) for i, t in rows.items())
    part = {i: i for i, _ in sets}
    for a, x in sets:
        for b, y in sets:
            if a < b and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((part[a], part[b]))
                part = {i: low if c == high else c for i, c in part.items()}
    return {i: rows[i] for i, c in part.items() if i == c}


def test_run_against_a_plain_version(spark, small):
    """Every stage once more, without Spark's joins, streams and groups."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = language.fit(docs.where(~held_out()))
    rejected = model.judge(list(rows.values()))[2]
    rows = {i: t for (i, t), r in zip(rows.items(), rejected) if not r}
    last = {}
    for i, t in rows.items():
        last[t.encode().lower()] = max(i, last.get(t.encode().lower(), i))
    rows = first_of_groups({i: t for i, t in rows.items() if last[t.encode().lower()] == i})
    left = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    copies = {r.doc_id: r.copies for r in mixing.mix(left, domains(spark, small), MIXTURE).collect()}
    texts = [(i, t) for i, t in rows.items() for _ in range(copies[i])]
    check_packing(corpus_pipeline.run(spark, small).collect(), texts)


def test_mixing_stage_follows_the_classifier(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = mixing.fit(docs, domains(spark, small))
    p, n = model.posteriors([r.text for r in docs.collect()])
    assert model.names == ["good", "poor", "toxic"] and np.allclose(p.sum(axis=1), 1, atol=0.02)
    rows = mixing.mix(docs, domains(spark, small), MIXTURE).collect()
    share = np.sum([[r.rate * r.tokens * x for x in r.posterior] for r in rows], axis=0)
    assert np.allclose(share / n.sum(), [MIXTURE[k] for k in model.names], atol=0.01)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, small, hard, none, name, tmp_path):
    for i, docs in enumerate((hard, none)):
        out = STAGES[name](spark, docs, small)
        if name != "packing":
            assert out.columns == docs.columns and out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / str(i)))
    assert spark.read.parquet(str(tmp_path / "1")).count() == 0


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_stage_decisions(spark, small, hard, most, monkeypatch):
    """With dropped documents broadcast, and joined by a shuffle."""
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", most)
    monkeypatch.setattr(corpus_pipeline.exact, "BROADCAST_DIGESTS", most)
    kept = lambda name, docs: sorted(r.doc_id for r in STAGES[name](spark, docs, small).where("doc_id is not null").collect())
    rows = [(i, prose(i, lang), lang) for i, lang in enumerate(["en", "fr", "de"] * 20)] + [(100, None, "en"), (101, "12 !", "de")]
    assert kept("language_id", documents(spark, rows)) == list(range(60))
    copies = [(1, "Same text", "en"), (2, "same TEXT", "en"), (3, "other", "en")]
    assert kept("exact_dedup", documents(spark, copies)) == [2, 3]
    long = prose(1, sentences=200)
    near = [(1, long, "en"), (2, long + " end", "en"), (3, prose(2, sentences=50), "en")]
    assert kept("simhash_dedup", documents(spark, near)) == [1, 3]


def shingle_truth(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def planted_near_copies(count=150):
    """Texts, and copies with some words replaced: rows, and the Jaccard similarity of each copy to its text."""
    r = random.Random(12)
    words = [f"{a}{b}" for a in WORDS["en"] for b in WORDS["de"]]
    rows, alike = [], {}
    for i in range(count):
        text = r.choices(words, k=r.randint(150, 400))
        copy = list(text)
        for at in r.sample(range(len(copy)), r.randint(1, max(1, len(copy) // 30))):
            copy[at] = r.choice(words)
        rows += [(2 * i, " ".join(text), "en"), (2 * i + 1, " ".join(copy), "en")]
        a, b = shingle_truth(rows[-2][1]), shingle_truth(rows[-1][1])
        alike[2 * i + 1] = len(a & b) / len(a | b)
    return rows, alike


def test_near_copies_of_similarity_08_are_dropped(spark, small):
    rows, alike = planted_near_copies()
    kept = {r.doc_id for r in STAGES["simhash_dedup"](spark, documents(spark, rows), small).collect()}
    assert sum(0.8 <= s < 0.9 for s in alike.values()) > 30 and sum(s < 0.8 for s in alike.values()) > 10
    near = [i for i, s in alike.items() if s >= 0.8]
    assert len([i for i in near if i not in kept]) >= 0.99 * len(near)
    assert kept >= {i for i, _, _ in rows if i % 2 == 0} | {i for i, s in alike.items() if s < 0.8}


@pytest.mark.parametrize("name", ["exact_dedup", "simhash_dedup"])
def test_stages_decide_by_row(spark, small, name):
    """Rows that are repeated, and a doc_id of two texts of which one is a copy of another document's."""
    long = prose(1, sentences=200)
    copy = long if name == "exact_dedup" else long + " end"
    kept = (20, long) if name == "exact_dedup" else (1, copy)
    rows = [(1, copy, "en"), (20, long, "en"), (20, long, "en"), (1, prose(2, sentences=50), "en"), (7, prose(3), "en"), (7, prose(3), "en"),
            (None, prose(5), "en"), (None, prose(5), "en"), (1, copy, "en")]
    docs = documents(spark, rows)
    out = STAGES[name](spark, docs, small)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([kept, (1, prose(2, sentences=50)), (7, prose(3)), (None, prose(5))], key=str)


def test_near_stage_against_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = sorted(r.doc_id for r in STAGES["simhash_dedup"](spark, docs, small).collect())
    assert kept == sorted(first_of_groups({r.doc_id: r.text for r in docs.collect()}))


def test_a_large_group_of_near_copies(spark, small):
    """More than a bucket compares in pairs."""
    base = prose(4, sentences=60).split()
    rows = [(i, " ".join(base[:i] + [f"new{i}"] + base[i + 1:]), "en") for i in range(150)]
    assert [r.doc_id for r in STAGES["simhash_dedup"](spark, documents(spark, rows), small).collect()] == [0]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, small, name):
    ok, message = compare(spark, duck(small), small, QUERIES[name], ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("number", range(1, 14))
def test_each_operator_has_one_query(number):
    assert len([n for n in QUERIES if n.startswith(f"op{number}_")]) == 1


def test_near_stage_links_by_fingerprints(spark, small, monkeypatch):
    """SimHash finds copies by itself, and its links are confirmed: equal fingerprints of different sets are no copies."""
    nothing = lambda nodes: nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    monkeypatch.setattr(corpus_pipeline.shingles, "candidates", nothing)
    long = prose(1, sentences=200)
    line = "the same line comes again "
    often = [line * 60 + prose(i) for i in (7, 8)]
    prints = [corpus_pipeline.simhash.fingerprint(t) for t in often]
    assert bin(prints[0] ^ prints[1]).count("1") <= 3 and len(shingle_truth(often[0]) & shingle_truth(often[1])) < 0.8 * len(shingle_truth(often[0]))
    rows = [(1, long, "en"), (2, long + " end", "en"), (3, prose(2, sentences=50), "en"), (4, often[0], "en"), (5, often[1], "en"), (2, long + " end", "en"), (6, None, "en"), (7, " ", "en")]
    kept = [r.doc_id for r in STAGES["simhash_dedup"](spark, documents(spark, rows), small).collect()]
    assert sorted(kept) == [1, 3, 4, 5, 6]


def test_near_stage_looks_at_all_fingerprint_links(spark, small, monkeypatch):
    """Pairs of copies in one component of SimHash, where the component's first text is like one of them alone."""
    nothing = lambda nodes: nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    monkeypatch.setattr(corpus_pipeline.shingles, "candidates", nothing)
    monkeypatch.setattr(corpus_pipeline.shingles, "TILE", 3, raising=False)
    texts = ["the same line comes again " * 60 + prose(i) for i in (7, 8, 9, 10)]
    rows = [(2 * i + end, t + " end" * end, "en") for i, t in enumerate(texts) for end in (0, 1)]
    prints = [corpus_pipeline.simhash.fingerprint(t) for _, t, _ in rows]
    sets = [shingle_truth(t) for _, t, _ in rows]
    for i in range(0, 8, 2):
        assert (prints[i] ^ prints[i + 1]).bit_count() <= 3 and len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])
        assert (prints[0] ^ prints[i]).bit_count() <= 3 and (i == 0 or len(sets[0] & sets[i]) < 0.8 * len(sets[0] | sets[i]))
    kept = [r.doc_id for r in STAGES["simhash_dedup"](spark, documents(spark, rows), small).collect()]
    assert sorted(kept) == [0, 2, 4, 6]


@pytest.mark.parametrize("tile", [16, 2_048])
def test_a_large_bucket_loses_no_link(spark, small, tile, monkeypatch):
    """More texts than a bucket compares in pairs, alike at the border of 0.8: chains that a leader's estimates cut."""
    monkeypatch.setattr(corpus_pipeline.shingles, "TILE", tile, raising=False)
    r, words = random.Random(10), [f"{a}{b}" for a in WORDS["en"] for b in WORDS["de"]]
    base, rows = r.choices(words, k=200), []
    for i in range(140):
        text = list(base)
        for at in r.sample(range(200), r.randint(2, 6)):
            text[at] = r.choice(words)
        rows.append((i, " ".join(text), "en"))
    kept = [r.doc_id for r in STAGES["simhash_dedup"](spark, documents(spark, rows), small).collect()]
    assert sorted(kept) == sorted(first_of_groups({i: t for i, t, _ in rows}))

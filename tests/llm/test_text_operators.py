"""Quality, language, token counts and mixing."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import language, mixing, quality, tokens
from pricelens.llm.common import tokenizer_path

from .conftest import HARD, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = "piece_bpe_32k.model"


def base(text):
    """The contract's counts, one text at a time."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_measures(spark, hard, small):
    texts = [t for _, t, _ in HARD]
    got = sorted(map(tuple, quality.measured(hard).select(*MEASURES).collect()))
    assert got == sorted(map(base, texts))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    expected = {r.doc_id: base(r.text) for r in docs.collect()}
    assert {r.doc_id: tuple(r[c] for c in MEASURES) for r in quality.judge(docs).collect()} == expected


def test_quality_edges(hard, none):
    rows = quality.judge(hard).collect()
    assert len(rows) == len(HARD)
    assert all(not r.kept for r in rows if r.base_failed)
    assert not any(r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert quality.judge(none).collect() == []


def test_quality_learns_which_rules_to_trust(spark):
    """Votes drawn from known rates: the estimate finds the rates and the classes."""
    r = np.random.default_rng(1)
    good = r.random(4000) < 0.8
    votes = []
    for g in good:
        says_bad, says_good = (0.02, 0.6) if g else (0.5, 0.1)
        u = r.random(11)
        votes.append([0 if x < says_bad else 1 if x < says_bad + says_good else -1 for x in u])
    frame = spark.createDataFrame([(v,) for v in votes], "votes array<int>")
    p = quality.estimated(frame.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))).first().p
    assert abs(p.good - good.mean()) < 0.03
    assert max(abs(np.array(p.bad_if_bad) - 0.5)) < 0.08 and max(abs(np.array(p.good_if_good) - 0.6)) < 0.06


def test_quality_finds_junk_and_keeps_prose(spark):
    prose_rows = [(i, prose(i, sentences=12), "en") for i in range(300)]
    junk = [(1000 + i, re.sub(r" ", "%%% ", prose(i, sentences=12)), "en") for i in range(20)]
    junk += [(2000 + i, re.sub(r" ", " | ", prose(i, sentences=12)), "en") for i in range(20)]
    rows = {r.doc_id: r.kept for r in quality.judge(documents(spark, prose_rows + junk)).collect()}
    assert sum(rows[i] for i in range(300)) >= 297
    assert sum(v for k, v in rows.items() if k >= 1000) <= 2


def test_quality_is_native(hard):
    plan = quality.measured(hard)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan)


def many(spark, n=240):
    return documents(spark, [(i, prose(i, lang := ("en", "fr", "de")[i % 3]), lang) for i in range(n)])


def test_language_accuracy(spark, hard, none):
    docs = many(spark)
    model = language.fit(docs.where("doc_id % 4 <> 1"))
    assert model.languages == ["de", "en", "fr"]
    rows = language.identify(docs.where("doc_id % 4 = 1"), model, carry=("lang",)).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    edge = {r.doc_id: r for r in language.identify(hard, model).collect()}
    assert [edge[i].lang_pred for i in (1, 2, 3, 6)] == ["und"] * 4 and edge[1].score == 0 and edge[1].rejected
    assert edge[7].lang_pred in model.languages and 0 <= edge[7].score <= 1
    assert edge[12].lang_pred == "de"
    assert language.identify(none, model).collect() == []
    blank = language.fit(none)
    assert {r.lang_pred for r in language.identify(hard, blank).collect()} == {"und"}


def test_language_blocks_agree(monkeypatch):
    texts = [prose(i, "fr", 60) for i in range(3)] + ["", "ab"]
    model = language.train([prose(i, k) for i in range(30) for k in ("en", "fr")], ["en", "fr"] * 30)
    whole = model.totals(texts)
    monkeypatch.setattr(language, "BLOCK", 257)
    assert np.allclose(whole, model.totals(texts), rtol=1e-4)


def test_language_texts_don_t_touch():
    model = language.train([prose(i, k) for i in range(30) for k in ("en", "fr")], ["en", "fr"] * 30)
    texts = [" ", "été", "", "12", "the house", "\n"]
    together, alone = model.totals(texts), [model.totals([t])[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-4) and list(together[[0, 2, 3, 5], -1]) == [0] * 4


def plain_scores(model, text):
    """A prediction by the definition: the mean of the weights of every run of letters, word edges included, that the model hashes."""
    codes = np.append(language.points(text), language.SPACE)
    found = [b for buckets in language.subwords(codes) for b in buckets.tolist() if b < language.BUCKETS]
    total = np.zeros(len(model.languages))
    for b in found:
        total += model.weights[b, : len(model.languages)]
    if not found:
        return language.UNDETERMINED, 0.0
    logits = total / len(found) * model.temperature
    p = np.exp(logits - logits.max())
    return model.languages[int(logits.argmax())], float((p / p.sum()).max())


def test_language_predictions_against_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.fit(docs.where("doc_id % 4 <> 1"))
    rows = docs.limit(60).collect()
    texts = documents(spark, [(r.doc_id, r.text, None) for r in rows] + [(-1, None, None), (-2, "12 !", None), (-3, "É", None)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(texts, model).collect()}
    for i, t in [(r.doc_id, r.text) for r in rows] + [(-1, ""), (-2, "12 !"), (-3, "É")]:
        name, score = plain_scores(model, t or "")
        assert got[i][0] == name and got[i][1] == pytest.approx(score, abs=1e-4)


@pytest.mark.parametrize("rows", [20, 100, 600])
def test_language_keeps_what_it_predicts_rightly(rows):
    """New texts of known languages, whatever the size of the sample."""
    names = ("en", "fr", "de")
    model = language.train([prose(i, k) for i in range(rows) for k in names], list(names) * rows)
    new = [(prose(10_000 + i, k), k) for i in range(400) for k in names]
    best, _, rejected = model.judge([t for t, _ in new])
    right = np.array([model.languages[b] == k for b, (_, k) in zip(best, new)])
    assert right.mean() > 0.99 and rejected[right].mean() < 0.005


def test_language_calibration_rejects_what_is_unlike_all():
    model = language.train([prose(i, k) for i in range(50) for k in ("en", "fr")], ["en", "fr"] * 50)
    _, score = model.predict([prose(900), "zzxq"])
    assert score[0] > 0.8 and score[0] > score[1]


@pytest.mark.parametrize("unseen, least", [("es", 0.9), ("fr", 0.9), ("de", 0.65)])
def test_language_left_out_of_the_labels_is_rejected(spark, unseen, least):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = docs.where(F.col("lang") != unseen)
    model = language.fit(known.where("doc_id % 4 <> 1"))
    rate = lambda rows: language.identify(rows, model).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert rate(docs.where(F.col("lang") == unseen)) > least
    held_back = known.where("doc_id % 4 = 1")
    assert rate(held_back) < 0.02
    # Texts of two known languages stay.
    pair = ["en", "es" if unseen == "de" else "de"]
    first, second = ([r.text for r in held_back.where(F.col("lang") == k).orderBy("doc_id").collect()] for k in pair)
    mixed = [f"{a[:n]} {b[:n]}" for a, b in zip(first, second) for n in [min(len(a), len(b))]]
    assert rate(documents(spark, [(i, t, None) for i, t in enumerate(mixed)])) < 0.05


def test_held_out_rows_are_the_contracts(spark, small):
    from pricelens.llm.queries import op3_language_id

    rows = op3_language_id(spark, small).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.9


def test_token_counts(spark, hard, none, small):
    import sentencepiece

    path = tokenizer_path(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = sorted(((i or -1), len((t or "").encode()), len(model.encode(t or ""))) for i, t, _ in HARD)
    rows = tokens.count_tokens(hard, path).collect()
    assert sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens) for r in rows) == expected
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows)
    assert tokens.count_tokens(none, path).collect() == []
    docs = spark.read.parquet(f"{small}/documents.parquet")
    truth = {r.doc_id: len(model.encode(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path).collect()} == truth


def test_token_cache_may_overflow(monkeypatch):
    path = tokenizer_path(PIECES)
    monkeypatch.setattr(tokens, "CACHE_ROWS", 3)
    monkeypatch.setattr(tokens, "CACHE_CHARS", 6)
    cache = {}
    texts = [prose(i) for i in range(20)]
    got = [tokens._with_misses(path, {}, cache, tokens.split(t)) for t in texts]
    assert got == [len(tokens.processor(path).encode(t)) for t in texts]


def test_token_pieces_never_cross():
    with pytest.raises(ValueError):
        tokens.check_vocabulary(type("V", (), {"vocab_size": lambda s: 1, "id_to_piece": lambda s, i: "a▁b"})())


def test_word_hashes_don_t_depend_on_place():
    a, b = mixing.word_buckets(b"one two one\n TWO x"), mixing.word_buckets(b"two")
    assert a[1][0] == a[1][2] and a[1][1] == a[1][3] == b[1][0] and list(a[0]) == [0, 4, 8, 13, 17]


def mixture(spark, n=300):
    rows = [(i, prose(i, "en" if i % 5 else "fr"), "en") for i in range(n)]
    labels = spark.createDataFrame([(i, "a" if i % 5 else "b") for i in range(0, n, 2)], "doc_id bigint, label string")
    return documents(spark, rows), labels


def test_mixing_meets_targets(spark):
    docs, labels = mixture(spark)
    rows = mixing.mix(docs, labels, {"a": 0.5, "b": 0.5}).collect()
    expected = np.sum([[r.rate * r.tokens * p for p in r.posterior] for r in rows], axis=0)
    total = sum(r.tokens for r in rows)
    assert np.allclose(expected / total, [0.5, 0.5], atol=1e-3)
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    # The drawn copies come close to what is expected.
    drawn = np.sum([[r.copies * r.tokens * p for p in r.posterior] for r in rows], axis=0)
    assert np.allclose(drawn / drawn.sum(), [0.5, 0.5], atol=0.06)


def test_mixing_against_projected_gradient_on_documents(spark):
    """The fit over grid points equals the same descent over every document."""
    r = np.random.default_rng(3)
    p = np.round(r.dirichlet([0.4, 0.4, 0.4], 200), 2)
    n = r.integers(1, 300, 200)
    member = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "tokens bigint, posterior array<double>")
    rate, mass = np.ones(200), (n[:, None] * p).sum(axis=0)
    goal, far = np.array([0.8, 0.2, 0.0]) * mass.sum(), np.inf
    for _ in range(mixing.STEPS):
        reached = ((n * rate)[:, None] * p).sum(axis=0)
        before, far = far, mixing.distance(reached, goal, mass)
        if far < mixing.TOLERANCE:
            break
        shared = np.einsum("d,di,dj->ij", n * (rate > 0), p, p)
        rate = np.maximum(0, rate - p @ mixing.direction(reached - goal, shared, mass, far < 0.9 * before))
    assert far < 1e-3 and (rate == 0).any()
    got = {tuple(x.posterior): x.rate for x in mixing.rates(member, ["x", "y", "z"], {"x": 0.8, "y": 0.2}).collect()}
    assert np.allclose([got[tuple(x)] for x in p.tolist()], rate, atol=1e-4)


def test_mixing_edges(spark, hard, none):
    docs, labels = mixture(spark, 40)
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, "a"), (3, None)], labels.schema))
    assert mixing.mix(docs, twice, {"a": 1.0}).count() == 40
    assert mixing.mix(none, labels, {"a": 1.0}).collect() == []
    rows = mixing.mix(hard, labels.where("false"), {"a": 1.0}).collect()
    assert len(rows) == len(HARD) and {r.rate for r in rows} == {1.0}
    rows = mixing.mix(hard, labels, {"a": 0.7, "b": 0.3, "c": 0.5}).collect()
    assert len(rows) == len(HARD) and {r.tokens for r in rows if r.doc_id in (1, 2, 3)} == {0}

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.operators import evaluate, models, order, retrieve
from pricelens.sources import models as model_io


def vectors(spark, values, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(values)], "id bigint, embedding array<float>")


def brute(queries, index, k, exclude_self):
    out = {}
    for q, v in queries:
        rows = sorted((round(float(((np.float32(v).astype(float) - np.float32(w).astype(float)) ** 2).sum()), 9), i) for i, w in index if not (exclude_self and i == q))
        out[q] = [i for _, i in rows[:k]]
    return out


def got(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("kind", ["uniform", "clustered", "copies"])
def test_exact_neighbours_match_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(1)
    values = rng.standard_normal((300, 6))
    if kind == "clustered":
        values = values * 0.05 + rng.standard_normal((6, 6))[rng.integers(0, 6, 300)] * 5
    if kind == "copies":
        values[:120] = values[0]  # one vector holds two fifths of all rows
    frame, pairs = vectors(spark, values), list(enumerate(values))
    assert got(retrieve.nearest(frame, frame, 5, exclude_self=True)) == brute(pairs, pairs, 5, True)
    others = list(enumerate(rng.standard_normal((25, 6)), start=1000))
    probe = vectors(spark, [v for _, v in others], 1000)
    assert got(retrieve.nearest(probe, frame, 3)) == brute(others, pairs, 3, False)


def test_fewer_rows_than_neighbours(spark):
    frame = vectors(spark, [[0, 0], [1, 0], [5, 0]])
    assert got(retrieve.nearest(frame, frame, 5)) == {0: [0, 1, 2], 1: [1, 0, 2], 2: [2, 1, 0]}


def compared_share(values, planes):
    """Share of the index that a query meets in its own and its neighbouring cells."""
    tables, bits, _ = planes.shape
    codes = (np.einsum("nd,tbd->ntb", values, planes) > 0) @ (1 << np.arange(bits))
    near = np.bitwise_count((codes[:, None, :] ^ codes[None, :, :]).astype(np.uint64)) <= 1
    return near.any(axis=2).mean()


def test_lsh_recall_with_the_settings_for_large_indexes(spark):
    """Planted clusters: most neighbours are found, and little of the index is looked at."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((120, 64))
    values = centres[rng.integers(0, 120, 1500)] + 0.35 * rng.standard_normal((1500, 64))
    frame = vectors(spark, values)
    pairs = list(enumerate(values))
    exact, approx = brute(pairs, pairs, 5, True), got(retrieve.nearest_approx(frame, frame, 5, True))
    hits = sum(len(set(exact[q]) & set(approx.get(q, []))) for q in exact)
    planes = retrieve.sign_planes(retrieve.TABLES, retrieve.BITS, 64, 42)
    assert hits / (5 * len(exact)) >= 0.8
    assert compared_share(values, planes) < 0.1


def test_lsh_of_nothing(spark):
    frame = vectors(spark, [[1.0, 0.0]])
    assert retrieve.nearest_approx(frame, frame.where("false")).count() == 0


def test_search_plan_has_no_cross_join(spark):
    frame = vectors(spark, np.eye(4))
    plan = retrieve.nearest(frame, frame, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_neighbour_price(spark):
    rows = spark.createDataFrame([(1, 1.0, 10.0), (1, 1.0, 30.0)], "query_id bigint, distance double, price double")
    assert retrieve.neighbour_price(rows).first()["guess"] == pytest.approx(20.0)


def prepared(items):
    """Price follows one word of the summary, so text models can learn it."""
    rows = items.withColumn("price", 100.0 + 20.0 * (F.col("id") % 11))
    return order.ordinal_by_id(rows)


def mean_error(rows):
    return rows.agg(F.avg(F.abs(F.col("guess") - F.col("price")))).first()[0]


@pytest.mark.parametrize("name", ["nlp_linear", "random_forest", "boosted", "log_target", "hashed"])
def test_text_models_beat_the_constant(spark, items, name):
    rows = prepared(items)
    train, test = rows.where("ord < 240"), rows.where("ord >= 240")
    fit = {"random_forest": lambda t: models.forest_price(t, trees=20), "boosted": lambda t: models.boosted_price(t, rounds=8)}
    scored = fit.get(name, models.MODELS[name])(train).price(test)
    constant = mean_error(test.withColumn("guess", models.mean_price(train)))
    assert scored.where("guess < 0").count() == 0
    assert mean_error(scored) < constant


@pytest.mark.parametrize("approximate", [False, True])
def test_retrieval_prices_texts_by_similar_ones(spark, items, approximate):
    rows = prepared(items)
    train, test = rows.where("ord < 240"), rows.where("ord >= 240")
    scored = models.MODELS["retrieval"](train, approximate=approximate).price(test)
    assert scored.columns == [*test.columns, "guess"] and scored.count() == test.count()
    assert mean_error(scored) < 0.8 * mean_error(test.withColumn("guess", models.mean_price(train)))


def test_a_blend_is_the_weighted_mean_of_its_models(spark, items):
    rows = prepared(items)
    train, test = rows.where("ord < 240"), rows.where("ord >= 240").withColumn("summary", F.when(F.col("ord") < 299, F.col("summary")))
    blend = models.MODELS["ensemble"](train)
    assert blend.weights == pytest.approx({"frontier": 8 / 9, "neural_network": 1 / 9})
    whole = test.where("summary is not null")
    parts = [{r["id"]: r["guess"] for r in m.price(whole).collect()} for m in blend.fitted.values()]
    clamp = lambda x: min(max(x, 0.5), 999.49)
    for r in blend.price(whole).collect():
        assert r["guess"] == pytest.approx(8 / 9 * clamp(parts[0][r["id"]]) + 1 / 9 * clamp(parts[1][r["id"]]))


def test_log_features_model_turns_answers_back_into_dollars(spark, items):
    rows = prepared(items)
    scored = models.log_features_price(rows).price(rows)
    data = rows.select("weight", (F.col("weight") == 0).cast("int"), F.length("summary"), "price").orderBy("id").collect()
    x = np.array([[1, *r[:3]] for r in data], dtype=float)
    y = np.log1p([r[3] for r in data])
    wanted = np.maximum(0, np.expm1(x @ np.linalg.lstsq(x, y, rcond=None)[0]))
    assert [r["guess"] for r in scored.orderBy("id").collect()] == pytest.approx(list(wanted), rel=1e-6)


def test_boosting_stops_where_held_out_rows_gain_no_more(spark, items):
    """Prices without any pattern end it early; planted ones are learned, and held-out rows never train."""
    rows = prepared(items).withColumn("holdout", F.col("ord") % 5 == 0)
    noise = rows.withColumn("price", F.pmod(F.xxhash64("id"), F.lit(900)) + 1.0)
    assert 1 <= models.rounds_used(models.boosted_price(noise, rounds=40, depth=3, holdout="holdout")) < 40
    fitted = models.boosted_price(rows, rounds=8, depth=3, holdout="holdout")
    held = rows.where("holdout")
    assert mean_error(fitted.price(held)) < mean_error(held.withColumn("guess", models.mean_price(rows.where("not holdout"))))
    _, error = models.validated(rows, models.linear_price)
    assert error == pytest.approx(mean_error(models.linear_price(rows.where("not holdout")).price(held)))


def test_validation_keeps_the_best_of_the_passes(spark, items):
    rows = prepared(items).withColumn("holdout", F.col("ord") % 5 == 0)
    best, curve = models.validation_curve(rows, models.MODELS["hashed"], looks=(1, 3, 20))
    assert [n for n, _ in curve] == [1, 3, 20]
    assert mean_error(best.price(rows.where("holdout"))) == pytest.approx(min(e for _, e in curve))


def test_linear_matches_normal_equations(spark, items):
    rows = items.withColumn("price", 3 * F.col("weight") + 0.5 * F.length("summary") + 7)
    priced = models.linear_price(rows).price(rows)
    data = rows.select("weight", (F.col("weight") == 0).cast("int"), F.length("summary"), "price").collect()
    x = np.array([[1, *r[:3]] for r in data], dtype=float)
    expected = x @ np.linalg.lstsq(x, np.array([r[3] for r in data]), rcond=None)[0]
    assert sorted(r["guess"] for r in priced.collect()) == pytest.approx(sorted(expected), abs=1e-6)


def test_model_reload_gives_the_same_price(spark, items, tmp_path):
    rows = prepared(items)
    priced, mean, std = models.log_target_price(rows)
    model_io.save_model(priced.model, str(tmp_path / "m"), mean, std)
    again = models.from_log_target(*model_io.load_model(str(tmp_path / "m")))
    both = again.price(priced.price(rows), "again")
    assert both.where("guess <> again").count() == 0


def test_term_totals_and_embedding(spark):
    rows = spark.createDataFrame([(1, "The big Cat cat a é9"), (2, "cat dog")], "id bigint, summary string")
    assert [tuple(r) for r in models.term_totals(rows, 3).collect()] == [("cat", 3), ("big", 1), ("dog", 1)]
    vector = models.embed_text(rows, models.text_encoder(rows, 32)).first()["embedding"]
    assert len(vector) == 32


def test_projection(spark):
    rng = np.random.default_rng(0)
    frame = vectors(spark, rng.standard_normal((40, 16)))
    rows, explained = models.project(frame)
    assert rows.count() == 40 and len(explained) == 3 and explained == sorted(explained, reverse=True)


def results(spark, errors, truths=None):
    truths = truths or [100.0] * len(errors)
    rows = [("m", i, "t", t, t + e) for i, (e, t) in enumerate(zip(errors, truths))]
    return evaluate.score(spark.createDataFrame(rows, "model string, ord bigint, title string, truth double, guess double"))


def test_metrics(spark):
    perfect = evaluate.eval_metrics(results(spark, [0.0, 0.0], [1.0, 2.0])).first()
    assert (perfect["error"], perfect["r2"]) == (0.0, 100.0)
    shifted = evaluate.eval_metrics(results(spark, [10.0, 10.0], [1.0, 2.0])).first()
    assert shifted["error"] == 10.0 and shifted["ci"] == 0.0
    single = evaluate.eval_metrics(results(spark, [10.0])).first()
    assert single["ci"] == 0.0 and single["r2"] == 0.0


def test_running_error(spark):
    rows = evaluate.running_error(results(spark, [10.0, 20.0, 30.0])).orderBy("ord").collect()
    assert [r["mean_error"] for r in rows] == [10.0, 15.0, 20.0]
    assert rows[0]["ci"] == 0.0 and rows[1]["ci"] == pytest.approx(1.96 * 5 / 2**0.5)


def test_ensemble_and_leaderboard(spark):
    from pricelens import config

    rows = spark.createDataFrame([(1, "frontier", 100.0), (1, "specialist", 200.0), (1, "neural_network", 300.0)], "ord int, model string, guess double")
    assert evaluate.weighted_estimate(rows, config.ENSEMBLE_WEIGHTS, "ord").first()["guess"] == pytest.approx(130.0)
    two = evaluate.weighted_estimate(rows, config.ENSEMBLE_WEIGHTS, "ord", active=config.ACTIVE_MODELS).first()["guess"]
    assert two == pytest.approx(100 * 8 / 9 + 300 / 9)
    wild = spark.createDataFrame([(1, "a", 5000.0), (1, "b", -20.0)], "ord int, model string, guess double")
    assert evaluate.weighted_estimate(wild, {"a": 0.5, "b": 0.5}, "ord").first()["guess"] == pytest.approx(499.995)
    metrics = spark.createDataFrame([("s", "constant", 100.0), ("s", "x", 60.0)], "test_set string, model string, error double")
    board = {r["model"]: r for r in evaluate.leaderboard(metrics).collect()}
    assert board["x"]["rank"] == 1 and board["x"]["percent_lower"] == 40.0 and board["constant"]["models"] == 2

"""Prediction tables and the tables made from them."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricelens import config
from pricelens.functions import scoring
from pricelens.operators.order import prefix_sums


def predict_table(test: DataFrame, **guesses: Column) -> DataFrame:
    """One row per model and test item, from guess expressions over the test columns.

    The test rows are read once: the models are exploded from an array, not joined.
    """
    answers = F.array(*[F.struct(F.lit(m).alias("model"), g.cast("double").alias("guess")) for m, g in guesses.items()])
    rows = test.select(
        "ord", scoring.clip_title(F.col("title")).alias("title"), F.col("price").alias("truth"), F.inline(answers)
    )
    return score(rows)


def predict_fitted(test: DataFrame, fitted: dict) -> DataFrame:
    """The same table for fitted models by name; each has `price(rows)`, as `models.MODELS` makes them."""
    rows = [
        model.price(test).select(
            F.lit(name).alias("model"), "ord", scoring.clip_title(F.col("title")).alias("title"),
            F.col("price").alias("truth"), F.col("guess").cast("double").alias("guess"),
        )
        for name, model in fitted.items()
    ]
    return score(union_tables(*rows))


def predict_prompts(prompts: DataFrame, **guesses: Column) -> DataFrame:
    """The same table for rows of `ord, prompt, completion`: the truth is the completion, the title is in the prompt."""
    rows = prompts.withColumns({
        "title": scoring.prompt_title(F.col("prompt")), "price": F.col("completion").try_cast("double"),
    })
    return predict_table(rows, **guesses)


def guess_by_hand(test: DataFrame, sheet: DataFrame) -> DataFrame:
    """Test rows with the guess that `sheet` (summary, guess) has for their summary; null where it has none."""
    return test.join(sheet.select("summary", "guess"), "summary", "left")


def evaluate(results: DataFrame) -> DataFrame:
    """Per model the metrics, the mean error behind the last row, rows without a guess and the colour bands."""
    metrics = eval_metrics(results)
    last = running_error(results).groupBy("model").agg(F.max_by("mean_error", "ord").alias("last_mean"))
    counts = results.groupBy("model").agg(
        F.count_if(F.col("guess").isNull()).alias("missing"),
        *[F.count_if(F.col("color") == c).alias(c) for c in ("green", "orange", "red")],
    )
    return metrics.join(last, "model").join(counts, "model")


def score(rows: DataFrame) -> DataFrame:
    """Error and colour band for rows of `model, ord, title, truth, guess`."""
    error = F.abs(F.col("guess") - F.col("truth"))
    return rows.select(
        "model", "ord", "title", "truth", "guess", error.alias("error"), scoring.error_band(error, F.col("truth")).alias("color")
    )


def union_tables(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def eval_metrics(results: DataFrame, *keys: str) -> DataFrame:
    """Mean absolute error, its 95 % interval, MSE and r² (in percent) per model."""
    keys = keys or ("model",)
    e = F.col("error")
    n, sse = F.count(F.lit(1)), F.sum(e * e)
    spread = n * F.var_pop("truth")
    flat = F.when(sse == 0, 100.0).otherwise(0.0)
    return results.groupBy(*keys).agg(
        n.alias("n"),
        F.avg(e).alias("error"),
        F.when(n > 1, config.Z95 * F.stddev_pop(e) / F.sqrt(n)).otherwise(0.0).alias("ci"),
        F.avg(e * e).alias("mse"),
        F.when(spread == 0, flat).otherwise(100 * (1 - F.try_divide(sse, spread))).alias("r2"),
    )


def running_error(results: DataFrame) -> DataFrame:
    """After each prediction of a model: mean error so far and its 95 % interval."""
    e = F.col("error")
    summed = prefix_sums(results, "model", "ord", sum_error=e, sum_square=e * e)
    n = (F.col("ord") + 1).cast("double")
    mean = F.col("sum_error") / n
    spread = F.sqrt(F.greatest(F.col("sum_square") / n - mean * mean, F.lit(0.0)))
    return summed.select(
        "model", "ord", mean.alias("mean_error"),
        F.when(F.col("ord") > 0, config.Z95 * spread / F.sqrt(n)).otherwise(0.0).alias("ci"),
    )


def band_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("model", "color").agg(F.count(F.lit(1)).alias("n"))


def leaderboard(metrics: DataFrame, baseline: str = "constant") -> DataFrame:
    """Per test set the models by error, with the gain over the baseline model.

    The windows run over metric rows: one per model and test set.
    """
    per_set = W.partitionBy("test_set")
    base = F.max(F.when(F.col("model") == baseline, F.col("error"))).over(per_set)
    return metrics.select(
        "test_set", "model", "error",
        F.rank().over(per_set.orderBy("error")).alias("rank"),
        F.bround((1 - F.try_divide(F.col("error"), base)) * 100, 0).alias("percent_lower"),
        F.count(F.lit(1)).over(per_set).alias("models"),
    )


def test_sets(results: DataFrame, small: int = config.EVAL_SIZE) -> DataFrame:
    """Every result in the set `all`, the first rows of each model also in the set `first`."""
    sets = F.when(F.col("ord") < small, F.array(F.lit("all"), F.lit("first"))).otherwise(F.array(F.lit("all")))
    return results.select(F.explode(sets).alias("test_set"), "*")


def weighted_estimate(estimates: DataFrame, weights: dict, *keys: str, active=None) -> DataFrame:
    """Mean of the clamped estimates in long-form rows of `model, guess`, by the weights of the active models.

    The weights are a handful of values, so they travel as a map literal.
    """
    weights = {m: w for m, w in weights.items() if active is None or m in active}
    factors = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    part = F.try_element_at(factors, F.col("model")) * scoring.clamp_price(F.col("guess"))
    return estimates.where(F.col("model").isin(*weights)).groupBy(*keys).agg((F.sum(part) / F.lit(float(sum(weights.values())))).alias("guess"))


def metrics_report(metrics: DataFrame) -> DataFrame:
    title = scoring.model_label(F.col("model"))
    return metrics.select(
        "model", title.alias("title"),
        scoring.metrics_text(title, *[F.col(c) for c in ("error", "ci", "mse", "r2")]).alias("report"),
    )

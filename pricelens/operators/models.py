"""Price models: fitted with Spark ML, scored as DataFrame transformations."""

import math

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import (
    CountVectorizerModel, HashingTF, IDF, Normalizer, PCA, RegexTokenizer, StopWordsRemover, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from pricelens import config
from pricelens.functions import scoring
from pricelens.operators import inverted, retrieve
from pricelens.operators.order import hash_key
from pricelens.session import materialize

# Tokens of two or more word characters, in lower case.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def random_price(id_: Column, seed=config.SEED) -> Column:
    """A repeatable integer price from 1 to 999 per row."""
    return (F.pmod(hash_key(id_, f"{seed}:price"), F.lit(999)) + 1).cast("double")


def mean_price(train: DataFrame) -> Column:
    return train.agg(F.avg("price")).scalar()


def log_target_stats(train: DataFrame) -> DataFrame:
    """Mean and sample deviation of ln(price + 1)."""
    return train.agg(F.avg(F.log1p("price")).alias("y_mean"), F.stddev_samp(F.log1p("price")).alias("y_std"))


def with_features(items: DataFrame) -> DataFrame:
    return items.withColumns(dict(zip(
        ("f_weight", "f_weight_unknown", "f_text_length"),
        scoring.price_features(F.col("weight"), F.col("summary")),
    )))


class Priced:
    """A fitted pipeline with the steps around it: input columns before, price after."""

    def __init__(self, model: PipelineModel, prepare=None, finish=None):
        self.model, self.prepare, self.finish = model, prepare, finish

    def price(self, items: DataFrame, name: str = "guess") -> DataFrame:
        ready = self.prepare(items) if self.prepare else items
        scored = self.model.transform(ready)
        guess = self.finish(F.col("prediction")) if self.finish else F.col("prediction")
        return scored.withColumn(name, guess).select(*items.columns, name)


def linear_price(train: DataFrame) -> Priced:
    """Least squares on weight, weight-unknown and text length; not floored."""
    assemble = VectorAssembler(inputCols=["f_weight", "f_weight_unknown", "f_text_length"], outputCol="features")
    regress = LinearRegression(labelCol="price", solver="normal", regParam=0.0)
    return Priced(Pipeline(stages=[assemble, regress]).fit(with_features(train)), prepare=with_features)


class Retrieved:
    """Prices of the most similar known texts: vectors of both sides, a distributed neighbour join, a mean by inverse distance.

    `embed` adds a column `embedding` to rows with a `summary`. With `lists` the search is approximate.
    """

    def __init__(self, known: DataFrame, embed, k: int = config.NEIGHBOURS, lists=None, entries: DataFrame = None):
        self.known, self.embed, self.k, self.lists, self.entries = known, embed, k, lists, entries

    def price(self, items: DataFrame, name: str = "guess") -> DataFrame:
        """Every row of `items` (by its `id`); one without a vector or a neighbour has no guess."""
        asked = materialize(self.embed(items).select("id", "embedding").where(F.col("embedding").isNotNull()), "asked")
        if self.lists is None:
            found = retrieve.nearest(asked, self.known, self.k)
        else:
            found = inverted.search(asked, self.known, self.entries, self.lists, self.k)
        guesses = retrieve.neighbour_price(found.join(self.known.select("id", "price"), "id"))
        return items.join(guesses.select(F.col("query_id").alias("id"), F.col("guess").alias(name)), "id", "left").select(*items.columns, name)


def retrieval_price(train: DataFrame, embed=None, k: int = config.NEIGHBOURS, approximate: bool = False) -> Retrieved:
    """Keep the vectors and prices of `train`; by default those of `text_encoder`, fitted on it."""
    if embed is None:
        encoder = text_encoder(train)
        embed = lambda rows: embed_text(rows, encoder)
    known = materialize(embed(train).select("id", "price", "embedding").where(F.col("embedding").isNotNull()), "known")
    lists = inverted.learn(known) if approximate else None
    entries = materialize(inverted.encode(known, lists), "entries") if lists else None
    return Retrieved(known, embed, k, lists, entries)


class Blended:
    """A weighted mean of the clamped prices of fitted models; the weights are those of the models given.

    Where one has no price, the row has none.
    """

    def __init__(self, fitted: dict, weights: dict = None):
        weights = config.ENSEMBLE_WEIGHTS if weights is None else weights
        total = sum(weights[name] for name in fitted)
        self.fitted, self.weights = fitted, {name: weights[name] / total for name in fitted}

    def price(self, items: DataFrame, name: str = "guess") -> DataFrame:
        rows = items
        for i, model in enumerate(self.fitted.values()):
            rows = model.price(rows, f"_price_{i}")
        parts = [F.lit(w) * scoring.clamp_price(F.col(f"_price_{i}")) for i, w in enumerate(self.weights.values())]
        return rows.withColumn(name, sum(parts[1:], parts[0])).select(*items.columns, name)


def ensemble_price(train: DataFrame, embed=None, **parameters) -> Blended:
    """Retrieval and the model of the log price, by the configured weights."""
    return Blended({"frontier": retrieval_price(train, embed, **parameters), "neural_network": log_target_price(train)[0]})


def log_features_price(train: DataFrame) -> Priced:
    """The model of the log price on weight, weight-unknown and text length instead of words, by the normal equations."""
    stats = log_target_stats(train).first()
    assemble = VectorAssembler(inputCols=["f_weight", "f_weight_unknown", "f_text_length"], outputCol="features")
    regress = LinearRegression(labelCol="_target", solver="normal", regParam=0.0)
    target = with_features(train).withColumn("_target", (F.log1p("price") - stats["y_mean"]) / stats["y_std"])
    found = from_log_target(Pipeline(stages=[assemble, regress]).fit(target), stats["y_mean"], stats["y_std"])
    return Priced(found.model, prepare=with_features, finish=found.finish)


def word_stages(stop_words=None):
    remover = StopWordsRemover(inputCol="tokens", outputCol="words")
    if stop_words is not None:
        remover.setStopWords(list(stop_words))
    return [RegexTokenizer(inputCol="summary", outputCol="tokens", pattern=TOKEN, gaps=False), remover]


def bag_of_words(train: DataFrame, terms: int = config.BAG_TERMS, stop_words=None):
    """Term counts over the most frequent terms of all rows of `train`, without stop words.

    The vocabulary is that of `term_totals`, so ties are settled and at most `terms` words are collected.
    """
    words = [r["term"] for r in term_totals(train, terms, stop_words).collect()]
    count = CountVectorizerModel.from_vocabulary(words or ["-"], inputCol="words", outputCol="features")
    return [*word_stages(stop_words), count]


def term_totals(train: DataFrame, terms: int = config.BAG_TERMS, stop_words=None) -> DataFrame:
    """The vocabulary and its counts; ties in count go to the earlier term."""
    words = Pipeline(stages=word_stages(stop_words)).fit(train).transform(train)
    counts = words.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "term").limit(terms)


def _text_model(train: DataFrame, features, regressor) -> Priced:
    return Priced(Pipeline(stages=[*features, regressor]).fit(train), finish=scoring.nonneg)


def nlp_linear_price(train: DataFrame) -> Priced:
    """Least squares on term counts, by the normal equations: one pass, as there are no more than 4,096 terms."""
    return _text_model(train, bag_of_words(train), LinearRegression(labelCol="price", solver="normal", regParam=0.0))


# The deepest trees Spark grows.
MOST_DEPTH = 30


def forest_price(train: DataFrame, rows: int = config.FOREST_ROWS, trees: int = 100, depth: int = MOST_DEPTH) -> Priced:
    """Random forest on the first rows by position, with the vocabulary of all rows.

    Trees are as deep as Spark lets them be; a query that wants less names its own `depth`.
    """
    forest = RandomForestRegressor(labelCol="price", numTrees=trees, maxDepth=depth, seed=config.SEED)
    return _text_model(train.where(F.col("ord") < rows), bag_of_words(train), forest)


# Rows of a partition that trees are grown on: at 2,000 terms, 66 MB of bins.
TREE_ROWS = 8_192
def dealt(train: DataFrame, *columns: str) -> DataFrame:
    """Rows for trees, of the columns that they need, in partitions of at most about `TREE_ROWS`.

    Trees are grown on binned rows that stay in memory, four bytes for each term, however small the stored
    texts are: a task that reads few bytes of text holds, and reads again for every level, very many of bins.
    """
    rows = train.select("summary", "price", *columns)
    wanted = math.ceil(train.count() / TREE_ROWS)
    return rows.repartition(wanted) if wanted > rows.rdd.getNumPartitions() else rows


def boosted_price(train: DataFrame, rounds: int = config.BOOSTING_ROUNDS, depth: int = 6, holdout: str = None) -> Priced:
    """Boosted trees at rate 0.1, `rounds` of them at the most.

    With `holdout`, a boolean column (as `curate.holdout` adds it), these rows don't train, and rounds end
    where their error improves no more; the model keeps the rounds before that.
    """
    boost = GBTRegressor(labelCol="price", stepSize=0.1, maxDepth=depth, maxIter=rounds, seed=config.SEED)
    if holdout:
        boost = boost.setValidationIndicatorCol(holdout)
    bag = bag_of_words(train.where(~F.col(holdout)) if holdout else train)
    return _text_model(dealt(train, *([holdout] if holdout else [])), bag, boost)


def rounds_used(fitted: Priced) -> int:
    """Trees of a boosted model."""
    return fitted.model.stages[-1].getNumTrees


def validated(train: DataFrame, fit, holdout: str = "holdout", **parameters) -> tuple[Priced, float]:
    """A model fitted on the rows that are not held out, and its mean error in dollars on those that are."""
    fitted = fit(train.where(~F.col(holdout)), **parameters)
    held = fitted.price(train.where(F.col(holdout)))
    return fitted, held.agg(F.avg(F.abs(F.col("guess") - F.col("price")))).first()[0]


def hashed_words(size: int = config.HASH_FEATURES, stop_words=None):
    """Binary hashed bag of words with rows of unit length."""
    return [
        *word_stages(stop_words),
        HashingTF(inputCol="words", outputCol="_hashed", numFeatures=size, binary=True),
        Normalizer(inputCol="_hashed", outputCol="features"),
    ]


# Passes over the rows that the hashed models make, and after which of them a validation looks at the error.
PASSES, LOOKS = 50, (1, 2, 5, 10, 20, 50)


def log_target_price(train: DataFrame, regressor=None, passes: int = PASSES) -> tuple[Priced, float, float]:
    """Regression on the standardised log price; answers are turned back into dollars."""
    stats = log_target_stats(train).first()
    regress = regressor or LinearRegression(labelCol="_target", solver="l-bfgs", regParam=0.01, maxIter=passes)
    target = train.withColumn("_target", (F.log1p("price") - stats["y_mean"]) / stats["y_std"])
    model = Pipeline(stages=[*hashed_words(), regress]).fit(target)
    return from_log_target(model, stats["y_mean"], stats["y_std"]), stats["y_mean"], stats["y_std"]


def from_log_target(model: PipelineModel, mean: float, std: float) -> Priced:
    return Priced(model, finish=lambda y: scoring.nonneg(F.exp(y * std + mean) - 1))


def hashed_price(train: DataFrame, passes: int = PASSES) -> Priced:
    """Linear model on the hashed bag with the plain price as target."""
    return _text_model(train, hashed_words(), LinearRegression(labelCol="price", solver="l-bfgs", regParam=0.01, maxIter=passes))


def validation_curve(train: DataFrame, fit, looks=LOOKS, holdout: str = "holdout") -> tuple[Priced, list[tuple[int, float]]]:
    """The model whose mean error in dollars on the held-out rows is least, and that error after each number of passes.

    A linear regression can't go on from an earlier model, so each look fits anew; as looks grow by a factor,
    all of them together cost about twice the last one. Of equal errors the fewest passes count.
    """
    whole = materialize(train, "validation")
    found = [(*validated(whole, fit, holdout, passes=n), n) for n in looks]
    best = min(found, key=lambda f: (f[1], f[2]))[0]
    return best, [(n, error) for _, error, n in found]


def text_encoder(items: DataFrame, size: int = 256) -> PipelineModel:
    """Default text vectors: hashed counts, inverse document frequency, unit length."""
    stages = [
        *word_stages(),
        HashingTF(inputCol="words", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vector"),
    ]
    return Pipeline(stages=stages).fit(items)


def embed_text(items: DataFrame, encoder: Transformer) -> DataFrame:
    return encoder.transform(items).select(*items.columns, vector_to_array("_vector").alias("embedding"))


def project(rows: DataFrame, dims: int = 3) -> tuple[DataFrame, list[float]]:
    """Principal-component coordinates of the vectors and the explained variance."""
    vectors = rows.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(vectors)
    coords = vector_to_array("_p")
    out = model.transform(vectors).select("*", *[coords[i].alias(f"x{i + 1}") for i in range(dims)])
    return out.drop("_v", "_p"), [float(v) for v in model.explainedVariance]


# Fit functions by model name; each takes the training split and returns something with `.price`.
MODELS = {
    "linear": linear_price,
    "nlp_linear": nlp_linear_price,
    "random_forest": forest_price,
    "boosted": boosted_price,
    "hashed": hashed_price,
    "log_target": lambda train, **parameters: log_target_price(train, **parameters)[0],
    "log_features": log_features_price,
    "retrieval": retrieval_price,
    "ensemble": ensemble_price,
}

"""Mixing documents to target weights by soft membership.

A classifier trained on a table of labels gives every document a posterior over domains. Document
rates r >= 0 are then fitted so that the expected tokens of each domain, sum of r * tokens *
posterior, meet their targets: a nonnegative least-squares problem, solved by projected gradient
descent from r = 1, so that documents change no more than they must. A step's direction is scaled
by the small matrix of what the domains share among documents with r > 0; should a scaled step not
bring the totals closer, a plain one follows, which always does.

Posteriors are rounded to a grid. Documents of one grid point have the same rate at every step, so
a step works on the totals of the grid points: one pass over the documents adds them up, however
many documents there are, and the grid bounds their number.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import arrow_of, batches_of, carried, materialize, renamed, schema_of
from pricelens.llm.language import SAMPLE_CHARS, sampled

BUCKETS, EPOCHS, RATE, SEED = 1 << 14, 12, 2.0, 77
# Labelled rows of each domain that the classifier learns from; a row has at most SAMPLE_CHARS of language.py.
SAMPLE_ROWS = 1000
# Decimals of a posterior.
GRID = 2
STEPS, STEP, TOLERANCE = 50, 1.6, 1e-6
# Grid points sent to every task; more are joined by a shuffle. Three domains have 5,151 points at most.
BROADCAST_POINTS = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BLOCK = 1 << 19


def word_buckets(data: bytes):
    """Start and hash bucket of every word of UTF-8 bytes, all at once.

    With H the running sum of byte * b^position, a word's hash is (H[end] - H[start]) * b^-start: the
    same wherever the word stands, since b is odd and so has an inverse modulo 2^64.
    """
    codes = np.frombuffer(data, np.uint8)
    space = _SPACE[codes]
    edges = np.flatnonzero(np.diff(np.r_[True, space, True].view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.int64)
    power = np.full(len(codes), _ODD, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    low = codes + np.where((codes >= 65) & (codes <= 90), 32, 0).astype(np.uint8)
    sums = np.r_[np.uint64(0), np.add.accumulate((low.astype(np.uint64) + np.uint64(1)) * power)]
    back = np.full(len(codes), _INVERSE, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    mixed = (sums[ends] - sums[starts]) * back[starts]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return starts, (mixed >> np.uint64(64 - 14)).astype(np.int64)


@dataclass
class Domains:
    names: list[str]
    weights: np.ndarray  # (BUCKETS, domains)
    bias: np.ndarray

    def posteriors(self, texts: list[str]):
        """Posterior of each text on the grid, and its number of words."""
        total, words = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), np.int64)
        for first, data, starts in _joined(texts):
            at, buckets = word_buckets(data)
            if len(at):
                owner = np.searchsorted(starts, at, "right") - 1
                # Each word counts once for every time it stands in the text, under a square root.
                key, n = np.unique(owner * BUCKETS + buckets, return_counts=True)
                own, bucket = key // BUCKETS, key % BUCKETS
                np.add.at(total, first + own, np.sqrt(n)[:, None] * self.weights[bucket])
                scale = np.bincount(own, np.asarray(n, float), minlength=len(starts))
                held = slice(first, first + len(starts))
                total[held] /= np.sqrt(np.maximum(scale, 1))[:, None]
                words[held] += np.bincount(owner, minlength=len(starts))
        p = np.exp(total + self.bias - (total + self.bias).max(axis=1, keepdims=True))
        return np.round(p / p.sum(axis=1, keepdims=True), GRID), words


def _joined(texts):
    """Texts joined up to BLOCK bytes: position of the first, the bytes, and where each begins."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        if held and size + len(data) > BLOCK:
            yield first, b"\n".join(held), np.cumsum([0] + [len(h) + 1 for h in held[:-1]])
            first, held, size = i, [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, b"\n".join(held), np.cumsum([0] + [len(h) + 1 for h in held[:-1]])


def _features(text):
    _, buckets = word_buckets(text.encode("utf-8", "surrogatepass"))
    bucket, n = np.unique(buckets, return_counts=True)
    return bucket, np.sqrt(n) / np.sqrt(max(n.sum(), 1))


def train(rows: list[tuple[str, str]], seed=SEED) -> Domains:
    """A softmax over words by stochastic gradient descent; each domain weighs as much as its share of rows."""
    rows = sorted(rows)
    names = sorted({label for _, label in rows})
    weights, bias = np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    bags = [_features(text) for text, _ in rows]
    own = [names.index(label) for _, label in rows]
    random = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in random.permutation(len(rows)):
            bucket, value = bags[i]
            z = value @ weights[bucket] + bias
            wrong = np.exp(z - z.max())
            wrong /= wrong.sum()
            wrong[own[i]] -= 1
            weights[bucket] -= rate * value[:, None] * wrong
            bias -= 0.01 * rate * wrong
    return Domains(names, weights, bias)


def fit(docs: DataFrame, labels: DataFrame, *, text="text", key="doc_id", label="label", rows=SAMPLE_ROWS) -> Domains:
    """A classifier of the domains in `labels` (key, label), from a bounded sample of labelled documents."""
    names = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    # Keys are chosen without texts, so no text is shuffled; at most `rows` for each domain are broadcast.
    listed = docs.select(F.col(key).alias("key"), F.length(text).alias("n")).where(F.col("n").between(1, SAMPLE_CHARS))
    chosen = sampled(listed.distinct().join(names, "key"), rows).select("key", "label")
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    return train([(r.text, r.label) for r in sampled(known.where(F.length("text") <= SAMPLE_CHARS), rows).select("text", "label").collect()])


def posteriors(docs: DataFrame, model: Domains, *, text="text", carry=("doc_id",)) -> DataFrame:
    """The columns `carry`, `tokens` (words) and `posterior` (an array in the order of `model.names`)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, held = carried(docs, text, carry)

    def run(batches):
        for batch in batches_of(batches, "_text", 8 << 20):
            p, words = shared.value.posteriors([t or "" for t in batch.column("_text").to_pylist()])
            yield arrow_of(batch, held, {"tokens": pa.array(words), "posterior": pa.array(list(p), pa.list_(pa.float64()))})

    out = rows.mapInArrow(run, schema_of(held, "tokens long, posterior array<double>"))
    return renamed(out, held, "tokens", "posterior")


def rates(member: DataFrame, names: list[str], targets: dict[str, float], total: float | None = None) -> DataFrame:
    """`posterior, rate` of every grid point of `member` (tokens, posterior).

    `targets` are weights of domains; `total` the expected tokens of the mixture, by default what there is.
    """
    cells = materialize(member.groupBy("posterior").agg(F.sum("tokens").alias("tokens")), "mixing-cells")
    count = len(names)
    part = lambda i: F.get("posterior", F.lit(i))
    pairs = [(i, j) for i in range(count) for j in range(i + 1)]

    def totals(rate):
        """Expected tokens of each domain, and of each pair of domains in documents with a rate over 0."""
        weigh = lambda x: F.coalesce(F.sum(F.col("tokens") * x), F.lit(0.0))
        there = F.when(F.col("_rate") > 0, 1.0).otherwise(0.0)
        row = cells.withColumn("_rate", rate).agg(
            *[weigh(part(i) * F.col("_rate")).alias(f"t{i}") for i in range(count)],
            *[weigh(part(i) * part(j) * there).alias(f"m{i}_{j}") for i, j in pairs],
        ).first()
        shared = np.zeros((count, count))
        for (i, j), x in zip(pairs, row[count:]):
            shared[i, j] = shared[j, i] = x
        return np.array(row[:count]), shared

    reached, shared = totals(F.lit(1.0))
    mass = reached
    wish = np.array([max(0.0, targets.get(n, 0.0)) for n in names])
    # A domain that no document belongs to can't be filled; the others share its weight.
    wish = np.where(mass > 0, wish, 0)
    goal = wish / max(wish.sum(), 1e-12) * (mass.sum() if total is None else total)
    steps: list[list[float]] = []
    far = np.inf
    for _ in range(STEPS):
        before, far = far, distance(reached, goal, mass)
        if far < TOLERANCE:
            break
        steps.append([float(x) for x in direction(reached - goal, shared, mass, scaled=far < 0.9 * before)])
        reached, shared = totals(_rate(steps, part, count))
    return cells.select("posterior", F.round(_rate(steps, part, count), 6).alias("rate"))


def distance(reached, goal, mass) -> float:
    return float(np.abs((reached - goal)[mass > 0] / mass[mass > 0]).max(initial=0))


def direction(over, shared, mass, scaled: bool):
    """Where rates go down, per unit of posterior, for domains that have `over` too many tokens.

    A plain step measures by each domain's tokens: in that measure the matrix of the problem has rows
    that sum to one, so steps under 2 never diverge, whatever the data.
    """
    held = mass > 0
    out = np.zeros(len(mass))
    if scaled:
        out[held] = np.linalg.solve(shared[np.ix_(held, held)] + 1e-6 * np.diag(mass[held]), over[held])
    else:
        out[held] = STEP * over[held] / mass[held]
    return out


def _rate(steps, part, domains):
    """The rate of a grid point after all steps so far: descend along its posterior, then project onto r >= 0."""
    rate = F.lit(1.0)
    for s in steps:
        downhill = sum((part(i) * F.lit(s[i]) for i in range(1, domains)), part(0) * F.lit(s[0]))
        rate = F.greatest(F.lit(0.0), rate - downhill)
    return rate


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], *, text="text", key="doc_id", label="label",
        total=None, carry=None) -> DataFrame:
    """Every row's `carry` columns (by default the key), `domain, tokens, posterior, rate, copies`.

    `copies` is the whole part of the rate, and one more where a hash of the key falls below the rest,
    so the expected number of copies is the rate and the draw doesn't depend on partitions. Null and
    empty texts have no tokens and the posterior of the classifier's bias; repeated rows are mixed
    alike; without any labelled row there are no domains and all rates are 1. Other columns are not read.
    """
    carry = (key,) if carry is None else tuple(carry)
    model = fit(docs, labels, text=text, key=key, label=label)
    if not model.names:
        model = Domains(["all"], np.zeros((BUCKETS, 1)), np.zeros(1))
        targets = {"all": 1.0}
    member = materialize(posteriors(docs, model, text=text, carry=(*carry, *([] if key in carry else [key]))), "mixing-members")
    fitted = materialize(rates(member.select("tokens", "posterior"), model.names, targets, total), "mixing-rates")
    names = F.array(*[F.lit(n) for n in model.names])
    best = F.get(names, (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("rate")
    # The grid bounds the points for few domains; with many they may be more than is fit to broadcast.
    if fitted.count() <= BROADCAST_POINTS:
        fitted = F.broadcast(fitted)
    return member.join(fitted, "posterior").select(
        *carry, best.alias("domain"), "tokens", "posterior", "rate",
        (whole + (draw < F.col("rate") - whole).cast("long")).alias("copies"),
    )

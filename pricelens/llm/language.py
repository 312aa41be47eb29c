"""Language identification: averaged hashed subword embeddings under a linear softmax.

Every run of one to four characters inside a word, or touching its edge, is hashed to a row of an
embedding matrix; a text is the average of its rows, and a linear softmax on it gives the
languages. The model is trained by stochastic gradient descent in numpy on a bounded sample. Since
everything behind the lookup is linear, the two matrices are multiplied once and a prediction is a
gather and a sum.

The softmax is sharpened by a temperature and gets a rejection threshold, both fitted on sample
rows that training has not seen. A text of two languages gets a low probability too, so a text is
rejected only if its evidence is low as well: the mean over its subwords of their highest logit,
whichever language that speaks for. Languages differ in it, so each has a threshold, fitted on held-back
rows and on mixtures of them that are taken for it.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pricelens.llm.common import arrow_of, batches_of, carried, once, renamed, schema_of

BUCKETS, DIMENSIONS, SIZES = 1 << 15, 16, (1, 2, 3, 4)
# Bounds of the training sample: rows of each language, and characters of a row.
SAMPLE_ROWS, SAMPLE_CHARS = 600, 1 << 16
EPOCHS, RATE, SEED = 8, 4.0, 20240
# Rejection needs both: the share of rightly predicted calibration rows that may fall below the threshold of
# the probability, and below that of the evidence.
WRONGLY_REJECTED, LITTLE_EVIDENCE = 0.001, 0.01
# The normal quantile (one in a thousand) that is widened where calibration rows are few.
RARE = 3.09
# Mixtures of each calibration row with others.
MIXTURES = 4
UNDETERMINED = "und"
# Characters handled at once; longer texts are summed up over blocks that overlap by a subword.
BLOCK = 1 << 18


@once
def _letters():
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


SPACE = np.array([32], np.uint32)


def points(text: str):
    """Code points in lower case behind a space, so that the first word has an edge. Who uses them puts a space behind the last."""
    return np.frombuffer((" " + text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)


def subwords(codes) -> list:
    """Bucket of the subword of each size that starts at each position; BUCKETS where there is none."""
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    found, mixed = [], np.zeros(len(codes), np.uint64)
    inside = np.ones(len(codes), bool)  # all but the ends are letters
    some = np.zeros(len(codes), bool)
    for n in range(1, max(SIZES) + 1):
        end = len(codes) - n + 1
        if end <= 0:
            break
        mixed = mixed[:end] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:]
        some = some[:end] | letter[n - 1:]
        if n > 2:
            inside = inside[:end] & letter[n - 2: len(codes) - 1]
        else:
            inside = inside[:end]
        if n in SIZES:
            mix = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
            found.append(np.where(inside & some, (mix >> np.uint64(49)).astype(np.int32), BUCKETS))
    return found


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS + 1, languages + 2): logits of each subword, the highest of them, and 1; the last row is 0
    temperature: float
    threshold: float
    evidence: np.ndarray | None = None  # threshold of each language

    def totals(self, texts: list[str]):
        """Summed logits and the number of subwords of each text."""
        out = np.zeros((len(texts), self.weights.shape[1]))
        group, size = [], 0
        for i, text in enumerate(texts):
            codes = points(text)
            if len(codes) > BLOCK:
                codes = np.append(codes, SPACE)
                step = BLOCK - max(SIZES) + 1
                for start in range(0, len(codes), step):
                    out[i] += self._block(codes[start: start + BLOCK], step)
                continue
            group.append((i, codes))
            size += len(codes)
            if size > BLOCK:
                self._sum(group, out)
                group, size = [], 0
        self._sum(group, out)
        return out

    def _values(self, codes):
        total = np.zeros((len(codes), self.weights.shape[1]), np.float32)
        for buckets in subwords(codes):
            total[: len(buckets)] += self.weights[buckets]
        return total

    def _block(self, codes, step):
        return self._values(codes)[:step].sum(axis=0, dtype=np.float64)

    def _sum(self, group, out):
        if not group:
            return
        # Each text begins with a space, which is the edge of the one before it too.
        values = self._values(np.concatenate([*(codes for _, codes in group), SPACE])).astype(np.float64)
        starts = np.cumsum([0] + [len(codes) for _, codes in group[:-1]])
        out[[i for i, _ in group]] = np.add.reduceat(values, starts, axis=0)

    def predict(self, texts: list[str]):
        """Index of the language and its calibrated probability; -1 and 0 where no letter is."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str]):
        """What `predict` gives, and whether each text is rejected."""
        totals = self.totals(texts)
        count = totals[:, -1]
        means = totals[:, :-1] / np.maximum(count, 1)[:, None]
        logits = means[:, :-1] * self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = np.where(count > 0, p[np.arange(len(p)), best], 0.0)
        unlike = (score < self.threshold) & (means[:, -1] < self.evidence[best])
        return np.where(count > 0, best, -1), score, (count == 0) | unlike


def train(texts: list[str], languages: list[str], seed=SEED) -> Model:
    """Fit on every row but each fifth of a language, which calibrate; the order of rows doesn't matter."""
    rows = sorted(zip(languages, texts))
    names = sorted({lang for lang, _ in rows})
    if not names:
        return Model([], np.zeros((BUCKETS + 1, 2), np.float32), 1.0, 0.0)
    bags, own = [], []
    for lang, text in rows:
        found = subwords(np.append(points(text), SPACE))
        buckets, counts = np.unique(np.concatenate(found or [np.zeros(0, int)]), return_counts=True)
        held = buckets < BUCKETS
        if held.any():
            bags.append((buckets[held], counts[held] / counts[held].sum()))
            own.append(names.index(lang))
    calibrates = np.arange(len(bags)) % 5 == 4
    random = np.random.default_rng(seed)
    embeddings = random.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    output = np.zeros((DIMENSIONS, len(names)))
    learns = np.flatnonzero(~calibrates)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in random.permutation(learns):
            buckets, share = bags[i]
            hidden = share @ embeddings[buckets]
            wrong = _softmax(hidden @ output)
            wrong[own[i]] -= 1
            back = output @ wrong
            output -= rate * 0.1 * np.outer(hidden, wrong)
            embeddings[buckets] -= rate * share[:, None] * back[None, :]
    weights = np.zeros((BUCKETS + 1, len(names) + 2), np.float32)
    weights[:-1, :-2] = embeddings @ output
    weights[:-1, -2] = weights[:-1, :-2].max(axis=1)
    weights[:-1, -1] = 1
    held_back = [i for i in np.flatnonzero(calibrates)] or list(learns)
    means = np.array([bags[i][1] @ weights[bags[i][0], :-1] for i in held_back]).reshape(-1, len(names) + 1)
    truth = np.array([own[i] for i in held_back], int)
    return Model(names, weights, *_calibrate(means[:, :-1], truth, means[:, -1]))


def _softmax(x):
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _expected_least(evidence) -> float:
    """What another text of the same language will hardly fall below: the lower end of a prediction interval.

    A quantile of a few rows is little more than their minimum, which new texts often pass. The interval widens as
    rows get fewer (Student's t, by its expansion around the normal quantile), and with under three it has no end.
    """
    n = len(evidence)
    if n < 3:
        return -np.inf
    z, df = RARE, n - 1
    t = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
    return float(evidence.mean() - t * evidence.std(ddof=1) * np.sqrt(1 + 1 / n))


def _calibrate(logits, truth, evidence):
    """Temperature of the least cross-entropy, and the probability and evidence below which predictions are rejected."""
    rows = np.arange(len(truth))
    loss = lambda t: -np.log(_softmax(logits * t)[rows, truth] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.25, 16, 49), key=loss))
    p = _softmax(logits * temperature)
    right = p.argmax(axis=1) == truth
    own = evidence[right]
    if not right.any():
        return temperature, 0.0, np.zeros(logits.shape[1])
    score = np.sort(p.max(axis=1)[right])
    # Half of one row and half of another of a different language.
    one, other = np.tile(rows, MIXTURES), np.concatenate([np.random.default_rng(SEED + i).permutation(len(rows)) for i in range(MIXTURES)])
    one, other = (x[truth[one] != truth[other]] for x in (one, other))
    taken_for = np.r_[truth[right], (logits[one] + logits[other]).argmax(axis=1)]
    evidence = np.r_[evidence[right], (evidence[one] + evidence[other]) / 2]
    of_language = [np.sort(evidence[taken_for == k]) for k in range(logits.shape[1])]
    alone = [_expected_least(own[truth[right] == k]) for k in range(logits.shape[1])]
    least = [min(float(e[int(LITTLE_EVIDENCE * len(e))]), low) if len(e) else 0.0 for e, low in zip(of_language, alone)]
    return temperature, float(score[int(WRONGLY_REJECTED * len(score))]), np.array(least)


def sample(docs: DataFrame, *, text="text", label="lang", key="doc_id", rows=SAMPLE_ROWS) -> list[tuple[str, str]]:
    """Up to `rows` labelled texts of each label, chosen by a hash of the key: a bounded number, alike at any size.

    Labels are counted first. A label's rows then pass a hash threshold that leaves about four times
    the wanted number, and of these the smallest hashes are taken.
    """
    labelled = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label")).where(
        F.col("label").isNotNull() & (F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS)
    )
    return [(r.text, r.label) for r in sampled(labelled, rows).select("text", "label").collect()]


def sampled(labelled: DataFrame, rows: int) -> DataFrame:
    """Up to `rows` rows of each `label`: those with the smallest hashes of `key`."""
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not counts:
        return labelled
    mark = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    pass_below = F.coalesce(*[
        F.when(F.col("label") == k, F.lit(min(1 << 30, (4 * rows << 30) // n))) for k, n in counts.items()
    ])
    near = labelled.withColumn("mark", mark).where(F.col("mark") < pass_below)
    place = F.row_number().over(Window.partitionBy("label").orderBy("mark", "key"))
    return near.withColumn("place", place).where(F.col("place") <= rows)


def fit(docs: DataFrame, **where) -> Model:
    """A model of the labelled rows of `docs`; with no label at all it knows no language."""
    rows = sample(docs, **where)
    return train([t for t, _ in rows], [label for _, label in rows])


def identify(docs: DataFrame, model: Model, *, text="text", key="doc_id", carry=()) -> DataFrame:
    """`key`, the columns `carry`, and `lang_pred, score, rejected`, row by row on the map side.

    `und` with score 0 stands for null or letterless texts, and for all if the model knows no
    language; these are rejected, as are predictions with both less calibrated probability and less
    evidence than the thresholds. Texts are read whole, however long. Repeated rows are predicted each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, held = carried(docs, text, (key, *[c for c in carry if c != key]))

    def run(batches):
        known = shared.value
        for batch in batches_of(batches, "_text", 8 << 20):
            if known.languages:
                best, score, rejected = known.judge([t or "" for t in batch.column("_text").to_pylist()])
            else:
                best, score, rejected = np.full(batch.num_rows, -1), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            names = pa.array([known.languages[b] if b >= 0 else UNDETERMINED for b in best], pa.string())
            yield arrow_of(batch, held, {"lang_pred": names, "score": pa.array(np.round(score, 6)), "rejected": pa.array(rejected)})

    out = rows.mapInArrow(run, schema_of(held, "lang_pred string, score double, rejected boolean"))
    return renamed(out, held, "lang_pred", "score", "rejected")

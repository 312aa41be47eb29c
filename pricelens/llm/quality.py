"""Quality by weak supervision, in DataFrame functions only.

Rules look at a document and vote good, vote bad or abstain. Nobody says how far to trust each rule:
expectation-maximisation estimates from the votes themselves how often a rule votes so on good and
on bad documents, and how common good ones are. The posterior probability of a document being good
replaces the habit of keeping what passes every rule.

Most rules know one symptom. Where they don't find it they abstain, since a document without this
symptom may have another.

Documents with the same votes have the same posterior. So the votes are counted once (a partial
aggregate whose size is bounded by the number of possible votes), and all rounds of the estimation
run inside one expression over those counts.
"""

from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import materialize

WINDOW = 8
GOOD, BAD, ABSTAIN = 1, 0, -1
ROUNDS = 40
# Before the first round: share of good documents, and how often a rule votes rightly and wrongly.
PRIOR, RIGHT, WRONG = 0.85, 0.3, 0.05
# Imagined votes that counts start from, and the most that one vote may change the odds.
IMAGINED, MOST_ODDS = 2.0, 40
KEEP_FROM = 0.5

# Rule: (votes good where, votes bad where). Both conditions are over the measured columns.
RULES = {
    "length": ("n_words >= 40", "n_words < 12"),
    "word_length": ("false", "word_chars > 14 * n_words OR 10 * word_chars < 20 * n_words"),
    "symbols": ("false", "10 * n_symbols > n_words"),
    "marks": ("20 * n_marks <= word_chars", "100 * n_marks > 8 * word_chars"),
    "marked_words": ("false", "100 * n_symbols > 4 * n_words AND 100 * n_marks > 6 * word_chars"),
    "duplicate_lines": ("false", "n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines"),
    "repeated_words": ("false", "4 * n_repeat_words > n_words"),
    "capitals": ("false", "100 * n_capitals > 30 * n_letters"),
    "shouting": ("false", "10 * n_exclaims > n_words"),
    "variety": ("n_words BETWEEN 20 AND 400 AND 10 * n_distinct >= 4 * n_words", "n_words BETWEEN 20 AND 1000 AND 5 * n_distinct < n_words"),
    "sentences": ("n_ends >= 1 AND 80 * n_ends >= n_words AND 3 * n_ends <= n_words", "n_words >= 50 AND 400 * n_ends < n_words"),
}
SPACES = " \t\n\x0b\f\r"


def measured(docs: DataFrame, *, text="text", key="doc_id") -> DataFrame:
    """`key`, the measures the rules look at, and `base_failed`."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), t.alias("t"), F.btrim(t, F.lit(SPACES)).alias("trimmed"))
    rows = rows.select(
        "key", "t",
        F.expr(r"CASE WHEN trimmed = '' THEN CAST(array() AS array<string>) ELSE split(trimmed, '[\\x20\\x09-\\x0D]+') END AS words"),
        F.expr(r"filter(split(t, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]') AS lines"),
    )
    count = lambda characters: F.length(F.regexp_replace("t", f"[^{characters}]+", "")).cast("long")
    rows = rows.select(
        "key", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        count("\\p{L}").alias("n_letters"), F.length(F.regexp_replace("t", r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")).cast("long").alias("n_marks"),
        count("\\p{Lu}").alias("n_capitals"), count("!").alias("n_exclaims"), count(".?!…。").alias("n_ends"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.expr(f"""CASE WHEN size(words) > {WINDOW}
            THEN transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW})))
            ELSE CAST(array() AS array<bigint>) END AS windows"""),
    )
    # Most texts repeat nothing; only for the others windows are sorted to find the equal ones.
    rows = rows.withColumn("sorted", F.expr("""CASE WHEN size(array_distinct(windows)) < size(windows)
        THEN sort_array(transform(windows, (h, i) -> struct(h, i)))
        ELSE CAST(array() AS array<struct<h: bigint, i: int>>) END""")).drop("windows")
    rows = rows.withColumn("again", F.expr("""sort_array(transform(filter(sorted, (e, k) ->
        (k > 0 AND get(sorted, k - 1).h = e.h) OR (k < size(sorted) - 1 AND get(sorted, k + 1).h = e.h)), e -> e.i))""")).drop("sorted")
    rows = rows.withColumn("n_repeat_words", F.expr(f"""CASE WHEN size(again) = 0 THEN 0L ELSE {WINDOW}L + aggregate(
        zip_with(slice(again, 2, size(again)), slice(again, 1, size(again) - 1), (b, a) -> CAST(least(b - a, {WINDOW}) AS bigint)), 0L, (x, y) -> x + y) END"""))
    return rows.drop("again").withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


def votes(rules=RULES):
    return F.expr("array(%s)" % ", ".join(
        f"CASE WHEN {bad} THEN {BAD} WHEN {good} THEN {GOOD} ELSE {ABSTAIN} END" for good, bad in rules.values()
    ))


def _posterior(vote: str, p: str) -> str:
    """Probability of good given the votes: the prior odds times each vote's odds. A vote never counts against what it says."""
    raised = lambda over, under: f"ln(least({MOST_ODDS}D, greatest(1D, get({p}.{over}, j) / get({p}.{under}, j))))"
    odds = f"""aggregate(sequence(0, size({vote}) - 1), ln({p}.good / (1 - {p}.good)), (x, j) -> x + CASE get({vote}, j)
        WHEN {GOOD} THEN {raised('good_if_good', 'good_if_bad')} WHEN {BAD} THEN -{raised('bad_if_bad', 'bad_if_good')} ELSE 0D END)"""
    return f"(1 / (1 + exp(-({odds}))))"


def estimated(patterns: DataFrame, rules=RULES) -> DataFrame:
    """One row `p`: the share of good documents, and how often each rule votes good and bad on good and on bad ones.

    `patterns` has `votes, n`, a row for each combination that occurs: at most 3 to the number of rules.
    """
    weigh = f"transform(all, e -> struct(e.votes AS votes, e.n * {_posterior('e.votes', 'p')} AS of_good, e.n * (1 - {_posterior('e.votes', 'p')}) AS of_bad))"
    total = lambda what: f"aggregate(w, 0D, (x, e) -> x + e.{what})"
    share = f"({IMAGINED}D * {PRIOR}D + {total('of_good')}) / ({IMAGINED}D + {total('of_good')} + {total('of_bad')})"
    rate = lambda vote, what, start: f"""transform(sequence(0, {len(rules) - 1}), j -> ({IMAGINED}D * {start}D
        + aggregate(w, 0D, (x, e) -> x + CASE WHEN get(e.votes, j) = {vote} THEN e.{what} ELSE 0D END)) / ({IMAGINED}D + {total(what)}))"""
    fields = [("good_if_good", GOOD, "of_good", RIGHT), ("good_if_bad", GOOD, "of_bad", WRONG), ("bad_if_bad", BAD, "of_bad", RIGHT), ("bad_if_good", BAD, "of_good", WRONG)]
    step = "element_at(transform(array(%s), w -> struct(least(0.99D, greatest(0.01D, %s)) AS good, %s)), 1)" % (
        weigh, share, ", ".join(f"{rate(vote, what, start)} AS {name}" for name, vote, what, start in fields)
    )
    flat = lambda x: f"transform(array_repeat(0, {len(rules)}), x -> CAST({x} AS double))"
    start = "struct(%sD AS good, %s)" % (PRIOR, ", ".join(f"{flat(x)} AS {name}" for name, _, _, x in fields))
    table = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("all"))
    return table.select(F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (p, i) -> {step})").alias("p"))


def judge(docs: DataFrame, *, text="text", key="doc_id", rules=RULES, keep_from=KEEP_FROM) -> DataFrame:
    """One row per row of `docs`: `key`, the measures, `base_failed, kept, votes, posterior`.

    A row that fails the base check isn't kept; otherwise its posterior decides. Null and empty texts
    have no words and fail. Repeated rows count as often as they occur. An empty table gives no rows;
    other columns are not read. Windows of words are compared by a 64-bit hash.
    """
    seen = materialize(measured(docs, text=text, key=key).withColumn("votes", votes(rules)), "quality-measured")
    p = estimated(seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), rules).scalar()
    found = seen.withColumn("p", p).withColumn("posterior", F.round(F.expr(_posterior("votes", "p")), 6)).drop("p")
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from)).withColumnRenamed("key", key)

"""Every operator as a named query over the driver tables: name -> (spark, sf folder) -> DataFrame."""

from pyspark.sql import DataFrame, Window as W, functions as F

from pricelens import config, schemas
from pricelens.functions import cleaning, hooks, markup, prompts, scoring
from pricelens.functions.pytext import list_literal
from pricelens.operators import curate, deals as deal_ops, enrich, evaluate, inverted, models, retrieve
from pricelens.operators.order import shuffle_order
from pricelens.plans import views
from pricelens.plans.views import part_of, table
from pricelens.session import materialize, scratch_path
from pricelens.sources import feeds, files, memory as memory_io, models as model_io, polls, products, tables
from pricelens.sources.vectors import VectorStore
from pricelens.streaming import deals as polling

QUERIES = {}


def query(fn):
    """Register a query under its function name; a trailing underscore only avoids a name clash."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def r6(column, name=None):
    return F.round(column, 6).alias(name or column)


def chat_columns(messages, **roles):
    """Message contents as plain columns."""
    return [F.get(messages, i)["content"].alias(name) for name, i in roles.items()]


# ---------------------------------------------------------------- sources and sinks


def _raw_files(spark, sf):
    path = scratch_path(spark, "raw")
    products.write_raw(views.raw_items(spark, sf), path)
    return path


ITEM_COLUMNS = ["title", "category", "price", "full"]


@query
def read_products(spark, sf):
    return products.read_products(spark, _raw_files(spark, sf)).select(*ITEM_COLUMNS, r6("weight"))


@query
def load_categories(spark, sf):
    chosen = [c for c in config.CATEGORIES if c not in config.CATEGORY_FACTORS]
    return products.load_categories(spark, _raw_files(spark, sf), chosen).select(*ITEM_COLUMNS, r6("weight"))


@query
def category_cache(spark, sf):
    path, cache = _raw_files(spark, sf), scratch_path(spark, "cache")
    products.category_cache(spark, path, cache, config.CATEGORIES[:3])
    rows = products.category_cache(spark, path, cache, force=("Automotive",))
    return rows.select(*ITEM_COLUMNS, r6("weight"))


@query
def save_splits(spark, sf):
    path = scratch_path(spark, "prompts")
    files.save_splits(enrich.prompt_pairs(views.splits(spark, sf)), path, "items_prompts")
    return files.load_splits(spark, path, "items_prompts").select("split", "ord", "prompt", "completion")


@query
def load_splits(spark, sf):
    path = scratch_path(spark, "splits")
    files.save_splits(views.splits(spark, sf), path)
    return files.load_splits(spark, path).select(
        "split", "ord", "id", "title", "category", "price", "full", r6("weight"), "summary"
    )


@query
def chat_jsonl(spark, sf):
    path = scratch_path(spark, "chat")
    files.write_chat(views.splits(spark, sf), path)
    rows = files.read_chat(spark, path)
    return rows.select("split", *chat_columns(F.col("messages"), user=0, assistant=1))


@query
def batch_requests(spark, sf):
    path = scratch_path(spark, "requests")
    files.write_batch_requests(files.batch_requests(views.positioned(spark, sf), views.BATCH_ROWS), path)
    rows = spark.read.schema("value string, file string").text(path)
    field = lambda p, name: F.get_json_object("value", p).alias(name)
    return rows.select(
        "file", field("$.custom_id", "custom_id"), field("$.method", "method"), field("$.url", "url"),
        field("$.body.model", "model"), field("$.body.messages[1].content", "content"),
        field("$.body.reasoning_effort", "reasoning_effort"),
    )


@query
def batch_results(spark, sf):
    return files.parse_batch_results(views.batch_responses(spark, sf))


@query
def checkpoint_read(spark, sf):
    return files.parse_checkpoint(views.checkpoint_lines(spark, sf))


@query
def guesses_csv(spark, sf):
    path = scratch_path(spark, "guesses")
    files.write_guess_sheet(part_of(views.splits(spark, sf), "test"), path)
    return files.read_guesses(spark, path)


def flat_memory(rows):
    return rows.select("deal.product_description", "deal.price", "deal.url", r6("estimate"), r6("discount"))


@query
def memory_table(spark, sf):
    """Two polls are remembered, the first one twice: a replay replaces it."""
    path, found = scratch_path(spark, "memory"), materialize(views.memory(spark, sf), "found")
    cheap = F.col("deal")["price"] < 20
    for batch_id, rows in ((0, found.where(cheap)), (1, found.where(~cheap)), (0, found.where(cheap))):
        memory_io.remember(rows, path, batch_id)
    return flat_memory(memory_io.read_memory(spark, path))


@query
def deal_source(spark, sf):
    return views.scraped(spark, sf)


@query
def index_store(spark, sf):
    """Appending the same rows again changes nothing."""
    path, rows = scratch_path(spark, "index"), tables.index_rows(views.index_items(spark, sf))
    tables.append_new(rows, path, "doc")
    stored = tables.append_new(rows, path, "doc")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return stored.select("doc", "document", "category", "price", F.round(total, 4).alias("total"))


@query
def index_resume(spark, sf):
    """The cheap half first, then everything: only the rest is added."""
    path, rows = scratch_path(spark, "index"), tables.index_rows(views.index_items(spark, sf))
    tables.append_new(rows.where("price < 100"), path, "doc")
    return tables.append_new(rows, path, "doc").select("doc", "document", "category", "price")


class _Letters:
    """A small encoder: how often each small letter stands in a text."""

    def encode(self, texts):
        return [[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


@query
def index_search(spark, sf):
    """Texts to index to neighbours: stored in two goes with other numbers and other metadata, repeated, then searched by first lines."""
    store = VectorStore(spark, scratch_path(spark, "store"), hooks.encode_hook(_Letters), ("lang", "source"))
    docs = table(spark, sf, "documents")
    store.upsert(docs.where("lang = 'en'"), "text", "doc_id")
    backwards = docs.select("text", "lang", F.upper("source").alias("source"), (-F.col("doc_id")).alias("number"))
    store.upsert(backwards, "text", "number")
    store.upsert(backwards, "text", "number")
    asked = docs.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("document"))
    return store.search(asked).select("query_id", "rank", "doc", "lang", "source", r6("distance"))


@query
def model_store(spark, sf):
    frame = views.splits(spark, sf)
    priced, mean, std = models.log_target_price(part_of(frame, "train"))
    path = scratch_path(spark, "model")
    model_io.save_model(priced.model, path, mean, std)
    again = models.from_log_target(*model_io.load_model(path))
    both = again.price(priced.price(part_of(frame, "test"), "guess"), "reloaded")
    return both.select("ord", (F.col("guess") == F.col("reloaded")).alias("same"))


# ---------------------------------------------------------------- scalars


@query
def price_filter(spark, sf):
    price = cleaning.number(F.col("price"))
    return views.raw_items(spark, sf).where(cleaning.in_price_range(price)).select("id", price.alias("price"))


@query
def simplify_text(spark, sf):
    return views.raw_items(spark, sf).select("id", cleaning.simplify(F.col("description")).alias("text"))


@query
def list_literal_(spark, sf):
    both = F.concat("features", "description")
    return views.raw_items(spark, sf).select("id", list_literal(both).alias("text"))


def _detail_pairs(details):
    pairs = F.transform(F.map_entries(details), lambda e: F.concat_ws("=", e["key"], e["value"]["text"]))
    return F.array_join(F.array_sort(pairs), ";")


@query
def details_map(spark, sf):
    m = cleaning.details_map(F.col("details"))
    return views.raw_items(spark, sf).select("id", _detail_pairs(m).alias("entries"))


@query
def drop_noise_keys(spark, sf):
    m = cleaning.drop_noise_keys(cleaning.details_map(F.col("details")))
    return views.raw_items(spark, sf).select("id", _detail_pairs(m).alias("entries"))


@query
def details_json(spark, sf):
    m = cleaning.drop_noise_keys(cleaning.details_map(F.col("details")))
    return views.raw_items(spark, sf).select("id", cleaning.details_json(m).alias("json"))


@query
def strip_codes(spark, sf):
    text = cleaning.strip_codes(F.col("text"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), text.alias("text"))


@query
def scrub_text(spark, sf):
    m = cleaning.drop_noise_keys(cleaning.details_map(F.col("details")))
    full = cleaning.scrub(F.col("title"), F.col("description"), F.col("features"), m)
    return views.raw_items(spark, sf).select("id", full.alias("full"))


@query
def weight_pounds(spark, sf):
    m = cleaning.details_map(F.col("details"))
    weight = cleaning.weight_pounds(cleaning.detail_text(m, "Item Weight"))
    return views.raw_items(spark, sf).select("id", r6(weight, "weight"))


@query
def min_text_filter(spark, sf):
    return scrub_text(spark, sf).select("id", F.length("full").alias("n_chars")).where(F.col("n_chars") >= config.MIN_CHARS)


@query
def parse_items(spark, sf):
    return views.items(spark, sf).select("id", *ITEM_COLUMNS, r6("weight"))


@query
def inference_prompt(spark, sf):
    return views.items_summary(spark, sf).select("id", prompts.inference_prompt(F.col("summary")).alias("prompt"))


@query
def extract_price(spark, sf):
    """From whole document texts and from formatted answers."""
    raw = views.raw_items(spark, sf)
    answer = F.concat(F.lit("It costs $"), F.format_number(cleaning.number(F.col("price")) * 10, 2))
    return raw.select(
        "id", scoring.extract_price(F.get("description", 0)).alias("from_text"),
        scoring.extract_price(F.coalesce(answer, F.lit("no idea"))).alias("from_answer"),
    )


@query
def make_prompt(spark, sf):
    text = prompts.training_prompt(F.col("summary"), F.col("price"))
    return views.items_summary(spark, sf).select("id", text.alias("prompt"))


@query
def test_prompt(spark, sf):
    text = prompts.training_prompt(F.col("summary"), F.col("price"))
    return views.items_summary(spark, sf).select("id", prompts.open_prompt(text).alias("prompt"))


@query
def token_count(spark, sf):
    pairs = enrich.prompt_pairs(views.splits(spark, sf))
    return pairs.select(
        "id", prompts.token_count(F.col("summary")).alias("summary_tokens"),
        prompts.token_count(F.concat("prompt", "completion")).alias("pair_tokens"),
    )


@query
def subword_prompts(spark, sf):
    """Token counts and texts cut to the limit by a public subword vocabulary."""
    import public_tokenizers

    count, cut = hooks.piece_hooks(str(public_tokenizers.path("piece_bpe_32k.model")), config.TOKEN_CUTOFF)
    rows = views.items_summary(spark, sf)
    return rows.select("id", count("summary").alias("tokens"), cut("summary").alias("text"))


@query
def prompt_pairs(spark, sf):
    return enrich.prompt_pairs(views.splits(spark, sf), 30).select("split", "ord", "prompt", "completion")


@query
def datapoint(spark, sf):
    return enrich.prompt_pairs(views.splits(spark, sf)).select("prompt", "completion")


@query
def content_key(spark, sf):
    return views.items(spark, sf).select("id", prompts.content_key(F.col("full")).alias("key"))


@query
def summary_messages(spark, sf):
    m = prompts.card_messages(F.col("full"))
    return views.items(spark, sf).select("id", *chat_columns(m, system=0, user=1))


@query
def summary_card(spark, sf):
    return views.items_summary(spark, sf).select("id", "summary")


@query
def price_messages(spark, sf):
    m = prompts.price_messages(F.col("summary"))
    return views.items_summary(spark, sf).select("id", *chat_columns(m, user=0))


def _neighbours(spark, sf):
    index = views.index_items(spark, sf)
    found = retrieve.nearest(index, index, exclude_self=True)
    return found.join(index.select("id", "document", "category", "price"), "id"), index


@query
def rag_context(spark, sf):
    found, index = _neighbours(spark, sf)
    rows = index.select(F.col("id").alias("query_id"), "document").join(retrieve.neighbour_lists(found), "query_id")
    m = prompts.context_messages(F.col("document"), F.col("neighbours"))
    return rows.select("query_id", *chat_columns(m, content=0))


@query
def price_features(spark, sf):
    columns = scoring.price_features(F.col("weight"), F.col("summary"))
    return views.items_summary(spark, sf).select("id", *columns).withColumn("weight", F.round("weight", 6))


@query
def truth_title(spark, sf):
    rows = enrich.prompt_pairs(views.splits(spark, sf))
    return rows.select(
        "id", F.col("completion").try_cast("double").alias("truth"), scoring.clip_title(F.col("title")).alias("item_title"),
        scoring.prompt_title(F.col("prompt")).alias("prompt_title"),
    )


@query
def error_band(spark, sf):
    return views.predictions(spark, sf).select("model", "ord", r6("error"), "color")


@query
def metrics_report(spark, sf):
    metrics = evaluate.eval_metrics(views.predictions(spark, sf))
    named = metrics.withColumn("model", F.concat(F.col("model"), F.lit("__4o_gpt")))
    return evaluate.metrics_report(named)


@query
def clean_html(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id", markup.clean_html(html, markup.ARTICLE).alias("article"), markup.clean_html(html).alias("snippet")
    )


@query
def page_section(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.page_section(F.col("html")).alias("section"))


@query
def deal_fields(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", *markup.deal_fields(markup.page_title(html), markup.page_section(html)))


@query
def deal_text(spark, sf):
    fields = [F.col(c) for c in ("title", "details", "features", "url")]
    return views.scraped(spark, sf).select("feed", "rank", markup.deal_text(*fields).alias("text"))


@query
def deal_digest(spark, sf):
    return deal_ops.deal_digest(views.scraped(spark, sf))


@query
def discount(spark, sf):
    return views.priced_deals(spark, sf).select("url", "price", r6("estimate"), r6("discount"))


@query
def positive_price(spark, sf):
    return deal_ops.positive_price(views.deals(spark, sf)).select("url", "price", "product_description")


def _texts(spark, sf):
    return views.priced_deals(spark, sf), [F.col(c) for c in ("product_description", "price", "estimate", "discount", "url")]


@query
def alert_text(spark, sf):
    rows, fields = _texts(spark, sf)
    return rows.select(
        "pos", scoring.alert_text(*fields).alias("alert"), scoring.notice_text(fields[0], fields[-1]).alias("notice")
    )


@query
def deal_report(spark, sf):
    rows, fields = _texts(spark, sf)
    money = [scoring.money(F.col(c)).alias(c) for c in ("price", "estimate", "discount")]
    return rows.select("product_description", *money, "url")


@query
def clear_columns(spark, sf):
    rows = curate.clear_columns(views.splits(spark, sf))
    return rows.select("split", "ord", "title", "price", "summary", "full", "id")


@query
def clamp_price(spark, sf):
    price = scoring.clamp_price(F.coalesce(cleaning.number(F.col("price")) * 3 - 20, F.lit(0.0)))
    return views.raw_items(spark, sf).select("id", r6(price, "price"))


@query
def nonneg(spark, sf):
    rows = views.predictions(spark, sf)
    return rows.select("model", "ord", r6(scoring.nonneg(F.col("guess") - 100), "guess"))


# ---------------------------------------------------------------- joins


@query
def checkpoint_join(spark, sf):
    done = files.parse_checkpoint(views.checkpoint_lines(spark, sf))
    return enrich.apply_checkpoint(views.open_summaries(spark, sf), done).select("id", "summary")


@query
def pending_anti(spark, sf):
    done = files.parse_checkpoint(views.checkpoint_lines(spark, sf))
    return enrich.pending(views.open_summaries(spark, sf), done).select("id", "title")


@query
def batch_join(spark, sf):
    return views.batch_state(spark, sf)[0].select("id", "ord", "summary")


@query
def seen_anti(spark, sf):
    return deal_ops.unseen(views.deals(spark, sf), views.memory(spark, sf)).select("url", "price")


@query
def guess_lookup(spark, sf):
    """Guesses by summary; every summary is guessed by its length, Electronics twice."""
    frame = views.splits(spark, sf)
    test = part_of(frame, "test")
    sheet = test.where("category <> 'Appliances'").select(
        "summary", F.explode(F.when(F.col("category") == "Electronics", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("ord")
    ).withColumn("guess", (F.length("summary") + 1000 * F.col("ord")).cast("double"))
    known = enrich.last_per_key(sheet, "summary", "guess")
    return evaluate.guess_by_hand(test, known).select("id", "summary", "guess")


@query
def knn_join(spark, sf):
    found, _ = _neighbours(spark, sf)
    return found.select("query_id", "rank", "id", r6("distance"), "price")


@query
def knn_lsh(spark, sf):
    index = views.index_items(spark, sf)
    found = inverted.nearest_listed(index, index, exclude_self=True)
    return found.select("query_id", "rank", "id", r6("distance"))


@query
def knn_recall(spark, sf):
    """Of the exact neighbours, the share that the approximate search finds; and of all pairs, the shares whose codes it scans and whose vectors it compares."""
    index = materialize(views.index_items(spark, sf), "index")
    exact = retrieve.nearest(index, index, exclude_self=True).select("query_id", "id")
    found = inverted.nearest_listed(index, index, exclude_self=True).select("query_id", "id", F.lit(1).alias("found"))
    lists = inverted.learn(index)
    scanned = inverted.share_scanned(index, inverted.encode(index, lists), lists)
    n = index.count()
    recall = exact.join(found, ["query_id", "id"], "left").agg(F.round(F.count("found") / F.count(F.lit(1)), 4).alias("recall"))
    shares = [F.lit(round(x, 4)).alias(name) for x, name in ((scanned, "scanned"), (min(inverted.CANDIDATES, n) / n, "reranked"))]
    return recall.select(F.lit(n).cast("bigint").alias("queries"), "recall", *shares)


def _estimates(spark, sf):
    names = {"text": "frontier", "constant": "specialist", "random": "neural_network"}
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return views.predictions(spark, sf).withColumn("model", F.try_element_at(mapping, F.col("model")))


@query
def weights_join(spark, sf):
    rows = evaluate.weighted_estimate(_estimates(spark, sf), config.ENSEMBLE_WEIGHTS, "ord")
    return rows.select("ord", r6("guess"))


@query
def ensemble_price(spark, sf):
    rows = evaluate.weighted_estimate(_estimates(spark, sf), config.ENSEMBLE_WEIGHTS, "ord", active=config.ACTIVE_MODELS)
    return rows.select("ord", r6("guess"))


@query
def split_leakage(spark, sf):
    frame = views.splits(spark, sf)
    by_text = curate.split_leakage(frame, prompts.content_key(F.col("full")))
    by_title = curate.split_leakage(frame, F.col("title"))
    return by_text.unionByName(by_title).agg(F.count(F.lit(1)).alias("leaks"))


# ---------------------------------------------------------------- aggregates


@query
def mean_price(spark, sf):
    return part_of(views.splits(spark, sf), "train").agg(r6(F.avg("price"), "mean_price"))


@query
def price_range(spark, sf):
    return curate.price_range(views.items(spark, sf))


@query
def log_target_stats(spark, sf):
    return models.log_target_stats(part_of(views.splits(spark, sf), "train")).select(r6("y_mean"), r6("y_std"))


def _metric_columns(*keys):
    return [*keys, "n", *[F.round(c, 4).alias(c) for c in ("error", "ci", "mse", "r2")]]


@query
def eval_metrics(spark, sf):
    return evaluate.eval_metrics(views.predictions(spark, sf)).select(*_metric_columns("model"))


@query
def truncation_rate(spark, sf):
    return enrich.truncation_rate(views.splits(spark, sf), 40).select(r6("rate"), "n")


@query
def category_counts(spark, sf):
    kept = materialize(views.items(spark, sf).select("id", "title", "category", F.sha2("full", 256).alias("full")), "kept")
    per = kept.groupBy("category").agg(F.count(F.lit(1)).alias("kept"))
    unique = curate.deduplicate(kept).groupBy("category").agg(F.count(F.lit(1)).alias("unique_items"))
    return per.join(unique, "category", "left")


@query
def summary_progress(spark, sf):
    answered, batches = views.batch_state(spark, sf)
    return enrich.batch_progress(answered, batches, views.BATCH_ROWS)


def _card(text):
    return "Card: " + text.split("\n")[0]


@query
def usage_totals(spark, sf):
    path, rows = scratch_path(spark, "store"), materialize(views.open_summaries(spark, sf), "open")
    enrich.map_with_checkpoint(rows, _card, path, waves=2)
    return enrich.usage_totals(spark.read.parquet(path)).withColumn("cost", F.round("cost", 6))


@query
def usage_progress(spark, sf):
    """The totals that the job itself observed, behind each of its waves."""
    path, rows, told = scratch_path(spark, "store"), materialize(views.open_summaries(spark, sf), "open"), []
    enrich.map_with_checkpoint(rows, _card, path, waves=2, progress=told.append)
    told = [(i, *[t[c] for c in enrich.USAGE]) for i, t in enumerate(told)]
    return spark.createDataFrame(told, "wave int, calls bigint, input_tokens bigint, output_tokens bigint, cost double").where("wave = 1").drop("wave")


@query
def best_deal(spark, sf):
    best = deal_ops.best_deal(views.priced_deals(spark, sf), "feed")
    return best.select("feed", "url", "price", r6("estimate"), r6("discount"))


@query
def leaderboard(spark, sf):
    metrics = evaluate.eval_metrics(evaluate.test_sets(views.predictions(spark, sf), 50), "test_set", "model")
    return evaluate.leaderboard(metrics).withColumn("error", F.round("error", 4))


@query
def band_counts(spark, sf):
    return evaluate.band_counts(views.predictions(spark, sf))


# ---------------------------------------------------------------- order, sampling, splitting


@query
def ordinal(spark, sf):
    return views.positioned(spark, sf).select("id", "ord")


@query
def running_error(spark, sf):
    return evaluate.running_error(views.predictions(spark, sf)).select("model", "ord", F.round("mean_error", 4).alias("mean_error"), F.round("ci", 4).alias("ci"))


@query
def first_per_key(spark, sf):
    keyed = views.items(spark, sf).withColumn("_key", curate.hash_key(F.col("id"), config.SEED))
    return curate.first_per_key(keyed, "title", ["_key", "id"]).select("id", "title")


@query
def top_n_per_feed(spark, sf):
    return feeds.first_entries(views.feed_entries(spark, sf)).select("feed", "rank", "title", "url")


@query
def sample_per_category(spark, sf):
    narrow = materialize(views.items(spark, sf).select("id", "category", "price"), "narrow")
    return curate.sample_per_category(narrow, 50).select("id", "category", "price")


@query
def shuffle(spark, sf):
    return shuffle_order(materialize(views.items(spark, sf), "items")).select("id", "ord")


@query
def dedupe(spark, sf):
    return curate.deduplicate(views.items(spark, sf)).select("id", "title", "full")


@query
def sample_weights(spark, sf):
    rows = curate.sample_weights(views.deduplicated(spark, sf))
    return rows.select("id", F.round("w", 9).alias("w"))


@query
def weighted_sample(spark, sf):
    return curate.weighted_sample(views.deduplicated(spark, sf), 400).select("id", "category", "price")


@query
def split(spark, sf):
    return views.splits(spark, sf).select("id", "split", "ord")


@query
def lite_subset(spark, sf):
    return curate.lite_subset(views.splits(spark, sf), (400, 30, 30)).select("id", "split", "ord")


@query
def head_clip(spark, sf):
    return curate.head_clip(part_of(views.splits(spark, sf), "train"), config.EVAL_SIZE).select("id", "ord", "price")


@query
def holdout_1pct(spark, sf):
    train = part_of(views.splits(spark, sf), "train")
    return curate.holdout(train).select("id", "holdout")


@query
def top_deals(spark, sf):
    return deal_ops.top_deals(views.deals(spark, sf)).select("url", "price", "product_description")


@query
def trim_memory(spark, sf):
    rows = views.memory(spark, sf).withColumn("batch_id", F.lit(0))
    return flat_memory(memory_io.trim_memory(rows))


@query
def flatten_resplit(spark, sf):
    frame = views.splits(spark, sf)
    parts = [part_of(frame, name).drop("split") for name in config.SPLITS]
    rows = curate.resplit(*parts)
    return rows.select("split", "ord", "id", F.length(prompts.truncate(F.col("summary"), 20)).alias("n_chars"))


@query
def union_categories(spark, sf):
    path = _raw_files(spark, sf)
    one = [products.load_categories(spark, path, [c]) for c in config.CATEGORIES]
    return evaluate.union_tables(*one).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total")
    )


@query
def index_sample(spark, sf):
    rows = views.index_items(spark, sf).orderBy("id").limit(2000)
    return rows.select("id", "document", "category", retrieve.category_color(F.col("category")).alias("color"))


# ---------------------------------------------------------------- models and evaluation


@query
def random_price(spark, sf):
    return views.items(spark, sf).select("id", models.random_price(F.col("id")).alias("guess"))


@query
def constant_price(spark, sf):
    frame = views.splits(spark, sf)
    return part_of(frame, "test").select("id", "price", r6(models.mean_price(part_of(frame, "train")), "guess"))


def _fitted(name, **parameters):
    def run(spark, sf):
        frame = views.splits(spark, sf)
        rows = models.MODELS[name](part_of(frame, "train"), **parameters).price(part_of(frame, "test"))
        return rows.select("id", "ord", "price", "guess")

    return run


@query
def linear_price(spark, sf):
    return _fitted("linear")(spark, sf).withColumn("guess", F.round("guess", 4))


# The query names smaller trees than the model's own default, to end in seconds.
for key, model, parameters in (
    ("nlp_linear_price", "nlp_linear", {}), ("forest_price", "random_forest", {"depth": 5}),
    ("log_target_price", "log_target", {}), ("hashed_price", "hashed", {}),
):
    QUERIES[key] = _fitted(model, **parameters)


@query
def boosted_price(spark, sf):
    """Boosting that ends where the held-out rows gain no more, with the rounds that it took."""
    frame = views.splits(spark, sf)
    train = materialize(curate.holdout(part_of(frame, "train")), "train")
    fitted = models.boosted_price(train, holdout="holdout")
    rows = fitted.price(part_of(frame, "test"))
    return rows.select("id", "ord", "price", "guess", F.lit(models.rounds_used(fitted)).alias("rounds"))


@query
def validation_curve(spark, sf):
    """Error in dollars on the held-out rows after more and more passes, for both hashed models."""
    train = materialize(curate.holdout(part_of(views.splits(spark, sf), "train")), "train")
    curves = [(name, n, error) for name in ("log_target", "hashed") for n, error in models.validation_curve(train, models.MODELS[name])[1]]
    return spark.createDataFrame(curves, "model string, passes int, error double")


@query
def bag_of_words(spark, sf):
    return models.term_totals(part_of(views.splits(spark, sf), "train"))


@query
def log_target(spark, sf):
    """The target transform and its inverse."""
    train = part_of(views.splits(spark, sf), "train")
    stats = models.log_target_stats(train)
    mean, std = stats.select("y_mean").scalar(), stats.select("y_std").scalar()
    z = (F.log1p("price") - mean) / std
    return train.select("id", r6(z, "z"), r6(scoring.nonneg(F.exp(z * std + mean) - 1), "price_again"))


@query
def embed_text(spark, sf):
    rows = materialize(views.items_summary(spark, sf), "items")
    return models.embed_text(rows, models.text_encoder(rows)).select("id", "embedding")


def _knn_guesses(spark, sf):
    found, index = _neighbours(spark, sf)
    return retrieve.neighbour_price(found).join(index.select(F.col("id").alias("query_id"), "price"), "query_id")


@query
def knn_price(spark, sf):
    return _knn_guesses(spark, sf).select("query_id", "price", F.round("guess", 4).alias("guess"))


def _by_letters(rows):
    return rows.withColumn("embedding", hooks.encode_hook(_Letters)(F.col("summary")))


def _blended(train):
    """Fitted models by name: linear, retrieval by letters, the log price on features, and a blend of these two."""
    fitted = {"linear": models.MODELS["linear"](train), "retrieval": models.MODELS["retrieval"](train, _by_letters), "log_features": models.MODELS["log_features"](train)}
    return fitted | {"ensemble": models.Blended({"frontier": fitted["retrieval"], "neural_network": fitted["log_features"]})}


@query
def ensemble_predict(spark, sf):
    """Prices of similar texts and of a fitted model, blended per item."""
    frame = views.splits(spark, sf)
    fitted = _blended(part_of(frame, "train"))
    rows = part_of(frame, "test").select("id", "price", "summary", "weight")
    for model, name in (("retrieval", "retrieval"), ("log_features", "log_features"), ("ensemble", "guess")):
        rows = materialize(fitted[model].price(rows, name), model)
    return rows.select("id", *[F.round(c, 4).alias(c) for c in ("retrieval", "log_features", "guess")])


@query
def predict_table(spark, sf):
    return views.predictions(spark, sf).select("model", "ord", "title", "truth", r6("guess"), r6("error"), "color")


@query
def evaluate_(spark, sf):
    """Baselines, guesses by hand and models fitted by name: metrics, missing guesses and band counts, a row per model."""
    frame = views.splits(spark, sf)
    train, test = part_of(frame, "train"), part_of(frame, "test")
    sheet = test.where("category <> 'Appliances'").select("summary", F.length("summary").cast("double").alias("guess")).distinct()
    by_hand = evaluate.guess_by_hand(test, sheet)
    human = evaluate.predict_table(by_hand, human=F.col("guess"))
    rows = evaluate.union_tables(views.predictions(spark, sf, frame), evaluate.predict_fitted(test, _blended(train)), human)
    report = evaluate.evaluate(materialize(rows, "predictions"))
    return report.select(*_metric_columns("model"), "missing", "green", "orange", "red")


@query
def evaluate_prompts(spark, sf):
    """Prompt rows as evaluation data: truth and title come out of the texts."""
    frame = views.splits(spark, sf)
    asked = enrich.prompt_pairs(part_of(frame, "test"))
    mean = models.mean_price(part_of(frame, "train"))
    length = F.length(prompts.truncate(F.col("summary"), config.TOKEN_CUTOFF)) / 10
    rows = evaluate.predict_prompts(asked, constant=mean, prompt_length=length)
    return rows.select("model", "ord", "title", "truth", r6("guess"), r6("error"), "color")


@query
def embedding_projection(spark, sf):
    rows, _ = models.project(views.index_items(spark, sf))
    color = retrieve.category_color(F.col("category")).alias("color")
    return rows.select("id", "category", color, "x1", "x2", "x3")


# ---------------------------------------------------------------- streaming


POLLS = 3


def _feed_pages(spark, sf, backwards=False):
    """Pages as entries of their feeds, with what each offers."""
    rows = views.feed_entries(spark, sf).join(table(spark, sf, "pages").select(F.col("page_id").alias("pos"), "html"), "pos")
    order = W.partitionBy("feed").orderBy(F.desc("pos") if backwards else "pos")
    listed = rows.withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))
    listed = listed.join(views.page_offers(spark, sf), "pos")
    return listed.select("feed", F.col("place").alias("pos"), "title", "url", "html", "offer", "category")


def _streamed(spark, sf):
    """Every poll offers all deals again: the memory, and the checkpoint."""
    item_rows = materialize(views.items(spark, sf).select("category", "price"), "prices")
    path, memory_path, checkpoint = (scratch_path(spark, name) for name in ("polls", "memory", "stream"))
    pages = views.deal_pages(spark, sf)
    for n in range(POLLS):
        polls.write_poll(pages, path, n)
    polling.stream_deals(
        polls.offers(polls.read_feeds(spark, path, entries=1 << 40)), memory_path, checkpoint, lambda rows: views.estimated(rows, item_rows),
    ).awaitTermination()
    return memory_io.read_memory(spark, memory_path), checkpoint


@query
def stream_deals(spark, sf):
    rows, _ = _streamed(spark, sf)
    return rows.select("batch_id", "deal.url", "deal.price", r6("estimate"), r6("discount"))


@query
def stream_seen_state(spark, sf):
    """Deals that can still be alerted after the stream: everything except the urls in its state."""
    _, checkpoint = _streamed(spark, sf)
    return views.deals(spark, sf).join(polling.alerted_urls(spark, checkpoint), "url", "left_anti").select("url", "price")


@query
def stream_best_per_poll(spark, sf):
    rows, _ = _streamed(spark, sf)
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("alerts"), r6(F.max("discount"), "discount"))


@query
def stream_scrape(spark, sf):
    """Two polls of all feeds, listed from either end: the first entries of each, scraped inside the stream."""
    path, out = scratch_path(spark, "polls"), scratch_path(spark, "scraped")
    for n in range(2):
        polls.write_poll(_feed_pages(spark, sf, backwards=n == 1), path, n)
    rows = polls.scraped(polls.read_feeds(spark, path))
    running = rows.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start(out)
    running.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


# ---------------------------------------------------------------- user functions


@query
def map_with_checkpoint(spark, sf):
    """Run twice on one store: the second run has nothing left to rewrite."""
    path, rows = scratch_path(spark, "store"), materialize(views.open_summaries(spark, sf), "open")
    enrich.map_with_checkpoint(rows, _card, path, waves=2)
    return enrich.map_with_checkpoint(rows, _card, path, run=1).select("id", "summary")


class _Lengths:
    """A stand-in encoder: text length, word count and line count."""

    def encode(self, texts):
        return [[len(t), len(t.split()), t.count("\n") + 1] for t in texts]


@query
def encode_hook(spark, sf):
    vector = hooks.encode_hook(_Lengths)("summary")
    rows = views.items_summary(spark, sf).select("id", vector.alias("v"))
    return rows.select("id", *[F.get("v", i).alias(n) for i, n in enumerate(("chars", "words", "lines"))])


@query
def predictor_hook(spark, sf):
    guess = hooks.predictor_hook(lambda s, w: f"between ${len(s)} and ${len(s) + 10}" if w else "no idea", numeric=False)
    rows = part_of(views.splits(spark, sf), "test")
    scored = evaluate.predict_table(rows, custom=guess(F.col("summary"), F.col("weight")))
    return scored.select("model", "ord", "title", "truth", "guess", r6("error"), "color")


@query
def curate_evaluate(spark, sf):
    """The whole batch path: parse, deduplicate, sample, split, predict, evaluate."""
    return evaluate.eval_metrics(views.predictions(spark, sf)).select(*_metric_columns("model"))

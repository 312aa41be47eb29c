import json

import pytest
from pyspark.sql import functions as F

from pricelens import config
from pricelens.functions import hooks, prompts
from pricelens.operators import enrich, order
from pricelens.session import scratch_path
from pricelens.sources import files, memory, products, tables

LONG = ["A sturdy kitchen appliance. " * 40]


def line(title, price, details='{"Item Weight": "2 pounds"}'):
    return json.dumps({"title": title, "price": price, "description": LONG, "features": [], "details": details})


def test_read_products_plain_and_gzip(spark, tmp_path):
    import gzip

    (tmp_path / "meta_Appliances.jsonl").write_text("\n".join([line("a", 5), "", line("b", "None"), line("c", "7.5")]) + "\n")
    with gzip.open(tmp_path / "meta_Automotive.jsonl.gz", "wt") as f:
        f.write("\n".join(line(f"t{i}", i + 1, {"Item Weight": "16 ounces"}) for i in range(50)) + "\n" + line("n", None) + "\n")
    rows = products.read_products(spark, str(tmp_path), partitions=4)
    counts = {r["category"]: r["count"] for r in rows.groupBy("category").count().collect()}
    assert counts == {"Appliances": 2, "Automotive": 50}
    assert rows.where("category = 'Automotive'").agg(F.max("weight")).first()[0] == 1.0


def test_category_cache(spark, tmp_path):
    path, cache = str(tmp_path / "raw"), str(tmp_path / "cache")
    (tmp_path / "raw" / "meta=Appliances").mkdir(parents=True)
    source = tmp_path / "raw" / "meta=Appliances" / "x.txt"
    source.write_text(line("a", 5) + "\n")
    assert products.category_cache(spark, path, cache, ["Appliances"]).count() == 1
    source.write_text(line("a", 5) + "\n" + line("b", 6) + "\n")
    assert products.category_cache(spark, path, cache, ["Appliances"]).count() == 1
    assert products.category_cache(spark, path, cache, ["Appliances"], force=["Appliances"]).count() == 2


def test_split_round_trip(spark, items, tmp_path):
    rows = order.ordinal_by_id(items).withColumn("split", F.lit("test"))
    files.save_splits(rows, str(tmp_path / "s"))
    again = files.load_splits(spark, str(tmp_path / "s"))
    assert again.select("id", "ord", "summary", "price").exceptAll(rows.select("id", "ord", "summary", "price")).count() == 0
    files.save_splits(again, str(tmp_path / "again"))
    assert files.load_splits(spark, str(tmp_path / "again")).count() == 300


def test_checkpoint_last_line_wins(spark):
    lines = ['{"key": "a", "summary": "1"}', "{bad", '{"other": 1}', '{"key": "a", "summary": "2"}', '{"key": "b"}', ""]
    frame = spark.createDataFrame(list(zip(lines, range(len(lines)))), "value string, ord bigint")
    assert [tuple(r) for r in files.parse_checkpoint(frame).collect()] == [("a", "2")]


def test_batches(spark, items):
    many = order.ordinal_by_id(spark.range(1005).select("id", F.lit("x").alias("full")))
    requests = files.batch_requests(many)
    counts = {r["file"]: r["count"] for r in requests.groupBy("file").count().collect()}
    assert counts == {"0_1000.jsonl": 1000, "1000_1005.jsonl": 5}
    body = json.loads(requests.where("ord = 3").first()["value"])
    assert body["custom_id"] == "3" and body["body"]["messages"][0]["content"] == config.CARD_PROMPT
    answer = json.dumps({"custom_id": "3", "response": {"body": {"choices": [{"message": {"content": " s "}}]}}})
    results = files.parse_batch_results(spark.createDataFrame([(answer, 0), ("{}", 1)], "value string, line bigint"))
    assert [tuple(r) for r in results.collect()] == [(3, " s ")]
    done = enrich.apply_batch_results(many.withColumn("summary", F.lit(None).cast("string")), results)
    assert done.where("summary is not null").count() == 1


def test_guess_sheet_round_trip(spark, tmp_path):
    rows = [(0, 'a "q", x\nnew line'), (1, "plain")]
    files.write_guess_sheet(spark.createDataFrame(rows, "ord bigint, summary string"), str(tmp_path / "g"))
    assert {tuple(r) for r in files.read_guesses(spark, str(tmp_path / "g")).collect()} == {(s, 0.0) for _, s in rows}


def test_append_new_is_idempotent(spark, tmp_path):
    rows = spark.range(10).select("id", F.lit("x").alias("v"))
    path = str(tmp_path / "t")
    tables.append_new(rows.where("id < 4"), path, "id")
    assert tables.append_new(rows, path, "id").count() == 10
    assert tables.append_new(rows, path, "id").count() == 10


def test_memory_replay_and_trim(spark, tmp_path):
    path = str(tmp_path / "m")
    row = lambda u: spark.createDataFrame([(("d", 1.0, u), 100.0, 99.0)], "deal struct<product_description:string,price:double,url:string>, estimate double, discount double")
    assert memory.read_memory(spark, path).count() == 0
    for batch, url in ((0, "a"), (1, "b"), (0, "a"), (2, "c")):
        memory.remember(row(url), path, batch)
    assert memory.read_memory(spark, path).count() == 3
    assert memory.read_memory(spark, path, but=("0", 1)).count() == 2
    memory.remember(row("z"), path, 0, "another run")
    assert memory.read_memory(spark, path).count() == 4
    memory.remember(row("z"), path, 0, "another run")
    memory.compact(spark, path, path + "-compact")
    assert memory.read_memory(spark, path + "-compact").count() == 4
    memory.remember(row("y"), path + "-compact", 0, "0")
    assert memory.read_memory(spark, path + "-compact").count() == 5
    assert [r["deal"]["url"] for r in memory.trim_memory(memory.read_memory(spark, path)).collect()] == ["a", "z"]


def test_rewriting_resumes(spark, tmp_path):
    rows = [(1, "one", None), (2, "two", ""), (3, "two", None), (4, "bad", None), (5, "own", "kept")]
    frame = spark.createDataFrame(rows, "id bigint, full string, summary string")
    store = str(tmp_path / "store")

    def fn(text):
        if text == "bad":
            raise ValueError("no")
        return f" {text}! "

    out = {r["id"]: r["summary"] for r in enrich.map_with_checkpoint(frame, fn, store).collect()}
    assert out == {1: "one!", 2: "two!", 3: "two!", 4: None, 5: "kept"}
    calls = spark.read.parquet(store)
    assert calls.count() == 3 and calls.where("error is not null").first()["error"] == "ValueError: no"
    again = {r["id"]: r["summary"] for r in enrich.map_with_checkpoint(frame, lambda t: "new", store, run=1).collect()}
    assert again == {1: "one!", 2: "two!", 3: "two!", 4: "new", 5: "kept"}
    assert spark.read.parquet(store).count() == 4


def test_retries_and_fallback():
    import pandas as pd

    def flaky(text, seen={}):
        seen[text] = seen.get(text, 0) + 1
        if seen[text] < 3:
            raise hooks.Retryable("busy, try again in 1s")
        return text

    waits = []
    run = hooks.rewriter(flaky, sleep=waits.append)
    got = next(run([pd.DataFrame({"key": ["k"], "full": ["t"]})]))
    assert got["attempts"][0] == 3 and all(1.5 <= w <= 2.5 for w in waits)

    def broke(text):
        raise hooks.Retryable("insufficient_quota")

    got = next(hooks.rewriter(broke, fallback=lambda t: "fb", sleep=waits.append)([pd.DataFrame({"key": ["k"], "full": ["t"]})]))
    assert got["summary"][0] == "fb" and got["model"][0] == "fallback"
    got = next(hooks.rewriter(broke, sleep=waits.append)([pd.DataFrame({"key": ["k"], "full": ["t"]})]))
    assert got["summary"][0] is None and "quota" in got["error"][0]


def test_prompt_pairs(spark):
    rows = spark.createDataFrame([("red kettle with a lid", 47.5, "train"), ("lid", 47.5, "test")], "summary string, price double, split string")
    got = enrich.prompt_pairs(rows, 3).orderBy("price", "summary").select("prompt", "completion").collect()
    assert got[0]["completion"] == "47.5" and got[1]["completion"] == "48.00" and "\n\nred kettle with\n\n" in got[1]["prompt"]
    assert enrich.truncation_rate(rows, 3).first()["rate"] == 0.5


def test_token_hooks(spark):
    class Pairs:
        """Every two characters are a token."""

        encode = staticmethod(lambda text: [text[i : i + 2] for i in range(0, len(text), 2)])
        decode = staticmethod("".join)

    count, cut = hooks.token_hooks(Pairs, 2)
    row = spark.createDataFrame([("abc de",), ("abc",)], "t string").select(count("t").alias("n"), cut("t").alias("c")).collect()
    assert [tuple(r) for r in row] == [(3, "abc"), (2, "abc")]


def test_hot_content_key_is_split_in_the_join(spark):
    """A third of all items are copies of one text: the join splits that partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        full = F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
        rows = spark.range(0, 30_000, 1, 8).select("id", full.alias("full"), F.lit(None).cast("string").alias("summary"))
        done = rows.select(prompts.content_key(F.col("full")).alias("key"), F.col("full").alias("summary")).distinct()
        joined = enrich.apply_checkpoint(rows, done)
        assert len(joined.collect()) == 30_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_text_instead_of_a_list_stays_a_text(spark, tmp_path):
    words = "It's a plain text of some length. " * 30
    rows = [
        {"title": "a", "price": "5", "description": words, "features": ["one", "two"], "details": "{}"},
        {"title": "b", "price": "5", "description": [words], "features": "", "details": "{}"},
        {"title": "c", "price": "5", "description": ["[" + words], "features": None, "details": "{}"},
    ]
    (tmp_path / "meta_Appliances.jsonl").write_text("\n".join(map(json.dumps, rows)))
    full = {r["title"]: r["full"] for r in products.read_products(spark, str(tmp_path)).collect()}
    assert full["a"].startswith("a\n" + words.strip() + "\n['one', 'two']")
    assert full["b"].startswith("b\n[") and full["b"].count("\n") == 1
    assert full["c"].startswith("c\n[") and len(full) == 3


def test_a_batch_is_one_file_in_order(spark, tmp_path):
    many = order.ordinal_by_id(spark.range(0, 250, 1, 7).select("id", F.lit("x").alias("full"))).repartition(5)
    files.write_batch_requests(files.batch_requests(many, 100), str(tmp_path / "r"))
    for folder, low, high in (("0_100", 0, 100), ("100_200", 100, 200), ("200_250", 200, 250)):
        parts = list((tmp_path / "r" / f"file={folder}.jsonl").glob("part-*"))
        assert len(parts) == 1
        assert [int(json.loads(x)["custom_id"]) for x in parts[0].read_text().splitlines()] == list(range(low, high))


def test_rewriting_runs_in_parallel_and_keeps_finished_waves(spark, tmp_path):
    import os

    from pyspark import TaskContext

    rows = spark.createDataFrame([(i, f"text {i}", None) for i in range(80)], "id bigint, full string, summary string")
    told = enrich.map_with_checkpoint(rows, lambda t: str(TaskContext.get().partitionId()), str(tmp_path / "p"), waves=1)
    assert told.select("summary").distinct().count() >= 6

    store, broken = str(tmp_path / "s"), tmp_path / "broken"
    broken.write_text("")

    def fragile(text):
        if text == "text 7" and broken.exists():
            os._exit(1)
        return "first" if broken.exists() else "second"

    try:
        enrich.map_with_checkpoint(rows, fragile, store, waves=4)
        raise AssertionError("the broken run should end")
    except Exception as error:
        assert "broken run" not in str(error)
    broken.unlink()
    out = [r["summary"] for r in enrich.map_with_checkpoint(rows, fragile, store, waves=4, run=1).collect()]
    assert len(out) == 80 and set(out) <= {"first", "second"} and "second" in out
    wave = rows.where(F.pmod(F.xxhash64(prompts.content_key(F.col("full"))), F.lit(4)) == 0).count()
    hit = rows.where("full = 'text 7'").select(F.pmod(F.xxhash64(prompts.content_key(F.col("full"))), F.lit(4))).first()[0]
    assert out.count("first") >= (wave if hit > 0 else 0)


def test_observed_totals_equal_the_stored_ones_after_a_broken_run(spark, tmp_path):
    """A wave that breaks is neither stored nor told; the rerun tells its own calls."""
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([(i, f"text number {i}", None) for i in range(40)], "id bigint, full string, summary string")
    told, later = [], []

    def work(text):
        return text.upper(), 3, 2, 0.5

    class Lost(Exception):
        pass

    def progress(totals):
        told.append(totals)
        if len(told) == 2:
            raise Lost

    stored = lambda: enrich.usage_totals(spark.read.parquet(store)).collect()[0]
    with pytest.raises(Lost):
        enrich.map_with_checkpoint(rows, work, store, waves=4, progress=progress)
    assert {c: stored()[c] for c in enrich.USAGE} == told[-1] and 0 < told[-1]["calls"] < 40
    out = enrich.map_with_checkpoint(rows, work, store, waves=4, run=1, progress=later.append)
    assert [r.summary for r in out.orderBy("id").collect()] == [f"TEXT NUMBER {i}" for i in range(40)]
    assert len(later) == 4 and later[-1]["calls"] + told[-1]["calls"] == stored()["calls"] == 40
    assert later[-1]["cost"] == later[-1]["calls"] * 0.5


def test_subword_tokens_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", None, "short", "Title: Kettle  with\nlines and 漢字 and more words than fit", "x" * 300]
    count, cut = hooks.piece_hooks(path, 7)
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").select("id", count("t").alias("n"), cut("t").alias("c")).orderBy("id").collect()
    for r, t in zip(rows, texts):
        ids = model.encode(t or "")
        assert r.n == len(ids)
        assert r.c == (t if t is None or len(ids) <= 7 else model.decode(ids[:7]).rstrip())


def test_a_category_without_a_kept_row_is_parsed_once(spark, tmp_path, monkeypatch):
    raw, cache = tmp_path / "raw", str(tmp_path / "cache")
    for name, price in (("Appliances", "20"), ("Electronics", "nothing")):
        (raw / f"meta={name}").mkdir(parents=True)
        (raw / f"meta={name}" / "part.txt").write_text(line(f"A {name}", price) + "\n")
    parsed, real = [], products.load_categories
    monkeypatch.setattr(products, "load_categories", lambda spark, path, categories: parsed.append(list(categories)) or real(spark, path, categories))
    both = ["Appliances", "Electronics"]
    first = products.category_cache(spark, str(raw), cache, both)
    assert [r.title for r in first.collect()] == ["A Appliances"]
    writes = []
    monkeypatch.setattr(spark, "createDataFrame", lambda *args: writes.append(args))
    again = products.category_cache(spark, str(raw), cache, both)
    assert [r.title for r in again.collect()] == ["A Appliances"] and not writes
    assert products.category_cache(spark, str(raw), cache, ["Electronics"]).count() == 0

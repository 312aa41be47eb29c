import json

import pytest
from pyspark.sql import functions as F

from pricelens.operators import deals
from pricelens.sources.feeds import deal_source, first_entries
from pricelens.sources.memory import read_memory, remember
from pricelens.streaming import deals as polling


@pytest.mark.parametrize("text, price", [
    ("$100 off, now $250", 250.0), ("reduced by $20 to $1,080.50", 1080.5), ("$30 Off", None), ("no price", None), ("Now $5 after $20 off", 5.0),
])
def test_advertised_price(one, text, price):
    assert one(deals.advertised_price(F.col("a")), a=text) == price


def offer(spark, rows):
    return spark.createDataFrame(rows, "product_description string, price double, url string, category string, pos int")


def test_best_deal(spark):
    rows = offer(spark, [("a", 250.0, "u1", "c", 1), ("b", 100.0, "u2", "c", 2), ("c", 280.0, "u3", "c", 3), ("d", 100.0, "u0", "c", 4)])
    best = deals.best_deal(deals.opportunities(rows, F.lit(300.0))).collect()
    assert [(r["url"], r["discount"]) for r in best] == [("u2", 200.0)]
    assert deals.best_deal(deals.opportunities(rows.where("price = 250"), F.lit(300.0))).count() == 0
    assert deals.best_deal(deals.opportunities(rows.where("price = 0"), F.lit(300.0))).count() == 0


def test_top_deals_and_unseen(spark):
    rows = offer(spark, [("x" * n, float(n % 3), f"u{n}", "c", n) for n in range(1, 12)])
    assert [r["url"] for r in deals.top_deals(rows).collect()] == ["u11", "u10", "u8", "u7", "u5"]
    seen = deals.as_opportunity(deals.opportunities(rows.where("url = 'u10'"), F.lit(9.0)))
    assert deals.unseen(rows, seen).count() == 10


def test_feeds(spark):
    entries = spark.createDataFrame(
        [("f", i, f"t{i}", None if i == 2 else f"u{i}") for i in range(15)] + [("g", 0, "x", "u0"), ("g", 1, "y", "gone")],
        "feed string, pos int, title string, url string",
    )
    pages = spark.createDataFrame([(f"u{i}", f"<article>text {i} Features f{i}</article>") for i in range(15)], "url string, html string")
    rows = deal_source(entries, pages)
    assert rows.where("feed = 'f'").count() == 9 and rows.where("feed = 'g'").count() == 1
    digest = {r["feed"]: r for r in deals.deal_digest(rows).collect()}
    assert digest["f"]["deals"] == 9 and digest["f"]["prompt"].count("Title: ") == 9
    assert digest["f"]["prompt"].index("Title: t0\n") < digest["f"]["prompt"].index("Title: t9\n")
    hot = first_entries(entries)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in hot


def write_polls(path, polls):
    import os
    import time

    os.makedirs(path)
    for n, rows in enumerate(polls):
        file = os.path.join(path, f"poll{n}.json")
        with open(file, "w") as f:
            f.writelines(json.dumps(dict(zip(("product_description", "price", "url", "category"), r))) + "\n" for r in rows)
        os.utime(file, (time.time() - 100 + n * 10,) * 2)


def test_stream_equals_batch_replay(spark, tmp_path):
    shared = [("long description", 100.0, "a", "c"), ("short", 180.0, "b", "c"), ("no", 260.0, "never", "c")]
    polls = [shared, shared, shared, [("free", 0.0, "z", "c"), ("dear", 290.0, "y", "c")]]
    write_polls(str(tmp_path / "in"), polls)
    estimate = lambda rows: rows.withColumn("estimate", F.lit(300.0))
    run = lambda: polling.stream_deals(
        polling.read_polls(spark, str(tmp_path / "in"), 1), str(tmp_path / "memory"), str(tmp_path / "state"), estimate
    ).awaitTermination()
    run()
    got = {(r["batch_id"], r["deal"]["url"], r["discount"]) for r in read_memory(spark, str(tmp_path / "memory")).collect()}
    # a rejected or passed-over deal comes back; an alerted one does not; the third poll finds nothing above the threshold
    assert got == {(0, "a", 200.0), (1, "b", 120.0)}

    seen, replay = set(), set()
    for n, rows in enumerate(polls):
        best = max(((300 - p, u) for d, p, u, _ in rows if p > 0 and u not in seen), default=(0, None))
        if best[0] > 50:
            seen.add(best[1])
            replay.add((n, best[1], best[0]))
    assert got == replay

    run()  # nothing new arrived, nothing is alerted twice
    assert read_memory(spark, str(tmp_path / "memory")).count() == 2
    batch = spark.createDataFrame(shared, polling.DEAL)
    run = read_memory(spark, str(tmp_path / "memory")).where("batch_id = 0").first()["run"]
    again = polling.poll(batch, read_memory(spark, str(tmp_path / "memory"), but=(run, 0)), estimate)
    remember(deals.as_opportunity(again), str(tmp_path / "memory"), 0, run)
    assert read_memory(spark, str(tmp_path / "memory")).count() == 2


def test_a_new_stream_still_knows_older_alerts(spark, tmp_path):
    """Ids of polls start again with a new checkpoint; nothing that was alerted is hidden, sent again or replaced."""
    rows = [("x" * n, 10.0, f"u{n}", "c") for n in range(1, 4)]
    write_polls(str(tmp_path / "polls"), [rows])
    estimate = lambda frame: frame.withColumn("estimate", F.lit(100.0) + F.length("product_description"))
    for turn in range(3):
        running = polling.stream_deals(
            polling.read_polls(spark, str(tmp_path / "polls")), str(tmp_path / "memory"), str(tmp_path / f"check{turn}"), estimate
        )
        running.awaitTermination()
    got = [r["deal"]["url"] for r in read_memory(spark, str(tmp_path / "memory")).collect()]
    assert sorted(got) == ["u1", "u2", "u3"]


def test_a_poll_takes_all_files(spark, tmp_path):
    write_polls(str(tmp_path / "polls"), [[("x", 1.0, f"u{n}", "c")] for n in range(3)])
    seen = []
    reader = polling.read_polls(spark, str(tmp_path / "polls"))
    running = reader.writeStream.foreachBatch(lambda batch, i: seen.append(batch.count())).option(
        "checkpointLocation", str(tmp_path / "check")
    ).trigger(availableNow=True).start()
    running.awaitTermination()
    assert seen == [3]

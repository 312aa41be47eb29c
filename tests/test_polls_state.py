"""The poll source and the keyed state of the polling stream."""

import os

import pytest
from pyspark.sql import functions as F

from pricelens.sources import polls
from pricelens.sources.memory import read_memory
from pricelens.streaming import deals as polling

from test_deals_stream import write_polls

ENTRIES = "feed string, pos bigint, title string, url string, html string, offer string, category string"


def entries(spark, rows):
    """(feed, pos, url, text) as entries with an offer."""
    return spark.createDataFrame(
        [(f, i, f"t{i}", u, None if t is None else f"<html><article>{t}</article></html>", " Now $10", "c") for f, i, u, t in rows], ENTRIES
    )


def collected(spark, frame, tmp_path, name):
    """The rows of a run over what has arrived, and of those before it."""
    out = str(tmp_path / name)
    running = frame.writeStream.format("parquet").option("checkpointLocation", out + "-check").trigger(availableNow=True).start(out)
    running.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out).collect()


def test_polls_are_offsets(spark, tmp_path):
    path = str(tmp_path / "polls")
    rows = [("f", i, None if i == 2 else f"u{i}", f"text {i} Features f{i}") for i in range(14)] + [("g", 0, "gone", None), ("g", 1, "v", "more")]
    polls.write_poll(entries(spark, rows).repartition(5), path, 0)
    polls.write_poll(entries(spark, rows[:3]), path, 1)
    os.makedirs(f"{path}/poll=2")  # still written
    polls.write_poll(entries(spark, rows[:3]), path, 3)
    frame = polls.scraped(polls.read_feeds(spark, path))
    got = collected(spark, frame, tmp_path, "out")
    assert sorted((r.poll, r.feed, r.pos, r.url) for r in got) == sorted(
        [(0, "f", i, f"u{i}") for i in range(10) if i != 2] + [(0, "g", 1, "v"), (1, "f", 0, "u0"), (1, "f", 1, "u1")]
    )
    assert {(r.title, r.details.strip(), r.features.strip()) for r in got if r.url == "u1"} == {("t1", "text 1", "f1")}
    polls.write_poll(entries(spark, [("f", 0, "late", "x")]), path, 2)
    again = collected(spark, frame, tmp_path, "out")
    assert sorted((r.poll, r.url) for r in again if r.poll > 1) == [(2, "late"), (3, "u0"), (3, "u1")]
    assert len(again) == len(got) + 3


def test_reader_of_an_empty_folder(tmp_path):
    reader = polls.PollReader(str(tmp_path / "nothing"), 10)
    assert reader.initialOffset() == reader.latestOffset() == {"poll": 0} and reader.partitions({"poll": 0}, {"poll": 0}) == []


def estimate(rows):
    return rows.withColumn("estimate", F.lit(100.0) + F.length("product_description"))


def alerts(spark, path):
    return sorted((r["batch_id"], r["deal"]["url"]) for r in read_memory(spark, path).collect())


def test_polls_in_one_batch_are_worked_off_in_order(spark, tmp_path):
    """Three polls wait when the stream starts: one batch, and still one alert each, none twice."""
    path = str(tmp_path / "polls")
    rows = [("f", i, f"u{i}", "x" * (20 + i)) for i in range(4)]
    for n in range(3):
        polls.write_poll(entries(spark, rows).repartition(3), path, n)
    run = lambda: polling.stream_deals(
        polls.offers(polls.read_feeds(spark, path)), str(tmp_path / "memory"), str(tmp_path / "check"), estimate
    ).awaitTermination()
    run()
    assert alerts(spark, str(tmp_path / "memory")) == [(0, "u3"), (1, "u2"), (2, "u1")]
    polls.write_poll(entries(spark, rows), path, 3)
    run()  # a restart: the state knows what was alerted
    polls.write_poll(entries(spark, rows), path, 4)
    run()
    assert alerts(spark, str(tmp_path / "memory")) == [(0, "u3"), (1, "u2"), (2, "u1"), (3, "u0")]
    assert sorted(r.url for r in polling.alerted_urls(spark, str(tmp_path / "check")).collect()) == ["u0", "u1", "u2", "u3"]


def test_a_batch_that_failed_behind_its_alert_is_replayed(spark, tmp_path, monkeypatch):
    """The alert is written, then the batch fails: the replay replaces the row and alerts nothing else."""
    rows = [("x" * n, 10.0, f"u{n}", "c") for n in range(1, 5)]
    write_polls(str(tmp_path / "polls"), [rows, rows])
    real, fails = polling.remember, [True]

    def remember(*args):
        real(*args)
        if args[2] == 1 and fails:
            fails.clear()
            raise RuntimeError("lost behind the write")

    monkeypatch.setattr(polling, "remember", remember)
    run = lambda: polling.stream_deals(
        polling.read_polls(spark, str(tmp_path / "polls"), 1), str(tmp_path / "memory"), str(tmp_path / "check"), estimate
    ).awaitTermination()
    with pytest.raises(Exception):
        run()
    assert alerts(spark, str(tmp_path / "memory")) == [(0, "u4"), (1, "u3")]
    run()
    assert alerts(spark, str(tmp_path / "memory")) == [(0, "u4"), (1, "u3")]
    assert sorted(r.url for r in polling.alerted_urls(spark, str(tmp_path / "check")).collect()) == ["u3", "u4"]


def test_deals_without_a_url_are_never_stopped(spark, tmp_path):
    write_polls(str(tmp_path / "polls"), [[("some text", 10.0, None, "c")]] * 2)
    polling.stream_deals(
        polling.read_polls(spark, str(tmp_path / "polls"), 1), str(tmp_path / "memory"), str(tmp_path / "check"), estimate
    ).awaitTermination()
    assert alerts(spark, str(tmp_path / "memory")) == [(0, None), (1, None)]

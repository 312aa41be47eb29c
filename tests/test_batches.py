"""What a Python worker holds of texts and pages does not follow the rows of a partition."""

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pricelens.operators import inverted, models
from pricelens.plans import views
from pricelens.sources import polls
from pricelens.streaming.deals import Unalerted


def test_pages_go_to_python_in_small_batches(spark, tmp_path):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(3_000).select(F.col("id").alias("page_id"), F.repeat(F.lit("x"), 5_000).alias("html"))
    rows.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))

    @F.pandas_udf("long")
    def held(pages: pd.Series) -> pd.Series:
        return pd.Series([len(pages)] * len(pages))

    assert views.table(spark, str(tmp_path), "pages").select(held("html").alias("n")).agg(F.max("n")).first()[0] < 1_000


def test_polls_are_read_through_a_buffer(spark, tmp_path, monkeypatch):
    entries = spark.createDataFrame([("f", i, None, f"u{i}", "page", "offer", "c") for i in range(9)], polls.ENTRY.removeprefix("poll bigint, "))
    polls.write_poll(entries.coalesce(1), str(tmp_path), 0)
    sizes, plain = [], pq.ParquetFile
    monkeypatch.setattr(pq, "ParquetFile", lambda file, **options: sizes.append(options.get("buffer_size", 0)) or plain(file, **options))
    reader = polls.PollReader(str(tmp_path), 5)
    found = [b for p in reader.partitions({"poll": 0}, {"poll": 1}) for b in reader.read(p)]
    assert sum(b.num_rows for b in found) == 5 and sizes and all(0 < n <= 4 << 20 for n in sizes)


def test_deals_without_a_url_pass_as_they_come():
    """They are one group, but only one part of it is held."""
    class Flag:
        exists, update = (lambda self: False), (lambda self, value: None)

    processor, taken = Unalerted(), []
    processor.alerted = Flag()
    part = pd.DataFrame({"url": [None, None], "alert": [False, True]})
    found = processor.handleInputRows((None,), (taken.append(i) or part for i in range(3)), None)
    assert len(next(found)) == 1 and taken == [0]
    assert len(list(found)) == 2


def test_visitors_of_a_list_are_cut_into_blocks(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(inverted, "VISIT_ROWS", 16, raising=False)
    plain = inverted._scan

    def counted(lists, count):
        run = plain(lists, count)

        def scan(queries, rows):
            sizes.add(len(queries) > 40)
            return run(queries, rows)

        return scan

    monkeypatch.setattr(inverted, "_scan", counted)
    rows = spark.range(400).select("id", F.array(*[F.rand(i).cast("float") for i in range(4)]).alias("embedding"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    assert inverted.nearest_listed(rows, rows, 3).count() == 1_200 and sizes.value == 0


def test_rows_for_trees_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(models, "TREE_ROWS", 100)
    train = spark.createDataFrame([(i, f"word{i % 7}", float(i % 50)) for i in range(1_000)], "id bigint, summary string, price double").coalesce(1)
    held = models.dealt(train)
    assert held.rdd.getNumPartitions() == 10 and sorted(held.collect()) == sorted(train.select("summary", "price").collect())
    monkeypatch.setattr(models, "TREE_ROWS", 1_000)
    assert models.dealt(train).rdd.getNumPartitions() == 1

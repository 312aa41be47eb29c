"""Feeds polled as a stream: a Python data source whose offsets are polls.

A poll is a folder `poll=<n>` of Parquet files with the entries of all feeds and their pages, complete once
it holds a `_SUCCESS` marker. How it got there (a crawler, a writer of this engine) is not this source's
concern. Offsets count polls, so which entries belong to a poll never depends on names, times or sizes of
files. Each (poll, file) is a partition of its own, read in a task.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from pricelens import config
from pricelens.functions import markup
from pricelens.operators.deals import advertised_price

ENTRY = "poll bigint, feed string, pos bigint, title string, url string, html string, offer string, category string"
MARKER = "_SUCCESS"
# Bytes of a column read from a file at once.
READ_BYTES = 1 << 20


class PollFile(InputPartition):
    def __init__(self, poll: int, path: str):
        super().__init__((poll, path))
        self.poll, self.path = poll, path


class PollReader(DataSourceStreamReader):
    """Offsets are `{"poll": n}`: all polls below `n` have been read."""

    def __init__(self, path: str, entries: int):
        self.path, self.entries = path.rstrip("/"), entries

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        """Behind the last of the complete polls that follow each other: one that is still written is waited for."""
        from pyarrow import fs

        files, base = self._files()
        n, found = 0, {f.base_name for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.type == fs.FileType.Directory}
        while f"poll={n}" in found and files.get_file_info(f"{base}/poll={n}/{MARKER}").type == fs.FileType.File:
            n += 1
        return {"poll": n}

    def partitions(self, start: dict, end: dict) -> list[PollFile]:
        from pyarrow import fs

        files, base = self._files()
        out = []
        for n in range(start["poll"], end["poll"]):
            names = [f.path for f in files.get_file_info(fs.FileSelector(f"{base}/poll={n}")) if f.path.endswith(".parquet")]
            out += [PollFile(n, p) for p in sorted(names)]
        return out

    def read(self, partition: PollFile):
        """The first entries of each feed that have a link and a page, as Arrow batches."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        files, _ = self._files()
        names = [c.split(" ")[0] for c in ENTRY.split(", ")[1:]]
        with files.open_input_file(partition.path) as file:
            # Through a buffer: else a whole column of a row group, here of pages, is held at once.
            for batch in pq.ParquetFile(file, buffer_size=READ_BYTES).iter_batches(batch_size=500, columns=names):
                first = pc.and_(pc.less(batch.column("pos"), self.entries), pc.and_(batch.column("url").is_valid(), batch.column("html").is_valid()))
                kept = batch.select(names).filter(first)
                poll = pa.array([partition.poll] * kept.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([poll, *kept.columns], ["poll", *names])

    def commit(self, end: dict) -> None:
        pass


class PollSource(DataSource):
    """`spark.readStream.format("feed_polls").option("entries", 10).load(path)` once registered."""

    @classmethod
    def name(cls) -> str:
        return "feed_polls"

    def schema(self) -> str:
        return ENTRY

    def streamReader(self, schema) -> PollReader:
        return PollReader(self.options["path"], int(self.options.get("entries", config.ENTRIES_PER_FEED)))


def write_poll(entries: DataFrame, path: str, poll: int) -> None:
    """One poll: `feed, pos, title, url, html, offer, category`, with `pos` counted from 0 in each feed.

    The marker is written when all files are there; writing a poll again replaces it.
    """
    entries.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/poll={poll}")


def read_feeds(spark: SparkSession, path: str, entries: int = config.ENTRIES_PER_FEED) -> DataFrame:
    """Entries with their pages, as they are polled."""
    spark.dataSource.register(PollSource)
    return spark.readStream.format("feed_polls").option("path", path).option("entries", str(entries)).load()


def scraped(entries: DataFrame) -> DataFrame:
    """Title, details and features of each page; a map over the stream."""
    return entries.select("poll", "feed", "pos", "url", *markup.deal_fields(F.col("title"), markup.page_section(F.col("html"))))


def offers(entries: DataFrame) -> DataFrame:
    """Deals of a stream of entries: the page's text with its offer, and the price that this advertises."""
    text = F.concat(markup.page_section(F.col("html")), F.col("offer"))
    rows = entries.select("poll", "url", "category", text.alias("product_description"))
    return rows.withColumn("price", advertised_price(F.col("product_description")))

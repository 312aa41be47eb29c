"""A table of texts with their vectors that is extended by content, committed atomically and searched by text.

The store is a folder. Parts (parquet) are written first, each under a fresh name; a commit then adds one
small manifest that lists all parts. Manifests are numbered, and one is put in place by a rename that
fails where the number is taken. So a writer that dies leaves parts which no manifest names and which
nothing reads; of two writers the second finds its number taken, looks at what the first has stored and
tries again; and a reader sees all of a commit or nothing.

A row's key is a hash of its text, so the order and the numbers of the input don't matter. Texts already
stored are not encoded again; if their other columns have changed, a part of newer columns by key replaces
those. What is new or changed is found on keys and columns alone; texts move once, when they are stored.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricelens import config
from pricelens.functions import prompts
from pricelens.operators import inverted, retrieve
from pricelens.operators.order import ordinal_by_id
from pricelens.session import discard, materialize
from pricelens.sources.tables import document_id

ADDED, REPLACED = "added", "replaced"
TRIES = 20
# Keys of new texts sent to every task; more are joined by a shuffle.
BROADCAST_KEYS = 200_000


class CommitConflict(Exception):
    """Another writer has committed in between."""


class VectorStore:
    """`encode` makes the vector column (array) from the text column; `metadata` names further columns to keep."""

    def __init__(self, spark: SparkSession, path: str, encode, metadata=()):
        self.spark, self.path, self.encode, self.metadata = spark, path.rstrip("/"), encode, tuple(metadata)

    # ------------------------------------------------------------ manifests

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place, files = self._place(folder)
        return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []

    def manifest(self) -> dict:
        """The newest state: number, parts, how many texts have been numbered, and the learned lists."""
        numbers = [int(n.split(".")[0]) for n in self._names("manifests") if n.endswith(".json") and not n.startswith(("_", "."))]
        if not numbers:
            return {"number": 0, "parts": [], "texts": 0, "lists": None}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{max(numbers):020d}.json", wholetext=True).first()[0])

    def commit(self, manifest: dict) -> dict:
        """Put the manifest in place as the next one; `CommitConflict` where that number is taken."""
        after = manifest | {"number": manifest["number"] + 1}
        staged, files = self._place(f"staged/{uuid.uuid4().hex}.json")
        place, _ = self._place(f"manifests/{after['number']:020d}.json")
        files.mkdirs(place.getParent())
        out = files.create(staged, False)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(staged, place, never_over)
        except Exception as error:  # a Java exception as the gateway wraps it
            if files.exists(place):
                files.delete(staged, False)
                raise CommitConflict(after["number"]) from error
            raise
        return after

    def vacuum(self) -> list[str]:
        """Remove parts that the newest manifest does not name. Only while nothing writes or reads an older state."""
        held = {n for p in self.manifest()["parts"] for n in (p["rows"], p.get("entries"))} | {self.manifest()["lists"]}
        gone = [n for n in self._names("parts") if n not in held]
        for name in gone:
            self._drop(name)
        return gone

    def _drop(self, part: str) -> None:
        place, files = self._place(f"parts/{part}")
        files.delete(place, True)

    # ------------------------------------------------------------ rows

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/parts/{name}")
        return name

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/parts/{n}" for n in names])

    def table(self, manifest: dict = None) -> DataFrame | None:
        """`id, key, document, embedding` and the metadata of every text; None while nothing is stored.

        Columns are only looked up by key where some have been replaced since the last `compact`.
        """
        parts = (manifest or self.manifest())["parts"]
        if not parts:
            return None
        whole = self._added(parts)
        columns = ["id", "key", "document", "embedding"]
        changes = [self._read([p["rows"]]).select("key", F.struct(*self.metadata).alias("_new"), F.lit(i).alias("_part")) for i, p in enumerate(parts) if p["kind"] == REPLACED]
        if not changes:
            return whole.select(*columns, *self.metadata)
        union = changes[0]
        for more in changes[1:]:
            union = union.unionByName(more)
        newest = union.groupBy("key").agg(F.max_by("_new", "_part").alias("_new"))
        replaced = F.col("_new").isNotNull()
        return whole.join(newest, "key", "left").select(*columns, *[F.when(replaced, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in self.metadata])

    def _added(self, parts: list[dict]) -> DataFrame:
        """Every text as it was stored first."""
        return self._read([p["rows"] for p in parts if p["kind"] == ADDED])

    def upsert(self, rows: DataFrame, text: str = "document", order: str = "id") -> dict:
        """Store each text of `rows` once; returns the manifest after it.

        Of equal texts the row that comes first in `order` gives the metadata. New texts are encoded and
        numbered on from those stored, in `order`. Null texts are left out. `rows` is read twice, for its keys and
        for new texts, and has to give the same both times.
        """
        keyed = rows.where(F.col(text).isNotNull())
        keyed = keyed.select(prompts.content_key(F.col(text)).alias("key"), F.col(order).alias("_order"), F.col(text).alias("document"), F.struct(F.lit(1).alias("_row"), *self.metadata).alias("_held"))
        once = keyed.groupBy("key", "_order").agg(F.first("_held").alias("_held"), F.count(F.lit(1)).alias("_n"))
        first = F.min_by(F.struct("_held", "_n"), "_order").alias("_first")
        incoming = once.groupBy("key").agg(first, F.min("_order").alias("_order"))
        incoming = materialize(incoming.select("key", "_order", "_first._n", *[F.col(f"_first._held.{c}").alias(c) for c in self.metadata]), "incoming")
        try:
            for _ in range(TRIES):
                before = self.manifest()
                parts = self._parts(keyed, incoming, before)
                if not parts:
                    return before
                added = sum(p["count"] for p in parts if p["kind"] == ADDED)
                try:
                    return self.commit(before | {"parts": before["parts"] + parts, "texts": before["texts"] + added})
                except CommitConflict:
                    continue  # what was staged is not named by any manifest
            raise CommitConflict(f"{TRIES} tries")
        finally:
            discard(incoming)

    def _parts(self, keyed: DataFrame, incoming: DataFrame, before: dict) -> list[dict]:
        stored, parts = self.table(before), []
        fresh = incoming if stored is None else incoming.join(self._added(before["parts"]).select("key"), "key", "left_anti")
        fresh = materialize(fresh, "fresh")
        count = fresh.count()
        if count:
            numbered = materialize(ordinal_by_id(fresh, "_order", "_nth").withColumn("id", F.col("_nth") + F.lit(before["texts"])), "numbered")
            columns = ["id", "key", "document", self.encode(F.col("document")).alias("embedding"), *self.metadata]
            name = self._write(self._with_texts(keyed, numbered, count).select(*columns), ADDED)
            discard(numbered)
            if self._read([name]).count() != count:
                raise ValueError("the rows were others when they were read again")
            parts.append({"kind": ADDED, "rows": name, "count": count, "entries": self._entries(name, before["lists"])})
        discard(fresh)
        if stored is not None and self.metadata:
            new = incoming.select("key", F.struct(*self.metadata).alias("_new"))
            changed = stored.join(new, "key").where(~F.struct(*self.metadata).eqNullSafe(F.col("_new")))
            name = self._write(changed.select("key", *[F.col(f"_new.{c}").alias(c) for c in self.metadata]), REPLACED)
            count = self._read([name]).count()
            if count:  # texts and vectors stay, and with them the codes in the lists
                parts.append({"kind": REPLACED, "rows": name, "count": count, "entries": None})
            else:
                self._drop(name)
        return parts

    @staticmethod
    def _with_texts(keyed: DataFrame, numbered: DataFrame, count: int) -> DataFrame:
        """New keys with their texts, from the row that comes first; where that is there more than once, from one of them."""
        of = lambda rows: F.broadcast(rows) if count <= BROADCAST_KEYS else rows
        texts = keyed.select(F.col("key").alias("_key"), F.col("_order").alias("_at"), "document")
        same = (F.col("key") == F.col("_key")) & F.col("_order").eqNullSafe(F.col("_at"))
        found = texts.join(of(numbered.where("_n = 1")), same)
        if numbered.where("_n > 1").isEmpty():
            return found
        return found.unionByName(texts.join(of(numbered.where("_n > 1")), same).dropDuplicates(["key"]))

    def compact(self) -> dict:
        """All parts as one, without what has been replaced."""
        before = self.manifest()
        if len(before["parts"]) < 2:
            return before
        name = self._write(self.table(before), ADDED)
        part = {"kind": ADDED, "rows": name, "count": self._read([name]).count(), "entries": self._entries(name, before["lists"])}
        return self.commit(before | {"parts": [part]})

    # ------------------------------------------------------------ search

    def _entries(self, rows: str, lists: str | None) -> str | None:
        if lists is None:
            return None
        learned = inverted.load(self.spark, f"{self.path}/parts/{lists}")
        return self._write(inverted.encode(self._read([rows]), learned), "entries")

    def build_lists(self, **settings) -> dict:
        """Learn the inverted file and encode every part; later upserts encode what they add."""
        before = self.manifest()
        learned = inverted.learn(self.table(before), **settings)
        name = f"lists-{uuid.uuid4().hex}"
        inverted.save(learned, self.spark, f"{self.path}/parts/{name}")
        parts = [p | {"entries": self._entries(p["rows"], name)} if p["kind"] == ADDED else p for p in before["parts"]]
        return self.commit(before | {"parts": parts, "lists": name})

    def search(self, queries: DataFrame, k: int = config.NEIGHBOURS, text: str = "document", approximate: bool = False) -> DataFrame:
        """`query_id, rank, doc, document, distance` and the metadata of the stored texts nearest to each text of `queries` (id, text)."""
        manifest = self.manifest()
        stored = self.table(manifest)
        if stored is None:
            raise ValueError("nothing is stored yet")
        asked = queries.where(F.col(text).isNotNull()).select("id", self.encode(F.col(text)).alias("embedding"))
        asked = materialize(asked, "asked")
        vectors = self._added(manifest["parts"]).select("id", "embedding")
        if approximate:
            if manifest["lists"] is None:
                raise ValueError("build_lists first")
            learned = inverted.load(self.spark, f"{self.path}/parts/{manifest['lists']}")
            entries = self._read([p["entries"] for p in manifest["parts"] if p["entries"]])
            found = inverted.search(asked, vectors, entries, learned, k)
        else:
            found = retrieve.nearest(asked, vectors, k)
        rows = stored.select("id", document_id(F.col("id")).alias("doc"), "document", *self.metadata)
        return found.join(rows, "id").select("query_id", "rank", "doc", "document", *self.metadata, "distance")

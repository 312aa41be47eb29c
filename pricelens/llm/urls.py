"""URL filters by a sorted digest array.

A rule is (host, path, verdict). It fits a url whose host is the rule's or a subdomain of it and
whose path starts with the rule's. The rules are kept as an array of sorted 64-bit XXH64 keys with
the full strings beside it. Each Python worker maps the array from a file, probes the keys of all
host suffixes and path prefixes of a batch of urls with one vectorised binary search, and compares
the stored strings of every hit, so a collision of keys can't give a wrong verdict.
"""

import os
import pickle
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import once

# Up to so many bytes of rule text the array is broadcast; a larger list is joined (`_joined`).
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEED = 42


def host_and_path(url):
    """Host and path columns: the host lies between the first `://` and the next `/`, `?` or `#`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


class DigestArray:
    """Sorted keys, mapped from a file, and the strings they stand for."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        best = {}
        for host, path, verdict in rules:  # of contradicting rules the one that blocks counts
            best[host, path] = "block" if "block" in (verdict, best.get((host, path))) else verdict
        keyed = sorted((key_of(h, p), h, p, v) for (h, p), v in best.items())
        self.rules = [r[1:] for r in keyed]
        self.keys = np.array([r[0] for r in keyed], np.uint64)
        self.path_lengths = sorted({len(r[1]) for r in self.rules})

    def __getstate__(self):
        return {"rules": self.rules, "keys": self.keys.tobytes(), "path_lengths": self.path_lengths}

    def __setstate__(self, state):
        self.rules, self.path_lengths = state["rules"], state["path_lengths"]
        self.keys = np.zeros(0, np.uint64)
        if state["keys"]:
            with tempfile.NamedTemporaryFile(suffix=".keys", delete=False) as file:
                file.write(state["keys"])
            self.keys = np.memmap(file.name, np.uint64, "r")
            os.unlink(file.name)  # the mapping keeps it; nothing is left behind

    def candidates(self, host: str, path: str):
        """Rules that could fit: every host suffix at a dot with every path prefix of a known length."""
        ends = [path[:n] for n in self.path_lengths if n <= len(path)]
        while ends:
            for end in ends:
                yield host, end
            dot = host.find(".")
            if dot < 0:
                return
            host = host[dot + 1:]

    def longest(self, urls: list[tuple[str, str]]) -> list[tuple[str, str, str] | None]:
        """The longest fitting rule of each (host, path); of equally long ones that with the longer host."""
        owners, wanted = [], []
        for i, url in enumerate(urls):
            for candidate in self.candidates(*url):
                owners.append(i)
                wanted.append(candidate)
        found: list[tuple[str, str, str] | None] = [None] * len(urls)
        if not wanted or not len(self.keys):
            return found
        keys = np.array([key_of(*w) for w in wanted], np.uint64)
        at = np.searchsorted(self.keys, keys)
        for j in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            k = int(at[j])
            while k < len(self.keys) and self.keys[k] == keys[j]:
                rule, owner = self.rules[k], owners[j]
                if rule[:2] == wanted[j] and (found[owner] is None or _rank(rule) > _rank(found[owner])):
                    found[owner] = rule
                k += 1
        return found


def key_of(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{path}".encode("utf-8", "surrogatepass"), SEED)


def _rank(rule):
    return len(rule[0]) + len(rule[1]), len(rule[0])


@once
def _loaded(packed: bytes) -> DigestArray:
    return pickle.loads(packed)


def judge(pages: DataFrame, rules: DataFrame, *, url="url", key="page_id", default="allow", broadcast_bytes=BROADCAST_BYTES):
    """`key, host, path, rule, verdict` of every row; `rule` is null where none fits, and `default` the verdict.

    `rules` has `host, path, verdict`. Its size is measured: up to `broadcast_bytes` the array goes to
    every worker, beyond that distinct urls are joined with the rules. Null urls and urls without `://`
    have an empty host and path. Repeated rows are judged each, an empty table gives none, an empty
    list of rules gives every row the default, and other columns are not read.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 32), F.lit(0)).alias("n")).first().n
    judged = _probed(rows, rules) if size <= broadcast_bytes else _joined(rows, rules)
    return judged.select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def _probed(rows: DataFrame, rules: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    array = DigestArray([tuple(r) for r in rules.select("host", "path", "verdict").collect()])
    packed = spark.sparkContext.broadcast(pickle.dumps(array))

    def probe(batches):
        mapped = _loaded(packed.value)
        for batch in batches:
            urls = list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()))
            found = mapped.longest(urls)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("key", "host", "path")),
                    pa.array([f and f[0] + f[1] for f in found], pa.string()), pa.array([f and f[2] for f in found], pa.string()),
                ],
                ["key", "host", "path", "rule", "verdict"],
            )

    key_type = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(probe, f"key {key_type}, host string, path string, rule string, verdict string")


def _joined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a list of any size: distinct urls meet the rules on host suffix and path prefix."""
    lengths = rules.select(F.length("path").alias("n")).distinct().agg(F.sort_array(F.collect_list("n"))).scalar()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    tried = rows.select("host", "path").distinct().withColumn("lengths", lengths)
    tried = tried.withColumn("rule_host", F.explode(suffixes)).withColumn("rule_path", F.explode(prefixes))
    listed = rules.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.min_by("verdict", F.col("verdict") != "block").alias("verdict"))
    fitting = tried.join(listed, ["rule_host", "rule_path"])
    rule = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("of_host"),
        F.concat("rule_host", "rule_path").alias("rule"), "verdict",
    )
    best = fitting.groupBy("host", "path").agg(F.max(rule).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("key", "host", "path", "best.rule", "best.verdict")

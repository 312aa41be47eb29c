"""The query catalog on rows of its own."""

import ast
import collections
import inspect

import pytest

from pricelens.plans import catalog

DOCUMENTS = [(i, f"Item {i}\nfirst line of {i}.\nsecond line of {i}.\n" + "more text " * 90, "en", "s", 900) for i in range(12)]


@pytest.fixture()
def tables(spark, tmp_path):
    """Documents, events and parts of a dozen numbers."""
    frames = {
        "documents": spark.createDataFrame(DOCUMENTS, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "events": spark.createDataFrame([(i, 10.0 + i) for i in range(12)], "event_id bigint, value double"),
        "part": spark.createDataFrame([(i, i + 1, f"Brand#{i}", f"part {i}") for i in range(12)], "p_partkey bigint, p_size int, p_brand string, p_name string"),
    }
    for name, frame in frames.items():
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_no_name_is_taken_twice():
    names = collections.Counter(n.name for n in ast.parse(inspect.getsource(catalog)).body if hasattr(n, "name"))
    assert [n for n, count in names.items() if count > 1] == []


@pytest.mark.parametrize("name", ["details_map", "drop_noise_keys"])
def test_entries_of_details(spark, tables, name):
    got = {r["id"]: r["entries"] for r in catalog.QUERIES[name](spark, tables).collect()}
    assert len(got) == 12
    assert got[3].startswith("Brand=Brand#3;Item Weight=4 ") and ("Part Number=" in got[3]) == (name == "details_map")

"""The inverted file, the exact grid join and the vector store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.functions import hooks
from pricelens.operators import inverted, retrieve
from pricelens.sources import vectors as store_io
from pricelens.sources.vectors import CommitConflict, VectorStore

from test_retrieve_models import brute, got, vectors


def recall(exact, found):
    return sum(len(set(exact[q]) & set(found.get(q, []))) for q in exact) / sum(map(len, exact.values()))


def test_lists_on_clusters_find_nearly_all_and_scan_little(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 32))
    values = centres[rng.integers(0, 60, 1500)] + 0.3 * rng.standard_normal((1500, 32))
    frame, pairs = vectors(spark, values), list(enumerate(values))
    found = got(inverted.nearest_listed(frame, frame, 5, True))
    assert recall(brute(pairs, pairs, 5, True), found) >= 0.95
    lists = inverted.learn(frame)
    assert inverted.share_scanned(frame, inverted.encode(frame, lists), lists) < 0.15


def test_recall_on_given_vectors_with_the_fixed_settings(spark):
    """Queries with an id divisible by 50 against all rows of vectors without structure."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    pairs = [(r.id, r.embedding) for r in rows.collect()]
    asked = [(i, v) for i, v in pairs if i % 50 == 0]
    found = got(inverted.nearest_listed(rows.where("id % 50 = 0"), rows, 5, True))
    assert recall(brute(asked, pairs, 5, True), found) >= 0.9


@pytest.mark.parametrize("block", [7, 100_000])
def test_lists_in_blocks_and_with_copies(spark, block, monkeypatch):
    """With every list probed and every candidate kept, the result is the exact one, however lists are cut."""
    monkeypatch.setattr(inverted, "BLOCK_ROWS", block)
    rng = np.random.default_rng(7)
    values = rng.standard_normal((200, 5))
    values[:90] = values[0]
    frame, pairs = vectors(spark, values), list(enumerate(values))
    found = got(inverted.nearest_listed(frame, frame, 4, True, margin=10**9, candidates=200))
    assert found == brute(pairs, pairs, 4, True)


def test_codes_and_lists_round_trip(spark, tmp_path):
    codes = np.random.default_rng(1).integers(0, 16, (40, 7)).astype(np.uint8)
    assert (inverted.unpack(inverted.pack(codes), 7) == codes).all()
    frame = vectors(spark, np.random.default_rng(2).standard_normal((300, 9)))
    lists = inverted.learn(frame, lists=8)
    inverted.save(lists, spark, str(tmp_path / "lists"))
    again = inverted.load(spark, str(tmp_path / "lists"))
    assert (again.scale, again.step) == (lists.scale, lists.step) and (again.centroids == lists.centroids).all()
    one, two = (sorted(map(tuple, inverted.encode(f, again).collect())) for f in (frame, frame.repartition(7)))
    assert one == two
    assert inverted.learn(frame.where("false")) is None and inverted.nearest_listed(frame, frame.where("false")).count() == 0


def test_equal_and_zero_vectors(spark):
    frame = vectors(spark, [[0, 0]] * 4 + [[1e-7, 0], [3, 4]])
    pairs = [(r.id, r.embedding) for r in frame.collect()]
    exact = brute(pairs, pairs, 3, True)
    assert got(retrieve.nearest(frame, frame, 3, True)) == exact
    assert got(inverted.nearest_listed(frame, frame, 3, True, margin=10**9)) == exact


@pytest.mark.parametrize("scale", [1e-4, 1.0, 1e5])
def test_bounds_hold_far_from_the_origin(spark, scale):
    """Clusters much tighter than their distance from the origin: codes tell little apart, results stay exact."""
    rng = np.random.default_rng(3)
    values = scale * (100.0 + rng.standard_normal((4, 6))[rng.integers(0, 4, 240)] + 1e-3 * rng.standard_normal((240, 6)))
    frame, pairs = vectors(spark, values), list(enumerate(values))
    assert got(retrieve.nearest(frame, frame, 5, True)) == brute(pairs, pairs, 5, True)


def test_grid_keeps_blocks_small_and_cores_busy(monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 1000)
    for q, n, cores in ((10, 10, 8), (100_000, 100_000, 8), (50, 1_000_000, 8), (5_000, 5_000, 100), (0, 0, 4)):
        a, b = retrieve.grid(q, n, cores)
        assert q / a <= 1000 and n / b <= 1000
        assert a * b >= 2 * cores or max(q / a, n / b) <= retrieve.LEAST_BLOCK_ROWS


# ---------------------------------------------------------------- vector store


def letters():
    """A class that workers get by value."""

    class Letters:
        def encode(self, texts):
            return [[t.count(c) for c in "abcde"] for t in texts]

    return Letters


def texts(spark, rows):
    return spark.createDataFrame(rows, "id bigint, document string, price double")


@pytest.fixture()
def store(spark, tmp_path):
    return VectorStore(spark, str(tmp_path / "store"), hooks.encode_hook(letters()), ("price",))


def rows_of(store):
    return sorted((r.id, r.document, r.price, r.embedding) for r in store.table().collect())


def test_upsert_by_content(spark, store):
    assert store.table() is None and store.manifest()["number"] == 0
    store.upsert(texts(spark, [(5, "aa", 1.0), (3, "b", 2.0), (9, "b", 7.0), (1, None, 1.0)]))
    assert rows_of(store) == [(0, "b", 2.0, [0, 1, 0, 0, 0]), (1, "aa", 1.0, [2, 0, 0, 0, 0])]
    before = store.manifest()
    assert store.upsert(texts(spark, [(90, "aa", 1.0), (100, "b", 2.0)])) == before  # other numbers, nothing new
    store.upsert(texts(spark, [(1, "ccc", 4.0), (2, "b", 3.0), (3, "aa", None)]))
    assert rows_of(store) == [(0, "b", 3.0, [0, 1, 0, 0, 0]), (1, "aa", None, [2, 0, 0, 0, 0]), (2, "ccc", 4.0, [0, 0, 3, 0, 0])]
    assert [p["kind"] for p in store.manifest()["parts"]] == ["added", "added", "replaced"]
    whole = rows_of(store)
    store.compact()
    assert rows_of(store) == whole and len(store.manifest()["parts"]) == 1
    assert store.upsert(texts(spark, [(1, "d", 1.0)]))["texts"] == 4
    assert len(store.vacuum()) == 3 and [r[0] for r in rows_of(store)] == [0, 1, 2, 3]


def test_half_a_write_is_never_read(spark, store, monkeypatch):
    store.upsert(texts(spark, [(1, "a", 1.0)]))
    monkeypatch.setattr(store, "commit", lambda manifest: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.upsert(texts(spark, [(2, "b", 1.0)]))
    monkeypatch.undo()
    assert [r[1] for r in rows_of(store)] == ["a"]
    store.upsert(texts(spark, [(2, "b", 1.0)]))
    assert [r[:2] for r in rows_of(store)] == [(0, "a"), (1, "b")]
    assert len(store.vacuum()) == 1


def test_two_writers(spark, store, monkeypatch):
    """The second finds its number taken, and stores what the first has not."""
    store.upsert(texts(spark, [(1, "a", 1.0)]))
    other = VectorStore(spark, store.path, hooks.encode_hook(letters()), ("price",))
    stale, real = store.manifest(), store.manifest
    other.upsert(texts(spark, [(1, "b", 1.0), (2, "c", 1.0)]))
    answers = iter([stale])
    monkeypatch.setattr(store, "manifest", lambda: next(answers, None) or real())
    store.upsert(texts(spark, [(7, "c", 1.0), (8, "d", 1.0)]))
    assert [r[:2] for r in rows_of(store)] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    with pytest.raises(CommitConflict):
        store.commit(stale)


def test_search_by_text_exact_and_by_lists(spark, store):
    with pytest.raises(ValueError):
        store.search(texts(spark, [(1, "a", 1.0)]))
    store.upsert(texts(spark, [(i, "a" * (i % 13) + "b" * (i // 13), float(i)) for i in range(100)]))
    with pytest.raises(ValueError):
        store.search(texts(spark, [(1, "a", 1.0)]), approximate=True)
    store.build_lists(lists=4)
    store.upsert(texts(spark, [(i, "c" * (i - 99) + "d", float(i)) for i in range(100, 120)]))  # encoded as it is added
    assert all(p["entries"] for p in store.manifest()["parts"])
    asked = texts(spark, [(500, "aaab", 0.0), (501, "ccccd", 0.0), (502, None, 0.0)])
    for approximate in (False, True):
        found = store.search(asked, 3, approximate=approximate).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.rank) for r in found] == [(q, k) for q in (500, 501) for k in (1, 2, 3)]
        assert found[0].document == "aaab" and found[0].distance == 0 and found[0].price == 16.0 and found[0].doc == "doc_16"
        assert found[3].document == "ccccd"


@pytest.mark.parametrize("most", [0, 200_000])
def test_texts_move_once(spark, store, most, monkeypatch):
    """Rows that come twice, equal texts under several numbers; changed metadata is stored without the texts."""
    monkeypatch.setattr(store_io, "BROADCAST_KEYS", most, raising=False)
    rows = [(5, "aa", 1.0), (5, "aa", 1.0), (9, "b", 7.0), (3, "b", 2.0), (4, "cc", None), (4, "cc", None), (1, None, 1.0)]
    assert store.upsert(texts(spark, rows))["texts"] == 3
    assert [r[:3] for r in rows_of(store)] == [(0, "b", 2.0), (1, "cc", None), (2, "aa", 1.0)]
    changed = store.upsert(texts(spark, [(1, "aa", 4.0), (2, "d", 5.0), (3, "cc", 6.0), (3, "cc", 6.0)]))
    assert [(p["kind"], p["count"]) for p in changed["parts"]] == [("added", 3), ("added", 1), ("replaced", 2)]
    assert store._read([changed["parts"][2]["rows"]]).columns == ["key", "price"]
    store.upsert(texts(spark, [(1, "aa", None)]))
    whole = [(0, "b", 2.0), (1, "cc", 6.0), (2, "aa", None), (3, "d", 5.0)]
    assert [r[:3] for r in rows_of(store)] == whole
    store.compact()
    assert [r[:3] for r in rows_of(store)] == whole


def test_blocks_meet_without_being_copied(spark, monkeypatch):
    """What is written for a search grows with the vectors, not with the blocks they are cut into."""
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 25)
    written, plain = [], retrieve.materialize

    def materialize(frame, name):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        done = plain(frame, name)
        written.append((name, done.count(), "CartesianProduct" in plan, plan.count("Exchange")))
        return done

    monkeypatch.setattr(retrieve, "materialize", materialize)
    values = np.random.default_rng(8).standard_normal((400, 5))
    frame, pairs = vectors(spark, values), list(enumerate(values))
    assert got(retrieve.nearest(frame, frame, 5)) == brute(pairs, pairs, 5, False)
    met = {name: (count, meets, moved) for name, count, meets, moved in written}
    assert met["begun"][0] == met["query-blocks"][0] >= 16 and met["begun"][1]
    assert met["candidates"][1] and met["candidates"][2] == 0


@pytest.mark.parametrize("block", [300, 100_000])
def test_a_block_of_lists_sends_the_best_only(spark, block, monkeypatch):
    """A query gets its best codes of each block of lists, not of each list; and they are the best of all."""
    monkeypatch.setattr(inverted, "BLOCK_ROWS", block)
    values = np.random.default_rng(9).standard_normal((900, 6))
    frame = vectors(spark, values)
    lists = inverted.learn(frame)
    entries = inverted.encode(frame, lists)
    cells = F.array(*[F.lit(c) for c in range(len(lists.centroids))])
    visits = frame.where("id < 40").select(F.col("id").alias("rep"), "embedding", cells.alias("cells"))
    found = inverted.scanned(visits, entries, lists, 7).collect()
    assert 40 * 7 <= len(found) <= (40 * 7 if block > 900 else 40 * 7 * 6)
    coded = {r["id"]: lists.decoded(inverted.unpack(np.frombuffer(r["code"], np.uint8).reshape(1, -1), 6))[0] + lists.centroids[r["cell"]] for r in entries.collect()}
    asked = {r["rep"]: lists.whole(np.array(r["embedding"], float)) for r in visits.collect()}
    for q, v in asked.items():
        best = sorted((r["distance"], r["id"]) for r in found if r["rep"] == q)[:7]
        assert best == sorted((float(((v - p) ** 2).sum()), i) for i, p in coded.items())[:7]

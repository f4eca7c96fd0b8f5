"""The store: replays, fresh checkpoints, two writers, older versions."""

import threading

import pytest
from pyspark.sql import functions as F

from tessera.streaming.store import Store, put_stream

SCHEMA = "doc string, n int, seen int"


def _rows(store, version=None):
    return sorted((tuple(r) for r in store.rows(version).collect()), key=str)


def _table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), spark.createDataFrame([], SCHEMA).schema, "doc", buckets=3)


def test_replaces_and_keeps_versions(spark, store):
    assert not store.exists() and _rows(store) == [] and store.versions() == []
    first = store.put(_table(spark, [("a", 1, 1), ("a", 2, 1), (None, 3, 1)]))
    second = store.put(_table(spark, [("a", 4, 2), ("b", 5, 2)]))
    assert (first, second) == (1, 2)
    assert _rows(store) == sorted([("a", 4, 2), ("b", 5, 2), (None, 3, 1)], key=str)
    assert _rows(store, 1) == sorted([("a", 1, 1), ("a", 2, 1), (None, 3, 1)], key=str)
    store.put(_table(spark, []))
    store.remove(spark.createDataFrame([(None,), ("b",)], "doc string"))
    assert _rows(store) == [("a", 4, 2)]
    store.vacuum(1, grace=0)
    assert _rows(store) == [("a", 4, 2)] and len(store.versions()) == 1
    with pytest.raises(LookupError):
        store.rows(1)
    assert store.clear() == 1 and store.clear() == 0 and not store.exists()
    with pytest.raises(ValueError):
        Store(spark, store.path, spark.createDataFrame([], "doc string, _bucket int").schema, "doc")


def test_batches_of_a_stream_count_once(spark, store):
    store.put(_table(spark, [("a", 1, 1)]), "s", 0)
    store.put(_table(spark, [("a", 2, 2)]), "s", 1)
    assert store.put(_table(spark, [("a", 1, 1)]), "s", 0) == 2
    assert _rows(store) == [("a", 2, 2)]
    # Another stream's numbers are its own.
    store.put(_table(spark, [("c", 3, 3)]), "t", 0)
    assert _rows(store) == [("a", 2, 2), ("c", 3, 3)]


def test_fresh_checkpoint_loses_nothing(spark, tmp_path, store):
    arriving = str(tmp_path / "in")
    ordered = Store(spark, store.path, store.schema, "doc", buckets=3, order="seen")
    for i in range(3):
        _table(spark, [("a", i, i), (None, 10 + i, i), (f"d{i}", i, i)]).coalesce(1).write.mode("append").parquet(arriving)
    expected = sorted([("a", 2, 2), (None, 12, 2), *((f"d{i}", i, i) for i in range(3))], key=str)
    for checkpoint in ("one", "one", "two"):
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(arriving)
        put_stream(source, ordered, str(tmp_path / checkpoint), once=True).awaitTermination()
        assert _rows(ordered) == expected
    ordered.put(_table(spark, [("new", 7, 7)]), "other", 0)
    assert _rows(ordered) == sorted([*expected, ("new", 7, 7)], key=str)


def test_writers_between_read_and_commit(spark, store, monkeypatch):
    """A second writer commits while the first has written and not committed: over other buckets, then over the same."""
    store.put(_table(spark, [(f"d{i}", i, 0) for i in range(20)]))
    names = [f"d{i}" for i in range(20)]
    key = dict(spark.createDataFrame([(n,) for n in names], "doc string").select("doc", F.pmod(F.xxhash64("doc"), F.lit(3))).collect())
    mine = names[0]
    other = next(n for n in names if key[n] != key[mine])
    same = next(n for n in names[1:] if key[n] == key[mine])
    real, waiting = Store._commit, [other, same]

    def interrupted(self, version):
        if waiting:
            name = waiting.pop(0)
            rest, waiting[:] = list(waiting), []
            Store(spark, store.path, store.schema, "doc", buckets=3).put(_table(spark, [(name, 100, 1)]))
            waiting[:] = rest
        return real(self, version)

    monkeypatch.setattr(Store, "_commit", interrupted)
    store.put(_table(spark, [(mine, 200, 1)]))
    monkeypatch.undo()
    expected = {n: (0, i) for i, n in enumerate(names)} | {other: (1, 100), same: (1, 100), mine: (1, 200)}
    assert {r[0]: (r[2], r[1]) for r in _rows(store)} == expected and store.versions() == [1, 2, 3, 4]


def test_writers_at_once(spark, store):
    failed = []

    def write(i):
        try:
            for j in range(2):
                Store(spark, store.path, store.schema, "doc", buckets=3).put(_table(spark, [(f"w{i}-{j}", i, j)]), f"s{i}", j)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed and {r[0] for r in _rows(store)} == {f"w{i}-{j}" for i in range(3) for j in range(2)}

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skylark.operators.analytics import DAY_MS
from skylark.sources import store
from skylark.sources.store import Store


@pytest.fixture
def kept(spark, tmp_path):
    return Store(spark, str(tmp_path / "base"))


def rows(spark, *items):
    return spark.createDataFrame(list(items), "object_id string, name string, n long")


def test_add_get_delete_browse(spark, kept):
    kept.add("i", rows(spark, *[(f"{k:03}", "x", k) for k in range(25)]))
    kept.add("i", rows(spark, ("003", "new", 99)))
    assert kept.get("i", ["003"], ["n"]).collect()[0].asDict() == {"object_id": "003", "n": 99}
    hits, cursor, total = kept.browse("i", None, 10)
    assert (hits.count(), total) == (10, 25)
    seen = [r.object_id for r in hits.collect()]
    while cursor:
        hits, cursor, _ = kept.browse("i", cursor, 10)
        seen += [r.object_id for r in hits.collect()]
    assert seen == [f"{k:03}" for k in range(25)]
    _, cursor, _ = kept.browse("i", None, 10)
    kept.delete_by("i", F.col("n") < 20)
    with pytest.raises(store.CursorExpired):
        kept.browse("i", cursor, 10)
    assert kept.read("i").count() == 6
    (info,) = kept.indexes()
    assert (info["entries"], info["dataSize"] == info["fileSize"]) == (6, True)


def test_batch_folds_changes(spark, kept):
    kept.add("i", rows(spark, ("a", "a", 1), ("b", "b", 2), ("c", "c", 3)))
    changes = spark.createDataFrame(
        [(1, "partialUpdateObject", "a", None, 7), (2, "deleteObject", "b", None, None), (3, "partialUpdateObjectNoCreate", "z",
            "z", 1), (4, "partialUpdateObject", "y", "y", None), (5, "addObject", "b", "b2", None)],
        "seq long, action string, object_id string, name string, n long",
    )
    kept.batch("i", changes)
    assert {tuple(r) for r in kept.read("i").collect()} == {("a", "a", 7), ("b", "b2", None), ("c", "c", 3), ("y", "y", None)}
    kept.batch("i", spark.createDataFrame([(6, "clear", None, None, None), (7, "addObject", "q", "q", 1)], changes.schema))
    assert [r.object_id for r in kept.read("i").collect()] == ["q"]


def test_snapshot_copy_move_compact(spark, kept):
    kept.create("e", "object_id string, name string, n long")
    assert kept.read("e").count() == 0
    kept.add("i", rows(spark, ("a", "a", 1), ("b", "b", 2)))
    data = kept.snapshot("i")
    kept.clear("i")
    assert kept.read("i").count() == 0
    kept.load_snapshot("i", data)
    assert kept.read("i").count() == 2
    kept.move("i", "j")
    assert not kept.exists("i")
    kept.compact("j")
    assert (kept.read("j").count(), len(kept.versions("j"))) == (2, 1)
    with pytest.raises(store.IndexMissing):
        kept.read("i")


def test_retention(spark, tmp_path):
    log = spark.createDataFrame([("p", d * DAY_MS) for d in (0, 95, 100)], "index_name string, timestamp_ms long")
    for index in ("a", "b"):
        for day in ("1970-01-01", "1970-04-05", "1970-04-11", "not-a-day"):
            (tmp_path / index / "searches" / f"date={day}").mkdir(parents=True)
    assert store.enforce_retention(spark, str(tmp_path), dt.date(1970, 4, 11) + dt.timedelta(days=1), 6) == 4
    assert store.enforce_retention(spark, str(tmp_path / "none"), dt.date(1970, 1, 1)) == 0
    store.write_partitioned(log, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("date = DATE'1970-01-01'").count() == 1


def test_snapshot_keys():
    assert store.snapshot_key("i", dt.datetime(2024, 1, 2, 3, 4, 5)) == "snapshots/i/20240102T030405Z.tar.gz"


def test_unfinished_versions_and_claims(spark, kept, tmp_path):
    kept.add("i", rows(spark, ("a", "a", 1)))
    (tmp_path / "base" / "i" / "v=7").mkdir()
    assert kept.versions("i") == [1] and kept.read("i").count() == 1
    assert kept.add("i", rows(spark, ("b", "b", 2))) == 8
    assert [kept._claim("i"), kept._claim("i")] == [9, 10]  # two writers at once
    assert kept.read("i").count() == 2
    with pytest.raises(ValueError):
        kept.snapshot("i", most_bytes=10)
    (tmp_path / "docs.json").write_text('[{"object_id": "c", "name": "c", "n": 3}]')
    kept.add_json("i", str(tmp_path / "docs.json"), "object_id string, name string, n long")
    assert kept.get("i", ["c"]).first().n == 3


def test_folds_of_changes_against_one_by_one(spark):
    import random

    rng = random.Random(4)
    kinds = ["addObject", "partialUpdateObject", "partialUpdateObjectNoCreate", "updateObject", "deleteObject"]
    changes = [(k, rng.choice(kinds), f"{rng.randrange(12)}", rng.choice([None, f"n{k}"]), rng.choice([None, k])) for k in range(150)]
    want = {"0": ("old", 1), "1": ("old", 2)}
    for _, kind, i, name, n in changes:
        if kind in ("addObject", "updateObject"):
            want[i] = (name, n)
        elif kind == "deleteObject":
            want.pop(i, None)
        elif i in want or kind == "partialUpdateObject":
            a, b = want.get(i, (None, None))
            want[i] = (name if name is not None else a, n if n is not None else b)
    docs = rows(spark, ("0", "old", 1), ("1", "old", 2))
    got = store.fold_changes(docs, spark.createDataFrame(changes, "seq long, action string, object_id string, name string, n long"))
    assert {r.object_id: (r.name, r.n) for r in got.collect()} == want


def test_snapshots_cursors_and_analytics(spark, tmp_path):
    snaps = store.Snapshots(spark, str(tmp_path))
    keys = [snaps.put("i", bytes([k]), dt.datetime(2024, 1, k + 1)) for k in range(4)]
    assert snaps.list("i") == keys and snaps.latest("i") == keys[-1] and snaps.get(keys[2]) == b"\x02" and snaps.latest("none") is None
    assert snaps.enforce_retention("i", 3) == 1 and snaps.list("i") == keys[1:] and snaps.enforce_retention("i", 9) == 0
    cursors, log = store.Cursors(spark, str(tmp_path / "peers")), spark.range(1, 11).withColumnRenamed("id", "seq")
    for n in (3, 10, 7):
        cursors.acknowledge("a", n)
    cursors.acknowledge("b", 4)
    assert cursors.pending(log, "a").count() == 0 and cursors.pending(log, "b").count() == 6 and cursors.pending(log, "c").count() == 10
    assert cursors.settled(["a", "b"]) == 4 and cursors.settled(["a", "c"]) == 0
    root = str(tmp_path / "analytics")
    searches = spark.createDataFrame([("p", d * DAY_MS) for d in (0, 95, 100)] + [("q", 0)], "index_name string, timestamp_ms long")
    assert store.flush(searches, root, disabled=True) == {"status": "disabled"} and store.flush(searches, root) == {"status": "ok"}
    assert store.clear_analytics(spark, root, "p") == 3 and spark.read.parquet(root).count() == 1 and store.clear_analytics(spark,
        root, "p") == 0

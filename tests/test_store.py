import json

import pytest
from pyspark.sql import functions as F

from loamlog.functions.tokens import Tokenizer
from loamlog.migrations import Registry
from loamlog.sources.files import BackupError, read_backup
from loamlog.store import ConflictError, EntityStore, ScanForbidden


@pytest.fixture
def store(spark, tmp_path):
    s = EntityStore(spark, str(tmp_path / "store"))
    s.create_collection("notes")
    return s


def note(title, **more):
    return json.dumps({"title": title, **more})


def test_snapshots_and_history(store):
    a = store.put("notes", "1", note("first"))
    b = store.put("notes", "1", note("second"))
    c = store.delete("notes", "1")
    assert (a, b, c) == (1, 2, 3)
    assert json.loads(store.get("notes", "1", as_of=a))["title"] == "first"
    assert store.get("notes", "1") is None and not store.exists("notes", "1")
    store.put("notes", "1", note("again"))
    assert [r["change_type"] for r in store.changes().collect()] == ["insert", "update", "delete", "insert"]
    assert store.count("notes") == 1 and store.entity_count() == 1
    assert store.history("notes", "1").count() == 4
    assert [r["sequence"] for r in store.changes(1, 2).collect()] == [2, 3]


def test_transaction_is_whole_or_not(store):
    with pytest.raises(ValueError), store.transaction() as t:
        t.put("notes", "1", note("x"))
        raise ValueError
    assert store.committed_sequence == 0
    with store.transaction() as t:
        t.put("notes", "1", note("x"))
        t.put("notes", "2", note("y"))
        assert t.get("notes", "1") == note("x")
        t.delete("notes", "2")
        assert t.get("notes", "2") is None
    assert [r["entity_id"] for r in store.scan("notes").collect()] == ["1"]


def test_conflict(store):
    store.put("notes", "1", note("a"))
    t, blind = store.begin(), store.begin()
    assert t.get("notes", "1") == note("a")
    t.put("notes", "1", note("b"))
    store.put("notes", "1", note("c"))
    with pytest.raises(ConflictError):
        t.commit()
    blind.put("notes", "1", note("d"))
    blind.commit()
    assert store.get("notes", "1") == note("d")
    gone = store.begin()
    assert gone.get("notes", "9") is None
    gone.put("notes", "9", note("z"))
    store.put("notes", "9", note("other"))
    with pytest.raises(ConflictError):
        gone.commit()


def test_unmarked_commit_is_not_seen(store, spark):
    store.put("notes", "1", note("a"))
    store.records().withColumn("sequence", F.lit(2).cast("long")).write.parquet(f"{store.path}/records/commit=2-lost")
    assert store.records().count() == 1 and store.put("notes", "2", note("b")) == 2


def test_indexes(store):
    store.create_index("notes", "size", "btree")
    store.create_index("notes", "title", "hash", unique=True)
    with store.transaction() as t:
        for i in range(6):
            t.put("notes", str(i), note(f"t{i}", size=i - 2))
        t.put("notes", "n", json.dumps({"title": "nothing", "size": None}))
        t.put("notes", "m", json.dumps({"title": "missing"}))
        t.put("notes", "x", "not json")
    assert [r[0] for r in store.lookup_range("notes", "size", -1, 2, "long").select("entity_id").collect()] == ["1", "2", "3", "4"]
    assert [r[0] for r in store.lookup("notes", "size", None).collect()] == ["n"]
    assert [r[0] for r in store.lookup("notes", "title", "t3").collect()] == ["3"]
    with pytest.raises(ConflictError):
        store.put("notes", "7", note("t3"))
    assert store.count("notes") == 9
    assert store.drop_index("notes", "title", "hash") and not store.drop_index("notes", "title", "hash")
    with pytest.raises(KeyError):
        store.lookup("notes", "title", "t3")
    assert EntityStore(store.spark, store.path)._indexes == store._indexes


def test_search(store):
    store.create_search_index("notes", "title", Tokenizer(min_length=2))
    store.put("notes", "1", note("Red apple"))
    store.put("notes", "2", note("green apples, red"))
    ids = lambda x: {r[0] for r in x.collect()}
    assert ids(store.search("notes", "title", "RED")) == {"1", "2"}
    assert ids(store.search("notes", "title", "red apple")) == {"1"}
    assert ids(store.search_any("notes", "title", "green blue")) == {"2"}
    assert ids(store.search_prefix("notes", "title", "app")) == {"1", "2"}
    store.put("notes", "1", note("blue"))
    assert ids(store.search("notes", "title", "red")) == {"2"}


def test_compact_backup_restore(store, spark, tmp_path):
    for i in range(3):
        store.put("notes", "1", note(f"v{i}"))
    store.put("notes", "2", note("x"))
    store.delete("notes", "2")
    path = str(tmp_path / "backup")
    assert store.backup(path, tombstones=False)["rows"] == 1 and store.valid_backup(path)
    assert store.compact() == 5
    assert store.records().count() == 1 and store.get("notes", "1") == note("v2")
    store.put("notes", "1", note("later"))
    store.put("notes", "3", note("kept"))
    store.restore(path)
    assert store.get("notes", "1") == note("v2") and store.get("notes", "3") == note("kept")
    read_backup(spark, path).limit(0).write.mode("append").parquet(f"{path}/records")
    assert store.valid_backup(path)
    read_backup(spark, path).write.mode("append").parquet(f"{path}/records")
    assert not store.valid_backup(path)
    with pytest.raises(BackupError):
        store.restore(path)
    with pytest.raises(BackupError):
        read_backup(spark, str(tmp_path / "none"))


def test_frames_and_policies(store, spark):
    with store.transaction() as t:
        t.put_frame("notes", spark.range(50).select(F.col("id").alias("entity_id"), F.lit("{}").alias("payload")))
        t.put("notes", "7", note("own"))
    assert store.count("notes") == 50 and store.get("notes", "7") == note("own")
    with pytest.raises(ScanForbidden):
        EntityStore(spark, store.path, "forbid").scan("notes")
    assert store.inspect().first()["records"] == 50


def test_migrations(store):
    done, r = [], Registry()
    r.register(1, "one", lambda s: s.create_collection("extra"))
    r.register(2, "two", lambda s: done.append(2))
    with pytest.raises(ValueError):
        r.register(2, "again", print)
    assert r.run(store) == [1, 2] and store.schema_version == 2 and r.run(store) == []
    assert store.get_collection("extra") == 2 and store.get_collection("nothing") is None
    r.register(4, "hole", print)
    with pytest.raises(ValueError):
        r.validate()

    def fails(s):
        raise RuntimeError

    r.register(3, "fails", fails)
    with pytest.raises(RuntimeError):
        r.run(store)
    assert store.schema_version == 2


def test_commit_in_between_is_not_overwritten(store, monkeypatch):
    store.put("notes", "1", note("a"))
    t = store.begin()
    t.get("notes", "1")
    t.put("notes", "1", note("mine"))
    check = store._check

    def late(x):
        monkeypatch.setattr(store, "_check", check)
        check(x)
        EntityStore(store.spark, store.path).put("notes", "1", note("theirs"))

    monkeypatch.setattr(store, "_check", late)
    with pytest.raises(FileExistsError):
        t.commit()
    assert store.get("notes", "1") == note("theirs")


def test_interrupted_compaction_brings_nothing_back(store, monkeypatch):
    store.put("notes", "1", note("a"))
    store.delete("notes", "1")
    store.put("notes", "2", note("b"))

    def stop(name):
        raise KeyboardInterrupt

    monkeypatch.setattr(store.files, "delete", stop)
    with pytest.raises(KeyboardInterrupt):
        store.compact()
    again = EntityStore(store.spark, store.path)
    assert [r["entity_id"] for r in again.scan("notes").collect()] == ["2"] and again.committed_sequence == 3
    assert again.put("notes", "3", note("c")) == 4 and again.count("notes") == 2


def test_interrupted_change_of_metadata(store, monkeypatch):
    def stop(name):
        raise KeyboardInterrupt

    monkeypatch.setattr(store.files, "delete", stop)
    with pytest.raises(KeyboardInterrupt):
        store.create_collection("more")
    assert EntityStore(store.spark, store.path).collections() == {"notes": 1, "more": 2}


def test_more_reads(store):
    for i in range(4):
        store.put("notes", str(i), note(f"t{i}"))
    assert sorted(r["entity_id"] for r in store.iterate("notes")) == ["0", "1", "2", "3"]
    assert store.scan_with_limit("notes", 2).count() == 2 and store.commit_records(3).first()["entity_id"] == "2"
    assert store.snapshot_stats()["entity_count"] == 4

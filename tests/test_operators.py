"""Edge cases of the operators, on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from loamlog.functions import crypto
from loamlog.functions.tokens import Tokenizer
from loamlog.operators import access, conflicts, log, search, sync
from loamlog.streaming import feed

LOG = "collection_id long, entity_id long, sequence long, is_tombstone boolean, payload string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_log_against_a_plain_model(spark):
    rng = random.Random(4)
    rows = [(1, rng.randrange(12), s, rng.random() < 0.3, f"p{s}") for s in range(1, 200)]
    df = spark.createDataFrame(rows, LOG)
    for at in (0, 1, 57, 199, 500):
        state, changes = {}, {}
        for c, e, s, gone, p in rows:
            if s > at:
                break
            changes[s] = "delete" if gone else "update" if state.get(e, (0, 0, True, 0))[2] is False else "insert"
            state[e] = (c, s, gone, p)
        live = sorted((c, e, s, gone, p) for e, (c, s, gone, p) in state.items() if not gone)
        assert rows_of(log.scan(df, at)) == live
        got = log.classify_changes(df.filter(F.col("sequence") <= at)).select("sequence", "change_type")
        assert dict(rows_of(got)) == changes


def test_compaction_bounds(spark):
    df = spark.createDataFrame([(1, 1, 90, True, None), (1, 2, 91, True, None), (1, 3, 5, False, "x")], LOG)
    keep = lambda n: {r[1] for r in rows_of(log.compact(df, True, n, 100).drop("payload"))}
    assert keep(10) == {2, 3}  # exactly as old as the retention goes
    assert keep(0) == {3}
    assert keep(1000) == {1, 2, 3}
    assert log.compaction_stats(df.limit(0), F.octet_length("payload")).first().asDict()["output_records"] == 0


def test_ranges(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, None), (5, -1)], "id long, k long")
    ids = lambda x: {r["id"] for r in x.collect()}
    assert ids(access.between(df, "k", 5, 5)) == {1, 2}
    assert ids(access.between(df, "k", 7, 5)) == set()
    assert ids(access.between(df, "k")) == {1, 2, 3, 5}
    assert ids(access.equal(df, "k", None)) == {4}
    assert ids(access.greater_than(df, "k", 5)) == {3}
    assert rows_of(access.take(df, "k", "id", 0)) == []
    assert rows_of(access.take_last(df, "k", "id", 2)) == [(5, 2), (7, 3)]
    assert rows_of(access.take(df, "k", "id", 99)) == [(-1, 5), (5, 1), (5, 2), (7, 3)]
    assert access.contains(df, "k", 7) and not access.contains(df, "k", 8)


def test_materialised_order(spark, tmp_path):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000)
    access.materialise(df, "k", str(tmp_path / "b"), "btree", 4)
    access.materialise(df, "k", str(tmp_path / "h"), "hash", 4)
    for kind in "bh":
        assert access.between(spark.read.parquet(str(tmp_path / kind)), "k", 10, 19).count() == 10


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("", []), ("  \t\n", []), ("!?.,", []), ("a_b-c", ["a", "b", "c"]), ("x y　z", ["x", "y", "z"]),
     ("“q”", ["“q”"]), ("É É é", ["é", "é", "é"]), ("a" * 257 + " ok", ["ok"]), ("a" * 256, ["a" * 256])],
)
def test_tokens(spark, text, tokens):
    t = Tokenizer()
    got = spark.createDataFrame([(text,)], "t string").select(t.tokens(F.col("t"))).first()[0]
    assert got == tokens == t.of(text)


def test_search(spark):
    df = spark.createDataFrame([(1, "The cat sat"), (2, "cat"), (3, None), (4, "Dog, cat; THE end")], "id long, t string")
    post = search.postings(df, "id", "t")
    ids = lambda x: {r[0] for r in x.collect()}
    assert ids(search.search_all(post, "the CAT cat")) == {1, 4}
    assert ids(search.search_all(post, " ,")) == ids(search.search_any(post, "")) == set()
    assert ids(search.search_any(post, "dog sat")) == {1, 4}
    assert ids(search.search_prefix(post, "")) == {1, 2, 4}
    assert ids(search.search_prefix(post, "CA")) == {1, 2, 4}
    assert ids(search.search_token(post, "the cat")) == set()
    assert search.search_stats(df, post).first()["entities"] == 4


def test_search_lists(spark, tmp_path):
    """Lists have a row for each entity, and what reads them shuffles no postings."""
    df = spark.createDataFrame([(1, "b a b"), (2, None), (1, "A c"), (None, "a"), (None, "d")], "id long, t string")
    lists = search.write_lists(search.token_lists(df, "id", "t"), str(tmp_path / "lists"))
    assert sorted((str(r[0]), sorted(r[1])) for r in lists.collect()) == [("1", ["a", "b", "c"]), ("2", []), ("None", ["a", "d"])]
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    made = plan(search.token_lists(df, "id", "t"))
    assert made.count("Exchange ") == 1 and "rangepartitioning" not in made
    assert "Exchange " not in plan(search.tokens_of(lists))
    wanted = spark.createDataFrame([(7, "a"), (7, "d"), (8, "a"), (9, "a"), (9, "zz")], "item_id long, token string")
    got = sorted((r[0], str(r[1])) for r in search.search_all_batch(lists, wanted).collect())
    assert got == [(7, "None"), (8, "1"), (8, "None")]


def test_conflicts(spark):
    staged = spark.createDataFrame(
        [(1, True, "a"), (2, True, "a"), (3, True, "a"), (4, True, None), (5, True, None), (6, False, None)],
        "entity_id long, was_read boolean, expected_hash string")
    now = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c"), (6, "z")], "entity_id long, current_hash string")
    got = {r["entity_id"]: r["conflict"] for r in conflicts.detect(staged, now).collect()}
    assert got == {1: None, 2: "changed", 3: "deleted", 4: "created", 5: None, 6: None}


def test_push_same_entity_twice(spark):
    ops = spark.createDataFrame([(1, 7, 5), (2, 7, 6), (3, 8, 4), (4, 9, 1)], "op_id long, entity_id long, sequence long")
    server = spark.createDataFrame([(8, 4), (7, 2)], "entity_id long, server_sequence long")
    got = {r["op_id"]: (r["accepted"], r["new_sequence"]) for r in sync.push(ops, server, 100).collect()}
    assert got == {1: (True, 100), 2: (False, None), 3: (False, None), 4: (True, 101)}
    assert sync.push(ops.limit(0), server, 1).count() == 0


def test_push_of_a_sequence_from_the_next_on(spark):
    """A sequence that the server hasn't given yet is above the server's like any other."""
    ops = spark.createDataFrame([(1, 7, 100), (2, 7, 300), (3, 8, 250)], "op_id long, entity_id long, sequence long")
    server = spark.createDataFrame([(7, 2)], "entity_id long, server_sequence long")
    got = {r["op_id"]: (r["accepted"], r["new_sequence"], r["reason"]) for r in sync.push(ops, server, 100).collect()}
    assert got == {1: (True, 100, None), 2: (False, None, "older"), 3: (True, 101, None)}


def test_pages_hold_whole_commits(spark):
    ops = spark.createDataFrame([(s, e) for s in (1, 2, 3) for e in (1, 2)], "sequence long, entity_id long")
    assert sync.pull(ops, 0, 3).count() == 4
    assert sync.pull(ops, 3, 3).count() == 0
    assert sync.has_more(ops, 0, 6).first()[0] is False and sync.has_more(ops, 0, 5).first()[0] is True
    assert sync.new_cursor(sync.pull(ops, 3, 3), 3).first()[0] == 3


def test_apply_twice(spark):
    local = spark.createDataFrame([(1, 1, False, "a"), (2, 1, False, "b")], "entity_id long, sequence long, is_tombstone boolean, payload string")
    ops = spark.createDataFrame([(1, 2, "put", None), (2, 3, "delete", None), (3, 4, "put", "n")], "entity_id long, sequence long, op_type string, payload string")
    once = sync.apply_remote(local, ops)
    assert rows_of(once.fillna("-")) == [(1, 1, False, "a"), (2, 3, True, "-"), (3, 4, False, "n")]
    assert rows_of(sync.apply_remote(once, ops).fillna("-")) == rows_of(once.fillna("-"))


def test_retention(spark):
    df = spark.range(1, 200_001).select(F.col("id").alias("sequence"))
    assert feed.retain(df, 70_000).agg(F.min("sequence"), F.count("*")).first()[:] == (130_001, 70_000)
    assert feed.retain(df, 0).count() == 0
    assert feed.retain(df, 10**9).count() == 200_000
    assert feed.latest_sequence(df.limit(0)).first()[0] == 0


def test_encryption(spark):
    key = crypto.derive_key("password", b"salt")
    assert len(key) == 32 and key != crypto.derive_key("password", b"pepper")
    df = spark.createDataFrame([("secret",), ("",), (None,)], "t string").withColumn("e", crypto.encrypt(F.col("t"), key, b"x"))
    texts = [r[0] for r in df.select(crypto.decrypt(F.col("e"), key, b"x").cast("string")).collect()]
    assert texts == ["secret", "", None]
    assert df.filter(crypto.decrypt(F.col("e"), key, b"y").isNotNull()).count() == 0
    assert spark.range(1).select(crypto.crc32(F.lit("123456789"))).first()[0] == 0xCBF43926


def test_order_over_many_partitions(spark):
    rng = random.Random(7)
    rows = [(1, 1 if rng.random() < 0.5 else rng.randrange(9), s, rng.random() < 0.3, None) for s in range(3000)]
    df = spark.createDataFrame(rows, LOG).repartition(6)
    kinds = lambda spread: rows_of(log.classify_changes(df, spread=spread).select("sequence", "change_type"))
    assert kinds(True) == kinds(False)
    got = access.ranked(df.select("sequence"), [F.desc("sequence")]).collect()
    assert {r["sequence"]: r["rank"] for r in got} == {s: 3000 - s for s in range(3000)}

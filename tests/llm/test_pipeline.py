"""The pipeline against plain versions of its stages."""

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from loamlog.llm import mixing, quality
from loamlog.llm.common import word_bytes
from tests.llm.test_operators import SMALL, plain_hits, plain_similarity, plain_targets, plain_tokens


def test_run(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    scores = model.of_texts(pa.array([t for _, t, _ in rows]))
    rows = [r for r, s in zip(rows, scores) if s >= 0.5]

    parent = {i: i for i, _, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [(i, t, word_bytes(t), {tuple(word_bytes(t)[k : k + 5]) for k in range(max(len(word_bytes(t)) - 4, 1))}) for i, t, _ in rows]
    for k, (i, a, w, s) in enumerate(bags):
        for j, b, v, u in bags[:k]:
            if w and v and len(s & u) >= 0.5 * max(len(s), len(u)) and plain_similarity(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    rows = [r for r in rows if find(r[0]) == r[0]]

    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    hits = {i: plain_hits(t, items, 13) for i, t, _ in rows}
    rows = [r for r in rows if not (hits[r[0]][1] and 20 * hits[r[0]][1] >= hits[r[0]][0])]

    size = {i: len(t.split()) for i, t, _ in rows}
    sources = {}
    for i, _, s in rows:
        sources[s] = sources.get(s, 0) + size[i]
    target = plain_targets(sources)
    start = {r["s"]: r["o"] for r in spark.createDataFrame([(s,) for s in sources], "s string").select("s", mixing.offset_of(F.col("s")).alias("o")).collect()}
    mixed = []
    for s in sources:
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: (size[r[0]], r[0]))
        each = target[s] / sources[s]
        for k, r in enumerate(mine):
            mixed += [r] * (int((k + 1) * each + start[s]) - int(k * each + start[s]))
    want = plain_tokens(sorted((i, t) for i, t, _ in mixed))

    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == sorted(want) and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_random_is_not_used_between_runs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    random.seed()
    one, two = (sorted(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, SMALL).collect()) for _ in range(2))
    assert one == two

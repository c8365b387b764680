"""A quality classifier that learns from preference pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Labelled documents that the model is fitted on, at most: a sample by hash of the id.
MAX_LABELLED = 20_000
#: Preference pairs drawn from them.
PAIRS = 20_000
#: Cuts between the steps of a feature.
BINS = 12
L2 = 1e-4
STEPS = 200

#: Measures of a text, in the order of `features`.
FEATURES = ["words", "characters", "word_length", "symbols", "digits", "capitals", "stops", "repeats", "distinct",
            "lines", "bars", "other"]


_STOPS, _SYMBOLS = b".!?", b"\"#$%&()*+/<=>@[\\]^_`{|}~"


def features(text: str | None) -> list[float]:
    """Measures of the whole text; null and empty texts have all of them."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype="uint8")
    count = np.bincount(raw, minlength=256)
    words = text.split()
    chars, n = len(text), len(words)
    each, some = max(chars, 1), max(n, 1)
    # Capitals: A-Z, and those of Latin-1, which are 0xC3 and one of 0x80 to 0x9E.
    latin = np.count_nonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) if count[0xC3] else 0
    return [
        np.log1p(n),
        np.log1p(chars),
        chars / some,
        count[list(_SYMBOLS)].sum() / each,
        count[0x30:0x3A].sum() / each,
        (count[0x41:0x5B].sum() + latin) / each,
        count[list(_STOPS)].sum() / some,
        sum(map(eq, words, words[1:])) / some,
        len(set(words)) / some,
        np.log1p(count[10]),
        count[0x7C] / some,
        count[0x80:].sum() / max(len(raw), 1),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t.as_py()) for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "x"]
        )


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Ranking:
    """cuts: for each feature its inner quantiles; a step per cut passed, and the feature itself, have a weight.
    threshold: the quantile of sample scores below which the share of label 0 lies. scale: of a score's distance
    from it, before the logistic function."""

    cuts: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def design(self, x: np.ndarray) -> np.ndarray:
        steps = (x[:, :, None] > self.cuts[None]).reshape(len(x), -1)
        return np.hstack([np.clip((x - self.centre) / self.spread, -8, 8), steps])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; 0.5 at the threshold."""
        return 1.0 / (1.0 + np.exp(np.clip((self.threshold - self.raw(x)) * self.scale, -500, 500)))

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        x = np.array([features(t.as_py()) for t in texts], dtype="float64").reshape(-1, len(FEATURES))
        return self.scores(x)


def fit_ranking(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Ranking:
    """Bradley-Terry: P(a is preferred to b) = logistic(s(a) - s(b)), with a linear score s, fitted by logistic
    loss on the differences of pairs of a document of label 1 and one of label 0."""
    rng = np.random.default_rng(seed)
    if not len(x):
        x, y = np.zeros((1, len(FEATURES))), np.array([1])
    cuts = np.quantile(x, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    model = Ranking(cuts, x.mean(axis=0), x.std(axis=0) + 1e-9, np.zeros(0), 0.0, 1.0)
    d = model.design(x)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):  # one class or none: nothing to rank by
        model.weights = np.zeros(d.shape[1])
        model.threshold = 1.0 if len(bad) else -1.0
        return model
    diff = d[rng.choice(good, PAIRS)] - d[rng.choice(bad, PAIRS)]
    w, speed, rate = np.zeros(d.shape[1]), np.zeros(d.shape[1]), 0.5
    for _ in range(STEPS):
        grad = -(diff.T @ (1.0 / (1.0 + np.exp(np.clip(diff @ w, -30, 30))))) / len(diff) + L2 * w
        speed = 0.9 * speed - rate * grad / (1 + np.abs(grad).max())
        w = w + speed
    model.weights = w
    s = d @ w
    # The threshold: the quantile of scores at the share of label 0; half way to the next score above.
    ranked = np.sort(s)
    k = min(max(int(round(len(bad) / len(y) * len(y))), 1), len(y) - 1)
    model.threshold = float((ranked[k - 1] + ranked[k]) / 2)
    model.scale = float(4.0 / (np.std(s) + 1e-9))
    return model


def learn(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "quality",
) -> Ranking:
    """Fits the ranking on labelled documents that are not held out.

    Of those, at most max_labelled are used, by the hash of their ids; only their measures (a dozen numbers a
    document) come to the driver. Labels other than 0 and 1, null ids and ids with both labels are left out.
    """
    small_batches(docs.sparkSession)
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z"))
        .filter(F.col("_y") == F.col("_z"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    )
    chosen = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
        .join(F.broadcast(known), "_id")  # at most max_labelled rows
        .select("_y", "_id", "_t")
    )
    kind = chosen.schema["_id"].dataType.simpleString()
    rows = chosen.mapInArrow(_measured, f"_y int, _id {kind}, x array<double>").orderBy("_id", "x")
    rows = rows.limit(max_labelled).toPandas()
    x = np.array(rows["x"].tolist(), dtype="float64").reshape(-1, len(FEATURES))
    return fit_ranking(x, rows["_y"].to_numpy())


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.of_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return run


def _acceptor(model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.of_texts(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array(scores >= 0.5))

    return run


def score_documents(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    score rises with the ranking's score and is 0.5 at its threshold. Labels, language, source and id take no
    part in it. Null and empty texts are scored by their measures, which exist for them. Repeated rows give
    repeated rows; a null doc_id isn't held out. An empty table gives an empty result; with no labels of one of
    the classes every score is on the side of the other. Other columns are neither read nor returned.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    run = _scorer(docs.sparkSession.sparkContext.broadcast(model))
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted_documents(docs: DataFrame, model: Ranking, text_col: str = "text") -> DataFrame:
    """docs without those that the model rejects, with all their columns."""
    small_batches(docs.sparkSession)
    run = _acceptor(docs.sparkSession.sparkContext.broadcast(model), text_col)
    return docs.mapInArrow(run, docs.schema)

"""What the corpus operators share: words, column names, joins by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import global_prefix
from ..sources.files import free, scratch_path, write_table

__all__ = [
    "cut_spans", "free", "free_name", "global_prefix", "join_rows", "scratch_path", "small_batches", "without_words", "word_bytes",
    "write_table",
]

#: Runs of characters between words: ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of a UTF-8 text as words see them: A-Z lowered, ASCII other than letters and digits blank.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def word_bytes(text: str | None) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


#: Rows that tasks pass to Python at a time, at most: texts can be long, and a worker holds a batch twice.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without some of its words, spans [start, end) of them: from the first's first byte to the last's last."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(WORD_BYTES), dtype="uint8") != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype("int8")))
    starts, stops = edges[::2], edges[1::2]
    out, at = [], 0
    for s, e in sorted(spans):
        begin, end = max(int(starts[s]), at), int(stops[e - 1])
        if end > begin:
            out.append(raw[at:begin])
            at = end
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def cut_spans(text_col: str, spans_col: str):
    """For mapInArrow: texts without the spans that a column lists as pairs; that column goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, by = batch.schema.get_field_index(text_col), batch.schema.get_field_index(spans_col)
            texts = [
                without_words(t.as_py(), [tuple(x.values()) for x in s.as_py()]) if s.is_valid and len(s) else t.as_py()
                for t, s in zip(batch.column(at), batch.column(by), strict=True)
            ]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            keep = [i for i in range(batch.num_columns) if i != by]
            yield batch.select(keep)

    return run


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bytes that are broadcast at most, as counted before; more are joined by a shuffle. A row counts as ROW_BYTES.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 32


def join_rows(
    rows: DataFrame, wanted: DataFrame, on: str, more: Column | None = None, how: str = "inner",
    most: int = BROADCAST_BYTES,
) -> DataFrame:
    """rows joined to wanted by a short key; wanted is broadcast if it is small, which is counted before. more: bytes
    of a row of wanted besides ROW_BYTES. most: bytes that are broadcast at most."""
    size = F.lit(ROW_BYTES).cast("long") + (more if more is not None else F.lit(0))
    few = (wanted.agg(F.sum(size)).first()[0] or 0) <= most
    return rows.join(F.broadcast(wanted) if few else wanted, on, how)

"""Token counts of sections, from one encoding of the whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .token_files import default_tokenizer
from .tokenizing import chunks, encoder, token_bytes

#: To which section a token belongs that stands in several: the one with most of its bytes, of equals the first;
#: or that of its first or last byte.
RULES = ("largest", "first", "last")


def line_ends(text: bytes) -> np.ndarray:
    """Where each line of a text ends, its line feed included; an empty text has no line."""
    ends = np.flatnonzero(np.frombuffer(text, dtype="uint8") == 10) + 1
    return ends if len(text) == 0 or (len(ends) and ends[-1] == len(text)) else np.append(ends, len(text))


def attribute(lengths: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many stand in several.

    lengths: bytes of each token in turn; ends: ends of sections that follow each other from 0 to the end, some
    perhaps empty. Both are intervals on one line in order, so two searches join them.
    """
    n = len(ends)
    if not n:
        return np.zeros(0, dtype="int64"), 0
    stop = np.cumsum(lengths)
    start = stop - lengths
    first = np.searchsorted(ends, start, side="right")
    last = np.searchsorted(ends, np.maximum(stop - 1, start), side="right")
    crossing = np.flatnonzero(last > first)
    owner = first.copy()
    if rule == "last":
        owner = last
    elif rule == "largest":
        for t in crossing.tolist():
            k = np.arange(first[t], last[t] + 1)
            left = np.maximum(start[t], np.where(k > 0, ends[k - 1], 0))
            owner[t] = k[np.argmax(np.minimum(stop[t], ends[k]) - left)]
    return np.bincount(owner, minlength=n), len(crossing)


def _counter(path: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = encoder(path).lists, token_bytes(path)
        for batch in chunks(batches, 1):
            totals, crossings, lists = [], [], []
            encoded = encode(batch.column(1))
            values, starts = encoded.values.to_numpy(), encoded.offsets.to_numpy()
            for k, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                raw = text.encode("utf-8", "surrogatepass")
                ends = line_ends(raw)
                if batch.num_columns == 3:
                    given = batch.column(2)[k].as_py()
                    ends = np.cumsum([len((x or "").encode("utf-8", "surrogatepass")) for x in given], dtype="int64")
                ids = values[starts[k] : starts[k + 1]]
                counts, crossing = attribute(sizes[ids], ends, rule)
                totals.append(len(ids))
                crossings.append(crossing)
                lists.append(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array([len(x) for x in lists], pa.int64()),
                 pa.array(crossings, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                names=["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
            )

    return run


def _counted(rows: DataFrame, tokenizer: str | None, rule: str) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _counter(tokenizer or default_tokenizer(), rule),
        f"doc_id {kind}, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>",
    )


def line_token_counts(
    docs: DataFrame, tokenizer: str | None = None, rule: str = "largest", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_sections, n_crossing, section_tokens (tokens of each line).

    A document is encoded once, as a whole; its tokens' byte spans are joined to the spans of its lines, each
    with its line feed. A token in several lines counts once, by `rule`, so section_tokens add up to n_tokens.

    Nulls: a null text is empty, with no token and no line; a null doc_id is returned as such. Very long texts are
    encoded whole. Repeated rows give repeated rows. An empty table gives an empty result. Other columns are
    neither read nor returned.
    """
    return _counted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), tokenizer, rule)


def field_token_counts(
    docs: DataFrame, fields: list[str], tokenizer: str | None = None, rule: str = "largest", id_col: str = "doc_id"
) -> DataFrame:
    """The same for a document made of several text columns, put together as they are; null fields are empty."""
    parts = F.array(*[F.coalesce(F.col(f), F.lit("")) for f in fields])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.concat(*[F.coalesce(F.col(f), F.lit("")) for f in fields])
                       .alias("text"), parts.alias("parts"))
    return _counted(rows, tokenizer, rule)

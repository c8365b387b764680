"""Token ids as Parquet list columns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_prefix, scratch_path, small_batches, write_table
from .tokenizing import chunks, encoder

END_ID = 2
#: Bytes of a row group before encoding, of a page, and of a dictionary: one row group's ids fit a dictionary.
ROW_GROUP, PAGE, DICTIONARY = 32 << 20, 1 << 20, 2 << 20
#: Documents of a file at most.
FILE_ROWS = 500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = encoder(path).lists
        for batch in chunks(batches, 1):
            ids = lists(batch.column(1), end_id)
            ends, start = ids.offsets.to_numpy(), 0
            while start < batch.num_rows:  # pieces of some MB
                stop = max(int(np.searchsorted(ends, ends[start] + (1 << 20), side="right")) - 1, start + 1)
                counts = pa.array(np.diff(ends[start : stop + 1]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), counts, ids.slice(start, stop - start)],
                    names=["doc_id", "n_tokens", "ids"],
                )
                start = stop

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id",
    text_col: str = "text", file_rows: int = FILE_ROWS,
) -> None:
    """Writes doc_id, n_tokens and ids (with end_id appended) in ascending doc_id order.

    Files are ranges of doc_id of at most file_rows documents: the part number and then the file's number give their
    order, rows within are sorted. Ids are dictionary encoded where a row group's distinct ids fit the dictionary, and
    delta encoded otherwise (version 2 pages); row groups are bounded, and pages have column and offset indexes, so
    that reading some documents, or counts alone, touches little else. Texts are shuffled and not ids, which are
    larger.

    Nulls: a null text is encoded as empty and has the end id alone; null doc_ids come first. Very long texts are
    one list. Ties and repeated rows stay, in an order fixed by a hash of the text. An empty table gives files
    without rows. Other columns are neither read nor written.
    """
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    kind = rows.schema["doc_id"].dataType.simpleString()
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_encode(tokenizer, end_id), f"doc_id {kind}, n_tokens long, ids array<int>")
        .write.option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", 1)
        .option("maxRecordsPerFile", file_rows)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", DICTIONARY)
        .option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE)
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """What was written, with each row's place: part (of the files) and row_index (within its file)."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return spark.read.parquet(path).select(
        "doc_id", "n_tokens", "ids", part.alias("part"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.row_index").alias("row_index"),
    )


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CRC-32 of each list's little-endian 32-bit values."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        keep = [i for i, n in enumerate(batch.schema.names) if n != "ids"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in keep), pa.array(sums, pa.int64())],
            names=[*(batch.schema.names[i] for i in keep), "ids_crc32"],
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document in the files.

    start counts all ids of documents before it: the running sum of n_tokens in order of files and rows, which goes
    on from one partition to the next by their totals. Only counts are shuffled.
    """
    rows = read_token_files(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()
    checked = write_table(
        rows.mapInArrow(
            _check, f"doc_id {kind}, n_tokens long, part long, file string, row_index long, ids_crc32 long"
        ),
        "token-index",
    )
    order = [F.col("part"), F.col("file"), F.col("row_index")]
    placed = global_prefix(checked, [], order, {"start": F.col("n_tokens")}, "token-starts")
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Writes token files (to the shared folder if no path is given) and returns their index."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer)
    return token_index(docs.sparkSession, path)

"""The queries opN_<name>: each corpus operator over its whole table, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, licences, mixing, near_dedup, quality, sharding, substring, token_counts, token_files
from .common import write_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.decontaminate(docs, items).drop("starts", "ends")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.line_token_counts(table(spark, sf_dir, "documents"))


def op5_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        sharding.text_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
    )
    placed = sharding.shard_by_bytes(write_table(docs, "sizes"), ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size")
    )
    mixed = mixing.mix(write_table(docs, "words"), ["doc_id"])
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_quality_ranking": op2_quality_ranking,
        "op3_decontaminate": op3_decontaminate,
        "op4_token_counts": op4_token_counts,
        "op5_shard_bytes": op5_shard_bytes,
        "op6_mix_sources": op6_mix_sources,
        "op7_token_files": op7_token_files,
        "op8_repeated_passages": op8_repeated_passages,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_licence_scan": op10_licence_scan,
    }


_OP1 = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""

_OP3 = r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         CASE WHEN text IS NULL THEN [] ELSE
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size,
         array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT row, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT g.row, g.i, g.size, v.item_id FROM grams g JOIN windows v ON v.size = g.size AND v.gram = g.gram),
hit AS (
  SELECT row, count(DISTINCT p) AS n_hit
  FROM (SELECT row, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT row, i, size FROM found)) GROUP BY row),
named AS (
  SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT row, item_id FROM found) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""

_OP5 = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i:
           CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, n)) AS t),
h AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
l AS (
  SELECT doc_id, size, list_transform(range(1, len(h), 2),
           lambda i: CAST('0x' || substring(h, i, 2) AS BIGINT)) AS l FROM h),
c AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(4294967295, CASE WHEN len(l) = 0 THEN 4294967295 ELSE
           list_reduce(l, lambda c, x: xor(t[xor(c % 256, x) + 1], c // 256), CAST(4294967295 AS BIGINT)) END) AS BIGINT)
           AS crc
  FROM l, tab),
o AS (
  SELECT *, row_number() OVER w AS r, sum(size) OVER w - size AS before, sum(size) OVER () AS total
  FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, crc, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST(least(15, ((before * 2 + size) * 16) // (2 * total)) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""

_OP6 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
         CAST(source_size * 3 AS DOUBLE) AS cap
  FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, n
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, least(cap, max(level) OVER () * w) AS target,
         CAST(('0x' || substr(sha256('17:' || coalesce('s' || source, 'n')), 1, 4)) AS BIGINT) / 65536.0 AS start
  FROM l),
r AS (
  SELECT d.*, t.source_size, t.target, CAST(t.start AS DOUBLE) AS start,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CAST(least(floor((k + 1) * each + start) - floor(k * each + start), 3) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c
"""


def _op10() -> str:
    def canonical(x: str) -> str:
        x = f"regexp_replace(lower({x}), '{licences.COPYRIGHT_LINE}', chr(10), 'g')"
        for old, new in licences.EQUIVALENTS:
            x = f"replace({x}, '{old}', '{new}')"
        return rf"trim(regexp_replace({x}, '{licences.PUNCTUATION}', ' ', 'g'))"

    def text(x: str) -> str:
        return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    known = ",\n".join(f"({text(a)}, {text(b)})" for a, b in licences.KNOWN)
    digests = ",\n".join(f"('{a}', '{b}')" for a, b in licences.KNOWN_DIGESTS)
    return f"""
WITH k AS (
  SELECT licence, sha256({canonical('t')}) AS digest FROM (VALUES {known}) AS v(licence, t)
  UNION SELECT licence, digest FROM (VALUES {digests}) AS w(licence, digest)),
d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, sha256({canonical("coalesce(text, '')")}) AS c
  FROM documents),
u AS (
  SELECT row, sha256({canonical('line')}) AS digest
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) WHERE line <> ''),
f AS (SELECT row, licence, count(*) AS n FROM u JOIN k USING (digest) GROUP BY ALL),
g AS (SELECT row, CAST(sum(n) AS BIGINT) AS n, list(licence) AS s FROM f GROUP BY row),
a AS (SELECT d.*, k.licence AS whole FROM d LEFT JOIN k ON k.digest = d.c)
SELECT doc_id, whole AS whole_text_licence, coalesce(g.n, 0) AS n_notices,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(g.s, []),
         CASE WHEN whole IS NULL THEN [] ELSE [whole] END))), ',') AS licences, c AS canonical_sha256
FROM a LEFT JOIN g USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": _OP1,
        "op3_decontaminate": _OP3,
        "op5_shard_bytes": _OP5,
        "op6_mix_sources": _OP6,
        "op10_licence_scan": _op10(),
    }

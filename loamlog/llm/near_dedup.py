"""Near-duplicates by order min-hash and banded alignment."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free, free_name, join_rows, small_batches, word_bytes, write_table
from .components import components
from .shingles import kmers, labelled, word_hashes

#: Words of a shingle, and the share of shingles that two near-duplicates have in common and in one order.
WORDS = 5
SIMILARITY = 0.8
#: Sketches of a text; each keeps so many least shingles: fewer for short texts, in which one edit touches most.
SKETCHES, LEAST, LEAST_SHORT = 16, 3, 2
#: Texts of up to so many shingles have sketches for short ones, of at least so many the others; between, both.
SHORT, LONG = 20, 16
#: Rounds that compare some texts of each larger bucket; what they leave unconnected is compared by rare shingles.
ROUNDS = 2
#: Texts of a bucket that are all compared with each other; larger buckets go by rounds.
FEW = 6
#: Neighbours that a text is compared with, in a chance order of each of its buckets, from the second round on.
BEFORE = 2
#: Texts of a bucket, or with a shingle, or compared with one text, in one task's part of a join.
SALT_ROWS = 1000

_U = np.uint64
_ODD = np.random.default_rng(20).integers(1, 1 << 63, size=SKETCHES, dtype=np.uint64) * _U(2) + _U(1)


def _tuples(labels: np.ndarray, least: int) -> np.ndarray:
    """One hash for each sketch: its `least` least labels by that sketch's order of them, in order of the text."""
    n = len(labels)
    values = labels[None, :] * _ODD[:, None]
    if n > least:
        places = np.sort(np.argpartition(values, least - 1, axis=1)[:, :least], axis=1)
    else:
        places = np.broadcast_to(np.arange(n), (SKETCHES, n))
    out = _ODD + _U(least)
    for j in range(places.shape[1]):
        out = (out ^ labels[places[:, j]]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return out


def sketch(text: str | None) -> tuple[int, bytes | None, list[int]]:
    """Shingles of a text, a digest of its words, and its bucket keys; a text without words has none of them."""
    words = word_bytes(text)
    if not words:
        return 0, None, []
    labels = labelled(kmers(word_hashes(words), WORDS))
    n, keys = len(labels), []
    if n <= SHORT:
        keys.append(_tuples(labels, LEAST_SHORT))
    if n >= LONG:
        keys.append(_tuples(labels, LEAST))
    return n, hashlib.md5(b" ".join(words)).digest(), np.concatenate(keys).astype("int64").tolist()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [sketch(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
             pa.array([r[2] for r in rows], pa.list_(pa.int64()))],
            names=["row", "n", "digest", "keys"],
        )


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Similarity of two texts by their labelled shingles: those that an alignment matches, over all of both.

    All labels of a text differ, so the best alignment is the longest rising run of matched places. The band:
    two texts that reach `similarity` have at most (1 - similarity) of all their shingles unmatched, and a match
    shifts by no more than these; matches outside can't be part of such an alignment.
    """
    most = min(len(a), len(b))
    if not most or most / max(len(a), len(b)) < similarity:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = (1 - similarity) * (len(a) + len(b)) / (1 + similarity)
    near = np.abs(ia - ib) <= band
    ia, ib = ia[near], ib[near]
    if len(ia) < similarity * (len(a) + len(b)) / (1 + similarity) - 1e-9:
        return 0.0
    ib = ib[np.argsort(ia)]
    if (ib[1:] > ib[:-1]).all():
        length = len(ib)
    else:
        tails: list[int] = []
        for x in ib.tolist():
            k = bisect.bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        length = len(tails)
    return length / (len(a) + len(b) - length)


def _verify(similarity: float):
    """From rows (rep, row, text) sorted by rep, its own text (row null) first: similarity of rep and row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.zeros(0, dtype=_U)
        for batch in batches:
            reps, rows, out = [], [], []
            for rep, row, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                own = labelled(kmers(word_hashes(word_bytes(text.as_py())), WORDS))
                if not row.is_valid:
                    labels = own
                    continue
                reps.append(rep.as_py())
                rows.append(row.as_py())
                out.append(aligned(labels, own, similarity))
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps, pa.int64()), pa.array(rows, pa.int64()), pa.array(out, pa.float64())],
                names=["rep", "row", "similarity"],
            )

    return run


def _links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """rep, row of those pairs whose whole texts are similar.

    A text that many are compared with goes once to each task that has some of them, SALT_ROWS at a time."""
    pairs = write_table(pairs, "pairs")
    ends = write_table(pairs.select(F.col("rep").alias("row")).union(pairs.select("row")).distinct(), "pair-ends")
    held = write_table(join_rows(texts, ends, "row"), "near-texts")
    salts = pairs.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    salts = write_table(salts, "pair-salts")
    own = held.withColumnRenamed("row", "rep").join(salts, "rep").select(
        "rep", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("row"), "text"
    )
    salted = pairs.join(salts, "rep").select(
        "rep", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"), "row"
    )
    both = own.unionByName(salted.join(held, "row").select("rep", "salt", "row", "text"))
    both = both.repartition("rep", "salt").sortWithinPartitions("rep", "salt", F.col("row").asc_nulls_first())
    made = both.select("rep", "row", "text").mapInArrow(_verify(similarity), "rep long, row long, similarity double")
    links = write_table(made.filter(F.col("similarity") >= similarity).select("rep", "row"), "links")
    free(pairs, ends, held, salts)
    return links


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [labelled(kmers(word_hashes(word_bytes(x.as_py())), WORDS)).astype("int64") for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["row", "labels"])


def _sharing(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """rep, row: all pairs of rows (row, component) of two components that can be similar, by rare shingles.

    Of sizes a <= b, two similar texts share at least o = similarity (a + b) / (1 + similarity) shingles. So if each
    text's are put in one order of all, the rarest first, the first that both have is among the first a - o + 1 of
    one and the first b - o + 1 of the other; a shingle of one text alone takes a place but is never joined. Texts
    made from one template so meet by what is their own. A frequent shingle is dealt over many tasks.
    """
    texts = join_rows(texts, rows.select("row"), "row").select("row", "text")
    each = write_table(texts.mapInArrow(_labels, "row long, labels array<long>"), "near-labels").select(
        "row", F.size("labels").alias("n"), F.explode("labels").alias("label")
    )
    often = each.groupBy("label").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    held = each.join(often, "label").groupBy("row", "n").agg(F.sort_array(F.collect_list(F.struct("often", "label"))).alias("_s"))
    # Places from 0, after the shingles that are the text's alone; the most that a text of any size may need.
    first = held.select("row", "n", (F.col("n") - F.size("_s")).alias("alone"), F.posexplode("_s").alias("at", "_e"))
    first = first.select("row", "n", (F.col("alone") + F.col("at")).alias("at"), "_e.often", "_e.label")
    first = first.filter(F.col("at") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-6))
    first = write_table(first.join(rows, "row"), "near-rare")
    # Each pair of components has one that isn't the label's largest: a large one isn't joined with itself.
    by = first.groupBy("label", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("label").agg(
        F.max_by("component", F.struct("size", "component")).alias("main"), F.count(F.lit(1)).alias("several")
    )
    kept = first.join(by.filter("several > 1"), "label").withColumns(
        {"other": F.col("component") != F.col("main"), "salts": F.ceil(F.col("often") / SALT_ROWS).cast("int")}
    )
    kept = write_table(kept.select("label", "row", "n", "at", "component", "other", "salts"), "near-rare")
    least = lambda a, b: F.ceil(similarity * (a + b) / (1 + similarity) - 1e-6)
    short = kept.filter(F.col("at") <= F.col("n") - least(F.col("n"), F.col("n")))
    short = short.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).select(
        "label", "salt", "other", *[F.col(c).alias(f"_{c}") for c in ("row", "n", "at", "component")]
    )
    dealt = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumnRenamed("other", "_other")
    o = least(F.col("n"), F.col("_n"))
    good = (
        (F.col("component") != F.col("_component")) & (F.col("_n") <= F.col("n")) & (F.col("_n") >= similarity * F.col("n"))
        & (F.col("at") <= F.col("n") - o) & (F.col("_at") <= F.col("_n") - o)
    )
    some = [
        short.filter(mine).join(dealt.filter(theirs), ["label", "salt"]).filter(good)
        .select(F.least("row", "_row").alias("rep"), F.greatest("row", "_row").alias("row"))
        for mine, theirs in (("other", "true"), ("not other", "_other"))
    ]
    return some[0].unionByName(some[1]).distinct()


def _merged(placed: DataFrame, links: DataFrame) -> DataFrame:
    """placed (row, component) after links (rep, row): what they connect becomes one component."""
    if not links.limit(1).count():
        return placed
    ends = placed.select(F.col("row").alias("_end"), "component")
    left = links.join(ends, F.col("rep") == F.col("_end")).select("row", F.col("component").alias("a"))
    both = left.join(ends, F.col("row") == F.col("_end")).select("a", F.col("component").alias("b"))
    found = components(both.filter("a <> b").distinct(), "a", "b").withColumnRenamed("component", "_new")
    new = placed.join(found, F.col("component") == F.col("vertex"), "left")
    new = write_table(new.select("row", F.coalesce("_new", "component").alias("component")), "near-placed")
    free(links)
    return new


def _pairs(left: str, right: str, weights: tuple[str, str]):
    """rep, row of two texts: the one that shares more with others, of equals the first, is rep."""
    a, b = (F.struct(F.col(w), -F.col(c)) for w, c in zip(weights, (left, right)))
    return [F.when(a > b, F.col(left)).otherwise(F.col(right)).alias("rep"),
            F.when(a > b, F.col(right)).otherwise(F.col(left)).alias("row")]


def _small(members: DataFrame, similarity: float) -> DataFrame:
    """rep, row: all pairs of buckets of at most FEW texts that can be similar."""
    listed = members.filter(F.col("size") <= FEW).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("weight", (-F.col("row")).alias("r"), "n")), False).alias("l")
    )
    each = listed.select("l", F.posexplode("l").alias("at", "a"))
    pairs = each.select("a", F.explode(F.slice("l", F.col("at") + 2, FEW)).alias("b"))
    fits = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * similarity
    return pairs.filter(fits).select((-F.col("a.r")).alias("rep"), (-F.col("b.r")).alias("row"))


def _to_hubs(members: DataFrame, hubs: DataFrame, similarity: float) -> DataFrame:
    """rep, row: each text of a bucket and the bucket's hub (key, hub, hub_n, hub_weight)."""
    fits = F.least("n", "hub_n") >= F.greatest("n", "hub_n") * similarity
    met = members.join(hubs, "key").filter((F.col("row") != F.col("hub")) & fits)
    return met.select(*_pairs("hub", "row", ("hub_weight", "weight")))


def _hubs(members: DataFrame) -> DataFrame:
    best = F.max(F.struct("weight", (-F.col("row")).alias("r"), "n"))
    return members.groupBy("key").agg(best.alias("_b")).select(
        "key", (-F.col("_b.r")).alias("hub"), F.col("_b.n").alias("hub_n"), F.col("_b.weight").alias("hub_weight")
    )


def _beside(mixed: DataFrame, turn: int, similarity: float) -> DataFrame:
    """rep, row: texts of two components that are neighbours in a chance order of a bucket, dealt over many tasks."""
    chance = F.xxhash64("row", "key", F.lit(turn))
    dealt = mixed.withColumns({"salt": F.pmod(chance, F.ceil(F.col("size") / SALT_ROWS)), "turn": F.xxhash64(chance)})
    order = Window.partitionBy("key", "salt").orderBy("turn", "row")
    one = F.struct("row", "n", "weight", "component")
    near = F.array(*[F.lag(one, k).over(order) for k in range(1, BEFORE + 1)])
    met = dealt.select("row", "n", "weight", "component", near.alias("_near")).withColumn("_o", F.explode("_near"))
    met = met.select("*", *[F.col(f"_o.{c}").alias(f"_{c}") for c in ("row", "n", "weight", "component")])
    fits = F.least("n", "_n") >= F.greatest("n", "_n") * similarity
    return met.filter((F.col("component") != F.col("_component")) & fits).select(*_pairs("row", "_row", ("weight", "_weight")))


def similar_texts(texts: DataFrame, sketches: DataFrame, similarity: float, rounds: int) -> DataFrame:
    """row, component of the texts that share a sketch with others: all that links of at least that similarity
    connect are in one component.

    Texts with a sketch in common make a bucket. All pairs of a small bucket are compared. The texts of a larger one
    are compared with its hub, the text that shares most with others, so that what many were made from comes first;
    then, where a bucket isn't of one component yet, with neighbours in a chance order and with the hub of those that
    the first hub isn't connected with. After the rounds, every pair of a larger bucket that is still of two
    components and can be similar is compared: see _sharing. So comparisons grow with the texts, but for texts that
    share rare shingles and aren't similar.
    """
    keyed = sketches.select("row", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    listed = keyed.join(shared, "key").groupBy("row", "n").agg(
        F.sum("size").alias("weight"), F.collect_list(F.struct("key", "size")).alias("_k")  # a text has at most 32 keys
    )
    listed = write_table(listed, "buckets")
    members = listed.select("row", "n", "weight", F.explode("_k").alias("_k")).select("row", "n", "weight", "_k.key", "_k.size")
    large = members.filter(F.col("size") > FEW)
    placed = listed.select("row", F.col("row").alias("component"))
    pairs = _small(members, similarity)
    if rounds:
        pairs = pairs.unionByName(_to_hubs(large, _hubs(large), similarity))
    placed = _merged(placed, _links(pairs.distinct(), texts, similarity))
    for turn in range(1, rounds + 1):
        now = write_table(large.join(placed, "row"), "near-members")
        by = now.groupBy("key").agg(
            F.min("component").alias("_a"), F.max("component").alias("_z"),
            F.max_by("component", F.struct("weight", -F.col("row"))).alias("_first"),
        )
        mixed = write_table(now.join(by.filter("_a < _z").drop("_a", "_z"), "key"), "near-mixed")
        free(now)
        if not mixed.limit(1).count():
            return placed
        if turn < rounds:
            others = _hubs(mixed.filter(F.col("component") != F.col("_first")))
            pairs = _beside(mixed, turn, similarity).unionByName(_to_hubs(mixed, others, similarity)).distinct()
            placed = _merged(placed, _links(pairs, texts, similarity))
    if not rounds:
        mixed = write_table(large.join(placed, "row"), "near-mixed")
    rows = write_table(mixed.select("row", "component").distinct(), "near-unconnected")
    return _merged(placed, _links(_sharing(rows, texts, similarity), texts, similarity))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, rounds: int = ROUNDS
) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept, and row (its number in this run).

    Texts with the same words (lower-cased runs of letters, digits and non-ASCII characters) are copies. Different
    texts are linked if at least `similarity` of the occurrence-labelled shingles of both (five words; all words of
    a shorter text) are matched by an alignment of the texts. A class is what links and copies connect;
    class_id is its least doc_id, and the first row with it is kept. Two texts of just that similarity share one of
    the sketches but for a chance of 1 in 90,000; see similar_texts for how those that share one are compared without
    making all pairs. The number of rounds changes what is compared, not the classes.

    Nulls: a null text has no words, and texts without words are each a class of their own; null doc_ids come
    last. Very long texts are compared whole. Ties: of rows with one doc_id the first read is kept. An empty table
    gives an empty result. Other columns are neither read nor returned.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = write_table(rows.withColumn("row", F.monotonically_increasing_id()), "near-rows")
    return classes(rows, similarity, rounds)


def classes(rows: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """The same for a written table of row, doc_id and text."""
    small_batches(rows.sparkSession)
    made = rows.select("row", "text").mapInArrow(_sketches, "row long, n long, digest binary, keys array<long>")
    made = write_table(made, "sketches")
    firsts = made.filter("digest is not null").groupBy("digest").agg(F.min("row").alias("first"))
    firsts = write_table(firsts, "firsts")
    one_each = join_rows(made, firsts.select(F.col("first").alias("row")), "row")
    found = similar_texts(rows.select("row", "text"), one_each, similarity, rounds).withColumnRenamed("row", "vertex")
    first_of = made.select("row", "digest").join(firsts, "digest", "left")
    first_of = write_table(first_of.select("row", F.coalesce("first", "row").alias("vertex")), "near-vertices")
    placed = first_of.join(found, "vertex", "left").select("row", F.coalesce("component", "vertex").alias("component"))
    placed = placed.join(rows.select("row", "doc_id"), "row")
    placed = write_table(placed, "near-classes")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row")))
    heads = placed.groupBy("component").agg(best.alias("_best"), F.count(F.lit(1)).alias("class_size"))
    heads = write_table(heads, "near-heads")  # a row per class: the join may then split a large one
    return placed.join(heads, "component").select(
        "doc_id", F.col("_best.doc_id").alias("class_id"), "class_size",
        (F.col("row") == F.col("_best.row")).alias("kept"), "row",
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, with all their columns.

    Rows are dropped by their number, not their id: of repeated rows, with null ids too, one stays. Null texts and
    texts without words all stay. Very long texts are compared whole. An empty table gives an empty result. Columns
    may have any names.
    """
    row = free_name(docs, "_row")
    marked = write_table(docs.withColumn(row, F.monotonically_increasing_id()), "near-documents")
    rows = marked.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kept = classes(rows).filter("kept").select(F.col("row").alias(row))
    return join_rows(marked, kept, row).select(*docs.columns)

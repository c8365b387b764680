"""Benchmark decontamination with a generalised suffix automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_spans, free_name, small_batches, without_words, word_bytes, write_table

#: Words of a window; items of fewer are one window.
WINDOW = 13
#: A document is contaminated from this share of hit words on: 1 in 20.
COVERAGE = 20
#: Words of test items in one automaton. More items make more automata, each passed over all documents.
BLOCK_WORDS = 400_000


@dataclass
class Automaton:
    """The suffix automaton of several word sequences. Words are numbers; a state's `longest` is the length of its
    longest sequence, `link` the state of its longest proper suffix that stands elsewhere."""

    vocab: dict[bytes, int] = field(default_factory=dict)
    pairs: np.ndarray = None  # packed neighbouring words of items, sorted: what can't be in there can't match
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    windows: dict[int, set[int]] = field(default_factory=dict)  # state that holds a full window: its items
    shorts: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # state: short items that end there
    above: list[int] = None  # nearest state on the chain of links, itself included, with short items
    ones: set[int] = field(default_factory=set)  # words that are an item by themselves

    def _grow(self, last: int, word: int) -> int:
        def clone(p: int, q: int) -> int:
            self.step.append(dict(self.step[q]))
            self.link.append(self.link[q])
            self.longest.append(self.longest[p] + 1)
            new = len(self.step) - 1
            self.link[q] = new
            while p >= 0 and self.step[p].get(word) == q:
                self.step[p][word] = new
                p = self.link[p]
            return new

        if word in self.step[last]:
            q = self.step[last][word]
            return q if self.longest[q] == self.longest[last] + 1 else clone(last, q)
        self.step.append({})
        self.link.append(0)
        self.longest.append(self.longest[last] + 1)
        new, p = len(self.step) - 1, last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else clone(p, q)
        return new

    @classmethod
    def of(cls, items: list[list[bytes]], window: int) -> Automaton:
        """items: sequences by item number; empty ones have no window."""
        a = cls()
        coded = [[a.vocab.setdefault(w, len(a.vocab)) for w in item] for item in items]
        for seq in coded:
            last = 0
            for w in seq:
                last = a._grow(last, w)
        for number, seq in enumerate(coded):
            for length, state in a.walk(seq):
                if length >= window:
                    while a.longest[a.link[state]] >= window:
                        state = a.link[state]
                    a.windows.setdefault(state, set()).add(number)
            if 0 < len(seq) < window:
                state = 0
                for w in seq:
                    state = a.step[state][w]
                a.shorts.setdefault(state, []).append((len(seq), number))
                if len(seq) == 1:
                    a.ones.add(seq[0])
        a.above = [-1] * len(a.step)
        for s in sorted(range(1, len(a.step)), key=a.longest.__getitem__):
            a.above[s] = s if s in a.shorts else a.above[a.link[s]]
        pairs = {(x << 32) | y for seq in coded for x, y in zip(seq, seq[1:])}
        a.pairs = np.array(sorted(pairs), dtype="int64")
        return a

    def walk(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the length of the longest suffix that occurs in an item, and its state."""
        state = length = 0
        step, link, longest = self.step, self.link, self.longest
        for w in words:
            while state and w not in step[state]:
                state = link[state]
                length = longest[state]
            if w in step[state]:
                state = step[state][w]
                length += 1
            else:
                length = 0
            yield length, state

    def match(self, words: list[bytes], window: int) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit stretches [start, end) of a document's words, in order and apart, and the items they are from."""
        known = self.vocab.get
        ids = np.fromiter((known(w, -1) for w in words), dtype="int64", count=len(words))
        packed = (ids[:-1] << 32) | ids[1:]
        at = np.searchsorted(self.pairs, packed)
        near = np.zeros(len(packed), dtype=bool)
        inside = at < len(self.pairs)
        near[inside] = self.pairs[at[inside]] == packed[inside]
        near &= (ids[:-1] >= 0) & (ids[1:] >= 0)
        # Only stretches of words that stand side by side in items can hold a window; each is walked.
        edges = np.flatnonzero(np.diff(np.concatenate(([False], near, [False])).astype("int8")))
        stretches = [(s, e + 1) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()) if e + 1 - s >= self.least]
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if self.ones:
            for i in np.flatnonzero(np.isin(ids, list(self.ones))).tolist():
                spans.append((i, i + 1))
                items.update(n for m, n in self.shorts[self.step[0][int(ids[i])]] if m == 1)
        for start, end in stretches:
            for i, (length, state) in enumerate(self.walk(ids[start:end].tolist()), start + 1):
                if length >= window:
                    spans.append((i - length, i))
                    top = state
                    while self.longest[self.link[top]] >= window:
                        top = self.link[top]
                    items |= self.windows[top]
                s = self.above[state]
                while s > 0:
                    for m, n in self.shorts[s]:
                        if m <= length:
                            spans.append((i - m, i))
                            items.add(n)
                    s = self.above[self.link[s]]
        return merged(spans), items

    @property
    def least(self) -> int:
        """Words of the shortest window of two words or more."""
        return self.shortest

    shortest: int = 2


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that overlap or touch as one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[tuple[list, list]]:
    """Item ids and their words, in blocks of about block_words words: what the driver holds at a time."""
    ids: list[str] = []
    words: list[list[bytes]] = []
    held = 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    for row in rows.toLocalIterator():
        item = word_bytes(row["t"])
        if row["i"] is None or not item:
            continue
        if held and held + len(item) > block_words:
            yield ids, words
            ids, words, held = [], [], 0
        ids.append(row["i"])
        words.append(item)
        held += len(item)
    yield ids, words


def _matcher(automaton, ids, window: int, every: bool):
    """From row ids and texts; every: also rows without a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, names = automaton.value, ids.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for row, text in enumerate(batch.column(1)):
                words = word_bytes(text.as_py())
                spans, items = a.match(words, window) if words else ([], set())
                if spans or every:
                    found = ([s for s, _ in spans], [e for _, e in spans], sorted({names[i] for i in items}))
                    for column, value in zip(out, (row, len(words), *found), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32())),
                 pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.list_(pa.string()))],
                names=["row", "n_words", "starts", "ends", "items"],
            )

    return run


def match_benchmark(
    rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """row, n_words, starts, ends, items for each row (row, text): hit stretches of words, and item ids.

    Each block of items is one automaton, broadcast (its size follows block_words, not the data) and passed
    over all documents; what several blocks find in a document is put together by a shuffle of hits alone.
    """
    small_batches(rows.sparkSession)
    spark, kind = rows.sparkSession, rows.schema["row"].dataType.simpleString()
    returned = f"row {kind}, n_words long, starts array<int>, ends array<int>, items array<string>"
    parts = []
    for ids, words in _blocks(benchmark, item_id, item_text, block_words):
        a = Automaton.of(words, window)
        a.shortest = min([window, *(len(w) for w in words if len(w) > 1)])
        run = _matcher(spark.sparkContext.broadcast(a), spark.sparkContext.broadcast(ids), window, not parts)
        parts.append(rows.select("row", "text").mapInArrow(run, returned))
    if len(parts) == 1:
        return parts[0]
    found = write_table(parts[0], "matches-0")
    for k, part in enumerate(parts[1:], 1):
        found = found.unionByName(write_table(part, f"matches-{k}"))
    spans = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))  # one entry per block at most
    both = found.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.sort_array(spans).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    one = "struct(int(x.starts) as starts, int(x.ends) as ends)"
    joined = F.expr(
        f"aggregate(s, cast(array() as array<struct<starts:int,ends:int>>), (acc, x) -> "
        f"if(size(acc) > 0 and element_at(acc, -1).ends >= x.starts, "
        f"concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).starts as starts, "
        f"greatest(element_at(acc, -1).ends, x.ends) as ends))), concat(acc, array({one}))))"
    )
    both = both.withColumn("m", joined)
    return both.select("row", "n_words", F.col("m.starts").alias("starts"), F.col("m.ends").alias("ends"), "items")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, id_col: str = "doc_id",
    text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, starts, ends.

    Words are lower-cased runs of letters, digits and non-ASCII characters. A window is `window` consecutive
    words of an item, or the whole item if that is shorter; words of a document inside an occurrence of a window
    are hit: the stretches starts[i] to ends[i] (exclusive), in words. A document is contaminated if it has hits
    and they are at least one in `coverage` of its words.

    Nulls: a null text has no words; a null item id or text has no window; a null doc_id is returned as such.
    Items without words have no window; without items nothing is hit. Very long texts are walked whole, in
    time linear in their words. Repeated rows give repeated rows. Other columns are neither read nor returned.
    """
    one = block_count_is_one(benchmark, item_text, block_words)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if one:  # the id goes along as the row
        found = match_benchmark(
            rows.withColumnRenamed("doc_id", "row"), benchmark, window, item_id, item_text, block_words
        ).withColumnRenamed("row", "doc_id")
    else:
        rows = write_table(rows.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
        found = match_benchmark(rows, benchmark, window, item_id, item_text, block_words)
        found = rows.select("row", "doc_id").join(found, "row").drop("row")
    hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"),
                      lambda acc, x: acc + x["ends"] - x["starts"])
    return found.withColumn("n_hit", hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words"))).alias("contaminated"),
        "starts", "ends",
    )


def block_count_is_one(benchmark: DataFrame, item_text: str, block_words: int) -> bool:
    """Whether all items surely fit one block: no item has more words than half its characters, and one."""
    bound = benchmark.agg(F.sum(F.length(F.col(item_text)) / 2 + 1)).first()[0] or 0
    return bound <= block_words


def _cleaner(automaton, window: int, coverage: int, span_limit: int | None, text_col: str):
    """Whole batches without contaminated rows, and the others' texts without long spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            keep, texts = [], []
            for value in batch.column(at):
                text = value.as_py()
                words = word_bytes(text)
                spans = a.match(words, window)[0] if words else []
                n = sum(e - s for s, e in spans)
                keep.append(not n or n * coverage < len(words))
                if span_limit is not None:
                    long = [(s, e) for s, e in spans if e - s > span_limit]
                    texts.append(without_words(text, long) if long and keep[-1] else text)
            if span_limit is not None:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, span_limit: int | None = None,
) -> DataFrame:
    """docs without those that are contaminated, with all their columns.

    span_limit: hit stretches of more words are cut out of the texts that stay; without it these are left as they
    are.
    """
    small_batches(docs.sparkSession)
    if block_count_is_one(benchmark, item_text, block_words):
        ids, words = next(_blocks(benchmark, item_id, item_text, block_words))
        a = Automaton.of(words, window)
        a.shortest = min([window, *(len(w) for w in words if len(w) > 1)])
        run = _cleaner(docs.sparkSession.sparkContext.broadcast(a), window, coverage, span_limit, text_col)
        return docs.mapInArrow(run, docs.schema)
    row = free_name(docs, "_row")
    marked = write_table(docs.withColumn(row, F.monotonically_increasing_id()), "to-clean")
    found = decontaminate(marked, benchmark, window, coverage, row, text_col, item_id, item_text, block_words)
    found = write_table(found.filter("n_hit > 0").withColumnRenamed("doc_id", row), "hits")
    kept = marked.join(found.filter("contaminated").select(row), row, "left_anti")
    if span_limit is None:
        return kept.select(*docs.columns)
    spans = free_name(docs, "_spans")
    long = F.filter(F.arrays_zip("starts", "ends"), lambda x: x["ends"] - x["starts"] > span_limit)
    cut = kept.join(found.select(row, long.alias(spans)), row, "left").drop(row)
    return cut.mapInArrow(cut_spans(text_col, spans), docs.schema)

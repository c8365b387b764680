"""Encoding texts inside tasks with a byte-level BPE tokenizer."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces whose ids a worker remembers, at most, in each of two generations; longer pieces aren't.
REMEMBERED, LENGTH = 200_000, 48
#: Distinct pieces whose ids are kept from one chunk of texts to the next, at most; words in one call of the model.
KEPT, TOGETHER = 600_000, 250
#: Bytes of a chunk of texts, which has one text at least, and of a text that is encoded with others at most.
CHUNK, TEXT = 4 << 20, 256 << 20
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A single space between two characters that aren't white space: a new piece always starts there.
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_SPACE = re.compile(r"\s")
#: Letters of any Unicode version: Latin, Greek, Cyrillic, Hebrew, Arabic, kana, Han, Hangul. Others are encoded singly.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0388-\u038a\u038e-\u03a1\u03a3-\u03ce\u0400-\u0481" \
    "\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: Pieces for the model alone: letters and then perhaps marks, perhaps after a line feed.
_WORD = f"^\\n?[{_LETTERS}]+[{re.escape(_MARKS)}]*$"
_TAIL = re.compile(f"([{re.escape(_MARKS)}]+)\x01")
#: Bytes that UTF-8 doesn't have: the end of a piece and a cut within it, which are written as 1 and 2 before.
_END, _CUT = 0xFE, 0xFF


def _byte_characters() -> dict[int, int]:
    """The character by which a byte-level vocabulary writes each byte: printable ones stand for themselves, the
    others are numbered from 256 on. As a table for str.translate()."""
    others = (b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE))
    return {b: 256 + k for k, b in enumerate(others)}


#: The same as a table without gaps, at which translate() is faster, with the bytes 1 and 2 as _END and _CUT.
_FORMS = "".join(chr(_byte_characters().get(b, b)) for b in [0, _END, _CUT, *range(3, 256)])


class _Spaces(Exception):
    """A piece that begins or ends with white space, so that its neighbours may change its ids."""


class _Seen(dict):
    """Ids of pieces as bytes: each after a space, or at the start of a text or line. When full, it starts anew and
    keeps the pieces of before in `old`."""

    def __init__(self, tokenizer, before: str, first: _Seen | None = None):
        super().__init__()
        self.encode, self.tokenize = tokenizer.encode, tokenizer.model.tokenize
        self.before, self.first = before, self if first is None else first
        self.characters, self.old = _byte_characters(), {}
        self.feed = array("i", self.encode("\n", add_special_tokens=False).ids).tobytes()

    def whole(self, piece: str) -> bytes:
        """By the tokenizer itself."""
        return array("i", self.encode(self.before + piece, add_special_tokens=False).ids).tobytes()

    def _other(self, piece: str) -> bytes:
        """Of a piece that isn't of letters alone."""
        stem = piece.rstrip(_MARKS)
        if len(stem) < len(piece) and stem.isalpha():  # marks after letters are a piece
            return self[stem] + self.first[piece[len(stem) :]]
        body = piece.lstrip("\n") if self.before else piece
        if not body or body[0].isspace() or body[-1].isspace():
            raise _Spaces
        if len(body) == len(piece):
            return self.whole(piece)
        # Line feeds take the place of the space.
        return self.first.feed + self.first[body] if len(body) + 1 == len(piece) else self.first.whole(piece)

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if piece.isalpha():  # one piece for the pre-tokenizer too: its model alone will do
                form = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.characters)
                ids = array("i", [t.id for t in self.tokenize("Ġ" + form if self.before else form)]).tobytes()
            else:
                ids = self._other(piece)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        if len(piece) <= LENGTH:
            self[piece] = ids
        return ids


class _Known:
    """Ids of pieces after a space as Arrow arrays, which take a third of the memory of a dict's objects. Those used
    last are kept."""

    def __init__(self, encode: Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]]):
        self.encode, self.turn = encode, 0
        self.pieces, self.used = pa.array([], pa.string()), np.zeros(0, dtype="i4")
        self.counts, self.flat = np.zeros(0, dtype="i4"), np.zeros(0, dtype="<i4")

    def __call__(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct pieces: where each stands in the counts, these, and all ids. A count is -1 for a piece whose
        neighbours may change its ids; such aren't kept."""
        self.turn += 1
        place = pc.index_in(pieces, self.pieces)
        new = pieces.filter(place.is_null())
        place = place.fill_null(-1).to_numpy().copy()
        self.used[place[place >= 0]] = self.turn
        place[place < 0] = len(self.used) + np.arange(len(new))
        counts, flat = self.encode(new)
        all_counts, all_flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, flat])
        short = (counts >= 0) & (pc.binary_length(new).to_numpy() <= LENGTH)
        self.pieces = pa.concat_arrays([self.pieces, new])
        self.used = np.concatenate([self.used, np.full(len(new), self.turn, dtype="i4")])
        keep = np.concatenate([np.ones(len(self.counts), dtype=bool), short])
        self.counts, self.flat = all_counts, all_flat
        if keep.sum() > KEPT:  # half of them go, and more of those that were used as long ago as the last of these
            keep &= self.used > np.partition(self.used[keep], -(KEPT // 2 + 1))[-(KEPT // 2 + 1)]
        if not keep.all():
            self.flat = all_flat[np.repeat(keep, np.maximum(all_counts, 0))]
            self.pieces, self.used, self.counts = self.pieces.filter(pa.array(keep)), self.used[keep], all_counts[keep]
        return place, all_counts, all_flat


class Encoder:
    """Token ids of whole texts by a file of the tokenizers library, for byte-level BPE.

    The pre-tokenizer cuts a text into pieces that are encoded each by itself. It always cuts before a space that
    stands between two characters that aren't white space, and before line feeds between such. So a text whose
    white space is of this kind is cut there and its pieces, of which those seen before are remembered, are encoded
    each by itself; a text that has other white space is cut at lone spaces only. So the ids are those of encoding
    the text as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.first = _Seen(self.tokenizer, "")
        self.seen = _Seen(self.tokenizer, " ", self.first)
        self.known = _Known(self._pieces)
        model = self.tokenizer.model
        self.words, marks = Tokenizer(model), [_FORMS[1], _FORMS[2]]
        self.end, self.cut = (model.token_to_id(x) for x in marks)
        # Words can be encoded together if no other token has the bytes between them, so that no merge goes over these.
        odd = ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix")
        added = [t.content.rstrip(_MARKS) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.together = (
            sorted(t for t in self.words.get_vocab() if any(x in t for x in marks)) == sorted(marks)
            and not any(getattr(model, x, None) for x in odd)
            and not any(x == "" or x.isalpha() for x in added)
        )

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<i4")
        try:
            head, *rest = text.replace("\n", " \n").replace("\n \n", "\n\n").split(" ")
            found = [self.first[head], *map(self.seen.__getitem__, rest)]
        except _Spaces:
            head, *rest = _BREAK.split(text)
            found = [self._piece(self.first, head), *[self._piece(self.seen, x) for x in rest]]
        return np.frombuffer(b"".join(found), dtype="<i4")

    def lists(self, texts: pa.StringArray, end_id: int | None = None) -> pa.ListArray:
        """Ids of each text, with end_id after them if given; null is empty. The same as ids(), for a chunk at a time:
        each distinct piece is looked up once, and the new ones are encoded by few calls of the model."""
        if not len(texts):
            return pa.array([], pa.list_(pa.int32()))
        texts = texts.cast(pa.string())
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        long = pc.greater(pc.binary_length(texts), TEXT)
        cut = pc.if_else(long, "", texts) if pc.any(long).as_py() else texts
        cut = pc.replace_substring(cut, "\n", " \n")
        cut = pc.replace_substring(cut, "\n \n", "\n\n")
        cut = pc.split_pattern(cut, " ")
        offsets = cut.offsets.to_numpy()
        starts = offsets[:-1]
        heads = cut.values.take(pa.array(starts)).to_pylist()
        found = cut.values.dictionary_encode()
        del cut
        place, counts, flat = self.known(found.dictionary)
        codes = place[found.indices.to_numpy()]
        del found, place
        # What isn't a piece after a space has an entry of its own: heads, whole texts, the end.
        more: list[bytes] = []
        entries: dict[str, int] = {}
        whole = long.to_numpy(zero_copy_only=False).copy()
        for k, head in enumerate(heads):
            if head not in entries:
                try:
                    more.append(self.first[head] if head else b"")
                    entries[head] = len(counts) + len(more) - 1
                except _Spaces:
                    entries[head] = -1
            codes[starts[k]] = entries[head]
            whole[k] |= entries[head] < 0 or not head and offsets[k + 1] - starts[k] > 1
        odd = counts < 0
        if odd.any():
            at = np.flatnonzero(np.append(odd, np.zeros(len(more), dtype=bool))[codes])
            whole[np.searchsorted(offsets, at, side="right") - 1] = True
        sizes = np.diff(offsets)
        if whole.any():
            for k in np.flatnonzero(whole).tolist():
                more.append(self.ids(texts[k].as_py()).tobytes())
                codes[starts[k]] = len(counts) + len(more) - 1
            keep = np.repeat(~whole, sizes)
            keep[starts] = True
            codes, sizes = codes[keep], np.where(whole, 1, sizes)
        if end_id is not None:
            codes = np.insert(codes, np.cumsum(sizes), len(counts) + len(more))
            sizes = sizes + 1
            more.append(np.array([end_id], dtype="<i4").tobytes())
        counts = np.concatenate([np.maximum(counts, 0), np.fromiter((len(x) // 4 for x in more), "i4", len(more))])
        flat = np.concatenate([flat, np.frombuffer(b"".join(more), dtype="<i4")])
        entry = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat))
        ids = entry.take(pa.array(codes))
        ends = ids.offsets.to_numpy()[np.append(0, np.cumsum(sizes))]
        return pa.ListArray.from_arrays(pa.array(ends), ids.values)

    def _pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ids of distinct pieces after a space, -1 for a piece of _Spaces, and the ids."""
        word = pc.match_substring_regex(pieces, _WORD) if self.together else pa.array([False] * len(pieces), pa.bool_())
        words, others = pieces.filter(word), pieces.filter(pc.invert(word))
        counts, flat = np.full(len(pieces), -1, dtype="i4"), []
        if len(words):
            bounds = np.append(np.arange(0, len(words), TOGETHER), len(words))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), "\x01 ").to_pylist()
            forms = [_TAIL.sub("\x02\\1\x01", f" {x}\x01".replace(" \n", "\n\x02")) for x in joined]
            forms = [x.encode("utf-8").decode("latin-1").translate(_FORMS) for x in forms]
            ids = [np.array(x.ids, dtype="<i4") for x in self.words.encode_batch_fast(forms, add_special_tokens=False)]
            ids = np.concatenate(ids)
            ids = ids[ids != self.cut]
            ends = np.flatnonzero(ids == self.end)
            word_counts, word_ids = np.diff(ends, prepend=-1) - 1, ids[ids != self.end]
        else:
            word_counts, word_ids = np.zeros(0, dtype="i4"), np.zeros(0, dtype="<i4")
        other_ids = []
        for piece in others.to_pylist():
            try:
                other_ids.append(self.seen[piece])
            except _Spaces:
                other_ids.append(None)
        is_word = word.to_numpy(zero_copy_only=False)
        counts[is_word] = word_counts
        counts[~is_word] = [-1 if x is None else len(x) // 4 for x in other_ids]
        flat = np.zeros(int(np.maximum(counts, 0).sum()), dtype="<i4")
        of_word = np.repeat(is_word, np.maximum(counts, 0))
        flat[of_word] = word_ids
        flat[~of_word] = np.frombuffer(b"".join(x for x in other_ids if x is not None), dtype="<i4")
        return counts, flat

    @staticmethod
    def _piece(seen: _Seen, piece: str) -> bytes:
        return seen.whole(piece) if _SPACE.search(piece) else seen[piece]


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of CHUNK bytes of a column's text, or of one row of more."""
    held, size = [], 0
    for batch in batches:
        sizes = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype="int64"))
        start = 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(sizes, sizes[start] + CHUNK - size, side="right")) - 1, start)
            if stop == start and not held:
                stop += 1
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(sizes[stop] - sizes[start])
                start = stop
            if start < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process: later tasks go on with the words that it has seen."""
    return Encoder(path)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """Length in bytes of each token of a byte-level vocabulary, in which one character stands for each byte."""
    tokenizer = encoder(path).tokenizer
    vocab = tokenizer.get_vocab()
    out = np.zeros(max(vocab.values()) + 1, dtype="int64")
    for token, i in vocab.items():
        out[i] = len(token)
    for i, token in tokenizer.get_added_tokens_decoder().items():
        out[i] = len(token.content.encode())
    return out

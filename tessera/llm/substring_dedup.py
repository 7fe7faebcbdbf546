"""Exact removal of repeated passages by recompression.

Recompression names runs of equal symbols and then pairs of neighbouring
symbols, round by round; which neighbours pair up depends only on the two
symbols, so equal substrings get equal symbols everywhere but near their ends.
A name is a 128-bit fingerprint of what it stands for, under a key drawn for
each call, hence the same in every task without an exchange; the rounds up to
symbols of 16 words and more run in the Spark pass that reads the texts. Spark
then counts names globally, from the top of the parse down:

* High symbols decide first: a pair of neighbouring symbols of the top level
  that a smaller doc_id also has is a long repeat, and all windows inside it are
  settled by that.
* Low symbols lead to what is left, the edges of long repeats and short ones:
  whether a level-2 boundary stands at a place depends on three words on either
  side only, and a level-2 symbol has at most four words unless a run is in it.
  So every window of 13 words holds such a boundary well inside, the same one in
  every document that has the window; the one of least name stands for the
  window. Windows without one (runs) stand for themselves. Windows that no high
  pair has settled and whose boundary occurs in two documents are compared one
  by one.

The document with the smallest id never has its windows settled by a pair, so it
is always there to be compared with, and the result is exact. Each pass works on
slices of many texts at once, so short texts cost no numpy call of their own.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import forget, shared_rows, texts, written
from tessera.llm.words import grams, hashed, mix, slices

_NONE = np.uint64(2**64 - 1)
_K = np.uint64(0x9FB21C651E98DF25)
_ROUNDS, _WIDE = 14, 16


def _sides(names: np.ndarray, level: int) -> np.ndarray:
    """True where a symbol may only be the right one of a pair of this level."""
    return (mix(names ^ np.uint64(level * 0x632BE59BD9B4E019 & (2**64 - 1))) & np.uint64(1)).astype(bool)


def _slot_names(words: np.ndarray) -> np.ndarray:
    """For each slot b (between words b-1 and b): the name of its six words if a level-2 boundary stands there, else _NONE."""
    n = len(words)
    out = np.full(n + 1, _NONE)
    if n < 6:
        return out
    right = _sides(words, 1)
    one = np.ones(n + 1, dtype=bool)
    one[1:n] = (words[1:] != words[:-1]) & ~(~right[:-1] & right[1:])
    double = np.zeros(n, dtype=np.uint64)
    double[:-1] = mix(words[:-1] * _K + words[1:])
    b = np.arange(3, n - 2)
    left_one, right_one = one[b - 1], one[b + 1]
    regular = one[b] & (left_one | one[b - 2]) & (right_one | one[b + 2])
    left = np.where(left_one, words[b - 1], double[b - 2])
    after = np.where(right_one, words[b], double[b])
    merged = (left == after) | (~_sides(left, 2) & _sides(after, 2))
    out[b] = np.where(regular & ~merged, grams(words, 6, 6)[b - 3], _NONE)
    return out


def _window_names(words: np.ndarray, window: int) -> np.ndarray:
    """The name that stands for the window at each start; needs the words of the window only."""
    full = grams(words, window, window + 1000)
    slots = window - 5
    if slots < 1 or not len(full):
        return full
    least = _slot_names(words)[3:]
    have = 1
    while have < slots:
        step = min(have, slots - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    least = least[: len(full)]
    return np.where(least == _NONE, full, least)


def _top_symbols(words: list[np.ndarray], doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Both halves of the names, first words and documents of the symbols after the last round."""
    names, start, of = words, np.arange(len(doc)), doc
    for level in range(1, _ROUNDS + 1):
        free = np.diff(np.append(start, len(doc))) < _WIDE
        # Runs of equal symbols become one symbol, named by its length too.
        new = np.ones(len(of), dtype=bool)
        new[1:] = (names[0][1:] != names[0][:-1]) | (of[1:] != of[:-1]) | ~free[1:] | ~free[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(of))).astype(np.uint64)
        run = np.flatnonzero(count > 1)
        names = [n[first] for n in names]
        for n in names:
            n[run] = mix(n[run] * _K + count[run] + np.uint64(level))
        start, of = start[first], of[first]
        free = np.diff(np.append(start, len(doc))) < _WIDE
        # Pairs of a left and a right symbol become one.
        right = _sides(names[0], level)
        at = np.flatnonzero(~right[:-1] & right[1:] & (of[1:] == of[:-1]) & free[:-1] & free[1:])
        stay = np.ones(len(of), dtype=bool)
        stay[at + 1] = False
        for n in names:
            n[at] = mix(n[at] * _K + n[at + 1] + np.uint64(level * 7919))
        names, start, of = [n[stay] for n in names], start[stay], of[stay]
    return names, start, of


def _high_pairs(words: list[np.ndarray], doc: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Both halves of the names, documents and word ranges of neighbouring top symbols, where a window fits."""
    if not len(doc):
        none = np.zeros(0, dtype=np.uint64)
        return none, none, *(np.zeros(0, dtype=np.int64),) * 3
    names, start, of = _top_symbols(words, doc)
    end = np.append(start[1:], len(doc))
    with_next = np.zeros(len(of), dtype=bool)
    with_next[:-1] = of[1:] == of[:-1]
    first_of = np.ones(len(of), dtype=bool)
    first_of[1:] = of[1:] != of[:-1]
    after = np.minimum(np.arange(len(of)) + 1, len(of) - 1)
    till = np.where(with_next, end[after], end)
    use = (with_next | first_of) & (till - start >= window)
    one, two = (mix(n * _K + np.where(with_next, n[after], np.uint64(1)) + np.uint64(0x1B873593))[use] for n in names)
    return one, two | np.uint64(1), of[use], start[use], till[use]


def _signed(*parts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(parts).view(np.int64))


def _first_of_each(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _lists(column: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of the lists of ``rows``, and which of these rows each is of."""
    part = column.take(pa.array(rows))
    n = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
    return part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(rows)), n)


def _among(values: np.ndarray, of: np.ndarray, listed: np.ndarray, listed_of: np.ndarray) -> np.ndarray:
    """Whether each value is in its own document's list."""
    if not len(values) or not len(listed):
        return np.zeros(len(values), dtype=bool)
    return np.isin(mix(values + of.astype(np.uint64) * _K), mix(listed + listed_of.astype(np.uint64) * _K))


class _Slice:
    """The words of some texts, their documents and which window starts lie in one document."""

    def __init__(self, docs: list[bytes], keys: tuple[int, int], window: int):
        self.words, self.at = hashed(docs, keys)
        self.doc = np.repeat(np.arange(len(docs)), np.diff(self.at))
        self.starts = max(0, len(self.doc) - window + 1)
        self.inside = self.doc[window - 1 :] == self.doc[: self.starts] if self.starts else np.zeros(0, dtype=bool)
        self.window = window

    def settled(self, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Window starts inside a high pair that a smaller doc_id also has."""
        if not len(pairs[0]):
            return np.zeros(self.starts, dtype=bool)
        key, _, of, start, till = _high_pairs(self.words, self.doc, self.window)
        hit = _among(key, of, *pairs)
        change = np.bincount(start[hit], minlength=len(self.doc) + 1) - np.bincount(till[hit] - self.window + 1, minlength=len(self.doc) + 1)
        return np.cumsum(change)[: self.starts] > 0


def _survey(window: int, keys: tuple[int, int]):
    """First pass: (doc_id, key, check); check is 0 for a boundary's name, odd for a high pair's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            docs = batch.column(1).cast(pa.binary()).to_pylist()
            for i, j in slices(docs):
                s = _Slice(docs[i:j], keys, window)
                names = _window_names(s.words[0], window)[s.inside]
                of = s.doc[: s.starts][s.inside]
                new = _first_of_each(names, of)
                names, of = names[new], of[new]
                order = np.lexsort((names, of))
                names, of = names[order], of[order]
                new = _first_of_each(names, of)
                names, of = names[new], of[new]
                key, check, pair_of, _, _ = _high_pairs(s.words, s.doc, window)
                yield pa.record_batch([pa.array(ids[i:j][np.concatenate([of, pair_of])]), _signed(names, key), _signed(np.zeros(len(names), dtype=np.uint64), check)], names=["doc_id", "key", "check"])

    return run


def _open_windows(window: int, keys: tuple[int, int]):
    """Second pass: (doc_id, h1, h2) of the windows still to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            docs = batch.column(1).cast(pa.binary()).to_pylist()
            for i, j in slices(docs):
                s = _Slice(docs[i:j], keys, window)
                rows = np.arange(i, j)
                # A boundary that two documents share is shared for each that has it.
                anchors = np.unique(_lists(batch.column(2), rows)[0])
                names = _window_names(s.words[0], window)
                new = _first_of_each(names) if len(names) else s.inside
                todo = np.repeat(np.isin(names[new], anchors), np.diff(np.append(np.flatnonzero(new), len(names)))) & s.inside
                todo &= ~s.settled(_lists(batch.column(3), rows))
                at = np.flatnonzero(todo)
                h1, h2 = (grams(w, window, window)[at] for w in s.words)
                yield pa.record_batch([pa.array(ids[i:j][s.doc[at]]), _signed(h1), _signed(h2)], names=["doc_id", "h1", "h2"])

    return run


def _cut(window: int, keys: tuple[int, int]):
    """Last pass: the kept words of each text, and how many went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            parts = [t.split() for t in docs]
            gone = [0] * len(docs)
            listed = np.flatnonzero(pc.or_(*(pc.fill_null(pc.greater(pc.list_value_length(batch.column(c)), 0), False) for c in (2, 3))).to_numpy(zero_copy_only=False))
            total = [len(p) for p in parts]
            for i, j in slices([docs[d] for d in listed]):
                rows = listed[i:j]
                s = _Slice([docs[d] for d in rows], keys, window)
                hit = s.settled(_lists(batch.column(2), rows))
                open_ = np.flatnonzero(s.inside & ~hit)
                hit[open_] = _among(grams(s.words[0], window, window)[open_], s.doc[open_], *_lists(batch.column(3), rows))
                first = np.flatnonzero(hit)
                change = np.bincount(first, minlength=len(s.doc) + 1) - np.bincount(first + window, minlength=len(s.doc) + 1)
                stay = np.cumsum(change)[:-1] == 0
                kept = stay.tolist()
                for d, a, b in zip(rows.tolist(), s.at[:-1].tolist(), s.at[1:].tolist(), strict=True):
                    parts[d] = list(compress(parts[d], kept[a:b]))
                    gone[d] = b - a - len(parts[d])
            text = [b" ".join(p).decode() for p in parts]
            yield pa.record_batch([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text.

    A word goes if it is covered by ``window`` consecutive words that also start
    in a document of smaller doc_id. Kept words are joined by one space. Null
    texts have no words; rows that share a doc_id never count as smaller than
    each other; rows with a null doc_id keep everything and are no one's source.
    Other columns are ignored; an empty table gives no rows.
    """
    docs = texts(docs)
    # Drawn for each call, so that no text can be made to collide; the result does not depend on it.
    keys = (secrets.randbits(64), secrets.randbits(64))
    known = docs.where("doc_id is not null and text is not null")
    seen = written(known.mapInArrow(_survey(window, keys), "doc_id long, key long, check long"), "names")
    own = shared_rows(seen, ["key", "check"])
    anchor = F.col("check") == 0
    per_doc = own.where(anchor | (F.col("doc_id") > F.col("low"))).groupBy("doc_id").agg(F.collect_list(F.when(anchor, F.col("key"))).alias("anchors"), F.collect_list(F.when(~anchor, F.col("key"))).alias("pairs"))
    per_doc = written(per_doc, "per_doc")
    forget(seen)
    open_ = written(known.join(per_doc, "doc_id").select("doc_id", "text", "anchors", "pairs").mapInArrow(_open_windows(window, keys), "doc_id long, h1 long, h2 long"), "open")
    hits = shared_rows(open_, ["h1", "h2"]).where("doc_id > low").groupBy("doc_id").agg(F.collect_set("h1").alias("windows"))
    found = written(per_doc.where(F.size("pairs") > 0).select("doc_id", "pairs").join(hits, "doc_id", "full"), "found")
    forget(per_doc, open_)
    return docs.join(found, "doc_id", "left").select("doc_id", "text", "pairs", "windows").mapInArrow(_cut(window, keys), "doc_id long, n_words long, n_removed long, kept_text string")


def repeats_digest(docs: DataFrame, window: int = 13) -> DataFrame:
    """remove_repeats with kept_sha256 in place of the kept text; nulls, ties and empty tables as there."""
    return remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

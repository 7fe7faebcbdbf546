"""Language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to 3 is counted and frozen.
A byte costs -log2 of its count share in the longest known context; where the
context lacks it, an escape (method C: distinct / (total + distinct)) is paid
and the next shorter context is asked, down to a uniform order -1 over all 256
bytes. The language of least total code length wins. A-Z count as a-z.

Costs of known contexts lie in hash tables keyed by the bytes themselves, so a
text costs a few numpy lookups a byte under all languages at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import held_out, small_enough, written

#: At most so many texts of each language are learnt from, those of least hash.
TEXTS_PER_LANGUAGE = 400
#: And so many bytes of them (one text at least); texts above LONG_TEXT bytes only if there are not enough others.
BYTES_PER_LANGUAGE, LONG_TEXT = 8 << 20, 1 << 16
#: So many times the rows wanted pass a first threshold on their hash; that too few do has a probability below 1e-100.
SPARE = 4
#: Tables of languages and of training rows (one language and id each) of up to so many rows are broadcast.
BROADCAST_ROWS = 100_000
_PIECE = 1 << 20
_PAD = b"   "
_FOLD = bytes([b + 32 if 65 <= b <= 90 else b for b in range(256)])


@dataclass
class Model:
    """Bits of a byte after its context, by language; grams are packed big-endian, the last byte lowest."""

    langs: list[str]
    grams4: np.ndarray  # known 4-grams
    costs4: np.ndarray  # (4-grams, langs) bits of the last byte
    grams3: np.ndarray  # known 3-grams
    costs3: np.ndarray  # (3-grams, langs) bits of the last byte after the two before
    leave3: np.ndarray  # (3-grams, langs) bits to leave the 3-gram as a context
    costs2: np.ndarray  # (256**2, langs) bits of the last byte after the one before
    leave2: np.ndarray  # (256**2, langs) bits to leave the 2-gram as a context


def _packed(s: np.ndarray, k: int) -> np.ndarray:
    """All k-grams of the bytes ``s`` as numbers."""
    out = s[: len(s) - k + 1].astype(np.uint32)
    for j in range(1, k):
        out = out << np.uint32(8) | s[j : len(s) - k + 1 + j]
    return out


def _shares(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of each gram's last byte in its context; the contexts, sorted, and the bits to leave them."""
    contexts, first = np.unique(grams >> np.uint32(8), return_index=True)
    kinds = np.diff(np.append(first, len(grams)))
    whole = np.add.reduceat(counts, first) + kinds
    return -np.log2(counts / np.repeat(whole, kinds)), contexts, -np.log2(kinds / whole)


def fit(samples: dict[str, list[bytes]]) -> Model:
    """Context trees of each language from its sample texts."""
    langs = sorted(samples)
    streams = [np.frombuffer(_PAD + _PAD.join(t.translate(_FOLD) for t in samples[k]) + _PAD, np.uint8) for k in langs]
    counted = [[np.unique(_packed(s, n), return_counts=True) for n in (1, 2, 3, 4)] for s in streams]
    grams3, grams4 = (np.unique(np.concatenate([c[n][0] for c in counted])) for n in (2, 3))
    costs2, leave2 = np.empty((1 << 16, len(langs))), np.zeros((1 << 16, len(langs)))
    costs3, leave3 = np.empty((len(grams3), len(langs))), np.zeros((len(grams3), len(langs)))
    costs4 = np.empty((len(grams4), len(langs)))
    pairs = np.arange(1 << 16)
    for i, (one, two, three, four) in enumerate(counted):
        bits, _, away = _shares(*one)
        alone = np.full(256, away[0] + 8.0)  # order -1: all bytes alike
        alone[one[0]] = bits
        bits, contexts, away = _shares(*two)
        lost = np.zeros(256)
        lost[contexts] = away
        costs2[:, i] = lost[pairs >> 8] + alone[pairs & 255]
        costs2[two[0], i] = bits
        bits, contexts, away = _shares(*three)
        leave2[contexts, i] = away
        costs3[:, i] = leave2[grams3 >> np.uint32(8), i] + costs2[grams3 & np.uint32(0xFFFF), i]
        costs3[np.searchsorted(grams3, three[0]), i] = bits
        bits, contexts, away = _shares(*four)
        leave3[np.searchsorted(grams3, contexts), i] = away
        # A known 4-gram's parts are known 3-grams, of one language or another.
        costs4[:, i] = leave3[np.searchsorted(grams3, grams4 >> np.uint32(8)), i] + costs3[np.searchsorted(grams3, grams4 & np.uint32(0xFFFFFF)), i]
        costs4[np.searchsorted(grams4, four[0]), i] = bits
    return Model(langs, grams4, costs4.astype(np.float32), grams3, costs3.astype(np.float32), leave3.astype(np.float32), costs2.astype(np.float32), leave2.astype(np.float32))


class _Table:
    """Row numbers of known keys, by open addressing; unknown keys have -1."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint32)
        self.rows = np.full(1 << self.bits, -1, dtype=np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.rows[at] < 0
            self.rows[at[free]] = left[free]  # of several keys at one place one wins
            won = self.rows[at] == left
            self.keys[at[won]] = keys[left[won]]
            left, at = left[~won], at[~won] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ keys >> np.uint32(15)) * np.uint32(0x9E3779B1)
        return (mixed >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.rows[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        at = at[open_]
        while len(open_):
            at = at + 1 & (1 << self.bits) - 1
            out[open_] = self.rows[at]
            more = (self.keys[at] != keys[open_]) & (self.rows[at] >= 0)
            open_, at = open_[more], at[more]
        return out


class Scorer:
    """Code lengths of texts under every language of a model."""

    def __init__(self, model: Model):
        self.m = model
        self.four, self.three = _Table(model.grams4), _Table(model.grams3)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """(texts, langs) total code lengths; long texts go in pieces that overlap by their context."""
        out = np.zeros((len(texts), len(self.m.langs)))
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            for a in range(0, len(t), _PIECE):
                piece = (t[a - 3 : a] if a else _PAD) + t[a : a + _PIECE]
                held.append((i, piece))
                size += len(piece)
                if size > _PIECE:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, bytes]], out: np.ndarray) -> None:
        if not held:
            return
        key = _packed(np.frombuffer(b"".join(p for _, p in held).translate(_FOLD), np.uint8), 4)
        row = self.four.find(key)
        cost = self.m.costs4[row] if len(self.m.costs4) else np.zeros((len(key), len(self.m.langs)), np.float32)
        new = np.flatnonzero(row < 0)
        if len(new):
            left, last = key[new] >> np.uint32(8), key[new] & np.uint32(0xFFFFFF)
            away, short = self.three.find(left), self.three.find(last)
            known = self.m.costs3[short]
            unknown = np.flatnonzero(short < 0)
            known[unknown] = self.m.leave2[last[unknown] >> np.uint32(8)] + self.m.costs2[last[unknown] & np.uint32(0xFFFF)]
            cost[new] = np.where((away >= 0)[:, None], self.m.leave3[away], 0) + known
        sums = np.concatenate([np.zeros((1, cost.shape[1])), np.cumsum(cost, axis=0, dtype=np.float64)])
        ends = np.cumsum([len(p) for _, p in held]) - 3
        starts = ends - np.array([len(p) - 3 for _, p in held])
        np.add.at(out, [i for i, _ in held], sums[ends] - sums[starts])


_LETTER = re.compile("[A-Za-z]")
_SCORERS: dict[int, Scorer] = {}


def _predict(model: Model, token: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[token] = Scorer(model)
        scorer = _SCORERS[token]
        for batch in batches:
            texts = batch.column(2).to_pylist()
            real = [bool(t) and (_LETTER.search(t) is not None or any(map(str.isalpha, t))) for t in texts]
            bits = scorer.bits([t.encode() if r else b"" for t, r in zip(texts, real, strict=True)])
            best = bits.argmin(1)
            rest = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            pred = [model.langs[b] if r else "und" for b, r in zip(best, real, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(np.where(real, 1 / rest, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def training_sample(docs: DataFrame, per_language: int) -> dict[str, list[bytes]]:
    """Whole texts of the rows of least hash of each language, held-out rows left aside."""
    size = F.octet_length(F.col("text").cast("string"))
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", size.alias("n"), F.xxhash64(F.lit("lid"), "doc_id").alias("h"))
    # Hashes that cannot be among the least ones go before the window, which then sees about SPARE x per_language rows of a language, however many there are.
    long = F.col("n") > LONG_TEXT
    sizes = rows.groupBy("lang").agg(F.sum((~long).cast("long")).alias("short_texts"), F.sum(long.cast("long")).alias("long_texts"))
    sizes = written(sizes, "sizes")
    sizes = F.broadcast(sizes) if small_enough(sizes, BROADCAST_ROWS) else sizes  # before the rows are dealt by language
    share = lambda c: (F.col("h") / 2.0**64 + 0.5) * F.col(c) <= SPARE * per_language
    rows = rows.join(sizes, "lang").where((~long & share("short_texts")) | (long & (F.col("short_texts") < per_language) & share("long_texts")))
    order = Window.partitionBy("lang").orderBy(long, "h", "doc_id", "n")
    picked = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    picked = picked.withColumn("b", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("b") <= BYTES_PER_LANGUAGE) | (F.col("r") == 1))
    ids = picked.select("doc_id", "lang", "n").distinct()
    ids = F.broadcast(ids) if small_enough(ids, BROADCAST_ROWS) else ids
    sample: dict[str, list[bytes]] = {}
    for lang, text in docs.where(F.col("text").isNotNull()).withColumn("n", size).join(ids, ["doc_id", "lang", "n"]).select("lang", "text").distinct().collect():
        sample.setdefault(lang, []).append(text.encode())
    return {k: sorted(v)[:per_language] for k, v in sample.items()}


def identify_languages(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE, learn_from: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from ``learn_from`` (default ``docs``), columns text and lang, rows
    whose crc32(doc_id) mod 5 is not 0. score is the predicted language's share
    of probability. Null texts and texts without a letter give 'und' and 0; so
    does everything if there is nothing to learn from. Null doc_ids are not held
    out. Repeated rows repeat; other columns are ignored.
    """
    source = (docs if learn_from is None else learn_from).select("doc_id", "text", "lang")
    sample = training_sample(source, per_language)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    if not sample:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = fit(sample)
    token = hash((tuple(model.langs), model.grams4.tobytes(), model.costs4.tobytes()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(model, token), f"doc_id {kind}, held_out boolean, lang_pred string, score double")

"""Toxicity scores from averaged subword-bag embeddings and a linear softmax.

A word's vector is the mean of the embeddings of its character 3- to 6-grams
(its borders count as characters), hashed into one table; a passage of ``_PASSAGE``
words is the mean of its words, and a linear softmax turns it into a probability.
Embeddings and softmax are trained together in numpy, from log odds of the
n-grams in the first dimension and small random numbers in the others. A text is
as toxic as its worst passage, and training follows that: the worst passages of
each text carry its label. A misspelling shares most of its n-grams with the
word it hides.

As averaging and the softmax's logit are linear, scoring needs only the logit of
each n-gram; words and passages are then averages of those. Training runs in one
task on a sample of bounded rows and bytes; only the logits reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import held_out, written

#: At most so many labelled texts of each class are learnt from, those of least hash.
TEXTS_PER_CLASS = 2_000
#: And so many bytes of them (one text at least); texts above LONG_TEXT bytes only if there are not enough others.
BYTES_PER_CLASS, LONG_TEXT = 8 << 20, 1 << 16
_BITS = 17
_BUCKETS = 1 << _BITS
_LENGTHS = (3, 4, 5, 6)
_DIMS = 8
#: Words of a passage; one starts at every word. This, the lengths of n-grams and their table, the decay, the first weight and bias and the number of steps were
#: chosen on the learnable rows whose crc32(doc_id) mod 5 is 1, trained on those of 2, 3 and 4.
_PASSAGE = 3
#: N-grams in fewer texts, counted over their words, keep a zero vector; decay keeps those of few from being learnt by heart.
_SEEN, _DECAY = 4, 1e-4
#: Added to the bias: toxic texts not learnt from score lower than those learnt. Chosen on the same fold.
_SHIFT = 0.2
#: Texts are scored in slices of about so many characters.
_SLICE = 1 << 19
_WORD = re.compile(r"[^\W_]+")
_LETTERS: list[np.ndarray] = []


@dataclass
class Model:
    logits: np.ndarray  # of each n-gram: embedding times softmax weight difference
    bias: float


def _table() -> np.ndarray:
    """Which code points are part of words: letters and digits."""
    if not len(_LETTERS):
        _LETTERS.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def ngrams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 3- to 6-grams of all words of lower-cased texts, in one pass.

    Returns, for each length, buckets and validity by position; then first and
    end positions of the words, and len(texts) + 1 offsets into these. The
    character before and after a word counts as its border.
    """
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n" * _LENGTHS[-1]).encode("utf-32-le", "replace"), dtype=np.uint32)
    inside = _table()[points]
    points = np.where(inside, points, np.uint32(1))
    change = np.diff(inside.view(np.int8))
    first, end = np.flatnonzero(change == 1) + 1, np.flatnonzero(change == -1) + 1
    out = []
    n = len(points) - _LENGTHS[-1] + 1
    h = points[:n] * np.uint32(0x85EBCA6B) + points[1 : n + 1]
    valid = np.ones(n, dtype=bool)
    for k in _LENGTHS:
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) + points[k - 1 : n + k - 1]
        valid = valid & inside[k - 2 : n + k - 2]
        out.append((((h ^ (h >> np.uint32(13))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS), valid))
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return out, first, end, np.searchsorted(first, bounds + 1)


def _passages(n: int) -> np.ndarray:
    """Starts of passages."""
    return np.arange(max(1, n - _PASSAGE + 1))


def fit(texts: list[str], labels: list[int], steps: int = 120, rate: float = 0.1, seed: int = 3) -> Model:
    """Embeddings and softmax weights by Adam on the logistic loss of the worst passages."""
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _WORD.findall(t.lower())], dtype=np.int32) for t in texts]
    y = np.array(labels, dtype=np.float64)
    have = np.array([len(d) > 0 for d in docs], dtype=bool)
    docs, y = [d for d, h in zip(docs, have, strict=True) if h], y[have]
    if not docs or y.min() == y.max():
        return Model(np.zeros(_BUCKETS, np.float32), -2.0 if not docs or y.max() == 0 else 2.0)
    names = list(vocabulary)
    by_length, begin, _, _ = ngrams(names)
    flat = np.concatenate([b[v] for b, v in by_length]).astype(np.int32)
    word_of = np.concatenate([(np.searchsorted(begin - 1, np.flatnonzero(v), "right") - 1).astype(np.int32) for _, v in by_length])
    del by_length, begin
    flat = flat[np.argsort(word_of, kind="stable")]
    lengths = np.bincount(word_of, minlength=len(names))
    del word_of
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])

    # Windows of word ids, all texts one after the other.
    stream = np.concatenate(docs)
    base = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    starts = np.concatenate([_passages(len(d)) + b for d, b in zip(docs, base[:-1], strict=True)]).astype(np.int32)
    owner = np.repeat(np.arange(len(docs), dtype=np.int32), [len(_passages(len(d))) for d in docs])
    ends = np.minimum(starts + _PASSAGE, base[owner + 1]).astype(np.int32)
    group = np.searchsorted(owner, np.arange(len(docs)))

    # The first dimension starts from how much oftener a gram is in toxic texts; the rest at random.
    texts_with = [np.bincount(np.concatenate([np.unique(d) for d, t in zip(docs, y, strict=True) if t == c]), minlength=len(names)) for c in (0, 1)]
    in_clean, in_toxic = (np.bincount(flat, weights=np.repeat(w, lengths), minlength=_BUCKETS) for w in texts_with)
    odds = np.log((in_toxic + 0.5) / (y.sum() + 1)) - np.log((in_clean + 0.5) / ((1 - y).sum() + 1))
    seen = np.minimum(1, (in_toxic + in_clean) / 8)
    common = in_toxic + in_clean >= _SEEN
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.01, (_BUCKETS, _DIMS))
    emb[:, 0] = np.clip(odds, -3, 3) * seen
    emb[~common] = 0
    weight, bias = rng.normal(0, 0.1, _DIMS), -4.0
    weight[0] = 4.0
    state = [np.zeros_like(emb), np.zeros_like(emb), np.zeros(_DIMS), np.zeros(_DIMS), np.zeros(1), np.zeros(1)]
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for step in range(1, steps + 1):
        word = np.add.reduceat((emb @ weight)[flat], first) / lengths
        sums = np.concatenate([[0], np.cumsum(word[stream])])
        score = (sums[ends] - sums[starts]) / (ends - starts)
        worst = np.maximum.reduceat(score, group)
        # Passages within reach of the worst one share its label's gradient.
        share = np.exp(np.clip(score - worst[owner], -30, 0) * 2.0)
        share[share < 0.2] = 0
        share /= np.add.reduceat(share, group)[owner]
        chosen = np.flatnonzero(share)
        p = 1 / (1 + np.exp(-np.clip(score[chosen] + bias, -60, 60)))
        pull = (p - y[owner[chosen]]) * share[chosen] * balance[owner[chosen]] / len(y)
        reach = ends[chosen] - starts[chosen]
        inside = np.repeat(starts[chosen], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        per_word = np.bincount(stream[inside], weights=np.repeat(pull / reach, reach), minlength=len(lengths)) / lengths
        touched = np.flatnonzero(per_word)
        reps = lengths[touched]
        at = np.repeat(first[touched], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        per_gram = np.bincount(flat[at], weights=np.repeat(per_word[touched], reps), minlength=_BUCKETS)
        rows = np.flatnonzero((per_gram != 0) & common)
        grads = (per_gram[rows, None] * weight[None, :] + _DECAY * emb[rows], per_gram[rows] @ emb[rows] + 1e-4 * weight, np.array([pull.sum()]))
        moves = []
        for k, g in enumerate(grads):
            m, v = (state[2 * k][rows], state[2 * k + 1][rows]) if k == 0 else (state[2 * k], state[2 * k + 1])
            m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
            if k == 0:
                state[0][rows], state[1][rows] = m, v
            else:
                state[2 * k], state[2 * k + 1] = m, v
            moves.append(rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-7))
        emb[rows] -= moves[0]
        weight -= moves[1]
        bias -= moves[2][0]
    return Model((emb @ weight).astype(np.float32), float(bias) + _SHIFT)


def logits(model: Model, texts: list[str | None]) -> np.ndarray:
    """The logit of each text's worst passage."""
    out = np.full(len(texts), min(model.bias, -2.0))
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size < _SLICE):
            size += len(texts[end] or "")
            end += 1
        by_length, first, till, at = ngrams([(t or "").lower() for t in texts[begin:end]])
        total, count = np.zeros(len(by_length[0][0])), np.zeros(len(by_length[0][0]), dtype=np.int64)
        for buckets, valid in by_length:
            total += np.where(valid, model.logits[buckets], 0)
            count += valid
        total, count = np.concatenate([[0], np.cumsum(total)]), np.concatenate([[0], np.cumsum(count)])
        words = (total[till - 1] - total[first - 1]) / np.maximum(1, count[till - 1] - count[first - 1])
        sums = np.concatenate([[0], np.cumsum(words)])
        for i in range(end - begin):
            a, b = at[i], at[i + 1]
            if b > a:
                s = _passages(b - a) + a
                e = np.minimum(s + _PASSAGE, b)
                out[begin + i] = ((sums[e] - sums[s]) / (e - s)).max() + model.bias
        begin = end
    return out


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(model, texts), -60, 60)))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = scores(model, batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """Whole labelled texts (text, toxic), per_class and BYTES_PER_CLASS of each label at most, held-out rows left aside.

    A doc_id with both labels counts as toxic.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    hashed = F.xxhash64(F.lit("tox"), "doc_id")
    picked = [known.where(F.col("toxic") == c).orderBy(hashed, "doc_id").limit(per_class) for c in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # 2 x per_class rows at most
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(ids, "doc_id")
    rows = rows.withColumns({"n": F.octet_length("text"), "h": hashed})
    order = [F.col("n") > LONG_TEXT, "h", "doc_id", F.xxhash64("text")]
    # Ids may repeat, so rows are bounded once more.
    kept = [rows.where(F.col("toxic") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    each = Window.partitionBy("toxic").orderBy(*order)
    kept = kept[0].unionByName(kept[1]).withColumns({"b": F.sum("n").over(each.rowsBetween(Window.unboundedPreceding, 0)), "r": F.row_number().over(each)})
    return kept.where((F.col("b") <= BYTES_PER_CLASS) | (F.col("r") == 1)).select("text", "toxic")


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted({(t, y) for b in batches for t, y in zip(*(c.to_pylist() for c in b.columns), strict=True)})
    model = fit([t for t, _ in rows], [y for _, y in rows])
    yield pa.record_batch([pa.array([model.logits.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["logits", "bias"])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = TEXTS_PER_CLASS) -> Model:
    """A model of the labelled texts of ``docs``; trained in one task, on the bounded sample."""
    sample = written(training_sample(docs, labels, per_class), "sample").coalesce(1)
    row = sample.mapInArrow(_train, "logits binary, bias double").first()
    return Model(np.frombuffer(row["logits"], np.float32), row["bias"]) if row else fit([], [])


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = TEXTS_PER_CLASS, learn_from: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Learns from rows of ``labels`` (doc_id, toxic) whose crc32(doc_id) mod 5 is
    not 0, with the texts of ``learn_from`` (default ``docs``). Null, empty and
    word-less texts get the score of no evidence, below 0.5. With labels of one
    class only, or none, every text gets one score. Repeated rows repeat; null
    doc_ids are scored and not held out; other columns are ignored.
    """
    model = learn(docs if learn_from is None else learn_from, labels, per_class)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = TEXTS_PER_CLASS, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns unchanged.

    The text is scored where it lies, so nothing is joined or shuffled. Scores
    are those of ``score_toxicity``: null, empty and word-less texts stay, and
    so does every row if there is nothing to learn from; repeated rows share
    their fate, null doc_ids are scored too.
    """
    model = learn(docs if learn_from is None else learn_from, labels, per_class)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            yield batch.filter(pa.array(scores(model, texts) < threshold))

    return docs.mapInArrow(run, docs.schema)

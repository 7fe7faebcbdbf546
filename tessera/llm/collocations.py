"""Collocations from vertical positional inverted lists.

Documents are cut into blocks; a block keeps, for every word, the sorted list of
its positions, with a gap wherever a piece ends. A frequent phrase is extended
by merge-joining its positions with the postings of the words one place on; the
length of the joined list is the phrase's exact frequency in the block, and
these lengths are summed over all blocks.

Blocks and sums talk in packed arrays: a block sends each bucket the phrases it
has met, sorted, with their list lengths; the bucket adds up all blocks, names
the frequent phrases and sends every block the names of those it has. So no
table of frequent phrases is broadcast, and rare phrases cost a few bytes once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import arrow_batches, written
from tessera.llm.words import mix
from tessera.operators.frame import with_position

#: Bytes of text of a block, and phrases that a bucket adds up, about.
BLOCK_BYTES, BUCKET_ENTRIES = 5 << 20, 1 << 20
ROWS = 1 << 16
_BREAK = 0xFF  # a byte that UTF-8 never has
_FOLD = bytes(_BREAK if b in b".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def packed(x: np.ndarray) -> bytes:
    """An array in planes of bytes, compressed: sorted and small numbers take a byte or two."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(raw: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


class _Ids(dict):
    """Numbers words as they come; the end of a piece is 0."""

    def __init__(self, at: list[int]) -> None:
        super().__init__({b"\xff": 0})
        self.at = at

    def __missing__(self, word: bytes) -> int:
        self.at[0] += 1
        self[word] = self.at[0]
        return self.at[0]


def inverted_lists(docs: DataFrame) -> DataFrame:
    """(block, lang, word, local, n, positions): the words of each block with their list lengths, and one row a block with all lists, in the order of ``local``."""
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("local", pa.int64()), ("n", pa.int64()), ("positions", pa.binary())])

    def lists(number: int, words: dict[str, _Ids], runs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate(runs)
        order = np.argsort(ids, kind="stable").astype(np.int32)
        counts = np.bincount(ids)
        yield pa.record_batch([[number], [None], [None], [None], [None], [packed(np.diff(order[counts[0] :], prepend=np.int32(0)))]], schema=schema)
        for lang, found in words.items():
            local = np.fromiter(found.values(), dtype=np.int64, count=len(found))[1:]
            text = pa.array(list(found)[1:], pa.binary()).cast(pa.string())
            for i in range(0, len(local), ROWS):
                some = local[i : i + ROWS]
                yield pa.record_batch([pa.array([number] * len(some)), pa.array([lang] * len(some)), text[i : i + ROWS], pa.array(some), pa.array(counts[some]), pa.nulls(len(some), pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        at, words, runs = [0], {}, []
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = text.translate(_FOLD).replace(b"\xff", b" \xff ").split()
                if not tokens:
                    continue
                ids = words[lang] if lang in words else words.setdefault(lang, _Ids(at))
                runs += [np.fromiter(map(ids.__getitem__, tokens), dtype=np.int32, count=len(tokens)), np.zeros(1, dtype=np.int32)]
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield from lists(number, words, runs)
                    number, size, at, words, runs = number + 1, 0, [0], {}, []
        if runs:
            yield from lists(number, words, runs)

    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return read.mapInArrow(run, "block long, lang string, word string, local long, n long, positions binary")


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (a, b), and where in it each pair begins, and how long it runs."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


_ASKED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary())])
_ASKED_SQL = "bucket long, block long, kind string, a binary, b binary, n binary"


def _row(bucket: int | None, block: int | None, kind: str, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([bucket], pa.int64()), pa.array([block], pa.int64()), [kind], [packed(a)], [packed(b)], [packed(n)]], schema=_ASKED)


def _asked(block: int, a: np.ndarray, b: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The distinct pairs (prefix, word) of a block with their numbers of occurrences, a row a bucket."""
    order, first, n = _distinct(a, b)
    a, b = a[order[first]], b[order[first]]
    n = n.astype(np.uint32)
    del order, first
    bucket = (mix(mix(a.astype(np.uint64)) ^ b.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        at = by[ends[k] : ends[k + 1]]
        yield _row(k, block, "asked", np.diff(a[at].astype(np.int64), prepend=0), b[at].astype(np.uint32), n[at])


def _add_up(least: int):
    """Of a bucket: 'named' rows (name, prefix, word, frequency in a, b, n) of the frequent pairs, and for each block the names of those it has."""

    def run(key, table):
        bucket = key[0].as_py()
        blocks = table.column("block").to_numpy()
        a = [np.cumsum(unpacked(x, np.int64)) for x in table.column("a").to_pylist()]
        b = [unpacked(x, np.uint32) for x in table.column("b").to_pylist()]
        n = [unpacked(x, np.uint32) for x in table.column("n").to_pylist()]
        source = np.repeat(np.arange(len(a)), [len(x) for x in a])
        a, b, n = np.concatenate(a), np.concatenate(b), np.concatenate(n).astype(np.int64)
        order, first, runs = _distinct(a, b)
        total = np.add.reduceat(n[order], first)
        often = total >= least
        name = (bucket << 32) + np.cumsum(often) - 1
        out = [_row(bucket, None, "named", a[order[first[often]]], b[order[first[often]]], np.concatenate([name[often], total[often]]))]
        per = np.repeat(np.where(often, name, -1), runs)
        names = np.empty(len(per), dtype=np.int64)
        names[order] = per
        kept = np.flatnonzero(names >= 0)
        ends = np.searchsorted(source[kept], np.arange(len(blocks) + 1))
        for i in np.flatnonzero(np.diff(ends)).tolist():
            at = kept[ends[i] : ends[i + 1]]
            out.append(_row(None, int(blocks[i]), "names", a[at], b[at], names[at]))
        return pa.Table.from_batches(out, schema=_ASKED)

    return run


def _joined(starts: np.ndarray, length: int, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge join: which phrase occurrences have a posting right behind them, and which posting that is."""
    at = np.searchsorted(positions, starts + length)
    hit = np.flatnonzero((at < len(positions)) & (positions[np.minimum(at, len(positions) - 1)] == starts + length)) if len(positions) else np.zeros(0, dtype=np.int64)
    return hit, at[hit]


def _first_pairs(buckets: int):
    """Of a block: its lists of frequent words in order of position ('words'), and its pairs of neighbouring words."""

    def run(key, table):
        block = key[0].as_py()
        lists = table.filter(pc.is_valid(table.column("positions"))).column("positions").to_pylist()
        words = table.filter(pc.is_valid(table.column("local")))
        local, n, name = (words.column(c).to_numpy() for c in ("local", "n", "name"))
        order = np.argsort(local)
        at = np.cumsum(unpacked(lists[0], np.int32), dtype=np.int32) if lists else np.zeros(0, dtype=np.int32)
        n, name = n[order], name[order]
        ids = np.repeat(name.astype(np.int32), n)  # frequent words are fewer than 2^31
        often = ids >= 0
        positions, ids = at[often], ids[often]
        order = np.argsort(positions)
        positions, ids = positions[order], ids[order]
        del at, often, order
        gaps = np.minimum(np.diff(positions, prepend=np.int32(0)), 255).astype(np.uint8)  # what matters is only whether words are neighbours
        out = [_row(None, block, "words", gaps, ids.astype(np.uint32), np.zeros(0))]
        hit, behind = _joined(positions, 1, positions)
        del positions, gaps
        return pa.Table.from_batches([*out, *_asked(block, ids[hit], ids[behind], buckets)], schema=_ASKED)

    return run


def _longer(length: int, buckets: int):
    """Of a block: occurrences of the named phrases of ``length`` words, extended by a word."""

    def run(key, table):
        block = key[0].as_py()
        rows = table.to_pylist()
        words = next((r for r in rows if r["kind"] == "words"), None)
        if words is None:
            return pa.Table.from_batches([], schema=_ASKED)
        positions = np.cumsum(unpacked(words["a"], np.uint8), dtype=np.int64)
        ids = unpacked(words["b"], np.uint32).astype(np.int64)
        starts, phrase = positions, ids
        for size in range(1, length):
            said = [r for r in rows if r["kind"] == f"names{size + 1}"]
            a, b, name = (np.concatenate([unpacked(r[c], t) for r in said] or [np.zeros(0, dtype=t)]).astype(np.int64) for c, t in (("a", np.int64), ("b", np.uint32), ("n", np.int64)))
            hit, behind = _joined(starts, size, positions)
            prefixes = np.unique(a)
            width = np.int64(1 << 32)
            known = np.searchsorted(prefixes, a) * width + b
            order = np.argsort(known)
            pre = np.searchsorted(prefixes, phrase[hit])
            pre = np.where((pre < len(prefixes)) & (prefixes[np.minimum(pre, len(prefixes) - 1)] == phrase[hit]), pre, -1) if len(prefixes) else np.full(len(hit), -1)
            asked = np.where(pre >= 0, pre * width + ids[behind], -1)
            at = np.searchsorted(known[order], asked)
            named = (at < len(known)) & (known[order[np.minimum(at, len(known) - 1)]] == asked) if len(known) else np.zeros(len(hit), dtype=bool)
            starts, phrase = starts[hit[named]], name[order[at[named]]]
        hit, behind = _joined(starts, length, positions)
        return pa.Table.from_batches(list(_asked(block, phrase[hit], ids[behind], buckets)), schema=_ASKED)

    return run


def _named_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, n in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n")), strict=True):
            name, total = unpacked(n, np.int64).reshape(2, -1)
            prefix, word = unpacked(a, np.int64), unpacked(b, np.uint32).astype(np.int64)
            for i in range(0, len(name), ROWS):
                yield pa.record_batch([pa.array(x[i : i + ROWS]) for x in (name, prefix, word, total)], names=["id", "prefix", "word", "f"])


def frequent_phrases(docs: DataFrame, least: int = 10, longest: int = 3) -> tuple[DataFrame, DataFrame]:
    """((lang, words array, f) of all phrases of 1 to ``longest`` words that occur ``least`` times or more, (lang, n) of all languages).

    Every phrase's words and beginnings are as frequent, so only frequent ones are extended.
    """
    with arrow_batches(docs.sparkSession, 1_000):
        index = written(inverted_lists(docs), "index")
    words = index.where("word is not null")
    counted = written(words.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    named = written(with_position(counted.where(F.col("f") >= least), ["lang", "word"]), "frequent_words")
    if (named.agg(F.max("__pos")).first()[0] or 0) >= 1 << 31:
        raise ValueError("more frequent words than 32 bits can name")
    whole = counted.agg(F.sum("f").alias("n")).first()["n"] or 0
    buckets = max(8, -(-whole // BUCKET_ENTRIES))

    told = words.join(named.select("lang", "word", F.col("__pos").alias("name")), ["lang", "word"], "left")
    told = told.select("block", "local", "n", F.coalesce("name", F.lit(-1)).alias("name"), F.lit(None).cast("binary").alias("positions"))
    lists = index.where("positions is not null").select("block", F.lit(None).cast("long").alias("local"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("name"), "positions")
    asked = written(told.unionByName(lists).groupBy("block").applyInArrow(_first_pairs(buckets), _ASKED_SQL), "pairs")
    state = asked.where("kind = 'words'")

    phrases = named.select(F.col("__pos").alias("id"), "lang", F.array("word").alias("words"), "f")
    found, last = phrases, phrases
    for length in range(2, longest + 1):
        added = written(asked.where("kind = 'asked'").groupBy("bucket").applyInArrow(_add_up(least), _ASKED_SQL), "names")
        new = added.where("kind = 'named'").mapInArrow(_named_rows, "id long, prefix long, word long, f long")
        heads = last.select(F.col("id").alias("prefix"), "lang", F.col("words").alias("head"))
        tails = named.select(F.col("__pos").alias("word"), F.col("word").alias("tail"))
        last = new.join(heads, "prefix").join(tails, "word").select("id", "lang", F.concat("head", F.array("tail")).alias("words"), "f")
        last = written(last, "phrases")
        found = found.unionByName(last)
        if length < longest:
            state = state.unionByName(added.where("kind = 'names'").withColumn("kind", F.lit(f"names{length}")))
            asked = written(state.groupBy("block").applyInArrow(_longer(length, buckets), _ASKED_SQL), "pairs")
    return written(found.drop("id"), "phrases"), totals


def mine_collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words by their weakest cut.

    Texts are cut into pieces at . , ; : ! ? and line ends, and these into words
    at spaces and tabs, A-Z as a-z. a, l and r are the occurrences of the phrase
    and of both sides of the cut whose floor(10^6 a a / (l r)), the score, is
    least (the earliest of ties); n counts all words of the language. Phrases of
    fewer than ``least`` occurrences do not count, nor those that lie inside a
    longer one with at least ``share`` percent of their occurrences. Rank by
    score, a, then phrase.

    Null lang is ``und``; null, empty and wordless texts add nothing; repeated
    rows count again; an empty table gives no rows. Other columns do not matter.
    """
    phrases, totals = frequent_phrases(docs, least, longest)
    size = F.size("words")
    long_ = phrases.where(size > 1)
    part = lambda mark: phrases.select("lang", F.col("words").alias(mark), F.col("f").alias(f"f_{mark}"))
    cuts = long_.select("lang", "words", "f", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("right"))
    cuts = cuts.join(part("left"), ["lang", "left"]).join(part("right"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", wide("f") * wide("f") * F.lit(1_000_000).cast("decimal(7,0)"), wide("f_left") * wide("f_right"))
    best = cuts.withColumn("score", score).groupBy("lang", "words").agg(F.max("f").alias("a"), F.min(F.struct("score", "k", "f_left", "f_right")).alias("cut"))
    inner = long_.where(size > 2).select("lang", "words", "f", F.explode(F.sequence(F.lit(2), size - 1)).alias("m")).select("*", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at"))
    inner = inner.select("lang", F.slice("words", F.col("at"), F.col("m")).alias("words"), "f").groupBy("lang", "words").agg(F.max("f").alias("longer"))
    kept = best.join(inner, ["lang", "words"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    rows = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", F.col("cut.f_left").alias("l"), F.col("cut.f_right").alias("r"), F.col("cut.score").cast("long").alias("score"))
    # The best of each share of a language first, so that no task sorts all its phrases; shares are as many as balances both rounds.
    best_first = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    shares = max(1, math.isqrt(phrases.count() // top))
    within = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*best_first)
    rows = rows.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
piece AS (SELECT id, lang, p, row_number() OVER () AS piece FROM (SELECT id, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
word AS (SELECT lang, piece, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM piece)),
run AS (SELECT lang, w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM word WINDOW s AS (PARTITION BY piece ORDER BY pos)),
f1 AS (SELECT lang, w1, count(*) AS f FROM run GROUP BY 1, 2),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM run WHERE w2 IS NOT NULL GROUP BY 1, 2, 3),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM run WHERE w3 IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY 1, 2, 3),
cut AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, 1 AS k, f2.f AS a, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2 LEFT JOIN longer g ON g.lang = f2.lang AND g.w1 = f2.w1 AND g.w2 = f2.w2
  WHERE f2.f >= 10 AND (g.f IS NULL OR 100 * g.f < 50 * f2.f)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, x.f, y.f FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f2 y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, x.f, y.f FROM f3 t JOIN f2 x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, CAST(1000000::HUGEINT * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cut),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, CAST((SELECT sum(f) FROM f1 WHERE f1.lang = ranked.lang) AS BIGINT) AS n, score FROM ranked WHERE rank <= 2000
"""

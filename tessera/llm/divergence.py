"""Source divergence audit: how the word use of each source departs from its language's.

Documents are counted once, in the task that reads them, by language, source and
term. The document frequencies of all tasks are merged into one count-min sketch
that never underestimates, so a term that the sketch knows too few documents of
is dropped before anything is shuffled. The rest is counted exactly in one
shuffle. Sources are then compared over the terms they share; a term that one
side lacks has that side's least probability, so it needs no row there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import small_enough, written
from tessera.llm.words import mix

_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Entries that a task counts before it passes them on, and rows of a batch.
ENTRIES, ROWS = 1 << 19, 1 << 16
#: Rows of the sketch, and least and most cells of a row; packed by fours, it is 16 MB at most.
DEPTH, LEAST_CELLS, MOST_CELLS = 4, 1 << 16, 1 << 24
#: Cells of a piece in which sketches are merged, and sketches merged at a time.
PIECE, FAN = 1 << 16, 32
#: Groups (language, source) of up to so many rows are broadcast.
BROADCAST_ROWS = 100_000
UNIT = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df) of each task: occurrences and documents; a row of null term for every group. Not summed up over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in found.items():
                terms = list(n)
                for i in range(0, max(1, len(terms)), ROWS):
                    some = terms[i : i + ROWS]
                    text = pa.array([*some, None], pa.binary()).cast(pa.string())
                    fill = lambda x: pa.array([x] * (len(some) + 1), pa.string())  # noqa: B023, E731
                    count = lambda c: pa.array([*map(c.__getitem__, some), 0], pa.int64())  # noqa: B023, E731
                    yield pa.record_batch([fill(lang), fill(source), text, count(n), count(df)], names=["lang", "source", "term", "n", "df"])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, df = found.setdefault((lang, source), (Counter(), Counter()))
                words = text.translate(_TERMS).split()
                n.update(words)
                df.update(set(words))
            if sum(len(n) for n, _ in found.values()) >= ENTRIES:
                yield from rows()
                found = {}
        yield from rows()

    read = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")]
    return docs.select(read[0].alias("lang"), read[1].alias("source"), read[2].cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term string, n long, df long")


class Sketch:
    """A count-min sketch of ``DEPTH`` rows whose cells stop at ``most`` (3 at most)."""

    def __init__(self, cells: int, most: int) -> None:
        self.cells, self.most = cells, most
        self.counts = np.zeros((DEPTH, cells), dtype=np.uint8)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """(DEPTH, keys) cells of 64-bit hashes."""
        h = hashes.view(np.uint64)
        return np.stack([(mix(h ^ np.uint64(0x9FB21C651E98DF25 * (i + 1) & (1 << 64) - 1)) % np.uint64(self.cells)).astype(np.int64) for i in range(DEPTH)])

    def add(self, hashes: np.ndarray, amounts: np.ndarray) -> None:
        for row, at in zip(self.counts, self.places(hashes), strict=True):
            cells, inverse = np.unique(at, return_inverse=True)
            row[cells] = np.minimum(self.most, row[cells] + np.bincount(inverse, weights=amounts)).astype(np.uint8)

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        """Never less than the true count, up to ``most``."""
        return self.counts[np.arange(DEPTH)[:, None], self.places(hashes)].min(axis=0)


def _packed(counts: np.ndarray) -> bytes:
    c = counts.reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8)
    return np.stack([b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6], axis=1).reshape(-1)


def merged_sketch(counts: DataFrame, key: Column, amount: str, most: int, distinct: int) -> Sketch:
    """One sketch of all rows of ``counts``: a sketch a task, merged piece by piece, FAN at a time."""
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (2 * distinct).bit_length()))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch(cells, most)
        for batch in batches:
            own.add(batch.column(0).to_numpy(), np.minimum(most, batch.column(1).to_numpy()))
        flat = own.counts.reshape(-1, PIECE)
        used = np.flatnonzero(flat.any(axis=1))
        task = TaskContext.get().partitionId()
        for i in used.tolist():
            yield pa.record_batch([pa.array([i]), pa.array([task], pa.int64()), pa.array([_packed(flat[i])])], names=["piece", "part", "cells"])

    def merge(key, table):
        total = np.zeros(PIECE, dtype=np.uint8)
        for raw in table.column("cells").to_pylist():
            total = np.minimum(most, total + _unpacked(raw))
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "cells": pa.array([_packed(total)], pa.binary())})

    schema = "piece long, part long, cells binary"
    read = counts.select(key, F.col(amount).cast("long"))
    parts, pieces = read.rdd.getNumPartitions(), read.mapInArrow(sketch, schema)
    while True:
        pieces = pieces.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("piece", "part").applyInArrow(merge, schema)
        parts = -(-parts // FAN)
        if parts <= 1:
            break
        pieces = written(pieces, "sketch")
    out = Sketch(cells, most)
    flat = out.counts.reshape(-1, PIECE)
    for r in pieces.collect():  # 16 MB at most
        flat[r["piece"]] = _unpacked(r["cells"])
    return out


def _p(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + v)), exact; null if there is nothing to divide by."""
    return (F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), F.nullif(total + v, F.lit(0)).cast("decimal(20,0)"))).cast("long")


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit_sources(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): for every source of a language its divergence from each other one, and its ``top`` terms above the language.

    Terms are runs of letters (A-Z as a-z) and bytes above 127; a language keeps
    those in ``least`` (1 to 3) of its documents. p = 1 + floor(10^9 (n + 1) /
    (N + V)) of a term in a source, q likewise; a term weighs floor((p - q)^2 / q).
    Part ``pair`` sums that over all kept terms against each other source (0
    without terms), part ``term`` ranks the kept terms of the source with p > q
    of the language. Ranks from 1 by value, largest first, then item.

    Null lang, source and text are ''. Every row is a document, also repeated
    ones. Sources without terms count with V terms of no occurrence. An empty
    table gives no rows. Other columns do not matter.
    """
    if not 1 <= least <= 3:
        raise ValueError("least must be 1, 2 or 3")
    counts = written(term_counts(docs), "term_counts")
    terms = counts.where("term is not null")
    key = F.xxhash64("lang", "term")
    distinct = terms.agg(F.approx_count_distinct(key).alias("n")).first()["n"] or 0
    sent = docs.sparkSession.sparkContext.broadcast(merged_sketch(terms, key, "df", least, distinct))

    @F.pandas_udf("boolean")
    def possible(h):
        import pandas as pd

        return pd.Series(sent.value.estimate(h.to_numpy()) >= least)

    # One shuffle by language and term serves both the sums and the windows.
    exact = terms.where(possible(key)).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    same = Window.partitionBy("lang", "term")
    kept = exact.withColumns({"df": F.sum("df").over(same), "c": F.sum("n").over(same), "one": (F.min("source").over(same) == F.col("source")).cast("long")})
    kept = written(kept.where(F.col("df") >= least).drop("df"), "kept_terms")

    groups = counts.select("lang", "source").distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"), F.sum("one").alias("one"))
    groups = groups.join(own, ["lang", "source"], "left").fillna(0)
    whole = Window.partitionBy("lang")
    stats = groups.select("lang", "source", F.col("n").alias("total"), "terms", F.sum("one").over(whole).alias("v"), F.sum("n").over(whole).alias("all"))
    stats = written(stats.withColumn("zero", _p(F.lit(0).cast("long"), F.col("total"), F.col("v"))), "groups")
    small = small_enough(stats, BROADCAST_ROWS)
    sized = F.broadcast(stats) if small else stats

    rows = kept.join(sized, ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("total"), F.col("v")))
    q = _p(F.col("c"), F.col("all"), F.col("v"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    found = rows.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    found = found.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    # Sum over all terms = (neither) + (source only) + (other only) + (both), the first three from counts of equal p.
    side = lambda mark: rows.select("lang", "term", F.col("source").alias(f"s{mark}"), F.col("p").alias(f"p{mark}"), F.col("zero").alias(f"z{mark}"))
    pa_, pb, za, zb = (F.col(c) for c in ("pa", "pb", "za", "zb"))
    both = side("a").join(side("b"), ["lang", "term"]).where("sa <> sb").select("lang", "sa", "sb", (_f(pa_, pb) - _f(pa_, zb) - _f(za, pb) + _f(za, zb)).alias("v"))
    levels = rows.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("m"))
    level = lambda mark: levels.select("lang", F.col("source").alias(f"s{mark}"), F.col("p").alias(f"p{mark}"), F.col("zero").alias(f"z{mark}"), "m")
    other = lambda mark: sized.select("lang", F.col("source").alias(f"s{mark}"), F.col("zero").alias(f"z{mark}"), F.col("terms").alias(f"t{mark}"), F.col("v").alias("size"))
    first = level("a").join(other("b"), "lang").where("sa <> sb").select("lang", "sa", "sb", (_f(pa_, zb) * F.col("m")).alias("v"))
    second = level("b").join(other("a"), "lang").where("sa <> sb").select("lang", "sa", "sb", (_f(za, pb) * F.col("m")).alias("v"))
    neither = stats.select("lang", F.col("source").alias("sa"), F.col("zero").alias("za"), F.col("terms").alias("ta")).join(other("b"), "lang").where("sa <> sb")
    neither = neither.select("lang", "sa", "sb", F.coalesce((F.col("size") - F.col("ta") - F.col("tb")) * _f(za, zb), F.lit(0)).alias("v"))
    pairs = both.unionByName(first).unionByName(second).unionByName(neither).groupBy("lang", "sa", "sb").agg(F.sum("v").alias("value"))
    pairs = pairs.select("lang", F.col("sa").alias("source"), F.lit("pair").alias("part"), F.col("sb").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(found)


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
cell AS (SELECT g.lang, g.source, kept.term, kept.c, coalesce(n.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT *, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p,
             1 + 1000000000::HUGEINT * (c + 1) // (SELECT sum(k.c) + count(*) FROM kept k WHERE k.lang = cell.lang) AS q FROM cell),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
found AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM found))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

"""URL filters by a cascade of Bloom filters.

Level 1 of a cascade encodes the listed keys, level 2 those keys of the corpus
that level 1 takes for listed though they are not, level 3 the listed keys that
level 2 takes for such, and so on until a level has nothing left to encode. For
every key of the corpus (the universe that the cascade was built over) the first
level that says no then settles membership exactly: no key is joined with the
list when URLs are judged, and each task only holds a few bits a listed key.

A URL's keys are its host and all parent domains, each with the beginnings of
the path that have the length of some rule's path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import forget, written
from tessera.llm.words import mix

#: Share of other keys that level 1 lets through, and that all further levels do.
FIRST_RATE, RATE = 1 / 64, 1 / 2
#: A cascade of more bytes raises: it is sent to every executor. About 100 million listed keys.
MOST_BYTES = 256 << 20
MOST_LEVELS = 200
#: The rules of the query: host and path, and what becomes of the URLs under them.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def digests(keys: list[str]) -> np.ndarray:
    """Two 64-bit halves of the keys' BLAKE2b, so that no two keys are confused on purpose or by chance."""
    raw = b"".join(blake2b(k.encode(), digest_size=16).digest() for k in keys)
    return np.frombuffer(raw, dtype="<u8").reshape(-1, 2)


class Level:
    """One Bloom filter: ``bits`` positions, ``hashes`` of them a key, drawn anew for each level."""

    def __init__(self, number: int, keys: int, rate: float) -> None:
        self.number = number
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = max(64, math.ceil(keys * -math.log2(rate) / math.log(2)))
        self.words = np.zeros(-(-self.bits // 64), dtype=np.uint64)

    def positions(self, digest: np.ndarray) -> np.ndarray:
        """(keys, hashes) bit positions."""
        salt = mix(np.array([self.number, self.number + (1 << 32)], dtype=np.uint64))
        a, b = mix(digest[:, 0] ^ salt[0]), mix(digest[:, 1] ^ salt[1]) | np.uint64(1)
        return (a[:, None] + np.arange(self.hashes, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(self.bits)

    def holds(self, digest: np.ndarray) -> np.ndarray:
        at = self.positions(digest)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)

    def filled(self, keys: DataFrame) -> Level:
        """With the bits of all ``keys``, set by one aggregation whose rows are words of the filter."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(self.positions(digests(batch.column(0).to_pylist())))
                bit = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
                yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["word", "bits"])

        for r in keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():  # at most MOST_BYTES / 8 rows
            self.words[r["word"]] = np.uint64(r["bits"] & (1 << 64) - 1)
        return self


class Cascade:
    """Levels of Bloom filters; exact for all keys of the universe it was built over."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    def member(self, digest: np.ndarray) -> np.ndarray:
        """Which of the keys are listed."""
        out, live = np.zeros(len(digest), dtype=bool), np.arange(len(digest))
        for i, level in enumerate(self.levels):
            passed = level.holds(digest[live])
            out[live[~passed]] = i % 2 == 1  # an odd level excludes what it holds not
            live = live[passed]
        out[live] = len(self.levels) % 2 == 1
        return out


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    """The keys (one column) that a level holds."""
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(sent.value.holds(digests(batch.column(0).to_pylist()))))

    return keys.mapInArrow(run, keys.schema)


def build_cascade(listed: DataFrame, universe: DataFrame, most_bytes: int = MOST_BYTES) -> Cascade:
    """A cascade for ``listed`` (column key) that is exact on ``universe`` (column key, repeats allowed) and on ``listed``.

    The universe is read once, for level 1; further levels only see the keys
    that the last ones confused, about half as many each time. Null keys do not
    count. A cascade above ``most_bytes`` raises: split the list by a hash then.
    """
    keep = ins = written(listed.select("key").where("key is not null").distinct(), "listed")
    n, levels, size, made = ins.count(), [], 0, [ins]
    others, rate = None, FIRST_RATE
    while n:
        level = Level(len(levels), n, rate)
        size += level.words.nbytes
        if size > most_bytes:
            raise ValueError(f"a cascade of more than {most_bytes} bytes")
        if len(levels) >= MOST_LEVELS:
            raise RuntimeError("the cascade does not end")
        levels.append(level.filled(ins))
        seen = universe.select("key").where("key is not null") if others is None else others
        passed = _passing(seen, level)
        if others is None:  # few: what level 1 lets through
            passed = passed.distinct().join(keep, "key", "left_anti")
        others, ins = ins, written(passed, "confused")
        made.append(ins)
        n, rate = ins.count(), RATE
    forget(*made)
    return Cascade(levels)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to / ? # or the end, A-Z lower-cased; path from there up to ? or #. Both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All domains of the host (longest first) with all beginnings of the path of the given lengths, longest keys first; ties by the longer domain."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)])
    made = F.flatten(F.transform(domains, lambda d: F.transform(F.filter(starts, lambda s: s.isNotNull()), lambda s: F.struct((-F.length(d) - F.length(s)).alias("n"), (-F.length(d)).alias("m"), F.concat(d, s).alias("key")))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(made), lambda x: x["key"]))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """All columns of ``pages`` with host, path, rule and verdict. ``rules`` has key (host and path, like ``net/``) and verdict (allow or block).

    A rule fits its host and all subdomains where the URL's path begins with the
    rule's. The longest rule wins, of equally long ones that of the longer host;
    a key listed with both verdicts blocks. Without a rule the verdict is
    ``default``. Null, empty and malformed URLs have empty host and path and no
    rule. Rules without a host fit nothing; null keys and verdicts do not count.
    An empty rule list gives every page the default, an empty page table no rows.
    Repeated rows are judged each. Columns of the made names or beginning with
    __ are dropped from the input.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict") and not c.startswith("__")]
    rules = rules.select(F.col("key").cast("string").alias("key"), F.col("verdict").cast("string").alias("verdict")).where("key is not null and verdict is not null")
    at = F.when(F.instr("key", "/") > 0, F.length("key") - F.instr("key", "/") + 1).otherwise(0)
    lengths = [r[0] for r in rules.select(at.alias("n")).distinct().orderBy("n").collect()] or [0]  # at most as many as a path has characters
    host, path = url_parts(F.col(url).cast("string"))
    split = pages.withColumns({"__host": host, "__path": path}).withColumn("__keys", url_keys(F.col("__host"), F.col("__path"), lengths))
    universe = split.select(F.explode("__keys").alias("key"))
    listed = build_cascade(rules, universe, most_bytes)
    blocked = build_cascade(rules.where("verdict = 'block'"), rules, most_bytes)
    sent = pages.sparkSession.sparkContext.broadcast((listed, blocked))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, blocked = sent.value
        for batch in batches:
            keys = batch.column(batch.num_columns - 1)
            flat, row = keys.flatten(), np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
            digest = digests(flat.to_pylist())
            hit = np.flatnonzero(listed.member(digest))
            rows, first = np.unique(row[hit], return_index=True)
            best = hit[first]
            take = np.full(len(keys), -1)
            take[rows] = best
            block = np.zeros(len(keys), dtype=bool)
            block[rows] = blocked.member(digest[best])
            rule = flat.take(pa.array(take, mask=take < 0))
            verdict = np.where(block, "block", np.where(take >= 0, "allow", default))
            yield pa.record_batch([*batch.columns[:-1], rule, pa.array(verdict.tolist(), pa.string())], names=[*batch.schema.names[:-1], "rule", "verdict"])

    out = split.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), "__keys")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1]), "rule string, verdict string"])
    return out.mapInArrow(judge, schema)


ORACLE_SQL = """
WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
parts AS (SELECT page_id, row_number() OVER () AS id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts),
rules(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
fits AS (SELECT id, rule, verdict, row_number() OVER (PARTITION BY id ORDER BY length(rule) DESC) AS best FROM parts, rules
         WHERE ('.' || host || chr(10)) LIKE '%.' || split_part(rule, '/', 1) || chr(10) AND starts_with(path, substr(rule, strpos(rule, '/'))))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE best = 1) f USING (id)
"""

"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every window of 10 words (or of all words of a shorter item) is represented by
the least hash among its k-grams. Equal windows have equal least hashes, so
joining the fingerprints of documents and items misses no shared window; the
windows behind a joint fingerprint are then compared word by word, which extends
hits over every word they cover.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import fresh, small_enough, written

#: Benchmark tables of up to so many fingerprints (16 bytes each) or windows are broadcast, larger ones shuffled.
BROADCAST_ROWS = 50_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = "".join(map(chr, [*range(1, 32), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128)]))


def word_list(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII characters; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\0" + _UPPER + _BREAKS, " " + _UPPER.lower() + " " * len(_BREAKS))
    return F.array_remove(F.split(plain, " "), "")


def _starts(size: Column, window: int) -> Column:
    return F.when(size >= window, F.sequence(F.lit(1), size - (window - 1))).otherwise(F.array().cast("array<int>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often its lambdas ask for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _least(words: Column, window: int, k: int) -> Column:
    """The least k-gram hash of every window, in order."""
    k = min(k, window)
    across = window - k + 1

    def least(grams: Column) -> Column:
        return F.transform(_starts(F.size(grams), across), lambda i: F.array_min(F.slice(grams, i, across)))

    def of(hashes: Column) -> Column:
        grams = F.transform(_starts(F.size(hashes), k), lambda i: F.xxhash64(F.slice(hashes, i, k)))
        return grams if across == 1 else let(grams, least)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


def _print(length: int, window: int, least: Column) -> Column:
    """A fingerprint of windows of this length: the least hash itself for the usual one."""
    return least if length == window else F.xxhash64(F.lit(length), least)


def _prints(words: Column, lengths: list[int], window: int, k: int) -> Column:
    """The distinct fingerprints of all windows of these lengths."""

    def of(n: int) -> Column:
        least = _least(words, n, k)
        return least if n == window else F.transform(least, lambda x: _print(n, window, x))

    return F.array_distinct(F.concat(*map(of, lengths)))


def _windows(items: DataFrame, lengths: list[int], window: int, k: int) -> DataFrame:
    """Distinct (item_id, win, fp) of the windows of ``items``, a whole item if it is shorter."""
    n = F.least(F.size("words"), F.lit(window))
    each = items.withColumn("n", n).select("item_id", "n", F.explode(F.when(F.size("words") > window, F.sequence(F.lit(1), F.size("words") - window + 1)).otherwise(F.array(F.lit(1)))).alias("i"), "words")
    each = each.select("item_id", "n", F.slice("words", F.col("i"), F.col("n")).alias("w"))
    fp = F.coalesce(*[F.when(F.col("n") == m, _print(m, window, F.get(_least(F.col("w"), m, k), F.lit(0)))) for m in lengths])
    return each.select("item_id", F.array_join("w", " ").alias("win"), fp.alias("fp")).distinct()


def _hits(docs: DataFrame, known: DataFrame, lengths: list[int], window: int, k: int) -> DataFrame:
    """(__id, __text, start, length, win) of every window of ``known`` in ``docs``, whose texts are read once for all lengths."""
    prints = _maybe_broadcast(known.select("fp").distinct())
    own = let(word_list(F.col("text")), lambda w: _prints(w, lengths, window, k))
    found = docs.select("__id", "__text", F.explode(own).alias("fp")).join(prints, "fp")
    found = written(found.groupBy("__id", "__text").agg(F.collect_set("fp").alias("fps")), "prints")
    texts = docs.join(found, ["__id", "__text"]).select("__id", "__text", "text", "fps").dropDuplicates(["__id", "__text"])

    def places(words: Column) -> Column:
        def of(n: int) -> Column:
            at = let(_least(words, n, k), lambda least: F.filter(_starts(F.size(least), 1), lambda i: F.array_contains("fps", _print(n, window, F.get(least, i - 1)))))
            return F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), F.array_join(F.slice(words, i, n), " ").alias("win")))

        return F.concat(*[of(n) for n in lengths])

    spans = texts.select("__id", "__text", F.inline(let(word_list(F.col("text")), places)))
    return spans.join(_maybe_broadcast(known.select("win").distinct()), "win")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if any occurrence of a window of ``benchmark`` covers it. Null
    texts have no words; items without words are ignored; items of a null
    item_id hit words but are not counted. Repeated rows repeat; rows of one
    doc_id and different texts are judged apart. Other columns are ignored.
    """
    return _judged(docs, benchmark, window, k).drop("__text")


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """find_contamination with the hash of each row's text, __text."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    docs = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__text": F.xxhash64("text")})
    items = benchmark.select("item_id", word_list(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    items = written(items, "items")
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(window))).distinct().collect())  # at most ``window`` numbers
    base = docs.select("doc_id", "__id", "__text", F.size(word_list(F.col("text"))).cast("long").alias("n_words"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    if not lengths:
        return base.select("doc_id", "__text", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    known = written(_windows(items, lengths, window, k), "windows")
    hits = written(_hits(docs, known, lengths, window, k), "hits")
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "length")), lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    per_doc = hits.groupBy("__id", "__text").agg(F.size(covered).cast("long").alias("n_hit"))
    # However often a window occurs in a document, it meets its items once.
    by_item = hits.select("__id", "__text", "win").distinct().join(_maybe_broadcast(known.select("win", "item_id")), "win").groupBy("__id", "__text").agg(ids.alias("ids"))
    by_item = by_item.select("__id", "__text", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"))
    per_doc = per_doc.join(by_item, ["__id", "__text"], "left")
    zero = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", zero)
    return base.join(per_doc, ["__id", "__text"], "left").select("doc_id", "__text", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The rows of ``docs`` that share no window with ``benchmark``, all columns unchanged.

    Rows are judged by doc_id and text, nulls included: of rows that share a
    doc_id, or have none, only the contaminated texts go. Null, empty and
    word-less texts stay; an empty ``benchmark`` drops nothing. doc_id is a
    number or the text of one; other texts raise. Other columns may have any name.
    """
    own, text = fresh("__bad", docs.columns), fresh("__bad_text", docs.columns)
    bad = _judged(docs, benchmark, window, k).where("contaminated").select(F.col("doc_id").alias(own), F.col("__text").alias(text)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text))
    return docs.join(written(bad, "contaminated"), same, "left_anti")


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, w FROM (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw),
bwin AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM bl),
dwin AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns)),
hit AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM dwin d JOIN bwin b ON d.n = b.n AND d.win = b.win),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN cover c USING (doc_id) LEFT JOIN its t USING (doc_id)
"""

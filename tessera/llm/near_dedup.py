"""MinHash near-duplicate detection with tensored banding.

A document is the set of its distinct ``k``-word shingles. Two small
collections of minhash bands, A and B, are computed; every pair (A_i, B_j) is
one table key, so ``bands`` x ``bands`` tables cost only 2 x bands x rows
minhashes instead of bands^2 x 2 x rows. A pair of Jaccard similarity 0.85
misses all tables with probability at most 2 * (1 - 0.85^rows)^bands, 7e-5 with
the defaults.

Texts of equal words (by a 128-bit BLAKE2b of them) collapse to one
representative first, so a huge group of copies is one node. Shingle hashes only
propose: every link between different texts is confirmed on the words. Within a bucket the members are first compared with the smallest one
only. Buckets that still hold several components are then settled exactly, but
without forming their pairs: every member is described by how it differs from
the hub of the bucket's largest component. Of two members to be linked, one of
them not linked with the hub, a known number of differences must be shared, so
they meet on a prefix of their differences, those that the hub lacks first
(prefix and position filter). Independent edits share next to nothing there.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.store import arrow_batches, fresh, texts, written
from tessera.llm.words import folded, grams, hashed, mix, slices

_CHUNK = 1 << 15
#: Rows of a batch that goes to Python, which bounds the buffers on both sides.
_BATCH = 1_000


def shingle_sets(docs: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z count as a-z."""
    for i, j in slices(docs):
        (words,), at = hashed(docs[i:j], fold=True)
        all_grams = grams(words, k, k)
        for d in range(j - i):
            a, b = at[d], at[d + 1]
            if b - a >= k:
                yield np.unique(all_grams[a : b - k + 1])
            elif b > a:
                yield grams(words[a:b], int(b - a), int(b - a))
            else:
                yield np.zeros(0, dtype=np.uint64)


def word_shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    """The set itself: distinct runs of ``k`` words, or the whole sequence of fewer; none without words."""
    return set(zip(*[words[i:] for i in range(k)], strict=False)) if len(words) >= k else {tuple(words)} if words else set()


def similar(x: set, y: set, percent: int) -> bool:
    both = len(x & y)
    return bool(both) and 100 * both >= percent * (len(x) + len(y) - both)


def _signer(k: int, bands: int, rows: int, seed: int):
    n = 2 * bands * rows
    rng = np.random.default_rng(seed)
    xor = rng.integers(0, 2**63, (n, 1), dtype=np.uint64)
    mul = rng.integers(0, 2**62, (n, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def minhashes(s: np.ndarray) -> np.ndarray:
        least = np.full(n, np.uint64(2**64 - 1))
        for c in range(0, len(s), _CHUNK):
            h = (s[c : c + _CHUNK][None, :] ^ xor) * mul
            h ^= h >> np.uint64(31)
            np.minimum(least, h.min(axis=1), out=least)
        return least

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            sizes, keys = [], []
            for s in shingle_sets(docs, k):
                sizes.append(len(s))
                keys.append(grams_of(minhashes(s)) if len(s) else [])
            same = [blake2b(b" ".join(folded(t)), digest_size=16).digest() for t in docs]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "same", "bands"])

    def grams_of(m: np.ndarray) -> list[int]:
        out = np.arange(1, 2 * bands + 1, dtype=np.uint64)
        for r in range(rows):
            out = mix(out * np.uint64(0x9FB21C651E98DF25) + m[r :: rows][: 2 * bands])
        return out.view(np.int64).tolist()

    return sign


def _confirm(k: int, percent: int):
    """Keeps the pairs (a, b, text_a, text_b) whose sets of words are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).cast(pa.binary()).to_pylist() for c in (2, 3))
            keep, held, of = [], None, set()
            for x, y in zip(left, right, strict=True):
                if x != held:  # rows of one leader often follow each other
                    held, of = x, word_shingles(folded(x), k)
                keep.append(similar(of, word_shingles(folded(y), k), percent))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return check


def _differences(k: int, percent: int):
    """From (hub, doc, comp, probe, text_hub, text_doc): a row of place 0 if the two are linked, and the prefix of the differences.

    ``most`` differences in all, places from 1: shingles the hub lacks, then
    those the document lacks. A probe (not of the hub's component) is indexed
    far enough for any partner, others for partners that are probes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs, docs, comps, probes = (batch.column(c).to_pylist() for c in range(4))
            hub_texts, doc_texts = (batch.column(c).cast(pa.binary()).to_pylist() for c in (4, 5))
            cols: list[list] = [[] for _ in range(8)]
            for hub, doc, comp, probe, x, y in zip(hubs, docs, comps, probes, hub_texts, doc_texts, strict=True):
                h, d = next(shingle_sets([x], k)), next(shingle_sets([y], k))
                extra, lacking = np.setdiff1d(d, h, assume_unique=True), np.setdiff1d(h, d, assume_unique=True)
                n, most = len(d), len(extra) + len(lacking)
                both = n - len(extra)
                linked = bool(both) and 100 * both >= percent * (n + len(lacking))
                linked = linked and (not probe or similar(word_shingles(folded(x), k), word_shingles(folded(y), k), percent))
                share = max(1, -((-most * (100 + percent) - (100 - percent) * (len(h) - n)) // (2 * (100 + percent))))
                reach = most - share + 1
                if probe and not linked:
                    room = (100 - percent) * n // percent
                    reach = max(reach, most - max(1, -((room - most) // 2), most - room) + 1)
                reach = min(reach, most)
                tokens = np.concatenate([extra, lacking])[: max(0, reach)].view(np.int64).tolist()
                places = list(range(1, len(tokens) + 1))
                if linked and probe:
                    tokens, places = [0, *tokens], [0, *places]
                for col, v in zip(cols, (hub, doc, comp, probe and not linked, most, n), strict=False):
                    col.extend([v] * len(tokens))
                cols[6].extend(tokens)
                cols[7].extend(places)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["hub", "doc", "comp", "probe", "most", "n", "token", "place"])

    return run


_DIFFERENCES = "hub long, doc long, comp long, probe boolean, most long, n long, token long, place long"


def _with_texts(pairs: DataFrame, some: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the texts of both ends, from the written texts of all bucket members."""
    left = some.select(F.col("doc_id").alias(a), F.col("text").alias("text_a"))
    right = some.select(F.col("doc_id").alias(b), F.col("text").alias("text_b"))
    return pairs.join(left, a).join(right, b).select(*pairs.columns, "text_a", "text_b")


def _confirmed(pairs: DataFrame, some: DataFrame, k: int, percent: int) -> DataFrame:
    full = _with_texts(written(pairs, "pairs"), some, "a", "b")
    with arrow_batches(some.sparkSession, _BATCH):
        return written(full.mapInArrow(_confirm(k, percent), "a long, b long"), "links")


def _cross_links(buckets: DataFrame, links: DataFrame, some: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different components of ``links`` within a bucket."""
    labels = written(components(links), "labels")
    placed = buckets.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    open_ = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("key", F.col("top.comp").alias("main"))
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("c"))
    hubs = ends.join(labels, "node").groupBy("component").agg(F.max(F.struct("c", "node"))["node"].alias("hub"))
    members = placed.join(open_, "key").join(hubs, F.col("main") == F.col("component"), "left")
    members = members.select(F.coalesce("hub", "main").alias("hub"), F.col("rep").alias("doc"), "comp", (F.col("comp") != F.col("main")).alias("probe")).where("hub <> doc").distinct()
    full = _with_texts(written(members, "members"), some, "hub", "doc")
    with arrow_batches(some.sparkSession, _BATCH):
        rows = written(full.mapInArrow(_differences(k, percent), _DIFFERENCES), "differences")
    direct = rows.where("place = 0").select(F.col("hub").alias("a"), F.col("doc").alias("b"))
    rows = rows.where("place > 0")
    mixed = rows.groupBy("hub", "token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("probe").alias("any")).where("low < high and any").select("hub", "token")
    rows = rows.join(mixed, ["hub", "token"])
    x, y = rows.where("probe").alias("x"), rows.alias("y")
    room = F.floor((100 - percent) * (F.col("x.n") + F.col("y.n")) / F.lit(100 + percent))
    share = F.greatest(F.lit(1), F.ceil((F.col("x.most") + F.col("y.most") - room) / F.lit(2)))
    near = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    meet = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & near
    meet &= (F.col("x.place") <= F.col("x.most") - share + 1) & (F.col("y.place") <= F.col("y.most") - share + 1)
    pairs = x.join(y, meet).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()
    return _confirmed(pairs, some, k, percent).unionByName(direct)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, bands: int = 8, rows: int = 2, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links of Jaccard
    similarity >= percent/100; kept marks the document that stands for it.
    Null and word-less texts have no shingles and link with nothing; a text of
    fewer than k words is one shingle. Rows that share a doc_id are one node.
    Null doc_ids are never linked (component null, kept). Other columns are
    ignored; an empty table gives no rows.
    """
    docs = texts(docs)
    with arrow_batches(docs.sparkSession, _BATCH):
        signed = written(docs.mapInArrow(_signer(k, bands, rows, seed), "doc_id long, n_shingles long, same binary, bands array<long>"), "signatures")
    sets = signed.where("n_shingles > 0 and doc_id is not null")
    reps = sets.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    pairs_of_bands = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.transform(F.sequence(F.lit(bands), F.lit(2 * bands - 1)), lambda j: F.xxhash64(i, j, F.get("bands", i), F.get("bands", j)))))
    tables = reps.select("rep", F.col("n_shingles").alias("n"), F.explode(pairs_of_bands).alias("key"))
    crowded = tables.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("low"), F.count("*").alias("c")).where("c > 1").select("key", F.col("low.rep").alias("leader"), F.col("low.n").alias("leader_n"))
    buckets = written(tables.join(crowded, "key"), "buckets")
    close = 100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n")
    stars = buckets.where((F.col("leader") < F.col("rep")) & close).select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    # Texts are shuffled once, to those that share a bucket with another; ids grow with the data, so they are never broadcast.
    need = buckets.select(F.col("rep").alias("doc_id")).distinct().hint("shuffle_hash")
    some = written(docs.where("text is not null").join(need, "doc_id", "left_semi"), "texts")
    links = _confirmed(stars, some, k, percent)
    more = written(_cross_links(buckets, links, some, k, percent), "cross")
    members = sets.groupBy("same").agg(F.min("doc_id").alias("rep"))
    # A copy takes its representative's component; ids that stand in several sets join them all.
    twice = sets.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    if twice.limit(1).count():
        ids = sets.select("doc_id", "same").join(members, "same").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
        final = components(links.unionByName(more).unionByName(ids))
        labelled = signed.join(final, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    else:
        final = components(links.unionByName(more))
        final = members.join(final, F.col("rep") == F.col("node"), "left").select("same", F.coalesce("component", "rep").alias("component"))
        labelled = signed.join(final, "same", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"))
    return labelled.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group, all columns unchanged.

    Links at ``percent``/100 similarity on ``k``-word shingles. Of repeated rows
    with one doc_id all stay if their id stands for the group. Rows of a null
    doc_id, null, empty and word-less texts stay. An empty table gives no rows.
    doc_id is a number or the text of one; other texts raise. Other columns may
    have any name.
    """
    name = fresh("__gone", docs.columns)
    gone = written(near_duplicates(docs, k, percent, **options).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")

"""Divergence audit, collocations and URL filters against brute force, with edges."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, divergence, url_filter

SCHEMA = "doc_id long, text string, lang string, source string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def made_texts(seed, n):
    """Few words, so phrases repeat; odd separators, capitals, other letters, empty and null texts."""
    rng = random.Random(seed)
    words = ["red", "Red", "fox", "ÉTÉ", "été", "don't", "a1b", "x_y", "\x00z", "über\u00a0all", "naïve", "the", "THE"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ;", "!", "\r\n", "\x0b"]
    out = [None, "", " ", "..", "\x7f"]
    while len(out) < n:
        out.append("".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(1, 60))))
    return out


def documents(spark, seed=3, n=260):
    rng = random.Random(seed)
    rows = [(i, t, rng.choice(["en", "en", "de", "", None]), rng.choice(["a", "b", "c", "", None])) for i, t in enumerate(made_texts(seed, n))]
    rows += rows[7:30]  # repeated rows
    rows.append((10_000, None, "xx", "only"))
    rows.append((10_001, "", "xx", "second"))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def brute_audit(rows, top=200):
    docs = [(r[2] or "", r[3] or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(r[1]))) for r in rows]
    df, whole, own, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, words in docs:
        groups.add((lang, source))
        df[lang].update(set(words))
        whole[lang].update(words)
        own[lang, source].update(words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= 3]
        prob = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        q, p = prob(whole[lang]), {s: prob(own[lang, s]) for g, s in groups if g == lang}
        for s in p:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in p if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if own[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize("seed", [3, 4])
def test_audit_equals_brute_force(spark, seed):
    rows, df = documents(spark, seed)
    got = divergence.audit_sources(df.withColumns({"term": F.lit(1), "p": F.lit("x"), "n": F.lit(2)}))
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == brute_audit(rows)


def test_audit_keeps_few_ranks_and_rejects_other_thresholds(spark):
    rows, df = documents(spark, 5, 120)
    assert sorted(map(tuple, divergence.audit_sources(df, top=2).collect())) == brute_audit(rows, 2)
    with pytest.raises(ValueError):
        divergence.audit_sources(df, least=4)


def test_audit_of_nothing(spark):
    assert divergence.audit_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    one = divergence.audit_sources(spark.createDataFrame([(1, None, None, None), (2, "x", None, "b")], SCHEMA)).collect()
    assert sorted(map(tuple, one)) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_sketch_never_underestimates(monkeypatch, spark):
    rng = np.random.default_rng(1)
    hashes, amounts = rng.integers(-(2**63), 2**63 - 1, 5_000), rng.integers(1, 3, 5_000)
    sketch = divergence.Sketch(1 << 12, 3)
    for part in np.array_split(np.arange(5_000), 7):
        sketch.add(hashes[part], amounts[part])
        sketch.add(hashes[part[:50]], amounts[part[:50]])
    assert (sketch.estimate(hashes) >= np.minimum(3, amounts)).all()
    monkeypatch.setattr(divergence, "FAN", 2)
    df = spark.createDataFrame([(int(h), int(a)) for h, a in zip(hashes, amounts, strict=True)], "h long, a long").repartition(9)
    merged = divergence.merged_sketch(df, F.col("h"), "a", 3, 5_000)
    assert (merged.estimate(hashes) >= np.minimum(3, amounts)).all()
    assert (merged.estimate(rng.integers(-(2**63), 2**63 - 1, 5_000)) < 3).mean() > 0.9


def test_terms_pass_in_small_flushes(monkeypatch, spark):
    monkeypatch.setattr(divergence, "ENTRIES", 1)
    monkeypatch.setattr(divergence, "ROWS", 3)
    rows, df = documents(spark, 6, 100)
    with divergence_batches(spark, 5):
        assert sorted(map(tuple, divergence.audit_sources(df).collect())) == brute_audit(rows)


def divergence_batches(spark, rows):
    from tessera.sources.scratch import arrow_batches

    return arrow_batches(spark, rows)


def brute_collocations(rows, least=10, longest=3, top=2000):
    counts = defaultdict(Counter)
    for r in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(r[1])):
            words = re.findall("[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                counts[r[2] if r[2] is not None else "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, c in counts.items():
        total = sum(f for p, f in c.items() if len(p) == 1)
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        ranked = []
        for p, a in found.items():
            if any(inside(p, q) and 100 * f >= 50 * a for q, f in found.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), " ".join(p), a, left, right, total, score))
        out += [(lang, i, *x[3:]) for i, x in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "block", "bucket"), [(11, 1 << 24, 1 << 20), (12, 300, 40), (13, 2_000, 500)])
def test_collocations_equal_brute_force(monkeypatch, spark, seed, block, bucket):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    monkeypatch.setattr(collocations, "BUCKET_ENTRIES", bucket)
    rows, df = documents(spark, seed)
    got = collocations.mine_collocations(df.withColumns({"word": F.lit(1), "block": F.lit("x"), "phrase": F.lit(2)}))
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows)


def test_longer_collocations_and_ranks(monkeypatch, spark):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 700)
    rows, df = documents(spark, 14, 200)
    assert sorted(map(tuple, collocations.mine_collocations(df, least=4, longest=5, top=30).collect())) == brute_collocations(rows, 4, 5, 30)
    assert sorted(map(tuple, collocations.mine_collocations(df, least=4, longest=2).collect())) == brute_collocations(rows, 4, 2)


def test_collocations_of_nothing(spark):
    assert collocations.mine_collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.mine_collocations(spark.createDataFrame([(1, None, None, None), (2, "a. b", "en", "s")], SCHEMA)).count() == 0
    many = collocations.mine_collocations(spark.createDataFrame([(1, "New York, " * 50_000, None, None)], SCHEMA)).collect()
    assert [tuple(r) for r in many] == [("und", 1, "new york", 50_000, 50_000, 50_000, 100_000, 1_000_000)]


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = lowered(host)
    fits = []
    for key, verdict in rules:
        own, _, start = key.partition("/")
        if host and (host == own or host.endswith("." + own)) and path.startswith("/" + start if "/" in key else ""):
            fits.append((len(key), len(own), verdict == "block", key, verdict))
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def urls(seed, n):
    rng = random.Random(seed)
    labels = ["a", "b", "net", "example", "ORG", "com", "x-y", "", "ü"]
    paths = ["", "/", "/en", "/en/", "/en/1?x#y", "/de/é", "/fr//", "/EN/", "?q=/en/", "#t/en/"]
    out = [None, "", "://", "http://", "no scheme.net/en/", "mailto:a@b.net", "http://net/", "x://y://net/en/", "http://a.net\n.net/en/"]
    return out + ["".join([rng.choice(["http://", "HTTPS://"]), ".".join(rng.choice(labels) for _ in range(rng.randint(1, 5))), rng.choice(paths)]) for _ in range(n)]


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(9)
    found = urls(8, 3_000)
    keys = [".".join(rng.choice(["a", "b", "net", "example", "org", "com", "x-y", "ü"]) for _ in range(rng.randint(1, 3))) + rng.choice(["", "/", "/en/", "/e", "/de/é", "/fr/"]) for _ in range(400)]
    rules = [(k, rng.choice(["allow", "block"])) for k in keys] + [("net/", "block"), ("net/", "allow"), ("/en/", "block")]
    both = {}
    for k, v in rules:
        both[k] = "block" if "block" in (v, both.get(k)) else v
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string").withColumns({"rule": F.lit("x"), "__keys": F.lit(1), "n": F.lit(5)}).repartition(4)
    got = url_filter.filter_urls(pages, spark.createDataFrame([*rules, (None, "block"), ("com/", None)], "key string, verdict string"))
    assert got.columns == ["page_id", "url", "n", "host", "path", "rule", "verdict"]
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {i: judged(u, both.items()) for i, u in enumerate(found)}


def test_urls_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "key string, verdict string")
    pages = spark.createDataFrame([("t", "http://a.net/"), ("t", "http://a.net/"), ("u", None)], "page_id string, url string")
    assert sorted(map(tuple, url_filter.filter_urls(pages, none, default="block").select("page_id", "rule", "verdict").collect())) == [("t", None, "block")] * 2 + [("u", None, "block")]
    rules = spark.createDataFrame(url_filter.RULES, "key string, verdict string")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    listed = spark.range(3_000).select(F.concat(F.lit("in"), "id").alias("key"))
    universe = spark.range(60_000).select(F.when(F.col("id") % 7 == 0, F.concat(F.lit("in"), F.col("id") % 4_000)).otherwise(F.concat(F.lit("out"), F.col("id") % 50_000)).alias("key"))
    cascade = url_filter.build_cascade(listed, universe)
    assert len(cascade.levels) > 4
    keys = [r[0] for r in universe.union(listed).distinct().collect()]
    assert (cascade.member(url_filter.digests(keys)) == np.array([k.startswith("in") and int(k[2:]) < 3_000 for k in keys])).all()
    with pytest.raises(ValueError):
        url_filter.build_cascade(listed, universe, most_bytes=1_000)
    with pytest.raises(ValueError):
        url_filter.filter_urls(spark.createDataFrame([(1, "http://a/")], "page_id int, url string"), listed.withColumn("verdict", F.lit("block")), most_bytes=100)

"""Personal data: fixed patterns, and boosted trees over high-recall candidates; DataFrame functions only.

Four fixed patterns give the base spans. Generators with loose patterns propose
overlapping candidate spans; each is described by a few small whole numbers on
its format and context. All candidates of the corpus are counted by these
numbers, by whether they touch a base span and by a hash fold of their document.
That table of cells is small whatever the corpus, so gradient boosting of
depth-two trees runs on exact totals, and the score threshold is calibrated for
precision on the other fold. Scored candidates are selected greedily, by column
expressions again, and added to the base.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
# Fixed patterns of the base kinds; possessive and anchored at run starts, which matches the same but never backtracks.
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?+[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Loose patterns of the candidates.
_AT = r"(?:(?<![^\s@<>()\[\]\",;:])|\G)[^\s@<>()\[\]\",;:]++(?:@|\x20?[\[(]at[\])]\x20?)[^\s@<>()\[\]\",;:]++"
_DIGITS = r"[+(]?+[0-9](?:[\x20().\-/]{0,2}+[0-9]){6,}+"
_CONTEXT = r"(?i)(?:mail|contact|tel|phone|call|fax|mobile|cell|card|visa|ip|addr|ssn|account|iban)[^A-Za-z0-9]{0,3}\w{0,10}[^A-Za-z0-9]{0,3}$"
#: Names and numbers of values of the candidates' features: a bound on the cells.
FEATURES = {"at": 2, "digits": 7, "groups": 6, "plus": 2, "paren": 2, "dots": 5, "luhn": 2, "context": 2, "name": 2, "loose": 2}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_SPANS = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, context: bool = False) -> Column:
    """All leftmost non-overlapping matches with their code point positions; with ``context`` also up to 24 characters before and one after, of what lies between matches.

    Positions are running sums of the lengths of gaps and matches. They are
    taken in two steps, over blocks of about the square root of their number
    and within a block, so that a text of very many matches stays cheap.
    """
    blank = F.array().cast(_SPANS[:-2] + ",before:string,after:string>>" if context else _SPANS)

    def walk(found: Column) -> Column:
        n = F.size(found)
        block = F.ceil(F.sqrt(n)).cast("int")

        def add(lengths: Column) -> Column:
            return F.aggregate(lengths, F.lit(0), lambda s, x: s + x)

        def place(gaps: Column, lengths: Column) -> Column:
            def run(starts: Column) -> Column:
                def of(value: Column, i: Column) -> Column:
                    b = F.floor(i / block).cast("int")
                    start = F.get(starts, b) + add(F.slice(lengths, b * block + 1, i - b * block)) + F.length(F.get(gaps, i))
                    more = [F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after")] if context else []
                    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), *more)

                return F.transform(found, of)

            sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: add(F.slice(lengths, b * block + 1, block)))
            before = F.aggregate(sums, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
            return let(before, run)

        placed = let(F.split(text, pattern, -1), lambda g: let(F.zip_with(found, F.slice(g, 1, n), lambda v, x: F.length(v) + F.length(x)), lambda lengths: place(g, lengths)))
        return F.when(n > 0, placed).otherwise(blank)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _small_parts(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(value, r"\."), small)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind>> of the four fixed kinds, by start, then kind as listed."""

    def of(rank: int, hint: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
        some = F.filter(matches(text, pattern), lambda m: keep(m["value"]))
        shaped = F.transform(some, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(KINDS[rank]).alias("kind")))
        return F.when(hint, shaped).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))

    def card(v: Column) -> Column:
        return let(_digits(v), lambda d: F.length(d).between(14, 19) & _luhn(d))

    digit = text.rlike("[0-9]")
    return F.array_sort(
        F.concat(
            of(0, F.contains(text, F.lit("@")), _EMAIL, lambda v: F.lit(True)),
            of(1, digit & F.contains(text, F.lit(".")), _IP, _small_parts),
            of(2, digit, _CARD, card),
            of(3, digit & F.contains(text, F.lit("+")), _PHONE, lambda v: F.length(_digits(v)).between(10, 15)),
        )
    )


def _blocks(spans: Column) -> Column:
    """``spans``, by start, in blocks of about the square root of their number, each with its range."""
    n = F.size(spans)
    block = F.ceil(F.sqrt(n)).cast("int")

    def of(part: Column) -> Column:
        return F.struct(F.array_min(F.transform(part, lambda p: p["start"])).alias("low"), F.array_max(F.transform(part, lambda p: p["end"])).alias("high"), part.alias("spans"))

    made = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: let(F.slice(spans, b * block + 1, block), of))
    return F.when(n > 0, made).otherwise(F.array())


def candidates(text: Column, base: Column) -> Column:
    """Overlapping candidate spans with their features and whether they touch one of the base spans, given as ``_blocks``."""

    def shape(at: int) -> Callable[[Column], Column]:
        def of(m: Column) -> Column:
            v = m["value"]

            def described(d: Column) -> Column:
                n = F.length(d)
                flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
                around = F.concat(F.right(m["before"], F.lit(1)), m["after"])
                return F.struct(
                    m["start"].alias("start"),
                    m["end"].alias("end"),
                    F.exists(base, lambda b: (b["low"] < m["end"]) & (m["start"] < b["high"]) & F.exists(b["spans"], lambda p: (p["start"] < m["end"]) & (m["start"] < p["end"]))).alias("known"),
                    F.lit(at).alias("at"),
                    # How many digits and groups of them there are tells numbers apart, not addresses.
                    F.when((n < 7) | F.lit(bool(at)), 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).when(n < 17, 4).when(n < 20, 5).otherwise(6).alias("digits"),
                    (F.lit(0) if at else F.least(F.size(F.split(v, "[^0-9]+")) - 1, F.lit(5))).alias("groups"),
                    flag(v.startswith("+")).alias("plus"),
                    flag(F.contains(v, F.lit("("))).alias("paren"),
                    F.least(F.size(F.split(v, r"\.")) - 1, F.lit(4)).alias("dots"),
                    flag(n.between(14, 19) & _luhn(d) if not at else F.lit(False)).alias("luhn"),
                    flag(m["before"].rlike(_CONTEXT)).alias("context"),
                    flag(v.rlike(r"\.[A-Za-z]{2,}$")).alias("name"),
                    flag(~around.rlike("[A-Za-z0-9]")).alias("loose"),
                )

            return let(_digits(v), described)

        return of

    some = F.concat(
        F.when(F.contains(text, F.lit("@")) | text.rlike(r"[\[(]at[\])]"), F.transform(matches(text, _AT, True), shape(1))).otherwise(F.array()),
        F.when(text.rlike("[0-9]"), F.transform(matches(text, _DIGITS, True), shape(0))).otherwise(F.array()),
    )
    return some


@dataclass
class Boosted:
    """Depth-two trees ((feature, at most), (feature, at most), (feature, at most), four leaves), a prior and a threshold."""

    trees: list[tuple]
    prior: float
    threshold: float

    def logit(self, cell: dict) -> float:
        z = self.prior
        for (f, a), (g, b), (h, c), leaves in self.trees:
            z += (leaves[0] if cell[g] <= b else leaves[1]) if cell[f] <= a else (leaves[2] if cell[h] <= c else leaves[3])
        return z

    def column(self, cell: Column) -> Column:
        z = F.lit(self.prior)
        for (f, a), (g, b), (h, c), leaves in self.trees:
            left = F.when(cell[g] <= b, leaves[0]).otherwise(leaves[1])
            right = F.when(cell[h] <= c, leaves[2]).otherwise(leaves[3])
            z = z + F.when(cell[f] <= a, left).otherwise(right)
        return z


def boost(cells: list[dict], rounds: int = 16, rate: float = 0.4, precision: float = 0.99) -> Boosted:
    """Gradient boosting on counted cells (features, known, fold, n); fold 0 trains, fold 1 calibrates.

    The threshold is the lowest score from which on at least ``precision`` of
    the calibration candidates touch a base span; without any such score
    nothing is added.
    """
    train = [c for c in cells if c["fold"] == 0]
    total, hits = sum(c["n"] for c in train), sum(c["n"] for c in train if c["known"])
    model = Boosted([], math.log((hits + 1) / (total - hits + 1)), math.inf)
    cuts = [(f, v) for f, size in FEATURES.items() for v in range(size - 1)]

    def gain(g: float, h: float) -> float:
        return g * g / (h + 1.0)

    def split(part: list[tuple[dict, float, float]]) -> tuple[tuple[str, int], float, float]:
        best = ((cuts[0][0], cuts[0][1]), -1.0, 0.0, 0.0)
        all_g, all_h = sum(p[1] for p in part), sum(p[2] for p in part)
        for f, v in cuts:
            g = sum(p[1] for p in part if p[0][f] <= v)
            h = sum(p[2] for p in part if p[0][f] <= v)
            won = gain(g, h) + gain(all_g - g, all_h - h)
            if won > best[1] + 1e-12:
                best = ((f, v), won, rate * g / (h + 1.0), rate * (all_g - g) / (all_h - h + 1.0))
        return best[0], best[2], best[3]

    for _ in range(rounds if train and 0 < hits < total else 0):
        part = []
        for c in train:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.logit(c)))))
            part.append((c, c["n"] * (c["known"] - p), c["n"] * p * (1 - p)))
        top, _, _ = split(part)
        low = split([p for p in part if p[0][top[0]] <= top[1]])
        high = split([p for p in part if p[0][top[0]] > top[1]])
        model.trees.append((top, low[0], high[0], (low[1], low[2], high[1], high[2])))
    ranked = sorted(((model.logit(c), c["n"], c["n"] * c["known"]) for c in cells if c["fold"] == 1), reverse=True)
    n = known = 0
    for i, (z, count, good) in enumerate(ranked):
        n, known = n + count, known + good
        if (i + 1 == len(ranked) or ranked[i + 1][0] < z) and known >= precision * n and z > 0:
            model.threshold = z
    return model


def fit(docs: DataFrame) -> Boosted:
    """Boosted trees from the counted candidates of all of ``docs``."""
    text = F.col("text").cast("string")
    rows = docs.where(text.rlike(r"[0-9@]|[\[(]at[\])]")).select(F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"), F.explode(let(base_spans(text), lambda s: let(_blocks(s), lambda b: candidates(text, b)))).alias("c"))
    rows = rows.select("fold", "c.known", *[f"c.{f}" for f in FEATURES])
    counted = rows.groupBy("fold", "known", *FEATURES).agg(F.count("*").alias("n")).collect()  # at most 4 x the product of FEATURES
    return boost(sorted((r.asDict() for r in counted), key=lambda r: tuple(map(int, r.values()))))


_FULL = "array<struct<start:int,rank:int,end:int,kind:string>>"


def find_pii(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """All columns of ``docs`` with pii_base and pii_spans, arrays of (start, rank, end, kind) by start, then kind.

    Added spans have kind 'likely_email' or 'likely_number', touch no base span
    and are taken by score, best first and of equal ones the earlier, without
    overlaps. Null and empty texts have
    none; repeated rows repeat; columns called pii_* are replaced; an empty
    table gives no rows. The model is fitted on ``docs`` unless given.
    """
    model = model or fit(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def added(base: Column) -> Column:
        if math.isinf(model.threshold):
            return F.array().cast(_FULL)
        scored = F.transform(F.filter(let(_blocks(base), lambda b: candidates(text, b)), lambda c: ~c["known"]), lambda c: F.struct((-model.column(c)).alias("cost"), c["start"].alias("start"), c["end"].alias("end"), c["at"].alias("at")))
        good = F.filter(scored, lambda c: -c["cost"] >= model.threshold)

        def take(s: Column, c: Column) -> Column:
            one = F.struct(c["start"].alias("start"), (4 + (1 - c["at"])).cast("int").alias("rank"), c["end"].alias("end"), F.when(c["at"] == 1, "likely_email").otherwise("likely_number").alias("kind"))
            return F.when(F.exists(s, lambda t: (t["start"] < c["end"]) & (c["start"] < t["end"])), s).otherwise(F.concat(s, F.array(one)))

        return F.aggregate(F.array_sort(good), F.array().cast(_FULL), take)

    both = let(base_spans(text), lambda b: F.struct(b.alias("base"), F.array_sort(F.concat(b, added(b))).alias("spans")))
    none = F.struct(F.array().cast(_FULL).alias("base"), F.array().cast(_FULL).alias("spans"))
    found = docs.select(*[c for c in docs.columns if not c.startswith("pii_")], F.when(text.rlike(r"[0-9@]|[\[(]at[\])]"), both).otherwise(none).alias("pii_found"))
    return found.withColumns({"pii_base": F.col("pii_found.base"), "pii_spans": F.col("pii_found.spans")}).drop("pii_found")


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """All columns of ``docs``; in text, every span of find_pii is replaced by its kind in brackets, overlaps once.

    Null and empty texts and texts without spans are unchanged; repeated rows
    repeat; columns called pii_* are dropped; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def step(s: Column, p: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, p["start"] - s["at"])
        more = F.struct(F.greatest(p["end"], s["at"]).alias("at"), F.concat(s["out"], gap, F.concat(F.lit("["), p["kind"], F.lit("]"))).alias("out"))
        return F.when(p["start"] < s["at"], F.struct(F.greatest(p["end"], s["at"]).alias("at"), s["out"].alias("out"))).otherwise(more)

    done = F.aggregate("pii_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return find_pii(docs, model).withColumn("text", F.when(F.size("pii_spans") > 0, done).otherwise(F.col("text"))).drop("pii_base", "pii_spans")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of base kinds, base_sha256, spans, n_likely; nulls, repeated rows and empty tables as in find_pii."""
    found = find_pii(docs.select("doc_id", "text")).select("doc_id", "pii_base", "pii_spans")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("pii_spans")).alias("spans"), (F.size("pii_spans") - F.size("pii_base")).cast("long").alias("n_likely"))

"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate, target bytes over own bytes. A
document's count is the inverse Poisson distribution function of its source's
rate at a uniform number hashed from seed and doc_id, so it is the same on every
run and machine. Documents are exploded by their counts and shuffled globally by
a hash of seed, doc_id and copy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import written

#: Rates of more bytes than this, names of sources included, are joined by a salted shuffle, not broadcast.
BROADCAST_BYTES, SALTS = 8 << 20, 32


def source_rates(docs: DataFrame, alpha: float = 0.5, weights: dict[str, float] | None = None, total_bytes: float | None = None) -> DataFrame:
    """Rows (source, bytes, rate). Weights are ``weights`` (absent sources: 0), else bytes**alpha.

    Sources without bytes keep rate 1. ``total_bytes`` defaults to what there is.
    """
    size = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"))
    if weights:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        weight = F.coalesce(F.element_at(given, F.coalesce("source", F.lit(""))), F.lit(0.0))
    else:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(alpha))
    size = size.select("source", "bytes", weight.alias("weight"))
    whole = size.agg(F.sum("weight").alias("all_weight"), F.sum("bytes").alias("all_bytes"))
    total = F.lit(float(total_bytes)) if total_bytes is not None else F.col("all_bytes").cast("double")
    rate = F.when((F.col("bytes") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * total / F.col("bytes")).otherwise(1.0)
    return size.crossJoin(F.broadcast(whole)).select("source", "bytes", rate.alias("rate"))  # one row


def _log_factorial(k: Column) -> Column:
    """Stirling's series; good to 1e-14 from 32 on, which is where it is asked."""
    return k * F.log(k) - k + F.log(2 * math.pi * k) / 2 + 1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * k * k * k * k * k)


def poisson_count(rate: Column, u: Column) -> Column:
    """The inverse Poisson distribution function: how many of its values 0, 1, ... have a cumulated probability of at most ``u``.

    Probabilities follow from each other by rate / k, within 12 deviations of
    the mean; what lies below weighs less than 1e-30. The steps of a row are
    fewer than 24 deviations, so no table of the distribution is ever held.
    """
    first = F.floor(rate - 12 * F.sqrt(rate) - 30)
    first = F.when(first >= 32, first).otherwise(0)
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30)
    k = first.cast("double")
    start = F.exp(F.when(first > 0, k * F.log(rate) - _log_factorial(k)).otherwise(0.0) - rate)

    def step(s: Column, i: Column) -> Column:
        total = s["sum"] + s["p"]
        return F.struct((s["p"] * rate / (i + 1)).alias("p"), total.alias("sum"), (s["n"] + (total <= u).cast("int")).alias("n"))

    begin = F.struct(start.alias("p"), F.lit(0.0).alias("sum"), first.cast("int").alias("n"))
    return F.when((rate > 0) & (u > 0), F.aggregate(F.sequence(first, last), begin, step, lambda s: s["n"])).otherwise(0)


def mix_sources(docs: DataFrame, alpha: float = 0.5, weights: dict[str, float] | None = None, total_bytes: float | None = None, seed: int = 17) -> DataFrame:
    """All columns of ``docs`` for each copy, with mix_copies, mix_copy (from 1) and mix_key, in mix_key order.

    Null sources are one source; null doc_ids share one draw; repeated rows
    repeat with the same count; empty or null texts count as no bytes. An empty
    table gives no rows. Columns called mix_* or __* are replaced.
    """
    own = [c for c in docs.columns if not c.startswith(("mix_", "__"))]
    docs = docs.select(*own)
    rates = written(source_rates(docs, alpha, weights, total_bytes).select(F.col("source").alias("__source"), F.col("rate").alias("__rate")), "rates")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), name).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    same = F.col("source").eqNullSafe(F.col("__source"))
    held = rates.agg(F.sum(F.coalesce(F.octet_length(F.col("__source").cast("string")), F.lit(0)) + 24)).first()[0] or 0
    if held <= BROADCAST_BYTES:
        rates = F.broadcast(rates)
    else:  # a source's rows are dealt to SALTS tasks
        rates = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn("__own_salt", F.pmod(F.xxhash64(F.lit("mix"), name), F.lit(SALTS)).cast("int"))
        same &= F.col("__salt") == F.col("__own_salt")
    drawn = docs.join(rates, same).withColumn("mix_copies", poisson_count(F.col("__rate"), u)).select(*own, "mix_copies").where("mix_copies > 0")
    copies = drawn.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    key = F.md5(F.concat(F.lit(f"{seed}|"), name, F.lit("|"), F.col("mix_copy").cast("string")).cast("binary"))
    return copies.withColumn("mix_key", key).repartitionByRange("mix_key").sortWithinPartitions("mix_key")


ORACLE_SQL = """
WITH size AS (SELECT source, sum(coalesce(octet_length(encode(text)), 0)) AS bytes FROM documents GROUP BY source),
whole AS (SELECT sum(pow(bytes, 0.5)) AS w, sum(bytes) AS b FROM size),
rate AS (SELECT source, CASE WHEN bytes > 0 THEN pow(bytes, 0.5) / w * b / bytes ELSE 1.0 END AS r FROM size, whole),
pmf AS (SELECT source, r, k, exp(-r + k * ln(r) - lgamma(k + 1)) AS p
        FROM (SELECT source, r, unnest(range(0, CAST(ceil(r + 12 * sqrt(r) + 30) AS BIGINT) + 1)) AS k FROM rate)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
steps AS (SELECT source, list(c ORDER BY k) AS s FROM cdf GROUP BY source),
drawn AS (SELECT d.doc_id, d.source, d.text,
                 len(list_filter(s, lambda x: x <= CAST(('0x' || substr(md5('17|' || d.doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0)) AS n
          FROM documents d JOIN steps ON d.source IS NOT DISTINCT FROM steps.source)
SELECT doc_id, source, text, CAST(n AS INTEGER) AS mix_copies, CAST(i AS INTEGER) AS mix_copy, md5('17|' || doc_id || '|' || i) AS mix_key
FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM drawn)
"""

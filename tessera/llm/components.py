"""Connected components of an undirected edge table, as Spark joins.

Alternates two star contractions until nothing changes: every node links its
larger neighbours to its smallest one, then every node links its smaller
neighbours to the smallest. Each round is written to the shared folder. No edge
or label ever reaches the driver, and a node of high degree is pre-aggregated
before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (columns a and b); component is its smallest node.

    Repeated edges, both directions of an edge and self-loops are accepted;
    edges with a null end are ignored; no edges give no rows.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(links, "links")
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Larger neighbours move to the smallest node seen.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Smaller neighbours, and the node itself, move to the smallest of them.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a")
        new = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        new = written(new.distinct(), "links")
        if _same(links, new):
            break
        links = new
    else:
        raise RuntimeError("connected components did not settle")
    labels = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.unionByName(roots)


def _same(old: DataFrame, new: DataFrame) -> bool:
    """Equal edge sets, by count and an order-free sum of hashes."""
    def of(x: DataFrame) -> tuple:
        r = x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    return of(old) == of(new)

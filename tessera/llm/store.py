"""Small DataFrame helpers of the llm operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import arrow_batches, forget, written

__all__ = ["arrow_batches", "forget", "fresh", "held_out", "shared_rows", "small_enough", "table", "texts", "written"]

#: Keys with more rows than this are joined apart, see ``shared_rows``.
HOT_ROWS = 1 << 20


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as long and text, whatever else the input carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it (Spark does not tell case apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than needed."""
    return df.limit(rows + 1).count() <= rows


def shared_rows(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of ``rows`` (a written table with doc_id) whose keys occur under two doc_ids, with ``low``, the least of these.

    Keys of more than ``hot_rows`` rows are so few (one in that many rows) that
    they are broadcast; the others are joined by a shuffle in which no key is
    large.
    """
    found = rows.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select(*keys, "low", "n")
    found = written(found, "shared")
    out = rows.join(found.where(F.col("n") <= hot_rows).drop("n"), keys)
    hot = found.where(F.col("n") > hot_rows).drop("n")
    return out.unionByName(rows.join(F.broadcast(hot), keys)) if hot.limit(1).count() else out

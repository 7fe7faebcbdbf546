"""File sources and sinks: CSV, Parquet, JSON and JDBC/SQL, on Spark's own readers and writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: T.StructType | str | None = None, skip_bad: bool = False, blank_as_zero: bool = False) -> DataFrame:
    """Ragged rows fail, or are left out with ``skip_bad``. Without header columns are col_0, col_1, ...

    Blanks are null; ``blank_as_zero`` turns them into 0 in number columns.
    Give a schema for large inputs: inference reads the data once more.
    """
    reader = spark.read.option("sep", sep).option("header", header).option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST")
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    if not header and schema is None:
        df = df.toDF(*[f"col_{i}" for i in range(len(df.columns))])
    if blank_as_zero:
        df = df.fillna(0, [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])
    return df


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "errorifexists", single: bool = False) -> None:
    """Null is the empty string. ``single`` writes one part file, for small results."""
    (df.coalesce(1) if single else df).write.mode(mode).option("sep", sep).option("header", header).option("nullValue", "").option("emptyValue", "").csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", mode: str = "errorifexists", partition_by: list[str] | None = None, row_group_bytes: int | None = None) -> None:
    out = df.write.mode(mode).option("compression", compression)
    if row_group_bytes:
        out = out.option("parquet.block.size", row_group_bytes)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def parquet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, modified, rows) of each file; columns and types are the DataFrame's schema."""
    df = spark.read.parquet(path)
    return df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified")).agg(F.count("*").alias("rows"))


def bucketed(df: DataFrame, table: str, keys: list[str], buckets: int) -> None:
    """A table whose joins and groupings on ``keys`` need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def series_json(df: DataFrame, column: str, order: list[str], keys: list[str]) -> DataFrame:
    """(keys, json): each series as one document {length, data, dtype}; data in ``order``."""
    data = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias("__v")))), lambda s: s["__v"])
    dtype = df.schema[column].dataType.simpleString()
    return df.groupBy(*keys).agg(data.alias("data")).select(*keys, F.to_json(F.struct(F.size("data").alias("length"), "data", F.lit(dtype).alias("dtype"))).alias("json"))


def from_series_json(df: DataFrame, json: str, dtype: str = "double") -> DataFrame:
    """The other columns with pos and value of every entry."""
    rest = [c for c in df.columns if c != json]
    parsed = df.select(*rest, F.from_json(json, f"length int, data array<{dtype}>, dtype string").alias("__j"))
    return parsed.select(*rest, F.posexplode("__j.data").alias("pos", "value"))


def array_json(data: F.Column, shape: list[int]) -> F.Column:
    """A flat array column with its shape as {data, shape}."""
    return F.to_json(F.struct(data.alias("data"), F.array(*[F.lit(s) for s in shape]).alias("shape")))


def from_array_json(df: DataFrame, json: str, dtype: str = "double") -> DataFrame:
    """The other columns with index (one number a dimension, row-major) and value of every entry; data that does not fill its shape is an error."""
    rest = [c for c in df.columns if c != json]
    parsed = df.select(*rest, F.from_json(json, f"data array<{dtype}>, shape array<int>").alias("__j"))
    size = F.aggregate("__j.shape", F.lit(1).cast("long"), lambda a, n: a * n)
    fits = F.when(F.size("__j.data") == size, F.col("__j.data")).otherwise(F.raise_error(F.lit("data does not fill its shape")).cast(f"array<{dtype}>"))
    each = parsed.select(*rest, "__j.shape", F.posexplode(fits).alias("__at", "value"))
    after = lambda d: F.aggregate(F.slice("shape", d + 2, F.size("shape")), F.lit(1).cast("long"), lambda a, n: a * n)
    index = F.transform("shape", lambda n, d: (F.floor(F.col("__at") / after(d)) % n).cast("int"))
    return each.select(*rest, index.alias("index"), "value")


def checked(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a table name: {name}")
    return name


def read_sql(spark: SparkSession, query: str, url: str | None = None, **options) -> DataFrame:
    """A query in another database by JDBC, or over the session's own views."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load() if url else spark.sql(query)


def write_sql(df: DataFrame, table: str, url: str | None = None, if_exists: str = "fail", batch: int = 1000, **options) -> None:
    """if_exists: fail, replace or append."""
    mode = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}[if_exists]
    if url:
        df.write.format("jdbc").mode(mode).options(url=url, dbtable=checked(table), batchsize=batch, **options).save()
    else:
        df.write.mode(mode).saveAsTable(checked(table))


def execute_sql(spark: SparkSession, statement: str, url: str | None = None) -> int | None:
    """Runs a statement that returns no rows; the number of rows it changed for JDBC, None for the session's own catalog."""
    if url is None:
        spark.sql(statement)  # commands run at once
        return None
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        running = connection.createStatement()
        return running.executeUpdate(statement)
    finally:
        connection.close()

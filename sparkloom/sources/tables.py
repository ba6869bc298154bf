"""Tables in and out. Reading is lazy, so filters and columns reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Make temporary views for SQL text."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists", **options) -> None:
    """Write in any format Spark has: parquet, orc, json, csv, xml, text."""
    out = df.write.format(fmt).mode(mode).options(**options)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


def read(spark: SparkSession, path: str, fmt: str, schema=None, **options) -> DataFrame:
    r = spark.read.format(fmt).options(**options)
    return (r.schema(schema) if schema is not None else r).load(path)


def bucketed(df: DataFrame, name: str, path: str, buckets: int, keys: list[str]) -> DataFrame:
    """A table kept in ``buckets`` by ``keys``, sorted within each, at ``path``: joins and aggregates on the keys of tables with
    the same buckets need no shuffle. Rows are dealt to their buckets first, so each is one file."""
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)

"""Registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (read, spark) -> DataFrame under its name; read(table) gives a table."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[function.__name__] = run
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def r6(column, name: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), 6).alias(name)


def long(column, name: str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("long").alias(name)


def stamp_pixels(read) -> DataFrame:
    """embeddings as 8 x 8 stamps: (vec_id, label, pos, y, x, v)."""
    out = read("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    return out.select("vec_id", "label", "pos", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), F.col("v").cast("double").alias("v"))


#: The same in SQL.
PIX = "pix as (select vec_id, label, i - 1 as pos, cast(floor((i - 1) / 8) as int) as y, (i - 1) % 8 as x, cast(embedding[i] as double) as v from embeddings, range(1, 65) t(i))"

"""Differences and running sums along a raster of any size, level by level, so that no task holds a raster.

A raster's order is given by columns from the coarsest to the finest, for example block of rows, row, column. Each
level is a window over the units of the level above, which bounds its partitions; what a unit passes on is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def differences(codes: DataFrame, raster: list[str], order: list[str], code: str, bits: int) -> DataFrame:
    """codes with `diff`: the code less the one before it along the raster, modulo 2**bits; the first is itself.

    Keys must not be null and places must be unique within a raster; gaps in rows or blocks are passed over.
    """
    out, before = codes, None
    for depth in range(len(order), 0, -1):
        units = [*raster, *order[: depth - 1]]
        if depth == len(order):
            out = codes.withColumn("_before", F.lag(code).over(Window.partitionBy(*units).orderBy(order[-1])))
            before = codes.groupBy(*units).agg(F.max_by(code, order[-1]).alias("_last"))
        else:
            shifted = before.withColumn("_edge", F.lag("_last").over(Window.partitionBy(*units).orderBy(order[depth - 1])))
            keys = [*raster, *order[:depth]]
            out = out.join(shifted.select(*keys, "_edge"), keys).withColumn("_before", F.coalesce("_before", "_edge")).drop("_edge")
            before = before.groupBy(*units).agg(F.max_by("_last", order[depth - 1]).alias("_last"))
    return out.withColumn("diff", F.pmod(F.col(code) - F.coalesce("_before", F.lit(0)), F.lit(1 << bits))).drop("_before")


def running_sums(differences: DataFrame, raster: list[str], order: list[str], diff: str, bits: int) -> DataFrame:
    """The inverse: `code`, the sum of all differences so far along the raster, modulo 2**bits."""
    modulus, out, totals = F.lit(1 << bits), differences, None
    for depth in range(len(order), 0, -1):
        units = [*raster, *order[: depth - 1]]
        so_far = Window.partitionBy(*units).orderBy(order[depth - 1])
        if depth == len(order):
            out = differences.withColumn("code", F.sum(diff).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
            totals = differences.groupBy(*units).agg(F.pmod(F.sum(diff), modulus).alias("_total"))
        else:
            keys = [*raster, *order[:depth]]
            earlier = totals.withColumn("_earlier", F.coalesce(F.sum("_total").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            out = out.join(earlier.select(*keys, "_earlier"), keys).withColumn("code", F.col("code") + F.col("_earlier")).drop("_earlier")
            totals = totals.groupBy(*units).agg(F.pmod(F.sum("_total"), modulus).alias("_total"))
    return out.withColumn("code", F.pmod("code", modulus))

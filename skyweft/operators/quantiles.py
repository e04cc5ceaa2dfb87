"""Exact quantiles of a few large groups without holding or sorting a group in one task.

Values are counted in fixed bins between their group's extremes; the bins that hold the wanted ranks are known from the
counts alone, and only their distinct values, with counts, are ranked. A value that repeats very often is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float], bins: int = 4096) -> DataFrame:
    """rows(group, value) -> (group, a column for each share): linear interpolation between neighbouring ranks; nulls don't count.

    The number of groups must be small enough to be sent to all tasks; their extremes, counts and bins are.
    """
    rows = rows.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(group).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_all"))
    width = F.col("_high") - F.col("_low")
    bin_ = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_low")) / width * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    # counted by value first: what is shuffled and ranked is one row a distinct value of a group
    values = rows.groupBy(group, "_v").agg(F.count("*").alias("_n")).join(F.broadcast(ends), group).withColumn("_bin", bin_)
    counts = values.groupBy(group, "_bin").agg(F.sum("_n").alias("_n"), F.max("_all").alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy("_bin"))
    counts = counts.withColumn("_before", upto - F.col("_n"))
    wanted = [(name, (F.col("_all") - 1) * share) for name, share in shares.items()]
    ranks = F.array(*[f(place) for _, place in wanted for f in (F.floor, F.ceil)])
    held = F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    some = counts.where(held).select(group, "_bin", "_before")
    window = Window.partitionBy(group, "_bin").orderBy("_v")
    ranked = values.join(F.broadcast(some), [group, "_bin"]).withColumn("_from", F.col("_before") + F.sum("_n").over(window) - F.col("_n"))

    def at(rank):
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_from") + F.col("_n")), F.col("_v")))

    out = ranked.groupBy(group).agg(*[x for name, place in wanted for x in (at(F.floor(place)).alias(f"_{name}_low"), at(F.ceil(place)).alias(f"_{name}_high"), F.max(place).alias(f"_{name}_at"))])
    part = lambda n: F.col(f"_{n}_at") - F.floor(f"_{n}_at")
    return out.select(group, *[(F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * part(n)).alias(n) for n, _ in wanted])

"""Pixels to stamps, neighbour joins, weights and weighted sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stamp_of(place: Column, side: int) -> Column:
    """Stamp of an output position; stamp 0 is padding."""
    return F.floor((place + side + 0.5) / side).cast("int")


def stamps(points: DataFrame, x: str, y: str, side: int, stamps_padded: int) -> DataFrame:
    """Points strictly inside the padded block, with their stamp (j_st, i_st)."""
    low, high = -side - 0.5, stamps_padded * side + side - 0.5
    inside = (F.col(x) > low) & (F.col(x) < high) & (F.col(y) > low) & (F.col(y) < high)
    return points.where(inside).withColumn("j_st", stamp_of(F.col(y), side)).withColumn("i_st", stamp_of(F.col(x), side))


def empirical_weights(pixels: DataFrame, side: int, extent: int, radius: float) -> DataFrame:
    """pixels(img, px, py, v) -> (oy, ox, img, v, w) by the empirical kernel; weights aren't normalised.

    Every input is sent to the nine stamps around its own and meets the outputs of a stamp there, so the join is
    on the stamp. The reach must not exceed a stamp, or neighbours further out would be missed.
    """
    if radius > side:
        raise ValueError("the acceptance radius exceeds the stamp")
    around = F.sequence(F.lit(-1), F.lit(1))
    sent = (
        pixels.withColumn("j", stamp_of(F.col("py"), side))
        .withColumn("i", stamp_of(F.col("px"), side))
        .withColumn("dj", F.explode(around))
        .withColumn("di", F.explode(around))
        .select((F.col("j") + F.col("dj")).alias("j_st"), (F.col("i") + F.col("di")).alias("i_st"), "img", "px", "py", "v")
    )
    grid = pixels.sparkSession.range(extent * extent).select((F.col("id") / extent).cast("int").alias("oy"), (F.col("id") % extent).cast("int").alias("ox"))
    grid = grid.withColumn("j_st", stamp_of(F.col("oy"), side)).withColumn("i_st", stamp_of(F.col("ox"), side))
    d = F.sqrt(F.pow(F.col("px") - F.col("ox"), 2) + F.pow(F.col("py") - F.col("oy"), 2))
    return grid.join(sent, ["j_st", "i_st"]).withColumn("w", radius - d).where("w > 0").select("oy", "ox", "img", "v", "w")


def by_image(weights: DataFrame) -> DataFrame:
    """Sums of weights and weighted layers by output pixel and image: what is shuffled is one row an image and task."""
    w, v = F.col("w"), F.col("v")
    return weights.groupBy("oy", "ox", "img").agg(F.sum(w).alias("w"), F.sum(w * v).alias("s1"), F.sum(w * v * v).alias("s2"), F.sum(w * w).alias("ww"))


def normalised(images: DataFrame) -> DataFrame:
    """by_image() with t, each image's share of the weight of its output pixel."""
    return images.withColumn("t", F.col("w") / F.sum("w").over(Window.partitionBy("oy", "ox")))


def coadd(images: DataFrame) -> DataFrame:
    """by_image() -> layers that share the weights, their noise, and the effective coverage over images.

    All sums are homogeneous in the weights, so they are divided by the total at the end and no join with it is needed.
    """
    total = F.sum("w")
    return images.groupBy("oy", "ox").agg(
        (F.sum("s1") / total).alias("science"),
        (F.sum("s2") / total).alias("squared"),
        (total / total).alias("constant"),
        (F.sum("ww") / (total * total)).alias("sigma"),
        (F.pow(F.sum(F.abs("w")), 2) / F.sum(F.col("w") * F.col("w"))).alias("neff"),
    )


def ring_average(pixels: DataFrame, group: list[str], radius: Column, value: Column, bins: int, most: float) -> DataFrame:
    """Mean, population deviation and standard error by ring; ring 0 is dropped."""
    ring = F.floor(bins * radius / most).cast("int")
    out = pixels.withColumn("ring", ring).where("ring >= 1").groupBy(*group, "ring")
    return out.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.stddev_pop(value) / F.sqrt(F.count("*"))).alias("err"))


def offsets(counts: DataFrame, group: list[str], order: str, n: str) -> DataFrame:
    """Exclusive running sum of n within a group."""
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum(n).over(window), F.lit(0)))


def pairs_by_separation(points: DataFrame, cell: float, least: float, most: float, bins: int) -> DataFrame:
    """points(id, x, y, g1, g2) -> log bins of separation with pair counts and the summed products.

    Points meet by cell: each is sent to the cells that its reach touches and meets those at home there.
    """
    reach = int(-(-most // cell))
    around = F.sequence(F.lit(-reach), F.lit(reach))
    home = points.withColumn("cx", F.floor(F.col("x") / cell).cast("int")).withColumn("cy", F.floor(F.col("y") / cell).cast("int"))
    sent = home.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    sent = sent.select((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), *[F.col(c).alias(f"{c}_b") for c in ("id", "x", "y", "g1", "g2")])
    sep = F.sqrt(F.pow(F.col("x") - F.col("x_b"), 2) + F.pow(F.col("y") - F.col("y_b"), 2))
    pairs = home.join(sent, ["cx", "cy"]).where("id < id_b").withColumn("sep", sep).where((F.col("sep") >= least) & (F.col("sep") < most))
    bin_ = F.floor(bins * F.log(F.col("sep") / least) / F.log(F.lit(most / least))).cast("int")
    return pairs.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.expr("g1 * g1_b + g2 * g2_b")).alias("xi"), F.avg("sep").alias("sep"))


def conjugated_difference(pixels: DataFrame, group: list[str], order: str, value: str, bits: int) -> DataFrame:
    """Forward difference of codes modulo 2**bits along a raster."""
    before = F.lag(value, 1, 0).over(Window.partitionBy(*group).orderBy(order))
    return pixels.withColumn("diff", F.pmod(F.col(value) - before, F.lit(1 << bits)))


def running_sum(pixels: DataFrame, group: list[str], order: str, value: str, bits: int) -> DataFrame:
    """Inverse of conjugated_difference."""
    total = F.sum(value).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return pixels.withColumn("code", total.bitwiseAND(F.lit((1 << bits) - 1)))

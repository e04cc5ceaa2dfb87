"""Blocks of a mosaic as tables partitioned by ix and iy, and layers compressed to bit planes.

A block's cube, quality maps, inputs and settings are tables side by side in one folder. A task that is run again
writes its partition again, so no checkpoint file or lock is needed.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import coadd as O


def folder(spark: SparkSession, kind: str = "blocks") -> str:
    """A new folder that driver and executors share; only a local session without one gets a temporary one."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="skyweft-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def write(tables: dict[str, DataFrame], place: str, mode: str = "overwrite") -> None:
    """Tables by name, each partitioned by its columns ix and iy. Rows of a block go to one task, so it makes one file."""
    for name, table in tables.items():
        table.repartition("ix", "iy").write.mode(mode).partitionBy("ix", "iy").parquet(f"{place}/{name}")


def read(spark: SparkSession, place: str, name: str, schema: str | None = None) -> DataFrame:
    """A table of blocks; filters on ix and iy prune partitions, and only the columns used are read."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{place}/{name}")


def neighbourhood(blocks: DataFrame, ix: int, iy: int, side: int, box: tuple[int, int, int, int]) -> DataFrame:
    """blocks(ix, iy, y, x, ...) around one block on its coordinates, cropped to box (y from, y to, x from, x to; ends not
    included). Blocks that aren't there leave no rows."""
    near = blocks.where(F.col("ix").between(ix - 1, ix + 1) & F.col("iy").between(iy - 1, iy + 1))
    moved = near.withColumns({"y": F.col("y") + (F.col("iy") - iy) * side, "x": F.col("x") + (F.col("ix") - ix) * side})
    return moved.where((F.col("y") >= box[0]) & (F.col("y") < box[1]) & (F.col("x") >= box[2]) & (F.col("x") < box[3]))


def unzigzag(value: Column, bits: int) -> Column:
    """Inverse of zigzag: odd values stand for negative ones."""
    return F.when(value % 2 == 1, (1 << bits) - F.floor((value + 1) / 2)).otherwise(F.floor(value / 2)).cast("long")


def bit_planes(codes: DataFrame, group: list[str], place: str, value: str, bits: int) -> DataFrame:
    """codes -> (group, plane, byte, packed): eight neighbouring places of one bit, lowest bit and place first."""
    out = codes.withColumn("plane", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    bit = F.expr(f"shiftleft(shiftright({value}, plane) & 1, cast({place} % 8 as int))")
    return out.groupBy(*group, "plane", F.floor(F.col(place) / 8).alias("byte")).agg(F.sum(bit).cast("int").alias("packed"))


def from_bit_planes(planes: DataFrame, group: list[str], place: str, value: str) -> DataFrame:
    """Inverse of bit_planes; places beyond the last one are for the caller to drop."""
    out = planes.select(*group, "plane", "byte", "packed", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_k"))
    bit = F.expr("shiftleft(cast(shiftright(packed, _k) & 1 as bigint), cast(plane as int))")
    return out.groupBy(*group, (F.col("byte") * 8 + F.col("_k")).alias(place)).agg(F.sum(bit).alias(value))


def compress(pixels: DataFrame, group: list[str], place: str, value: str, low: float, high: float, bits: int, alpha: float = 1.0) -> dict[str, DataFrame]:
    """pixels -> the tables of a compressed layer: planes of differenced codes, overflow, and what is needed to read them."""
    codes = pixels.withColumn("code", C.quantise(F.col(value), low, high, bits, alpha))
    codes = O.conjugated_difference(codes, group, place, "code", bits).withColumn("zig", C.zigzag(F.col("diff"), bits).cast("long"))
    pairs = {"VMIN": low, "VMAX": high, "BITKEEP": bits, "ALPHA": alpha, "DIFF": True, "SOFTBIAS": -1, "REORDER": True}
    settings = pixels.select(*group).distinct().select(*group, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(str(v)).alias("value")) for k, v in pairs.items()])).alias("p"))
    return {
        "planes": bit_planes(codes, group, place, "zig", bits),
        "overflow": pixels.where((F.col(value) < low) | (F.col(value) > high)).select(*group, place, value),
        "settings": settings.select(*group, "p.key", "p.value"),
    }


def decompress(planes: DataFrame, overflow: DataFrame, group: list[str], place: str, value: str, low: float, high: float, bits: int, alpha: float = 1.0) -> DataFrame:
    """Inverse of compress: codes are added up again and the overflow is put back."""
    zig = from_bit_planes(planes, group, place, "zig").withColumn("diff", unzigzag(F.col("zig"), bits))
    codes = O.running_sum(zig, group, place, "diff", bits)
    kept = overflow.withColumnRenamed(value, "_kept")
    plain = codes.select(*group, place, C.dequantise(F.col("code"), low, high, bits, alpha).alias("_plain"))
    return plain.join(kept, [*group, place], "left").select(*group, place, F.coalesce("_kept", "_plain").alias(value))

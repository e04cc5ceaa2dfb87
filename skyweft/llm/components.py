"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is two grouped minimums and two joins, written to the shared folder; a node with very many links
has them dealt out by salts. Before a round is written, each task replaces the links that it holds by stars of the
components that they make, so chains that lie together need no rounds. Neither the links nor the components pass
through the driver; it sees one row of counts a round. Small graphs go by few tasks (`parts`), since a round has ten shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import discard, durable, merged

#: Links that a task joins at once; more are joined in turns, which affects the number of rounds only.
HELD = 1 << 18


def with_least(rows: DataFrame, key: str, value: str, name: str = "m", parts: int | None = None) -> DataFrame:
    """rows with the least `value` of their `key`, however many rows one key has.

    The rows of a key are dealt out by salts; a key has at most one row a salt where its parts' minimums meet.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    part = merged(salted.groupBy(key, "_salt").agg(F.min(value).alias(name)), parts)
    part = merged(part.select(key, "_salt", F.min(name).over(Window.partitionBy(key)).alias(name)), parts)
    return merged(salted.join(part, [key, "_salt"]).drop("_salt"), parts)


def _large_star(edges: DataFrame, parts: int | None) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    rows = with_least(both, "u", "v", parts=parts).where("v > u")
    return rows.select(F.col("v").alias("a"), F.least("u", "m").alias("b")).where("a <> b").distinct().transform(merged, parts)


def _small_star(edges: DataFrame, parts: int | None) -> DataFrame:
    rows = with_least(edges, "a", "b", parts=parts)
    ends = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return rows.select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a <> b").distinct().transform(merged, parts)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> (member, smallest) for every member of a component but its smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(ids))
    while True:
        low = np.minimum(up[x], up[y])
        new = up.copy()
        np.minimum.at(new, up[x], low)
        np.minimum.at(new, up[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == up).all():
            break
        up = new
    some = up != np.arange(len(ids))
    return ids[some], ids[up[some]]


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a task as stars, HELD or a batch at a time."""

    def joined(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(x) for x in zip(*held, strict=True)))], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        if sum(len(x) for x, _ in held) >= HELD:
            yield joined(held)
            held = []
    if held:
        yield joined(held)


def _contracted(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_held, "a long, b long")


def _settled(edges: DataFrame, parts: int | None) -> bool:
    """Whether the links are stars: no member has two links or is another's smallest."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("ups"), F.lit(0).alias("least")).union(edges.select("b", F.lit(0), F.lit(1)))
    met = ends.groupBy("id").agg(F.sum("ups").alias("ups"), F.max("least").alias("least"))
    return merged(met, parts).where("ups + least > 1 and ups > 0").agg(F.count("*")).first()[0] == 0


def roots(links: DataFrame, most_rounds: int = 60, parts: int | None = None) -> DataFrame:
    """links (a, b) of long ids -> (a, b): each id that isn't its component's smallest, and that smallest id.

    `parts`: the most tasks of a shuffle, for links that are few; it affects speed only.
    """
    edges = durable(_contracted(merged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), parts)))
    for _ in range(most_rounds):
        if _settled(edges, parts):
            return edges
        old, edges = edges, durable(_contracted(_small_star(_large_star(edges, parts), parts)))
        discard(old)
    raise RuntimeError("components did not settle")

"""Distortions, residual maps and raster scans against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweft.functions import distortion as D
from skyweft.operators import rasters
from skyweft.plans import maps


def test_newton_restores_places(spark):
    random = np.random.default_rng(2)
    rows = [tuple(map(float, r)) for r in random.uniform(-2044, 2044, (200, 2))]
    a = {(2, 0): F.lit(2e-6), (1, 1): F.lit(-1e-6), (0, 4): F.lit(1e-14), (1, 0): F.lit(1e-3)}
    b = {(0, 2): F.lit(-3e-6), (2, 1): F.lit(2e-10), (0, 0): F.lit(0.5)}
    p = spark.createDataFrame(rows, "u double, v double").withColumn("d", D.distorted(a, b, F.col("u"), F.col("v")))
    for steps, off in ((0, 1e9), (1, 0.5), (5, 1e-9)):
        found = p.withColumn("r", D.restored(a, b, F.col("d.u"), F.col("d.v"), steps) if steps else F.col("d")).collect()
        assert max(abs(r.r.u - r.u) + abs(r.r.v - r.v) for r in found) < off
    for r in found:
        assert r.d.u == pytest.approx(r.u + 2e-6 * r.u**2 - 1e-6 * r.u * r.v + 1e-14 * r.v**4 + 1e-3 * r.u) and r.d.v == pytest.approx(r.v - 3e-6 * r.v**2 + 2e-10 * r.u**2 * r.v + 0.5)


@pytest.mark.parametrize(("ra0", "dec0"), [(10.0, -40.0), (359.99, 0.0), (120.0, 89.5), (0.0, -90.0)])
def test_sky_and_back(spark, ra0, dec0):
    random = np.random.default_rng(3)
    rows = [tuple(map(float, r)) for r in random.uniform(-2000, 2000, (50, 2))]
    cd = tuple(map(F.lit, (-3e-5, 2e-6, 1e-6, 3e-5)))
    p = spark.createDataFrame(rows, "u double, v double").withColumn("s", D.to_sky(F.col("u"), F.col("v"), cd, F.lit(ra0), F.lit(dec0)))
    for r in p.withColumn("p", D.from_sky(F.col("s.ra"), F.col("s.dec"), cd, F.lit(ra0), F.lit(dec0))).collect():
        assert (r.p.u, r.p.v) == pytest.approx((r.u, r.v), abs=1e-6)
        x, y = np.radians(-3e-5 * r.u + 2e-6 * r.v), np.radians(1e-6 * r.u + 3e-5 * r.v)
        a, d = np.radians(ra0), np.radians(dec0)
        east, north = np.array([-np.sin(a), np.cos(a), 0]), np.array([-np.sin(d) * np.cos(a), -np.sin(d) * np.sin(a), np.cos(d)])
        way = np.array([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)]) + x * east + y * north
        ra, dec = np.radians(r.s.ra), np.radians(r.s.dec)
        assert way / np.linalg.norm(way) == pytest.approx(np.array([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)]), abs=1e-12)


def test_grid_is_padded_in_line(spark):
    grid = np.random.default_rng(4).normal(size=(4, 4))
    wide = np.zeros((6, 6))
    wide[1:5, 1:5] = grid
    wide[0, 1:5], wide[5, 1:5] = 2 * grid[0] - grid[1], 2 * grid[3] - grid[2]
    wide[:, 0], wide[:, 5] = 2 * wide[:, 1] - wide[:, 2], 2 * wide[:, 4] - wide[:, 3]
    table = spark.createDataFrame([(grid.ravel().tolist(),)], "g array<double>").select(D.padded(F.col("g"), 4).alias("g"))
    assert np.array(table.first().g).reshape(6, 6) == pytest.approx(wide)
    places = [(0.0, 0.0), (2.5, 1.25), (5.0, 5.0), (4.999, 0.1), (-1.0, 6.0)]
    found = [r[0] for y, x in places for r in table.select(D.bilinear(F.col("g"), 6, F.lit(y), F.lit(x))).collect()]
    for (y, x), v in zip(places, found, strict=True):
        j, i = min(max(int(np.floor(y)), 0), 4), min(max(int(np.floor(x)), 0), 4)
        fy, fx = y - j, x - i
        assert v == pytest.approx(wide[j : j + 2, i : i + 2].ravel() @ [(1 - fy) * (1 - fx), (1 - fy) * fx, fy * (1 - fx), fy * fx])


def test_map_holds_what_the_fit_leaves(spark):
    """At the nodes fit and map are the distortion; between them a cubic is off by the chord alone; the fit is off by far more."""
    images = spark.createDataFrame([(4,), (5,)], "img long")
    u, v = np.meshgrid(np.arange(-32.0, 33, 4), np.arange(-32.0, 33, 4))
    for r in maps.residual_maps(images).collect():
        c3 = (r.img % 5) * 1e-4
        truth = 2e-3 * u * u - 1e-3 * u * v + 0.01 * u + c3 * u**3
        fit = np.stack([np.ones_like(u), u, v, u * u, u * v, v * v], axis=-1) @ np.array(r.c)
        inside = np.array(r.map).reshape(19, 19)[1:-1, 1:-1]
        assert fit + inside == pytest.approx(truth, abs=1e-9)
        assert (np.abs(fit - truth).max() > 0.5) == (r.img == 4)
    assert maps.residual_maps(images.limit(0)).count() == 0


def test_rasters_with_gaps(spark):
    random = np.random.default_rng(6)
    rows, wanted = [], []
    for raster in (1, 2, 3):
        before = 0
        for row in range(40):
            if row % 7 == 3 or raster == 3 and row > 1:
                continue  # rows and whole blocks that are missing
            if raster == 2 and 8 <= row < 24:
                continue
            for x in range(int(random.integers(1, 9))):
                code = int(random.integers(0, 1 << 10))
                rows.append((raster, row // 8, row, x, code))
                wanted.append((raster, row, x, (code - before) % 1024))
                before = code
    table = spark.createDataFrame(rows, "raster int, block int, row int, x int, code long").repartition(7)
    found = rasters.differences(table, ["raster"], ["block", "row", "x"], "code", 10)
    assert sorted(map(tuple, found.select("raster", "row", "x", "diff").collect())) == wanted
    back = rasters.running_sums(found.drop("code"), ["raster"], ["block", "row", "x"], "diff", 10)
    assert sorted(map(tuple, back.select("raster", "block", "row", "x", "code").collect())) == rows
    one = rasters.differences(table, ["raster", "block", "row"], ["x"], "code", 10)
    assert one.count() == len(rows) and rasters.differences(table.limit(0), ["raster"], ["block", "row", "x"], "code", 10).count() == 0

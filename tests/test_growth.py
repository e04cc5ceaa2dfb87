"""What must not grow: broadcasts of tables that follow the input, rows of copies, memory of a batch."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweft import plans
from skyweft.operators import copies, fourier, spots
from skyweft.operators import interpolate as I
from skyweft.operators import kernels as K
from skyweft.operators import lags as L
from skyweft.operators import systems
from skyweft.plans import solve, spot_systems

SF = "/root/testdata/sf0.001"


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_residual_maps_are_not_broadcast(spark):
    assert "Broadcast" not in _plan(plans.queries()["distortion_residuals"](spark, SF))


def test_pairs_of_lenses_need_no_row(spark):
    """Sums by lag against plain loops, at edges of tiles and of the grid, with places that repeat a reach away."""
    random = np.random.default_rng(5)
    at = sorted({(int(y), int(x)) for y, x in random.integers(-9, 17, (150, 2))})
    rows = [(y, x, int(random.integers(0, 3)), float(random.integers(0, 4)), float(random.normal())) for y, x in at]
    wanted = {}
    for ya, xa, lenses, _, _ in rows:
        for y, x, _, n, g in rows:
            if lenses and n and max(abs(y - ya), abs(x - xa)) <= 5:
                key = ya // 5, xa // 5, y - ya, x - xa
                so_far = wanted.get(key, (0, 0))
                wanted[key] = so_far[0] + lenses * n, so_far[1] + lenses * g
    places = spark.createDataFrame([r if r[3] else (*r[:4], 0.0) for r in rows], "gy long, gx long, lenses long, n double, g double")
    found = {tuple(r)[:4]: (r.n, r.g) for r in L.lag_sums(places, "lenses", ["n", "g"], 5).collect()}
    assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k], abs=1e-9) for k in wanted)


@pytest.mark.parametrize("name", ["count_shear", "jackknife_shear"])
def test_shear_of_copies(spark, name, tmp_path):
    """Sixteen copies of a customer at each place give the shears of one and 256 times the pairs."""
    one = spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey < 60")
    for copies in (1, 16):
        keys = one.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("c_custkey", F.col("c_custkey") + F.col("k") * 20937000)
        keys.drop("k").write.parquet(f"{tmp_path}/{copies}/customer.parquet")  # 20937000 is a multiple of every period
    few, many = (sorted(map(tuple, plans.queries()[name](spark, f"{tmp_path}/{c}").collect())) for c in (1, 16))
    if name == "count_shear":
        few = [(r[0], 256 * r[1], *r[2:]) for r in few]
    assert many == [pytest.approx(r, abs=2e-6) for r in few]


def test_two_nodes_keep_their_digits():
    """A system of lineitem whose first weight is 0.5734595000122: nearly equal nodes cost the digits that round it."""
    a, b = np.array([[1, 0.5911857577781763], [0.5911857577781763, 1]]), np.array([[0.9757976889184073, 0.9797282908443904]])
    found = K.cholesky_nodes(a, b, 1.25, [1e-3, 0.1], 0.3, 0.45)
    assert round(float(found.t[0, 1]), 6) == 0.57346
    same = K.cholesky_nodes(a, np.zeros((1, 2)), 1.25, [1e-3, 0.1], 0.3, 0.45)
    assert not same.t.any() and np.isfinite(same.leakage).all()


@pytest.mark.parametrize("name", ["sphere_overlap", "overlap_fractions", "overlap_pixels"])
def test_copies_are_met_as_one(spark, name, tmp_path):
    """All pairs of copies are told, but no join makes more rows than the kinds have pairs."""
    one = spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey < 40")
    one.write.parquet(f"{tmp_path}/1/customer.parquet")
    copied = one.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("c_custkey", F.col("c_custkey") + F.col("k") * 61200).drop("k")
    copied.write.parquet(f"{tmp_path}/12/customer.parquet")
    few, many = (plans.queries()[name](spark, f"{tmp_path}/{c}").collect() for c in (1, 12))
    met = {(r.id_a, r.id_b): tuple(r)[2:] for r in few}
    wanted = sum(1 for a in range(40 * 12) for b in range(a % 40, 40 * 12, 40) if a < b) + 144 * len(met)
    assert len({(r.id_a, r.id_b) for r in many}) == len(many) == wanted
    assert all(met[pair] == tuple(r)[2:] for r in many if (pair := (r.id_a % 61200, r.id_b % 61200)) in met and r.id_a < r.id_b and r.id_a % 61200 < r.id_b % 61200)
    frame = plans.queries()[name](spark, f"{tmp_path}/12")
    assert "ids" in _plan(frame) and "BroadcastHashJoin" not in _plan(frame)


def test_large_kinds_go_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(copies, "PIECE", 3)
    rows = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, v int")
    found = copies.kinds(rows)
    assert sorted(len(r.ids) for r in found.collect()) == [1, 1, 3, 3, 3, 3, 3, 3]
    both = found.select("v", "ids").crossJoin(found.select(F.col("v").alias("w"), F.col("ids").alias("others"))).where("v = w").where(copies.some_rise("ids", "others"))
    pairs = [(r.id_a, r.id_b) for r in copies.members(both, "ids", "others").collect()]
    assert sorted(pairs) == [(a, b) for a in range(20) for b in range(a + 2, 20, 2)]


def test_circles_about_one_place_are_one(spark, tmp_path):
    """A hundred suppliers at one place, of five radii, and customers of one place are looked up once."""
    spark.range(100).selectExpr("id * 1000 + id % 5 * 5000 + 7 as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(60).selectExpr("id * 997000 + 11 as c_custkey").union(spark.range(60).selectExpr("id as c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    frame = plans.queries()["mask_caps"](spark, str(tmp_path))
    assert frame.count() == 120
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3


def test_taps_of_a_batch_take_little_memory():
    """Ten thousand stamps, which a batch of Arrow may have: their taps alone are 512 MB."""
    random = np.random.default_rng(7)
    cube, (y, x) = random.normal(size=(10000, 20, 20)), random.uniform(3, 16, (2, 10000, 64))
    tracemalloc.start()
    found = I.scattered(cube, y, x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
    some = [0, 163, 164, 9999]
    for n in some:
        assert found[n] == pytest.approx(I.scattered(cube[n : n + 1], y[n : n + 1], x[n : n + 1])[0], abs=1e-12)


def test_stamps_are_sent_planes_not_correlations(spark):
    read = lambda table: spark.read.parquet(f"{SF}/{table}.parquet")
    pixels, found = solve.mosaic(read), spot_systems.planes(read)
    rows = spots.stamp_systems(pixels, found, solve.SIDE, solve.RADIUS)
    assert rows.columns == ["j_st", "i_st", "inputs", "spots"]
    planes = np.random.default_rng(9).normal(size=(5, 8, 8))
    for (i, j), lags in zip(zip(*np.triu_indices(5)), fourier.correlations(planes, 7), strict=True):
        assert lags == pytest.approx(fourier.correlate(planes[i : i + 1], planes[j : j + 1], 7)[0], abs=1e-12)


def test_stamps_are_solved_many_at_a_time(spark):
    """No task is called once a stamp, and stamps without pixels of their own don't reach one."""
    read = lambda table: spark.read.parquet(f"{SF}/{table}.parquet")
    frame = plans.queries()["mosaic_empirical"](spark, SF)
    assert "FlatMapGroupsInPandas" not in _plan(frame)
    side = solve.SIDE
    own = {(int((r.py + 0.5) // side), int((r.px + 0.5) // side)) for r in solve.mosaic(read).collect()}
    assert {(r.oy // side, r.ox // side) for r in frame.collect()} == own


def test_inputs_meet_without_rows(spark, monkeypatch):
    """Overlaps of inputs against plain loops, across edges of tiles, with repeated inputs; the plan has no join and sends no input thirteen times."""
    monkeypatch.setattr(systems, "HELD", 40)
    random = np.random.default_rng(3)
    rows = [(int(n % 7), float(y), float(x)) for n, (y, x) in enumerate(random.integers(-20, 60, (300, 2)) * 0.9)]
    rows += rows[:9]
    wanted = {}
    at = [(int((y + 0.5) // 4), int((x + 0.5) // 4)) for _, y, x in rows]
    for a, p in zip(rows, at, strict=True):
        for b, q in zip(rows, at, strict=True):
            dj, di = q[0] - p[0], q[1] - p[1]
            if 0 <= dj <= 2 and abs(di) <= 2 and (dj or di >= 0) and (dj or di or a <= b):
                n, w = wanted.get((*p, dj, di), (0, 0.0))
                wanted[(*p, dj, di)] = n + 1, w + np.exp(-((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) / 4)
    frame = systems.stamp_overlaps(spark.createDataFrame(rows, "img long, py double, px double"), 4)
    found = {tuple(r)[:4]: (r.n, r.overlap) for r in frame.collect()}
    assert found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k]) for k in wanted)
    assert "Join" not in _plan(frame) and "Join" not in _plan(plans.queries()["ii_overlaps"](spark, SF))


@pytest.mark.parametrize("kernel", ["Cholesky", "Eigen", "Iterative", "Empirical"])
def test_stamps_of_one_shape_are_solved_together(kernel, monkeypatch):
    """The same columns as stamp by stamp, one call of the kernel for many stamps, few matrices kept where shapes are many."""
    random = np.random.default_rng(2)
    out = np.stack([g.ravel() for g in np.mgrid[:4, :4]], axis=1).astype(float)
    stamps = []
    for j, n in enumerate([60] * 20 + [45, 33] + [60] * 20):
        places = random.uniform(-1.5, 5, (n, 2))
        stamps.append((j, 0, out, places, random.integers(0, 4, n), random.normal(size=n), systems.gaussian_system(out, places, 1.0, 1.2)))
    rest = (1.5, kernel, [1e-2, 1e-1][: 1 if kernel == "Empirical" else 2], 1e-3, 0.5)
    wanted = {s[0]: systems.outputs(*s, *rest) for s in stamps}
    calls, solve_ = [], K.solve
    monkeypatch.setattr(K, "solve", lambda *a: calls.append(a[1].shape) or solve_(*a))
    for held, most in ((1 << 20, 4), (4 * 3600, 14)):
        monkeypatch.setattr(systems, "HELD", held)
        calls.clear()
        found = {int(s["j_st"][0]): s for s in systems.solved(iter(stamps), *rest)}
        assert found.keys() == wanted.keys() and len(calls) <= most and max(np.prod(c) for c in calls) <= held + 3600
        assert all(found[j][c] == pytest.approx(wanted[j][c], abs=1e-6) for j in wanted for c in wanted[j])


def test_members_are_told_from_both_sides(spark):
    """Kinds met once tell each pair of members once, with the value of its own direction; a kind with itself and pieces of a kind too."""
    rows = spark.createDataFrame([([1, 4, 9],), ([2, 3, 10],), ([9, 9, 12],)], "ids array<long>")
    both = rows.selectExpr("ids as a").crossJoin(rows.selectExpr("ids as b")).where("a <= b")
    found = copies.members_both(both, "a", "b", side=(F.lit("forth"), F.lit("back")))
    kinds = [r.ids for r in rows.collect()]
    wanted = [(min(x, y), max(x, y), "forth" if x < y else "back") for n, p in enumerate(kinds) for q in kinds[n + 1 :] for x in p for y in q if x != y]
    wanted += [(x, y, "forth") for p in kinds for x in p for y in p if x < y]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)

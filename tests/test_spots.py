"""Systems from differing spots against dense algebra, pair of pixels by pair of pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweft.operators import interpolate as I
from skyweft.operators import kernels as K
from skyweft.operators import spots as P
from skyweft.plans import spot_systems

SIDE, RADIUS = 4, 1.5


def identity(y, x):
    return y, x


@pytest.fixture(scope="module")
def scene(spark):
    random = np.random.default_rng(8)
    rows = [(int(i), float(y), float(x), float(v)) for i in range(3) for y, x, v in zip(random.uniform(0, 8, 40), random.uniform(0, 12, 40), random.normal(size=40), strict=True)]
    y, x = np.mgrid[:8, :8] - 3.5
    spots = [(i, [float(v) for v in (np.exp(-(y * y / (2 * w * w) + (x * x + 0.3 * i * x * y) / (2 * u * u))) / 12).ravel()]) for i, (w, u) in enumerate(((1.2, 1.4), (1.5, 1.1), (1.3, 1.3)))]
    pixels = spark.createDataFrame(rows, "img long, py double, px double, v double")
    return rows, spots, pixels, spark.createDataFrame(spots, "img long, spot array<double>")


def direct(planes, target, mine, out):
    """A, B, C with each pair's overlap from a correlation summed place by place."""

    def lags(p, q):
        found = np.zeros((15, 15))
        for dy in range(-7, 8):
            for dx in range(-7, 8):
                for y in range(max(0, -dy), min(8, 8 - dy)):
                    for x in range(max(0, -dx), min(8, 8 - dx)):
                        found[dy + 7, dx + 7] += p[y, x] * q[y + dy, x + dx]
        return np.pad(found, 6)[None]

    names = sorted(planes)
    between = {(s, t): lags(planes[s], planes[t]) for s in names for t in names}
    against = {s: lags(planes[s], target) for s in names}
    at = lambda cube, dy, dx: I.scattered(cube, np.array([[dy + 13]]), np.array([[dx + 13]]))[0, 0]
    a = np.array([[at(between[p[0], q[0]], p[1] - q[1], p[2] - q[2]) for q in mine] for p in mine])
    b = np.array([[at(against[p[0]], p[1] - o[0], p[2] - o[1]) for p in mine] for o in out])
    return a, b, (target**2).sum()


def test_planes_by_group(spark, scene):
    rows, spots, pixels, table = scene
    found = P.planes(pixels, table, SIDE, identity).collect()
    wanted = {(int((r[1] + 0.5) // 4 // 2), int((r[2] + 0.5) // 4 // 2), r[0]) for r in rows}
    assert {(r.gj, r.gi, r.img) for r in found} == wanted and len(found) == len(wanted)
    for r in found:  # under the identity a plane is its spot
        assert r.plane == pytest.approx(dict(spots)[r.img], abs=2e-5)
    assert P.planes(pixels.limit(0), table, SIDE, identity).count() == 0
    odd = spark.createDataFrame([(0, None), (1, [1.0])], "img long, spot array<double>")
    assert {(r.img, max(r.plane)) for r in P.planes(pixels, odd, SIDE, identity).collect()} == {(0, 0.0), (1, 0.0)}


def test_linear_form_and_map_agree_on_a_linear_map(spark, scene):
    _, spots, pixels, table = scene
    turn = lambda y, x: (1.03 * y - 0.07 * x + 5, 0.06 * y + 0.95 * x - 2)
    linear, whole = ({(r.gj, r.gi, r.img): r.plane for r in P.planes(pixels, table, SIDE, turn, form).collect()} for form in (True, False))
    for key, plane in linear.items():
        y, x = (g.ravel() - 3.5 for g in np.mgrid[:8, :8])
        spot = np.pad(np.array(dict(spots)[key[2]]).reshape(8, 8), 6)[None]
        assert plane == pytest.approx(whole[key], abs=1e-9)
        assert plane == pytest.approx(I.scattered(spot, (1.03 * y - 0.07 * x + 9.5)[None], (0.06 * y + 0.95 * x + 9.5)[None])[0].tolist(), abs=1e-9)
    bent = lambda y, x: (y + 0.05 * x * x, x)
    one, other = ({(r.gj, r.gi, r.img): r.plane for r in P.planes(pixels, table, SIDE, bent, form).collect()} for form in (True, False))
    assert max(np.abs(np.subtract(one[k], other[k])).max() for k in one) > 1e-3


@pytest.mark.parametrize(("kernel", "kappas"), [("Cholesky", [0.01]), ("Cholesky", [0.001, 0.01, 0.1]), ("Eigen", [0.01]), ("Eigen", [0.001, 0.1]), ("Iterative", [0.01]), ("Iterative", [0.01, 0.1]), ("Empirical", [0.0])])
def test_systems(spark, scene, kernel, kappas):
    rows, spots, pixels, table = scene
    tilted = lambda y, x: ((1 + 0.02 * F.col("img")) * y + 0.01 * x, x - 0.01 * y)
    planes = P.planes(pixels, table, SIDE, tilted)
    held = {(r.gj, r.gi, r.img): np.array(r.plane).reshape(8, 8) for r in planes.collect()}
    leak, noise = 1e-3, 0.5
    found = {(r.oy, r.ox): r for r in P.solve_stamps(pixels, planes, SIDE, RADIUS, kernel, kappas, most_leak=leak).collect()}
    assert {(y, x) for y in range(8) for x in range(12)} <= {*found}
    for j, i in ((0, 0), (1, 2), (0, 1)):
        low, high = np.array([j, i]) * 4 - 0.5, np.array([j, i]) * 4 + 3.5
        near = [r for r in sorted(rows) if (np.maximum(np.maximum(low - r[1:3], np.array(r[1:3]) - high), 0) ** 2).sum() < RADIUS**2]
        keyed = [((int((r[1] + 0.5) // 8), int((r[2] + 0.5) // 8), r[0]), r[1], r[2]) for r in near]
        out = np.array([(y, x) for y in range(4 * j, 4 * j + 4) for x in range(4 * i, 4 * i + 4)], float)
        a, b, c = direct(held, P.target_plane(1.6), keyed, out)
        values, d = np.array([r[3] for r in near]), np.sqrt(((out[:, None] - np.array([r[1:3] for r in near])[None]) ** 2).sum(axis=2))
        assert a == pytest.approx(a.T, abs=1e-9)
        for k, (y, x) in enumerate(out.astype(int).tolist()):
            r = found[y, x]
            assert r.inputs == len(near)
            if kernel in ("Cholesky", "Eigen") and len(kappas) == 1:
                t = np.linalg.solve(a + kappas[0] * c * np.eye(len(a)), b[k])
                assert (r.value, r.constant, r.sigma, r.leakage) == pytest.approx((t @ values, t.sum(), t @ t, 1 - (2 * t @ b[k] - t @ a @ t) / c), abs=1e-6)
            elif kernel == "Eigen":  # one kappa an output: the residual at the kappa that is told vanishes, and the target is met unless it can't be
                t = np.linalg.solve(a + r.kappa * np.eye(len(a)), b[k])
                assert (r.value, r.sigma) == pytest.approx((t @ values, t @ t), abs=1e-6) and kappas[0] * c * 0.999 <= r.kappa <= kappas[1] * c * 1.001
                assert r.leakage == pytest.approx(1 - (2 * t @ b[k] - t @ a @ t) / c, abs=1e-6)
            else:
                want = K.solve(kernel, (a + a.T) / 2, b, c, d, RADIUS, kappas, leak, noise)
                assert (r.value, r.sigma, r.leakage, r.kappa) == pytest.approx((want.t[k] @ values, want.sigma[k], want.leakage[k], want.kappa[k]), abs=1e-5)
                if kernel == "Iterative" and len(kappas) == 1:  # what it promises is the residual on the inputs near the output
                    some = d[k] < RADIUS
                    rest = ((a + kappas[0] * c * np.eye(len(a))) @ want.t[k] - b[k])[some]
                    assert not want.t[k][~some].any() and rest @ rest <= 1.5e-3**2 * (b[k][some] @ b[k][some]) * 1.0001
                if len(kappas) > 1:
                    assert min(kappas) * c * 0.999 <= r.kappa <= max(kappas) * c * 1.001 and r.sigma == pytest.approx(want.t[k] @ want.t[k], rel=1e-3, abs=1e-9)


def test_registered_spots_differ(spark):
    read = lambda table: spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
    rows = spot_systems.spots(read).limit(50).collect()
    assert all(sum(r.spot) == pytest.approx(1) for r in rows) and len({round(r.spot[27], 6) for r in rows}) > 40


def _stamp(images, places, seed):
    """Inputs in ascending order of their spots, as a stamp has them, with planes of their own and sixteen outputs."""
    random = np.random.default_rng(seed)
    spot = np.repeat(np.arange(images), [len(places(n)) for n in range(images)])
    y, x = np.concatenate([places(n) for n in range(images)]).T
    return spot, y, x, random.normal(size=(images, 8, 8)), np.stack([g.ravel() for g in np.mgrid[8:12, 4:8]], axis=1).astype(float)


def _grid(n):
    return [(8 + i + 0.31 * n, 3 + j + 0.23 * n) for i in range(-2, 5) for j in range(2 + n % 3)]


def _scattered(n):
    return np.random.default_rng(n).uniform(4, 14, (9, 2))


@pytest.mark.parametrize("places", [_grid, _scattered])
def test_assembled_shifts_planes_and_not_pixels(places, monkeypatch):
    """A and B against overlaps summed place by place; no hundred taps for each pair of pixels."""
    monkeypatch.setattr(P, "HELD", 2000)  # by several pieces
    spot, y, x, own, out = _stamp(5, places, 4)
    target = P.target_plane(1.6)
    a, b, c = direct(dict(enumerate(own)), target, list(zip(spot.tolist(), y, x, strict=True)), out)
    monkeypatch.setattr(I, "scattered", None)
    found = P.assembled(spot, y, x, own, out, target)
    # the taps of a whole place differ by 1e-9 on its two sides
    assert found[0] == pytest.approx((a + a.T) / 2, abs=1e-8) and found[1] == pytest.approx(b, abs=1e-8) and found[2] == pytest.approx(c)


def test_pixels_apart_by_more_than_the_lags(monkeypatch):
    """Both ways agree at every separation, those at the ends of a correlation and beyond it too."""
    spot, y, x, own, out = _stamp(2, lambda n: [(i + 0.5 * n, 2 * i + 0.25 * n) for i in range(-14, 15)], 6)
    found = P.assembled(spot, y, x, own, out, P.target_plane(1.6))
    assert P._by_steps(spot, y, x + 0.1 * (np.arange(len(y)) == 3), len(y), np.zeros((3, 15, 15)), np.zeros((2, 2), int)) is None
    monkeypatch.setattr(P, "_by_steps", lambda *_: None)
    for one, other in zip(found, P.assembled(spot, y, x, own, out, P.target_plane(1.6)), strict=True):
        assert one == pytest.approx(other, abs=1e-12)


@pytest.mark.parametrize("name", ["spots_cholesky", "spots_eigen", "spots_iterative"])
def test_planes_are_made_once_and_dealt_out(spark, name):
    """One call that makes planes and one that solves; neither is left to the few tasks that bytes would give it, nothing is broadcast."""
    from skyweft import plans

    plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 2 and plan.count("REPARTITION_BY_NUM") == 2 and "Broadcast" not in plan


def test_two_spots_of_one_exposure(spark, scene):
    """An exposure whose spot comes twice has its inputs once, under one of its planes."""
    _, _, pixels, table = scene
    once, twice = ({(r.j_st, r.i_st): len(r.inputs) for r in P.stamp_systems(pixels, P.planes(pixels, t, SIDE, identity), SIDE, RADIUS).collect()} for t in (table, table.union(table.limit(1))))
    assert once == twice

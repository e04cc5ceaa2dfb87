"""Polynomial distortions of a detector as columns: forward, by Newton's steps backward, and the way to the sky."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers (of u, of v) -> coefficient.
Polynomial = dict[tuple[int, int], Column]


def _power(x: Column, n: int) -> Column:
    out = F.lit(1.0)
    for _ in range(n):
        out = out * x
    return out


def _sum(terms: list[Column]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def value(p: Polynomial, u: Column, v: Column) -> Column:
    return _sum([c * _power(u, i) * _power(v, j) for (i, j), c in p.items()])


def slope(p: Polynomial, u: Column, v: Column) -> tuple[Column, Column]:
    """Derivatives by u and by v."""
    by_u = _sum([i * c * _power(u, i - 1) * _power(v, j) for (i, j), c in p.items() if i])
    return by_u, _sum([j * c * _power(u, i) * _power(v, j - 1) for (i, j), c in p.items() if j])


def distorted(a: Polynomial, b: Polynomial, u: Column, v: Column) -> Column:
    """struct(u, v) of a place moved by both polynomials."""
    return F.struct((u + value(a, u, v)).alias("u"), (v + value(b, u, v)).alias("v"))


def restored(a: Polynomial, b: Polynomial, u: Column, v: Column, steps: int = 5) -> Column:
    """struct(u, v) that the polynomials move to u, v: so many of Newton's steps from there, one expression however many."""

    def step(at: Column, _: Column) -> Column:
        (auu, auv), (bvu, bvv) = slope(a, at["u"], at["v"]), slope(b, at["u"], at["v"])
        fu, fv = at["u"] + value(a, at["u"], at["v"]) - u, at["v"] + value(b, at["u"], at["v"]) - v
        det = (1 + auu) * (1 + bvv) - auv * bvu
        return F.struct((at["u"] - ((1 + bvv) * fu - auv * fv) / det).alias("u"), (at["v"] - ((1 + auu) * fv - bvu * fu) / det).alias("v"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(u.alias("u"), v.alias("v")), step)


def to_sky(u: Column, v: Column, cd: tuple[Column, Column, Column, Column], ra0: Column, dec0: Column) -> Column:
    """struct(ra, dec) in degrees of a place in the tangent plane at (ra0, dec0); cd: degrees a pixel, by rows."""
    x, y = F.radians(cd[0] * u + cd[1] * v), F.radians(cd[2] * u + cd[3] * v)
    d0 = F.radians(dec0)
    down = F.cos(d0) - y * F.sin(d0)
    ra = ra0 + F.degrees(F.atan2(x, down))
    dec = F.degrees(F.atan2(F.sin(d0) + y * F.cos(d0), F.sqrt(x * x + down * down)))
    return F.struct(ra.alias("ra"), dec.alias("dec"))


def from_sky(ra: Column, dec: Column, cd: tuple[Column, Column, Column, Column], ra0: Column, dec0: Column) -> Column:
    """struct(u, v): the inverse of to_sky on the tangent's half of the sky."""
    d, d0, a = F.radians(dec), F.radians(dec0), F.radians(ra - ra0)
    along = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a)
    x = F.degrees(F.cos(d) * F.sin(a) / along)
    y = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a)) / along)
    det = cd[0] * cd[3] - cd[1] * cd[2]
    return F.struct(((cd[3] * x - cd[1] * y) / det).alias("u"), ((cd[0] * y - cd[2] * x) / det).alias("v"))


def bilinear(grid: Column, side: int, y: Column, x: Column) -> Column:
    """The value at (y, x) of a square grid in an array by rows; places beyond the outer nodes follow the outer cell's plane."""
    j, i = (F.greatest(F.lit(0), F.least(F.lit(side - 2), F.floor(p))).cast("int") for p in (y, x))
    fy, fx = y - j, x - i
    at = lambda dj, di: F.element_at(grid, ((j + dj) * side + i + di + 1).cast("int"))
    return (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))


def padded(grid: Column, side: int) -> Column:
    """The grid with one more node on every edge, in line with the two next to it."""
    wide = side + 2
    inside = lambda p: F.greatest(F.lit(0), F.least(F.lit(side - 1), p))

    def node(k: Column) -> Column:
        j, i = (k / wide).cast("int") - 1, (k % wide) - 1
        at = lambda y, x: F.element_at(grid, (y * side + x + 1).cast("int"))
        j0, i0 = inside(j), inside(i)
        j1, i1 = 2 * j0 - j, 2 * i0 - i  # the node beyond the edge's, mirrored inward; the node itself inside
        beyond = lambda y: F.when(i0 == i, at(y, i0)).otherwise(2 * at(y, i0) - at(y, i1))
        return F.when(j0 == j, beyond(j0)).otherwise(2 * beyond(j0) - beyond(j1))

    return F.transform(F.sequence(F.lit(0), F.lit(wide * wide - 1)), node)

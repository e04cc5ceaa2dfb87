"""Correlations against plain sums, with missing and misshapen stamps."""

import numpy as np

from skyweft.operators import fourier


def test_autocorrelation(spark):
    v = np.arange(16.0) ** 2 % 7
    rows = [(1, v.tolist()), (1, v.tolist()), (2, None), (3, [1.0]), (None, [None, *v[1:].tolist()])]
    stamps = spark.createDataFrame(rows, "id long, px array<double>")
    found = fourier.autocorrelation(stamps, "id", "px", 4, 1).collect()
    assert len(found) == 9 * len(rows)
    plain = {(dy, dx): 0.0 for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    s = v.reshape(4, 4)
    for (dy, dx), (y, x) in ((d, p) for d in plain for p in np.ndindex(4, 4)):
        if 0 <= y + dy < 4 and 0 <= x + dx < 4:
            plain[dy, dx] += s[y, x] * s[y + dy, x + dx]
    for i, dy, dx, overlap in found:
        if i in (2, 3):
            assert overlap is None
        else:
            assert abs(overlap - plain[dy, dx]) < 1e-9
    assert fourier.autocorrelation(stamps.limit(0), "id", "px", 4, 1).count() == 0

"""Overlaps of stamps at small lags."""

from __future__ import annotations

from ..operators import fourier
from .registry import PIX, query, r6


@query(f"""with {PIX} select a.vec_id, cast(b.y - a.y as bigint) dy, cast(b.x - a.x as bigint) dx, round(sum(a.v * b.v), 6) overlap
from pix a join pix b on a.vec_id = b.vec_id and abs(b.y - a.y) <= 2 and abs(b.x - a.x) <= 2 group by all""")
def psf_correlation(read):
    """Correlation of every stamp with itself at lags of up to two pixels; no shuffle."""
    out = fourier.autocorrelation(read("embeddings"), "vec_id", "embedding", 8, 2)
    return out.select("vec_id", "dy", "dx", r6("overlap", "overlap"))

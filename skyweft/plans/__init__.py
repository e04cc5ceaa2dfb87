"""Registered queries and their SQL."""

from . import aggregates, blocks, coadds, codes, footprints, interp, maps, more, overlaps, selection, shapes, solve, sphere, spot_systems, texts  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)

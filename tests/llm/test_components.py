"""Components against a search over neighbours: chains, hubs, repeated links and loops, however tasks hold the links."""

import random

import numpy as np
import pytest

from skyweft.llm import base, components


def brute(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        if start in out:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return {x: r for x, r in out.items() if x != r}


def some_links(seed):
    rng = random.Random(seed)
    chain = [(i * 7919 % 10007 - 5000, (i + 1) * 7919 % 10007 - 5000) for i in range(700)]
    hub = [(20_000, 20_001 + i) for i in range(900)]
    rest = [(rng.randrange(30_000, 31_000), rng.randrange(30_000, 31_000)) for _ in range(600)]
    out = chain + hub + rest + rest[:50] + [(b, a) for a, b in hub[:50]] + [(7, 7)]
    rng.shuffle(out)
    return out


def test_stars():
    links = some_links(1)
    a, b = components.stars(*np.array(links, np.int64).T)
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == brute(links) and len(a) == len(set(a.tolist()))
    assert [len(x) for x in components.stars(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_roots(spark, coalesce):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, coalesce)
    try:
        links = some_links(2)
        found = components.roots(spark.createDataFrame(links, "a long, b long")).collect()
    finally:
        spark.conf.unset(key)
    assert {r.a: r.b for r in found} == brute(links) and len(found) == len({r.a for r in found})
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_graphs_go_by_few_tasks(spark, monkeypatch):
    """As many shuffle partitions as a large job has don't make as many tasks and files of a few links, and stars need no round."""
    monkeypatch.setattr(components, "_held", lambda batches: batches)  # tasks join nothing, so that rounds are needed
    links = [(k + 1, k) for k in range(40)] + [(1000 + k, 1000) for k in range(1, 30)]
    written = []

    def durable(table):
        written.append(base.durable(table))
        return written[-1]

    monkeypatch.setattr(components, "durable", durable)
    monkeypatch.setattr(components, "discard", lambda *tables: None)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        found = components.roots(spark.createDataFrame(links, "a long, b long"), parts=3)
        assert {tuple(r) for r in found.collect()} == {(k, 0) for k in range(1, 41)} | {(1000 + k, 1000) for k in range(1, 30)}
        assert len(written) > 2 and all(len(table.inputFiles()) <= 3 for table in written)
        written.clear()
        assert components.roots(found, parts=3).count() == 69 and len(written) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    some = spark.range(100, numPartitions=7)
    assert base.parts_for(some) == spark.sparkContext.defaultParallelism
    assert base.merged(some, None).rdd.getNumPartitions() == 7 and base.merged(some, 2).rdd.getNumPartitions() == 2

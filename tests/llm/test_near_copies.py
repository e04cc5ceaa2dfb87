"""Near copies of the pipeline against brute force over all pairs."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyweft.llm import near_copies
from skyweft.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(texts):
    sets = list({brute_set(t) for t in texts})
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                parent[root(i)] = root(j)
    return {x: root(i) for i, x in enumerate(sets)}


def texts():
    random = np.random.default_rng(7)
    out = [None, "", " \n", "Two words", "two  WORDS", "two other"]
    for base in range(12):
        words = [f"w{x}" for x in random.integers(0, 3000, int(random.integers(20, 300)))]
        out.append(" ".join(words))
        for _ in range(10 if base else 60):  # the first group is a dense one
            copy = list(words)
            for at in random.integers(0, len(words), int(random.integers(1, 2 + len(words) // 18))):
                copy[at] = f"x{random.integers(0, 3000)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("most", "tile", "asked"), [(16, 2048, near_copies.ASKED), (2, 8, 3)])
def test_components(spark, monkeypatch, most, tile, asked):
    monkeypatch.setattr(near_copies, "ASKED", asked)
    mine = texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(mine)], "doc_id long, text string")
    seen, links = near_copies.components(docs, most, tile)
    up, of, found = dict(links.collect()), dict(seen.collect()), {}
    for r in near_copies.hashed(docs, "doc_id").collect():
        found.setdefault(up.get(of[r.th], of[r.th]), set()).add(r.doc_id)
    groups, wanted = brute_groups(mine), {}
    for i, t in enumerate(mine):
        wanted.setdefault(groups[brute_set(t)], set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))
    assert [x.count() for x in near_copies.components(docs.limit(0))] == [0, 0]


def test_stage_finds_copies_at_similarity(spark):
    """Four changed words of 200 leave a Jaccard similarity of 0.81, five leave 0.77."""
    words = [f"word{i}" for i in range(200)]
    copy = " ".join("other" if i in (30, 70, 110, 150) else w for i, w in enumerate(words))
    below = " ".join("other" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(words))
    assert (fingerprint(" ".join(words).encode()) ^ fingerprint(copy.encode())).bit_count() > 4  # no link of op2
    docs = spark.createDataFrame([(1, " ".join(words)), (2, copy), (3, below)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicated(spark, docs, SF).collect()) == [1, 3]


def test_stage_keeps_a_row_of_each_group(spark):
    """Equal and missing ids: one row of each group, however they share ids."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (5, d), (7, a + " end"), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.deduplicated(spark, docs, SF)
    assert found.schema == docs.schema
    assert Counter(map(tuple, found.collect())) == Counter([(None, b), (5, c), (5, d), (7, a + " end"), (9, "")])


def test_stage_leaves_columns_alone(spark):
    """Columns with the operator's own names, and of a type that can't be hashed, come back as they were."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, a), (3, b), (None, "")], "doc_id long, text string")
    for name in ("_row", "_th", "_set", "ROOT", "least", "id", "th", "row", "a", "b"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs = docs.withColumn("facts", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("two words", F.array(F.struct(F.col("facts"))))
    found = corpus_pipeline.deduplicated(spark, docs, SF)
    assert found.schema == docs.schema
    assert sorted(map(repr, found.collect())) == sorted(repr(r) for r in docs.collect() if r.doc_id != 2)


def test_counts_never_rule_out_similar_sets():
    random = np.random.default_rng(9)
    ruled_out = 0
    for size in (1, 7, 60, 300, 2000, 9000):
        for share in (0.0, 0.5, 0.78, 0.8, 0.9, 1.0):
            both = random.integers(0, 2**64, int(size * share), dtype=np.uint64)
            x, y = (np.concatenate([both, random.integers(0, 2**64, size - len(both), dtype=np.uint64)]) for _ in range(2))
            alike = 9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y))
            may = near_copies.may_agree(near_copies.bucket_counts(x), near_copies.bucket_counts(y), len(x), len(y))
            assert may or not alike
            ruled_out += not may
    assert ruled_out > 8
    one = np.full(3000, 1 << 41, np.uint64)  # more in one bucket than can be counted
    assert near_copies.may_agree(near_copies.bucket_counts(one), near_copies.bucket_counts(one), 3000, 3000)


def test_dense_tiles_give_few_pairs_a_set():
    """Sets of a tile that are all alike give a few likely pairs each, and their key for a second look; the pairs in full are a square.
    Sets that fail by a third of their shingles give none."""
    random = np.random.default_rng(11)
    shared, n = random.integers(0, 2**64, 130, dtype=np.uint64), 120

    def found(own, nearest):
        sets = [np.concatenate([shared[own:], random.integers(0, 2**64, own, dtype=np.uint64)]) for _ in range(n)]
        counts = [near_copies.bucket_counts(x).tobytes() for x in sets]
        ids, size_place = np.arange(n), np.full(n, len(shared) << near_copies.SIZE_BITS)
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(n, 5), np.zeros(n, np.int64), ids, size_place, ids)] + [pa.array(counts, pa.binary())], ["key", "tile", "id", "size_place", "root", "counts"])
        out = [tuple(r.values()) for x in near_copies._across(near_copies.NEAR, 0, nearest)(iter([batch])) for r in x.to_pylist()]
        return [x for x in out if x[0] is not None], {x[2] for x in out if x[0] is None}

    pairs, keys = found(4, near_copies.NEAREST)
    assert n - 1 <= len(pairs) <= near_copies.NEAREST * n and keys == {5}
    assert len(found(4, None)[0]) == n * (n - 1) // 2
    assert found(40, None) == ([], set())

"""The n-gram join, the filter audit and the hard negatives against brute force and SQL, on awkward rows too."""

import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from skyweft.llm import filter_audit, hard_negatives, ngram_join

SF = "/root/testdata/sf0.001"
CLASHING = ("key", "id", "size", "a", "b", "root", "least", "mask", "part", "first", "n", "good", "rank", "step", "q", "done", "cell", "block", "windows", "label_", "component_id", "_place")


@pytest.mark.parametrize("name", ["op11_ngram_join", "op12_filter_audit", "op13_hard_negatives"])
def test_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        connection.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = __spark_entry__.queries()[name](spark, SF)
    result = connection.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(found.columns) == sorted(columns)
    wanted = result.fetchall()
    assert wanted and Counter(map(tuple, found.select(*columns).collect())) == Counter(wanted)


def clashing(table):
    for name in CLASHING:
        table = table.withColumn(name, F.lit("x"))
    return table


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return Counter((doc_id, len(sets[i]), least.get(root(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


def copies():
    """Dense and loose groups, shared passages, and pairs that are just alike or just not."""
    random = np.random.default_rng(11)
    passage = " ".join(f"p{i}" for i in range(60))
    out = [None, "", " \n\t", "two words", "TWO  words", "two other", "one", "long " * 4000, "a b c a b c a b c"]
    for base in range(14):
        words = [f"w{x}" for x in random.integers(0, 2000, int(random.integers(5, 200)))]
        out.append(" ".join(words))
        for _ in range(8 if base else 70):
            copy = list(words)
            for at in random.integers(0, len(words), int(random.integers(1, 2 + len(words) // 40))):
                copy[at] = f"x{random.integers(0, 3000)}"
            out.append(" ".join(copy))
        out.append(passage + " " + " ".join(f"y{x}" for x in random.integers(0, 9000, int(random.integers(3, 12)))))
    for n in (29, 30, 58, 59, 61, 200):  # one changed word at the end
        out += [" ".join(f"z{n}_{i}" for i in range(n)), " ".join(f"z{n}_{i}" for i in range(n - 1)) + " last"]
    return out


@pytest.mark.parametrize(("most", "tile"), [(48, 2048), (2, 8), (1, 3), (10**6, 64)])
def test_join(spark, monkeypatch, most, tile):
    plain = ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda docs, rule: plain(docs, most, tile, rule))
    rows = [(i, t) for i, t in enumerate(copies())]
    rows += [(None, "two words"), (None, rows[12][1]), (3, rows[12][1]), (3, rows[12][1]), (None, "only here without an id"), (7, None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = ngram_join.join(docs)
    assert Counter(map(tuple, found.collect())) == brute_join(rows)
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_matches_asked_are_the_cheapest(spark):
    """A set whose postings are its own asks for one match; one with frequent ones for as many as lower its cost."""
    rule = ngram_join.CLOSE
    rows = [(k, 1, (100 << 32) | k, 2) for k in range(11)] + [(k, 2, (100 << 32) | k, 40) for k in range(14)] + [(0, 3, 1 << 32, 40)]
    posted = spark.createDataFrame(rows, "key long, id long, size_place long, sets long")
    found = dict(ngram_join.matches_asked(posted, rule, 4).collect())

    def cost(size, sets, prefix):
        first = size - -(-9 * size // 10) + 1
        return {
            need: (others := sum(s - 1 for s in sets[: first + need - 1])) + others / need * (ngram_join.CANDIDATE + ngram_join.THOUSAND * size / 1000)
            for need in range(1, min(4, prefix) + 1)
        }

    for ident, size, sets in ((1, 100, [2] * 11), (2, 100, [40] * 14), (3, 1, [40])):
        costs = cost(size, sets, max(1, -(-9 * size // 10)))
        assert found[ident] == min(costs, key=lambda need: (costs[need], need))
    assert found[2] > 1 and found[3] == 1


def test_intervals_cover_every_order():
    assert filter_audit.ORDERS == sorted(filter_audit.ORDERS) and len(filter_audit.ORDERS) == 120
    covered = Counter()
    for mask, step, first, after in filter_audit.intervals():
        for rank in range(first, after):
            assert rank < 120 and mask >> "ABCDE".index(filter_audit.ORDERS[rank][step - 1]) & 1
            covered[mask, rank] += 1
    assert covered == Counter(dict.fromkeys(itertools.product(range(1, 32), range(120)), 1))


def brute_audit(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    masked = []
    for doc_id, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len({*words}) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = doc_id is not None and doc_id > least[t]
        masked.append((source or "", {x for x, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out = []
    for part in {m[0] for m in masked}:
        mine, shapley, figures = [m for m in masked if m[0] == part], Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if letter in m[1]]
                redundant = sum(letter in m[1] for m in mine) - len(gone)
                left = [m for m in left if letter not in m[1]]
                shapley[letter] += len(gone)
                figures.append((part, order, step, len(left), len(gone), redundant, sum(m[1] == {letter} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)))
        out += [(*f, shapley[f[1][f[2] - 1]]) for f in figures]
    return Counter(out)


def test_audit(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "x"), (2, words, "x"), (2, words, "x"), (3, words, None), (None, words, "x"), (None, words, "x"), (None, None, None), (4, None, "x"), (5, "", "y")]
    rows += [(6, "SHOUT " * 60, "y"), (7, words + " #", "y"), (8, words.replace("word7 ", "word8 "), "x"), (9, "é日本 \x0b a b" * 30, "x"), (10, "long " * 30000, "z"), (11, "same same", "z"), (11, "other", "z")]
    marks = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (None, 1, 1), (7, 0, 1), (10, 1, None), (99, 1, 1)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("good", F.lit(3))
    found = filter_audit.audit(docs, labels)
    assert Counter(map(tuple, found.collect())) == brute_audit(rows, marks)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert sum(r.removed for r in filter_audit.audit(docs, labels.limit(0)).collect()) == sum(k[4] * v for k, v in brute_audit(rows, []).items())


def brute_negatives(rows, every=50):
    usable = {}
    for vec_id, label, vector in rows:
        if vec_id is not None and label is not None and vector is not None and all(v is not None and np.isfinite(v) for v in vector):
            q = [int(np.floor(256 * v)) for v in vector]
            usable[vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(q)] = True
    out = Counter()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for anchor, label, q in usable:
        if anchor % every:
            continue
        scored = sorted((-dot(q, y), i, x) for i, x, y in usable if i != anchor or x != label)
        for ps, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            for rank, (ns, negative, _) in enumerate(inside, 1):
                out[anchor, positive, rank, negative, -ps, -ns] += 1
    return out


@pytest.mark.parametrize(("block", "first"), [(512, 2048), (4, 6)])
def test_hard_negatives(spark, monkeypatch, block, first):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "FIRST", first)
    monkeypatch.setattr(hard_negatives, "GROWTH", 3)
    random = np.random.default_rng(5)
    centres = random.normal(size=(6, 7))
    rows = [(i, int(random.integers(0, 4)), [float(v) for v in np.round(centres[i % 6] + random.normal(size=7) * 0.2, 2)]) for i in range(400)]
    rows += [(400 + i, 2, rows[50][2]) for i in range(40)] + [(440 + i, 3, rows[50][2]) for i in range(10)]  # copies, ties
    nan, inf = float("nan"), float("inf")
    rows += [(500, None, [1.0]), (550, 1, None), (600, 1, [1.0, None]), (650, 1, [nan]), (700, 1, [-inf]), (None, 1, [1.0]), (750, 9, [5.0] * 7), (800, 2, [3.0, 1.0]), (850, 2, [])]
    rows += [rows[100], rows[100], (100, 1, [2.0] * 7), (900, 4, [-1.0] * 7)]
    table = clashing(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    rows = [(i, x, None if v is None else [None if y is None else float(np.float32(y)) for y in v]) for i, x, v in rows]
    found = hard_negatives.mine(table)
    assert Counter(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == brute_negatives(rows)
    assert hard_negatives.mine(table.limit(0)).count() == 0


def test_cells_come_in_falling_order():
    random = np.random.default_rng(3)
    first, second = random.normal(size=9), random.normal(size=13)
    found = list(hard_negatives.cells_by_bound(first, second))
    assert {(i, j) for i, j, _ in found} == set(itertools.product(range(9), range(13)))
    assert all(a[2] >= b[2] for a, b in itertools.pairwise(found)) and all(np.isclose(s, first[i] + second[j]) for i, j, s in found)

"""The language model of op6 on scripts and languages that the given tables don't have."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from skyweft.llm import quality_rules

CYRILLIC = [chr(0x430 + i) for i in range(32)]


def prose(random, vocabulary, n):
    """Words that mostly follow one another as fixed by the vocabulary."""
    at, out = int(random.integers(len(vocabulary))), []
    for _ in range(n):
        out.append(vocabulary[at])
        at = (at * 7 + int(random.integers(0, 3))) % len(vocabulary)
    return " ".join(out)


def seen(text):
    return re.sub(r"[\s\x00-\x1f\x7f]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), re.sub("[0-9]", "0", text or "")))


class Brute:
    """Modified Kneser-Ney of one language and one fold, with dictionaries; `every` has the texts of both folds."""

    def __init__(self, texts, every, order=5):
        def grams(some, k):
            return Counter(t[i - k + 1 : i + 1] for t in (" " * (order - 1) + seen(x) for x in some) for i in range(order - 1, len(t)))

        self.counts = {order: grams(texts, order)}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.letters = len(grams(every, 1))
        self.discounts, self.contexts = {}, {}
        for k, c in self.counts.items():
            t = [max(1, sum(n == i for n in c.values())) for i in (1, 2, 3, 4)]
            y = t[0] / (t[0] + 2 * t[1])
            self.discounts[k] = [0.0] + [min(float(i), max(quality_rules.LEAST_DISCOUNT, i - (i + 1) * y * t[i] / t[i - 1])) for i in (1, 2, 3)]
            self.contexts[k] = defaultdict(list)
            for g, n in c.items():
                self.contexts[k][g[:-1]].append(n)

    def p(self, gram):
        if not gram:
            return 1 / (self.letters + 1)
        k, lower = len(gram), self.p(gram[1:])
        d, mine = self.discounts[k], self.contexts[k].get(gram[:-1])
        if not mine:
            return lower
        n = self.counts[k].get(gram, 0)
        return (n - d[min(n, 3)] + sum(d[min(x, 3)] for x in mine) * lower) / sum(mine)


def brute_loss(rows, mine):
    """Mean log loss a word of text `mine` by the texts of its language in the other fold."""
    every = [t for _, t, x in rows if x == rows[mine][2]]
    fold = lambda t: zlib.crc32((t or "").encode()) & 1
    model = Brute([t for t in every if fold(t) != fold(rows[mine][1])], every)
    text = " " * 4 + seen(rows[mine][1])
    return -sum(math.log(model.p(text[i - 4 : i + 1])) for i in range(4, len(text))) / (len(re.findall(r"[^\x20\x09-\x0D]+", rows[mine][1])) + len(re.findall("[日本語]", rows[mine][1])))


@pytest.mark.parametrize("core", [quality_rules.CORE, 50])
def test_losses_and_many_languages(spark, monkeypatch, core):
    """Whatever the size of the core, every n-gram counts."""
    monkeypatch.setattr(quality_rules, "CORE", core)
    random = np.random.default_rng(4)
    rows, junk = [], []
    for k in range(40):
        vocabulary = ["".join(random.choice(CYRILLIC, int(random.integers(2, 8)))) for _ in range(60)]
        for _ in range(14):
            rows.append((len(rows), prose(random, vocabulary, 60), f"l{k}"))
        junk.append(len(rows))
        rows.append((len(rows), " ".join("".join(random.choice(CYRILLIC, int(random.integers(2, 8)))) for _ in range(60)), f"l{k}"))
    rows.append((len(rows), "\x01 Mixed 12 \U0001f389\u3000日本語 " * 9, "l0"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i in (0, 14, 37, 599, 600):
        assert found[i].log_perplexity == pytest.approx(brute_loss(rows, i), rel=1e-6)
    assert not any(found[i].kept for i in junk)
    assert sum(r.kept for r in found.values()) > 0.95 * (len(rows) - len(junk))


def test_slices_and_broken_bytes(spark, monkeypatch):
    docs = spark.sql("select 1 doc_id, cast(x'61ff62' as string) text, 'x' lang union all select 2, repeat('some words ', 3000), 'x' union all select null, null, null")
    wanted = {r.doc_id: r.log_perplexity for r in quality_rules.judge(docs).collect()}
    monkeypatch.setattr(quality_rules, "SLICE", 1000)
    found = {r.doc_id: r.log_perplexity for r in quality_rules.judge(docs).collect()}
    assert found.keys() == wanted.keys() == {1, 2, None} and found[None] is None
    assert all(found[i] == pytest.approx(wanted[i], rel=1e-6) for i in (1, 2))

"""The ten operators against brute force, on the smallest table and on awkward rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from skyweft.llm import bpe_automaton, flac, license_scan, packing, pii, quality_crf, quality_rules, range_coder, simhash, token_store, toxicity
from skyweft.llm.base import fold, labelled_sample

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
COPY = " ".join(f"word{i}" for i in range(200))
AWKWARD = [
    (10001, None), (10002, ""), (10003, " \n\t\r\x0b\x0c "), (10004, "tie tie tie"), (10004, "tie tie tie"), (None, "no id at all"), (None, None),
    (10005, "CC-BY cc by GNU General Public License, all rights RESERVED; licensed under the apache license, version 2.0"),
    (10006, "mail a.b@c.de x_y@d.e.f, +49 (030) 123-4567 and 4111 1111-1111 1111 at 1.2.3.4.5 or 300.1.1.1 ññ 10.0.0.1 a@b.c_x@d.ee"),
    (10007, COPY), (10008, COPY.replace("word77", "other")), (10009, COPY), (10010, "long " * 30000), (10011, "<|endoftext|>don't <|endoftext|> 日本語 \U0001f389 0́"),
    (10012, "4" * 5000 + " " + "a" * 5000 + "@"), (10013, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'),
]


@pytest.fixture(scope="module")
def table(spark):
    """The smallest table with the awkward rows and columns whose names the operators use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame(AWKWARD, "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) lang", "'s' source", "cast(null as long) n_chars")
    out = docs.unionByName(more)
    for name in ("_pii", "_pii_candidates", "_row", "_set", "_salt", "row", "loss", "score", "label", "_label", "fp", "key", "language", "kept", "component_id", "a", "b"):
        out = out.withColumn(name, F.lit("x"))
    return out.cache()


@pytest.fixture(scope="module")
def rows(table):
    return [(r[0], r[1] or "") for r in table.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(table):
    return table.limit(0)


def same(found, wanted):
    assert Counter(map(tuple, found)) == Counter(wanted)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_license_scan(table, rows, empty):
    wanted = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        wanted.append((doc_id, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    found = license_scan.scan(table)
    same(found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect(), wanted)
    for r in found.collect():
        assert 0 <= r.score <= 1 and {*r.base_labels.split(",")} <= {*r.labels.split(","), ""}
    assert found.where("doc_id = 10005").first().labels == "apache-2.0,cc-by,gpl,reserved"
    assert license_scan.scan(empty).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: (doc_id, fingerprint) -> smallest doc_id of each row's component."""
    parent = {p: p for _, p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = list(parent)
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if (x ^ y).bit_count() <= 4:
                parent[root(x)] = root(y)
    least = defaultdict(list)
    for doc_id, p in prints:
        least[root(p)].append(doc_id)
    return [min((d for d in least[root(p)] if d is not None), default=None) for _, p in prints]


def test_simhash(table, rows, empty):
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    wanted = [(d, format(p, "016x"), c) for (d, p), c in zip(prints, brute_components(prints), strict=True)]
    found = simhash.near_duplicates(table)
    same(found.select("doc_id", simhash.hexed(), "component_id").collect(), wanted)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile", [4096, 16])
def test_simhash_links_dense_and_chained(spark, tile):
    random = np.random.default_rng(3)
    words = {int(x) for x in random.integers(0, 2**64, 200, dtype=np.uint64)}
    center = int(random.integers(0, 2**64, dtype=np.uint64))
    words |= {center ^ sum(1 << int(b) for b in random.choice(64, random.integers(0, 5), replace=False)) for _ in range(300)}
    chain = center ^ 0xFFFFFFFF
    for step in range(12):
        chain ^= 0b1111 << 4 * step
        words.add(chain)
    prints = [(i, w) for i, w in enumerate(sorted(words))]
    table = spark.createDataFrame([(np.uint64(w).astype(np.int64).item(),) for _, w in prints], "fp long")
    from skyweft.llm.components import roots

    up = {r.a: r.b for r in roots(simhash.links(table, 4, tile)).collect()}
    groups, wanted = defaultdict(set), defaultdict(set)
    for (i, w), c in zip(prints, brute_components(prints), strict=True):
        signed = np.uint64(w).astype(np.int64).item()
        groups[up.get(signed, signed)].add(i)
        wanted[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


@pytest.mark.parametrize(("module", "label", "modulus", "kept"), [(toxicity, "toxic", 5, 0), (quality_crf, "quality", 3, 1)])
def test_classifiers(spark, table, empty, module, label, modulus, kept):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    scored = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    held = [(scored[r.doc_id], r[1]) for r in labels.select("doc_id", label).collect() if r.doc_id in scored and fold(r.doc_id) % modulus == kept]
    ones, zeros = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    area = np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])
    assert area > 0.9 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.9
    again = module.score(table, model).collect()
    assert len(again) == table.count() and all(0 <= r.score <= 1 for r in again)
    kept_rows = module.keep(table, model)
    assert kept_rows.schema == table.schema and module.score(empty, model).count() == 0
    split = sum(r.score < 0.5 for r in again)
    assert kept_rows.count() == (split if module is toxicity else len(again) - split)
    long = spark.createDataFrame([(5, "x" * 70000), (7, "one text"), (7, "another"), (11, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality long, toxic long")
    assert labelled_sample(long, marks, label, 99, 98, 20) == [(b"another", 1), (b"", 1)]
    one = module.train([(b"only one label", 1)])
    assert one.scores(np.frombuffer(b"x", np.uint8), np.array([0, 1]))[0] > 0.5
    assert module.train([]).scores(np.zeros(0, np.uint8), np.array([0, 0]))[0] == 0.5


def test_crf_marginals():
    random = np.random.default_rng(5)
    unary, table, doc = random.normal(size=6), random.normal(size=(2, 2)), np.array([0, 0, 0, 0, 1, 2])
    good, pairs, total = quality_crf._chain(unary, doc, table)
    weights = np.zeros((6, 2))
    for d in range(3):
        mine = np.flatnonzero(doc == d)
        for state in range(2 ** len(mine)):
            y = [state >> i & 1 for i in range(len(mine))]
            w = math.exp(sum(unary[m] * s for m, s in zip(mine, y, strict=True)) + sum(table[a, b] for a, b in zip(y, y[1:], strict=False)))
            for m, s in zip(mine, y, strict=True):
                weights[m, s] += w
    assert np.allclose(good, weights[:, 1] / weights.sum(axis=1)) and np.allclose(pairs.sum(axis=(1, 2)), 1)


def test_packing(table, rows, empty):
    tokenizer = Tokenizer.from_file(PATH)
    ids = [(d, [*tokenizer.encode(t, add_special_tokens=False).ids, 0]) for d, t in rows]
    found = packing.pack(table, PATH, docs_a_group=64).collect()
    assert sum(r.length for r in found) == sum(len(x) for _, x in ids)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for d, x in ids:
        if sum(i == d for i, _ in ids) == 1:
            at = 0
            for start, length, crc, n in sorted(by_id[d]):
                assert start == at and n == len(x) and crc == zlib.crc32(np.array(x[start : start + length], "<u4").tobytes())
                at += length
            assert at == len(x)
    assert packing.pack(empty, PATH).count() == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def test_pii(table, rows, empty):
    wanted = []
    for d, t in rows:
        spans = sorted((m.start(), list(BASE).index(k), k, m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, t) if ok(m[0]))
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
        wanted.append((d, *(sum(x[2] == k for x in spans) for k in BASE), hashlib.sha256(joined.encode()).hexdigest(), joined))
    found = pii.report(table).collect()
    same([r[:6] for r in found], [w[:6] for w in wanted])
    base = {w[5]: {*w[6].split(",")} for w in wanted}
    assert all(base[r.base_sha256] - {""} <= {*r.spans.split(",")} for r in found)
    more = table.sparkSession.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").union(table.where("doc_id = 10013").select("doc_id", "text"))
    more = pii.report(more)
    assert any("secret:9:49" in r.spans for r in more.where("doc_id = 10013").collect())
    assert more.where("spans like '%account:%'").count() == 0  # digit runs that fail the check
    out = pii.redact(table)
    assert out.columns == table.columns and out.count() == len(rows)
    text = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
    assert text[10001] is None and text[10002] == "" and text[10006].startswith("mail [EMAIL] [EMAIL], [PHONE] and [CARD] at [IP].5 or 300.1.1.1 ññ [IP] [EMAIL]")
    assert pii.report(empty).count() == 0


def test_pii_many_spans(spark):
    """Thousands of matches in one text, past the size of a chunk; spans that overlap are replaced once."""
    text = " ".join(f"ñ{i} me{i}@x.org" for i in range(3000)) + " é"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.report(docs).first()
    assert found.n_email == 3000 and found.spans == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"me[0-9]+@x\.org", text))
    assert pii.redact(docs).first().text == " ".join(f"ñ{i} [EMAIL]" for i in range(3000)) + " é"
    both = spark.createDataFrame([(1, "call +1.2.3.4 5678901 now 10.0.0.1")], "doc_id long, text string")
    spans = pii.report(both).first()
    assert (spans.n_ip, spans.n_phone) == (2, 1) and pii.redact(both).first().text == "call [PHONE] now [IP]"
    votes = {(v1, v2, v3, v4): 1.0 for v1 in (-1, 1) for v2 in (-1, 0, 1) for v3 in (0, 1) for v4 in (-1, 0, 1)}
    # one labeler that is always right and three that guess: EM must find the one, whichever it is
    random = np.random.default_rng(3)
    for right in range(4):
        counts = Counter()
        for truth in random.integers(0, 2, 4000):
            v = [int(random.choice((-1, 1))) if random.random() < 0.35 else 2 * int(truth) - 1 for _ in range(4)]
            v[right] = 2 * int(truth) - 1
            counts[tuple(v)] += 1
        _, tables = pii.reliabilities(sorted(counts.items()))
        assert tables[right][1][2] > 0.95 and tables[right][0][0] > 0.95 and len(votes) == 36


def test_quality_rules(table, rows, empty):
    wanted = []
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        count = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        n = len(words)
        wanted.append((d, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n))
    found = quality_rules.judge(table)
    same(found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), wanted)
    assert not any(r.kept and r.base_failed for r in found.collect())
    assert found.where("kept").count() > 0.8 * found.where("not base_failed").count()
    assert quality_rules.judge(empty).count() == 0


def test_flac(table, rows, empty, spark):
    found = flac.features(flac.store(table)).collect()
    wanted = []
    for d, t in rows:
        raw = t.encode()
        whole = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        wanted.append((d, len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:])))
    same([r[:5] for r in found], wanted)
    assert len({r.media_sha256 for r in found}) == len({r.payload_sha256 for r in found})
    media = flac.store(table.where("doc_id in (10007, 10010)"))
    for r in media.collect():
        text = next(t for d, t in rows if d == r.doc_id).encode()
        scalar = bytes(x + 128 for x in flac.decode_stream(r.media)[0])
        assert scalar[: len(text)] == text
        blocks = flac.pcm_blocks(media.where(F.col("doc_id") == r.doc_id)).orderBy("sample_offset").collect()
        assert b"".join(b.pcm for b in blocks) == scalar and [b.sample_offset for b in blocks] == list(range(0, len(scalar), 1024))
        broken = bytearray(r.media)
        broken[-100] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])
    assert flac.features(flac.store(empty)).count() == 0


def test_flac_linear_prediction():
    """A hand-made stereo frame: LPC of order two with two Rice partitions on the left, constant on the right."""
    bits = []

    def put(value, n):
        bits.extend(value >> (n - 1 - i) & 1 for i in range(n))

    left = [10, 12, 15, 17, 22, 24, 25, 31]
    put(0, 1), put(32 + 1, 6), put(0, 1)
    put(left[0], 8), put(left[1], 8)
    put(4 - 1, 4), put(1, 5), put(4 & 15, 4), put(-2 & 15, 4)  # (4 a - 2 b) >> 1
    put(0, 2), put(1, 4)
    rest = [left[i] - ((4 * left[i - 1] - 2 * left[i - 2]) >> 1) for i in range(2, 8)]
    for part in (rest[:2], rest[2:]):
        put(2, 4)
        for r in part:
            z = 2 * r if r >= 0 else -2 * r - 1
            put(1, (z >> 2) + 1), put(z & 3, 2)
    put(0, 8), put(-3 & 255, 8)
    bits += [0] * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0b0110_0000, 0b0001_001_0, 0, 7])
    frame = head + bytes([flac.crc8(head)]) + np.packbits(bits).tobytes()
    frame += int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    info = bytes(10) + (8000 << 44 | 1 << 41 | 7 << 36 | 8).to_bytes(8, "big") + bytes(16)
    assert flac.decode_stream(b"fLaC\x80\x00\x00\x22" + info + frame) == [left, [-3] * 8]


def test_range_coder():
    random = np.random.default_rng(1)
    blocks = [random.integers(0, 65536, n).astype(np.uint16) for n in (1, 2, 700, 2048, range_coder.LANE * 3 + 1, range_coder.BLOCK)]
    blocks += [np.zeros(2048, np.uint16), np.tile(np.arange(50), 40).astype(np.uint16), random.zipf(1.3, 2000).clip(0, 50000).astype(np.uint16)]
    made = range_coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(made), strict=True))
    assert len(made[6]) < 100 and len(made[7]) < 600
    broken = bytearray(made[2])
    broken[100] ^= 4
    with pytest.raises(ValueError):
        range_coder.decode([bytes(broken)])
    assert range_coder.encode([]) == [] == range_coder.decode([])


def test_token_store(spark, table, rows, empty, tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    token_store.write(table, PATH, f"file://{tmp_path}/t", ids_a_segment=20000)
    found = token_store.read(spark, f"file://{tmp_path}/t").collect()
    wanted, at = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for d, t in order:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        wanted.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    same(found, wanted)
    token_store.write(empty, PATH, f"file://{tmp_path}/none")
    assert token_store.read(spark, f"file://{tmp_path}/none").count() == 0


def test_bpe(table, rows, empty):
    tokenizer = Tokenizer.from_file(PATH)
    wanted = []
    for d, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        wanted.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    same(bpe_automaton.encode_and_decode(table, PATH).collect(), wanted)
    kept = bpe_automaton.encode_and_decode(table.where("doc_id = 10011"), PATH, keep=True).first()
    assert kept.decoded == AWKWARD[13][1]
    assert bpe_automaton.encode_and_decode(empty, PATH).count() == 0


def brute_merges(word, labels, numbered):
    tokens = [labels.index(bytes([c])) for c in word]
    for u, v, both in numbered:
        i = 0
        while i < len(tokens) - 1:
            if tokens[i] == u and tokens[i + 1] == v:
                tokens[i : i + 2] = [both]
            i += 1
    return tokens


@pytest.mark.parametrize("seed", range(40))
def test_automaton_spells_as_merges_do(seed):
    """All short strings under random merges, of whose tokens some can't be reached."""
    random = np.random.default_rng(seed)
    alphabet = b"ab" if seed % 2 else b"abc"
    labels, numbered = [bytes([c]) for c in alphabet], []
    if seed == 0:
        for u, v in ((0, 1), (1, 2), (0, 4)):  # a b, b c, a bc: never abc
            labels.append(labels[u] + labels[v])
            numbered.append((u, v, len(labels) - 1))
    while len(numbered) < 9:
        u, v = random.integers(0, len(labels), 2).tolist()
        if labels[u] + labels[v] not in labels:
            labels.append(labels[u] + labels[v])
            numbered.append((u, v, len(labels) - 1))
    machine = bpe_automaton.Automaton(labels, numbered, {})
    for n in range(1, 9 if len(alphabet) == 2 else 7):
        for word in itertools.product(alphabet, repeat=n):
            assert machine.path(bytes(word)) == brute_merges(word, labels, numbered)


def test_automaton_forgets_without_harm(monkeypatch):
    words = [f"word{i} \U0001f389{i % 7}".encode() for i in range(300)]
    machine = bpe_automaton.Automaton.load(PATH)
    wanted = [machine.path(w) for w in words]
    monkeypatch.setattr(bpe_automaton, "MOST_STATES", 20)
    monkeypatch.setattr(bpe_automaton, "MOST_KEPT", 20)
    monkeypatch.setattr(bpe_automaton, "LONG_TEXT", 10)
    assert [machine.path(w) for w in words] == wanted
    text = "many words in a text that counts as long, décodé " * 5
    ids = machine.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids and machine.decode(ids) == text


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.limit(20)).union(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    assert docs.select("doc_id").distinct().count() == docs.count()
    packed = stages["packing"](spark, docs, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_rare_toxic_texts_go_at_even_evidence(spark):
    """With one toxic text in ten, a score of a fifth speaks for toxic; without both labels the stage keeps to one half."""
    docs = spark.createDataFrame([(1, "so ein text"), (2, None)], "doc_id long, text string")
    model = toxicity.Model(np.zeros(1 << toxicity.SLOT_BITS, np.float32), float(np.log(0.2 / 0.8)), share=0.1)
    assert toxicity.keep(docs, model, toxicity.even(model)).count() == 0 and toxicity.keep(docs, model).count() == 2
    model.share = 0.9
    assert toxicity.even(model) == 0.5
    assert toxicity.train([(b"dumm", 1), *[(b"gut und schoen %d" % i, 0) for i in range(3)]]).share == 0.25
    clean = toxicity.train([(b"gut", 0)])
    assert toxicity.keep(docs, clean, toxicity.even(clean)).count() == 2

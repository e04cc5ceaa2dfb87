"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from the base patterns (always kept) and from one wider pattern: long hexadecimal or prefixed
secrets, social security and bank account numbers, digit runs. Four labelers vote +1, 0 or -1 on each: a
regex labeler (does the strict form hold), a gazetteer labeler (known domain endings, country codes, issuer
digits, secret prefixes), a context labeler (telling words before the span) and a shape labeler (variety of
characters). Spark counts the vote patterns; expectation-maximisation estimates the labelers' reliabilities
from that bounded table, and a logistic span classifier is fitted to the resulting chances. It is applied as
a column expression, so spans of the wider pattern are added where it is at least one half.

Positions count code points. A text is split by a pattern and the pieces' and matches' lengths are added up.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import durable

#: Kinds by rank; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban", "account")
#: Possessive quantifiers and look-behinds keep the matches of the plain patterns but never back-track far.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = r"(?:[0-9a-f]{32,64}|AKIA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})"
WIDER = rf"(?<![A-Za-z0-9_-])(?:{SECRET}|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|[0-9]{{13,19}})(?![A-Za-z0-9_-])"
#: Fixed word lists of the gazetteer and context labelers.
ENDINGS = r"\.(com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"
CALLING = r"^\+(1|7|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
TELLING = r"(?i)(token|key|secret|password|passwd|pwd|auth|tel|phone|call|mobile|mail|contact|card|visa|iban|account|ssn|social|address|host|ip)[^A-Za-z0-9]{0,6}$"
#: Matches that are placed together; it affects speed only.
CHUNK = 128
VOTES = ("v_regex", "v_gazetteer", "v_context", "v_shape")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    places = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), worth)
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of non-negative longs, what combine() makes of those before it, from 0 on.

    Folded by chunks, then over the chunks, so the work hardly grows faster than the array.
    """
    zero = F.lit(0).cast("bigint")

    def upto(numbers: Column, first: Column) -> Column:
        return F.aggregate(numbers, F.array(first), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def over(chunks: Column) -> Column:
        bases = upto(F.transform(chunks, lambda c: F.aggregate(c, zero, combine)), zero)
        return _let(bases, lambda b: F.flatten(F.transform(chunks, lambda c, i: F.slice(upto(c, F.element_at(b, i + 1)), 1, F.size(c)))))

    def cut(v: Column) -> Column:
        count = F.ceil(F.size(v) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(v, c * CHUNK + 1, CHUNK))

    return _let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(_let(cut(v), over)))


SPANS = "array<struct<start:bigint,end:bigint,value:string,before:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """SPANS of a pattern's leftmost non-overlapping matches; before: up to 24 characters since the match before."""

    def placed(found: Column) -> Column:
        def spans(gaps: Column) -> Column:
            lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: (F.length(g) + F.length(v)).cast("bigint"))
            return _let(_running(lengths, lambda a, x: a + x), lambda at: F.transform(found, lambda v, i: span(F.element_at(at, i + 1), F.element_at(gaps, i + 1), v)))

        return _let(F.split(text, pattern, -1), spans)

    def span(at: Column, gap: Column, value: Column) -> Column:
        start = at + F.length(gap)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.substring(gap, -24, 24).alias("before"))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array().cast(SPANS)).otherwise(placed(found)))


def _kept(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(x, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _vote(sure: Column, against: Column) -> Column:
    return F.when(sure, 1).when(against, -1).otherwise(0)


def _candidate(x: Column, kind: Column, base: bool) -> Column:
    value, before = x["value"], x["before"]
    digits = _digits(value)
    strict = (
        F.when(kind == "email", value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@.*\.[A-Za-z]{2,}$") & ~value.contains(".."))
        .when(kind == "ip", ~value.rlike(r"(^|\.)0[0-9]"))
        .when(kind == "card", value.rlike("^([0-9]+|[0-9]{4}([ -])[0-9]{4}\\2[0-9]{4}\\2[0-9]{2,7}|[0-9]{4}([ -])[0-9]{6}\\3[0-9]{4,5})$"))
        .when(kind == "phone", ~value.rlike(r"[-. ]{2}|\([^)]*$|^[^(]*\)"))
        .when(kind == "account", luhn(digits))
        .when(kind == "ssn", ~value.rlike("^(000|666|9)|-00-|-0000$"))
        .otherwise(True)
    )
    listed = (
        F.when(kind == "email", _vote(value.rlike(ENDINGS), ~value.rlike(ENDINGS)))
        .when(kind == "phone", _vote(value.rlike(CALLING), ~value.rlike(CALLING)))
        .when(kind.isin("card", "account"), _vote(digits.rlike("^[3-6]"), ~digits.rlike("^[3-6]")))
        .when(kind == "ip", _vote(~value.rlike(r"^(0|127|255)\."), value.rlike(r"^(0|127|255)\.")))
        .when(kind == "secret", _vote(value.rlike("^(AKIA|gh|sk-)"), F.lit(False)))
        .otherwise(0)
    )
    variety = F.size(F.array_distinct(F.split(value, "")))
    return F.struct(
        x["start"].alias("start"),
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int").alias("rank"),
        x["end"].alias("end"),
        kind.alias("kind"),
        F.lit(base).alias("base"),
        F.when(strict, 1).otherwise(-1).cast("int").alias("v_regex"),
        listed.cast("int").alias("v_gazetteer"),
        _vote(before.rlike(TELLING), F.lit(False)).alias("v_context"),
        _vote(variety >= 6, variety <= 3).alias("v_shape"),
        F.least(F.floor(F.length(value) / 8), F.lit(5)).cast("int").alias("bucket"),
    )


def _free(docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    name = "_pii"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def with_candidates(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column of candidate spans and their votes, by start and kind. A null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]{2}|[0-9][ -][0-9]")}
    none = F.array().cast(SPANS)

    def base(kind: str) -> Column:
        found = F.filter(F.when(hint[kind], _matches(text, PATTERNS[kind])).otherwise(none), lambda x: _kept(kind, x["value"]))
        return F.transform(found, lambda x: _candidate(x, F.lit(kind), True))

    lists = [base(kind) for kind in KINDS[:4]]

    def wide(x: Column) -> Column:
        value = x["value"]
        kind = F.when(value.rlike("^[0-9]{3}-"), "ssn").when(value.rlike("^[0-9]{13,19}$"), "account").when(value.rlike(f"^{SECRET}$"), "secret").otherwise("iban")
        return _candidate(x, kind, False)

    found = F.when(text.rlike("[0-9]{2}|AKIA|gh[opsu]_|sk-"), _matches(text, WIDER)).otherwise(none)
    other = F.filter(found, lambda x: ~(x["value"].rlike("^[0-9]{14,19}$") & luhn(x["value"])))  # those are base cards
    lists.append(F.transform(other, wide))
    return docs.withColumn(name, F.array_sort(F.concat(*lists)))


@dataclass
class Classifier:
    """Weights of kinds, of each labeler's votes -1, 0, +1, and of length buckets."""

    bias: float
    kinds: list[float]
    votes: list[list[float]]
    buckets: list[float]

    def margin(self, x: Column) -> Column:
        def pick(weights: list[float], at: Column) -> Column:
            return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at.cast("int") + 1)

        total = F.lit(self.bias) + pick(self.kinds, x["rank"] - 1) + pick(self.buckets, x["bucket"])
        for name, weights in zip(VOTES, self.votes, strict=True):
            total = total + pick(weights, x[name] + 1)
        return total


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 30) -> tuple[float, list[list[list[float]]]]:
    """Expectation-maximisation of a two-class model with independent labelers over counted vote patterns.

    Starts from the sum of the votes, so no labeler is trusted before the others. Returns the share of true spans and, for each labeler, the chance of votes -1, 0, +1 in classes 0 and 1.
    """
    chance = {v: _sigmoid(float(sum(v))) for v, _ in patterns}  # all labelers count alike at first
    share, tables = 0.5, []
    for _ in range(rounds):
        true = sum(n * chance[v] for v, n in patterns) + 1
        false = sum(n * (1 - chance[v]) for v, n in patterns) + 1
        share = true / (true + false)
        tables = []
        for j in range(len(VOTES)):
            table = [[0.5] * 3, [0.5] * 3]
            for v, n in patterns:
                table[1][v[j] + 1] += n * chance[v]
                table[0][v[j] + 1] += n * (1 - chance[v])
            tables.append([[x / sum(row) for x in row] for row in table])
        for v, _ in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(tables[j][1][x + 1] / tables[j][0][x + 1]) for j, x in enumerate(v))
            chance[v] = _sigmoid(odds)
    return share, tables


def train(docs: DataFrame, name: str, steps: int = 200, rate: float = 0.5) -> Classifier:
    """Fit to all candidates of docs (which has them as column `name`). The driver sees counts of at most
    8 kinds x 81 vote patterns x 6 length buckets."""
    x = docs.select(F.explode(name).alias("x")).select("x.rank", *[f"x.{v}" for v in VOTES], "x.bucket")
    rows = [tuple(map(int, r)) for r in x.groupBy("rank", *VOTES, "bucket").count().orderBy("rank", *VOTES, "bucket").collect()]
    if not rows:
        return Classifier(-1.0, [0.0] * len(KINDS), [[0.0] * 3 for _ in VOTES], [0.0] * 6)
    patterns: dict[tuple[int, ...], float] = {}
    for r in rows:
        patterns[r[1:5]] = patterns.get(r[1:5], 0) + r[6]
    share, tables = reliabilities(sorted(patterns.items()))
    target = {v: _sigmoid(math.log(share / (1 - share)) + sum(math.log(tables[j][1][x + 1] / tables[j][0][x + 1]) for j, x in enumerate(v))) for v in patterns}
    out = Classifier(0.0, [0.0] * len(KINDS), [[0.0] * 3 for _ in VOTES], [0.0] * 6)
    total = sum(r[6] for r in rows)
    for _ in range(steps):
        step = Classifier(0.0, [0.0] * len(KINDS), [[0.0] * 3 for _ in VOTES], [0.0] * 6)
        for rank, *v, bucket, n in rows:
            margin = out.bias + out.kinds[rank - 1] + out.buckets[bucket] + sum(out.votes[j][x + 1] for j, x in enumerate(v))
            up = (target[tuple(v)] - _sigmoid(margin)) * n / total
            step.bias += up
            step.kinds[rank - 1] += up
            step.buckets[bucket] += up
            for j, x in enumerate(v):
                step.votes[j][x + 1] += up
        out.bias += rate * step.bias
        for mine, theirs in ((out.kinds, step.kinds), (out.buckets, step.buckets), *zip(out.votes, step.votes, strict=True)):
            for i, up in enumerate(theirs):
                mine[i] += rate * up
    return out


def detect(docs: DataFrame, keep: tuple[str, ...] | None = None) -> tuple[DataFrame, str]:
    """docs (or its columns `keep`) with a column of the spans found, and that column's name: base spans and those that
    the classifier takes.

    Repeated rows and null ids are handled alike; an empty table stays empty. The candidates are written to the shared
    folder, so texts are searched once.
    """
    name = _free(docs)
    found = durable(with_candidates(docs, name).select(*(keep or docs.columns), name))
    model = train(found, name)
    return found.withColumn(name, F.filter(name, lambda x: x["base"] | (model.margin(x) >= 0))), name


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def report(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans).

    A null text counts as empty: no spans, and the hash of an empty list. Every row gives a row, repeated ones too.
    """
    found, name = detect(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), keep=("doc_id",))

    def count(kind: str) -> Column:
        return F.size(F.filter(name, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:4]]
    base = F.filter(name, lambda x: x["base"])
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(name)).alias("spans"))


def _without(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; of spans that overlap, the first counts.

    The text is cut at every few spans first, since finding a place in a string takes time in proportion to it.
    """

    def whole(s: Column, at: Column) -> Column:
        many = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(s)))).cast("int")

        def block(first: Column, most: Column) -> Column:
            last = F.least(first + most, F.size(s))
            low = F.element_at(at, first + 1)
            high = F.greatest(F.element_at(at, last), F.element_at(s, last)["end"])

            def pieces(part: Column) -> Column:
                def piece(i: Column) -> Column:
                    x, since = F.element_at(s, i), F.element_at(at, i)
                    gap = F.substring(part, (since - low + 1).cast("int"), (x["start"] - since).cast("int"))
                    return F.when(x["start"] >= since, F.concat(gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

                return F.concat_ws("", F.transform(F.sequence(first + 1, last), piece))

            return _let(F.substring(text, (low + 1).cast("int"), (high - low).cast("int")), pieces)

        end = F.greatest(F.element_at(at, -1), F.element_at(s, -1)["end"])
        tail = F.substring(text, (end + 1).cast("int"), F.lit(2**31 - 1))
        blocks = _let(many, lambda m: F.transform(F.sequence(F.lit(0), F.ceil(F.size(s) / m).cast("int") - 1), lambda b: block(b * m, m)))
        return F.concat(F.concat_ws("", blocks), tail)

    ends = lambda s: F.transform(s, lambda x: x["end"])
    return _let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(_let(_running(ends(s), lambda a, x: F.greatest(a, x)), lambda at: whole(s, at))))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; n_chars, where there is one, follows.

    A null text stays null; every row stays, repeated ones too.
    """
    found, name = detect(docs)
    out = found.withColumn("text", F.when(F.size(name) > 0, _without(F.col("text"), F.col(name))).otherwise(F.col("text"))).drop(name)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

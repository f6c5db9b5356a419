r"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base spans come from four patterns (email, ip, card, phone) with their checks. The patterns
below are written with possessive parts and only start where a run of their first characters
starts, so that a text is read in linear time; they find the same spans as the plain ones.

More spans come from candidates: obfuscated addresses, numbers in telephone or identity
shape, and long tokens that mix letters and digits, where no base span stands. Six labelers
vote on each (shape by regex, gazetteers of the words before, context, mixing of letters and
digits, digits, variety of characters) for, against, or not at all. Vote patterns are counted
over all documents; expectation-maximisation over the counted patterns (at most 3 ** 6 times
the few shapes, whatever the input) estimates how reliable each labeler is and how likely
each pattern is personal data; a logistic regression trained on these likelihoods is the
span classifier, a plain expression that every span is scored with.

Spans are kind:start:end in code points, end exclusive, ordered by start, then kind, joined by
commas. Base kinds may overlap each other, added spans overlap nothing. Defined results: a
null text counts as empty; a text without spans has an empty list and the digest of the empty
text; without candidates nothing is added; rows of one id and null ids are handled each for
itself; an empty table gives an empty table; other columns are kept by redact() unchanged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveplan.llm.store import read

# Kinds in order, and what they look like.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = ("email_like", "phone_like", "id", "secret")
OBFUSCATED = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++"
    r"(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++"
)
TELEPHONE = r"(?<![A-Za-z0-9.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9-])"
IDENTITY = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
MIXED = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{8,}+"
CANDIDATE = f"{OBFUSCATED}|{TELEPHONE}|{IDENTITY}|{MIXED}"
SECRET_SHAPE = r"^(?:AKIA|ASIA)[A-Z0-9]{12,}$|^[0-9a-f]{16,}$|^(?:ghp|gho|sk|pk|xoxb|xoxp)[_-]|^eyJ"
PLAIN_SHAPE = r"^[A-Za-z]+[_-]?[0-9]{1,4}$|^[0-9]{1,4}[_-]?[A-Za-z]+$|^[0-9]{4}-[0-9]{2}-[0-9]{2}"
TELLING = (
    "(?:password|passwd|pwd|token|secret|api.?key|access.?key|credential|auth|login|ssn|social security|passport|iban"
    "|account|phone|tel|mobile|fax|call|e-?mail|contact)[^a-z0-9]{0,6}$"
)
HARMLESS = "(?:page|chapter|figure|table|section|version|release|year|isbn|doi|line|step|article|model|part)[^a-z0-9]{0,3}$"

THRESHOLD = 0.5
LABELERS = ("shape", "words", "context", "mixing", "digits", "variety")
FEATURES = (*LABELERS, "is_email", "is_phone", "is_id", "long", "cased")
_BLOCK = 64
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def bound(docs: DataFrame, **named: Column) -> DataFrame:
    """Adds columns whose values are computed once, here.

    Spark merges a projection into the next one, which would repeat an array's expression for
    every element of a lambda that uses it, and a filter behind all steps would repeat all of
    them. A generator of one row keeps the steps apart.
    """
    step = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in named.items()])))
    own = [c for c in docs.columns if c not in named]
    return docs.select(*own, step.alias("_step")).select(*own, *[F.col(f"_step.{n}").alias(n) for n in named])


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)


def matches(text: Column, pattern: str, needed: Column) -> tuple[Column, Column]:
    """Leftmost matches that don't overlap, and what stands before, between and behind them."""
    found = F.when(needed, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    between = F.when(needed, F.split(text, pattern, -1))
    return F.coalesce(found, F.array().cast("array<string>")), F.coalesce(between, F.array(text))


def with_starts(docs: DataFrame, *names: str) -> DataFrame:
    """Adds name_s, where each match of name_m starts in code points; name_b is between them.

    Lengths are summed by blocks, so that long arrays stay cheap.
    """
    last = lambda n: F.floor((F.size(f"{n}_l") - 1) / _BLOCK).cast("int")
    block_sum = lambda n: lambda b: _total(F.slice(F.col(f"{n}_l"), b * _BLOCK + 1, F.lit(_BLOCK)))
    before = lambda n: lambda b: _total(F.slice(F.col(f"{n}_k"), F.lit(1), b))
    none = F.array().cast("array<bigint>")

    def place(n: str):
        def at(x: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            inside = _total(F.slice(F.col(f"{n}_l"), block * _BLOCK + 1, i % _BLOCK))
            return F.get(F.col(f"{n}_p"), block) + inside + F.length(x["b"])

        return at

    some = lambda n: F.size(f"{n}_m") > 0
    pairs = lambda n: F.slice(F.arrays_zip(F.col(f"{n}_m").alias("m"), F.col(f"{n}_b").alias("b")), 1, F.size(f"{n}_m"))
    long = lambda x: (F.length(x["m"]) + F.length(x["b"])).cast("long")
    docs = bound(docs, **{f"{n}_z": F.when(some(n), pairs(n)) for n in names})
    docs = bound(docs, **{f"{n}_l": F.when(some(n), F.transform(f"{n}_z", long)) for n in names})
    docs = bound(docs, **{f"{n}_k": F.when(some(n), F.transform(F.sequence(F.lit(0), last(n)), block_sum(n))) for n in names})
    docs = bound(docs, **{f"{n}_p": F.when(some(n), F.transform(F.sequence(F.lit(0), last(n)), before(n))) for n in names})
    docs = bound(docs, **{f"{n}_s": F.when(some(n), F.transform(f"{n}_z", place(n))).otherwise(none) for n in names})
    return docs.drop(*[f"{n}_{x}" for n in names for x in "zlkp"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substr(turned, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(places, F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    if kind == "card":
        digits = _digits(m)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _needed(kind: str, text: Column) -> Column:
    """A cheap condition without which a text holds no match."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return F.col("_digit") if kind in ("ip", "card") else F.lit(True)


def _found(docs: DataFrame) -> DataFrame:
    """Adds _spans (structs of start, rank, end, kind, valid), sorted."""
    found = {}
    for kind in KINDS:
        found[f"_{kind}_m"], found[f"_{kind}_b"] = matches(F.col("_text"), PATTERNS[kind], _needed(kind, F.col("_text")))
    out = with_starts(bound(bound(docs, _digit=F.col("_text").rlike("[0-9]")), **found), *[f"_{k}" for k in KINDS])
    spans = []
    for order, kind in enumerate(KINDS):
        both = F.arrays_zip(F.col(f"_{kind}_m").alias("m"), F.col(f"_{kind}_s").alias("s"))
        own = F.transform(F.filter(both, _right(kind)), _span(kind, order))
        spans.append(F.when(F.size(f"_{kind}_m") > 0, own).otherwise(F.array().cast(_SPANS)))
    out = bound(out, _spans=F.concat(*spans))
    out = bound(out, _spans=F.when(F.size("_spans") > 0, F.array_sort("_spans")).otherwise(F.col("_spans")))
    return out.drop(*[f"_{k}_{x}" for k in KINDS for x in "mbs"])


def _right(kind: str):
    return lambda x: valid(kind, x["m"])


def _span(kind: str, order: int):
    def span(x: Column) -> Column:
        return F.struct(
            x["s"].alias("start"), F.lit(order).alias("rank"), (x["s"] + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind")
        )

    return span


def _replaced(docs: DataFrame, by) -> DataFrame:
    """Adds _masked, the text with the valid matches of one kind after the other replaced."""
    out = docs.withColumn("_masked", F.col("_text"))
    for kind in KINDS:
        found, between = matches(F.col("_masked"), PATTERNS[kind], _needed(kind, F.col("_masked")))
        out = bound(out, _m=found, _b=between)
        parts = F.transform(F.arrays_zip(F.col("_b").alias("b"), F.col("_m").alias("m")), _swap(kind, by))
        out = bound(out, _masked=F.when(F.size("_m") > 0, F.array_join(parts, "")).otherwise(F.col("_masked")))
    return out.drop("_m", "_b")


def _swap(kind: str, by):
    def swap(x: Column) -> Column:
        other = F.when(valid(kind, x["m"]), by(kind, x["m"])).otherwise(x["m"])
        return F.concat(x["b"], F.when(x["m"].isNull(), "").otherwise(other))

    return swap


def _blanks(kind: str, m: Column) -> Column:
    return F.repeat(F.lit(" "), F.length(m))


def _sign(kind: str, m: Column) -> Column:
    return F.lit(f"[{kind.upper()}]")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


def _features(m: Column, before: Column, after: Column) -> list[Column]:
    """Votes of the labelers, then shape features, of a candidate and what stands around it."""
    email, phone, identity = m.rlike(r"[\[(](?:at|AT)[\])]"), m.rlike(TELEPHONE), m.rlike(IDENTITY)
    switches = F.regexp_count(m, F.lit("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"))
    numbers, kinds = F.length(_digits(m)), F.size(F.array_distinct(F.split(m, "")))
    near = F.lower(before)
    flag = lambda c: c.cast("int")
    return [
        _vote(email | phone | identity | m.rlike(SECRET_SHAPE), m.rlike(PLAIN_SHAPE)),
        _vote(near.rlike(TELLING), near.rlike(HARMLESS)),
        _vote(before.rlike("[=:]\\s*[\"']?$"), after.rlike("^[/.][A-Za-z0-9]")),
        F.when(email | phone | identity, 0).otherwise(_vote(switches >= 3, switches <= 1)),
        F.when(email, 0).otherwise(_vote(numbers >= 8, numbers <= 2)),
        _vote(kinds >= 9, kinds <= 4),
        flag(email), flag(phone), flag(identity), flag(F.length(m) >= 16), flag(m.rlike("[a-z]") & m.rlike("[A-Z]")),
    ]


def _candidates(docs: DataFrame) -> DataFrame:
    """Adds _c_m, the candidates of _masked, _c_b, what stands between, and _f, their features."""
    text = F.col("_masked")
    needed = F.col("_digit") | text.rlike(r"[\[(](?:at|AT)[\])]")
    found, between = matches(text, CANDIDATE, needed)
    out = bound(docs, _c_m=found, _c_b=between)
    behind = F.slice(F.col("_c_b"), F.lit(2), F.size("_c_m"))
    around = F.arrays_zip(F.col("_c_m").alias("m"), F.col("_c_b").alias("b"), behind.alias("a"))
    features = F.transform(
        F.slice(around, F.lit(1), F.size("_c_m")),
        lambda x: F.array(*[f.cast("int") for f in _features(x["m"], F.right(x["b"], F.lit(24)), F.left(x["a"], F.lit(8)))]),
    )
    return bound(out, _f=F.when(F.size("_c_m") > 0, features).otherwise(F.array().cast("array<array<int>>")))


@dataclass
class Classifier:
    """Weights of the features and bias; accuracy of the labelers as estimated."""

    weights: tuple[float, ...]
    bias: float
    accuracy: tuple[float, ...]

    def positive(self, features: Column, threshold: float = THRESHOLD) -> Column:
        score = F.lit(self.bias)
        for k, w in enumerate(self.weights):
            score = score + F.lit(w) * F.get(features, F.lit(k))
        return score >= math.log(threshold / (1 - threshold))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[list[float], list[float]]:
    """Expectation-maximisation over counted vote patterns.

    Returns the likelihood of each pattern and the accuracy of each labeler. A labeler that
    doesn't vote tells nothing; accuracies start, and are drawn to, 0.8.
    """
    n = len(LABELERS)
    accuracy, share = [0.8] * n, 0.5
    likely = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (votes, _) in enumerate(patterns):
            odds = math.log(share / (1 - share))
            for a, v in zip(accuracy, votes):
                odds += v * math.log(a / (1 - a))
            likely[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(c for _, c in patterns)
        share = min(0.95, max(0.05, (sum(p * c for p, (_, c) in zip(likely, patterns)) + 1) / (total + 2)))
        pull = 0.05 * total + 4
        for k in range(n):
            right = sum(c * (p if votes[k] > 0 else 1 - p) for p, (votes, c) in zip(likely, patterns) if votes[k])
            voted = sum(c for votes, c in patterns if votes[k])
            accuracy[k] = min(0.98, max(0.55, (right + 0.8 * pull) / (voted + pull)))
    return likely, accuracy


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> Classifier | None:
    """Train the classifier on feature patterns (votes first) and their counts."""
    if not patterns:
        return None
    likely, accuracy = estimate([(p[: len(LABELERS)], c) for p, c in patterns])
    weights, bias = [0.0] * len(FEATURES), 0.0
    # logarithmic counts, so that one frequent shape doesn't settle all others
    mass = [math.log(1 + c) for _, c in patterns]
    total = sum(mass)
    for _ in range(800):
        grad, grad_bias = [0.01 * w for w in weights], 0.0
        for (x, _), p, m in zip(patterns, likely, mass):
            z = bias + sum(w * v for w, v in zip(weights, x))
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * m / total
            grad_bias += error
            for k, v in enumerate(x):
                grad[k] += error * v
        weights = [w - 0.5 * g for w, g in zip(weights, grad)]
        bias -= 0.5 * grad_bias
    return Classifier(tuple(weights), bias, tuple(accuracy))


def _prepared(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def learn(docs: DataFrame, text_col: str = "text") -> Classifier | None:
    """Count feature patterns over all documents and train on them."""
    own = _prepared(docs.select(F.col(text_col).alias("text")), "text")
    own = _candidates(_replaced(bound(own, _digit=F.col("_text").rlike("[0-9]")), _blanks))
    rows = own.select(F.explode("_f").alias("f")).groupBy("f").count().orderBy("f").collect()
    return fit([(tuple(r["f"]), r["count"]) for r in rows])


def find(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of start, end and kind) of every row."""
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    own = _found(_prepared(own, "text"))
    if model is None:
        return own.select(F.col("_id").alias("doc_id"), _plain("_spans").alias("base"), _plain("_spans").alias("spans"))
    own = with_starts(_candidates(_replaced(own, _blanks)), "_c")
    both = F.arrays_zip(F.col("_c_m").alias("m"), F.col("_c_s").alias("s"), F.col("_f").alias("f"))
    added = F.transform(
        F.filter(both, lambda x: model.positive(x["f"])),
        lambda x: F.struct(
            x["s"].alias("start"), _rank(x["f"]).alias("rank"), (x["s"] + F.length(x["m"])).alias("end"), _kind(x["f"]).alias("kind")
        ),
    )
    every = F.when(F.size("_c_m") > 0, F.array_sort(F.concat("_spans", added))).otherwise(F.col("_spans"))
    own = bound(own, _all=every)
    return own.select(F.col("_id").alias("doc_id"), _plain("_spans").alias("base"), _plain("_all").alias("spans"))


def _plain(spans: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["kind"]))


def _rank(f: Column) -> Column:
    spot = len(LABELERS)
    one = lambda k: F.get(f, F.lit(spot + k)) == 1
    return F.when(one(0), 4).when(one(1), 5).when(one(2), 6).otherwise(7)


def _kind(f: Column) -> Column:
    rank = _rank(f)
    return F.when(rank == 4, ADDED[0]).when(rank == 5, ADDED[1]).when(rank == 6, ADDED[2]).otherwise(ADDED[3])


def redact(docs: DataFrame, model: Classifier | None, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets."""
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    own = _prepared(packed.withColumn("_raw", F.col(f"_row.`{text_col}`")), "_raw")
    own = _replaced(bound(own, _digit=F.col("_text").rlike("[0-9]")), _sign)
    if model is not None:
        own = _candidates(own)
        several = F.arrays_zip(F.col("_c_b").alias("b"), F.col("_c_m").alias("m"), F.col("_f").alias("f"))

        def part(x: Column) -> Column:
            sign = F.concat(F.lit("["), F.upper(_kind(x["f"])), F.lit("]"))
            return F.concat(x["b"], F.when(x["m"].isNull(), "").when(model.positive(x["f"]), sign).otherwise(x["m"]))

        whole = F.array_join(F.transform(several, part), "")
        own = bound(own, _masked=F.when(F.size("_c_m") > 0, whole).otherwise(F.col("_masked")))
    text = F.when(F.col("_raw").isNotNull(), F.col("_masked"))
    return own.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = find(docs, learn(docs))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )

"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from wide patterns. Labelers vote on each (+1 personal, -1 not, 0 no opinion): the
strict pattern, a gazetteer, the words before it and the shape of what surrounds it. Expectation-
maximisation over the counts of vote patterns estimates how reliable each labeler is, per kind, and a
logistic span classifier is trained on the resulting posteriors. Strict matches (the base) always
count; the classifier decides about the other candidates.

Only the table of distinct vote patterns, at most kinds x 3**labelers rows, reaches the driver.

A text's work grows in proportion to its length and, but for sorting, to its candidates: offsets and
overlaps come from running sums and maxima, which are made block by block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
# Possessive runs that start where a run starts (or where the last match ended) find what the plain
# patterns find, leftmost and greedy, in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z-])",
}
LABELERS = ("strict", "gazetteer", "context", "shape")
_CUES = {
    "email": r"(?i)(e-?mail|mailto|contact|write|reach)\W*(\w+\W+)?$",
    "ip": r"(?i)(\bip\b|address|host|server|from|login)\W*(\w+\W+)?$",
    "card": r"(?i)(card|visa|credit|debit|payment|master|account)\W*(\w+\W+)?$",
    "phone": r"(?i)(phone|tel|mobile|cell|fax|call|whatsapp)\W*(\w+\W+)?$",
}
_AGAINST = r"(?i)(version|release|section|isbn|figure|table|chapter|order|invoice|serial|\bv)\W*$"
_TLDS = r"(?i)(com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu|us)$"
#: Digits of what may be a card.
CARD_DIGITS = (13, 19)
_BLOCK = 512
_FAR = 1 << 62


def _running(df: DataFrame, values: dict[str, F.Column], op, zero: int, before: bool = False) -> DataFrame:
    """``df`` with, per name, the array of what ``op`` makes of an array's longs up to and with each (or before it), from ``zero`` on.

    An array grows by copying, so runs are made within blocks, and each starts from that of the blocks' totals.
    Arrays that lambdas need are columns used twice: others would be computed again for each element.
    """
    first, none = F.lit(zero).cast("long"), F.array().cast("array<bigint>")

    def run(block: F.Column, start: F.Column, before: bool = before) -> F.Column:
        def step(acc, x):
            v = op(acc["at"], x)
            return F.struct(v.alias("at"), F.concat(acc["all"], F.array(acc["at"] if before else v)).alias("all"))

        return F.aggregate(block, F.struct(start.alias("at"), none.alias("all")), step, lambda acc: acc["all"])

    def blocks(v: str) -> F.Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(_BLOCK)), lambda i: F.slice(v, i, _BLOCK))

    df = df.withColumns(values)
    df = df.withColumns({n: blocks(n) for n in values})
    totals = lambda n: run(F.transform(n, lambda b: F.aggregate(b, first, op)), first, True)
    return df.withColumns({n: F.flatten(F.zip_with(n, totals(n), lambda b, s: run(b, s))) for n in values})


def _sum(a: F.Column, b: F.Column) -> F.Column:
    return a + b


def _most(a: F.Column, b: F.Column) -> F.Column:
    return F.greatest(a, b)


def _least(a: F.Column, b: F.Column) -> F.Column:
    return F.least(a, b)


def _pieces(found: str, gaps: str) -> F.Column:
    """(match, 24 characters before, first after, characters of what lies before it and of the match) of matches and what lies between them."""
    left = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.right(g, F.lit(24)).alias("l"), (F.length(g) + F.length(m)).cast("long").alias("n")))
    return F.zip_with(left, F.slice(gaps, F.lit(2), F.size(found)), lambda x, g: F.struct(x["m"].alias("m"), x["l"].alias("l"), F.left(g, F.lit(1)).alias("r"), x["n"].alias("n")))


def _digits(m: F.Column) -> F.Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: F.Column) -> F.Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  the i-th from the right
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, value(i)).otherwise(F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))))
    return total % 10 == 0


def _passes(kind: str, m: F.Column) -> F.Column:
    """What the base asks of a match beyond its pattern."""
    digits = _digits(m)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")).between(1, 3) & (F.right(F.concat(F.lit("00"), F.regexp_replace(p, "^0+(?=[0-9])", "")), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _votes(kind: str, x: F.Column, base: F.Column, wide: bool) -> list[F.Column]:
    m, left, right = x["m"], x["l"], x["r"]
    digits = _digits(m)
    if kind == "email":
        gazetteer = F.when(m.rlike(_TLDS), 1).otherwise(0)
    elif kind == "ip":
        gazetteer = F.when(m.rlike(r"^(10\.|127\.|192\.168\.|0\.)"), -1).otherwise(0)
    elif kind == "card":
        gazetteer = F.when(digits.rlike(r"^(3[47][0-9]{13}|3[068][0-9]{12}|4[0-9]{12}|4[0-9]{15}|5[1-5][0-9]{14}|6[0-9]{15,18})$"), F.when(_luhn(digits), 1).otherwise(-1)).otherwise(-1)
    else:
        gazetteer = F.when(F.length(digits) < 10, -1).when(digits.rlike(r"^1?[0-9]{3}555[0-9]{4}$"), 1).otherwise(0)
    strict = F.when(base, 1).otherwise(0 if wide else -1)
    context = F.when(left.rlike(_CUES[kind]), 1).when(left.rlike(_AGAINST), -1).otherwise(0)
    open_left, open_right = (left == "") | left.rlike(r"[\s(\[<\"':;,>]$"), (right == "") | right.rlike(r"^[\s)\]<>\"',.;:!?]")
    shape = F.when(open_left & open_right, 1).when(open_left | open_right, 0).otherwise(-1)
    return [strict, gazetteer, context, shape]


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``cands``: array of (k, s, e, base, v) of all candidates in column ``text`` (null: empty).

    Kind number, start and end in code points, whether it is a base span, and the labelers' votes. Other
    than base spans, candidates that overlap a base span or an earlier candidate of their kind are gone.
    A column ``cands`` is replaced.
    """
    text = F.coalesce("text", F.lit(""))
    gates = {"email": F.contains("__text", F.lit("@")), "ip": F.col("__digit"), "card": F.col("__digit"), "phone": F.contains("__text", F.lit("+"))}
    wide_gates = {"email": F.col("__text").rlike(r"[\[({]\x20?(?:at|AT)\x20?[\])}]"), "phone": F.col("__digit")}
    df = docs.drop("cands").withColumn("__text", text).withColumn("__digit", F.col("__text").rlike("[0-9]"))
    sought = {f"b_{k}": (BASE[k], gates[k]) for k in KINDS} | {f"w_{k}": (WIDE[k], wide_gates[k]) for k in WIDE}
    # column by column, as an expression that is used twice in one projection is computed twice
    none = F.array().cast("array<string>")
    df = df.withColumns({f"__f_{n}": F.when(gate, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))).otherwise(none) for n, (pattern, gate) in sought.items()})
    df = df.withColumns({f"__g_{n}": F.when(F.size(f"__f_{n}") > 0, F.split("__text", pattern, -1)).otherwise(none) for n, (pattern, _) in sought.items()})
    df = df.withColumns({f"__f_{n}": _pieces(f"__f_{n}", f"__g_{n}") for n in sought})
    df = _running(df, {f"__g_{n}": F.transform(f"__f_{n}", lambda x: x["n"]) for n in sought}, _sum, 0)

    def told(kind: str, wide: bool):
        name = f"{'w' if wide else 'b'}_{kind}"

        def one(x, e):
            base = F.lit(False) if wide else _passes(kind, x["m"])
            return F.struct((e.cast("int") - F.length(x["m"])).alias("s"), (~base).alias("other"), e.cast("int").alias("e"), F.lit(KINDS.index(kind)).alias("k"), F.array(*_votes(kind, x, base, wide)).alias("v"))

        return F.zip_with(f"__f_{name}", f"__g_{name}", one)

    # by start, base ones first; others stay if no base span started before and goes on, or starts within
    df = df.withColumn("cands", F.array_sort(F.concat(*[told(k, False) for k in KINDS], *[told(k, True) for k in WIDE])))
    df = _running(df, {"__f_b_ip": F.transform("cands", lambda x: F.when(x["other"], F.lit(0)).otherwise(x["e"]).cast("long"))}, _most, 0)
    df = _running(df, {"__g_b_ip": F.reverse(F.transform("cands", lambda x: F.when(x["other"], F.lit(_FAR)).otherwise(x["s"]).cast("long")))}, _least, _FAR)
    seen = F.zip_with("__f_b_ip", F.reverse("__g_b_ip"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    free = F.zip_with("cands", seen, lambda x, y: F.when(~x["other"] | ((y["a"] <= x["s"]) & (y["b"] >= x["e"])), F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), (~x["other"]).alias("base"), x["v"].alias("v"))))
    return df.withColumn("cands", F.array_compact(free)).drop("__text", "__digit", *[f"__{x}{n}" for x in ("f_", "g_") for n in sought])


@dataclass(frozen=True)
class Model:
    """Per kind: labeler reliabilities P(vote | personal or not) and the span classifier's weights."""

    reliability: dict[int, list[dict[int, tuple[float, float]]]]
    prior: dict[int, float]
    weights: dict[int, list[float]]  # intercept, then a weight per labeler


def estimate(patterns: dict[tuple, int], rounds: int = 50) -> Model:
    """EM over counts of (kind, vote, ...) and, on its posteriors, a logistic regression per kind."""
    reliability, prior, weights = {}, {}, {}
    for kind in sorted({p[0] for p in patterns}):
        rows = [(p[1:], n) for p, n in sorted(patterns.items()) if p[0] == kind]
        soft = [1 / (1 + math.exp(-2.0 * sum(v))) for v, _ in rows]  # starts from the majority vote
        rates, share = [], 0.5
        for _ in range(rounds):
            yes = sum(q * n for q, (_, n) in zip(soft, rows))
            no = sum((1 - q) * n for q, (_, n) in zip(soft, rows))
            share = (yes + 1) / (yes + no + 2)
            rates = []
            for j in range(len(LABELERS)):
                counts = {v: [0.5 + (v > 0), 0.5 + (v < 0)] for v in (-1, 0, 1)}
                for q, (votes, n) in zip(soft, rows):
                    counts[votes[j]][0] += q * n
                    counts[votes[j]][1] += (1 - q) * n
                rates.append({v: (a / (yes + 2.5), b / (no + 2.5)) for v, (a, b) in counts.items()})
            soft = []
            for votes, _ in rows:
                odds = math.log(share / (1 - share)) + sum(math.log(rates[j][v][0] / rates[j][v][1]) for j, v in enumerate(votes))
                soft.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        w, total = [0.0] * (1 + len(LABELERS)), sum(n for _, n in rows)
        for _ in range(500):
            slope = [1e-3 * x for x in w]
            for q, (votes, n) in zip(soft, rows):
                p = 1 / (1 + math.exp(-w[0] - sum(a * b for a, b in zip(w[1:], votes))))
                for j, x in enumerate((1, *votes)):
                    slope[j] += (p - q) * x * n / total
            w = [a - 1.0 * g for a, g in zip(w, slope)]
        reliability[kind], prior[kind], weights[kind] = rates, share, w
    return Model(reliability, prior, weights)


def fit(found: DataFrame) -> Model:
    """Learns from all candidates (column ``cands``) of ``found``."""
    votes = [F.col("c.v")[j].alias(name) for j, name in enumerate(LABELERS)]
    counts = found.select(F.explode("cands").alias("c")).groupBy(F.col("c.k").alias("k"), *votes).agg(F.count("*").alias("n"))
    return estimate({tuple(r)[:-1]: r.n for r in counts.collect()})


def classified(found: DataFrame, model: Model) -> DataFrame:
    """``found`` with ``spans``: the candidates (k, s, e, base) that are base or accepted, by kind and start.

    Of accepted candidates that overlap within a kind, the earlier one stays. A column ``spans`` is replaced.
    """

    def accepted(c):
        score = F.lit(None).cast("double")
        for kind, w in model.weights.items():
            own = F.lit(w[0])
            for j in range(len(LABELERS)):
                own = own + F.lit(w[1 + j]) * c["v"][j]
            score = F.when(c["k"] == kind, own).otherwise(score)
        return c["base"] | F.coalesce(score > 0, F.lit(False))

    kept = F.array_sort(F.transform(F.filter("cands", accepted), lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), (-c["e"]).alias("n"), c["base"].alias("base"))))
    # a base span never meets another candidate; two patterns' candidates of one kind may
    far = lambda c: F.shiftleft(c["k"].cast("long"), 32)
    found = _running(found.withColumn("spans", kept), {"__reach": F.transform("spans", lambda c: far(c) - c["n"])}, _most, -1, before=True)
    apart = F.zip_with("spans", "__reach", lambda c, reach: F.when(c["base"] | (reach <= far(c) + c["s"]), F.struct(c["k"].alias("k"), c["s"].alias("s"), (-c["n"]).alias("e"), c["base"].alias("base"))))
    return found.withColumn("spans", F.array_compact(apart)).drop("__reach")


def spans_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, spans) per row of ``docs``: patterns run once over whole texts, candidates are cut into a table without the texts."""
    found = cut(candidates(docs.select(key, "text")).drop("text"), "pii-candidates")
    return classified(found, fit(found))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` redacted, same columns and rows; null texts stay null.

    Rows with their candidates are written once; the model is fitted on all candidates and what it accepts
    is replaced within the rows: no join by key, so repeated or null keys do no harm.
    """
    others = F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])  # out of the way of names in use here
    found = cut(candidates(docs.select("text", others.alias("__row"))), "pii-candidates")
    found = redacted(classified(found, fit(found)))
    return found.select(*[F.col("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns])


def listed(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))))


def redacted(found: DataFrame) -> DataFrame:
    """``found`` with each of ``spans`` in ``text`` replaced by its kind in brackets; of overlapping spans the earlier start, then the longer, names it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["k"].alias("k"))))
    found = _running(found.withColumn("__spans", ordered), {"__reach": F.transform("__spans", lambda x: (-x["n"]).cast("long"))}, _most, 0, before=True)
    # a place in a string is found by walking to it, in an array of characters it is there
    found = found.withColumn("__chars", F.when(F.size("spans") > 0, F.split("text", "")))
    between = lambda a, b: F.array_join(F.slice("__chars", (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "")
    parts = F.zip_with("__spans", "__reach", lambda x, at: F.when(x["s"] >= at, F.concat(between(at, x["s"]), F.get(names, x["k"]))).otherwise(F.lit("")))
    rest = between(-F.array_min(F.transform("__spans", lambda x: x["n"])), F.size("__chars"))
    return found.withColumn("text", F.when(F.size("spans") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("text"))).drop("__spans", "__reach", "__chars")

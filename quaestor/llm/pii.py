"""Personal data by weak supervision, all in DataFrame and SQL functions.

Base spans come from four fixed patterns, leftmost and non-overlapping for each kind, kept
where the kind's check holds.  Wider patterns (e-mail addresses written out, dots in brackets and
colon-separated addresses, card numbers with other separators or 13 digits, phone numbers without
a plus) add candidates, on which labelers vote for, against, or not at all:

* regex: the base pattern and its check; a stricter shape of the kind,
* gazetteer: common top-level domains, ranges of public addresses, card issuers' first digits, area codes that exist,
* context: words before the span that announce the kind, or other numbers (order, invoice, page).

Votes are counted by pattern, of which there are at most 3**L per kind whatever the corpus.
Expectation-maximisation over those counts estimates how reliable each labeler is and how
likely each pattern is personal data; a logistic span classifier is trained on these
probabilities, over the votes and the span's shape, and applied as a SQL expression.  Wider
candidates that it accepts and that overlap no base span are added; base spans always stay.
Counts enter EM and the fit as shares of a fixed weight, so a larger corpus of the same kind
gives the same classifier.

Positions are code points, ends exclusive.  Patterns are written so that Java's matcher runs
them without recursion and in linear time: possessive where nothing follows, and tried only
at the start of a run of their first characters (or right after the previous match).

Empty cases: a null text is empty and has no spans.  Rows that share a doc_id stay rows of
their own.  Empty tables give empty results.  Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Base patterns (fixed values).
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
CHECK = {
    "email": "true",
    "ip": rf"x.m RLIKE r'^{_BYTE}[.]{_BYTE}[.]{_BYTE}[.]{_BYTE}$'",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}
#: What a text must hold for a pattern to match at all.
_NEEDS = {"email": "contains(text, '@')", "ip": r"text RLIKE r'[0-9][.][0-9]'", "card": r"text RLIKE r'[0-9][\x20-]?[0-9]'", "phone": "contains(text, '+')"}
_DOT = r"\x20?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?"
_GROUP = "[0-9A-Fa-f]{1,4}"
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9A-Za-z.:])(?:[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}|(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{2,6}}(?::{_GROUP}){{1,5}})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4}){3}|[0-9]{4}[\x20._/-]{1,2}[0-9]{6}[\x20._/-]{1,2}[0-9]{5}|[0-9]{13})(?![0-9])",
    "phone": r"(?<![0-9+])(?<![0-9][.-])(?:1[\x20.-])?\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])",
}
_WIDE_NEEDS = {
    "email": r"text RLIKE r'[(\[{]at[)\]}]'", "ip": rf"text RLIKE r'[0-9]{_DOT}[0-9]' OR contains(text, ':') AND text RLIKE r'[0-9A-Fa-f]:[0-9A-Fa-f:]'",
    "card": r"text RLIKE r'[0-9](?:[\x20._/-]{1,2}[0-9]{4}|[0-9]{12})'", "phone": r"text RLIKE r'[0-9]{3}[\x20.-][0-9]{4}'",
}
#: What a wider candidate must be to count as one.
_WIDE_CHECK = {
    "email": None, "ip": r"contains(x.m, ':') OR forall(regexp_extract_all(x.m, '[0-9]+', 0), n -> int(n) <= 255)", "card": f"luhn_check({_DIGITS})", "phone": None,
}
#: Word lists of the labelers (fixed values).
_DOMAINS = "com|org|net|edu|gov|io|info|de|fr|es|it|uk|eu"
_ANNOUNCE = {"email": "mail|write|contact|reach", "ip": "ip|host|server|address|ping", "card": "card|visa|master|credit|pay", "phone": "tel|phone|call|mobile|cell|fax|contact"}
_OTHER = "order|invoice|page|isbn|version|serial|ticket|item|part|no|id"
_BEFORE = 24


def _spans(kind: int, pattern: str, needs: str, check: str | None) -> str:
    """array<struct<start, kind, end, m, before>> of a pattern's matches: matches and the gaps between give the places."""
    found = f"CASE WHEN {needs} THEN regexp_extract_all(text, r'{pattern}', 0) END"
    gaps = f"split(text, r'{pattern}', -1)"
    span = f"struct(s.at + length(g[k]) AS start, {kind} AS kind, s.at + ln[k] AS end, y.ms[k] AS m, lower(right(g[k], {_BEFORE})) AS before)"
    # places are summed up within runs of 256 matches, each from the sum of the runs before it
    walk = (
        "flatten(transform(sequence(0, CAST((size(y.ms) - 1) div 256 AS INT)), b -> aggregate(sequence(b * 256, least(size(y.ms), (b + 1) * 256) - 1), "
        "struct(aggregate(slice(ln, 1, b * 256), 0, (s, x) -> s + x) AS at, cast(array() AS array<struct<start: int, kind: int, end: int, m: string, before: string>>) AS out), "
        f"(s, k) -> struct(s.at + ln[k] AS at, concat(s.out, array({span})) AS out), s -> s.out)))"
    )
    lengths = "transform(y.ms, (m, k) -> length(m) + length(g[k]))"
    one = f"flatten(transform(filter(array(struct({found} AS ms)), y -> size(y.ms) > 0), y -> flatten(transform(array({gaps}), g -> flatten(transform(array({lengths}), ln -> {walk}))))))"
    return f"filter({one}, x -> {check})" if check else one


def _votes(kind: str) -> list[str]:
    """Labelers of a kind over a struct ``x``: 1 for, -1 against, 0 silent."""
    strict = {
        "email": r"x.m RLIKE r'^[A-Za-z0-9][A-Za-z0-9._%+-]*[A-Za-z0-9]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$'",
        "ip": rf"x.m RLIKE r'^(?:[1-9][0-9]{{0,2}}|0)(?:{_DOT}(?:[1-9][0-9]{{0,2}}|0)){{3}}$' OR x.m RLIKE r'^[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{7}}$'",
        "card": r"x.m RLIKE r'^(?:[0-9]{15,16}|[0-9]{4}(?:([\x20._/-]{1,2})[0-9]{4})(?:\1[0-9]{4}){2}|[0-9]{4}([\x20._/-]{1,2})[0-9]{6}\2[0-9]{5})$'",
        "phone": r"x.m RLIKE r'^\+?1?[\x20.-]?\(?[2-9][0-9]{2}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}$'",
    }[kind]
    known = {
        "email": rf"lower(x.m) RLIKE r'(?:\.|dot.?\x20?)(?:{_DOMAINS})$'",
        "ip": r"NOT x.m RLIKE r'^(?:(?:0|127|22[4-9]|2[3-5][0-9])[^0-9:]|[fF][fF][0-9A-Fa-f]{2}:)'",
        "card": rf"{_DIGITS} RLIKE r'^(?:4|5[1-5]|2[2-7]|3[47]|6)'",
        "phone": rf"{_DIGITS} RLIKE r'^1?[2-9][0-8][0-9]'",
    }[kind]
    return [
        "CASE WHEN x.base THEN 1 ELSE 0 END",
        f"CASE WHEN {strict} THEN 1 ELSE -1 END",
        f"CASE WHEN {known} THEN 1 ELSE -1 END",
        f"CASE WHEN x.before RLIKE r'(?:^|[^a-z])(?:{_ANNOUNCE[kind]})[a-z]*[^a-z0-9]*$' THEN 1 ELSE 0 END",
        rf"CASE WHEN x.before RLIKE r'(?:^|[^a-z])(?:{_OTHER})[^a-z0-9]*$' THEN -1 ELSE 0 END",
    ]


_SHAPE = ["CASE WHEN length(x.m) >= 16 THEN 1 ELSE 0 END", "CASE WHEN x.before RLIKE r'[0-9][^a-z]{0,3}$' THEN 1 ELSE 0 END"]


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 100) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(share of true spans, per labeler vote -> (chance if true, chance if false)) by expectation-maximisation."""
    count = len(patterns[0][0])
    belief = [min(0.9, max(0.1, 0.5 + 0.2 * sum(votes))) for votes, _ in patterns]
    share, tables = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        share = (sum(n * b for (_, n), b in zip(patterns, belief, strict=True)) + 1) / (total + 2)
        tables = []
        for k in range(count):
            true, false = {-1: 1.0, 0: 1.0, 1: 1.0}, {-1: 1.0, 0: 1.0, 1: 1.0}
            for (votes, n), b in zip(patterns, belief, strict=True):
                true[votes[k]] += n * b
                false[votes[k]] += n * (1 - b)
            a, c = sum(true.values()), sum(false.values())
            tables.append({v: (true[v] / a, false[v] / c) for v in true})
        new = []
        for votes, _ in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, votes, strict=True))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        if max(abs(x - y) for x, y in zip(new, belief, strict=True)) < 1e-6:
            break
        belief = new
    return share, tables


def logistic(rows: list[tuple[tuple[float, ...], float, float]], penalty: float = 1.0, rounds: int = 50) -> list[float]:
    """Weights, the constant first, of a logistic fit to (features, target probability, weight), by Newton steps."""
    import numpy as np

    x = np.array([(1.0, *f) for f, _, _ in rows])
    y, n = np.array([t for _, t, _ in rows]), np.array([w for _, _, w in rows])
    beta, keep = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]) + keep, x.T @ (n * (y - p)) - penalty * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def _classifier(found: DataFrame, kind: str, weight: int) -> str | None:
    """A SQL expression over ``x`` for the probability that a candidate is personal data; null if there is nothing to learn from."""
    votes = _votes(kind)
    columns = [F.expr(v).alias(f"v{k}") for k, v in enumerate(votes)] + [F.expr(s).alias(f"s{k}") for k, s in enumerate(_SHAPE)]
    names = [f"v{k}" for k in range(len(votes))] + [f"s{k}" for k in range(len(_SHAPE))]
    seen = found.filter(F.col("x.kind") == KINDS.index(kind)).select(*columns).groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3**5 * 2**2 rows
    if not seen:
        return None
    total = sum(r["n"] for r in seen)
    merged: dict[tuple[int, ...], float] = {}
    for r in seen:
        key = tuple(r[k] for k in range(len(votes)))
        merged[key] = merged.get(key, 0) + r["n"] * weight / total
    share, tables = reliabilities(sorted(merged.items()))

    def belief(v: tuple[int, ...]) -> float:
        odds = math.log(share / (1 - share)) + sum(math.log(t[a][0] / t[a][1]) for t, a in zip(tables, v, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))

    beta = logistic([(tuple(float(r[n]) for n in names), belief(tuple(r[k] for k in range(len(votes)))), r["n"] * weight / total) for r in sorted(seen)])
    terms = [repr(beta[0])] + [f"{b!r} * ({e})" for b, e in zip(beta[1:], votes + _SHAPE, strict=True)]
    return f"1 / (1 + exp(-({' + '.join(f'double({t})' if k == 0 else t for k, t in enumerate(terms))})))"


def personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, weight: int = 1000) -> DataFrame:
    """Per document: doc_id, base and spans, both array<struct<start, kind, end>> in order of start and kind, and
    n_refused, the wider candidates that the classifier refuses.

    ``kind`` counts in ``KINDS``.  ``weight`` is what all counts together weigh against the priors.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return _found(rows, ["doc_id"], threshold, weight)


#: The wider candidates that touch no base span.  Base spans come in order of their starts, in runs of 256: of those that start
#: before a candidate's end, all but the last run's are known by the furthest end of the runs before it.
_RUNS = "sequence(0, CAST((size(base) - 1) div 256 AS INT))"
_FIRST = f"transform({_RUNS}, r -> base[r * 256].start)"
_FURTHEST = f"flatten(transform(array(transform({_RUNS}, r -> array_max(transform(slice(base, r * 256 + 1, 256), b -> b.end)))), m -> transform({_RUNS}, r -> coalesce(array_max(slice(m, 1, r)), -1))))"
_TOUCHED = "exists(array(size(filter(z.first, h -> h < w.end))), k -> k > 0 AND (z.furthest[k - 1] > w.start OR exists(slice(base, (k - 1) * 256 + 1, 256), b -> b.start < w.end AND w.start < b.end)))"
_FREE = f"IF(size(base) = 0 OR size(wide) = 0, wide, flatten(transform(array(struct({_FIRST} AS first, {_FURTHEST} AS furthest)), z -> filter(wide, w -> NOT ({_TOUCHED})))))"


def _found(rows: DataFrame, kept: list[str], threshold: float, weight: int) -> DataFrame:
    base = ", ".join(_spans(k, BASE[kind], _NEEDS[kind], CHECK[kind]) for k, kind in enumerate(KINDS))
    wide = ", ".join(_spans(KINDS.index(kind), p, _WIDE_NEEDS[kind], _WIDE_CHECK[kind]) for kind, p in WIDE.items())
    marked = lambda b: f"transform(s, x -> struct(x.start, x.kind, x.end, x.m, x.before, {b} AS base))"
    found = rows.select(*kept, F.expr(f"array_sort(flatten(array({base})))").alias("base"), F.expr(f"flatten(array({wide}))").alias("wide"))
    found = found.select(*kept, F.expr(marked("true").replace("(s,", "(base,")).alias("base"), F.expr(_FREE).alias("wide"))
    found = written(found.select(*kept, "base", F.expr(marked("false").replace("(s,", "(wide,")).alias("wide")), "spans")
    every = found.select(F.explode(F.concat("base", "wide")).alias("x"))
    cases = []
    for kind in WIDE:
        if scored := _classifier(every, kind, weight):
            cases.append(f"WHEN x.kind = {KINDS.index(kind)} THEN {scored} >= {threshold!r}D")
    accepted = F.expr(f"filter(wide, x -> CASE {' '.join(cases)} ELSE false END)") if cases else F.expr("filter(wide, x -> false)")
    plain = lambda c: f"transform({c}, x -> struct(x.start, x.kind, x.end))"
    return found.withColumn("added", accepted).select(*kept, F.expr(plain("base")).alias("base"), F.expr(f"array_sort({plain('concat(base, added)')})").alias("spans"), F.expr("size(wide) - size(added)").alias("n_refused"))


def redacted(docs: DataFrame, *, text: str = "text", threshold: float = 0.5, weight: int = 1000) -> DataFrame:
    """The documents, all their columns, with each span of personal data replaced by ``[KIND]``; null texts stay null."""
    row = docs.select(F.struct("*").alias("row")).withColumn("text", F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit("")))
    found = _found(row, ["row"], threshold, weight)
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    # spans in order; one that starts inside the last one kept is part of it
    parts = (
        f"aggregate(spans, struct(0 AS at, '' AS out), (s, x) -> CASE WHEN x.start < s.at THEN struct(greatest(s.at, x.end) AS at, s.out AS out) "
        f"ELSE struct(x.end AS at, concat(s.out, substr(row.`{text}`, s.at + 1, x.start - s.at), {names}[x.kind]) AS out) END, s -> concat(s.out, substr(row.`{text}`, s.at + 1)))"
    )
    changed = F.when(F.size("spans") > 0, F.expr(parts)).otherwise(F.col(f"row.`{text}`"))
    return found.select(*[(changed if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])

"""Many patterns in one scan against regular expressions and plain counts."""

import random
import re
import time

from quaestor.functions import matcher, names


def test_claims_equal_a_regular_expression(spark):
    rng = random.Random(5)
    letters = "abAB é."
    patterns = [(label, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 5)))) for label in ("x", "y") for _ in range(12)]
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(80)))) for k in range(150)] + [(900, None), (901, ""), (902, "İA ab")]
    docs, table = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(patterns, "label string, pattern string")
    want = set()
    for label in ("x", "y"):
        own = sorted({p.lower() for kind, p in patterns if kind == label}, key=lambda p: -len(p))
        finder = re.compile("|".join(map(re.escape, own)))
        want |= {(i, label, *m.span(), m.group()) for i, t in rows for m in finder.finditer(matcher.lowered(t or ""))}
    for limit in (matcher.LIMIT, 9):  # one shard and several
        assert {tuple(r) for r in matcher.claims(docs, table, limit=limit).collect()} == want


def test_counts_equal_plain_counts(spark):
    words = ["aa", "aba", "b", "it's", "b", "aab"]
    texts = ["aaaa abab abaaba", "it's b", "", None, "x"]
    rows = spark.createDataFrame(enumerate(texts), "k int, t string")
    got = {r.k: (r.n, r.m) for r in rows.select("k", matcher.counter(words, False)("t").alias("n"), matcher.counter(words, True)("t").alias("m")).collect()}
    assert got == {k: (sum((t or "").count(w) for w in words), sum(w in (t or "") for w in words)) for k, t in enumerate(texts)}


def test_a_hundred_thousand_names_in_one_scan(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(7)).title()
    known = [f"{word()} {word()}" for _ in range(100_000)]
    texts = [(k, f"Yesterday {known[k]} left, and {known[-k - 1].upper()} came; {known[k]} again.") for k in range(300)]
    start = time.time()
    found = {(r.document_id, r.name): r["count"] for r in names.extract_entities(spark.createDataFrame(texts, "id long, text string"), {"person": known}).filter("type = 'person'").collect()}
    assert time.time() - start < 60
    assert all(found[k, known[k]] >= 2 and found[k, known[-k - 1]] >= 1 for k in range(300))

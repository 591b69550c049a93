"""The fielded index: matches, ranks and excerpts against brute force and hand-made cases."""

import math
import random

import pytest

from quaestor.functions import fulltext

FIELDS = fulltext.FIELDS


def brute(rows, query, phrase, weights, by_field):
    terms = fulltext.terms_of(query)
    docs = [(i, {f: fulltext.terms_of(v) for f, v in zip(FIELDS, values)}) for i, *values in rows]
    total = {f: sum(len(d[f]) for _, d in docs) for f in FIELDS}
    n, mean = len(docs), sum(total.values()) / len(docs)
    units = [" ".join(terms)] if phrase else sorted(set(terms))
    count = lambda own, u: sum(own[k : k + len(u.split())] == u.split() for k in range(len(own)))
    tf = {(i, u): {f: count(d[f], u) for f in FIELDS} for i, d in docs for u in units}
    df = {u: sum(any(tf[i, u].values()) for i, _ in docs) for u in units}
    out = []
    for i, d in docs:
        if terms and all(any(tf[i, u].values()) for u in units):
            score = 0
            for u in units:
                f = sum(weights.get(x, 1.0) * tf[i, u][x] / ((0.25 + 0.75 * len(d[x]) / max(1, total[x] / n)) if by_field else 1) for x in FIELDS)
                norm = 1.2 if by_field else 1.2 * (0.25 + 0.75 * sum(map(len, d.values())) / mean)
                score += max(1e-6, math.log((n - df[u] + 0.5) / (df[u] + 0.5))) * f * 2.2 / (f + norm)
            out.append((i, round(score, 9)))
    return sorted(out, key=lambda r: (-r[1], r[0]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["wire", "transfers", "transferred", "café", "CAFE", "holding", "the", "of", "report", "x1", "naïve", "bank"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    return [(k, some(5), some(40), rng.choice(["report", "legal", None]), rng.choice(["bank of x", ""])) for k in range(60)] + [(90, None, None, None, None), (91, "wire transfer", "", "legal", "")]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    docs = spark.createDataFrame(rows, "id long, title string, text string, category string, source string")
    return fulltext.indexed(docs.repartition(3), f"file://{tmp_path_factory.mktemp('index')}")


@pytest.mark.parametrize("weights,by_field", [({}, False), ({"title": 4.0, "source": 0.0}, False), ({"title": 3.0, "text": 0.5}, True)])
def test_ranks_equal_brute_force(index, rows, weights, by_field):
    assert index.docs == len(rows)
    for query, phrase in (("wire transfer", True), ("cafe", True), ("transfer report cafe", False), ("bank of", True), ("of of", False), ("Legal", True), ("nothing here", False), ("...", True)):
        got = [(r.doc_id, round(r.score, 9)) for r in fulltext.search(index, query, phrase=phrase, k=None, weights=weights, by_field=by_field).collect()]
        assert got == brute(rows, query, phrase, weights, by_field), query


def test_a_weight_of_a_field_changes_the_order(spark, tmp_path):
    filler = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "nothing", f"secret secret secret {filler}", "x", "y"), (2, "secret", filler, "x", "y"), *((k, "a", filler, "x", "y") for k in range(3, 9))], "id long, title string, text string, category string, source string")
    index = fulltext.indexed(docs, f"file://{tmp_path}/i")
    assert [r.doc_id for r in fulltext.search(index, "secret").collect()] == [1, 2]
    assert [r.doc_id for r in fulltext.search(index, "secret", weights={"title": 10.0}).collect()] == [2, 1]
    assert [r.doc_id for r in fulltext.search(index, "secret", k=1).collect()] == [1]


def test_a_query_reads_the_shelves_of_its_words_alone(index):
    plan = index.of(["cafe"])._jdf.queryExecution().executedPlan().toString()
    wanted = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "shelf" in wanted and "PushedFilters: [" in plan and "term" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert {r.shelf for r in index.of(["cafe"]).select("shelf").distinct().collect()} == {fulltext.zlib.crc32(b"cafe") % fulltext.SHELVES}


def test_excerpts():
    words = " ".join(f"w{k}" for k in range(100))
    text = f"alpha {words} alpha beta gamma {words} beta"
    assert fulltext.excerpt(text, ["alpha", "beta"], phrase=False, size=4) == "...w99 <mark>alpha</mark> <mark>beta</mark> gamma..."
    assert fulltext.excerpt(text, ["alpha", "beta"], size=6) == "...w98 w99 <mark>alpha beta</mark> gamma w0..."
    assert fulltext.excerpt("One café, two.", ["cafe"], size=40) == "One <mark>café</mark>, two."
    assert fulltext.excerpt("a b c d", ["x"], size=2) == "a b..." and fulltext.excerpt(None, ["x"]) is None and fulltext.excerpt(" ?", ["x"]) == " ?"
    assert fulltext.excerpt("x x x x y", ["x"], phrase=False, size=2, marks=("[", "]")) == "[x] [x]..."
    assert fulltext.excerpt("a a a", ["a", "a"], size=9, marks=("[", "]")) == "[a a] a"
    dense = "hit " * 50_000
    assert fulltext.excerpt(dense, ["hit"], phrase=False, size=3, marks=("", "")) == "hit hit hit..."


def test_excerpt_shows_most_different_terms():
    rng = random.Random(6)
    for _ in range(200):
        words = [rng.choice(["a1", "b1", "c1", "n", "n", "n", "n"]) for _ in range(rng.randrange(1, 40))]
        cut = fulltext.excerpt(" ".join(words), ["a1", "b1", "c1"], phrase=False, size=5, marks=("", "")).replace(".", "").split()
        best = max(len({w for w in words[k : k + 5]} - {"n"}) for k in range(len(words)))
        assert len(set(cut) - {"n"}) == best and len(cut) <= 5

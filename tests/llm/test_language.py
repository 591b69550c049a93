"""Pieces, collocations and divergences against the library or brute force, with odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaestor.llm import collocations, divergence, pieces
from quaestor.llm.queries import QUERIES, vocabulary

CLASH = ["body", "ids", "block", "codes", "words", "counts", "place", "n", "f", "id", "l", "r", "phrase", "term", "p", "q", "part", "kind", "value", "rank", "item"]
DOCS = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASH)


def documents(spark, rows):
    return spark.createDataFrame([(*row, *(["x"] * len(CLASH))) for row in rows], DOCS)


@pytest.fixture(scope="module")
def model():
    return vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def code(model):
    return pieces.PieceEncoder(model)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    common = ["New", "york", "city", "of", "the", "light", "ÉTÉ", "x\x00y", "\x1cz", "it's"]
    rows = []
    for k in range(260):
        words = [rng.choice(common) if rng.random() < 0.7 else f"w{chr(97 + rng.randrange(26))}{rng.randrange(9)}" for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["new York\tcity hall", "a b c d e f g", "the end. The end"]))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for w in words)
        rows.append((k, text, rng.choice(["en", "en", "fr", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", "é3", None])))
    rows += [(900, None, "en", "s0"), (901, "", "fr", "none"), (902, None, "de", "only"), (903, "...", "de", "other"), (None, "new york", "en", None), (3, rows[3][1], rows[3][2], rows[3][3])]
    rows.append((904, "a b c d e " * 4000, "en", "s1"))
    return rows


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abcdeinorst ▁\n\t.,<s>0x/é́中한😀\x00")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_pieces_are_the_librarys(code, text):
    assert code.encode([text])[0].tolist() == code.library.encode(text, add_bos=True, add_eos=True)


def test_pieces_of_words_and_runs(code):
    rng = random.Random(3)
    syllables = ["the", "ing", "tion", "an", "er", " ", "  ", "    ", "\n", "...", "===", "http://", "ç", "è", "École", "1", "00"]
    texts = ["".join(rng.choice(syllables) for _ in range(rng.randrange(200))) for _ in range(3000)] + ["a" * 50_000, " " * 5000, "é" * 3000]
    assert [x.tolist() for x in code.encode(texts)] == code.library.encode(texts, add_bos=True, add_eos=True)
    small = pieces.PieceEncoder(vocabulary("piece_bpe_32k.model"), limit=10)  # forgets after each call
    assert [small.encode([t])[0].tolist() for t in texts[:200]] == [x.tolist() for x in code.encode(texts[:200])]


def test_last_piece_of_each_prefix(code):
    """Whatever the prefix, the table's last piece is that of the prefix's own encoding."""
    for word in ("▁unbelievable", "▁tionsthering", "▁▁▁▁mañana", "Łódź"):
        last = [code.start] + [None] * len(word)
        code._table(word, last)
        for k in range(1, len(word) + 1):
            assert last[k].piece == code._merged(word[:k])[-1]


def test_encoded_rows(spark, model, code, corpus):
    rows = [*corpus, (905, "long " * 60_000 + "word" * 9000, "en", "s")]
    want = sorted(((i, code.library.encode(t or "", add_bos=True, add_eos=True)) for i, t, _, _ in rows), key=str)
    got = pieces.encoded(documents(spark, rows), model=model, with_text=True)
    found = got.collect()
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in found), key=str) == want
    assert all(r.n_tokens == len(r.ids) // 4 and r.decoded == code.library.decode(np.frombuffer(r.ids, "<u4").tolist()) for r in found)
    texts = pieces.decoded(got.select("doc_id", "ids"), model=model)
    assert sorted(((r.doc_id, r.text) for r in texts.collect()), key=str) == sorted(((r.doc_id, r.decoded) for r in found), key=str)
    assert pieces.encoded(documents(spark, rows).limit(0), model=model).count() == 0


def test_sentencepiece_query(spark, sf_dir, code):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op11_sentencepiece"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = code.library.encode(r.text or "", add_bos=True, add_eos=True)
        own = got[r.doc_id]
        assert (own.n_tokens, own.ids_sha256, own.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(code.library.decode(ids).encode()).hexdigest())


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def best_phrases(rows, least, most, longest=5):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * own[p[i:j]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((Fraction(1000 * a * n[lang], own[p[:k]] * own[p[k:]]).__floor__(), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_words,few,bits", [(40, 10**6, 31), (40, 0, 31), (300, 12, 0), (10**6, 10**6, 0)])
def test_collocations(spark, corpus, block_words, few, bits):
    want = best_phrases(corpus, 4, 40)
    got = collocations.collocations(documents(spark, corpus).repartition(3), least=4, most=40, block_words=block_words, few=few, bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert {w[0] for w in want} == {"en", "fr", "und"} and any(len(w[2].split()) == 5 for w in want) and any(w[1] == 40 for w in want)


def test_collocations_of_empty_and_wordless_tables(spark, corpus):
    assert collocations.collocations(documents(spark, corpus).limit(0)).count() == 0
    assert collocations.collocations(documents(spark, [(1, None, None, None), (2, " . ", "en", "s")]), least=1).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    runs = spark.createDataFrame([(2, "en", "a b", 10**11, [10**12], [3 * 10**11], False), (3, "en", "a b c", 10**11, [10**11, 2 * 10**11], [2 * 10**11, 10**11], False)], "size int, lang string, phrase string, f long, heads array<long>, tails array<long>, subsumed boolean")
    totals = spark.createDataFrame([("en", 9 * 10**14 + 7)], "lang string, n long")
    for few in (10, 0):  # both ways to join the totals
        got = {r.phrase: r for r in collocations.scored(runs, totals, few).collect()}
        n = 9 * 10**14 + 7
        assert got["a b"].score == 1000 * 10**11 * n // (10**12 * 3 * 10**11)
        assert got["a b c"].score == 1000 * 10**11 * n // (2 * 10**22) and got["a b c"].l == 10**11  # a tie: the first cut


def test_a_name_never_leaves_its_bits(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_TASK_BITS", 1)
    with pytest.raises(Exception, match="63 bits"):
        collocations.collocations(documents(spark, [(k, "a b c d", "en", "s") for k in range(40)]).coalesce(1), least=1, block_words=4)


def distances(rows, least_docs, top):
    docs = [(lang or "", source or "", Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text)))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held, total = Counter(), Counter()
        groups = defaultdict(Counter)
        for _, source, words in own:
            held.update(words.keys())
            total.update(words)
            groups[source].update(words)
        kept = [t for t, n in held.items() if n >= least_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        q, p = share(total), {s: share(c) for s, c in groups.items()}
        for s in groups:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pair, 1)]
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(term[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"rare": 0.0, "terms": 3}, {"rare": 1.0}, {"rare": 0.4, "side": 2, "terms": 5}, {"rare": 1.0, "side": 1}])
def test_divergences(spark, corpus, options):
    want = distances(corpus, 6, 5)
    got = divergence.divergences(documents(spark, corpus), least_docs=6, top=5, **options)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(w[:4] == ("de", "only", "pair", "other") and w[4] == 0 for w in want) and any(w[5] == 5 and w[2] == "term" for w in want) and ("fr", "none") in {w[:2] for w in want}


def test_divergences_with_many_groups_and_flushes(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, " ".join("t" + "".join(map(chr, (97 + v // 9, 97 + v % 9))) for v in (min(int(rng.expovariate(0.1)), 80) for _ in range(12))), "en", f"s{rng.randrange(40)}") for k in range(400)]
    want = distances(rows, 3, 50)
    counts = divergence._counts
    monkeypatch.setattr(divergence, "_counts", lambda *a: counts(*a, most=7))
    for options in ({"side": 7, "terms": 9}, {"rare": 0.3, "side": 16}):
        assert sorted(tuple(r) for r in divergence.divergences(documents(spark, rows), least_docs=3, **options).collect()) == want


def test_divergences_of_an_empty_table(spark, corpus):
    assert divergence.divergences(documents(spark, corpus).limit(0)).count() == 0
    one = divergence.divergences(documents(spark, [(1, None, None, None)])).collect()
    assert one == []


def test_pairs_cover_every_two_groups_once(spark):
    groups = spark.createDataFrame([("en", f"s{k}", k + 1) for k in range(23)], "lang string, source string, p0 long")
    langs = spark.createDataFrame([("en", 10)], "lang string, v long")
    cells = spark.createDataFrame([], "lang string, source string, term binary, p long, q long, spread long")
    got = divergence.pair_distances(groups, langs, cells, side=4).collect()
    assert sorted((r.s1, r.s2, r.value) for r in got) == sorted((a, b, 10 * abs(int(a[1:]) - int(b[1:]))) for a, b in itertools.combinations(sorted(f"s{k}" for k in range(23)), 2))

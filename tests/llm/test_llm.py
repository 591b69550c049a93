"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaestor.llm import decontam, encoders, minhash, packing, pii, substrings, tokens, toxicity, urls, vectors, warc
from quaestor.llm.components import components
from quaestor.llm.queries import ORACLE_SQL, QUERIES, URL_RULES, vocabulary

CLASH = ["body", "text_hash", "fp", "bands", "sketch", "part", "row", "row_id", "row_hash", "key", "node", "base", "spans", "words", "kept", "label", "score", "first", "last", "tokens"]
DOCS = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASH)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", *(["x"] * len(CLASH))) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    base, passage = [prose(rng, n) for n in (60, 90, 120, 50)], prose(rng, 45)
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(10, base[0]), (11, base[0].upper()), (12, base[1] + " tail"), (13, "head " + base[2].replace("w1 ", "w2 ", 1)), (14, base[3] + "\n" + passage), (15, passage + "\t" + base[3])]
    rows += [(20, None), (21, ""), (22, " \n "), (23, "w1"), (24, "w1 w2 w3"), (25, "W1 w2 w3"), (26, prose(rng, 9000)), (27, "é" * 40_000)]
    rows += [(28, " ".join(["again"] * 80)), (None, base[2]), (None, prose(rng, 40)), (None, None), (30, "caf\u00e9\u00a0 \n na\u00efve\u2003x\x1cy <|endoftext|> 123"), (31, "w9 w8 w7 w6 w5"), (31, "w9 w8 w7 w6 w5"), (31, prose(rng, 30))]
    return rows


def sets(rows, width):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    return out


def labelled(n, pairs, names):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    least = {}
    for k in range(n):
        if names[k] is not None:
            least[find(k)] = min(names[k], least.get(find(k), names[k]))
    return [least.get(find(k)) for k in range(n)]


@pytest.mark.parametrize("options", [{}, {"small": 1, "task_nodes": 2}, {"small": 1, "task_nodes": 1, "dense": 0}])
def test_near_duplicates(spark, corpus, options):
    own = sets(corpus, 4)
    pairs = [(a, b) for a, b in itertools.combinations(range(len(own)), 2) if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])]
    want = labelled(len(own), pairs, [i for i, _ in corpus])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, corpus), width=4, **options).collect()), key=str)
    assert got == sorted(((i, len(s), c, i == c or c is None) for (i, _), s, c in zip(corpus, own, want)), key=str)


def test_deduplicated_keeps_one_of_each_group(spark, corpus):
    docs = documents(spark, corpus)
    kept = minhash.deduplicated(docs, width=4)
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 10 not in ids and 11 not in ids and {20, 21, 22, 26} <= set(ids) and ids.count(31) == 2


@pytest.mark.parametrize("dense", [0, 64, 10**9])
def test_large_near_copy_group_spans_tasks(spark, dense):
    rng = random.Random(3)
    base = prose(rng, 120, 100_000).split()
    rows = [(k, " ".join(f"v{k}_{j}" if rng.random() < 0.01 else w for j, w in enumerate(base))) for k in range(90)]
    own = sets(rows, 4)
    pairs = [(a, b) for a, b in itertools.combinations(range(90), 2) if 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), width=4, small=4, task_nodes=16, dense=dense).collect()}
    assert [got[k] for k in range(90)] == labelled(90, pairs, list(range(90)))


def test_template_family_has_no_pairs_to_compare(spark, monkeypatch):
    """Texts that share a template and are not similar enough: prefixes give no pair, so no text travels twice."""
    rng = random.Random(4)
    template = prose(rng, 150, 100_000).split()
    rows = [(k, " ".join([*template, *(f"u{k}_{j}" for j in range(30))])) for k in range(300)]
    rows += [(1000 + k, rows[k][1] + f" z{k}") for k in range(0, 300, 10)]  # 30 pairs that are
    monkeypatch.setattr(minhash, "_in_blocks", None)  # would fail
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), width=4, small=4, task_nodes=40).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    for share in (0.8, 0.9, 0.95):
        common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (int(2000 * share), 2000 - int(2000 * share), 2000 - int(2000 * share)))
        x, y = minhash.samples(np.concatenate([common, a])), minhash.samples(np.concatenate([common, b]))
        distance = int(np.bitwise_count(minhash.odd_sketch(x).view(np.uint64) ^ minhash.odd_sketch(y).view(np.uint64)).sum())
        assert abs(float(minhash.least_similar(distance)) - (x == y).mean()) < 0.06
        assert distance <= minhash.FURTHEST


def test_components_agree_on_both_paths(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(3, 3), (None, 4)]
    df = spark.createDataFrame(links, "a long, b long")
    nodes = sorted({x for a, b in links if a is not None and a != b for x in (a, b)})
    want = dict(zip(nodes, labelled(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in links if a is not None and a != b], nodes)))
    for limit in (1, 10_000):
        rows = components(df, one_task=limit).collect()
        assert {r.node: r.component for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 500])
def test_substrings(spark, corpus, bucket_bytes):
    words = [(t or "").encode().split() for _, t in corpus]
    count = {}
    for w in words:
        for k in range(len(w) - 34):
            count[tuple(w[k : k + 35])] = count.get(tuple(w[k : k + 35]), 0) + 1
    want = []
    for (i, t), w in zip(corpus, words):
        keep = [True] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                keep[k : k + 35] = [False] * 35
        want.append((i, len(w), keep.count(False), None if t is None else b" ".join(itertools.compress(w, keep)).decode()))
    got = substrings.without_repeats(documents(spark, corpus), bucket_bytes=bucket_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_removed == sum(s["last"] - s["first"] + 1 for s in r.removed) for r in got)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + 0.15 * rng.normal(size=8)).astype(np.float32).tolist()) for k in range(120)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, [2 * x for x in rows[0][1]]), (203, None), (204, [0.0] * 8), (205, [float("nan")] * 8), (206, [float("inf")] + [0.0] * 7), (207, [None] * 8), (208, []), (209, [1.0, 2.0]), (210, [1.0, 2.0]), (None, rows[5][1])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, node string")
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    pairs = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9:
                pairs.append((a, b))
    links = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    want = [(i, int(n), c, i is not None and i == c) for (i, _), n, c in zip(rows, links, labelled(len(rows), pairs, [i for i, _ in rows]))]
    got = vectors.near_duplicate_vectors(frame, block_rows=16, fan=2)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=str) == sorted(want, key=str)


def test_decontamination(spark, corpus):
    rng = random.Random(9)
    item = prose(rng, 30, 10_000)
    items = [(1, item), (2, prose(rng, 25, 10_000)), (3, None), (4, ""), (5, "w1 w2 w3"), (6, item), (6, item), (7, prose(rng, 120, 10_000))]
    long_item = items[7][1].split()
    rows = [*corpus, (40, prose(rng, 3000) + " " + item.upper() + "\n" + prose(rng, 3000)), (41, item.rsplit(" ", 12)[0]), (42, prose(rng, 20) + " " + " ".join(long_item[:100]) + " z"), (43, " ".join(long_item[:90]))]
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, body string")
    docs, own, small = documents(spark, rows), sets(rows, 5), sets(items, 5)
    want = {(i, j, len(b), len(a & b)) for (i, _), a in zip(rows, own) for (j, _), b in zip(items, small) if b and len(a & b) >= 0.8 * len(b) - 1e-9}
    for block in (4_000_000, 60):
        got = decontam.contaminations(docs, frame, block=block).collect()
        assert {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got} == want
    assert any(i == 40 for i, *_ in want)
    clean = decontam.decontaminated(docs, frame)
    assert clean.schema == docs.schema
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((i for i, _ in rows if i not in {w[0] for w in want}), key=str)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    """The contract's patterns with the checks, by Python's matcher."""
    digits = lambda m: re.sub(r"\D", "", m)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, check) in enumerate(kinds) for m in re.finditer(p, text) if check(m.group()))


PRIVATE = [
    "mail a.b@x.org, c@d.e.f.g@h.i and @x.y a@b a@b.c_d@e.f é😀q@w.com", "ip 1.2.3.4 256.1.1.1 001.2.3.4.5.6.7.8 1.2.3 0.0.0.0", "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 5 5--5 0000000000000000",
    "+1 (988) 555-2485 and +12 3 +1234567890123456 ++49 30 1234567.", "call 212-555-0187 or (415) 555 2671; order 123-456-7890", "write joe (at) example (dot) com or jane[at]site.org", "9" * 30_000, "a" * 30_000 + "@b.c", "x@y.z " * 20_000, None, "",
]


def test_pii_base_spans(spark, corpus):
    rows = [*corpus, *((100 + k, t) for k, t in enumerate(PRIVATE))]
    got = pii.personal_data(documents(spark, rows)).collect()
    want = sorted(((i, base_spans(t or "")) for i, t in rows), key=str)
    assert sorted(((r.doc_id, [(s.start, s.kind, s.end) for s in r.base]) for r in got), key=str) == want
    assert all(set(r.base) <= set(r.spans) for r in got)


def test_pii_redaction_covers_every_base_span(spark):
    docs = documents(spark, [(k, t) for k, t in enumerate(PRIVATE)])
    out = pii.redacted(docs)
    assert out.schema.names == docs.schema.names
    rows = {r.doc_id: r.text for r in out.collect()}
    assert rows[9] is None and rows[10] == "" and rows[0].startswith("mail [EMAIL], [EMAIL]") and "4111" not in rows[2].split("[CARD]")[0]
    assert not any(base_spans(t or "") for k, t in rows.items() if k not in (0,))


def test_pii_phone_numbers_at_the_end_of_sentences(spark):
    whole = ["212-555-0187.", "(212) 555-0187.", "1-212-555-0187", "1 (212) 555-0187.", "212.555.0187-", "212-555-0187"]
    texts = [f"please call {w}{rest}" for w in whole for rest in ("", " Then", ", or")]
    texts += ["call 212-555-0187.5", "call 212-555-01879", "call 5-212-555-0187", "call 212-555-0187-44", "call 11-212-555-0187"]
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in pii.personal_data(documents(spark, list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(len(texts))] == [[w.rstrip(".-")] for w in whole for _ in range(3)] + [[]] * 5


def test_em_finds_the_reliable_labelers():
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        votes = tuple((1 if truth else -1) * (1 if rng.random() < a else -1) for a in (0.95, 0.9, 0.55))
        counts[votes] = counts.get(votes, 0) + 1
    share, tables = pii.reliabilities(sorted(counts.items()))
    assert abs(share - 0.4) < 0.05 and tables[0][1][0] > 0.9 and tables[2][1][0] < 0.65


def test_urls(spark):
    words = ["http://a.com/x", "https://WWW.Example.com/en/1?q=1#t", "http://example.com/en/", "http://x.example.com/en", "ftp://b.net/es/9", "b.net/es/9", "http://b.net", "://", "", None, "http://a.net/fr/1?u=http://c.com/", "x://y://com/", "http://notexample.com/en/", "http://sub.www.example.com/en/z"]
    pages = spark.createDataFrame([(k, u, "h", "x", "y") for k, u in enumerate(words * 2)], "page_id long, url string, html string, host string, tokens string")
    got = urls.judged(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int"), URL_RULES).collect()
    assert len(got) == len(words) * 2
    for r in got:
        url, host, path = words[r.page_id % len(words)] or "", "", ""
        if "://" in url:
            m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
            host, path = m[1].lower(), m[2]
        best = max(((len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])


def test_url_rules_are_mined_from_labels(spark):
    rows = [(k, f"http://{'bad' if k % 3 == 0 else 'good'}.example.org/{'offer' if k % 2 else 'news'}/{k}", None) for k in range(300)]
    labels = spark.createDataFrame([(k, 0 if k % 3 == 0 and k % 2 else 1, 0) for k in range(240)] + [(None, 0, 1), (500, None, None)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judged(pages, labels, []).collect()}
    assert all((got[k] == "block") == (k % 3 == 0 and k % 2 == 1) for k in range(300))
    assert urls.judged(pages.limit(0), labels, []).count() == 0


def test_packing(spark, corpus):
    path = vocabulary("word_bpe_49k.json")
    rows = packing.packed(documents(spark, corpus), tokenizer=path).collect()
    check_pieces(rows, corpus, path)
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert sum(used.values()) / (2048 * len(used)) > 0.9
    assert packing.packed(documents(spark, []), tokenizer=path).count() == 0


def check_pieces(rows, corpus, path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    whole = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in corpus]
    assert sum(r.length for r in rows) == sum(map(len, whole))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in by_doc.items():
        same = [w for (j, _), w in zip(corpus, whole) if j == i]
        for r in own:
            assert any(len(w) == r.doc_tokens and zlib.crc32(w[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for w in same)
        assert sum(r.length for r in own) == sum(map(len, same))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert set(by_sequence) == set(range(len(by_sequence)))


def test_packing_plan_uses_the_histogram_exactly():
    rng = random.Random(4)
    for _ in range(20):
        histogram = {64 * rng.randint(1, 32): rng.randint(1, 500) for _ in range(rng.randint(1, 20))} | {rng.randint(1, 63): rng.randint(1, 90) for _ in range(rng.randint(0, 20))}
        used = {}
        for lengths, times in packing.plan(histogram, 2048, 64, 4):
            assert sum(lengths) <= 2048 and times > 0
            for n in lengths:
                used[n] = used.get(n, 0) + times
        assert used == histogram


def test_nnls_matches_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(10):
        a, b = rng.normal(size=(6, 4)), rng.normal(size=6)
        best = np.inf
        for mask in itertools.product([0, 1], repeat=4):
            cols = [k for k in range(4) if mask[k]]
            x = np.linalg.lstsq(a[:, cols], b, rcond=None)[0] if cols else np.empty(0)
            if (x >= 0).all():
                best = min(best, np.linalg.norm(a[:, cols] @ x - b))
        assert np.linalg.norm(a @ packing.nnls(a, b) - b) <= best + 1e-6


def test_token_files(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    path, folder = vocabulary("byte_bpe_50k.json"), f"file://{tmp_path}/out"
    plain = Tokenizer.from_file(path)
    manifest = tokens.write_sequences(documents(spark, corpus), folder, tokenizer=path, length=128, shard_bytes=20_000)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_documents(manifest).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, t in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    shard = min(manifest.collect(), key=lambda r: r.shard)
    ids, mask = tokens.sequence(shard.path.removeprefix("file://") + ".arrow", 0, 128)
    assert ids.dtype == np.uint16 and len(ids) == len(mask) == 128 and mask.dtype == np.uint8 and mask.all() and not ids.flags.owndata and not mask.flags.owndata
    for r in manifest.collect():  # every shard ends in padding, if any, and holds its ids before it
        name = r.path.removeprefix("file://") + ".arrow"
        masks = np.concatenate([tokens.sequence(name, k, 128)[1] for k in range(-(-r.n_ids // 128))])
        assert masks.sum() == r.n_ids == masks[: r.n_ids].sum() and len(masks) % 128 == 0
    assert tokens.tokenized(documents(spark, []), tokenizer=path).count() == 0


@pytest.mark.parametrize("name,keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_unit_encoder_equals_the_tokenizer(name, keeps):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary(name))
    rng = random.Random(11)
    pieces = ["word", "Word", "WORD's", " ", "  ", "\n", "\t", "\r\n", "é", "e\u0301", "Σς", "İ", "ß", "中文", "\u00a0", "\u2003", "\x1c", "12345", "!!", "<|endoftext|>", "<|ENDOFTEXT|>", "<|start", "oftext|>", "'ll", "😀", "\x00", "\u0308"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    own = encoders.UnitEncoder(vocabulary(name), keeps, limit=300)
    ids, starts = own.encode([t.encode() for t in texts], 0, block=2000)
    for k, t in enumerate(texts):
        assert ids[starts[k] : starts[k + 1] - 1].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
    assert own.encode([], 7)[0].tolist() == [] and own.encode([b"ab" * 8], 7, block=16)[0][-1] == 7  # a block that ends with the texts


def test_encoder_of_an_unknown_file_takes_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as file:
        parts = json.load(file)
    parts["normalizer"] = {"type": "Replace", "pattern": {"String": "a b"}, "content": "xyz"}
    path = f"{tmp_path}/other.json"
    with open(path, "w", encoding="utf-8") as file:
        json.dump(parts, file)
    texts = ["a b c", "la b", " a b <|endoftext|> a b", ""]
    ids, starts = encoders.UnitEncoder(path, True).encode([t.encode() for t in texts], 0)
    plain = Tokenizer.from_file(path)
    assert [ids[a : b - 1].tolist() for a, b in zip(starts, starts[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_decontamination_judges_repeated_ids_by_their_own_texts(spark):
    import duckdb

    a, b = (" ".join(f"{c}{k}" for k in range(12)) for c in "ab")
    docs = spark.createDataFrame([(1, f"x {a} y"), (1, f"{b} z"), (1, f"{b} z"), (2, " ".join(a.split()[:7] + b.split()[:7])), (3, None), (4, "hi there you")], "doc_id long, text string")
    items = spark.createDataFrame([(7, a), (7, b), (7, b.upper()), (8, "hi there"), (9, "Hi there YOU"), (None, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in decontam.contaminations(docs, items).collect())
    assert got == [(1, 7, 8, 8)] * 3 + [(4, 9, 1, 1)]
    db = duckdb.connect()
    for name, frame in (("documents", docs), ("benchmark", items)):
        db.register(name, frame.toArrow())
    assert sorted(db.sql(ORACLE_SQL["op9_benchmark_decontamination"]).select("doc_id, item_id, n_item_shingles, n_shared").fetchall()) == got


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(8)
    long = "".join(chr(rng.randrange(32, 1000)) for _ in range(5000))
    inner = warc.record(99, "http://inner", b"trap", hashlib.sha256(b"trap").hexdigest(), None, None, False, "2024-01-01T00:00:00Z").decode("latin-1")
    rows = [(5, "http://a/1", long), (3, "http://a/2", long), (9, None, long), (1, "http://a\r\nX: y/", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello" * 9), (8, "u", inner), (None, "u", long), (3, "u", long), (None, None, None)]
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, payload string")
    manifest = warc.write_pages(pages, f"file://{tmp_path}/warc", file_bytes=4000)
    got = warc.read_records(manifest, chunk=700).collect()
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = min((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        revisit = len(body) >= 100 and first is not None and i != first
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert all(r.sound for r in got)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_rejects_records_inside_payloads(tmp_path, spark):
    """A whole gzip member stored uncompressed inside a record is a candidate, and is not returned."""
    trap = warc.record(77, "http://trap", b"x" * 300, hashlib.sha256(b"x" * 300).hexdigest(), None, None, False, "2024-01-01T00:00:00Z")
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    lines = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(trap).hexdigest()}\r\nPage-ID: 1\r\nContent-Length: {len(trap) + 4}\r\n\r\n".encode()
    outer = packer.compress(lines + b"H\r\n\r\n"[1:] + trap + b"\r\n\r\n") + packer.flush()
    path = tmp_path / "a.warc.gz"
    path.write_bytes(outer + outer)
    manifest = spark.createDataFrame([(f"file://{path}", len(outer) * 2, 2)], "path string, bytes long, records long")
    for chunk in (64, 300, 1 << 20):
        assert warc.candidates(manifest, chunk).count() == 4
        assert [r.page_id for r in warc.read_records(manifest, chunk=chunk).collect()] == [1, 1]


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(12)
    bad = ["blorgon", "snarkface", "wuzzle"]
    rows, labels = [], []
    for k in range(600):
        toxic, text = k % 4 == 0, prose(rng, 60).split()
        for _ in range(3 * toxic):
            text.insert(rng.randrange(60), rng.choice(bad) if k % 8 else "grumpf" + rng.choice("abcdefgh") + rng.choice("aeiou"))
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "you " + prose(rng, 20) + " blorgom " + prose(rng, 20) + " snarkfase"), (1003, prose(rng, 20) + ' he said "blorgon" ' + prose(rng, 20)), (None, "z" * 50_000)]
    frame = spark.createDataFrame([(i, y, None) for i, y in labels] + [(1000, None, 1)], "doc_id long, toxic int, quality int")
    docs = documents(spark, rows)
    model = toxicity.learned(docs, frame.filter(~toxicity.held_out()))
    assert set(bad) <= set(model.terms) | {t for t in bad if any(t.startswith(s) for s in model.stems)} and any("grumpf".startswith(s) or s.startswith("grumpf") for s in model.stems)
    score = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    held = {r.doc_id for r in docs.select("doc_id", toxicity.held_out().alias("h")).filter("h").collect()}
    assert held and all((score[k] >= 0.7) == bool(y) for k, y in labels if k in held)
    assert score[1000] == score[1001] < 0.5 and score[1002] >= 0.7 and score[1003] < score[0] and all(0 <= s <= 1 for s in score.values())
    kept = toxicity.accepted(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(s < 0.7 for s in score.values())
    none = toxicity.learned(docs, frame.limit(0))
    assert all(r.score < 1e-6 for r in toxicity.scores(docs, none).collect())


def test_toxicity_learns_beside_a_text_with_many_copies(spark):
    rng = random.Random(13)
    rows, labels = [], []
    hot = prose(rng, 40).split() + ["blorgon", "snarkface"] + [f"own{k}q" for k in range(30)]
    for k in range(600):
        text, copy = prose(rng, 60).split(), k >= 400
        if copy:  # near copies of one toxic text, far more than all other toxic rows
            text = list(hot)
            text[rng.randrange(40)] = f"w{rng.randrange(400)}"
        elif k % 10 == 0:
            text[rng.randrange(60)] = ("blorgon", "snarkface")[k // 10 % 2]
        rows.append((k, " ".join(text)))
        labels.append((k, int(copy or k % 10 == 0)))
    docs = documents(spark, rows)
    model = toxicity.learned(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("blorgon".startswith(t) for t in [*model.terms, *model.stems]) and any("snarkface".startswith(t) for t in [*model.terms, *model.stems])
    assert not any(t.startswith("own") for t in [*model.terms, *model.stems])
    assert all((r.score >= 0.7) == bool(labels[r.doc_id][1]) for r in toxicity.scores(docs, model).collect())


def test_automaton_matches_edit_distance():
    rng = random.Random(13)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 11))) for _ in range(25)]
    automaton = toxicity.LexiconAutomaton(sorted(set(terms)), ["cab"])
    for _ in range(1500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
        best = min(((d, t) for t in set(terms) if (d := distance(word, t)) <= automaton.allowed(t)), default=None)
        want = (best[1], best[0]) if best and (best[0] == 0 or not word.startswith("cab")) else ("cab", 0) if word.startswith("cab") else None
        assert automaton.match(word) == want, word


def test_empty_tables(spark):
    empty = documents(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert minhash.near_duplicates(empty).count() == minhash.deduplicated(empty).count() == substrings.without_repeats(empty).count() == 0
    assert decontam.contaminations(empty, items).count() == decontam.decontaminated(empty, items).count() == pii.personal_data(empty).count() == 0
    assert vectors.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert toxicity.scores(empty, toxicity.Model()).count() == 0


def test_registered_queries():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from quaestor.llm.scratch import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = written(stage(spark, docs, sf_dir), name)
        counts.append(docs.count())
        assert name == "packing" or docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] == counts[4] > 0.6 * counts[0]
    assert docs.agg(F.sum("length")).first()[0] > 0 and pa.__version__


def test_substring_buckets_stay_even_beside_a_common_phrase():
    """A phrase shorter than a window, in every text: its windows differ, and share their minimizer."""
    rng = random.Random(21)
    phrase, n = [f"p{k}" for k in range(25)], 4000
    bodies = [" ".join(w[:60] + phrase + w[60:]).encode() for w in ([f"w{rng.randrange(100_000)}" for _ in range(120)] for _ in range(n))]
    part = lambda chosen: pa.RecordBatch.from_arrays([pa.array(chosen, pa.int64()), pa.array(chosen, pa.int64()), pa.array([bodies[k] for k in chosen], pa.binary())], names=["text_hash", "text_check", "body"])
    load = lambda s: np.bincount((s.least[s.distinct] % np.uint64(200)).astype(int), minlength=200)
    whole, some = (substrings._Slice(part(list(k)), substrings.WordHashes(), 35, 20) for k in (range(n), range(0, n, 16)))
    seen = load(some)
    plan = substrings.Plan({b: int(m) for b, m in enumerate(seen) if m > 1.5 * seen.mean()}, 200, seen.mean())
    final = np.bincount(plan.of(whole.hash[whole.distinct], whole.least[whole.distinct]), minlength=plan.total)
    assert load(whole).max() > 20 * np.median(load(whole)) and final.max() < 2 * np.median(final)


def test_vector_pruning_keeps_every_link(spark):
    """Clusters, strangers and hot groups, in blocks and in one: the same links, and few pairs compared."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    v = np.vstack([rng.normal(size=(500, 24)), centres[rng.integers(0, 40, 300)] + 0.1 * rng.normal(size=(300, 24)), centres[0] + 0.01 * rng.normal(size=(200, 24))])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    part = labelled(len(v), list(zip(*np.nonzero(near))), list(range(len(v))))
    for options in ({}, {"block_rows": 50, "block_bytes": 50 * 24 * 8, "fan": 3}):
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(frame, **options).collect()}
        assert got == {k: (int(near[k].sum()), part[k]) for k in range(len(v))}
        steps = vectors.pruning(frame, **options).first()
        assert steps.all_pairs == len(v) * (len(v) - 1) // 2 >= steps.pairs >= steps.met > steps.compared >= near.sum() // 2


def test_warc_is_read_in_many_tasks(spark, tmp_path):
    pages = spark.range(400).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(sha2(string(id), 256), 40) AS html")
    manifest = warc.write_pages(pages, f"file://{tmp_path}/many", file_bytes=20_000)
    files = manifest.collect()
    chunks = sum((f.bytes - 1) // 1000 + 1 for f in files)
    tasks = warc.candidates(manifest, 1000).rdd.getNumPartitions()
    assert chunks > 30 and tasks == min(chunks, max(4 * spark.sparkContext.defaultParallelism, -(-chunks // 16)))
    got = warc.read_records(manifest, chunk=1000)
    assert got.rdd.getNumPartitions() == tasks
    assert got.filter("sound").count() == 400 == sum(f.records for f in files)


@pytest.mark.parametrize("chunk", [1 << 16, 1 << 22])
def test_warc_reading_reads_each_byte_about_once(spark, tmp_path, monkeypatch, chunk):
    rng = random.Random(5)
    rows = [(k, f"http://a/{k}", prose(rng, 200, 100_000)) for k in range(1500)]
    manifest = warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/bytes")
    path, size = manifest.collect()[0][:2]
    read, at, n = 0, 0, 0
    while at < size:  # as a chunk's scan and walk read
        window = warc._Window(path, at, min(size, (at // chunk + 1) * chunk), stretch=min(1 << 18, chunk // 4))
        until = (at // chunk + 1) * chunk
        while at < min(until, size):
            window.drop(at)
            at, n = window.member(at)[1], n + 1
        read += window.read
    assert n == 1501 and read <= 1.5 * size
    monkeypatch.setattr(warc._Window.__init__, "__defaults__", (17, 5))  # whatever pieces a member comes in
    window = warc._Window(path, 0, 3)
    at = 0
    for _ in range(20):
        window.drop(at)
        content, at = window.member(at)
        assert content.startswith(b"WARC/1.1\r\n")
    assert warc.read_records(manifest, chunk=chunk).filter("sound").count() == 1500


def test_warc_marks_repeated_payloads_alike_with_and_without_a_broadcast(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"page {k % 7} " * 40) for k in range(60)], "page_id long, url string, html string")
    few, many = (warc.read_records(warc.write_pages(pages, f"file://{tmp_path}/few{n}", few=n)).select("page_id", "record_type", "refers_to") for n in (100, 0))
    assert sorted(few.collect()) == sorted(many.collect()) and few.filter("record_type = 'response'").count() == 7


def test_warc_references_name_records_that_exist(spark, tmp_path):
    import gzip

    body = "same " * 50
    pages = spark.createDataFrame([(2, "http://a/2", body), (1, "http://a/1", body), (1, "http://b/1", body), (None, None, body), (3, "http://a/3", "x")], "page_id long, url string, html string")
    names = [m.path.removeprefix("file://") for m in warc.write_pages(pages, f"file://{tmp_path}/ids").collect()]
    text = b"".join(gzip.open(n).read() for n in names).decode()
    ids, refers = re.findall(r"WARC-Record-ID: (\S+)", text), re.findall(r"WARC-Refers-To: (\S+)", text)
    assert len(refers) == 2 and set(refers) < set(ids) and len(set(ids)) == len(ids) == 5 + len(names)
    assert text.count("WARC-Type: warcinfo") == len(names) and all(gzip.open(n).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for n in names)


def url_tokens(url):
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    labels = host.lower().split(".")
    own = {f"label={x}" for x in labels} | {f"host={'.'.join(labels[k:])}" for k in range(len(labels) - 1)}
    return frozenset(own | {"segment=" + re.sub("[0-9]+", "0", x) for x in path.split("/") if x} | {f"key={k}" for k in re.findall(r"[?&]([^=&#]+)", url)})


def test_mined_url_rules_match_brute_force(spark):
    """All token combinations counted in plain Python: a url is blocked exactly where it holds one that qualifies."""
    rng = random.Random(17)
    pages, labels = [], []
    for k in range(700):
        url = f"http://{rng.choice(['a', 'b', 'www.a', 'x.b'])}.{rng.choice(['org', 'io'])}/{rng.choice(['p', 'q/r', 'q/s7'])}/{rng.choice(['t', 'u'])}{rng.choice(['', '?w=1', '?w=1&z=2'])}"
        pages += [(k, url)] * (1 + (k % 50 == 0))
        if k < 500:
            risky = (".a." in url or "//a." in url) and "/q/" in url and "w=" in url or "s7/u" in url
            labels.append((k, int(not (rng.random() < (0.95 if risky else 0.2))), 0))
    frame = spark.createDataFrame(pages, "page_id long, url string")
    marks = spark.createDataFrame([*labels, (3, 0, None)], "doc_id long, quality int, toxic int")
    bad = {i for i, q, _ in labels if q == 0} | {3}
    known = [(url_tokens(u), i in bad) for i, u in pages if i < 500]
    count = {}
    for own, b in known:
        for size in range(1, len(own) + 1):
            for some in itertools.combinations(sorted(own), size):
                n = count.setdefault(some, [0, 0])
                n[0] += b
                n[1] += 1
    good = {frozenset(s) for s, (b, n) in count.items() if b >= 20 and b >= 0.8 * n}
    assert any(len(s) > 1 and not any(t < s for t in good) for s in good)
    got = urls.judged(frame, marks, [], least_rows=20).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == sorted((i, "block" if any(s <= url_tokens(u) for s in good) else "allow") for i, u in pages)
    assert len(got) == len(pages) and {r.verdict for r in got} == {"block", "allow"}


def test_deep_paths_are_mined_in_bounded_time(spark):
    deep = "/".join(f"s{chr(97 + k % 26)}{k // 26}x" for k in range(30))
    pages = spark.range(400).selectExpr("id AS page_id", f"concat('http://h', string(id % 2), '.example.org/{deep}/', IF(id % 3 = 0, 'odd', 'even'), '?k', string(id % 5), '=1') AS url")
    labels = spark.range(400).selectExpr("id AS doc_id", "int(id % 7 != 0 AND id % 3 != 0) AS quality", "0 AS toxic")
    start = time.time()
    got = {r.page_id: r.verdict for r in urls.judged(pages, labels, []).collect()}
    assert time.time() - start < 60
    assert all(got[k] == "block" for k in range(0, 400, 3)) and any(v == "allow" for v in got.values())


def test_urls_with_repeated_ids_long_hosts_and_long_paths(spark):
    rows = [(1, "http://" + "a." * 200 + "com/" + "x/" * 5000), (1, "http://b.org/"), (1, "http://b.org/"), (2, "http://" + "y" * 50_000 + ".net/es/"), (None, "http://b.org/")]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = [(r.page_id, r.rule, r.verdict) for r in urls.judged(frame, labels, URL_RULES, least_rows=2).collect()]
    assert sorted(got, key=str) == sorted([(1, "com/", "allow"), (1, None, "block"), (1, None, "block"), (2, "net/es/", "block"), (None, None, "block")], key=str)


def test_scratch_tables_of_a_settled_step_are_deleted(spark, tmp_path):
    from pathlib import Path

    from quaestor.llm import scratch

    made = []

    def build():
        inner = scratch.written(spark.range(5).toDF("k"), "inner")
        made.append(inner.inputFiles()[0])
        return inner.filter("k > 1")

    out = scratch.settled(spark, "outer", build)
    assert sorted(r.k for r in out.collect()) == [2, 3, 4]
    assert not Path(made[0].removeprefix("file:").replace("//", "/")).exists()
    later = scratch.written(spark.range(2).toDF("k"), "later")
    assert later.count() == 2


def test_toxicity_of_repeated_ids_and_contradictory_labels(spark):
    rng = random.Random(31)
    rows, labels = [], []
    for k in range(300):
        text, toxic = prose(rng, 40).split(), k % 3 == 0
        if toxic:
            text.insert(rng.randrange(40), rng.choice(["blorgon", "snarkface"]))
        rows.append((k, " ".join(text)))
        labels += [(k, int(toxic))] + [(k, 0)] * (k % 6 == 0) + [(k, None)] * (k % 7 == 0)  # toxic if one label is
    rows += [(0, "quiet words " + prose(rng, 20)), (1, rows[0][1]), (None, rows[0][1]), (1, None)]
    docs, frame = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learned(docs, frame)
    assert model == toxicity.learned(docs.repartition(7), frame.repartition(3))  # the same from any order
    got = toxicity.scores(docs, model).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.score >= 0.7) for r in got), key=str) == sorted(((i, bool(t) and ("blorgon" in t or "snarkface" in t)) for i, t in rows), key=str)


def test_toxicity_of_a_text_full_of_hits_takes_linear_time():
    model = toxicity.Model({"blorgon": 5.0, "snarkface": 4.0}, {}, frozenset(), (-6.0, 1.0, 1.0, 1.0))
    scorer = toxicity.Scorer(model)
    some = scorer.hits("blorgon " + "calm " * 20 + "blorgon calm snarkface " + "calm " * 12 + "blorgon")
    assert [(k, round(w, 6)) for k, _, w in some] == [(0, 5.0), (21, 5.5), (23, 4.4), (36, 5.0)]
    start = time.time()
    assert len(scorer.hits("blorgon snarkface " * 100_000)) == 200_000
    assert time.time() - start < 10


def test_toxicity_query_equals_scores_one_by_one(spark, sf_dir):
    """The query against the rule said plainly: each text by itself, from the model of rows outside the held-out third."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, sf_dir).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in out}
    model = toxicity.learned(docs, labels.filter(F.col("doc_id").isin([i for i in out if not held[i]])))
    scorer = toxicity.Scorer(model)
    for r in docs.collect():
        q = out[r.doc_id]
        assert abs(q.score - scorer.score(r.text)) < 1e-12 and q.held_out == held[r.doc_id] and q.predicted == int(q.score >= 0.7)
    assert len(out) == docs.count()


def test_pipeline_stages_on_odd_rows(spark, corpus, sf_dir, tmp_path):
    """Nulls, empty texts, repeated rows and clashing columns go through every stage as its docstring says."""
    import corpus_pipeline

    docs = documents(spark, [*corpus, (50, "mail a.b@x.org now"), (50, "mail a.b@x.org now"), (51, "z" * 60_000)])
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.schema == docs.schema
        kept[name] = sorted(((r.doc_id, r.text) for r in now.collect()), key=str)
    assert len(kept["toxicity"]) == docs.count()  # nothing toxic here
    ids = [i for i, _ in kept["near_dedup"]]
    own = sets(corpus, 5)
    pairs = [(a, b) for a, b in itertools.combinations(range(len(own)), 2) if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])]
    groups = {}
    for (i, t), c in zip(corpus, labelled(len(corpus), pairs, list(range(len(corpus))))):
        groups.setdefault(c, []).append(i)
    assert all(min(j for j in g if j is not None) in ids for g in groups.values() if any(j is not None for j in g))
    assert ids.count(50) == 1 and 51 in ids and {20, 21, 22} <= set(ids) and None in ids
    assert kept["decontamination"] == kept["near_dedup"]
    assert (50, "mail [EMAIL] now") in kept["pii"] and len(kept["pii"]) == len(ids)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
    check_pieces(pieces, kept["pii"], vocabulary("word_bpe_49k.json"))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_shards_of_one_task_and_rows_without_an_id(spark, tmp_path):
    """A task writes one shard after another, and rows without an id are dealt to several tasks; the order stays."""
    rng = random.Random(2)
    rows = [(None if k % 2 else k, prose(rng, 300)) for k in range(200)]
    path = vocabulary("byte_bpe_50k.json")
    got = {}
    for tasks in (3, 8192):
        manifest = tokens.write_sequences(documents(spark, rows), f"file://{tmp_path}/{tasks}", tokenizer=path, length=64, shard_bytes=12_000, tasks=tasks)
        made = manifest.collect()
        by_task = {}
        for r in made:
            by_task.setdefault(r.shard >> tokens._TASK_BITS, []).append(r)
        assert len(by_task) <= tasks and sum(r.n_docs for r in made) == 200 and (tasks > 3 or max(map(len, by_task.values())) > 1)
        if tasks > 3:
            assert max(sum(r.n_docs for r in own) for own in by_task.values()) < 100  # not all rows without an id
        got[tasks] = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_documents(manifest).collect()), key=lambda r: r[1])
    assert got[3] == got[8192]


def test_a_plan_of_buckets_holds_the_split_ones_alone():
    rng = np.random.default_rng(3)
    plan = substrings.Plan({5: 40, 900_000: 25}, 1_250_000, 10.0)
    assert plan.total == 1_250_000 + 3 + 2 and len(plan.heavy) == 2
    least = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    least[:5000] = least[:5000] // np.uint64(1_250_000) * np.uint64(1_250_000) + np.uint64(5)
    hashes = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    home = plan.of(hashes, least)
    assert set(home[:5000].tolist()) == {5, 1_250_000, 1_250_001, 1_250_002} and (home[least % np.uint64(1_250_000) != 5] < 1_250_005).all()
    plain = (least % np.uint64(1_250_000)).astype(np.int64)
    rest = ~np.isin(plain, [5, 900_000])
    assert (home[rest] == plain[rest]).all() and (home == plan.of(hashes.copy(), least.copy())).all()


def test_candidates_that_touch_no_base_span_equal_brute_force(spark):
    rng = random.Random(14)
    rows = []
    for k in range(40):
        at, base, wide = 0, [], []
        for _ in range(rng.randrange(700) if k else 0):
            at += rng.randrange(6)
            base.append((at, rng.randrange(4), at + rng.randrange(1, 12), "m", ""))
        for _ in range(rng.randrange(60)):
            start = rng.randrange(at + 20)
            wide.append((start, rng.randrange(4), start + rng.randrange(1, 9), "m", ""))
        rows.append((k, sorted(base), wide))
    kind = "array<struct<start: int, kind: int, end: int, m: string, before: string>>"
    got = {r.k: [tuple(x) for x in r.free] for r in spark.createDataFrame(rows, f"k int, base {kind}, wide {kind}").selectExpr("k", f"{pii._FREE} AS free").collect()}
    assert got == {k: [w for w in wide if not any(w[0] < b[2] and b[0] < w[2] for b in base)] for k, base, wide in rows}
    assert any(0 < len(got[k]) < len(wide) for k, _, wide in rows)


def test_personal_data_of_a_text_full_of_it_takes_bounded_time(spark):
    text = " ".join(f"a{k}@b.org or 555-{200 + k % 700}-{1000 + k % 9000}" for k in range(50_000))
    docs = documents(spark, [(1, text), (2, "mail me at x@y.org"), (3, None)])
    start = time.time()
    found = {r.doc_id: (r.base, r.spans) for r in pii.personal_data(docs).collect()}
    assert time.time() - start < 60
    assert len(found[1][0]) == 50_000 and len(found[1][1]) >= 50_000
    assert len(found[2][0]) == 1 and found[3] == ([], [])

"""What plans shuffle: figures that follow the input, with results that equal brute force."""

import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quaestor import registry
from quaestor.bindings import Corpus
from quaestor.functions import fulltext, phrases
from quaestor.operators import graph, pairs, resolve


def shuffled(spark, run):
    """(rows of the result, rows that all stages of it wrote to shuffles)."""
    sc = spark.sparkContext._jsc.sc()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, quantiles, None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    return [tuple(r) for r in run().collect()], written() - before


def runs_of(text, sizes, least):
    found = []
    for n in sizes:
        counts = Counter(" ".join(text[k : k + n]) for k in range(len(text) - n + 1))
        found += [(run, c) for run, c in counts.items() if c >= least]
    return sorted(found, key=lambda x: -x[1])


def test_runs_are_counted_where_a_text_is_read(spark):
    rng = random.Random(3)
    texts = {k: [rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "of"]) for _ in range(300)] for k in range(40)}
    docs = spark.createDataFrame([(k, " ".join(ws)) for k, ws in texts.items()], "id long, text string")
    got, rows = shuffled(spark, lambda: phrases.repeated_phrases(docs))
    stops = set(phrases.L.PHRASE_STOPS)
    want = set()
    for k, ws in texts.items():
        telling = [x for x in runs_of(ws, (3, 4, 5), 2)[:200] if sum(w not in stops for w in x[0].split()) >= 2][:50]
        want |= {(k, run, c, place) for place, (run, c) in enumerate(telling, 1)}
    assert set(got) == want and len(got) == len(want)
    assert rows < 40 * 205  # 300 runs of each of three sizes in a text before
    got, rows = shuffled(spark, lambda: phrases.keywords(docs))
    want = {(k, run, c, place) for k, ws in texts.items() for place, (run, c) in enumerate(runs_of([w for w in ws if w != "of"], (1, 2), 1)[:50], 1)}
    assert set(got) == want and rows < 40 * 5


def test_rows_that_share_an_id_are_one_text(spark):
    docs = spark.createDataFrame([(1, "red fox runs home"), (1, "the red fox runs"), (None, "blue whale swims"), (None, "blue whale swims"), (2, "red fox runs"), (3, None)], "id long, text string")
    assert {tuple(r) for r in phrases.repeated_phrases(docs).select("id", "phrase", "count").collect()} == {(1, "red fox runs", 2), (None, "blue whale swims", 2)}
    words = {(r.id, r.word): r["count"] for r in phrases.keywords(docs).collect()}
    assert words[1, "red"] == 2 and words[1, "runs home"] == 1 and words[None, "blue whale"] == 2 and words[2, "fox runs"] == 1 and not [w for w in words if w[0] == 3]


def test_phrases_meet_the_documents_after_the_first_ones_are_chosen(spark):
    found = spark.range(3000).select(F.col("id"), F.concat(F.lit("p"), F.expr("IF(id < 30, 'common', string(id))")).alias("phrase"), F.lit(2).cast("long").alias("count"))
    docs = spark.range(3000).select("id", F.lit("1996-01-02").alias("date"))
    got, _ = shuffled(spark, lambda: phrases.phrase_trends(found, docs, 1))
    assert got == [("pcommon", 30, 60, "1996", 30)]
    plan = phrases.phrase_trends(found, docs, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, (id#") < plan.index("Join Inner, (phrase#")  # the outer join is that with the documents


def test_not_among_sends_nothing_whole_to_a_task(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id long, key long")
    for others, want in (([10], [2]), ([10, None], []), ([], [1, 2, 3]), ([30, 30], [1, 2])):
        table = spark.createDataFrame([(x,) for x in others], "other long")
        rows.createOrReplaceTempView("growth_rows"), table.createOrReplaceTempView("growth_others")
        asked = spark.sql("SELECT id FROM growth_rows WHERE key NOT IN (SELECT other FROM growth_others)")
        assert sorted(r.id for r in pairs.not_among(rows, "key", table).collect()) == sorted(r.id for r in asked.collect()) == want


def test_events_without_mentions_are_found_without_a_broadcast_of_mentions(spark, sf_dir):
    plan = registry.queries()["orphan_events"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "isnull((document_id" not in plan  # what NOT IN adds to an anti join, which only a broadcast can answer


def shared_pairs(sets, enough):
    return {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and enough(len(sets[a] & sets[b]), min(len(sets[a]), len(sets[b])))}


def test_pairs_that_share_are_settled_where_they_meet(spark):
    rng = random.Random(8)
    sets = {k: {rng.randrange(60) for _ in range(rng.randrange(1, 12))} for k in range(150)}
    sets |= {k: sets[k % 20] for k in range(150, 190)}  # copies
    rows = spark.createDataFrame([(k, g) for k, s in sets.items() for g in s] + [(5, None), (None, 5)], "m long, g long")
    for carried in (4096, 6, 0):  # 0: no set travels
        got = pairs.sharing(rows, "m", "g", 3, carried).collect()
        assert {tuple(r) for r in got} == shared_pairs(sets, lambda n, _: n >= 3) and len(got) == len(set(got))
        got = pairs.sharing_in_blocks(rows, "m", "g", 3, 40 + carried).collect()
        assert {tuple(r) for r in got} == shared_pairs(sets, lambda n, _: n >= 3) and len(got) == len(set(got))
        got = pairs.overlapping(rows, "m", "g", 0.6, carried).collect()
        assert {tuple(r) for r in got} == shared_pairs(sets, lambda n, least: n and n >= 0.6 * least - 1e-9) and len(got) == len(set(got))


def test_pairs_in_blocks_are_written_out_where_they_are_counted(spark, monkeypatch):
    rng = random.Random(9)
    sets = {k: {rng.randrange(30) for _ in range(rng.randrange(1, 14))} for k in range(40)}
    sets |= {k: sets[rng.randrange(10)] for k in range(40, 500)}  # copies
    rows = spark.createDataFrame([(k, g) for k, s in sets.items() for g in s] * 2 + [(5, None), (None, 5)], "m long, g long")
    first = spark.createDataFrame([(k,) for k in range(0, 500, 3)] * 2 + [(None,), (10_000,)], "id long")
    want = shared_pairs(sets, lambda n, _: n >= 3)
    got, moved = shuffled(spark, lambda: pairs.sharing_in_blocks(rows, "m", "g", 3, first=first))
    assert set(got) == {x for x in want if x[0] % 3 == 0} and len(got) == len(set(got)) > 10_000
    assert moved < 10_000  # pairs of classes were joined with their members before, and each of a member's pairs with the first ones
    monkeypatch.setattr(pairs, "ARRAY", 7)
    for cells in (1, 3):
        monkeypatch.setattr(pairs, "CELLS", cells)
        got = [tuple(r) for r in pairs.sharing_in_blocks(rows, "m", "g", 3, 10, first).collect()]
        assert set(got) == {x for x in want if x[0] % 3 == 0} and len(got) == len(set(got))
    monkeypatch.setattr(pairs, "SIDE", 5), monkeypatch.setattr(pairs, "FRAME", 50)  # what a task does, in smaller pieces
    units = [[k] if k < 40 else [k, k + 40, k + 80] for k in range(80)]
    held = pd.DataFrame({"items": [sorted(sets[u[0]]) for u in units], "ms": units, "fs": [[m % 3 == 0 for m in u] for u in units]})
    held["any"] = held["fs"].map(any)
    held = held.sort_values("any", ascending=False)
    for ends in ((held, held), (held[::2], held[1::2])):
        cells = [pairs._Cell(x) for x in ends]
        cells = cells[:1] * 2 if ends[0] is held else cells
        got = [r for x, y, n in pairs._alike(*cells, 3) for more in pairs._members(*cells, x, y, n) for r in zip(*(v.tolist() for v in more))]
        inside = [[(m, sets[u[0]]) for u in x["ms"] for m in u] for x in ends]
        want = {(min(m, o), max(m, o), len(s & t)) for m, s in inside[0] for o, t in inside[1] if m != o and len(s & t) >= 3 and min(m, o) % 3 == 0}
        assert set(got) == want and len(got) == len(want)


def test_copies_meet_others_once(spark):
    rows = spark.range(400 * 12).selectExpr("id div 12 AS m", "(id div 12) % 4 * 100 + id % 12 AS g")  # four sets, 100 copies of each
    got, moved = shuffled(spark, lambda: pairs.sharing(rows, "m", "g", 3))
    assert len(got) == 4 * 100 * 99 // 2 and {r[2] for r in got} == {12}
    assert moved < 4 * 400 * 12  # 19 800 candidates by their sets before


def test_pairs_of_entities_are_written_out_last(spark):
    entities = spark.range(600).selectExpr("id", "element_at(array('Ann Marsh', 'ann marsh', 'Joan Fielding', 'Joan Fieldings'), int(id % 4) + 1) AS name", "'person' AS type")
    mentions = spark.range(600).selectExpr("id div 8 AS document_id", "id AS entity_id", "1L AS count")
    got, moved = shuffled(spark, lambda: resolve.candidates(entities, mentions))
    base = lambda a, b: 0.95 if (a % 4 < 2) == (b % 4 < 2) and (a % 4 < 2 or a % 4 == b % 4) else 0.7 if a % 4 > 1 and b % 4 > 1 else 0
    total = lambda a, b: min(1.0, base(a, b) + 0.1 + 0.1 * (a // 8 == b // 8))
    want = {(a, b, round(total(a, b), 6), "auto" if total(a, b) >= 0.85 else "queue") for a in range(600) for b in range(a + 1, 600) if base(a, b)}
    assert {(a, b, round(x, 6), action) for a, b, x, action in got} == want and len(got) == len(want)
    assert moved < 20 * 600  # 89 700 pairs, which went to their documents before


def test_sources_of_path_centralities_are_dealt_to_tasks(spark):
    rng = random.Random(4)
    pairs_ = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(900)} | {(k, k + 1) for k in range(400, 500)}  # two parts, one a line of 101 nodes
    rows = [(a, b, rng.choice([1, 1, 2, 5])) for a, b in sorted(pairs_)]
    edges = spark.createDataFrame(rows, "a long, b long, weight long")
    df = graph.path_centralities(edges)
    assert "Repartition 3, true" in df._jdf.queryExecution().optimizedPlan().toString()  # one task had all sources before
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    place = {x: k for k, x in enumerate(names)}
    ends = sorted((place[y], place[x], w) for a, b, w in rows for x, y in ((a, b), (b, a)))
    head, tail, weight = (np.array(c) for c in zip(*ends))
    between, close = np.zeros(len(names)), np.zeros(len(names))
    for s in range(len(names)):  # the plain way
        graph._add_source(s, tail, head, weight.astype(float), between, close)
    got = {r.node: r for r in df.collect()}
    scale = 1 / ((len(names) - 1) * (len(names) - 2))
    assert sorted(got) == names and all(abs(got[x].betweenness - between[k] * scale) < 1e-12 and abs(got[x].closeness - close[k]) < 1e-12 for x, k in place.items())


def test_nodes_that_meet_hubs_alone_are_followed_through_the_hubs(spark, monkeypatch):
    rng = random.Random(5)
    rows = {(h, 100 + k): rng.choice([1, 1, 2, 3]) for k in range(260) for h in rng.sample(range(12), rng.randrange(1, 11))}
    rows |= {(a, b): rng.choice([2, 4, 9]) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.6} | {(k, k + 1): 1 for k in range(900, 912)}
    monkeypatch.setattr(graph, "_add_sources", None)  # each source went over all ends, as often as its longest path has edges
    df = graph.path_centralities(spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "a long, b long, weight long"))
    names = sorted({x for ab in rows for x in ab})
    place = {x: k for k, x in enumerate(names)}
    ends = sorted((place[y], place[x], w) for (a, b), w in rows.items() for x, y in ((a, b), (b, a)))
    head, tail, weight = (np.array(c) for c in zip(*ends))
    assert len(graph._Hubs.of(tail, head, weight.astype(float)).hubs) < 30
    between, close = np.zeros(len(names)), np.zeros(len(names))
    for s in range(len(names)):
        graph._add_source(s, tail, head, weight.astype(float), between, close)
    scale = 1 / ((len(names) - 1) * (len(names) - 2))
    got = {r.node: r for r in df.collect()}
    assert sorted(got) == names and all(abs(got[x].betweenness - between[k] * scale) < 1e-12 and abs(got[x].closeness - close[k]) < 1e-12 for x, k in place.items())


def test_pairs_are_counted_by_canonical_ends_before_they_are_shuffled(spark, sf_dir):
    from quaestor.plans import library

    c = Corpus(spark, sf_dir)
    got, moved = shuffled(spark, lambda: library._edges(c))
    want, before = shuffled(spark, lambda: graph.canonical_edges(c["links"], c["entities"], c["resolutions"]))
    assert sorted(got) == sorted(want) and moved < before


def test_names_made_of_few_letters_do_not_meet_all(spark):
    letters = "translate(substr(md5(string(id div 2)), 1, 12), '456789abcdef', '012301230123')"  # 64 trigrams in all
    entities = spark.range(3000).selectExpr("id", f"concat('Lone ', {letters}, IF(id % 2 = 1, 'z', '')) AS name", "'person' AS type")
    got, moved = shuffled(spark, lambda: resolve.class_links(entities))
    n = entities.selectExpr("id", "lower(name) AS n")
    want = n.toDF("a", "na").crossJoin(n.toDF("b", "nb")).filter("a < b AND levenshtein(na, nb, 2) >= 0")
    assert {r[:2] for r in got} == {tuple(r) for r in want.select("a", "b").collect()} and len(got) >= 1500
    assert moved < 3000 * 200  # nearly all of 4 500 000 pairs before


def test_two_edits_are_found_at_every_length(spark):
    rng = random.Random(11)
    names = set()
    for size in (8, 9, 10, 11, 22, 23, 24, 25, 26, 27, 28, 40):
        for _ in range(6):
            name = [rng.choice("ab😀é") for _ in range(size)]
            names.add("".join(name))
            for _ in range(4):
                other = list(name)
                for _ in range(rng.randrange(1, 3)):
                    k = rng.randrange(len(other))
                    other[k : k + rng.randrange(2)] = rng.choice(["", "a", "bé"])[: rng.randrange(3)]
                names.add("".join(other))
    table = spark.createDataFrame([("org", n) for n in sorted(names) if n], "type string, n string")
    every = resolve._close(table.select("type", F.col("n").alias("na")).join(table.select("type", F.col("n").alias("nb")), "type").filter("na < nb").select("type", "na", "nb"))
    got = resolve._close_names(table).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in every.collect()} and len(got) > 100


def test_words_too_rare_for_the_best_pairs_are_not_paired(spark):
    rng = random.Random(6)
    docs = {k: sorted({f"c{int(rng.paretovariate(0.7)) % 30}" for _ in range(12)} | {f"w{rng.randrange(400)}" for _ in range(30)}) for k in range(300)}
    rows = spark.createDataFrame([(k, w) for k, ws in docs.items() for w in ws] + [(None, "w1")], "d long, w string")
    counts = Counter((a, b) for ws in docs.values() for a in ws for b in ws if a < b)
    want = lambda k, least, members: sorted(((a, b, n) for (a, b), n in counts.items() if n >= least and min(sizes[a], sizes[b]) >= members), key=lambda x: (-x[2], x[:2]))[:k]
    sizes = Counter(w for ws in docs.values() for w in ws) + Counter(["w1"])
    for k, least, members, first in ((40, 3, 5, 20), (40, 3, 5, 2), (3, 1, 30, 100), (100_000, 2, 1, 20), (5, 400, 1, 10)):
        got, moved = shuffled(spark, lambda: pairs.most_shared(rows, "d", "w", k, least, members, first))
        assert got == want(k, least, members)
        assert (k, first) != (40, 20) or moved < 40_000  # about 120 000 different pairs of words before


def test_places_of_a_phrase_are_compared_where_all_its_terms_stand(spark, tmp_path):
    texts = spark.range(0, 40, 1, 1).selectExpr("id", "CASE id % 4 WHEN 0 THEN repeat('of a ', 500) WHEN 1 THEN repeat('of the ', 500) WHEN 2 THEN repeat('the of of ', 500) ELSE repeat('20 of the 20 ', 500) END AS title")
    index = fulltext.indexed(texts, f"file://{tmp_path}/index", ("title",))
    got, moved = shuffled(spark, lambda: fulltext.matches(index, "of the"))
    assert {r[0]: (r[3], r[4]) for r in got} == {k: {1: (500, 1000), 2: (499, 1500), 3: (500, 2000)}[k % 4] for k in range(40) if k % 4} and len(got) == 30
    assert moved < 500  # each place moved before: 45 000
    assert {r.doc_id: r.tf for r in fulltext.matches(index, "of of").collect()} == {k: 500 for k in range(2, 40, 4)}
    assert {r.doc_id: r.tf for r in fulltext.matches(index, "20 20").collect()} == {k: 499 for k in range(3, 40, 4)}


def test_short_documents_of_one_file_are_dealt_to_several_tasks(spark, tmp_path):
    texts = spark.range(0, 60_000, 1, 1).selectExpr("id", "concat(repeat('word of ', 12), id) AS title")
    tasks = []
    held = fulltext.postings
    try:
        fulltext.postings = lambda rows, *more: tasks.append(rows.rdd.getNumPartitions()) or held(rows, *more)
        index = fulltext.indexed(texts, f"file://{tmp_path}/index", ("title",))
    finally:
        fulltext.postings = held
    assert tasks == [2] and index.docs == 60_000 and fulltext.matches(index, "59999").collect()[0].doc_id == 59_999


def test_postings_are_written_where_their_documents_lie(spark, sf_dir, tmp_path):
    texts = spark.range(0, 5000, 1, 2).selectExpr("id", "concat('word of ', id) AS title")
    got, moved = shuffled(spark, lambda: fulltext.indexed(texts, f"file://{tmp_path}/index", ("title",)).rows)
    assert len(got) == 4 * 5000 and moved < 6000  # the 20 000 postings were shuffled too before
    c = Corpus(spark, sf_dir)
    plain = lambda rows: sorted(map(tuple, rows.select("id", "title", "category", "source").collect()))
    assert plain(c.headed()) == plain(c["docs"]) and "l_orderkey" not in c.headed()._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_follow_the_mentions_and_the_pairs(spark, sf_dir):
    assert Corpus(spark, sf_dir).tasks(1000) == -(-Corpus(spark, sf_dir).raw("lineitem").count() // 1000) > 1
    for name in ("export_documents", "entity_path_suggestions", "financial_entity_links", "list_entities"):  # as many tasks as the session has before
        assert "RepartitionByExpression" in registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    rng = random.Random(2)
    groups = {k: {rng.randrange(40) for _ in range(rng.randrange(9))} for k in range(200)}
    rows = spark.createDataFrame([(k, m) for k, ms in groups.items() for m in ms for _ in range(1 + m % 2)], "g long, m long")
    counts = Counter((a, b) for ms in groups.values() for a in ms for b in ms if a < b)
    want = sorted(((a, b, n) for (a, b), n in counts.items()), key=lambda x: (-x[2], x[:2]))[:30]
    best = pairs.best_shared(rows, "g", "m", 30, 100)
    assert [tuple(r) for r in best.collect()] == want
    assert f"], {sum(counts.values()) // 100}" in best._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_a_common_name_are_written_out_by_many_tasks(spark, sf_dir):
    rng = random.Random(8)
    rows = [(k // 2, rng.choice(["common", "common", "other", f"own {k}"]), rng.choice("abcd")) for k in range(900)]
    rows += [rows[0], (1, None, "a"), (2, "common", None), (None, "common", "a"), (-5, "common", "b"), (7, "twice", "a"), (7, "twice", "b")]
    table = spark.createDataFrame(rows, "id long, name string, type string")
    want = Counter((i, j, n) for i, n, t in rows for j, m, u in rows if None not in (i, j, n, t, u) and n == m and t != u and i < j)
    for side in (7, 1024):
        found = pairs.unlike(table, "name", "type", "id", side, 5_000)
        assert Counter(map(tuple, found.collect())) == want
    written = pairs.unlike(table, "name", "type", "id", 7, 5_000).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(written) == sum(want.values()) // 5_000 > 8 and max(r.n for r in written) < 7_500
    assert pairs.unlike(table.filter("id < -9"), "name", "type", "id").count() == 0
    query = registry.queries()["entity_name_duplicates"](spark, sf_dir)
    assert "Repartition" in query._jdf.queryExecution().optimizedPlan().toString()  # two tasks wrote all before

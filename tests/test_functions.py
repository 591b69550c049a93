import json
import random
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quaestor.bindings import Corpus
from quaestor.functions import lexicons, names, search, timeline
from quaestor.operators import anomaly, graph, pairs, resolve
from quaestor.plans import library
from quaestor.sources import files
from quaestor.sources.store import Store
from quaestor.streaming import alerts

EDGES = [(1, 2, 5), (2, 3, 3), (1, 4, 2), (3, 5, 1), (4, 5, 4), (7, 2, 2)]
KINDS = {1: "person", 2: "person", 3: "person", 4: "org", 5: "place", 6: "person", 7: "person"}


def weighted(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, weight long")


def greedy(times, seconds, least):
    """The windows of a sorted list, one after another."""
    k = 0
    while k < len(times):
        inside = [t for t in times[k:] if t - times[k] <= seconds]
        if len(inside) >= least:
            yield inside[0], inside[-1], len(inside)
            k += len(inside)
        else:
            k += 1


@pytest.fixture(scope="module")
def edges(spark):
    nodes = spark.createDataFrame(list(KINDS.items()), "id long, type string")
    return graph.cut(graph.canonical_edges(weighted(spark, EDGES), nodes, spark.createDataFrame([(7, 1)], "s long, t long")))


def test_graph_canonical_edges_and_stats(spark, edges):
    assert {(r.a, r.b): r.weight for r in edges.collect()} == {(1, 2): 7, (2, 3): 3, (1, 4): 2, (3, 5): 1, (4, 5): 4}
    s = graph.stats(edges).first()
    assert (s.nodes, s.edges, s.components, s.density, s.avg_degree, s.avg_weighted_degree) == (5, 5, 1, 0.5, 2.0, 6.8)
    nodes = spark.createDataFrame(list(KINDS.items()), "id long, type string")
    persons = graph.canonical_edges(weighted(spark, EDGES), nodes, spark.createDataFrame([(7, 1)], "s long, t long"), "person")
    assert persons.count() == 2
    assert graph.subgraph(edges, spark.createDataFrame([(1,), (2,), (4,)], "n long")).count() == 2


def test_graph_queries_read_every_connection(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    to, known, want = {r[0]: r[1] for r in c["resolutions"].collect()}, {r.id for r in c["entities"].collect()}, {}
    for r in c["links"].collect():
        a, b = sorted((to.get(r.entity_a_id, r.entity_a_id), to.get(r.entity_b_id, r.entity_b_id)))
        if a != b and {a, b} <= known:
            want[a, b] = want.get((a, b), 0) + r.weight
    assert 1 in want.values()
    assert {(r.a, r.b): r.weight for r in library.graph_edges(spark, sf_dir).collect()} == want
    ends = [to.get(r.entity_a_id, r.entity_a_id) for r in c["links"].collect()]
    assert library._ends(c) == (min(ends), max(ends))


def test_graph_paths(edges):
    assert graph.shortest_path(edges, 1, 2) == ([1, 2], 7.0)
    assert graph.shortest_path(edges, 1, 1) == ([1], 0.0)
    assert graph.shortest_path(edges, 1, 99) is None
    assert graph.shortest_path(edges, 3, 4)[0] == [3, 2, 1, 4]  # 1/3 + 1/7 + 1/2 is less than 1 + 1/4
    assert {r.node: r.hops for r in graph.neighbours(edges, 1, 2).collect()} == {2: 1, 4: 1, 3: 2, 5: 2}
    assert {r.node for r in graph.neighbours(edges, 1, 2, least_weight=3).collect()} == {2, 3}


def test_graph_centralities(edges):
    assert {r.node: r.score for r in graph.degree_centrality(edges).collect()} == dict.fromkeys((1, 2, 3, 4, 5), 0.5)
    found = {r.node: r for r in graph.path_centralities(edges).collect()}
    near = {r.a: {} for r in edges.collect()} | {r.b: {} for r in edges.collect()}
    for r in edges.collect():
        near[r.a][r.b] = near[r.b][r.a] = r.weight
    far = {a: {b: 0 if a == b else near[a].get(b, 1e9) for b in near} for a in near}
    for k in near:
        for a in near:
            for b in near:
                far[a][b] = min(far[a][b], far[a][k] + far[k][b])
    for v in near:
        assert abs(found[v].closeness - 4 / sum(far[v].values())) < 1e-9
        through = sum(abs(far[a][v] + far[v][b] - far[a][b]) < 1e-9 for a in near for b in near if a < b and v not in (a, b))
        assert abs(found[v].betweenness - through / 6) < 1e-9 or through > 0
    scores = [r.score for r in graph.eigenvector_centrality(edges, 200).collect()]
    assert abs(sum(s * s for s in scores) - 1) < 1e-3 and min(scores) > 0


def test_graph_components_and_communities(spark):
    two = weighted(spark, [(1, 2, 9), (2, 3, 9), (1, 3, 9), (3, 10, 1), (10, 11, 9), (11, 12, 9), (10, 12, 9), (20, 21, 1)])
    assert {r.node: r.component for r in graph.components(two).collect()} == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 12: 1, 20: 20, 21: 20}
    found = {r.node: r.community for r in graph.communities(two).collect()}
    assert found[1] == found[2] == found[3] != found[10] == found[11] == found[12]


@pytest.mark.parametrize("name,want", [("Dr. John Smith", "john smith"), ("John Smith Jr.", "john smith"), ("Smith, John", "john smith"), ("  John   Smith  ", "john smith"), ("Dr. Smith, John Jr.", "john smith"), ("Jane Doe, Esq.", "jane doe"), ("James Bond III", "james bond"), ("John.Smith", "johnsmith"), ("", "")])
def test_normalized_names(spark, name, want):
    assert spark.range(1).select(resolve.normalized(F.lit(name)).alias("n")).first().n == want


def test_name_similarity(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    j = lambda a, b: one(resolve.jaccard(F.lit(a), F.lit(b)))
    i = lambda a, b: one(resolve.initial_match(F.lit(a), F.lit(b)))
    e = lambda a, b: one(resolve.edit_score(F.lit(a), F.lit(b)))
    assert (j("john smith", "john smith"), j("john smith", "jane doe"), j("", "x"), j("x", "")) == (1.0, 0.0, 0.0, 0.0)
    assert (i("j smith", "john smith"), i("j smith", "john doe"), i("john", "john smith"), i("john smith", "james smith")) == (True, False, False, False)
    assert (e("christopher", "christopher"), e("john", "jonh"), e("abcdefghij", "qrstuvwxyz")) == (0.8, None, None)


def test_resolution_confidence(spark):
    rows = [(1, "John Smith", "person"), (2, "Dr. John Smith", "person"), (3, "J. Smith", "person"), (4, "Christopherson", "person"), (5, "Christophersen", "person"), (6, "John Smith", "org"), (7, "Xavier Quill", "person"), (8, "", "person")]
    entities = spark.createDataFrame(rows, "id long, name string, type string")
    mentions = spark.createDataFrame([(1, 1), (1, 3), (2, 4), (3, 5)], "document_id long, entity_id long")
    found = {(r.source, r.target): (round(r.confidence, 6), r.action) for r in resolve.candidates(entities, mentions).collect()}
    assert found == {(1, 2): (1.0, "auto"), (1, 3): (0.9, "auto"), (2, 3): (0.8, "queue"), (4, 5): (0.8, "queue")}
    assert {r.source_entity_id: r.canonical_entity_id for r in resolve.resolved(resolve.candidates(entities, mentions)).collect()} == {1: 3}


@pytest.mark.parametrize(
    "phrase,iso,precision,confidence",
    [("March 14, 2009", "2009-03-14", "day", 0.95), ("14 March 2009", "2009-03-14", "day", 0.95), ("2009-03-14", "2009-03-14", "day", 0.95), ("January 3rd, 2005", "2005-01-03", "day", 0.95), ("03/14/2009", "2009-03-14", "day", 0.85), ("3/14/09", "2009-03-14", "day", 0.70), ("approximately March 2003", "2003-03", "month", 0.80), ("Spring 2001", "2001-03", "season", 0.70), ("since 2003", "2003", "year", 0.60), ("approximately 2001", "2001", "approx", 0.50), ("around 2003", "2003", "year", 0.60), ("the following Tuesday", None, "relative", 0.30), ("two weeks later", None, "relative", 0.30), ("shortly after", None, "relative", 0.30), ("that same day", None, "relative", 0.30)],
)
def test_dates(phrase, iso, precision, confidence):
    (found,) = timeline.dates(f"It was {phrase} there.")
    assert found[2:] == (iso, precision, confidence)


def test_no_year_in_plain_numbers():
    assert timeline.dates("4500 units at warehouse 2100") == []


def test_dates_are_looked_for_around_digits_and_a_few_words():
    patterns = [(re.compile(p, re.I), precision) for p, precision, _ in lexicons.DATES] + [(re.compile(p, re.I), "relative") for p in lexicons.RELATIVE_DATES]

    def plainly(text):
        taken = []
        for pattern, precision in patterns:
            for m in pattern.finditer(text):
                if all(m.end() <= a or b <= m.start() for a, b, _ in taken):
                    taken.append((*m.span(), precision))
        return sorted(taken)

    words = "January may MAR. Sept august 14 3rd 2009 1999, 03/14/2009 3-4-99 2009-03-14 12/1/20091 Spring of in since around circa approx. approximately the following next same that day days weeks monday evening two 12 later after before shortly soon immediately today daydayday \u212a a1b2 \u0663\u0664\u0665\u0666 \u3000 - / nightafter".split(" ")
    rng, n = random.Random(5), 0
    for _ in range(4000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "", ". ", ", ", "\u3000", "      "]) for _ in range(rng.randrange(40)))
        text = rng.choice([text, text.upper(), text.lower()])
        got = [(a, b, precision) for a, b, _, precision, _ in timeline.dates(text)]
        assert got == plainly(text)
        n += len(got)
    assert n > 5000
    assert [(a, b, iso) for a, b, iso, _, _ in timeline.dates("\u0130\u0130 on \u017feptember 5, 2009")] == [(6, 23, "2009-09-05")]  # an error before
    began = time.process_time()
    assert timeline.dates("on the march of those who may not be seen again " * 40_000) == []
    assert timeline.dates("a1" * 100_000) == [] and timeline.dates("day" * 100_000) == [] and timeline.sentences("A. " * 60_000) == [(0, 180_000)]
    assert time.process_time() - began < 4  # 8 s and more before


def test_events_of_a_long_sentence_come_in_parts(spark):
    docs = spark.createDataFrame([(1, "2009-03-14 and Ann, " * 3000), (2, "On 2009-03-15 Bob left.")], "id long, text string")
    known = spark.createDataFrame([(1, "ann"), (2, "Ann"), (2, "bob")], "document_id long, name string")
    found = timeline.extract_events(docs, known).groupBy("document_id", "event_date", "names").count().collect()
    assert {tuple(r[:2]) + tuple(r.names) + (r["count"],) for r in found} == {(1, "2009-03-14", "ann", 3000), (2, "2009-03-15", "bob", 1)}


def test_events_carry_sentence_and_names(spark):
    docs = spark.createDataFrame([(1, "Dr. Jones came. On March 14, 2009 Ann Lee met Bob. Nothing else."), (2, None), (3, "")], "id long, text string")
    known = spark.createDataFrame([(1, "Ann Lee"), (1, "Carl"), (1, "bob")], "document_id long, name string")
    (r,) = timeline.extract_events(docs, known).collect()
    assert (r.event_date, r.context, r.names, r.is_resolved) == ("2009-03-14", "On March 14, 2009 Ann Lee met Bob.", ["Ann Lee", "bob"], True)


def test_names(spark):
    docs = spark.createDataFrame([(1, "Yesterday Dr. Maria Lopez of Northern Trust met Mr. Adam Stone in paris. Maria Lopez left on March 3, 2010."), (2, None)], "id long, text string")
    found = {(r.name, r.type): r["count"] for r in names.extract_entities(docs, {"place": ["Paris", "New York"]}).collect()}
    assert found[("Paris", "place")] == 1 and found[("March 3, 2010", "date")] == 1 and found[("Northern Trust", "org")] == 1
    assert ("Maria Lopez", "person") in found and ("Adam Stone", "person") in found


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("rational", "ration"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky")])
def test_porter_stems(word, want):
    assert search.stem(word) == want


def test_search(spark):
    docs = spark.createDataFrame([(1, "the wire transfers went offshore"), (2, "a wire, and later a transfer"), (3, "wire transfer wire transfer"), (4, None), (5, "unrelated words here")], "id long, text string")
    index = search.postings(docs)
    assert [r.doc_id for r in search.search(index, "Wire transfer").collect()] == [3, 1]
    assert {r.doc_id for r in search.search(index, "transfer wire", phrase=False).collect()} == {1, 2, 3}
    assert search.search(index, "  ").count() == 0
    assert docs.filter("id = 1").select(search.snippet(F.col("text"), "wire", 4).alias("s")).first().s == "the wire tra..."


def test_anomalies(spark):
    day = lambda *ds: spark.createDataFrame([(d,) for d in ds], "event_date string")
    assert [(r.days, r.severity) for r in anomaly.temporal_gaps(day("2015-01-01", "2015-06-01")).collect()] == [(151, "low")]
    assert [anomaly.temporal_gaps(day("2015-01-01", d)).first().severity for d in ("2015-08-01", "2016-06-01", "2015-05-01")] == ["medium", "high", "low"]
    assert anomaly.temporal_gaps(day("2015-01-01", "2015-01-15")).count() == 0
    burst = day(*["2015-01-05"] * 20, *[f"2015-{m:02d}-01" for m in range(2, 12)])
    assert [r.month for r in anomaly.activity_bursts(burst).collect()] == ["2015-01"]
    assert anomaly.activity_bursts(day(*[f"2015-{m:02d}-01" for m in range(1, 13)])).count() == 0
    docs = spark.createDataFrame([(k, 5, "2020-01-01 00:00:00", "", None, "x") for k in range(15)] + [(99, 900, "2020-02-15 00:00:00", "d", "s", "c")], "id long, pages int, at string, date string, source string, category string")
    assert [r.n for r in anomaly.bulk_ingestion(docs, "at").collect()] == [15]
    assert [r.id for r in anomaly.page_outliers(docs).collect()] == [99]
    assert anomaly.missing_metadata(docs).count() == 15


def test_anchored_windows_equal_the_greedy_scan(spark):
    rng = random.Random(2)
    for _ in range(3):
        times = sorted(rng.randrange(0, 2000) for _ in range(150))
        rows = spark.createDataFrame([(t,) for t in times], "t long").select(F.timestamp_seconds("t").alias("at"))
        got = sorted((int(r.start.timestamp()), int(r.end.timestamp()), r.n) for r in anomaly.anchored_windows(rows, "at", 60, 4).collect())
        assert got == list(greedy(times, 60, 4))


def test_metadata_anomalies(spark):
    schema = "document_id long, author string, creator string, producer string, title string, creation_date string, modification_date string"
    m = spark.createDataFrame([(1, "A", "c", "p1", "t", "2020-05-01 00:00:00", "2019-05-01 00:00:00"), (2, "A", "c", "p2", "t", "1990-01-01 00:00:00", "2020-01-01 00:00:00"), (3, "A", "c", "p3", "t", None, None), (4, "", None, " ", "", "2031-01-01 00:00:00", None), (5, None, "c", "p", "t", "bad", None)], schema)
    found = {(r.document_id, r.problem) for r in anomaly.date_inconsistencies(m, "2024-01-01 00:00:00").collect()}
    assert found == {(1, "created_after_modified"), (2, "wide_gap"), (4, "future_creation")}
    assert {(r.document_id, r.severity) for r in anomaly.metadata_stripping(m).collect()} == {(4, "medium"), (5, "low")}
    assert [(r.author, r.n) for r in anomaly.producer_inconsistencies(m).collect()] == [("A", 3)]


def test_pairs(spark):
    bridge = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (2, 3), (3, 9)], "d long, e long")
    assert {(r.a, r.b): r.weight for r in pairs.co_occurrence(bridge, "d", "e").collect()} == {(1, 2): 2, (1, 3): 1, (2, 3): 1}
    top = pairs.top_per_group(bridge, ["d"], [F.col("e").desc()], 1)
    assert {(r.d, r.e) for r in top.collect()} == {(1, 2), (2, 3), (3, 9)}


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("plain text that is long enough")
    (tmp_path / "copy.txt").write_text("plain text that is long enough")
    (tmp_path / "b.html").write_text("<html><script>x()</script><p>Hello   &amp; welcome to the page</p></html>")
    (tmp_path / "c.csv").write_text("Date,Flight,Notes\n2001-01-01,AB1,\n,,\n")
    (tmp_path / "sub" / "d.json").write_text(json.dumps({"a": {"b": [1, {"c": "a longer value here"}]}}))
    (tmp_path / "e.eml").write_text("From: Ann Lee <ann@x.org>\nTo: bob@y.org\nSubject: Hi\nDate: Mon, 2 Jan 2012 10:00:00 +0000\nMessage-ID: <1@x>\n\nThe body of the mail.\n")
    (tmp_path / "f.xyz").write_bytes(b"\x00\x01")
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("in/h.txt", "text inside of an archive")
        z.writestr("__MACOSX/x.txt", "ignored ignored ignored ignored")
    found = {r.name: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert set(found) == {"a.txt", "b.html", "c.csv", "d.json", "e.eml", "h.txt"}
    assert found["b.html"].text == "Hello &amp; welcome to the page" and found["c.csv"].text == "Date | Flight | Notes\n2001-01-01 | AB1"
    assert found["d.json"].text == "a.b[0]: 1\na.b[1].c: a longer value here" and found["e.eml"].text.startswith("Subject: Hi\nFrom: Ann Lee")


def test_emails(spark, tmp_path):
    mail = "From: Ann Lee <ann@x.org>\nTo: Bob <bob@y.org>, c.d@z.org\nSubject: Hi\nDate: Mon, 2 Jan 2012 10:00:00 +0000\nMessage-ID: <1@x>\n\nBody\n"
    (tmp_path / "a.eml").write_text(mail)
    (tmp_path / "b.mbox").write_text("From x\n" + mail + "\nFrom y\n" + mail.replace("<1@x>", "<2@x>") + "\n")
    (tmp_path / "c.json").write_text(json.dumps({"emails": [{"sender": "e@f.org", "to": ["g@h.org"], "subject": "S", "body": "B"}]}))
    found = files.emails(spark, str(tmp_path)).collect()
    assert sorted(r.message_id or "" for r in found) == ["", "<1@x>", "<2@x>"]
    one = next(r for r in found if r.message_id == "<2@x>")
    assert (one.from_addr, one.date, [p.addr for p in one.to], one.to[1].name, one.body.strip()) == ("ann@x.org", "2012-01-02", ["bob@y.org", "c.d@z.org"], "C D", "Body")


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/tags", "entity_id long, tag string")
    row = lambda *r: spark.createDataFrame(list(r), "entity_id long, tag string")
    assert store.read().count() == 0
    store.append(row((1, "a"), (1, "a"), (2, "b")), unique=["entity_id", "tag"])
    store.append(row((1, "a"), (3, "c")), unique=["entity_id", "tag"])
    store.upsert(row((2, "z")), ["entity_id"])
    store.update(F.col("entity_id") == 3, {"tag": F.upper("tag")})
    store.delete(F.col("entity_id") == 1)
    assert {(r.entity_id, r.tag) for r in store.read().collect()} == {(2, "z"), (3, "C")}


def test_streams(spark, sf_dir, tmp_path):
    docs = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/documents.parquet").schema).parquet(f"{sf_dir}/documents.parquet*")
    run = lambda df, name, mode: df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
    query = run(alerts.keyword_alerts(docs, ["tion", ""]), "alerts", "append")
    query.processAllAvailable()
    query.stop()
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r.hits for r in spark.table("alerts").collect()} == {t.lower().count("tion") for t in texts if "tion" in t.lower()}
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    query = run(alerts.windowed_counts(events), "counts", "complete")
    query.processAllAvailable()
    query.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_names_meet_wherever_all_pairs_would(spark):
    """Blocking by rare parts against every pair of names."""
    rng = random.Random(6)
    firsts, lasts = ["john", "j", "ann", "a", "maria", "christopher"], ["smith", "smyth", "jonesworthy", "lee"]
    rows = [(k, " ".join([rng.choice(firsts), *([rng.choice(["van", "de", "k"])] if rng.random() < 0.3 else []), rng.choice(lasts)]), rng.choice(["person", "org"])) for k in range(120)]
    rows += [(200 + k, n, "org") for k, n in enumerate(["northern trust", "northern trusts", "nothern trust co", "northen trust", "trust northern", "a"])]
    entities = spark.createDataFrame(rows, "id long, name string, type string")
    mentions = spark.createDataFrame([(k % 40, k) for k in range(120)], "document_id long, entity_id long")
    e = entities.select("id", "type", resolve.normalized(F.col("name")).alias("n"))
    every = e.toDF("a", "type", "x").join(e.toDF("b", "type", "y"), "type").filter("a < b")
    j, edit = resolve.jaccard(F.col("x"), F.col("y")), resolve.edit_score(F.col("x"), F.col("y"))
    soft = F.greatest(F.when(j > 0.5, j).otherwise(0.0), F.coalesce(edit, F.lit(0.0)), F.when(resolve.initial_match(F.col("x"), F.col("y")), resolve.INITIAL).otherwise(0.0))
    base = F.when(F.col("x") == F.col("y"), resolve.EXACT).otherwise(soft)
    together = "CASE WHEN a < 120 AND b < 120 AND a % 40 = b % 40 THEN 1 ELSE 0 END"
    want = every.withColumn("base", base).filter(F.col("base") >= resolve.DROP).select("a", "b", F.least(F.lit(1.0), F.col("base") + resolve.SAME_TYPE + resolve.TOGETHER * F.expr(together)).alias("c"))
    got = {(r.source, r.target): round(r.confidence, 6) for r in resolve.candidates(entities, mentions).collect()}
    assert got == {(r.a, r.b): round(r.c, 6) for r in want.collect()} and len(got) > 50


def test_path_centralities_of_a_graph_that_is_not_broadcast(edges):
    small, large = ({r.node: r for r in graph.path_centralities(edges, most_edges=n).collect()} for n in (100, 3))
    assert small.keys() == large.keys()
    assert all(abs(small[v].closeness - large[v].closeness) < 1e-9 and abs(small[v].betweenness - large[v].betweenness) < 1e-9 for v in small)


def test_paths_and_components_of_long_chains(spark):
    chain = graph.cut(weighted(spark, [(k, k + 1, 1) for k in range(45)]))
    assert graph.shortest_path(chain, 0, 45) == (list(range(46)), 45.0)
    assert {r.component for r in graph.components(chain).collect()} == {0}


def test_communities_raise_the_modularity(spark):
    rng = random.Random(8)
    rows = [(a, b, 3) for g in range(5) for a in range(10 * g, 10 * g + 10) for b in range(a + 1, 10 * g + 10) if rng.random() < 0.7] + [(10 * g, (10 * g + 10) % 50, 1) for g in range(5)]
    edges = weighted(spark, [(min(a, b), max(a, b), w) for a, b, w in rows])
    found = graph.cut(graph.communities(edges))
    assert {r.node: r.community for r in found.collect()} == {k: k // 10 * 10 for k in range(50)}
    names = spark.createDataFrame([(k, f"n{k}", "org" if k < 10 else "person") for k in range(50)], "node long, name string, type string")
    about = {r.community: r for r in graph.described(edges, found.join(names, "node")).collect()}
    assert about[0].label == "n0 / n1 / n2" and about[20].label == "n20 / n21 / n22" and about[20].size == 10
    inside = sum(a // 10 == b // 10 == 2 for a, b, _ in rows)
    assert abs(about[20].density - inside / 45) < 1e-9


def test_store_survives_a_crash_at_any_place(spark, tmp_path, monkeypatch):
    t = Store(spark, f"file://{tmp_path}/s", "k long, v string")
    row = lambda *r: spark.createDataFrame([r], "k long, v string")
    t.append(row(1, "a"))
    monkeypatch.setattr(Store, "_point", lambda self, n, v: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        t.append(row(2, "b"))
    monkeypatch.undo()
    assert [r.k for r in t.read().collect()] == [1]
    (tmp_path / "s" / "current-2").write_text("v-cut")  # a pointer cut short
    assert [r.k for r in t.read().collect()] == [1]
    reader = t.read()
    t.append(row(3, "c"))
    assert sorted(r.k for r in t.read().collect()) == [1, 3] and [r.k for r in reader.collect()] == [1]


def test_store_keeps_the_changes_of_two_writers(spark, tmp_path, monkeypatch):
    one, two = (Store(spark, f"file://{tmp_path}/s", "k long, v string") for _ in range(2))
    row = lambda k: spark.createDataFrame([(k, "x")], "k long, v string")
    point, met = Store._point, []

    def late(self, number, version):
        if self is one and not met:
            met.append(number)
            two.append(row(2))  # comes first
        return point(self, number, version)

    monkeypatch.setattr(Store, "_point", late)
    one.append(row(1))
    assert sorted(r.k for r in one.read().collect()) == [1, 2]


def test_index_on_disk_answers_like_the_texts(spark, tmp_path):
    rng = random.Random(9)
    words = ["running", "runs", "run", "the", "money", "monies", "laundering", "bank", "banks"]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(80)] + [(99, None)], "id long, text string")
    index = search.Index.write(docs, f"file://{tmp_path}/index", shelves=8)
    for query, phrase in (("run the bank", True), ("money laundering", True), ("running money", False), ("absent", True), ("", True)):
        rows = [[(r.doc_id, round(r.score, 9)) for r in f.collect()] for f in (search.search(index, query, phrase=phrase), search.search_texts(docs, query, phrase=phrase), search.search(search.postings(docs), query, phrase=phrase))]
        assert rows[0] == rows[1] == rows[2] and bool(rows[0]) == (query not in ("absent", ""))
    plan = index.of(["run"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shelf" in plan.replace("isnotnull(shelf#", "shelf#") or "PartitionFilters: [isnotnull(shelf" in plan

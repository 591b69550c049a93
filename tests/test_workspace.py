import json

import pytest

from quaestor.operators.workspace import Workspace, merge_entities
from quaestor.sources import reports


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(1, "First", "alpha ALPHA beta"), (2, "Second", "beta"), (3, "Third", None)], "id long, title string, text string")
    entities = spark.createDataFrame([(5, "Ann", "person"), (6, "Bob", "person"), (7, "Corp", "org")], "id long, name string, type string")
    mentions = spark.createDataFrame([(1, 5, 3), (1, 6, 1), (2, 5, 2), (2, 7, 9)], "document_id long, entity_id long, count long")
    links = spark.createDataFrame([(5, 6, 1), (5, 7, 1), (6, 7, 4)], "entity_a_id long, entity_b_id long, weight long")
    return docs, entities, mentions, links


def test_notes_tags_and_lists(spark, corpus, tmp_path):
    docs, entities, mentions, _ = corpus
    w = Workspace(spark, f"file://{tmp_path}/w")
    first = w.add("annotations", document_id=1, start_offset=0, end_offset=5, text="alpha", note="see")
    w.change("annotations", first, note="seen")
    assert w.table("annotations").first().note == "seen"
    w.remove("annotations", first)
    assert w.table("annotations").count() == 0
    w.tag(5, " Key ")
    w.tag(5, "key")
    assert [r.tag for r in w.table("entity_tags").collect()] == ["key"]
    assert w.tag_type(entities, mentions, "person", "key", 1) == 1
    w.add("watchlist", replace=True, entity_id=5, notes="a")
    w.add("watchlist", replace=True, entity_id=5, notes="b")
    (row,) = w.watched(entities, mentions).collect()
    assert (row.name, row.notes, row.docs, row.mentions) == ("Ann", "b", 2, 5)
    with pytest.raises(ValueError):
        w.rate_source("s", "Z")
    w.rate_source("s", "A")
    w.rate_source("s", "B")
    assert [(r.source, r.rating) for r in w.table("source_ratings").collect()] == [("s", "B")]
    w.add("keyword_alerts", keyword="alpha")
    assert [(r.id, r.hits) for r in w.alerts(docs).collect()] == [(1, 2)]
    assert w.remember_search("x", 1, "t") is None
    w.remember_search("find", 3, "2020-01-01")
    w.remember_search("find", 5, "2021-01-01")
    assert [(r.query, r.n, r.result_count) for r in w.searches().collect()] == [("find", 2, 5)]
    assert w.table("audit").count() > 5


def test_chains_cases_and_redactions(spark, corpus, tmp_path):
    docs, entities, *_ = corpus
    w = Workspace(spark, f"file://{tmp_path}/w")
    chain = w.add("evidence_chains", name="c")
    w.add_link(chain, "document", 2)
    w.add_link(chain, "entity", 5, "then")
    assert [(r.position, r.label) for r in w.chain(chain, docs, entities).collect()] == [(1, "Second"), (2, "Ann")]
    assert w.chains().first().links == 2
    case = w.add("case_files", name="k", status="open")
    w.add_case_item(case, "document", 1)
    w.add_case_item(case, "document", 1)
    w.add_case_item(case, "chain", chain)
    with pytest.raises(ValueError):
        w.add_case_item(case, "pizza", 1)
    row = w.cases().first()
    assert (row.document, row.entity, row.chain) == (1, 0, 1)
    w.add("redactions", document_id=1, start_offset=0, end_offset=5)
    w.add("redactions", document_id=1, start_offset=3, end_offset=8)
    w.add("redactions", document_id=1, start_offset=12, end_offset=99)
    assert w.redacted_text(docs).first().text == "[REDACTED]PHA [REDACTED]"
    shot = w.snapshot("s", "t", documents=3)
    assert json.loads(w.table("snapshots").filter(f"id = {shot}").first().data)["watchlist"] == []
    w.dismiss(9, 4)
    w.dismiss(4, 9)
    assert [(r.doc_a, r.doc_b) for r in w.table("dismissals").collect()] == [(4, 9)]
    queued = w.add("resolution_queue", source_entity_id=5, target_entity_id=6, confidence=0.8)
    w.review(queued, True)
    assert [(r.source_entity_id, r.canonical_entity_id) for r in w.table("resolutions").collect()] == [(5, 6)] and w.table("resolution_queue").count() == 0
    w.split(5, 6)
    assert w.table("resolutions").count() == 0
    w.remove_chain(chain)
    w.remove_case(case)
    assert w.table("evidence_links").count() == w.table("case_items").count() == 0


def test_merge_sums_counts_and_weights(corpus):
    _, entities, mentions, links = corpus
    e, m, g = merge_entities(entities, mentions, links, 5, 6)
    assert {r.id for r in e.collect()} == {6, 7}
    assert {(r.document_id, r.entity_id): r["count"] for r in m.collect()} == {(1, 6): 4, (2, 6): 2, (2, 7): 9}
    assert {(r.entity_a_id, r.entity_b_id): r.weight for r in g.collect()} == {(6, 7): 5}


def test_reports(spark, corpus, tmp_path):
    docs, entities, _, links = corpus
    text = reports.markdown("Brief", [("Documents", docs)], most=2)
    assert "| 1 | First | alpha ALPHA beta |" in text and "The first 2 rows." in text
    assert "&lt;b&gt;" in reports.page("<b>", [("x", entities)])
    reports.write_graph(entities.filter("id < 7"), links, f"file://{tmp_path}/g")
    assert spark.read.json(f"file://{tmp_path}/g/edges").count() == 1
    reports.write_csv(docs, f"file://{tmp_path}/c")
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/c").count() == 3

"""Classes, the mapping made of them and the index of names against the pairs written out."""

import random

import pytest
from pyspark.sql import functions as F

from quaestor.operators import resolve


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(12)
    first, last = ["John", "Johan", "Maria", "M.", "J.", "Anna"], ["Smithson", "Smithsen", "Lopez Garcia", "Field", "Fielding"]
    names = [f"{rng.choice(['', 'Dr. ', 'Mr '])}{rng.choice(first)} {rng.choice(last)}{rng.choice(['', ' Jr.', ''])}" for _ in range(120)] + ["Smithson, John", "", "  ", "X", "Lopez Garcia Maria Anna", "INTERNATIONAL HOLDINGS", "International Holding"]
    rows = [(k * 3 % 401, n, rng.choice(["person", "person", "org"])) for k, n in enumerate(names, 1)]
    entities = spark.createDataFrame(rows, "id long, name string, type string").cache()
    mentions = spark.createDataFrame([(rng.randrange(25), i, 1) for i, _, _ in rows for _ in range(2)], "document_id long, entity_id long, count long").cache()
    return entities, mentions


def test_mapping_from_classes_equals_that_from_pairs(people):
    entities, mentions = people
    found = resolve.candidates(entities, mentions).cache()
    want = sorted(tuple(r) for r in resolve.resolved(found).collect())
    assert sorted(tuple(r) for r in resolve.mapping(entities, mentions).collect()) == want and want
    assert {r.action for r in found.collect()} == {"auto", "queue"}


def test_classes_and_links_write_out_to_the_pairs(people):
    entities, mentions = people
    members, links = resolve.membership(entities), resolve.class_links(entities)
    across = links.join(members.toDF("x", "a"), "a").join(members.toDF("y", "b"), "b").select(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"))
    inside = members.toDF("source", "c").join(members.toDF("target", "c"), "c").filter("source < target").select("source", "target")
    pairs = resolve.candidates(entities, mentions).select("source", "target")
    assert sorted(map(tuple, across.unionAll(inside).collect())) == sorted(map(tuple, pairs.collect()))


def test_output_follows_the_entities_where_all_have_one_name(spark):
    entities = spark.range(3000).select("id", F.expr("IF(id % 2 = 0, 'Dr. Ann Marsh', 'ann marsh')").alias("name"), F.lit("person").alias("type"))
    mentions = spark.createDataFrame([], "document_id long, entity_id long, count long")
    (one,) = resolve.classes(entities).collect()
    assert (one.class_id, one.n, one["size"], one.last) == (0, "ann marsh", 3000, 2999)
    assert resolve.membership(entities).count() == 3000 and resolve.class_links(entities).count() == 0
    assert resolve.mapping(entities, mentions).filter("canonical_entity_id = 2999").count() == 2999


def test_an_index_of_names_finds_what_all_pairs_hold(spark, people, tmp_path):
    entities, mentions = people
    early, late = entities.filter("id % 3 <> 0"), entities.filter("id % 3 = 0")
    index = resolve.NameIndex.write(early, f"file://{tmp_path}/names")
    every = {tuple(r) for r in resolve.candidates(entities, mentions).collect()}
    known = {r.id for r in early.collect()}
    arrived = {tuple(r) for r in index.matches(late, mentions).collect()}  # a batch that is not filed yet
    assert arrived == {r for r in every if r[0] not in known or r[1] not in known} and arrived
    index.add(late)
    index.add(late)  # twice changes nothing
    for k in (3, 6, 300):
        own = {tuple(r) for r in index.matches(entities.filter(F.col("id") == k), mentions).collect()}
        assert own == {r for r in every if k in r[:2]}
    stranger = spark.createDataFrame([(9000, "Jon Smithson", "person"), (9001, None, "person")], "id long, name string, type string")
    both = entities.unionAll(stranger)
    assert {tuple(r) for r in index.matches(stranger, mentions).collect()} == {tuple(r) for r in resolve.candidates(both, mentions).filter("target >= 9000").collect()}

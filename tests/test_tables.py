"""Table functions in SQL, and differences of JSON snapshots."""

import time

from quaestor.functions import tables, timeline
from quaestor.operators import snapshots


def test_table_functions(spark, tmp_path):
    tables.register(spark)
    text = "On March 14, 2009 and 2010-02-03 they met; two weeks later in 2011."
    mail = b"From: Ann Lee <ann@x.org>\nSubject: one\nMessage-ID: <1>\nDate: Mon, 5 Feb 2007 10:00:00 +0000\n\nbody"
    spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string").createOrReplaceTempView("t_docs")
    got = sorted(tuple(r) for r in spark.sql("SELECT id, d.* FROM t_docs, LATERAL dates(text) d").collect())
    assert got == sorted((1, *x) for x in timeline.dates(text)) and len(got) == 4
    spark.createDataFrame([("a/m.eml", mail), ("b.eml", None), ("c.txt", b"just text")], "path string, content binary").createOrReplaceTempView("t_files")
    got = [tuple(r) for r in spark.sql("SELECT path, m.subject, m.from_addr, m.date FROM t_files, LATERAL mails(path, content) m WHERE path LIKE '%.eml'").collect()]
    assert got == [("a/m.eml", "one", "ann@x.org", "2007-02-05")]
    assert [tuple(r) for r in spark.sql("SELECT m.name, m.method, m.text FROM t_files, LATERAL members(path, content) m WHERE path = 'c.txt'").collect()] == [("c.txt", "text", "just text")]
    box = "From a Mon\nSubject: one\nFrom: x@y.z\n\nhello\n>From here\n\nFrom b Tue\nSubject: two\n\nbye".split("\n")
    lines = [(p, k, line) for p in ("p", "q") for k, line in enumerate(box if p == "p" else box[7:])]
    spark.createDataFrame(lines, "path string, number int, line string").createOrReplaceTempView("t_lines")
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM mailbox(TABLE(SELECT * FROM t_lines) PARTITION BY path ORDER BY number)").collect())
    assert [(p, n, s, a, b.strip()) for p, n, s, a, b in got] == [("p", 1, "one", "x@y.z", "hello\nFrom here"), ("p", 2, "two", None, "bye"), ("q", 1, "two", None, "bye")]


def test_many_dates_in_one_text_take_linear_time():
    start = time.time()
    assert len(timeline.dates("2009-03-14 " * 100_000)) == 100_000
    assert time.time() - start < 20


def test_differences_of_snapshots(spark):
    schema = "id long, json string"
    before = spark.createDataFrame([(1, '{"a": 1, "b": {"c": [1, 2, {"d": null}]}, "e": {}}'), (2, '{"x": "y"}'), (3, "no json"), (4, None), (5, '[]')], schema)
    after = spark.createDataFrame([(1, '{"a": 1.5, "b": {"c": [1, 3]}, "e": {}, "f": "new"}'), (2, '{"x": "y"}'), (3, "no json {"), (5, '[{}]'), (6, "7")], schema)
    got = {(r.key, r.path): (r.change, r.before, r.after) for r in snapshots.difference(before, after).collect()}
    assert got == {
        (1, "$.a"): ("changed", "1", "1.5"), (1, "$.b.c[1]"): ("changed", "2", "3"), (1, "$.b.c[2].d"): ("removed", "null", None), (1, "$.f"): ("added", None, '"new"'),
        (3, "$"): ("changed", '"no json"', '"no json {"'), (5, "$"): ("removed", "[]", None), (5, "$[0]"): ("added", None, "{}"), (6, "$"): ("added", None, "7"),
    }

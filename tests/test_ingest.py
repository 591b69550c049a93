"""Files, mails and PDF files, and the way from files to the answers of routes."""

import email
import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quaestor import api
from quaestor.bindings import Corpus
from quaestor.functions import phrases
from quaestor.operators import ingest
from quaestor.sources import files, pdf
from quaestor.streaming import alerts


def pdf_file(*pages, info=b"", packed=True, trailer=b""):
    """A small PDF file; each page's content stream as given."""
    out = [b"%%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Count %d >>\nendobj\n" % len(pages)]
    for k, content in enumerate(pages):
        data = zlib.compress(content) if packed else content
        out.append(b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>\nendobj\n" % (10 + 2 * k, 11 + 2 * k))
        out.append(b"%d 0 obj\n<< /Length %d%s >>\nstream\n%s\nendstream\nendobj\n" % (11 + 2 * k, len(data), b" /Filter /FlateDecode" if packed else b"", data))
    out.append(b"5 0 obj\n<< %s >>\nendobj\ntrailer\n<< /Root 1 0 R /Info 5 0 R %s >>\nstartxref\n0\n%%%%EOF" % (info, trailer))
    return b"".join(out)


PAGE = rb"BT /F1 12 Tf 72 700 Td (Wire \(secret\) transfer) Tj 0 -14 Td [(to the off) 20 (shore) -300 (holding)] TJ T* <436166E9> Tj ET"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_text_and_metadata(packed):
    found = pdf.read(pdf_file(PAGE, b"BT (Second page) Tj ET", info=b"/Title (A \\050b\\051) /Author <FEFF00C9006C> /CreationDate (D:20090314120530Z)", packed=packed))
    assert (found.pages, found.encrypted) == (2, False)
    assert found.text == "Wire (secret) transfer\nto the offshore holding\nCafé\nSecond page"
    assert found.info == {"Title": "A (b)", "Author": "Él", "CreationDate": "D:20090314120530Z"}
    assert pdf.read(pdf_file(PAGE, trailer=b"/Encrypt 9 0 R")).encrypted
    assert pdf.read(b"no such file") is None


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_no_file_stops_a_job():
    deep = b"x" * 30
    for _ in range(8):
        deep = zipped({"inner.zip": deep})
    assert files.text_of("a.zip", deep) == [("inner.zip", "too_deep", 0, "")]
    broken = {"a.docx": b"PK\x03\x04bad", "b.pdf": b"%PDF-1.4 \x00", "c.json": b"\xff{", "d.zip": b"PK", "e.xlsx": zipped({"xl/worksheets/sheet1.xml": "<row"}), "f.png": b"\x89PNG", "g.eml": b"\xff\xfe"}
    for name, content in broken.items():
        assert len(files.text_of(name, content)) == 1
        assert isinstance(files.mails_of(name, content), list)
    assert files.mails_of("a.json", b'[1, "x", {"subject": "s", "body": "b"}]')[0][2] == "s" and files.mails_of("a.json", b"not json") == []
    wide = files.text_of("w.csv", b"a," + b"y" * 300_000 + b"\n1,2\n", files.Limits(csv_rows=1))
    assert wide[0][1] == "csv cut" and len(wide[0][3]) > 300_000
    assert files.text_of("l.json", json.dumps({"a": list(range(5))}).encode(), files.Limits(list_items=2))[0][1:] == ("json cut", 1, "a[0]: 0\na[1]: 1")


def test_office_files_have_their_entities_and_cells():
    word = '<w:document xmlns:w="w"><w:p><w:r><w:t>Smith &amp; Sons</w:t></w:r></w:p><w:p><w:t>second</w:t></w:p></w:document>'
    assert files.text_of("a.docx", zipped({"word/document.xml": word})) == [("a.docx", "docx", 1, "Smith & Sons\nsecond")]
    sheet = '<worksheet><sheetData><row><c t="s"><v>1</v></c><c><v>42</v></c></row><row><c t="inlineStr"><is><t>in &lt;line</t></is></c></row></sheetData></worksheet>'
    book = zipped({"xl/sharedStrings.xml": "<sst><si><t>zero</t></si><si><t>o</t><t>ne</t></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    assert files.text_of("a.xlsx", book) == [("a.xlsx", "xlsx", 1, "one | 42\nin <line")]


def test_mail_forms():
    box = b"From a@b Mon\nSubject: one\nFrom: Ann Lee <ann@x.org>\n\nbody\n>From the start\n\nFrom c@d Tue\nSubject: two\n\nother\n"
    assert [m["Subject"] for m in files.mbox_messages(box)] == ["one", "two"]
    rows = files.text_of("m.mbox", box)
    assert len(rows) == 2 and rows[0][3].startswith("Subject: one\nFrom: Ann Lee <ann@x.org>") and "\nFrom the start" in rows[0][3]
    page = '<a href="/emailid/77"></a><td>Subject</td><td>Hi &amp; bye</td><td> From </td><td>bob.stone@x.org</td><pre>The  body</pre>'
    (r,) = files.mails_of("p.html", page.encode())
    assert r[1:5] == ("77", "Hi & bye", "Bob Stone", "bob.stone@x.org") and r[8].strip() == "The body"
    assert [files.guessed_subject(t) for t in ("x\nSubject: the one\n", "Re: again\nmore", "abc\nA fitting line\n", "")] == ["the one", "Re: again", "A fitting line", "Untitled Email"]
    assert files.mails_of("t.txt", b"Subject: s\nFrom: a@b.c\n\nhello")[0][2] == "s"
    assert len(files.mails_of("t.txt", b"From a\nSubject: s\n\nx\nFrom b\nSubject: t\n\ny")) == 2
    assert files.mails_of("t.txt", b"Just some words here\nand more")[0][2] == "Just some words here"


@pytest.mark.parametrize("name,want", [("../../etc/passwd", "passwd"), ("..hidden.txt", "hidden.txt"), ("a b&c.pdf", "a_b_c.pdf"), ("C:\\x\\y.eml", "y.eml"), ("", "upload"), ("???.txt", "upload.txt")])
def test_safe_names(name, want):
    assert ingest.safe_name(name) == want


def test_folders_outside_are_refused(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "link").symlink_to("/etc")
    assert ingest.inside(str(tmp_path / "in"), [str(tmp_path)]) == str(tmp_path / "in")
    for bad in (str(tmp_path / "link"), str(tmp_path / "in" / ".." / ".."), str(tmp_path) + "x"):
        with pytest.raises(PermissionError):
            ingest.inside(bad, [str(tmp_path)])


def put(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.txt").write_text(text)


LETTER = "A letter about the holding\nDear client, split the payment and keep it under the limit: $9,500 by wire transfer to the offshore holding company. On March 14, 2009 Dr. Maria Lopez met Mr. Adam Stone in Paris. Keep this quiet."
REPORT = "The second report of all\nMr. Adam Stone and Dr. Maria Lopez left on March 20, 2009. The wire transfer to the offshore holding company was made; the wire transfer to the offshore holding company was large."


def test_files_become_a_corpus_that_routes_answer_from(spark, tmp_path):
    put(tmp_path / "in", a=LETTER, b=REPORT, c=LETTER)
    (tmp_path / "in" / "p.pdf").write_bytes(pdf_file(b"BT (" + b"Plain words of a file. " * 4 + b") Tj ET", info=b"/Author (Ann) /CreationDate (D:20090314)"))
    out = f"file://{tmp_path}/out"
    assert ingest.ingest(spark, f"file://{tmp_path}/in", out, batch="one", at="2024-05-01 09", gazetteers={"place": ["Paris"]}) == 3
    assert ingest.ingest(spark, f"file://{tmp_path}/in", out, batch="one", at="2024-05-01 09", gazetteers={"place": ["Paris"]}) == 3  # again: the same
    put(tmp_path / "more", d=LETTER, e="Nothing to see, only some quiet words that hold no name and no date at all, none.")
    assert ingest.ingest(spark, f"file://{tmp_path}/more", out, batch="two", at="2024-05-02 10") == 1
    c = ingest.corpus(spark, out)
    assert {(r.title, r.date) for r in api.list_documents(c).collect()} >= {("A letter about the holding", "2009-03-14"), ("The second report of all", "2009-03-20")}
    assert c["docs"].count() == c["texts"].count() == 4
    (stone,) = api.search_entities(c, "adam stone").collect()
    assert stone.doc_count == 2 and {r.event_date for r in api.entity_timeline(c, stone.id)["events"].collect()} == {"2009-03-14", "2009-03-20"}
    assert [r.shared for r in api.entity_partners(c, stone.id, 1).collect()] == [2]
    letter = api.search_documents(c, "split the payment").first()
    assert letter.title == "A letter about the holding" and "split the payment" in letter.excerpt
    assert {r.label for r in api.document_forensics(c, letter.id).filter("analysis_type = 'aml_flag'").collect()} >= {"structuring"}
    risky = api.advanced_search(c, min_risk=20, limit=None).collect()
    assert [r.id for r in risky] and all(r.id != 0 for r in risky)
    assert [(r.author, r.creation_date[:10]) for r in c["pdf_metadata"].collect()] == [("Ann", "2009-03-14")]
    assert c["phrases"].filter("phrase = 'wire transfer to the offshore'").count() == 1
    path = api.graph_path(c, "Maria Lopez", "adam stone")
    assert [r.name for r in path["path"].collect()] == ["Maria Lopez", "Adam Stone"] and path["documents"].count() == 2


def test_streamed_files_are_read_once(spark, tmp_path):
    put(tmp_path / "in", a=LETTER)
    start = lambda: ingest.streaming_ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/at", lambda: "2024-05-01 09").trigger(availableNow=True).start().awaitTermination()
    start()
    put(tmp_path / "in", b=REPORT, c=LETTER)
    start()
    start()
    assert sorted(r.title for r in ingest.corpus(spark, f"file://{tmp_path}/out")["docs"].collect()) == ["A letter about the holding", "The second report of all"]


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    times = [0, 5, 10, 100, 400, 405, 406, 407, 900, 2000]
    for k, part in enumerate((times[:4], times[4:])):
        spark.createDataFrame([("x", t) for t in part], "key string, t long").select("key", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    rows = spark.readStream.schema("key string, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = alerts.anchored_windows(rows, seconds=60, least=3)
    found.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((int(r.start.timestamp()), int(r.end.timestamp()), r.n) for r in spark.table("windows").collect())
    assert got == [(0, 10, 3), (400, 407, 4)]


def test_titles(spark):
    cases = [("\n\nA Proper Title Line\nmore", "x.txt", "A Proper Title Line"), ("page 1 of the thing\n# heading here\nshort\nThe real title", "x.txt", "The real title"), ("x" * 90, "my_file-name2b.final.pdf", "My File Name2B.Final"), ("", "", "Untitled"), (None, None, "Untitled")]
    rows = spark.createDataFrame([(k, t, f) for k, (t, f, _) in enumerate(cases)], "k int, t string, f string")
    got = {r.k: r.x for r in rows.select("k", phrases.title(F.col("t"), F.col("f")).alias("x")).collect()}
    assert got == {k: w for k, (_, _, w) in enumerate(cases)}


def test_keywords_phrases_and_codewords(spark):
    text = 'The bank wired money. Bank money! The bank wired "Pizza" and "the" and "ice cream" 3abc été bank'
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    got = [(r.word, r["count"]) for r in phrases.keywords(docs, 6).orderBy("rank").collect()]
    assert got == [("bank", 4), ("wired", 2), ("money", 2), ("bank wired", 2), ("money bank", 2), ("pizza", 1)]
    runs = spark.createDataFrame([(1, "large sums of cash moved; large sums of cash moved. to the of to the of")], "id long, text string")
    assert {(r.phrase, r["count"]) for r in phrases.repeated_phrases(runs).collect()} == {(p, 2) for p in ("large sums of", "sums of cash", "of cash moved", "large sums of cash", "sums of cash moved", "large sums of cash moved", "cash moved large")} - {("cash moved large", 2)}
    found = {r.word: (r["count"], r.note) for r in phrases.codewords(docs).collect()}
    assert found["pizza"] == (1, "potential codeword") and found['"pizza"'] == (1, "quoted ordinary word") and '"the"' not in found and '"ice cream"' in found


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "0123456789"), (2, "abc"), (3, "kept")], "id long, text string")
    spans = spark.createDataFrame([(1, 2, 4), (1, 3, 6), (1, 8, 99), (2, 5, 9)], "document_id long, start_offset long, end_offset long")
    assert {r.id: (r.text, r.n) for r in phrases.redacted(docs, spans).collect()} == {1: ("01[REDACTED]67[REDACTED]", 3), 2: ("abc[REDACTED]", 1)}


def test_routes_refuse_what_they_do_not_take(spark):
    c = Corpus.of(spark, {})
    assert api.call(c, "list_documents", category="x").count() == 0 and api.call(c, "resolve_alias", name="x").count() == 0
    assert api.graph_path(c, 1, 2) is None and api.compare_documents(c, 1, 2)["stats"].first().jaccard == 0
    for route, arguments in (("nothing", {}), ("list_documents", {"wrong": 1}), ("graph_centrality", {"metric": "fame"})):
        with pytest.raises(ValueError):
            api.call(c, route, **arguments)
    with pytest.raises(ValueError):
        Corpus.of(spark, {"other": c["docs"]})


def test_command_line_over_an_ingested_corpus(spark, tmp_path, capsys):
    from quaestor.__main__ import main

    put(tmp_path / "in", a=LETTER, b=REPORT)
    out = f"file://{tmp_path}/out"
    assert main(["ingest", f"file://{tmp_path}/in", "--to", out, "--batch", "one"]) == 0
    assert "2 new documents" in capsys.readouterr().out
    for words, want in ((["search", "split the payment"], "A letter about"), (["entities", "person", "limit=5"], "Adam Stone"), (["timeline", "lopez", "start=2009-03-15"], "2009-03-20"), (["graph", "degree", "type=person"], "Maria Lopez"), (["stats"], "entities"), (["ask", "search_entities", "q=stone"], "Adam Stone")):
        assert main([*words, "--corpus", out]) == 0
        assert want in capsys.readouterr().out
    assert main(["ask", "nothing", "--corpus", out]) == 2 and "no route" in capsys.readouterr().err
    assert main(["routes"]) == 0 and "list_documents(category" in capsys.readouterr().out
    stone = api.search_entities(ingest.corpus(spark, out), "adam stone").first().id
    assert main(["report", str(stone), "--to", f"{tmp_path}/d.html", "--corpus", out]) == 0
    page = (tmp_path / "d.html").read_text()
    assert "Report: Adam Stone (person)" in page and "The second report of all" in page and "Maria Lopez" in page


def test_assistant_is_given_the_right_texts(spark, tmp_path):
    from quaestor.operators import assistant

    put(tmp_path / "in", a=LETTER, b=REPORT)
    ingest.ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", batch="one", at="2024-05-01 09")
    c = ingest.corpus(spark, f"file://{tmp_path}/out")
    (letter,) = api.search_documents(c, "split the payment").collect()
    seen = []
    answer = assistant.summarize(c, letter.id, lambda p, n: seen.append((p, n)) or " done ")
    assert answer == "done" and "A letter about the holding" in seen[0][0] and "split the payment" in seen[0][0]
    _, ids = assistant.ask(c, "offshore limit", lambda p, n: seen.append((p, n)) or "x")
    assert ids == [letter.id] and "[1]" in seen[1][0] and "offshore" in seen[1][0]
    with pytest.raises(LookupError):
        assistant.summary_prompt(c, 1)


def test_lobbying_records_become_documents(spark, tmp_path):
    from quaestor.sources import lobbying

    rows = [("Group Inc.", None, "59", None, ["A B", "C D"], ["Shop"], [("Bank of X", "X", "2016", None, "sanctions"), (None, "Y", None, None, None)]), ("Other", "active", None, "n", None, None, None), (None, "x", None, None, None, None, None)]
    frame = spark.createDataFrame(rows, lobbying.REGISTRANT)
    found = {r.filename: r.text for r in lobbying.documents(frame).collect()}
    assert set(found) == {"registrant_group_inc.txt", "registrant_other.txt", "filing_group_inc_bank_of_x.txt"}
    assert "Status: unknown\nRegistration: 59\nPrincipals: A B, C D" in found["registrant_group_inc.txt"] and "- Bank of X; X; 2016; sanctions" in found["registrant_group_inc.txt"] and found["registrant_group_inc.txt"].endswith("Domestic clients:\n- Shop")
    assert found["filing_group_inc_bank_of_x.txt"].split("\n")[2:] == ["Foreign principal: Bank of X", "Country: X", "Period: 2016", "Details: sanctions"]
    assert ingest.write_batch(ingest.tables(lobbying.as_files(frame), "2024-01-01 00"), f"file://{tmp_path}/out", "lobby") == 3


def test_uploaded_files_and_bulk_tags(spark, tmp_path):
    from quaestor.operators.workspace import bulk_tag

    put = lambda: ingest.upload(spark, "../../a b.txt", LETTER.encode(), f"file://{tmp_path}/up", f"file://{tmp_path}/out", at="2024-05-01 09")
    assert put() == 1 and put() == 1  # the same file replaces its batch
    docs = ingest.corpus(spark, f"file://{tmp_path}/out")["docs"]
    (d,) = docs.collect()
    assert d.filename == "a_b.txt" and [p.name for p in (tmp_path / "up").rglob("*.txt")] == ["a_b.txt"]
    once, n = bulk_tag(docs, [d.id, 5], "seen", "legal")
    twice, m = bulk_tag(once, [d.id], "seen")
    assert (n, m) == (2, 0) and [(r.notes, r.category) for r in twice.collect()] == [("[tag:seen]", "legal")]
    with pytest.raises(ValueError):
        bulk_tag(docs, [d.id])


def test_parts_of_known_names_are_no_persons(spark):
    from quaestor.functions import names

    assert [names.capitalised(n) for n in ("palm beach pd", "u.s. attorney", "fbi", "John Mc", "usvi")] == ["Palm Beach PD", "U.S. Attorney", "FBI", "John Mc", "USVI"]
    docs = spark.createDataFrame([(1, "Then Mr. Luc Brunel came with Jean-Luc Brunel. Mr. Other Man left the fbi.")], "id long, text string")
    got = {(r.name, r.type) for r in names.extract_entities(docs, {"person": ["jean-luc brunel"], "org": ["fbi"]}).collect()}
    assert ("Jean-Luc Brunel", "person") in got and ("Other Man", "person") in got and ("FBI", "org") in got and ("Luc Brunel", "person") not in got


def by_hand(folder, spark):
    """The same corpus without anything kept: pairs by a self-join of all mentions, and an index written anew."""
    from quaestor.functions import fulltext
    from quaestor.operators.pairs import co_occurrence

    c = ingest.corpus(spark, folder)
    pairs = {tuple(r) for r in co_occurrence(c["mentions"], "document_id", "entity_id").collect()}
    documents = c["docs"].join(c["texts"].select("id", "text"), "id")
    return c, pairs, documents, fulltext


def same_search(c, documents, fulltext, where):
    fresh = fulltext.indexed(documents, where)
    assert (c.index.docs, c.index.words) == (fresh.docs, fresh.words)
    for query, phrase in (("wire transfer", True), ("transfer maria", False), ("report", True), ("the offshore holding", True), ("Press", True), ("absent words", True)):
        rows = [[(r.doc_id, round(r.score, 9)) for r in fulltext.search(x, query, phrase=phrase).collect()] for x in (c.index, fresh)]
        assert rows[0] == rows[1]


def test_connections_and_index_follow_batches_replacements_removals_and_rewrites(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    people = ["Maria Lopez", "Adam Stone", "John Field", "Ann Marsh", "Eva Brook"]

    def batch(k, n, name):
        texts = {f"t{k}x{j}": f"Press item {k} of {j}. Dr. {people[(k + j) % 5]} met Mr. {people[(k * j + 1) % 5]} about the wire transfer to the offshore holding number {k}{j}." for j in range(n)}
        put(tmp_path / f"in{name}{k}", **texts)
        return ingest.ingest(spark, f"file://{tmp_path}/in{name}{k}", out, batch=f"b{k}", at="2024-05-01 09")

    assert [batch(k, 2, "a") for k in range(3)] == [2, 2, 2]
    c, pairs, documents, fulltext = by_hand(out, spark)
    assert {tuple(r) for r in c["links"].collect()} == pairs and pairs
    same_search(c, documents, fulltext, f"file://{tmp_path}/fresh0")
    assert batch(1, 3, "b") == 3  # the same batch with another document
    gone = c["texts"].filter("text LIKE 'Press item 0 of 1%'").select("id")
    assert ingest.remove(spark, out, gone) == 1 and ingest.remove(spark, out, gone) == 0
    assert ingest.rewrite(spark, out, most=2)
    catalog = ingest._catalog(spark, out).read()
    assert catalog.filter("kind = 'rows'").select("version").distinct().count() <= 2 and catalog.filter("kind = 'pairs'").count() <= 2 and catalog.filter("kind = 'rows'").count() == 3
    assert ingest.vacuum(spark, out) > 0
    c, pairs, documents, fulltext = by_hand(out, spark)
    assert {tuple(r) for r in c["links"].collect()} == pairs and c["docs"].count() == 6
    same_search(c, documents, fulltext, f"file://{tmp_path}/fresh1")
    assert batch(0, 2, "c") == 2  # replaced after it was rewritten together with others: the removed document is back
    c, pairs, documents, fulltext = by_hand(out, spark)
    assert {tuple(r) for r in c["links"].collect()} == pairs and c["docs"].count() == 7
    same_search(c, documents, fulltext, f"file://{tmp_path}/fresh2")


def test_a_batch_that_failed_half_way_does_not_count(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", a=LETTER)
    out = f"file://{tmp_path}/out"
    assert ingest.ingest(spark, f"file://{tmp_path}/in", out, batch="one", at="2024-05-01 09") == 1
    before = {name: sorted(map(str, ingest.corpus(spark, out)[name].collect())) for name in ("docs", "mentions", "dated", "links")}
    put(tmp_path / "in", b=REPORT)
    monkeypatch.setattr(ingest, "_write_pairs", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.ingest(spark, f"file://{tmp_path}/in", out, batch="one", at="2024-05-01 09")
    assert {name: sorted(map(str, ingest.corpus(spark, out)[name].collect())) for name in before} == before
    monkeypatch.undo()
    assert ingest.ingest(spark, f"file://{tmp_path}/in", out, batch="one", at="2024-05-01 09") == 2
    assert ingest.corpus(spark, out)["docs"].count() == 2


def test_two_streams_fill_one_corpus_and_a_foreign_checkpoint_is_refused(spark, tmp_path):
    put(tmp_path / "a", one=LETTER)
    put(tmp_path / "b", two=REPORT)
    run = lambda source, at, out="out": ingest.streaming_ingest(spark, f"file://{tmp_path}/{source}", f"file://{tmp_path}/{out}", f"file://{tmp_path}/{at}", lambda: "2024-05-01 09").trigger(availableNow=True).start().awaitTermination()
    run("a", "at-a")
    run("b", "at-b")  # starts at epoch 0 as well
    assert ingest.corpus(spark, f"file://{tmp_path}/out")["docs"].count() == 2
    with pytest.raises(ValueError, match="another|belongs"):
        run("a", "at-a", "elsewhere")


def test_outcomes_of_files_are_counted_in_the_write(spark, tmp_path):
    put(tmp_path / "in", a=LETTER, b=REPORT, c=LETTER, d="short")
    (tmp_path / "in" / "x.docx").write_bytes(b"PK\x03\x04bad")
    (tmp_path / "in" / "y.bin").write_bytes(b"\x00\x01")
    out = f"file://{tmp_path}/out"
    made = ingest.tables(files.files(spark, f"file://{tmp_path}/in"), "2024-05-01 09")
    totals = ingest.batch_totals(made, out, "one")
    assert totals == {"documents": 2, "read": 2, "duplicate": 1, "too short": 1, "broken": 1, "unsupported": 1, "found": 6}
    put(tmp_path / "again", e=LETTER)
    made = ingest.tables(files.files(spark, f"file://{tmp_path}/again"), "2024-05-02 09")
    assert ingest.batch_totals(made, out, "two") == {"documents": 0, "read": 0, "duplicate": 1, "too short": 0, "broken": 0, "unsupported": 0, "found": 1}
    rows = {(r.batch, r.name): r.outcome for r in ingest.outcomes(spark, out).collect()}
    assert len(rows) == 7 and rows["one", "x.docx"] == "broken" and rows["two", "e.txt"] == "duplicate"


def test_mails_count_once_and_their_people_are_mentions(spark, tmp_path):
    mail = "Message-ID: <1@x>\nSubject: The plan\nFrom: Ann Marsh <ann@jpmorgan.com>\nTo: Bob Brook <bob@gmail.com>, carl.dane@acme.com\nDate: Mon, 5 Feb 2007 10:00:00 +0000\n\nAnn Marsh will send the wire transfer to the offshore holding on March 14, 2009.\n"
    other = mail.replace("<1@x>", "<2@x>").replace("The plan", "")
    for name, texts in (("m1", {"a.eml": mail, "b.eml": mail.replace("will send", "sends")}), ("m2", {"c.eml": mail, "d.eml": other})):
        (tmp_path / name).mkdir()
        for file, text in texts.items():
            (tmp_path / name / file).write_text(text)
    out = f"file://{tmp_path}/out"
    assert ingest.ingest_mails(spark, f"file://{tmp_path}/m1", out, batch="one", at="2024-05-01 09", collection="Leak") == 1
    assert ingest.ingest_mails(spark, f"file://{tmp_path}/m2", out, batch="two", at="2024-05-01 09") == 1
    c = ingest.corpus(spark, out)
    docs = {(r.title, r.category, r.date) for r in c["docs"].collect()}
    assert docs == {("[Leak] The plan", "email", "2007-02-05"), ("Email from Ann Marsh", "email", "2007-02-05")}
    (plan,) = c["docs"].filter("title LIKE '%plan'").collect()
    held = {(r.name, r.type): r["count"] for r in c["mentions"].filter(F.col("document_id") == plan.id).join(c["entities"], F.expr("id = entity_id")).collect()}
    assert held["Ann Marsh", "person"] == 2 and held["Bob Brook", "person"] == 1 and held["Carl Dane", "person"] == 1 and held["JPMorgan", "org"] == 1 and held["Acme", "org"] == 1
    assert {r.outcome for r in ingest.outcomes(spark, out).filter("batch = 'two'").collect()} == {"read", "duplicate"}
    found = api.search_documents(c, "wire transfer").collect()
    assert len(found) == 2 and all("<mark>wire transfer</mark>" in r.excerpt for r in found)


def test_pages_that_show_mails():
    page = "<html><script>Subject: no</script><a href='/x/emailid/41?y'></a><table><tr><th>From:</th><td>Ann <b>Lee</b> &lt;a@x.org&gt;</td></tr><tr><td>To<td>c@d.org</table><p>Date: 2007-01-02</p><div class='box email-body'>One<div>two</div> &amp; three</div><pre>no</pre>"
    (r,) = files.mails_of("p.html", page.encode())
    assert (r[1], r[2], r[3], r[4], r[7], r[8].strip()) == ("41", "", "Ann Lee", "a@x.org", None, "One two & three")
    (r,) = files.mails_of("q.html", b"<p>just a page</p>")
    assert r[1] is None and r[8].strip() == "just a page"

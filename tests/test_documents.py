import io
import random
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking, ingestion
from docloom.params import Params
from docloom.sources import extract, files, markdown
from docloom.streaming import ingest as streams

MARKDOWN = """---
topic_id: t1
title: "Night audit"
relative_path: a/b.md
breadcrumbs: [Home, 'Daily', Audit]
tags:
  - one
  - "two"
---
![logo](logo.png)
[Home](h.md) > [Daily](d.md)

| Previous | Next |
|---|---|
| [a](a.md) | [b](b.md) |

# Start

First paragraph of the text,
in two lines.

1. Open the screen
2. Close it

## Values

| name | value |
| --- | --- |
| room rate | 10 |
"""
HTML = b"""<html><head><title>Night  audit</title><style>x</style></head><body><nav><a href='n.htm'>Nav</a></nav><div class="breadcrumbs">Home &gt; Daily</div>
<h1>Start</h1><p>Text with a <a href='sub/x.htm#top'>link</a> and <b>bold<p>Second one<ul><li>Item <li>Other</ul><img src="sub/../p.png"><img src="icon.png"><img src="../out.png"><a href="mailto:x@y.z">mail</a>
<table><tr><td>Name</td><td>Value</td></tr></table><script>var x;</script></body></html>"""


def model(blocks, limit, least):
    """The packing rule, block by block."""
    out, buf, head = [], [], None
    for text, heading in blocks:
        size = sum(map(len, buf))
        if buf and (heading != head or (size + len(text) > limit and size >= least)):
            out.append(("\n\n".join(buf), head))
            buf = []
        if len(text) > limit:
            if buf:
                out.append(("\n\n".join(buf), head))
                buf = []
            out += [(piece, heading) for s in range(0, len(text), limit) if (piece := text[s : s + limit].strip())]
            continue
        buf.append(text)
        head = heading
    return out + ([("\n\n".join(buf), head)] if buf else [])


def test_packing_agrees_with_the_rule():
    rng = random.Random(1)
    for _ in range(200):
        b = [("w" * rng.choice([5, 30, 60, 130, 260]), rng.choice([None, "A", "B"])) for _ in range(rng.randint(1, 12))]
        given, name = [], None
        for text, heading in b:
            if heading != name and heading is None:
                heading = name  # a heading holds until the next
            if heading != name:
                given.append({"text": heading, "name": heading, "html_tag": None})
                name = heading
            given.append({"text": text, "name": None, "html_tag": None})
        carried, name = [], None
        for g in given:
            name = g["name"] or name
            carried += [] if g["name"] else [(g["text"], name)]
        assert [(c["content"], c["heading"]) for c in chunking.packed(given, 100, 40)] == model(carried, 100, 40)


def no_shuffle(df):
    return "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_chunks_of_texts(spark):
    df = spark.createDataFrame([(1, "NIGHT AUDIT\n\nFirst words of it.\n\nSecond words of it.\n\nOTHER\n\nLast words."), (2, None), (3, " \n\n "), (4, "x" * 5000)], "doc_id bigint, text string")
    got = {(r.doc_id, r.chunk_index): r for r in chunking.chunk_documents(df).collect()}
    assert set(got) == {(1, 0), (1, 1), (4, 0), (4, 1), (4, 2)}
    assert got[1, 0].content == "First words of it.\n\nSecond words of it." and got[1, 0].heading == "NIGHT AUDIT" and got[1, 1].heading == "OTHER"
    assert chunking.chunk_documents(df.where("doc_id > 9")).count() == 0 and no_shuffle(chunking.chunk_documents(df))
    stats = {r.doc_id: (r.text_length, r.chunk_count) for r in chunking.document_stats(chunking.chunk_documents(df)).collect()}
    assert stats[4] == (5000, 3)


def test_markdown(spark):
    df = spark.createDataFrame([("d", MARKDOWN, "Night audit"), ("n", None, "x"), ("e", "", "only title"), ("o", "--- no fence\ntext", None)], "doc_id string, text string, title string")
    fields = {r.doc_id: r.f for r in df.select("doc_id", markdown.front_matter_fields(F.col("text")).alias("f")).collect()}
    assert fields["d"]["title"] == ["Night audit"] and fields["d"]["breadcrumbs"] == ["Home", "Daily", "Audit"] and fields["d"]["tags"] == ["one", "two"] and fields["o"] == {}
    rows = sorted((r.block_no, r.kind, r.text, r.heading) for r in markdown.blocks(df).collect() if r.doc_id == "d")
    assert [r[1:] for r in rows] == [
        ("title", "Night audit", "Night audit"), ("heading", "Start", "Start"), ("paragraph", "First paragraph of the text,\nin two lines.", "Start"), ("paragraph", "1. Open the screen\n2. Close it", "Start"),
        ("heading", "Values", "Values"), ("table", "name | value\nroom rate | 10", "Values"),
    ]
    chunks = chunking.chunked(markdown.as_chunk_blocks(markdown.block_lists(df)))
    assert no_shuffle(chunks) and no_shuffle(markdown.blocks(df))
    assert all(r.heading for r in chunks.where("doc_id = 'd'").collect())
    assert {r.chunk_type for r in chunks.where("html_tag = 'table'").collect()} == {"table"}


def test_html():
    page = extract.read_html(HTML, "daily/a.htm")
    assert page["title"] == "Night audit" and page["breadcrumbs"] == ["Home", "Daily"]
    texts = [b["text"] for b in page["blocks"]]
    # the main heading comes first; the path is a block too, as it isn't among what is taken out of a page
    assert texts[:5] == ["Start", "Home > Daily", "Start", "Text with a link (sub/x.htm#top) and bold", "Second one"] and "- Item" in texts
    assert {"text": "Name | Value", "heading": "Start", "style": None, "html_tag": "table"} in page["blocks"]
    assert page["links"] == [{"href": "sub/x.htm#top", "text": "link"}] and [x["filename"] for x in page["images"]] == ["p.png", "icon.png", "out.png"]


def test_html_chrome_root_and_assets():
    repeated = "".join(f"<p>Paragraph number {i} of the page.</p>" for i in range(70)) + "<p>Paragraph number 0 of the page.</p>"
    html = f"""<html><head><title>T</title><link rel=stylesheet href=b.CSS><link href=a.css><script src="s.js"></script><script src="s.js"></script></head><body>
<div class="footer">foot</div><div id="nav">menu</div><span class="noprint">hidden</span><p><a href="p.htm">Print this page</a></p><p><a href="print.htm">x</a></p>
<p>Outside the main part.</p><div id="Layer1"><p class="heading1">Main  heading</p><div><div>Inner text</div></div>{repeated}<ul><li>one</ul></div></body></html>""".encode()
    page = extract.read_html(html, "d/x.htm")
    texts = [b["text"] for b in page["blocks"]]
    assert texts[0] == "Main heading" and page["blocks"][0]["style"] == "heading 1" and "Inner text" in texts and "- one" in texts
    assert len([t for t in texts if t.startswith("Paragraph number 0 ")]) == 1 and len(texts) == len(set(texts)) + 1  # the heading is named first, then stands
    assert not {"foot", "menu", "hidden", "Print this page", "Outside the main part."} & set(texts)
    assert page["assets"] == ["a.css", "b.CSS", "s.js"] and page["links"] == []
    other = extract.read_html(html.replace(b"Layer1", b"Other"), "d/x.htm")
    assert "Outside the main part." in [b["text"] for b in other["blocks"]]
    assert extract.read_html(b"<html><body>only <b>words</b></body></html>", "x.htm")["blocks"][0]["text"] == "only\n\nwords"
    assert extract.read_html(b"", "x.htm")["blocks"] == []


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p>{"<w:pPr><w:pStyle w:val=%r/></w:pPr>" % style if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>' for style, text in paragraphs).replace("'", '"')
    body += "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell text</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("docProps/core.xml", '<cp:coreProperties xmlns:cp="c" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Ann</dc:creator><dc:title>Word title</dc:title></cp:coreProperties>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return buffer.getvalue()


def test_docx():
    page = extract.read_docx(docx(("Heading1", "Part one"), (None, "A paragraph.")), "a.docx")
    assert [b["text"] for b in page["blocks"]] == ["Part one", "A paragraph."] and page["title"] == "Word title"
    assert page["properties"] == {"author": "Ann", "title": "Word title", "paragraph_count": "2"}


PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (40).to_bytes(4, "big") + (50).to_bytes(4, "big")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text(MARKDOWN)
    (tmp_path / "b.html").write_bytes(HTML)
    (tmp_path / "sub" / "c.txt").write_bytes("Grüße aus dem Archiv, das hier beginnt.\n\nEin zweiter Absatz folgt.".encode("latin-1"))
    (tmp_path / "sub" / "copy.txt").write_bytes((tmp_path / "sub" / "c.txt").read_bytes())
    (tmp_path / "d.docx").write_bytes(docx(("Heading1", "Part one"), (None, "A paragraph in the document that says something.")))
    (tmp_path / "bad.docx").write_bytes(b"PK not a zip")
    (tmp_path / "e.doc").write_bytes(b"\xd0\xcf\x11Some printable words here\x00\x01\r\nok")
    (tmp_path / "empty.txt").write_bytes(b"  \n\n ")
    (tmp_path / "p.png").write_bytes(PNG)
    (tmp_path / "icon.png").write_bytes(PNG)
    (tmp_path / "s.zip").write_bytes(b"1")
    (tmp_path / "x.bin").write_bytes(b"1")
    return str(tmp_path)


def test_ingest(spark, folder):
    out = ingestion.ingest_folder(spark, folder, params=Params(vector_size=16))
    docs = {r.filename: r for r in out.documents.collect()}
    assert set(docs) == {"a.md", "b.html", "c.txt", "d.docx", "e.doc"}
    assert docs["a.md"].title == "Night audit" and docs["a.md"].breadcrumbs == ["Home", "Daily", "Audit"]
    s = out.stats.first()
    assert (s.total_files, s.files_read, s.failed, s.documents_ingested, s.skipped_duplicate, s.skipped_empty, s.route_text, s.route_unsupported) == (12, 7, 1, 5, 1, 1, 4, 2)
    assert (s.images_stored, s.images_skipped, s.documents_skipped, s.ignored, s.batch_flushes, s.links_resolved) == (1, 1, 2, 2, 1, 0)
    assert [(r.filename, r.width, r.document_id) for r in out.images.collect()] == [("p.png", 40, docs["b.html"].document_id)]
    c = out.chunks.collect()
    assert all(len(r.embedding) == 16 for r in c) and len({r.vector_id for r in c}) == len(c) == s.total_chunks
    a = next(r for r in c if r.document_id == docs["a.md"].document_id and r.chunk_index == 0)
    assert a.vector_id == str(uuid.uuid5(uuid.UUID(a.document_id), "a.md:0"))
    assert "Grüße" in next(r for r in c if r.document_id == docs["c.txt"].document_id).content
    assert {r.href for r in out.links.collect()} == {"sub/x.htm#top"}
    again = ingestion.ingest_folder(spark, folder, known=out.documents, params=Params(vector_size=16))
    assert again.documents.count() == 0 and again.stats.first().skipped_duplicate == 6


def test_streamed_folder(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    run = lambda: streams.watch_folder(spark, folder, f"{at}/t", f"{at}/c", Params(vector_size=8)).awaitTermination(120)
    run()
    assert spark.read.parquet(f"{at}/t/documents").count() == 5
    with open(f"{folder}/new.txt", "w") as f:
        f.write("A new text that came later than all the others did.")
    run()
    assert spark.read.parquet(f"{at}/t/documents").count() == 6


def test_windows_are_the_same_on_a_stream(spark, tmp_path):
    rows = spark.range(500).select(F.timestamp_seconds(F.col("id") * 97).alias("ts"), (F.col("id") % 7).alias("user_id"), F.concat(F.lit("t"), F.col("id") % 2).alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.start, r.event_type)
    assert [(key(r), r.events, r.value) for r in sorted(spark.table("w").collect(), key=key)] == [(key(r), r.events, r.value) for r in sorted(streams.windowed(rows).collect(), key=key)]
    assert streams.sessions(rows, "96 seconds").count() == 500


def test_routes(spark):
    df = spark.createDataFrame([("a/B.HTM", None, "html"), ("x.pdf", None, "pdf"), ("x.docx", None, "word"), ("x.md", None, "text"), ("x.csv", None, "text"), ("x.png", None, "image"), ("x.css", None, "text"), ("x.bin", None, "unsupported"), ("noext", "text/html; q", "text"), (None, "image/webp", "image"), (None, None, "unsupported"), (".htm", None, "unsupported")], "path string, t string, want string")
    for r in df.withColumn("got", files.route(F.col("path"), F.col("t"))).collect():
        assert r.got == r.want or (r.path == "x.css" and r.got in ("text", "ignored")), r


def test_links_and_images(spark):
    target = lambda s, h: spark.createDataFrame([(s, h)], "s string, h string").select(ingestion.target_path(F.col("s"), F.col("h"))).first()[0]
    assert target("a/b/c.htm", "d.htm#x") == "a/b/d.htm" and target("a/c.htm", "a/d.htm") == "a/d.htm" and target("a/c.htm", "/d.htm") == "d.htm"
    assert target("a/c.htm", "https://x/y") is None and target("a/c.htm", "#top") is None and target(None, "d.htm") == "d.htm" and target("c.htm", None) is None
    links = spark.createDataFrame([(1, None, "p1"), (2, "set", "p1"), (3, None, "nope"), (4, None, None), (5, None, "")], "link_id int, target_document_id string, target_path string")
    docs = spark.createDataFrame([("d2", "p1"), ("d1", "p1"), ("d3", None)], "document_id string, source_path string")
    got = {r.link_id: (r.target_document_id, r.newly_resolved) for r in ingestion.resolved_links(links, docs).collect()}
    assert got == {1: ("d1", True), 2: ("set", False), 3: (None, False), 4: (None, False), 5: (None, False)}
    small = spark.createDataFrame([("a.png", 32, 32, True), ("a.png", 33, 1, False), ("Icon_x.png", 900, 900, True), ("a.png", None, 5, False), (None, None, None, False)], "n string, w int, h int, want boolean")
    assert all(r.got == r.want for r in small.withColumn("got", files.is_small_image(F.col("n"), F.col("w"), F.col("h"))).collect())
    img = "file_hash string, path string, referenced_by_document_id string"
    known = spark.createDataFrame([("h", "p", None)], img)
    assert ingestion.new_images(spark.createDataFrame([("h", "p", None), ("h", "p", "d"), (None, "p", None)], img), known).count() == 2


def test_upsert(spark):
    schema = "vector_id string, v int, created_at timestamp"
    old = spark.createDataFrame([("a", 1), ("b", 1)], "vector_id string, v int").withColumn("created_at", F.timestamp_seconds(F.lit(1)))
    batch = spark.createDataFrame([("b", 2, 5), ("b", 3, 9), ("c", 4, None), (None, 9, 9)], "vector_id string, v int, s int").withColumn("created_at", F.timestamp_seconds("s")).drop("s")
    assert {(r.vector_id, r.v) for r in ingestion.upserted(old, batch).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert ingestion.upserted(spark.createDataFrame([], schema), batch.limit(0)).count() == 0
    assert ingestion.index_status(spark.createDataFrame([("a", [1.0])], "vector_id string, embedding array<double>")).first().asDict() == {"points": 1, "vector_size": 1}

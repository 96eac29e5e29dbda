import json

import pytest
from pyspark.sql import functions as F

from quillmesh.functions.paths import content_hash
from quillmesh.sources import compound as compound_files
from quillmesh.sources import files, formats, store
from quillmesh.sources import pdf as pdf_files
from quillmesh.streaming import ingest, metrics, thinking


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\xe9".encode("cp1252"))
    (tmp_path / "b.CSV").write_text('h1,h2\n"x, y",z\n')
    (tmp_path / "c.html").write_text("<p>hello<script>x</script> world")
    (tmp_path / "d.eml").write_text("Subject: Hi\nContent-Type: text/plain\n\nbody text")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.md").write_text("  ")
    (tmp_path / "g.xyz").write_text("no")
    rows = {r.file_name: r for r in files.extract(files.scan(spark, str(tmp_path))).collect()}
    assert rows["a.txt"].page_content == "café" and rows["b.CSV"].page_content == "h1 h2\nx, y z" and rows["b.CSV"].file_type == ".csv"
    assert rows["c.html"].page_content == "hello  world" and "Subject: Hi" in rows["d.eml"].page_content and "body text" in rows["d.eml"].page_content
    assert rows["a.txt"].creation_date[:4] >= "2020" and len(rows["a.txt"].creation_date) == 26
    assert rows["e.pdf"].error == "no text" and rows["f.md"].error == "no text" and "g.xyz" not in rows
    registry = files.LoaderRegistry()
    assert registry.load(".odt", b"x")[1] == "no loader for .odt"
    registry.register(".pdf", lambda b: "[[page1]]text")
    registry.register(".txt", lambda b: 1 / 0)
    rows = {r.file_name: r for r in files.extract(files.scan(spark, str(tmp_path)), registry).collect()}
    assert rows["e.pdf"].page_content == "[[page1]]text" and "ZeroDivisionError" in rows["a.txt"].error
    assert files.incompatible(spark.read.format("binaryFile").load(str(tmp_path))).count() == 1


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"page_content": "said", "metadata": {"file_name": "a.mp3", "document_type": "audio"}}, indent=4))
    (tmp_path / "b.json").write_text("{broken")
    rows = files.transcripts(spark, str(tmp_path)).collect()
    assert sorted(r.page_content for r in rows) == ["", "said"] and sum(r.error is not None for r in rows) == 1


def test_staging(spark):
    df = spark.createDataFrame([("/a/x.txt",), ("/b/X.txt",), ("/b/y.txt",), ("/a/x.txt",)], "path string")
    rows = {r.path: r.staged_name for r in files.staging(df).collect()}
    assert rows["/a/x.txt"] == "x.txt" and rows["/b/y.txt"] == "y.txt" and rows["/b/X.txt"].startswith("X_") and len(rows) == 3


def test_store(spark, tmp_path):
    vectors = spark.createDataFrame([("1", [1.0, 0.0], "a", "{}"), ("2", [0.0, 2.0], "b", "{}")], "id string, vector array<float>, text string, metadata string")
    meta = spark.createDataFrame([(1, "f", "h1", "/f", "a"), (2, "g", "h2", "/g", "b")], "id int, file_name string, hash string, file_path string, page_content string")
    ids = spark.createDataFrame([("1", "h1"), ("2", "h2")], "tiledb_id string, hash string")
    db = store.VectorStore(spark, str(tmp_path), "first")
    assert db.build(vectors, meta, ids, 2)["num_vectors"] == 2 and db.describe()["index_type"] == "FLAT"
    with pytest.raises(FileExistsError):
        db.build(vectors, meta, ids, 2)
    assert db.table("vectors").where("id = '2'").first().norm == 2.0
    assert [r.text for r in db.point_read(spark.createDataFrame([("2",), ("9",)], "id string"), ["text"]).collect()] == ["b"]
    less = db.delete_documents(spark.createDataFrame([("h1",)], "hash string"))
    assert less.files().count() == 1 and less.table("vectors").count() == 1
    db.backup(str(tmp_path / "backup"))
    db.delete()
    assert not db.exists()
    db.restore(str(tmp_path / "backup"))
    assert db.table("hash_chunk_ids").count() == 2
    import zipfile

    with zipfile.ZipFile(db.export(str(tmp_path / "out.zip"))) as z:
        assert any(n.startswith("vectors/part-") for n in z.namelist()) and z.testzip() is None
    bad = store.VectorStore(spark, str(tmp_path), "bad")
    with pytest.raises(Exception):
        bad.build(vectors.withColumn("text", F.raise_error(F.lit("no"))), meta, ids, 2)
    assert not bad.exists() and not (tmp_path / "_building_bad").exists()


def test_metadata_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string").select(store.metadata_json("a", "b").alias("m"))
    assert json.loads(df.first().m) == {"a": 1, "b": None}
    broken = spark.createDataFrame([("{",)], "m string").select(store.parsed_metadata(F.col("m"), "a int").alias("p"))
    assert broken.first().p is None or broken.first().p.a is None


def test_chunk_ids(spark):
    df = spark.createDataFrame([("h", k, "/f") for k in range(100)], "h string, k int, p string").select(store.chunk_id(F.col("h"), F.col("k"), F.col("p")).alias("i"))
    ids = [int(r.i) for r in df.collect()]
    assert len(set(ids)) == 100 and all(0 <= i < 2**64 for i in ids)


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([("a" * 1000, ".txt", "/a"), ("[[page2]]b", ".pdf", "/b")], "page_content string, file_type string, file_path string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = ingest.document_stream(spark, str(tmp_path / "in"), docs.schema)
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4

    samples = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", 10.0, 20.0, None), (2, 1, "2024-01-01 00:00:00", 10.0, 20.0, None), (3, 1, "2024-01-09 00:00:00", 50.0, 20.0, None)], "sample_id long, session_id long, t string, cpu_usage double, ram_usage_percent double, gpu_utilization double").withColumn("sample_ts", F.to_timestamp("t"))
    samples.write.parquet(str(tmp_path / "m"))
    source = spark.readStream.schema(samples.schema).parquet(str(tmp_path / "m"))
    q = metrics.tumbling(source, late="1 day").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.samples, r.avg_cpu) for r in spark.table("windows").collect()] == [(1, 10.0)]

    pieces = spark.createDataFrame([(1, 0, "<thi"), (1, 1, "nk>a</think>b"), (2, 0, "c"), (3, 0, "a <thi"), (3, 1, None)], "conv_id long, seq long, piece string")
    pieces.write.parquet(str(tmp_path / "p"))
    source = spark.readStream.schema(pieces.schema).parquet(str(tmp_path / "p"))
    thinking.filter_stream(source).writeStream.format("memory").queryName("answers").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {(r.conv_id, r.seq): r.piece for r in spark.table("answers").collect()} == {(1, 0): "", (1, 1): "b", (2, 0): "c", (3, 0): "a ", (3, 1): "<thi"}
    thinking.gathered_stream(source, 3).writeStream.format("memory").queryName("gathered").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.conv_id, r.piece) for r in spark.table("gathered").collect()) == [(1, "<thi"), (1, "nk>a</think>b"), (3, "a <thi")]


def test_recent_stream(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{k:02d}", float(k)) for k in range(10)] + [(2, "2024-01-01 00:00:00", 5.0)]
    df = spark.createDataFrame(rows, "session_id long, t string, cpu_usage double").withColumn("sample_ts", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "m"))
    metrics.recent_stream(stream, 4).writeStream.format("memory").queryName("recent").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    last = {r.session_id: (r.in_history, r.mean_cpu) for r in spark.table("recent").collect()}
    assert last == {1: (4, 7.5), 2: (1, 5.0)}


def test_hash_is_of_the_text(spark):
    import hashlib

    assert spark.createDataFrame([("é",)], "t string").select(content_hash(F.col("t"))).first()[0] == hashlib.sha256("é".encode()).hexdigest()


def zipped(**parts):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two é</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t><w:br/><w:t>four</w:t></w:r></w:p><w:p/></w:body></w:document>"
    header = f"<w:hdr {w}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>"
    assert formats.load_docx(zipped(word__document_dot_xml=body, word__header1_dot_xml=header)) == "Head\n\nOne\ttwo é\n\nthree\nfour"
    assert formats.load_docx(zipped(word__document_dot_xml=f"<w:document {w}/>")) is None


def test_xlsx():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = f'<workbook {ns}><sheets><sheet name="B" sheetId="1" r:id="r2"/><sheet name="A" sheetId="2" r:id="r1"/></sheets></workbook>'
    links = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>'
    strings = f"<sst {ns}><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si><si><t>  </t></si></sst>"
    styles = f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    one = f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>2</v></c><c t="s"><v>1</v></c></row><row/><row><c><v>3</v></c><c><v>2.50</v></c><c s="1"><v>45000</v></c><c s="2"><v>0.5</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>'
    two = f'<worksheet {ns}><sheetData><row><c t="inlineStr"><is><t>in</t></is></c><c t="str"><f>1+1</f><v>two</v></c><c t="e"><v>#N/A</v></c></row></sheetData></worksheet>'
    content = zipped(xl__workbook_dot_xml=book, xl___rels__workbook_dot_xml_dot_rels=links, xl__sharedStrings_dot_xml=strings, xl__styles_dot_xml=styles, xl__worksheets__sheet1_dot_xml=one, xl__worksheets__sheet2_dot_xml=two)
    assert formats.load_xlsx(content) == "in two #N/A\nname rich\n3 2.5 2023-03-15 00:00:00 12:00:00 True"


def test_rtf():
    source = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\*\generator x;}\f0 Caf\'e9 \b bold\b0\par \u8364?5 \{x\}\tab \u-10179?\u-8704?\line {\uc2\u960??z}{\pict 00ff}\~end\emdash }"
    assert formats.load_rtf(source) == "Café bold\n€5 {x}\t😀\nπz\xa0end—"
    assert formats.load_rtf(rb"{\rtf1 {\info x}}") is None and formats.load_rtf(b"") is None


def test_broken_files_are_rows(spark, tmp_path):
    for name in ("a.docx", "b.xlsx", "c.xlsm"):
        (tmp_path / name).write_bytes(b"PK no zip")
    (tmp_path / "d.rtf").write_text("{}")
    (tmp_path / "e.html").write_text("<div>" * 5000 + "deep")
    (tmp_path / "f.txt").write_text("text")
    extracted = files.extract(files.scan(spark, str(tmp_path)))
    rows = {r.file_name: r for r in extracted.collect()}
    assert all("BadZipFile" in rows[n].error for n in ("a.docx", "b.xlsx", "c.xlsm")) and rows["d.rtf"].error == "no text" and rows["e.html"].page_content == "deep"
    counts = {r.file_type: r for r in files.ingest_counts(extracted).collect()}
    assert counts[".docx"].failed == 1 and counts[".rtf"].empty == 1 and counts[".txt"].read == 1 and counts[".txt"].characters == 4
    assert files.ingest_counts(extracted.where("false")).count() == 0


def test_whole_pages_and_mails():
    page = b"<nav>menu</nav><p>body</p><section><h2>License</h2>mit</section><footer>foot</footer><script>no</script>"
    assert files.load_html(page).split() == ["menu", "body", "License", "mit", "foot"]
    mail = b"Subject: S\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=b\n\n--b\nContent-Type: text/plain\n\nplain\n--b\nContent-Type: text/html\n\n<nav>menu</nav><p>rich</p>\n--b--\n"
    assert files.load_email(mail).split("\n") == ["Subject: S", "plain", "menu rich"]
    assert files.load_email(b"Content-Type: text/html\n\n<p>as it stands</p>") == "<p>as it stands</p>"


def test_saved_once(spark, tmp_path):
    from quillmesh.operators import web

    rows = [("https://a.example/x", '<body><a href="/y">y</a></body>'), ("https://a.example/y", "<body>z</body>"), ("https://a.example/n", None)]
    pages = spark.createDataFrame(rows, "url string, html string")
    folder = str(tmp_path / "saved")
    assert web.save_pages(pages.where("url LIKE '%x'"), folder).count() == 1
    table = {r.file_name: r for r in web.save_pages(pages, folder).collect()}
    assert len(table) == 3 and table["a.example_x"].links == "https://a.example/y" and table["a.example_y"].links == "" and "Original Source" in table["a.example_y"].html
    assert web.save_pages(pages, folder).count() == 3


def test_metrics_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 10.0, None)], "session_id long, t string, cpu_usage double, ram_usage_percent double").selectExpr("session_id", "timestamp(t) AS sample_ts", "cpu_usage", "ram_usage_percent", "1D AS gpu_utilization", "2D AS vram_usage_percent", "3D AS power_usage_percent", "4D AS power_limit_percent")
    df.write.parquet(str(tmp_path / "m"))
    q = metrics.csv_sink(spark.readStream.schema(df.schema).parquet(str(tmp_path / "m")), str(tmp_path / "out"), str(tmp_path / "state"), every="1 second")
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == [("2024-01-01T00:00:00.000000", "10.0", None, "1.0", "2.0", "3.0", "4.0")]


def test_dump(spark, tmp_path):
    from quillmesh.operators import citations

    hits = spark.createDataFrame([("/b", 2, None), ("/a", 1, 3)], "file_path string, rank int, page_number int")
    citations.dump(hits, ["file_path", "page_number"], str(tmp_path / "d"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "d")).collect()] == [{"file_path": "/a", "page_number": 3}, {"file_path": "/b", "page_number": None}]


def compound(**streams):
    """A compound file of these streams: small ones in small sectors, as programs write it."""
    import struct

    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    small, small_next, big, next_, entries = b"", [], b"", [], []

    def chain(data, size, table):
        n, first = -(-len(data) // size), len(table)
        table += [first + k + 1 for k in range(n - 1)] + [end] * bool(n)
        return data.ljust(n * size, b"\0"), first if n else end

    for name, data in streams.items():
        if len(data) < 4096:
            padded, start = chain(data, 64, small_next)
            small += padded
        else:
            padded, start = chain(data, 512, next_)
            big += padded
        entries.append((name, 2, start, len(data)))
    sectors, small_start = chain(small, 512, next_)
    big += sectors
    sectors, table_start = chain(struct.pack(f"<{len(small_next)}I", *small_next).ljust(512 * -(-4 * len(small_next) // 512), b"\xff"), 512, next_)
    big += sectors
    listed = [("Root Entry", 5, small_start, len(small)), *entries]
    directory = b""
    for k, (name, kind, start, size) in enumerate(listed):
        wide = name.encode("utf-16-le")
        right = k + 1 if 0 < k < len(listed) - 1 else free
        directory += wide.ljust(64, b"\0") + struct.pack("<HBBIII", len(wide) + 2, kind, 1, free, right, 1 if not k else free) + b"\0" * 36 + struct.pack("<IQ", start, size)
    sectors, directory_start = chain(directory, 512, next_)
    big += sectors
    at = len(next_)
    next_.append(0xFFFFFFFD)
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH6xIIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, 1, directory_start, 0, 4096, table_start if small_next else end, 1, end, 0, at)
    assert len(next_) <= 128
    return header.ljust(512, b"\xff") + big + struct.pack(f"<{len(next_)}I", *next_).ljust(512, b"\xff")


def test_msg():
    body = "Zeile eins\r\n" + "größer " * 900
    content = compound(**{"__substg1.0_0037001F": "Über".encode("utf-16-le"), "__substg1.0_1000001F": body.encode("utf-16-le"), "other": b"x"})
    assert compound_files.load_msg(content) == f"Subject: Über\n{body}"
    assert compound_files.load_msg(compound(**{"__substg1.0_1000001E": "caf\xe9".encode("cp1252")})) == "café"
    assert compound_files.load_msg(compound(other=b"x")) is None
    with pytest.raises(ValueError):
        compound_files.load_msg(b"no storage")


def test_xls():
    import struct

    def record(kind, data=b""):
        return struct.pack("<HH", kind, len(data)) + data

    start = record(0x809, struct.pack("<HH", 0x600, 5).ljust(16, b"\0"))
    cell = lambda row, column: struct.pack("<HHH", row, column, 0)
    texts = struct.pack("<II", 3, 3) + struct.pack("<HB", 4, 0) + b"name" + struct.pack("<HBH", 3, 9, 1) + "żółw"[:3].encode("utf-16-le") + b"runs" + struct.pack("<HB", 6, 0) + b"par"
    shared = record(0xFC, texts) + record(0x3C, b"\x01" + "tęd".encode("utf-16-le"))
    first = start + record(0xFD, cell(1, 1) + struct.pack("<I", 1)) + record(0xFD, cell(0, 0) + struct.pack("<I", 0)) + record(0xFD, cell(0, 2) + struct.pack("<I", 2))
    first += record(0x203, cell(1, 0) + struct.pack("<d", 5.0)) + record(0xBD, struct.pack("<HH", 2, 0) + struct.pack("<HIHI", 0, 7 << 2 | 2, 0, 125 << 2 | 3) + struct.pack("<H", 1)) + record(0x27E, cell(2, 5) + struct.pack("<I", 0x3FF80000))
    first += record(0x06, cell(3, 0) + b"\0\0\0\0\0\0\xff\xff" + b"\0" * 8) + record(0x207, struct.pack("<HB", 2, 0) + b"ok") + record(0x06, cell(3, 1) + struct.pack("<d", 2.5) + b"\0" * 8) + record(0x205, cell(3, 2) + b"\x01\x00") + record(0x204, cell(4, 0) + struct.pack("<HB", 1, 0) + b" ") + record(0x0A)
    second = start + record(0x204, cell(0, 0) + struct.pack("<HB", 3, 0) + b"two") + record(0x0A)
    sheet = lambda at, name: record(0x85, struct.pack("<IBB", at, 0, 0) + struct.pack("<BB", len(name), 0) + name)
    length = len(start + sheet(0, b"A") + sheet(0, b"B") + shared + record(0x0A))
    book = start + sheet(length, b"A") + sheet(length + len(first), b"B") + shared + record(0x0A) + first + second
    expected = "name partęd\n5.0 żół\n7.0 1.25 1.5\nok 2.5 1\ntwo"
    assert compound_files.load_xls(compound(Workbook=book)) == expected
    assert compound_files.load_xls(compound(Workbook=book.ljust(6000, b"\0"))) == expected
    with pytest.raises(ValueError):
        compound_files.load_xls(compound(other=b"x"))


def pdf(*pages, compress=True, extra=()):
    """A PDF of content streams, one a page; fonts F1 (simple, with differences) and F2 (two bytes, mapped)."""
    import zlib

    def stream(data, entries=b""):
        packed = zlib.compress(data) if compress else data
        return b"<<" + entries + (b"/Filter/FlateDecode" if compress else b"") + b"/Length %d>>stream\n" % len(packed) + packed + b"\nendstream"

    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0416> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0066006C> <20AC>] endbfrange"
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>",
        2: b"<</Type/Pages/Kids[3 0 R]/Count %d/Resources<</Font<</F1 5 0 R/F2 6 0 R>>/XObject<</X 9 0 R>>>>>>" % len(pages),
        3: b"<</Type/Pages/Parent 2 0 R/Kids[" + b" ".join(b"%d 0 R" % (20 + 2 * k) for k in range(len(pages))) + b"]>>",
        5: b"<</Type/Font/Subtype/Type1/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[1/eacute/fi/uni20AC]>>/FirstChar 32/Widths[250]>>",
        6: b"<</Type/Font/Subtype/Type0/ToUnicode 7 0 R>>",
        7: stream(cmap),
        9: stream(b"BT /F1 10 Tf 50 50 Td (in a form) Tj ET /X Do", b"/Subtype/Form"),
    }
    for k, page in enumerate(pages):
        objects[20 + 2 * k] = b"<</Type/Page/Parent 3 0 R/Contents %d 0 R>>" % (21 + 2 * k)
        objects[21 + 2 * k] = stream(page)
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % n + o + b"\nendobj\n" for n, o in objects.items()) + b"".join(extra) + b"trailer<</Root 1 0 R>>\n%%EOF"


@pytest.mark.parametrize("compress", [True, False])
def test_pdf(compress):
    first = b"BT /F1 12 Tf 72 700 Td (One \\(two\\) caf\\001) Tj 0 -14 Td [(spl) 10 (it) -600 (apart)] TJ T* ET BI /W 1 ID \x01 (\xff EI BT /F1 12 Tf 1 0 0 1 72 600 Tm (o\002\003 \\344) Tj ET"
    second = b"q 1 0 0 RG Q % nothing\n"
    third = b"BT /F2 9 Tf 10 TL 5 5 Td <0001001000110012> Tj <00200021> ' ET /X Do"
    assert pdf_files.load_pdf(pdf(first, second, third, compress=compress)) == "[[page1]]One (two) café\nsplit apart\nofi€ ä[[page3]]Жabc\nfl€\nin a form"
    assert pdf_files.load_pdf(pdf(second, compress=compress)) is None and pdf_files.page_texts(pdf(compress=compress)) == []


def test_pdf_objects():
    import zlib

    packed = zlib.compress(b"30 0 31 27 " + b"<</Type/Page/Contents 21 0 R>> <</a 1>>")
    stream = b"40 0 obj<</Type/ObjStm/N 2/First 11/Filter/FlateDecode/Length %d>>stream\r\n" % len(packed) + packed + b"\r\nendstream endobj\n"
    later = b"3 0 obj<</Type/Pages/Kids[30 0 R 30 0 R 3 0 R]>>endobj\n"
    assert pdf_files.page_texts(pdf(b"BT /F1 9 Tf (packed) Tj ET", extra=[stream, later])) == ["packed"]
    for broken in (b"", b"no pdf", pdf(b"x").replace(b"trailer<<", b"trailer<</Encrypt 8 0 R"), pdf(b"x").replace(b"/FlateDecode", b"/JBIG2Decode")):
        with pytest.raises(ValueError):
            pdf_files.page_texts(broken)


@pytest.mark.parametrize("kind", [".pdf", ".msg", ".xls", ".rtf", ".docx", ".xlsx", ".html", ".eml", ".csv"])
def test_damaged_files_end(kind):
    """Whatever a file holds, its loader comes to an end with a text or a reason."""
    import random
    import time

    draw = random.Random(kind)
    samples = {
        ".pdf": pdf(b"BT /F1 12 Tf 72 700 Td (One) Tj [(a) 5 (b)] TJ ET /X Do", compress=False),
        ".msg": compound(**{"__substg1.0_0037001F": b"a\0b\0", "__substg1.0_1000001F": b"x\0" * 3000}),
        ".xls": compound(Workbook=bytes(range(256)) * 20),
        ".rtf": rb"{\rtf1{\fonttbl{\f0 A;}}\u960?text{\*\x y}}",
        ".docx": zipped(word__document_dot_xml="<a/>"),
        ".xlsx": zipped(xl__workbook_dot_xml="<a/>"),
        ".html": b"<p>a<b>c</p><script>x</script>&amp;" * 20,
        ".eml": b"Subject: x\nContent-Type: multipart/mixed; boundary=b\n\n--b\n\nx\n--b--",
        ".csv": b'a,"b\nc",d\n' * 40,
    }
    registry, began = files.LoaderRegistry(), time.perf_counter()
    for n in range(150):
        damaged = bytearray(samples[kind])
        for _ in range(draw.randrange(1, 30)):
            at = draw.randrange(len(damaged))
            damaged[at : at + draw.randrange(3)] = bytes(draw.randrange(256) for _ in range(draw.randrange(3)))
        text, error = registry.load(kind, bytes(damaged))
        assert (text is None) == (error is not None)
    assert registry.load(kind, b"[" * 200_000) is not None and registry.load(kind, b"1 0 obj" + b"<<" * 100_000) is not None
    assert time.perf_counter() - began < 30

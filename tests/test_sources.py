import os
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.operators import index as I
from corpusloom.operators import state
from corpusloom.operators.chunk import ChunkConfig
from corpusloom.plans.index import IndexConfig, ask, build_index
from corpusloom.plans.ingest import IngestConfig, SlugCollision, ingest, read_chunks
from corpusloom.sources.files import discover, load, parse_docx, parse_xlsx, pdf_text, read_manifest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d" xmlns:dcterms="t"><dc:title>Deck</dc:title><dc:creator>Ann</dc:creator><dcterms:created>2024-01-02T03:04:05Z</dcterms:created></cp:coreProperties>'


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def docx(path):
    table = "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr><w:tr><w:tc>" + p("") + "</w:tc><w:tc>" + p("") + "</w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{p('First')}{p(' ')}{table}{p('Second')}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}>{p('top')}</w:hdr>")
        z.writestr("docProps/core.xml", CORE)


def xlsx(path):
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} {r}><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>name</t></si><si><r><t>x</t></r><r><t>y</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {s}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"/></row><row><c r="A3"><v>1</v></c><c r="B3"><v>2.5</v></c><c r="C3" s="1"><v>45292</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {s}><sheetData/></worksheet>")


def test_docx_and_xlsx(tmp_path):
    docx(tmp_path / "a.docx")
    text, meta = parse_docx((tmp_path / "a.docx").read_bytes())
    assert text == "First\n\nSecond\n\n\n[TABLE]\na | b\n[/TABLE]"
    assert (meta["title"], meta["author"], meta["creation_date"], meta["paragraph_count"], meta["table_count"], meta["has_headers"]) == ("Deck", "Ann", "2024-01-02T03:04:05", 2, 1, True)
    xlsx(tmp_path / "a.xlsx")
    text, meta = parse_xlsx((tmp_path / "a.xlsx").read_bytes())
    assert text == "[SHEET:One]\nname |  | xy\n1 | 2.5 | 2024-01-01 00:00:00\n\n[SHEET:Two]"
    assert (meta["sheet_count"], meta["total_rows"], meta["total_columns"]) == (2, 2, 3)
    assert parse_xlsx(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest")[1] == {"parse_warning": "password_protected"}


def test_pdf_pages():
    assert pdf_text([" a ", "", None, "b"]) == ("[PAGE:1]\na\n\n[PAGE:2]\n\n[PAGE:3]\n\n[PAGE:4]\nb", [3])


def test_load(spark, tmp_path):
    root = tmp_path / "in" / "sub dir"
    root.mkdir(parents=True)
    (root / "a.md").write_text('---\ntitle: "T"\nTags: [a, \'b\']\nempty:\n# c\n---\n# H1\n\n###\n- x\n999. y\n[l](u)\n```\n```\n')
    (root / "b.txt").write_bytes("caf\xe9 “q”".encode("cp1252"))
    (root / "c.txt").write_bytes(b"a\x81b")
    (root / "UP.TXT").write_text("not discovered")
    (root / "bad.docx").write_bytes(b"zip?")
    docx(root / "d.docx")
    files = discover(spark, str(tmp_path / "in"))
    documents, failures = load(files)
    got = {r.relative_path: r for r in documents.collect()}
    assert sorted(got) == ["sub dir/a.md", "sub dir/b.txt", "sub dir/c.txt", "sub dir/d.docx"]
    a = got["sub dir/a.md"]
    assert (a.doc_id, a.title, a.tags, a.h1, a.h3, a.list_items, a.link_count, a.code_blocks, a.has_frontmatter) == ("sub-dir-a-md", "T", '["a","b"]', 2, 1, 2, 1, 1, True)  # the note in the front matter counts as a header
    assert a.text.startswith("---\ntitle")
    b = got["sub dir/b.txt"]
    assert (b.text, b.encoding_fallback, b.title, b.line_count) == ('café "q"', "cp1252", "b", 1)
    assert got["sub dir/c.txt"].encoding_fallback == "iso-8859-1"
    assert got["sub dir/d.docx"].title == "Deck"
    bad = failures.collect()
    assert [(os.path.basename(r.source_path), r.error_type) for r in bad] == [("bad.docx", "ParseError")]


def run(spark, tmp_path, **more):
    return ingest(spark, IngestConfig(str(tmp_path / "in"), str(tmp_path / "out"), ChunkConfig(40), **more))


def test_ingest_is_idempotent(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    assert run(spark, tmp_path)["processed"] == 0
    for n in range(3):
        (root / f"f{n}.txt").write_text(f"Text number {n}. " * 20)
    first = run(spark, tmp_path)
    assert (first["processed"], first["skipped"], first["failed"]) == (3, 0, 0)
    before = {r.chunk_id: r.text for r in read_chunks(spark, str(tmp_path / "out")).collect()}
    assert len(before) == first["total_chunks"]
    again = run(spark, tmp_path)
    assert (again["processed"], again["skipped"], again["total_chunks"]) == (0, 3, 0)
    assert {r.chunk_id: r.text for r in read_chunks(spark, str(tmp_path / "out")).collect()} == before
    (root / "f1.txt").write_text("Changed.")
    assert run(spark, tmp_path)["processed"] == 1
    after = {r.chunk_id: r.text for r in read_chunks(spark, str(tmp_path / "out")).collect()}
    assert [t for c, t in after.items() if c.startswith("f1-txt")] == ["Changed."]
    assert {c: t for c, t in after.items() if not c.startswith("f1-")} == {c: t for c, t in before.items() if not c.startswith("f1-")}
    (root / "f0.txt").unlink()
    assert run(spark, tmp_path)["cleaned_up"] == 0
    assert run(spark, tmp_path, cleanup_orphans=True)["cleaned_up"] == 1
    assert {r.doc_id for r in read_chunks(spark, str(tmp_path / "out")).select("doc_id").collect()} == {"f1-txt", "f2-txt"}


def test_failures_retry_and_collisions(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "ok.txt").write_text("fine")
    (root / "x.pdf").write_bytes(b"no pdf")
    report = run(spark, tmp_path)
    assert (report["processed"], report["failed"]) == (1, 1)
    assert run(spark, tmp_path, retry_failed=True, parsers={".pdf": lambda raw: ("[PAGE:1]\nnow", {"page_count": 1})})["processed"] == 1
    assert {r.doc_id for r in read_chunks(spark, str(tmp_path / "out")).select("doc_id").collect()} == {"ok-txt", "x-pdf"}
    (root / "y.pdf").write_bytes(b"no pdf")
    with pytest.raises(RuntimeError):
        run(spark, tmp_path, fail_fast=True)
    (root / "ok!txt.txt").write_text("1")
    (root / "ok-txt.txt").write_text("2")
    with pytest.raises(SlugCollision):
        run(spark, tmp_path)


def test_index_and_ask(spark, tmp_path, capsys):
    root = tmp_path / "in"
    root.mkdir()
    topics = {"space": "rockets reach orbit around planets", "food": "bread and cheese taste good", "music": "violins play a quiet song"}
    for name, text in topics.items():
        (root / f"{name}.md").write_text(f"# {name}\n\n{text}")
    run(spark, tmp_path)
    out, idx = str(tmp_path / "out"), str(tmp_path / "idx")
    report = build_index(spark, IndexConfig(out, idx))
    assert report == {"indexed_docs": 3, "indexed_chunks": 3, "skipped_docs": 0, "failed_chunks": 0}
    ids = {r.id for r in state.Store(spark, idx).read("pilot-docs").collect()}
    assert build_index(spark, IndexConfig(out, idx, doc_filter=["food-md", "none"]))["skipped_docs"] == 1
    assert {r.id for r in state.Store(spark, idx).read("pilot-docs").collect()} == ids
    questions = spark.createDataFrame([(1, "which cheese and bread?"), (2, "rockets in orbit")], "query_id int, question string")
    hits, prompts = ask(spark, idx, questions, 1)
    assert {r.query_id: r.doc_id for r in hits.collect()} == {1: "food-md", 2: "space-md"}
    assert "[1] (food.md | section: food)\n" in prompts.where("query_id = 1").first().context
    rows = state.Store(spark, idx).read("pilot-docs")
    found = I.verify(rows.withColumn("timestamp", F.col("timestamp")), 10).first()
    assert found.verified_chunks == 3 and found.field_coverage["section"] == 100.0
    store = state.Store(spark, idx)
    assert I.health(store, "pilot-docs").document_count == 3
    assert not I.health(store, "nope").healthy
    assert not I.health(state.Store(spark, str(tmp_path / "none"))).healthy
    assert cli.main(["query", idx, "bread and cheese", "-k", "1"], spark) == 0
    assert "doc_id=food-md" in capsys.readouterr().out
    assert cli.main(["chat", idx, "bread and cheese", "--provider", "echo", "--json"], spark) == 0
    assert '"answer": "bread and cheese"' in capsys.readouterr().out
    assert cli.main(["health", idx, "--collection", "pilot-docs"], spark) == 0
    assert cli.main(["ingest", str(root), str(tmp_path / "out2"), "--no-bullets", "--preset", "minimal"], spark) == 0
    assert cli.main(["index", str(tmp_path / "out2"), str(tmp_path / "idx2"), "--verify"], spark) == 0


def test_state_operators(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, n int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 2)], "doc_id string, n int")
    rows = lambda d: sorted(map(tuple, d.select("doc_id", "n").collect()))
    assert rows(state.replace_by_key(old, new)) == [("a", 1), ("b", 2), ("b", 3), ("c", 2)]
    assert rows(state.upsert(old, new, "doc_id", "n")) == [("a", 1), ("b", 3), ("c", 2)]
    assert rows(state.delete_where(old, doc_id="a")) == [("b", 1)]
    assert rows(state.replace_by_key(old, new.limit(0))) == [("a", 1), ("b", 1)]


def test_chunkless_documents_drop_out(spark):
    manifest = spark.createDataFrame([("a", "/a"), ("b", "/b")], "doc_id string, source_path string")
    chunks = spark.createDataFrame([("a", 0, "x")], "doc_id string, chunk_index int, text string")
    assert [tuple(r) for r in I.flatten(manifest, chunks).collect()] == [("a", "/a", 0, "x")]


def test_store_pointers(spark, tmp_path):
    """A lost write leaves the last version, a reader of the replaced one still reads it, and a broken pointer is no empty table."""
    store, rows = state.Store(spark, str(tmp_path)), lambda d: sorted(r.n for r in d.collect())
    frame = lambda *ns: spark.createDataFrame([(n,) for n in ns], "n int")
    assert rows(store.read("t", "n int")) == []
    store.write("t", frame(1))
    reader = store.read("t")
    store.write("t", frame(2))
    assert rows(reader) == [1] and rows(store.read("t")) == [2]
    # A run lost before its pointer is renamed: the data and the pointer aside exist, nothing points to them.
    frame(3).write.parquet(str(tmp_path / "t" / "lost"))
    (tmp_path / "t" / "lost.tmp").write_text('{"version": "lost"}')
    assert rows(store.read("t", "n int")) == [2]
    store.write("t", frame(4))
    assert rows(store.read("t")) == [4] and store.tables() == ["t"]
    last = max((tmp_path / "t").glob("pointer-*.json"))
    (tmp_path / "t" / f".{last.name}.crc").unlink(missing_ok=True)
    last.write_text("")
    with pytest.raises(ValueError):
        store.read("t", "n int")


def test_stream_and_batch_agree(spark, tmp_path):
    from corpusloom.streaming.ingest import stream_chunks

    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("One  line.\n\nPage 3\n\nCONFIDENTIAL\n\nTwo.")
    (root / "sub" / "b.md").write_text("---\ntitle: T\n---\n# H\n\ntext \u201cq\u201d\n")
    (root / "skipped.bin").write_bytes(b"\x00")
    ingest(spark, IngestConfig(str(root), str(tmp_path / "batch")))
    stream_chunks(spark, str(root), str(tmp_path / "stream"), str(tmp_path / "cp")).awaitTermination()
    rows = lambda out: sorted(tuple(r) for r in read_chunks(spark, str(tmp_path / out)).select("doc_id", "chunk_id", "text").collect())
    assert len(rows("batch")) == 2 and rows("batch") == rows("stream")
    # The same folder once more as a batch run on the streamed store: nothing changes.
    assert ingest(spark, IngestConfig(str(root), str(tmp_path / "stream")))["skipped"] == 2


def test_manifest_file(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"d": {"content_hash": "h", "source_path": "/d", "metadata": {"title": "t"}}}')
    row = read_manifest(spark, str(tmp_path / "m.json")).first()
    assert (row.doc_id, row.content_hash, row.metadata["title"]) == ("d", "h", "t")
    with pytest.raises(FileNotFoundError):
        read_manifest(spark, str(tmp_path / "none.json"))

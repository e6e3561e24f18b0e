"""The PDF reader and its data source, held against the lines that were written."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import pandas as pd
import pytest

from clausewright.plans.queries import QUERIES
from clausewright.sources.files import chosen_pages, extract_documents, page_table, pages_of
from clausewright.sources.pdf import Font, Pdf, PdfReader, Run, _filtered, glyph, laid_out, operations, pdf_pages, scan_pdf, unicode_map
from clausewright.sources.pdf_writer import pdf_file
from clausewright.sources.shared import write_files


def some_pages(choose, letters):
    line = lambda: " ".join("".join(choose.choice(letters) for _ in range(choose.randint(1, 9))) for _ in range(choose.randint(1, 8)))
    return [[line() for _ in range(choose.randint(0, 12))] for _ in range(choose.randint(0, 30))]


@pytest.mark.parametrize("letters", ["abc()\\<>%/[]", "aé§ß–", "a日本\U0001f600é"])
@pytest.mark.parametrize("compact", [False, True])
@pytest.mark.parametrize("by_word", [False, True])
def test_pages_come_back(letters, compact, by_word):
    choose = random.Random(f"{letters}{compact}{by_word}")
    for _ in range(15):
        pages = some_pages(choose, letters)
        expected = [(i, "\n".join(lines)) for i, lines in enumerate(pages, 1)]
        content = pdf_file(pages, compact, by_word)
        assert list(pdf_pages(content)) == expected and Pdf(content).page_count() == len(pages)
        first = choose.randint(0, len(pages))
        last = choose.randint(first, len(pages))
        assert list(pdf_pages(content, first, last)) == expected[first:last]
        # Without usable cross references the objects are searched for.
        assert list(pdf_pages(content.replace(b"startxref", b"startxxxx"))) == expected
        assert list(pdf_pages(b"moved by some bytes\n" + content)) == expected


def test_a_broken_page_is_left_out_and_a_broken_file_is_an_error():
    pages = [["one"], ["two"], ["three"]]
    assert list(pdf_pages(pdf_file(pages, broken=(2,)))) == [(1, "one"), (3, "three")]
    for content in (b"", b"%PDF-1.4 nothing", pdf_file(pages).replace(b"/Root 1 0 R >>", b"/Root 1 0 R /Encrypt 9 0 R >>")):
        with pytest.raises(ValueError):
            list(pdf_pages(content))


def test_later_sections_replace_objects():
    content = pdf_file([["old text"]])
    body = b"BT /F1 10 Tf 1 0 0 1 40 700 Tm (new ) Tj (text) Tj ET"
    at = len(content)
    update = b"7 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(body), body)
    old = int(content.rsplit(b"startxref\n", 1)[1].split()[0])
    table = b"xref\n7 1\n%010d 00000 n \ntrailer\n<< /Size 9 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (at, old, at + len(update))
    page = next(n for n in (7, 8) if isinstance(Pdf(content).places.get(n), int) and b"(old text)" in content[Pdf(content).places[n] : Pdf(content).places[n] + 120])
    assert list(pdf_pages(content + (update + table).replace(b"7 0 obj", b"%d 0 obj" % page).replace(b"xref\n7 1", b"xref\n%d 1" % page))) == [(1, "new text")]


def test_operators_move_the_text():
    """Two columns of words in any order of drawing, forms, and lines by Td, TD, T*, ' and \"."""
    from clausewright.sources.pdf import runs_of

    shown = b'BT /F1 10 Tf 12 TL 100 700 Td (right) Tj -60 0 Td (left) Tj 0 -20 TD (a) Tj T* (b) Tj (c) \' 0 0 (d) " ET q 1 0 0 1 0 -400 cm BT 1 0 0 1 40 700 Tm [(x) -50 (y) -900 (z)] TJ ET Q % end'
    pdf = Pdf(pdf_file([["any"]]))
    runs = list(runs_of(pdf, shown, {"Font": {"F1": {"Subtype": "Type1"}}}))
    assert laid_out(runs) == "left right\na\nb\nc\nd\nxy z"


def test_words_of_the_format():
    found = [(w, args) for w, args, _ in operations(b"/A#42 <4a4> (a\\(b\\051\\n(c)) -.5 +3 [1 [2]] << /K 1 0 R >> true null x BI /W 1 ID \x00\xff EI y")]
    assert found[0] == (b"x", ["AB", b"J@", b"a(b)\n(c)", -0.5, 3, [1, [2]], {"K": (1, 0)}, True, None])
    assert [w for w, _ in found] == [b"x", b"BI", b"ID", b"y", b""]
    texts, sizes = unicode_map(b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfrange <01> <03> <0041> <05> <06> [<0058> <00590059>] endbfrange 1 beginbfchar <09> <D83DDE00> endbfchar")
    assert texts == {b"\x01": "A", b"\x02": "B", b"\x03": "C", b"\x05": "X", b"\x06": "YY", b"\x09": "😀"} and sizes == {1}
    assert [glyph(n) for n in ("eacute", "A", "hyphen", "uni00e9", "u1F600", "Udieresis", "none such")] == ["é", "A", "-", "é", "😀", "Ü", ""]
    assert [t for t, _, _ in Font({b"a": "z"}, {}, 500, 1, "cp1252").shown(b"a\x80")] == ["z", "€"]


def test_filters_and_predictors():
    rows = [bytes(random.Random(i).randrange(256) for _ in range(6)) for i in range(5)]
    plain, above, coded = b"".join(rows), bytes(6), b""
    for how, row in zip((0, 1, 2, 3, 4), rows):
        left = lambda r, i: r[i - 2] if i > 1 else 0
        guess = {0: lambda i: 0, 1: lambda i: left(row, i), 2: lambda i: above[i], 3: lambda i: (left(row, i) + above[i]) // 2}.get(how)
        paeth = lambda i: min((left(row, i), above[i], left(above, i)), key=lambda x: abs(left(row, i) + above[i] - left(above, i) - x))
        coded += bytes([how]) + bytes((row[i] - (guess or paeth)(i)) & 255 for i in range(6))
        above = row
    assert _filtered(zlib.compress(coded), "FlateDecode", {"Predictor": 15, "Colors": 2, "Columns": 3}) == plain
    assert _filtered(b"4 1 42 4>", "ASCIIHexDecode", {}) == b"AB@" and _filtered(base64.a85encode(b"Hello w") + b"~>", "ASCII85Decode", {}) == b"Hello w"
    with pytest.raises(ValueError):
        _filtered(b"", "DCTDecode", {})


def test_lines_keep_their_order():
    runs = [Run(50, 100, 60, 10, "b"), Run(10, 100.5, 20, 10, "a"), Run(10, 80, 20, 10, "c"), Run(20.5, 80, 30, 10, "d"), Run(5, 60, 9, 10, "  ")]
    assert laid_out(runs) == "a b\ncd"


def test_files_are_read_by_ranges_of_pages(spark, tmp_path):
    choose = random.Random(6)
    files = {f"{i}.pdf": some_pages(choose, "abé日") for i in range(6)} | {"deep/long.PDF": [[f"page {i}"] * 30 for i in range(300)]}
    rows = [(path, pdf_file(pages, i % 2 == 0)) for i, (path, pages) in enumerate(files.items())]
    (tmp_path / "deep").mkdir()
    assert write_files(spark.createDataFrame([*rows, ("broken.pdf", b"no file"), ("note.txt", b"x")], "path string, content binary"), str(tmp_path)) == 9
    pages = scan_pdf(spark, str(tmp_path), 5000)
    assert pages.rdd.getNumPartitions() > 5
    got = sorted((r["path"].removeprefix(f"{tmp_path}/"), r["page_no"], r["text"]) for r in pages.collect())
    expected = sorted((path, i, "\n".join(lines)) for path, own in files.items() for i, lines in enumerate(own, 1))
    assert [r for r in got if r[1]] == expected
    assert [(r[0], r[2][:6]) for r in got if not r[1]] == [("broken.pdf", "error:")]
    one = scan_pdf(spark, f"file://{tmp_path}/0.pdf").filter("page_no = 1").collect()
    assert [r["text"] for r in one] == ["\n".join(files["0.pdf"][0])]


def test_the_text_layer_in_the_dispatch(spark):
    rows = [("a.pdf", pdf_file([["words enough for a page of its own"], []])), ("b.pdf", pdf_file([[]])), ("c.pdf", b"broken")]
    files = spark.createDataFrame(rows, "path string, content binary")
    layer = pages_of(files, pdf_pages)
    assert [tuple(r) for r in layer.filter("page_no > 0").orderBy("path", "page_no").collect()] == [("a.pdf", 1, "words enough for a page of its own"), ("a.pdf", 2, ""), ("b.pdf", 1, "")]
    read = spark.createDataFrame([("a.pdf", 1, "no"), ("a.pdf", 2, "recognised")], "path string, page_no int, text string")
    assert [tuple(r) for r in chosen_pages(layer, read).orderBy("page_no").collect()] == [("a.pdf", 1, "words enough for a page of its own"), ("a.pdf", 2, "recognised")]
    found = {r["path"]: (r["raw_text"], r["num_pages"], r["source_type"]) for r in extract_documents(files, pdf_pages).collect()}
    assert found["a.pdf"] == ("words enough for a page of its own\n", 2, "scanned") and found["b.pdf"][1:] == (1, "scanned") and found["c.pdf"] == ("", 0, "scanned")
    spark.udtf.register("pdf_layer", page_table(pdf_pages))
    files.createOrReplaceTempView("pdf_files")
    assert spark.sql("SELECT path, page_no FROM pdf_files, LATERAL pdf_layer(content) WHERE text <> ''").collect() == [("a.pdf", 1)]


def test_many_small_parts_are_few_tasks(spark, tmp_path):
    """parts of a folder of many files are bundled, in order, and give the same pages; each file is read once a task."""
    for i in range(60):
        (tmp_path / f"{i:02}.pdf").write_bytes(pdf_file([[f"file {i} page {k}"] for k in range(12)]))
    fine, few = PdfReader(str(tmp_path), 1000, 10_000).partitions(), PdfReader(str(tmp_path), 1000, 7).partitions()
    assert len(fine) > 60 and len(few) <= 7 and [s for p in few for s in p.shares] == [s for p in fine for s in p.shares]
    pages = lambda parts, reader: sorted(row for p in parts for row in reader.read(p))
    reader = PdfReader(str(tmp_path), 1000)
    assert pages(few, reader) == pages(fine, reader) and len(pages(few, reader)) == 720
    assert scan_pdf(spark, str(tmp_path), 1000).rdd.getNumPartitions() <= 400


def test_pages_leave_a_task_some_at_a_time(spark, monkeypatch):
    """the pages of a batch of files are not one table."""
    seen = []
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.mapInPandas", lambda self, run, schema: seen.append(run))
    pages_of(spark.createDataFrame([("a", b"x")], "path string, content binary"), lambda content: iter([(k, "x" * 1000) for k in range(1, 1001)]))
    batch = pd.DataFrame({"path": [f"{i}.pdf" for i in range(20)], "content": [b"x"] * 20})
    out = list(seen[0](iter([batch])))
    assert sum(map(len, out)) == 20_000 and max(map(len, out)) <= 3000


def test_files_are_decoded_once(spark):
    """text, number of pages and kind of a file come from one pass over it."""
    held = spark.createDataFrame([("a.pdf", b"1"), ("b.pdf", b"2")], "path string, content binary")
    plan = extract_documents(held, lambda content: iter([(1, "x" * 200), (2, "y")]))
    assert plan._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert [(r["raw_text"], r["num_pages"], r["source_type"]) for r in plan.collect()] == [("x" * 200 + "\ny", 2, "digital")] * 2


def test_every_file_has_its_row(spark, tmp_path):
    """documents without a line or text, whose files have no pages, are rows too; lines of odd white space are lines."""
    texts = [(1, "a line"), (2, ""), (3, None), (4, " \t\n\x01"), (5, "x\n\u00a0\ny"), (6, "\u3000")]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["digest"], r["num_pages"], r["source_type"]) for r in QUERIES["pdf_extract"](spark, str(tmp_path)).collect()}
    shown = {1: "a line", 2: "", 3: "", 4: "", 5: "x\n\u00a0\ny", 6: "\u3000"}
    assert found == {i: (hashlib.md5(t.encode()).hexdigest(), int(t != ""), "scanned") for i, t in shown.items()}


def test_want_of_memory_is_no_fault_of_a_page(monkeypatch):
    """a page that found no memory was left out in silence; now the task fails and runs again."""

    def full(pdf, page):
        raise MemoryError

    monkeypatch.setattr("clausewright.sources.pdf.page_text", full)
    with pytest.raises(MemoryError):
        list(pdf_pages(pdf_file([["one"]])))


def test_files_are_made_once_and_do_not_move(spark, small):
    """one pass writes the files, one reads them, and their texts are joined where they are read."""
    plan = QUERIES["pdf_extract"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("MapInPandas") == 1 and "Exchange" not in plan


def test_objects_of_a_stream_are_read_by_themselves(monkeypatch):
    """an object of a stream was read with all that follow it, and the stream unpacked for each."""
    seen = []
    monkeypatch.setattr("clausewright.sources.pdf.zlib", type("Z", (), {"decompressobj": staticmethod(lambda: seen.append(1) or zlib.decompressobj()), "error": zlib.error}))
    pages = [[f"line {i}"] for i in range(200)]
    assert [t for _, t in pdf_pages(pdf_file(pages, compact=True))] == [p[0] for p in pages]
    assert len(seen) < 250  # a stream a page, one of objects, the cross references and the font


def test_whole_strings_are_their_codes():
    """strings that are looked up whole have the text, width and blanks of their codes."""
    fonts = [Font({b"a": "z"}, {97: 700}, 500, 1, "cp1252"), Font({b"\x00a": "日"}, {97: 250}, 500, 2), Font({b"abc": "é"}, {}, 500, 3), Font({}, {}, 600, 1, "mac_roman")]
    for font in fonts:
        for data in (b"", b"a", b"a b\x81 a", b"\x00a\x00b", b"abcabc", b"a" * 40):
            parts = list(font.shown(data))
            text, ems, codes, blanks = font.whole(data)
            assert (text, codes, blanks) == ("".join(t for t, _, _ in parts), len(parts), sum(b for _, _, b in parts))
            assert ems == pytest.approx(sum(w for _, w, _ in parts)) and font.whole(data) == (text, ems, codes, blanks)

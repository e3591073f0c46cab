"""Mixed-format folders through converters, and scanned pages through OCR, with stub models."""

from pyspark.sql import functions as F

from docquarry.operators import adapters as ad
from docquarry.sources import convert as cv
from docquarry.sources import files as fl


def stub():
    """A converter that cuts pages at form feeds and fails on broken files; local, so that workers get it whole."""

    def convert(path, content):
        if content.startswith(b"%broken"):
            raise ValueError("no pages here")
        return content.decode().split("\f")

    return convert


pages_of = stub()


def folder(tmp_path):
    files = {
        "b.pdf": b"page one\f\fpage three", "a.txt": b"plain \xff text", "c.pdf": b"%broken", "d.docx": b"only page", "e.pdf": b"",
        "f.md": b"", "g.pptx": b"\f \f", "h.bin": b"ignored",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def test_converted_folder(spark, tmp_path):
    found = {r.path.rsplit("/", 1)[1]: r for r in cv.read_converted(spark, folder(tmp_path), pages_of).collect()}
    plain = {r.path.rsplit("/", 1)[1]: r for r in fl.read_corpus(spark, str(tmp_path)).collect()}
    assert {n: r.doc_pos for n, r in found.items()} == {n: r.doc_pos for n, r in plain.items()}
    assert found["b.pdf"].text == "page one\n\npage three" and found["b.pdf"].n_pages == 3
    assert found["a.txt"].text == "plain  text" and found["a.txt"].n_pages is None
    assert found["c.pdf"].text == "[Extracted from .pdf document] c.pdf" and found["c.pdf"].error == "ValueError: no pages here"
    assert found["d.docx"].text == "only page" and found["e.pdf"].text == "" and found["f.md"].text == ""
    assert found["g.pptx"].text == "[Extracted from .pptx document] g.pptx" and found["g.pptx"].error is None


def test_robustness_by_format(spark, tmp_path):
    read = cv.read_converted(spark, folder(tmp_path), pages_of)
    found = {r.suffix: (r.files, r.failures, r.success_pct, r.robustness_pct) for r in cv.format_robustness(read).collect()}
    pdf = round(100 * 2 / 3, 4)
    mean = round((pdf + 4 * 100) / 5, 4)
    assert found == {".pdf": (3, 1, pdf, mean), **{s: (1, 0, 100.0, mean) for s in (".txt", ".docx", ".md", ".pptx")}}


def test_pages_of_a_stream_equal_those_of_the_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path, out, state = folder(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    kind = "path string, modificationTime timestamp, length long, content binary"
    for name in ("", "z.pdf"):
        if name:
            (tmp_path / "in" / name).write_bytes(b"late\fpages")
        stream = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", "*.pdf").load(path)
        cv.convert_pages(stream, pages_of).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    batch = cv.convert_pages(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path), pages_of)
    rows = [sorted(map(tuple, df.collect()), key=str) for df in (spark.read.parquet(out), batch)]
    assert rows[0] == rows[1] and len(rows[0]) == 6


def test_scanned_pages_are_read_and_appended(spark):
    kind = "document_id string, page_no int, type string, text string, modality string"
    regions = spark.createDataFrame([("d", 1, "body", "x" * 30, "text"), ("d", 2, "body", "few", "text"), ("d", -1, "title", "y" * 99, "text"), ("w", 1, "body", "", "text")], kind)
    images = [("d", n, True, f"scan {n}".encode(), "in/d.PDF") for n in (1, 2, 3)] + [("d", 4, True, b"  ", "in/d.PDF"), ("d", 5, False, b"none", "in/d.PDF"), ("w", 1, True, b"word", "in/w.docx")]
    pages = spark.createDataFrame(images, "document_id string, page_no int, has_image boolean, image binary, path string")
    found = ad.with_ocr(regions, pages, lambda: None, lambda _, xs: [bytes(x).decode().upper() for x in xs])
    added = {(r.document_id, r.page_no, r.text, r.type, r.modality) for r in found.filter(F.col("layout_source") == "ocr").collect()}
    assert added == {("d", 2, "SCAN 2", "body", "text"), ("d", 3, "SCAN 3", "body", "text")}
    assert found.count() == 6 and found.filter("layout_source is null").select(regions.columns).exceptAll(regions).count() == 0

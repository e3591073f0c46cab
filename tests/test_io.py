"""Files, corpus reload, streaming, adapters, configuration and end-to-end answers."""

import json

from pyspark.sql import functions as F

from docquarry.config import EngineConfig
from docquarry.operators import adapters as ad
from docquarry.operators import index as ix
from docquarry.operators import segment as sg
from docquarry.operators import segments as seg
from docquarry.operators import sparse as sp
from docquarry.operators import tablesql as ts
from docquarry.plans import answer as an
from docquarry.plans import hybrid as hy
from docquarry.sources import corpus as cp
from docquarry.sources import files as fl
from docquarry.streaming import ingest as si
from test_values import SAMPLE


def write_samples(folder):
    folder.mkdir()
    (folder / "b.txt").write_text(SAMPLE)
    (folder / "A.txt").write_text("Notes\nPlain body about the company overview and revenue growth in the year.\n")
    (folder / "page.html").write_text("<p>kept as is</p>")
    (folder / "scan.pdf").write_bytes(b"%PDF")
    (folder / "empty.docx").write_bytes(b"")
    (folder / "bad.md").write_bytes(b"ok \xff bytes")
    (folder / "skip.bin").write_bytes(b"x")


def test_read_corpus(spark, tmp_path):
    write_samples(tmp_path / "in")
    rows = fl.read_corpus(spark, str(tmp_path / "in")).orderBy("doc_pos").collect()
    names = [r.path.split("/")[-1] for r in rows]
    assert names == ["A.txt", "b.txt", "bad.md", "page.html", "scan.pdf", "empty.docx"]
    assert [r.doc_pos for r in rows] == list(range(6))
    texts = dict(zip(names, (r.text for r in rows)))
    assert texts["page.html"] == "<p>kept as is</p>" and texts["bad.md"] == "ok  bytes"
    assert texts["empty.docx"] == ""
    assert texts["scan.pdf"] == "[Extracted from .pdf document] scan.pdf"


def test_reload_skips_the_build(spark, tmp_path):
    write_samples(tmp_path / "in")
    out = str(tmp_path / "corpus")
    built = []

    def build():
        built.append(1)
        return cp.nested_documents(sg.with_regions(fl.read_corpus(spark, str(tmp_path / "in"))))

    first = cp.region_rows(cp.load_or_build(spark, out, build)).count()
    again = cp.load_or_build(spark, out, build)
    assert built == [1] and cp.region_rows(again).count() == first
    table = cp.region_rows(again).filter("type = 'table'").collect()[0].table
    assert table.columns == ["Quarter", "Region", "Revenue"] and len(table.rows) == 2
    assert cp.chunk_rows(again).count() == first
    cp.load_or_build(spark, out, build, force=True)
    assert built == [1, 1]


def test_log_and_index_sinks(spark, tmp_path):
    log = str(tmp_path / "log")
    df = spark.createDataFrame(
        [("q", "s", "boom", (["a"], [["1"], ["2"], ["3"], ["4"]])), ("q", "s", None, (["a"], []))],
        "query string, generated_sql string, error string, table struct<columns:array<string>,rows:array<array<string>>>",
    )
    for _ in range(2):
        cp.append_failures(ts.failure_records(df), log)
    rows = spark.read.json(log).collect()
    assert len(rows) == 2 and len(rows[0].sample_rows) == 3
    units = spark.createDataFrame([("text", 1, "alpha beta alpha"), ("table", 2, "beta")], "modality string, doc_pos long, text string")
    index = sp.SparseIndex(str(tmp_path / "postings"), ("doc_pos",), ("modality",))
    sp.write_segment(units, index)
    back = sp.read_blocks(spark, index).filter("modality = 'text' and term = 'alpha'").collect()
    assert [(r.n, [tuple(d) for d in r.docs]) for r in back] == [(1, [(2, 3, 1)])]
    cp.write_metrics(units.agg(F.count("*").alias("n")), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).collect()[0].n == 2


def test_stream_in_two_steps_equals_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "doc_pos long, path string, text string"
    docs = spark.createDataFrame([(i, f"d/{i}.txt", SAMPLE + f"\nextra line {i}") for i in range(6)], schema)
    for part in (docs.filter("doc_pos < 4"), docs.filter("doc_pos >= 4")):
        part.write.mode("append").parquet(source)
        si.start_chunks(si.document_stream(spark, source, schema), out, state, once=True).awaitTermination()
        si.start_postings(si.document_stream(spark, source, schema), out + "-p", state + "-p", once=True).awaitTermination()
    want = sg.region_chunks(sg.segment(docs))
    got = spark.read.parquet(out).select(want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    keys = ["modality", "doc_pos", "region_idx"]
    batch = ix.postings(ix.tokenised(sg.segment(docs), keys), keys)
    blocks = sp.read_blocks(spark, seg.index_at(out + "-p"))
    rows = blocks.filter("term is not null").select("modality", "term", F.inline("docs")).select(batch.columns)
    assert {r.segment for r in blocks.select("segment").distinct().collect()} == {0, 1}
    assert rows.count() == batch.count() and rows.exceptAll(batch).count() == 0


def test_adapters_with_stub_models(spark):
    df = spark.createDataFrame([("d", 0, "q", "hello world", "text", 11)], "document_id string, page_no int, query string, text string, modality string, body_len int")
    enc = ad.encode(df, lambda: 2, lambda m, xs: [[float(len(x) * m)] for x in xs]).collect()[0]
    assert enc.embedding == [22.0]
    ranked = ad.cross_encoder_scores(df, lambda: None, lambda m, a, b: [float(len(x)) for x in b]).collect()[0]
    assert ranked.rank_score == 5.5
    ocr = ad.ocr_regions(df.withColumn("image", F.lit(bytearray(b"abc"))), lambda: None, lambda m, xs: [" seen " for _ in xs])
    assert ocr.collect()[0].text == "seen"
    files = spark.createDataFrame([("f.pdf", bytearray(b"x"))], "path string, content binary")
    item = {"item_type": "TextItem", "markdown": "", "item_text": "para", "orig": None, "provenance": []}
    regions = ad.parse_layout(files, lambda: None, lambda m, p, c: [item, {**item, "item_type": "PageItem"}]).collect()
    assert [(r.type, r.text, r.page_no) for r in regions] == [("body", "para", -1)]
    assert ad.generate(df.withColumn("prompt", F.lit("p")), lambda: None, lambda m, xs: [x + "!" for x in xs]).collect()[0].raw_answer == "p!"


def test_config(tmp_path):
    fast = EngineConfig.load_preset("latency_optimized")
    assert (fast.reranker.final_top_k, fast.attribution.enable_nli, fast.generation.max_context_tokens) == (3, False, 2048)
    assert EngineConfig.load_preset("quality_max").generation.max_context_tokens == 8192
    assert EngineConfig.load_preset("unknown").reranker.final_top_k == 5
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"preset": "quality_max", "retrieval": {"rrf_k": 10, "nope": 1}}))
    env = {"DOCQUARRY_RERANKER_FINAL_TOP_K": "4", "DOCQUARRY_ENABLE_NLI": "no", "DOCQUARRY_SHORT_HEADING_CHAR_THRESHOLD": "x"}
    cfg = EngineConfig.load(str(path), env)
    assert (cfg.retrieval.rrf_k, cfg.reranker.final_top_k, cfg.attribution.enable_nli) == (10, 4, False)
    assert (cfg.reranker.short_heading_char_threshold, cfg.generation.max_context_tokens) == (45, 8192)
    other = cfg.for_query({"final_top_k": 9, "no_such": "legal"})
    assert (other.reranker.final_top_k, other.generation.max_context_tokens, cfg.reranker.final_top_k) == (9, 8192, 4)


def test_answers_end_to_end(spark, tmp_path):
    write_samples(tmp_path / "in")
    regions = sg.segment(fl.read_corpus(spark, str(tmp_path / "in")))
    queries = [(1, "revenue by region"), (2, "zzz"), (3, "sum of revenue table")]
    hits = hy.hybrid_retrieve(regions, queries).collect()
    assert all(h.rank_score is not None for h in hits) and any(h.modality == "table" for h in hits)
    rows = {r.query_id: r for r in an.answer_queries(regions, queries).collect()}
    assert rows[1].sql_query == "SELECT * FROM doc_table" and "**Quarter: Q1, Region: North, Revenue: 100M**" in rows[1].answer
    assert rows[2].answer.startswith("No relevant context") and rows[2].evidence == []
    assert rows[1].total_claims >= 1 and rows[1].citations[0].chunk_id == "c-1"
    service = {r.query_id: r for r in an.service_answers(regions, queries).collect()}
    assert "[T1]" in service[1].answer and service[2].answer == "No supporting evidence found."


def test_streamed_table_of_several_files(spark, tmp_path):
    from docquarry.plans import inputs as I
    from docquarry.plans import source_queries as sq

    rows = [(i, f"Title {i}\n\nbody of {i}", "en", "web", 10) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/many/documents.parquet")
    (tmp_path / "one").mkdir()
    frame.toPandas().to_parquet(tmp_path / "one" / "documents.parquet")
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    many, one, none = (sq.stream_region_chunks(spark, f"{tmp_path}/{name}") for name in ("many", "one", "none"))
    assert many.count() == one.count() == I.regions(spark, f"{tmp_path}/many").count() > 6 and none.count() == 0 and many.dtypes == none.dtypes
    assert sorted(many.collect()) == sorted(one.collect())

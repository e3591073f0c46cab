"""Known inputs with known results, worked out by hand."""

import re

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import attribute as at
from docquarry.operators import chunk as ck
from docquarry.operators import fuse as fu
from docquarry.operators import generate as ge
from docquarry.operators import rank as rk
from docquarry.operators import retrieve as rv
from docquarry.operators import route as rt
from docquarry.operators import segment as sg
from docquarry.operators import tables as tb
from docquarry.operators import tablesql as ts
from docquarry.operators import evaluate as ev

SAMPLE = (
    "Quarterly Revenue Report\n\nRevenue rose in all regions.\n\nTable:\n| Quarter | Region | Revenue |\n"
    "| Q1 | North | 100M |\n| Q2 | South | 125M |\n\nFigure:\nBar chart of revenue by region.\n"
)


def strings(values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def grid(rows):
    return F.array(*[strings(r) for r in rows])


def header(rows):
    return F.array(*[F.array(*[F.struct(F.lit(t).alias("text"), F.lit(n).alias("colspan")) for t, n in r]) for r in rows])


def test_header_hierarchy(one):
    rows = [[("Revenue by Segment", 2), ("Operating Expenses", 1)], [("Q1 2024", 1), ("Q2 2024", 1), ("Total", 1)]]
    paths = tb.header_hierarchy(header(rows), F.lit(3))
    out = one(paths.alias("p"), F.transform(paths, tb.flatten_column_name).alias("n"))
    assert out.p[0] == ["Revenue by Segment", "Q1 2024"] and [len(p) for p in out.p] == [2, 2, 2]
    assert out.n[0] == "revenue_by_segment_q1_2024"


@pytest.mark.parametrize(
    "cell, number, text",
    [
        ("(1,234.50)", -1234.5, "-1234.5"),
        ("$5,000", 5000.0, "5000"),
        ("12.5%", 12.5, "12.5"),
        ("N/A", None, "N/A"),
        ("(7)", -7.0, "-7"),
        ("(-7)", 7.0, "7"),
        ("007", 7.0, "7"),
        (".5", 0.5, "0.5"),
        ("1.", 1.0, "1.0"),
        ("(", None, "("),
        ("", None, ""),
    ],
)
def test_numeric_cells(one, cell, number, text):
    out = one(tb.numeric_value(F.lit(cell)).alias("n"), tb.normalize_cell(F.lit(cell)).alias("t"))
    assert (out.n, out.t) == (number, text)


@pytest.mark.parametrize("text, unit", [("in thousands", 1000), ("(In Millions)", 10**6), ("in billions", 10**9), ("x", 1)])
def test_unit_multiplier(one, text, unit):
    assert one(tb.unit_multiplier(F.lit(text)).alias("u")).u == unit


@pytest.mark.parametrize(
    "values, kind",
    [
        (["100", "200", "300"], ts.INTEGER),
        (["100.50", "(50.25)", "300.00"], ts.DECIMAL),
        (["alpha", "beta"], ts.VARCHAR),
        (["1250", "5000"], ts.VARCHAR),
        (["N/A", "-"], ts.VARCHAR),
        (["N/A", "12"], ts.INTEGER),
    ],
)
def test_infer_type(one, values, kind):
    assert one(ts.infer_type(strings(values)).alias("k")).k == kind


def test_sum_template(one):
    columns, rows = strings(["region", "revenue_q1"]), grid([["north", "1500.5"], ["south", "2500"]])
    types = ts.infer_types(columns, rows)
    plan = ts.template_plan(F.lit("revenue total sum"), columns, types)
    out = one(
        ts.template_sql(plan).alias("sql"),
        ts.match_score(F.lit("revenue total sum"), columns).alias("score"),
        ts.template_result(plan, columns, rows, types).alias("rows"),
    )
    assert out.sql == 'SELECT SUM("revenue_q1") AS total_sum FROM doc_table'
    assert out.score == 0.6 and float(out.rows[0]["total_sum"]) == 4000.5


def test_quoted_identifiers(one):
    columns = strings(['we"ird', "x2024"])
    plan = ts.template_plan(F.lit("q"), columns, strings([ts.VARCHAR, ts.VARCHAR]))
    assert one(ts.template_sql(plan).alias("s")).s == 'SELECT "we""ird", "x2024" FROM doc_table'


def test_stub_realign(one):
    columns = strings(["note", "2019", "2018", "col_4"])
    rows = grid([["ASSETS", "", "", ""], ["Cash", "1", "2", "3"]])
    assert one(tb.sanitize_stub_columns(columns, rows).alias("c")).c == ["description", "note", "2019", "2018"]


def test_spatial_sort(one):
    cell = lambda t, x: F.struct(
        F.lit(0).alias("row"),
        F.lit(0).alias("col"),
        F.struct(F.lit(10.0).alias("y0"), F.lit(float(x)).alias("x0")).alias("bbox"),
        F.lit(t).alias("text"),
    )
    cells = F.array(cell("2019", 200), cell("ASSETS", 20), cell("2018", 300))
    assert [c.text for c in one(tb.spatial_sort(cells).alias("c")).c] == ["ASSETS", "2019", "2018"]


def test_table_scores(one):
    columns, rows = strings(["a", "b"]), grid([["1", "2"]])
    s = one(ev.table_scores(columns, rows, columns, rows).alias("s")).s
    assert (s.teds_structural_similarity, s.content_accuracy) == (1.0, 1.0)


def brute_enrich(rows):
    """Serialise a grid without Spark."""
    width = max(len(r) for r in rows)
    names, seen = [], {}
    for i in range(width):
        part = rows[0][i].strip() if i < len(rows[0]) else ""
        name = re.sub(r"[^a-zA-Z0-9]+", "_", (part or f"col_{i + 1}").lower()).strip("_") or "col"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")

    def number(cell):
        text = cell.strip()
        minus = len(text) > 1 and text[0] == "(" and text[-1] == ")"
        text = re.sub("[$,€£%]", "", text[1:-1] if minus else text).strip()
        try:
            value = float(text) if "." in text else int(text)
        except ValueError:
            return cell
        return -value if minus else value

    data = [[number(c) for c in r] for r in rows[1:]]
    wordy = sum(isinstance(r[0], str) and bool(re.search("[a-zA-Z]{2}", r[0])) for r in data) >= 0.25 * max(1, len(data))
    if data and width > 1 and names[-1].startswith("col") and not names[0].startswith("col") and wordy:
        names = [names[-1]] + names[:-1]
    if data and wordy and names[0].startswith("col"):
        names[0] = "description"
    lines = [names, ["---"] * width] + [[str(c) for c in r] + [""] * (width - len(r)) for r in data]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines), bool(data) and all(len(r) == width for r in data)


@pytest.mark.parametrize(
    "rows",
    [
        [["Item", "2019", "2018"], ["Cash", "(1,005)", "$9.50"], ["Debt", "12%", "N/A"]],
        [["note", "2019"], ["ASSETS", "1", "2"], ["Cash", "3", "4.0"]],
        [["a", "a", ""], ["1", "2", "3"]],
        [["only"]],
    ],
)
def test_enrich(spark, rows):
    df = spark.createDataFrame([(rows, None)], "grid array<array<string>>, text string")
    out = tb.enrich(df).collect()[0]
    assert (out.table_markdown, out.is_valid_structure) == brute_enrich(rows)


def test_table_forms_of_odd_cells(spark):
    """HTML and JSON of cells with and without characters to escape, of nulls, and of rows without cells."""
    head = ["n & m", "<b>", None]
    rows = [head, ['say "hi"', "a\\b\tc", "\u2028é\x7f"], [], ["1.500", "0.0", "-00.50"], [None, "+5", "1.e3"], ["(0)", "-0", "$(7)"], ["12a", "١٢", "(-1.25)"]]
    out = tb.enrich(spark.createDataFrame([(rows, None)], "grid array<array<string>>, text string")).first()
    assert out.rows[2:] == [["1.5", "0.0", "-0.5"], [None, "5", "1000.0"], ["0", "0", "$(7)"], ["12a", "١٢", "1.25"]]
    found = out.table_json[out.table_json.index('"rows": ') + 8 : out.table_json.index(', "unit_multiplier"')]
    want = [", ".join(t for t in r) for r in (
        ['"say \\"hi\\""', '"a\\\\b\\tc"', '"\u2028é\x7f"'], [], ["1.5", "0.0", "-0.5"], ["null", "5", "1000.0"], ["0", "0", '"$(7)"'], ['"12a"', '"١٢"', "1.25"])]
    assert found == "[" + ", ".join(f"[{r}]" for r in want) + "]"
    lines = out.table_html.split("\n")
    assert lines[:3] == ["<table>", "  <thead><tr>", f"    <th>{out.columns[0]}</th>"] and lines[-2:] == ["  </tbody>", "</table>"]
    safe = [["say &quot;hi&quot;", "a\\b\tc", "\u2028é\x7f"], *[[c for c in r if c is not None] for r in out.rows[1:]]]
    body = [line for r in safe for line in ["  <tr>", *[f"    <td>{c}</td>" for c in r], "  </tr>"]]
    assert lines[lines.index("  <tbody>") + 1 : -2] == body


def test_segmentation(spark):
    docs = spark.createDataFrame([(0, "s/sample.txt", SAMPLE), (1, "s/empty.txt", "")], "doc_pos long, path string, text string")
    rows = sg.segment(docs).orderBy("doc_pos", "region_idx").collect()
    assert [(r.doc_pos, r.type) for r in rows] == [(0, "title"), (0, "body"), (0, "table"), (0, "figure")]
    assert rows[0].text == "Quarterly Revenue Report" and rows[2].start == 4
    assert rows[3].text == "Figure:\nBar chart of revenue by region."


def test_title_becomes_body_when_first_line_is_blank(spark):
    docs = spark.createDataFrame([(0, "a.txt", "\n Head \nmore")], "doc_pos long, path string, text string")
    assert [(r.type, r.text) for r in sg.segment(docs).orderBy("region_idx").collect()] == [
        ("title", "Head"),
        ("body", "Head\nmore"),
    ]


def test_line_breaks(one):
    assert one(tx.lines(F.lit("a\r\nb c\x0bd")).alias("l")).l == ["a", "b", "c", "d"]


def greedy_groups(flags):
    groups, i = [], 0
    while i < len(flags):
        step = 2 if flags[i] and i + 1 < len(flags) else 1
        groups.append((i, step))
        i += step
    return groups


def test_heading_binding_is_the_greedy_scan(spark):
    import itertools

    cases = [list(f) for n in range(1, 8) for f in itertools.product([True, False], repeat=n)]
    rows = [
        (k, f"p/{k}.txt", [("title" if f else "body", "x" * 80, 0, 80) for f in flags]) for k, flags in enumerate(cases)
    ]
    docs = spark.createDataFrame(
        rows, "doc_pos long, path string, regions array<struct<type:string,text:string,start:int,end:int>>"
    )
    got = {}
    for r in ck.explode_groups(ck.with_groups(docs)).orderBy("doc_pos", "grp").collect():
        got.setdefault(r.doc_pos, []).append((r.region_idx, r.n_regions))
    assert [got[k] for k in range(len(cases))] == [greedy_groups(f) for f in cases]


def test_section_chunk(spark):
    rows = [(0, "d.txt", [("title", "# Executive Summary", 0, 0), ("paragraph", "Revenue grew by ten percent.", 1, 9)], "Financial Statement")]
    docs = spark.createDataFrame(
        rows, "doc_pos long, path string, regions array<struct<type:string,text:string,start:int,end:int>>, doc_title string"
    )
    (c,) = ck.section_chunks(docs).collect()
    assert c.text.startswith("Metadata Header: Financial Statement > Executive Summary\n")
    assert c.field_weight == 2.5 and "ten percent" in c.text and c.chunk_id.endswith("-title-1-1")


@pytest.mark.parametrize("n", [0, 1, 5, 6, 9, 10, 23])
def test_token_windows(spark, n):
    words = [f"w{i}" for i in range(n)]
    want, start = [], 0
    while start < n:
        want.append(" ".join(words[start : start + 5]))
        if start + 5 >= n:
            break
        start += 4
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    got = [r.window_text for r in ck.token_windows(df, size=5, overlap=1).orderBy("win").collect()]
    assert got == want


def test_route(spark):
    df = rt.with_routes(spark.createDataFrame([("revenue by region chart",), ("hello",)], "query string")).collect()
    assert df[0].use_text and df[0].use_table and df[0].use_vision
    assert (df[1].p_text, df[1].p_table, df[1].use_table) == (0.5, 0.1, False)
    assert abs(sum(df[0][f"w_{m}"] for m in rt.MODALITIES) - 1) < 0.01


def test_router_training(spark):
    vocab = {(r.token, r.modality): r.weight for r in rt.train(rt.labeled_queries(spark)).collect()}
    assert vocab[("revenue", "text")] == 3.0 and vocab[("revenue", "vision")] == 0.3
    assert vocab[("chart", "vision")] == 2.0 and vocab[("chart", "text")] == 1.1


def test_rrf(spark):
    rows = [
        (1, "text", "doc1", 0.9, 0), (1, "text", "doc2", 0.7, 1),
        (1, "table", "doc2", 0.95, 1), (1, "table", "doc3", 0.6, 2),
    ]
    hits = spark.createDataFrame(rows, "query_id long, modality string, item_id string, score double, doc_pos long")
    hits = hits.withColumn("region_idx", F.lit(0)).withColumn("weight", fu.default_weight(F.col("modality")))
    fused = fu.fuse_rrf(fu.rank_runs(hits, [("score", False)]), ["doc_pos"]).orderBy(F.col("score").desc()).collect()
    assert [r.item_id for r in fused][0] == "doc2" and len(fused) == 3
    assert fused[0].fused_modalities == "table,text"
    assert fused[0].rrf_score == round(0.45 / 62 + 0.35 / 61, 5)


def test_short_heading_penalty(one):
    out = one(
        rk.rank_score(F.lit(0.8), F.lit(0.5), F.lit("text"), F.lit(12)).alias("short"),
        rk.rank_score(F.lit(0.8), F.lit(0.5), F.lit("text"), F.lit(120)).alias("long"),
        rk.model_score(F.lit(-2.0), F.lit("text"), F.lit(3)).alias("raised"),
        rv.body_length(F.lit("[Context: a > b] body")).alias("body"),
    )
    assert out.short < out.long and out.raised == -1.0 and out.body == 4


def test_chart(spark):
    df = spark.createDataFrame([("vision", "Bar chart of adoption", 4), ("text", "plain", 1)], "modality string, text string, page_no int")
    (row,) = fu.chart_evidence(df, F.lit("q")).collect()
    assert row.linearized == "[BAR_CHART - Page 4] Bar chart of adoption"


def test_reasoning(one):
    out = one(ge.extract_reasoning(F.lit("<think>step\none</think> Answer.")).alias("r")).r
    assert (out.reasoning, out.answer) == ("step\none", "Answer.")


def test_template_answer(one):
    ev_ = F.array(F.struct(F.lit("d1").alias("document_id"), F.lit("table").alias("modality"), F.lit("Revenue table").alias("text")))
    rows = F.array(F.create_map(F.lit("region"), F.lit("North"), F.lit("revenue"), F.lit("10")))
    answer = one(ge.template_answer(ev_, rows).alias("a")).a
    assert "**region: North, revenue: 10**" in answer and "| region | revenue |" in answer
    assert "* **[TABLE]** Revenue table [Source: d1]" in answer


@pytest.mark.parametrize("text", ["Hello. World", "A . B.", "v 1.2 . x", "", " . . ", "é. ü .", "a .b"])
def test_split_claims(one, text):
    parts = [p.strip() for p in re.split(r"(?<!\w)\.(?!\w)", text.strip()) if p.strip()]
    assert one(at.split_claims(F.lit(text)).alias("c")).c == (parts or [text.strip()])


def test_citations_tab_matches_text(one):
    evidence = F.array(F.struct(F.lit("table").alias("modality")))
    loose, strict = (at.check_citations(F.lit("See [TAB1]."), evidence, s) for s in (False, True))
    out = one(loose.alias("l"), strict.alias("s"))
    assert (out.l.supported, out.s.supported) == (False, True)


def test_pyround_equals_python(spark):
    values = [i * 0.0005 for i in range(4000)] + [m / t * w for t in range(1, 9) for m in range(t + 1) for w in (1.0, 2.5, 3.0)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r.r for r in df.select(tx.pyround(F.col("v"), 4).alias("r")).collect()]
    assert sum(abs(a - round(v, 4)) > 1e-9 for a, v in zip(got, values)) == 0

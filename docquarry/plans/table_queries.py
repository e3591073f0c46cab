"""Registered queries over table serialisation and table SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions.rows import present, unnest
from docquarry.operators import tables as tb
from docquarry.operators import tablesql as ts
from docquarry.plans import inputs as I

# A document as a grid: its lines are rows, its words are cells, words of some lengths become amounts.
_SPARK_CELL = "CASE length(w) % 3 WHEN 0 THEN " + I._VALUE.format(s="string") + " ELSE replace(w, '|', '/') END"
_DUCK_CELL = "CASE length(w) % 3 WHEN 0 THEN " + I._VALUE.format(s="varchar") + " ELSE replace(w, '|', '/') END"


def _grids(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id",
        F.expr(
            "filter(transform(split(text, '\\n'), l -> transform(filter(split(l, ' '), w -> w <> ''), "
            f"w -> {_SPARK_CELL})), r -> size(r) > 0)"
        ).alias("grid"),
    )


GRIDS = f"""grids AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
    lambda l: list_transform(list_filter(string_split(l, ' '), lambda w: w <> ''), lambda w: {_DUCK_CELL})),
    lambda r: len(r) > 0) AS grid FROM documents)"""

SEP = "\x1f"


def _joined(col):
    return F.array_join(F.transform(col, lambda r: F.array_join(r, SEP)), "\n")


def _header_cells(word):
    return F.struct(word.alias("text"), (F.length(word) % 3).alias("colspan"))


def tbl_header_hierarchy(spark, sf):
    """Two header rows from the first two lines, spans from word lengths."""
    grids = _grids(spark, sf)
    first, second = F.get("grid", F.lit(0)), F.get("grid", F.lit(1))
    heads = F.transform(
        F.filter(F.array(first, second), lambda r: r.isNotNull()),
        lambda r: F.transform(r, _header_cells),
    )
    paths = tb.header_hierarchy(heads, F.size(first))
    return grids.filter(F.size("grid") > 0).select("doc_id", _joined(paths).alias("paths"))


def tbl_flatten_column(spark, sf):
    grids = _grids(spark, sf).withColumn("names", F.transform("grid", tb.flatten_column_name))
    return grids.select("doc_id", F.array_join("names", "\n").alias("names"))


def tbl_dedup_columns(spark, sf):
    base = F.transform(F.flatten("grid"), lambda w: F.lower(F.substring(w, 1, 2)))
    words = _grids(spark, sf).select("doc_id", base.alias("base"))
    return words.select("doc_id", F.array_join(tb.dedup_columns(F.col("base")), "\n").alias("names"))


def _money(spark, sf):
    """Order amounts written the way filings write them, by status and priority."""
    amount = F.format_number("o_totalprice", 2)
    orders = I.table(spark, sf, "orders")
    return orders.select(
        "o_orderkey",
        "o_custkey",
        "o_orderdate",
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("("), amount, F.lit(")")))
        .when(F.col("o_orderpriority").startswith("1"), F.lit("N/A"))
        .when(F.col("o_orderpriority").startswith("2"), F.concat(F.lit("$"), amount))
        .when(F.col("o_orderpriority").startswith("3"), F.format_number(F.floor("o_totalprice"), 0))
        .otherwise(F.concat(F.lit(" "), amount, F.lit("%")))
        .alias("cell"),
    )


MONEY = """money AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN '(' || format('{:,.2f}', o_totalprice) || ')'
    WHEN o_orderpriority LIKE '1%' THEN 'N/A'
    WHEN o_orderpriority LIKE '2%' THEN '$' || format('{:,.2f}', o_totalprice)
    WHEN o_orderpriority LIKE '3%' THEN format('{:,.0f}', floor(o_totalprice))
    ELSE ' ' || format('{:,.2f}', o_totalprice) || '%' END AS cell FROM orders)"""
_MONEY_NUM = """CASE WHEN cell = 'N/A' THEN NULL ELSE
  (CASE WHEN cell LIKE '(%' THEN -1 ELSE 1 END) * cast(regexp_replace(trim(cell), '[$,%()]', '', 'g') AS DOUBLE) END"""


def tbl_normalize_numeric(spark, sf):
    return _money(spark, sf).select(
        "o_orderkey",
        "cell",
        tb.numeric_value(F.col("cell")).alias("number"),
        tb.normalize_cell(F.col("cell")).alias("normalized"),
    )


def tbl_unit_multiplier(spark, sf):
    unit = F.when(F.length("text") % 4 == 0, " (In Millions)").when(
        F.length("text") % 4 == 1, " stated in thousands, not in billions"
    ).when(F.length("text") % 4 == 2, " (billions)").otherwise("")
    docs = I.table(spark, sf, "documents")
    return docs.select("doc_id", tb.unit_multiplier(F.concat("text", unit)).alias("multiplier"))


def tbl_cells_to_grid(spark, sf):
    """Line items as spanned cells of one table per order: row = line number, column = ship year."""
    items = I.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("table_id"),
        (F.col("l_linenumber") - 1).alias("row"),
        (F.year("l_shipdate") - 1990).alias("col"),
        F.lit(1).alias("row_span"),
        (F.col("l_linenumber") % 2 + 1).alias("col_span"),
        F.col("l_linenumber").alias("cell_no"),
        F.col("l_returnflag").alias("text"),
    )
    grid = tb.cells_to_grid(items, ["table_id"])
    return grid.select("table_id", "row", F.array_join("cells", SEP).alias("cells"))


def _boxed_cells():
    return F.transform(
        F.flatten("grid"),
        lambda w, i: F.struct(
            i.alias("row"),
            F.length(w).alias("col"),
            F.when(
                F.length(w) % 2 == 0,
                F.struct(
                    F.length(w).cast("double").alias("y0"), (F.length(w) % 5).cast("double").alias("x0")
                ),
            ).alias("bbox"),
            (F.length(w) % 4 == 1).alias("column_header"),
            w.alias("text"),
        ),
    )


def tbl_spatial_sort(spark, sf):
    out = _grids(spark, sf).withColumn("cells", _boxed_cells())
    ordered = F.transform(tb.spatial_sort(F.col("cells")), lambda c: c["text"])
    return out.select(
        "doc_id",
        F.array_join(ordered, "\n").alias("cells"),
        tb.header_row_count(F.col("cells")).alias("header_rows"),
    )


def _markdown(spark, sf):
    line = F.transform(
        "grid", lambda r, i: F.concat(F.lit("| "), F.array_join(r, " | "), F.when(i == 0, "|\n|:--|--:|").otherwise("|"))
    )
    return _grids(spark, sf).select(
        "doc_id", F.concat(F.lit("preface a|b\n"), F.array_join(line, "\n")).alias("md")
    )


MARKDOWN = GRIDS + """,
markdown AS (
  SELECT doc_id, 'preface a|b' || chr(10) || array_to_string(list_transform(grid, lambda r, i:
    '| ' || array_to_string(r, ' | ') || CASE WHEN i = 1 THEN '|' || chr(10) || '|:--|--:|' ELSE '|' END), chr(10)) AS md
  FROM grids)"""


def tbl_markdown_parse(spark, sf):
    return _markdown(spark, sf).select("doc_id", _joined(tb.markdown_grid(F.col("md"))).alias("grid"))


def sql_parse_pipe_table(spark, sf):
    # A leading text line with a pipe becomes the header here, so only rows of its width survive.
    parsed = present(_markdown(spark, sf), ["doc_id"], ts.parse_pipe_table(F.col("md")), "t")
    return parsed.select(
        "doc_id", F.array_join("t.columns", SEP).alias("columns"), _joined(F.col("t.rows")).alias("rows")
    )


def _as_table(spark, sf):
    grids = present(_grids(spark, sf), ["doc_id"], tb.table_from_grid(F.col("grid")), "t")
    return grids.select("doc_id", "t.columns", "t.rows")


AS_TABLE = GRIDS + """,
tables_ AS (SELECT doc_id, grid[1] AS cols, grid[2:] AS rows FROM grids WHERE len(grid) >= 2),
padded AS (
  SELECT *, greatest(len(cols), list_max(list_transform(rows, lambda r: len(r)))) AS n FROM tables_)"""


def tbl_to_markdown(spark, sf):
    t = _as_table(spark, sf)
    return t.select("doc_id", tb.to_markdown(F.col("columns"), F.col("rows")).alias("md"))


def tbl_to_html(spark, sf):
    t = _as_table(spark, sf)
    return t.select("doc_id", tb.to_html(F.col("columns"), F.col("rows")).alias("html"))


def tbl_validate(spark, sf):
    t = _as_table(spark, sf)
    return t.select("doc_id", tb.is_valid_table(F.col("columns"), F.col("rows")).alias("ok"))


def tbl_sanitize_stub(spark, sf):
    t = _as_table(spark, sf)
    names = F.transform(
        "columns",
        lambda c, i: F.when(i == F.size("columns") - 1, "col_9").when((i == 0) & (F.length(c) % 2 == 0), "col_1").otherwise(c),
    )
    t = t.withColumn("names", names)
    clean = tb.sanitize_stub_columns(F.col("names"), F.col("rows"))
    return t.select("doc_id", F.array_join(clean, SEP).alias("names"))


def tbl_enrich(spark, sf):
    out = tb.enrich(_grids(spark, sf).withColumn("text", F.lit(None).cast("string")))
    return out.select("doc_id", "table_markdown", "table_html", "unit_multiplier", "is_valid_structure", "table_json")


def tbl_enrich_cells(spark, sf):
    """Line items as cells of one table per order, with two header rows: years above, months below."""
    items = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("text"))

    def cell(row, col, span, header, text, y):
        box = F.struct(y.cast("double").alias("y0"), col.cast("double").alias("x0"))
        return F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), F.lit(1).alias("row_span"), span.cast("int").alias("col_span"),
                        F.lit(header).alias("column_header"), text.alias("text"), box.alias("bbox"))

    n = F.col("l_linenumber")
    # An order has few lines, so its cells are one small array; of lines at one place the greatest text counts.
    body = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(cell(n + 1, n % 2, F.lit(1), False, F.col("text"), n + 1))).alias("body"))
    heads = [cell(F.lit(1), F.lit(i), F.lit(1), True, F.lit(t), F.lit(1)) for i, t in ((1, "High"), (0, "Low"))]
    heads.append(cell(F.lit(0), F.lit(0), F.lit(2), True, F.lit("Quantity (in thousands)"), F.lit(0)))
    tables = body.select("l_orderkey", F.concat(F.array(*heads), "body").alias("cells"), F.lit(None).cast("array<array<string>>").alias("grid"), F.lit("in thousands").alias("text"))
    out = tb.enrich(tables, cells="cells")
    return out.select("l_orderkey", "table_markdown", "unit_multiplier", "is_valid_structure", "table_json")


def _cells(spark, sf):
    """Orders as extracted tables, one per customer, in long form."""
    cells = F.array(F.col("cell"), F.date_format("o_orderdate", "yyyy"), F.col("o_orderkey").cast("string"))
    return unnest(_money(spark, sf), ["o_custkey", "o_orderkey"], cells, "value", "col_idx")


CELLS = MONEY + """,
cells AS (
  SELECT o_custkey, o_orderkey, 0 AS col_idx, cell AS value FROM money
  UNION ALL SELECT o_custkey, o_orderkey, 1, strftime(o_orderdate, '%Y') FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, 2, o_orderkey::VARCHAR FROM orders),
bare AS (
  SELECT *, nullif(trim(regexp_replace(value, '[,$€£%]', '', 'g'), '()'), '') AS b FROM cells),
types AS (
  SELECT o_custkey, col_idx, CASE WHEN count(k) = 0 OR bool_and(regexp_full_match(k, '\\d{4}(-\\d{2}-\\d{2})?')) THEN 'VARCHAR'
    WHEN bool_and(regexp_full_match(k, '-?\\d+')) THEN 'INTEGER'
    WHEN bool_and(regexp_full_match(k, '-?\\d+\\.?\\d*')) THEN 'DECIMAL(18,2)' ELSE 'VARCHAR' END AS sql_type
  FROM (SELECT *, CASE WHEN b NOT IN ('-', '—', 'N/A', 'null', 'None', 'nan') THEN b END AS k FROM bare)
  GROUP BY ALL)"""


def sql_infer_types(spark, sf):
    return ts.infer_types_long(_cells(spark, sf), ["o_custkey", "col_idx"])


def sql_sanitize_cells(spark, sf):
    cells = _cells(spark, sf)
    types = ts.infer_types_long(cells, ["o_custkey", "col_idx"])
    typed = cells.join(types, ["o_custkey", "col_idx"])
    return typed.select(
        "o_orderkey",
        "col_idx",
        "sql_type",
        ts.sanitize_number(F.col("value"), F.col("sql_type")).alias("number"),
        ts.sanitize_text(F.col("value"), F.col("sql_type")).alias("txt"),
    )


def sql_typed_table(spark, sf):
    cols = [("amount", ts.DECIMAL), ("year", ts.VARCHAR), ("order", ts.INTEGER)]
    wide = ts.typed_rows(_cells(spark, sf), cols, ["o_custkey", "o_orderkey"])
    return wide.select("o_orderkey", F.col("amount").cast("double").alias("amount"), "year", "order")


def _statement(spark, sf):
    """Customers as one typed statement: a label, a year column and a number."""
    return I.table(spark, sf, "customer").select(
        F.concat("c_mktsegment", F.when(F.col("c_acctbal") < 0, " Total").otherwise(" part")).alias("item"),
        F.round(F.col("c_acctbal"), 2).cast("decimal(18,2)").alias("2024"),
        F.col("c_custkey").alias("n"),
    )


STATEMENT = """statement AS (
  SELECT c_mktsegment || CASE WHEN c_acctbal < 0 THEN ' Total' ELSE ' part' END AS item,
         round(c_acctbal, 2)::DECIMAL(18, 2) AS "2024", c_custkey AS n FROM customer)"""


def _doubled(df):
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) if t.startswith("decimal") else F.col(f"`{c}`") for c, t in df.dtypes])


def sql_concept_filter(spark, sf):
    return _doubled(ts.answer(_statement(spark, sf), "What were Total Assets?"))


def sql_sum_agg(spark, sf):
    return _doubled(ts.answer(_statement(spark, sf), "average balance"))


def sql_year_projection(spark, sf):
    return _doubled(ts.answer(_statement(spark, sf), "balance by item"))


def sql_full_scan(spark, sf):
    nation = I.table(spark, sf, "nation")
    return ts.answer(nation, "show everything")


def _planned(spark, sf):
    """Every query against every table region of the corpus, planned inside the region's row."""
    found = I.regions(spark, sf).filter(F.col("type") == "table")
    t = present(tb.with_region_table(found), ["document_id", "region_idx"], F.col("table"), "t")
    t = t.select("document_id", "region_idx", "t.columns", "t.rows")
    t = t.withColumn("types", ts.infer_types(F.col("columns"), F.col("rows")))
    queries = F.array(
        *[F.struct(F.lit(i).alias("query_id"), F.lit(q.lower()).alias("query")) for i, q in I.QUERY_SET]
    )
    rows = unnest(t, ["*"], queries, "q")
    return rows.withColumn("plan", ts.template_plan(F.col("q.query"), F.col("columns"), F.col("types")))


def sql_template_choice(spark, sf):
    p = _planned(spark, sf)
    return p.select(
        "document_id",
        "region_idx",
        "q.query_id",
        "plan.template",
        ts.template_sql(F.col("plan")).alias("sql_query"),
        F.array_join("types", ";").alias("types"),
    )


def sql_match_score(spark, sf):
    p = _planned(spark, sf)
    return p.select(
        "document_id", "region_idx", "q.query_id", ts.match_score(F.col("q.query"), F.col("columns")).alias("score")
    )


# What real tables hold and neat ones do not, added by the region's number.
_WIDE, _LONG, _SHORT = ["x", "9" * 20], ["Total", "7", "extra"], ["total sum"]


def _strings(values):
    return F.array(*[F.lit(v) for v in values])


def _odd_planned(spark, sf):
    """Each table region asked one query, in turn; some repeat a column, some have short, long or far too large rows."""
    found = I.regions(spark, sf).filter(F.col("type") == "table")
    t = present(tb.with_region_table(found), ["document_id", "region_idx"], F.col("table"), "t")
    kind, head = F.col("region_idx") % 5, F.get("t.columns", F.lit(0))
    extra = F.when(kind == 2, F.array(_strings(_SHORT))).when(kind == 3, F.array(_strings(_WIDE))).when(kind == 4, F.array(_strings(_LONG)))
    t = t.select(
        "document_id",
        "region_idx",
        F.when(kind == 1, F.array(head, F.upper(head))).otherwise(F.col("t.columns")).alias("columns"),
        F.concat("t.rows", F.coalesce(extra, F.array().cast("array<array<string>>"))).alias("rows"),
    )
    t = t.withColumn("types", ts.infer_types(F.col("columns"), F.col("rows")))
    turn = F.size("rows") % len(I.QUERY_SET)
    queries = F.array(*[F.struct(F.lit(n).alias("query_id"), F.lit(q.lower()).alias("query")) for n, q in I.QUERY_SET])
    t = t.withColumn("q", F.get(queries, turn))
    t = t.withColumn("plan", ts.template_plan(F.col("q.query"), F.col("columns"), F.col("types")))
    return t.withColumn("error", ts.statement_error(F.col("plan"), F.col("columns"), F.col("rows"), F.col("types")))


def _record_text(record):
    entries = F.transform(F.map_entries(record), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("NULL"))))
    return F.array_join(entries, SEP)


def sql_template_result(spark, sf):
    p = _odd_planned(spark, sf)
    p = p.withColumn("result", ts.template_result(F.col("plan"), F.col("columns"), F.col("rows"), F.col("types")))
    return p.select(
        "document_id",
        "region_idx",
        "q.query_id",
        "plan.template",
        "error",
        ts.match_score(F.col("q.query"), F.col("columns"), F.col("error").isNotNull()).alias("score"),
        F.size("result").cast("long").alias("n_rows"),
        F.md5(F.array_join(F.transform("result", _record_text), "\n")).alias("values_md5"),
    )


def sql_preview(spark, sf):
    """The fallback runner's score on every row it may show; five rows are its feature."""
    return ts.preview(I.table(spark, sf, "region").orderBy("r_regionkey"), "sales by region")


def sql_failure_log(spark, sf):
    """What is logged of the statements that fail, on tables with faults."""
    attempts = _odd_planned(spark, sf).select(
        F.col("q.query").alias("query"),
        ts.template_sql(F.col("plan")).alias("generated_sql"),
        "error",
        F.struct("columns", "rows").alias("table"),
    )
    out = ts.failure_records(attempts)
    return out.select(
        "query", "generated_sql", "error", F.array_join("columns", SEP).alias("columns"), _joined(F.col("sample_rows")).alias("sample_rows")
    )


QUERIES = {
    f.__name__: f
    for f in (
        tbl_header_hierarchy,
        tbl_flatten_column,
        tbl_dedup_columns,
        tbl_normalize_numeric,
        tbl_unit_multiplier,
        tbl_cells_to_grid,
        tbl_spatial_sort,
        tbl_markdown_parse,
        sql_parse_pipe_table,
        tbl_to_markdown,
        tbl_to_html,
        tbl_validate,
        tbl_sanitize_stub,
        tbl_enrich,
        tbl_enrich_cells,
        sql_infer_types,
        sql_sanitize_cells,
        sql_typed_table,
        sql_concept_filter,
        sql_sum_agg,
        sql_year_projection,
        sql_full_scan,
        sql_template_choice,
        sql_match_score,
        sql_template_result,
        sql_preview,
        sql_failure_log,
    )
}

_PIPE = "list_transform(string_split(trim({l}, '|'), '|'), lambda c: trim(c))"
_JOIN = "array_to_string(list_transform({rows}, lambda r: array_to_string(r, chr(31))), chr(10))"

PLANNED = I.REGIONS + f""",
grid_lines AS (
  SELECT document_id, region_idx, list_filter(string_split(text, chr(10)), lambda l: l LIKE '|%') AS ls
  FROM regions WHERE type = 'table'),
grid_rows AS (
  SELECT document_id, region_idx, list_filter(list_transform(ls, lambda l: {_PIPE.format(l='l')}),
    lambda r: len(list_filter(r, lambda c: NOT regexp_full_match(c, '[-: ]*'))) > 0) AS g FROM grid_lines),
reg_tables AS (
  SELECT document_id, region_idx, g[1] AS cols, g[2:] AS rows FROM grid_rows WHERE len(g) >= 2),
col_cells AS (
  SELECT document_id, region_idx, j AS col_no, trim(regexp_replace(r[j], '[,$€£%]', '', 'g'), '()') AS v
  FROM (SELECT document_id, region_idx, len(cols) AS n, unnest(rows) AS r FROM reg_tables),
       LATERAL (SELECT unnest(range(1, n + 1)) AS j) WHERE j <= len(r)),
col_types AS (
  SELECT document_id, region_idx, col_no,
    CASE WHEN count(k) = 0 OR bool_and(regexp_full_match(k, '\\d{{4}}(-\\d{{2}}-\\d{{2}})?')) THEN 'VARCHAR'
    WHEN bool_and(regexp_full_match(k, '-?\\d+')) THEN 'INTEGER'
    WHEN bool_and(regexp_full_match(k, '-?\\d+\\.?\\d*')) THEN 'DECIMAL(18,2)' ELSE 'VARCHAR' END AS sql_type
  FROM (SELECT *, CASE WHEN v NOT IN ('', '-', '—', 'N/A', 'null', 'None', 'nan') THEN v END AS k FROM col_cells)
  GROUP BY ALL),
typed AS (
  SELECT t.document_id, t.region_idx, any_value(cols) AS cols, any_value(rows) AS rows,
         list(sql_type ORDER BY col_no) AS types
  FROM reg_tables t JOIN col_types c ON c.document_id = t.document_id AND c.region_idx = t.region_idx GROUP BY ALL),
{I.QUERIES_CTE},
planned AS (
  SELECT t.*, query_id, lower(query) AS q,
    CASE WHEN contains(lower(query), 'total assets') THEN 'total' END AS kw,
    regexp_matches(lower(query), 'sum|average|avg|max|min') AS agg,
    list_filter(list_zip(cols, types), lambda z: z[2] <> 'VARCHAR')[1][1] AS num,
    list_filter(cols, lambda c: regexp_matches(c, '2018|2019|202[0-5]'))[1] AS yr
  FROM typed t, query_set),
chosen AS (
  SELECT *, CASE WHEN kw IS NOT NULL THEN 'A' WHEN agg AND num IS NOT NULL THEN 'B' WHEN yr IS NOT NULL THEN 'C'
            ELSE 'D' END AS template FROM planned)"""

_NUMBER = """((CASE WHEN trim({v}) LIKE '(%)' THEN -1 ELSE 1 END) * try_cast(regexp_replace({v}, '[$,%€£()]', '', 'g') AS DOUBLE))"""
_VOID = "({v} IS NULL OR trim({v}) IN ('', '-', '—', 'N/A', 'null', 'None', 'nan'))"
_TYPED = (
    "CASE WHEN {t} = 'VARCHAR' THEN trim({v}) WHEN " + _VOID + " THEN NULL WHEN {t} = 'INTEGER' THEN try_cast(trunc("
    + _NUMBER + ") AS BIGINT)::VARCHAR ELSE try_cast(" + _NUMBER + " AS DECIMAL(18, 2))::VARCHAR END"
)
_ENTRY = "{n} || '=' || coalesce({v}, 'NULL')"


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# Tables with faults, each asked one query: typed, planned, run, and written as text.
ODD = PLANNED + f""",
odd_tables AS (
  SELECT document_id, region_idx, CASE WHEN region_idx % 5 = 1 THEN [cols[1], upper(cols[1])] ELSE cols END AS cols,
    CASE region_idx % 5 WHEN 2 THEN list_append(rows, {_sql_list(_SHORT)}) WHEN 3 THEN list_append(rows, {_sql_list(_WIDE)})
      WHEN 4 THEN list_append(rows, {_sql_list(_LONG)}) ELSE rows END AS rows FROM reg_tables),
odd_cells AS (
  SELECT document_id, region_idx, j, r[j] AS raw, trim(regexp_replace(r[j], '[,$€£%]', '', 'g'), '()') AS v
  FROM (SELECT document_id, region_idx, len(cols) AS n, unnest(rows) AS r FROM odd_tables), LATERAL (SELECT unnest(range(1, n + 1)) AS j)),
odd_types AS (
  SELECT document_id, region_idx, j, CASE WHEN count(k) = 0 OR bool_and(regexp_full_match(k, '\\d{{4}}(-\\d{{2}}-\\d{{2}})?')) THEN 'VARCHAR'
    WHEN bool_and(regexp_full_match(k, '-?\\d+')) THEN 'INTEGER'
    WHEN bool_and(regexp_full_match(k, '-?\\d+\\.?\\d*')) THEN 'DECIMAL(18,2)' ELSE 'VARCHAR' END AS t
  FROM (SELECT *, CASE WHEN v NOT IN ('', '-', '—', 'N/A', 'null', 'None', 'nan') THEN v END AS k FROM odd_cells) GROUP BY ALL),
odd_wide AS (
  SELECT c.document_id, c.region_idx, bool_or(coalesce(NOT {_VOID.format(v="raw")} AND ((t = 'INTEGER' AND
    (trunc({_NUMBER.format(v="raw")}) < -2147483648 OR trunc({_NUMBER.format(v="raw")}) > 2147483647))
    OR (t = 'DECIMAL(18,2)' AND abs({_NUMBER.format(v="raw")}) >= 1e16)), false)) AS wide, list(DISTINCT {{'j': c.j, 't': t}} ORDER BY {{'j': c.j, 't': t}}) AS jt
  FROM odd_cells c JOIN odd_types USING (document_id, region_idx, j) GROUP BY ALL),
odd_typed AS (
  SELECT o.document_id, o.region_idx, cols, rows, wide, list_transform(jt, lambda x: x.t) AS types,
    lower(query) AS q, query_id
  FROM odd_tables o JOIN odd_wide w ON w.document_id = o.document_id AND w.region_idx = o.region_idx
  JOIN query_set ON query_id = len(rows) % 10 + 1),
odd_planned AS (
  SELECT *, CASE WHEN contains(q, 'total assets') THEN 'total' END AS kw, regexp_matches(q, 'sum|average|avg|max|min') AS agg,
    list_filter(list_zip(cols, types), lambda z: z[2] <> 'VARCHAR')[1][1] AS num,
    list_filter(cols, lambda c: regexp_matches(c, '2018|2019|202[0-5]'))[1] AS yr,
    len(list_filter(cols, lambda c: contains(q, lower(c)))) > 0 AS named,
    list_transform(rows, lambda r: list_transform(range(1, len(cols) + 1), lambda j: {_TYPED.format(v="r[j]", t="types[j]")})) AS typed_rows
  FROM odd_typed),
odd_template AS (
  SELECT *, CASE WHEN kw IS NOT NULL THEN 'A' WHEN agg AND num IS NOT NULL THEN 'B' WHEN yr IS NOT NULL THEN 'C' ELSE 'D' END AS template
  FROM odd_planned),
odd_chosen AS (
  SELECT *, CASE WHEN len(list_distinct(list_transform(cols, lambda c: lower(c)))) < len(cols) THEN 'repeated column name'
    WHEN wide THEN 'number out of range' WHEN template = 'A' AND types[1] <> 'VARCHAR' THEN 'label column is no text' END AS error,
    list_filter(typed_rows, lambda r: template <> 'A' OR coalesce(contains(lower(r[1]), kw), false)) AS kept,
    list_filter(list_transform(typed_rows, lambda r: r[list_position(cols, num)]), lambda v: v IS NOT NULL) AS nums FROM odd_template),
odd_shown AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN list_transform(rows[1:5], lambda r: array_to_string(list_transform(
        range(1, least(len(cols), len(r)) + 1), lambda j: {_ENTRY.format(n="cols[j]", v="r[j]")}), chr(31)))
    WHEN template = 'B' THEN ['total_sum=' || coalesce(CASE WHEN types[list_position(cols, num)] = 'INTEGER'
        THEN list_sum(list_transform(nums, lambda v: v::HUGEINT))::VARCHAR
        ELSE list_sum(list_transform(nums, lambda v: v::DECIMAL(38, 2)))::DECIMAL(38, 2)::VARCHAR END, 'NULL')]
    WHEN template IN ('A', 'C') AND yr IS NOT NULL THEN list_transform(kept, lambda r:
        {_ENTRY.format(n="cols[1]", v="r[1]")} || chr(31) || {_ENTRY.format(n="yr", v="r[list_position(cols, yr)]")})
    ELSE list_transform(kept, lambda r: array_to_string(list_transform(range(1, len(cols) + 1), lambda j: {_ENTRY.format(n="cols[j]", v="r[j]")}), chr(31))) END AS shown
  FROM odd_chosen)"""

ORACLES = {
    "tbl_header_hierarchy": I.with_(GRIDS)
    + """, spans AS (
  SELECT doc_id, h, k, len(grid[1]) AS n, grid[h][k] AS t, greatest(1, length(grid[h][k]) % 3) AS span
  FROM (SELECT doc_id, grid, unnest(range(1, least(2, len(grid)) + 1)) AS h FROM grids),
       LATERAL (SELECT unnest(range(1, len(grid[h]) + 1)) AS k)),
placed AS (
  SELECT *, sum(span) OVER (PARTITION BY doc_id, h ORDER BY k) - span AS first FROM spans),
spread AS (SELECT doc_id, h, t, n, first + unnest(range(0, span)) AS c FROM placed),
paths AS (SELECT doc_id, c, string_agg(t, chr(31) ORDER BY h) AS path FROM spread WHERE c < n GROUP BY ALL),
frame AS (SELECT doc_id, unnest(range(0, len(grid[1]))) AS c FROM grids WHERE len(grid) > 0)
SELECT f.doc_id, string_agg(coalesce(path, 'col_' || (f.c + 1)), chr(10) ORDER BY f.c) AS paths
FROM frame f LEFT JOIN paths p ON p.doc_id = f.doc_id AND p.c = f.c GROUP BY f.doc_id""",
    "tbl_flatten_column": I.with_(GRIDS)
    + """, parts AS (
  SELECT doc_id, i, j, trim(regexp_replace(lower(grid[i][j]), '[^a-zA-Z0-9]+', '_', 'g'), '_') AS p
  FROM (SELECT doc_id, grid, unnest(range(1, len(grid) + 1)) AS i FROM grids),
       LATERAL (SELECT unnest(range(1, len(grid[i]) + 1)) AS j)),
firsts AS (SELECT doc_id, i, p, min(j) AS j FROM parts GROUP BY ALL),
names AS (
  SELECT doc_id, i, coalesce(string_agg(p, '_' ORDER BY j) FILTER (p <> ''), 'col') AS name FROM firsts GROUP BY ALL)
SELECT g.doc_id, coalesce(string_agg(name, chr(10) ORDER BY i), '') AS names
FROM grids g LEFT JOIN names n ON n.doc_id = g.doc_id GROUP BY g.doc_id""",
    "tbl_dedup_columns": I.with_(GRIDS)
    + """, named AS (
  SELECT doc_id, i, lower(substr(flatten(grid)[i], 1, 2)) AS n
  FROM grids, LATERAL (SELECT unnest(range(1, len(flatten(grid)) + 1)) AS i)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY i) AS k FROM named)
SELECT g.doc_id, coalesce(string_agg(CASE WHEN k = 1 THEN n ELSE n || '_' || k END, chr(10) ORDER BY i), '') AS names
FROM grids g LEFT JOIN numbered x ON x.doc_id = g.doc_id GROUP BY g.doc_id""",
    "tbl_normalize_numeric": I.with_(MONEY)
    + f"""SELECT o_orderkey, cell, {_MONEY_NUM} AS number,
  CASE WHEN cell = 'N/A' THEN cell WHEN NOT contains(cell, '.') THEN replace(cell, ',', '')
   ELSE regexp_replace(printf('%.2f', {_MONEY_NUM}), '0$', '') END AS normalized FROM money""",
    "tbl_unit_multiplier": """SELECT doc_id, CASE length(text) % 4 WHEN 0 THEN 1000000 WHEN 1 THEN 1000
  WHEN 2 THEN 1000000000 ELSE 1 END AS multiplier FROM documents""",
    "tbl_cells_to_grid": """WITH c AS (
  SELECT l_orderkey AS t, l_linenumber - 1 AS r, year(l_shipdate) - 1990 AS c, l_linenumber % 2 + 1 AS span,
         max(l_returnflag) AS v FROM lineitem GROUP BY ALL),
d AS (SELECT t, max(r) + 1 AS nr, max(c + span) AS nc FROM c GROUP BY t),
f AS (SELECT t, r, unnest(range(0, nc)) AS c FROM (SELECT t, nc, unnest(range(0, nr)) AS r FROM d))
SELECT f.t AS table_id, f.r AS row, string_agg(coalesce(v, ''), chr(31) ORDER BY f.c) AS cells
FROM f LEFT JOIN c ON c.t = f.t AND c.r = f.r AND c.c = f.c GROUP BY ALL""",
    "tbl_enrich_cells": """WITH c AS (
  SELECT l_orderkey, l_linenumber AS r, l_linenumber % 2 AS c, max(printf('%.2f', l_quantity::DOUBLE)) AS t FROM lineitem GROUP BY ALL),
v AS (SELECT *, CASE WHEN t LIKE '%.00' THEN left(t, length(t) - 1) ELSE rtrim(t, '0') END AS num FROM c),
f AS (SELECT l_orderkey, unnest(range(1, m + 1)) AS r FROM (SELECT l_orderkey, max(r) AS m FROM c GROUP BY l_orderkey)),
w AS (
  SELECT f.l_orderkey, f.r, coalesce(max(num) FILTER (c = 0), '') AS low, coalesce(max(num) FILTER (c = 1), '') AS high
  FROM f LEFT JOIN v ON v.l_orderkey = f.l_orderkey AND v.r = f.r GROUP BY ALL),
j AS (SELECT *, CASE WHEN low = '' THEN '""' ELSE low END AS a, CASE WHEN high = '' THEN '""' ELSE high END AS b FROM w)
SELECT l_orderkey, '| quantity_in_thousands_low | quantity_in_thousands_high |' || chr(10) || '| --- | --- |' || chr(10)
    || string_agg('| ' || low || ' | ' || high || ' |', chr(10) ORDER BY r) AS table_markdown, 1000::BIGINT AS unit_multiplier, true AS is_valid_structure,
  '{"columns": ["quantity_in_thousands_low","quantity_in_thousands_high"], "header_paths": [["Quantity (in thousands)","Low"],["Quantity (in thousands)","High"]], "rows": ['
    || string_agg('[' || a || ', ' || b || ']', ', ' ORDER BY r) || '], "unit_multiplier": 1000, "is_valid_structure": true}' AS table_json
FROM j GROUP BY l_orderkey""",
    "tbl_spatial_sort": I.with_(GRIDS)
    + """, w AS (
  SELECT doc_id, i, flatten(grid)[i] AS w FROM grids, LATERAL (SELECT unnest(range(1, len(flatten(grid)) + 1)) AS i)),
k AS (
  SELECT *, CASE WHEN length(w) % 2 = 0 THEN length(w) ELSE i - 1 END AS y,
         CASE WHEN length(w) % 2 = 0 THEN length(w) % 5 ELSE length(w) END AS x FROM w)
SELECT g.doc_id, coalesce(string_agg(w, chr(10) ORDER BY y, x, i), '') AS cells,
  coalesce(max(CASE WHEN length(w) % 4 = 1 AND i <= 3 THEN i END), 1) AS header_rows
FROM grids g LEFT JOIN k ON k.doc_id = g.doc_id GROUP BY g.doc_id""",
    "tbl_markdown_parse": I.with_(GRIDS) + f"SELECT doc_id, {_JOIN.format(rows='grid')} AS grid FROM grids",
    "sql_parse_pipe_table": I.with_(GRIDS)
    + f""", kept AS (SELECT doc_id, list_filter(grid, lambda r: len(r) = 2) AS rows FROM grids)
SELECT doc_id, 'preface a' || chr(31) || 'b' AS columns, {_JOIN.format(rows='rows')} AS rows FROM kept WHERE len(rows) > 0""",
    "tbl_to_markdown": I.with_(AS_TABLE)
    + """SELECT doc_id, array_to_string(list_transform(list_concat([cols, list_transform(range(0, n), lambda i: '---')], rows),
 lambda r: '| ' || array_to_string(list_concat(r, list_transform(range(0, n - len(r)), lambda i: '')), ' | ') || ' |'), chr(10)) AS md
FROM padded""",
    "tbl_to_html": I.with_(AS_TABLE)
    + """, e AS (
  SELECT doc_id, list_transform(list_concat([cols], rows), lambda r: list_transform(r, lambda c:
    replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'))) AS g FROM tables_)
SELECT doc_id, '<table>' || chr(10) || '  <thead><tr>' || chr(10)
 || array_to_string(list_transform(g[1], lambda c: '    <th>' || c || '</th>'), chr(10)) || chr(10)
 || '  </tr></thead>' || chr(10) || '  <tbody>' || chr(10)
 || array_to_string(list_transform(g[2:], lambda r: '  <tr>' || chr(10)
    || array_to_string(list_transform(r, lambda c: '    <td>' || c || '</td>'), chr(10)) || chr(10) || '  </tr>'), chr(10))
 || chr(10) || '  </tbody>' || chr(10) || '</table>' AS html FROM e""",
    "tbl_validate": I.with_(AS_TABLE)
    + "SELECT doc_id, len(list_filter(rows, lambda r: len(r) <> len(cols))) = 0 AS ok FROM tables_",
    "tbl_sanitize_stub": I.with_(AS_TABLE)
    + """, n AS (
  SELECT doc_id, list_transform(cols, lambda c, i: CASE WHEN i = len(cols) THEN 'col_9'
     WHEN i = 1 AND length(c) % 2 = 0 THEN 'col_1' ELSE c END) AS c,
   len(list_filter(rows, lambda r: regexp_matches(r[1], '[a-zA-Z]{2,}'))) >= 0.25 * len(rows) AS wordy FROM tables_),
m AS (
  SELECT doc_id, wordy, CASE WHEN wordy AND len(c) > 1 AND NOT starts_with(c[1], 'col')
    THEN list_concat([c[len(c)]], c[1:len(c) - 1]) ELSE c END AS c FROM n)
SELECT doc_id, array_to_string(CASE WHEN wordy AND starts_with(c[1], 'col') THEN list_concat(['description'], c[2:]) ELSE c END,
  chr(31)) AS names FROM m""",
    "sql_infer_types": I.with_(CELLS) + "SELECT o_custkey, col_idx, sql_type FROM types",
    "sql_sanitize_cells": I.with_(CELLS)
    + """SELECT o_orderkey, c.col_idx, sql_type,
  CASE WHEN sql_type <> 'VARCHAR' AND value <> 'N/A' THEN (CASE WHEN value LIKE '(%' THEN -1 ELSE 1 END)
    * cast(regexp_replace(trim(value), '[$,%()]', '', 'g') AS DOUBLE) END AS number,
  CASE WHEN sql_type = 'VARCHAR' THEN trim(value) END AS txt
FROM cells c JOIN types t ON t.o_custkey = c.o_custkey AND t.col_idx = c.col_idx""",
    "sql_typed_table": I.with_(MONEY)
    + f"""SELECT o_orderkey, round({_MONEY_NUM}, 2) AS amount, strftime(o_orderdate, '%Y') AS year, o_orderkey AS "order"
FROM money JOIN orders USING (o_orderkey)""",
    "sql_concept_filter": I.with_(STATEMENT)
    + """SELECT item, "2024"::DOUBLE AS "2024" FROM statement WHERE lower(item) LIKE '%total%'""",
    "sql_sum_agg": I.with_(STATEMENT) + """SELECT sum("2024")::DOUBLE AS total_sum FROM statement""",
    "sql_year_projection": I.with_(STATEMENT) + """SELECT item, "2024"::DOUBLE AS "2024" FROM statement""",
    "sql_full_scan": "SELECT * FROM nation",
    "sql_template_choice": I.with_(PLANNED)
    + """SELECT document_id, region_idx, query_id, template, CASE
  WHEN template = 'A' THEN 'SELECT ' || CASE WHEN yr IS NULL THEN '*' ELSE '"' || cols[1] || '", "' || yr || '"' END
     || ' FROM doc_table WHERE LOWER("' || cols[1] || '") LIKE ''%total%'''
  WHEN template = 'B' THEN 'SELECT SUM("' || num || '") AS total_sum FROM doc_table'
  WHEN template = 'C' THEN 'SELECT "' || cols[1] || '", "' || yr || '" FROM doc_table' ELSE 'SELECT * FROM doc_table' END AS sql_query,
  array_to_string(types, ';') AS types FROM chosen""",
    "sql_match_score": I.with_(PLANNED)
    + """SELECT document_id, region_idx, query_id,
  CASE WHEN len(list_filter(cols, lambda c: contains(q, lower(c)))) > 0 THEN 0.9 ELSE 0.6 END::DOUBLE AS score FROM chosen""",
    "sql_template_result": I.with_(ODD)
    + f"""SELECT document_id, region_idx, query_id, template, error,
  CASE WHEN named THEN CASE WHEN error IS NULL THEN 0.9 ELSE 0.6 END WHEN error IS NULL THEN 0.6
    WHEN contains(q, 'revenue') OR contains(q, 'region') THEN 0.6 ELSE 0.2 END::DOUBLE AS score,
  len(shown)::BIGINT AS n_rows, md5(array_to_string(shown, chr(10))) AS values_md5 FROM odd_shown""",
    "sql_preview": "SELECT *, 0.6::DOUBLE AS score FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 5)",
    "sql_failure_log": I.with_(ODD)
    + f"""SELECT q AS query, CASE WHEN template = 'A' THEN CASE WHEN yr IS NULL THEN 'SELECT *' ELSE 'SELECT "' || cols[1] || '", "' || yr || '"' END
    || ' FROM doc_table WHERE LOWER("' || cols[1] || '") LIKE ' || chr(39) || '%' || kw || '%' || chr(39)
   WHEN template = 'B' THEN 'SELECT SUM("' || num || '") AS total_sum FROM doc_table'
   WHEN template = 'C' THEN 'SELECT "' || cols[1] || '", "' || yr || '" FROM doc_table' ELSE 'SELECT * FROM doc_table' END AS generated_sql,
  error, array_to_string(cols, chr(31)) AS columns, {_JOIN.format(rows='rows[1:3]')} AS sample_rows FROM odd_chosen WHERE error IS NOT NULL""",
}

"""Typed SQL over extracted tables: type inference, cell typing and the four query templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions import text as tx
from docquarry.functions.rows import let, present
from docquarry.operators import tables as tb

# Null markers, aggregate triggers, concepts and year labels of the templates.
NULL_TOKENS = ["-", "—", "N/A", "null", "None", "nan"]
AGGREGATE_WORDS = ["sum", "average", "avg", "max", "min", "total sum"]
CONCEPTS = [
    "total assets",
    "total equity",
    "total liabilities",
    "cash and cash equivalents",
    "net income",
    "operating expenses",
]
YEARS = ["2018", "2019", "2020", "2021", "2022", "2023", "2024", "2025"]

INTEGER, DECIMAL, VARCHAR = "INTEGER", "DECIMAL(18,2)", "VARCHAR"
_SEPARATOR = r"^\|?\s*:?-+:?\s*(\|?\s*:?-+:?\s*)*\|?$"
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_pipe_table(text: Column) -> Column:
    """``STRUCT<columns, rows>`` from lines holding a pipe; rows of the wrong width are dropped."""
    piped = F.filter(F.transform(tx.lines(text), tx.strip), lambda l: l.contains("|"))
    grid = F.transform(
        F.filter(
            F.transform(piped, lambda l, i: F.when((i == 0) | ~l.rlike(_SEPARATOR), l)),
            lambda l: l.isNotNull(),
        ),
        tb.split_pipe_row,
    )

    def as_table(g: Column) -> Column:
        columns = F.get(g, F.lit(0))
        rows = F.filter(F.slice(g, F.lit(2), F.size(g)), lambda r: F.size(r) == F.size(columns))
        return F.struct(columns.alias("columns"), rows.alias("rows"))

    return let(grid, lambda g: let(as_table(g), lambda t: F.when(F.size(t["rows"]) > 0, t)))


def region_table(regions_table: Column, text: Column) -> Column:
    """The table of a region: its own when extraction gave one, else what its text holds between pipes."""
    return F.coalesce(regions_table, parse_pipe_table(text))


def _bare(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, "[,$€£%]", ""), F.lit("()"))


def _says(bare: Column) -> Column:
    return (bare != "") & ~bare.isin(NULL_TOKENS)


def _typing_text(value: Column) -> Column:
    """What type inference looks at; NULL when the cell says nothing."""
    return F.when(_says(_bare(value)), _bare(value))


_DATE, _INT, _DEC = r"^\d{4}(-\d{2}-\d{2})?$", r"^-?\d+$", r"^-?\d+\.?\d*$"


def infer_type(values: Column) -> Column:
    """SQL type of a column from its cells. All-year columns stay text, as do columns with no values."""
    return let(
        F.filter(F.transform(values, _bare), _says),
        lambda known: F.when((F.size(known) == 0) | F.forall(known, lambda v: v.rlike(_DATE)), VARCHAR)
        .when(F.forall(known, lambda v: v.rlike(_INT)), INTEGER)
        .when(F.forall(known, lambda v: v.rlike(_DEC)), DECIMAL)
        .otherwise(VARCHAR),
    )


def infer_types(columns: Column, rows: Column) -> Column:
    """One type per column of a nested table."""
    return F.transform(
        columns,
        lambda _, i: infer_type(
            F.transform(F.filter(rows, lambda r: i < F.size(r)), lambda r: F.get(r, i))
        ),
    )


def infer_types_long(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Types from one row per cell: three flags per column, combined before the shuffle."""
    bare = _typing_text(F.col(value))
    flags = cells.groupBy(*keys).agg(
        F.count(bare).alias("_n"),
        F.min(bare.rlike(_DATE)).alias("_date"),
        F.min(bare.rlike(_INT)).alias("_int"),
        F.min(bare.rlike(_DEC)).alias("_dec"),
    )
    return flags.select(
        *keys,
        F.when((F.col("_n") == 0) | F.col("_date"), VARCHAR)
        .when(F.col("_int"), INTEGER)
        .when(F.col("_dec"), DECIMAL)
        .otherwise(VARCHAR)
        .alias("sql_type"),
    )


def sanitize_number(value: Column, sql_type: Column) -> Column:
    """Typed numeric value of a cell as DOUBLE; NULL for null markers, unreadable cells and text columns."""
    def signed(bare: Column, negative: Column) -> Column:
        inner = F.when(negative, tx.strip(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)
        return let(inner, lambda i: let(F.when(i.rlike(_FLOAT), i).try_cast("double"), lambda n: typed(n, negative)))

    def typed(number: Column, negative: Column) -> Column:
        whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("double")
        value = F.when(sql_type == INTEGER, whole).otherwise(number)
        return F.when(negative, -value).otherwise(value)

    def of(body: Column) -> Column:
        bare = tx.strip(F.regexp_replace(body, "[,$€£%]", ""))
        negative = lambda b: b.startswith("(") & b.endswith(")") & (F.length(b) > 1)
        return F.when((body != "") & ~body.isin(NULL_TOKENS), let(bare, lambda b: signed(b, negative(b))))

    # each step is bound once, as a lambda's body evaluates whatever it repeats again
    return F.when(sql_type.isin(INTEGER, DECIMAL), let(tx.strip(value), of))


def sanitize_text(value: Column, sql_type: Column) -> Column:
    """Text of a cell in a text column, NULL in numeric columns."""
    return F.when(~sql_type.isin(INTEGER, DECIMAL), tx.strip(value))


def year_column(columns: Column) -> Column:
    """First column naming a year between 2018 and 2025, NULL if none."""
    return F.get(F.filter(columns, lambda c: c.rlike("|".join(YEARS))), F.lit(0))


def _first(words: list[str], query: Column) -> Column:
    return F.get(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(query, w)), F.lit(0))


def template_plan(query: Column, columns: Column, types: Column) -> Column:
    """Which template answers the (lower-cased) query on this table, and its operands.

    A: filter by concept; B: sum of the first numeric column; C: first and year column; D: all rows.
    Triggers are substrings, so "administration" asks for an aggregate.
    """
    concept = _first(CONCEPTS, query)
    wants_sum = _first(AGGREGATE_WORDS, query).isNotNull()
    numeric = F.get(
        F.filter(F.arrays_zip(columns.alias("c"), types.alias("t")), lambda z: z["t"].isin(INTEGER, DECIMAL)),
        F.lit(0),
    )["c"]
    year = year_column(columns)
    template = (
        F.when(concept.isNotNull(), "A")
        .when(wants_sum & numeric.isNotNull(), "B")
        .when(year.isNotNull(), "C")
        .otherwise("D")
    )
    return F.struct(
        template.alias("template"),
        F.element_at(F.split(concept, " "), 1).alias("keyword"),
        F.get(columns, F.lit(0)).alias("label_column"),
        numeric.alias("numeric_column"),
        year.alias("year_column"),
    )


def _quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def template_sql(plan: Column) -> Column:
    """SQL text of a template over ``doc_table`` with quoted identifiers."""
    label, year = _quoted(plan["label_column"]), _quoted(plan["year_column"])
    pair = F.concat(F.lit("SELECT "), label, F.lit(", "), year, F.lit(" FROM doc_table"))
    where = F.concat(F.lit(" WHERE LOWER("), label, F.lit(") LIKE '%"), plan["keyword"], F.lit("%'"))
    return (
        F.when((plan["template"] == "A") & plan["year_column"].isNotNull(), F.concat(pair, where))
        .when(plan["template"] == "A", F.concat(F.lit("SELECT * FROM doc_table"), where))
        .when(
            plan["template"] == "B",
            F.concat(
                F.lit("SELECT SUM("), _quoted(plan["numeric_column"]), F.lit(") AS total_sum FROM doc_table")
            ),
        )
        .when(plan["template"] == "C", pair)
        .otherwise("SELECT * FROM doc_table")
    )


def column_named(query: Column, columns: Column) -> Column:
    """Whether a column name occurs in the lower-cased query."""
    return F.exists(columns, lambda c: F.contains(query, F.lower(c)))


def match_score(query: Column, columns: Column, failed: Column | None = None) -> Column:
    """0.6, and 0.3 more when a column name occurs in the lower-cased query.

    Where the statement failed: 0.6 when a column, "revenue" or "region" does, else 0.2.
    """
    named = column_named(query, columns)
    score = F.when(named, F.lit(0.9)).otherwise(F.lit(0.6))
    if failed is None:
        return score
    weaker = F.when(named | F.contains(query, F.lit("revenue")) | F.contains(query, F.lit("region")), 0.6).otherwise(0.2)
    return F.when(failed, weaker).otherwise(score)


# The ranges of the two numeric types.
_INTEGER_RANGE, _DECIMAL_END = (-(2.0**31), 2.0**31 - 1), 1e16


def _out_of_range(value: Column, sql_type: Column) -> Column:
    def outside(number: Column) -> Column:
        whole = (sql_type == INTEGER) & ~number.between(*_INTEGER_RANGE)
        return whole | ((sql_type == DECIMAL) & (F.abs(number) >= _DECIMAL_END))

    return F.coalesce(let(sanitize_number(value, sql_type), outside), F.lit(False))


def table_error(columns: Column, rows: Column, types: Column) -> Column:
    """Why a table cannot be created or filled; NULL when it can."""
    lowered = F.transform(columns, F.lower)
    wide = F.exists(
        rows,
        lambda r: F.exists(F.arrays_zip(F.slice(r, F.lit(1), F.size(columns)).alias("v"), types.alias("t")), lambda z: _out_of_range(z["v"], z["t"])),
    )
    return (
        F.when(F.size(F.array_distinct(lowered)) < F.size(columns), "repeated column name")
        .when(F.exists(columns, lambda c: (c == "") | F.contains(c, F.lit('"'))), "column name is no identifier")
        .when(wide, "number out of range")
    )


def statement_error(plan: Column, columns: Column, rows: Column, types: Column) -> Column:
    """Why the statement of a plan fails; NULL when it runs. Filters need a text label."""
    numeric_label = (plan["template"] == "A") & (F.get(types, F.lit(0)) != VARCHAR)
    return F.coalesce(table_error(columns, rows, types), F.when(numeric_label, "label column is no text"))


def _record(names: Column, values: Column) -> Column:
    """Names to values, in order; a repeated name holds its last value."""
    entries = F.transform(
        F.array_distinct(names),
        lambda n: F.struct(n, F.get(values, F.size(names) - F.array_position(F.reverse(names), n).cast("int"))),
    )
    return F.map_from_entries(entries)


def typed_text(value: Column, sql_type: Column) -> Column:
    """A cell's typed value as text; NULL for null markers in numeric columns and for missing cells."""
    number = sanitize_number(value, sql_type)
    return (
        F.when(sql_type == INTEGER, number.try_cast("bigint").cast("string"))
        .when(sql_type == DECIMAL, number.try_cast("decimal(18,2)").cast("string"))
        .otherwise(tx.strip(value))
    )


def typed_records(columns: Column, rows: Column, types: Column) -> Column:
    """Rows as maps of column to typed text, padded or cut to the header; a repeated name holds its last value."""
    return F.transform(rows, lambda r: _record(columns, F.transform(columns, lambda c, i: typed_text(F.get(r, i), F.get(types, i)))))


PREVIEW_ROWS = 5


def template_result(plan: Column, columns: Column, rows: Column, types: Column) -> Column:
    """Rows the template returns on a nested table, as ``ARRAY<MAP<column, value>>`` of typed text.

    Short rows are padded and long ones cut to the header. A statement that fails gives the first
    rows as they are.
    """
    typed = F.transform(rows, lambda r: F.transform(columns, lambda c, i: typed_text(F.get(r, i), F.get(types, i))))

    def of(cells: Column) -> Column:
        kept = F.filter(
            cells, lambda r: (plan["template"] != "A") | F.coalesce(F.contains(F.lower(F.get(r, F.lit(0))), plan["keyword"]), F.lit(False))
        )
        position = (F.array_position(columns, plan["numeric_column"]) - 1).cast("int")
        numbers = F.filter(F.transform(cells, lambda r: F.get(r, position)), lambda v: v.isNotNull())
        zero = F.lit(0).cast("decimal(38,2)")
        total = F.aggregate(numbers, zero, lambda acc, v: (acc + v.try_cast("decimal(38,2)")).cast("decimal(38,2)"))
        whole_number = F.get(types, position) == INTEGER
        total = F.when(F.size(numbers) > 0, F.when(whole_number, total.cast("decimal(38,0)").cast("string")).otherwise(total.cast("string")))
        at_year = (F.array_position(columns, plan["year_column"]) - 1).cast("int")
        pair = F.transform(
            kept, lambda r: _record(F.array(plan["label_column"], plan["year_column"]), F.array(F.get(r, F.lit(0)), F.get(r, at_year)))
        )
        narrow = plan["year_column"].isNotNull() & plan["template"].isin("A", "C")
        return (
            F.when(plan["template"] == "B", F.array(F.create_map(F.lit("total_sum"), total)))
            .when(narrow, pair)
            .otherwise(F.transform(kept, lambda r: _record(columns, r)))
        )

    shown = F.transform(F.slice(rows, 1, PREVIEW_ROWS), lambda r: _record(F.slice(columns, F.lit(1), F.size(r)), F.slice(r, F.lit(1), F.size(columns))))
    failed = statement_error(plan, columns, rows, types).isNotNull()
    return F.when(failed, shown).otherwise(let(typed, of))


def typed_rows(cells: DataFrame, columns: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """Pivot one table's cells to typed columns; short rows get NULL. Groups are single rows."""
    wide = cells.groupBy(*keys).pivot("col_idx", list(range(len(columns)))).agg(F.first("value"))
    out = []
    for i, (name, sql_type) in enumerate(columns):
        cell, kind = F.col(str(i)), F.lit(sql_type)
        if sql_type == VARCHAR:
            out.append(sanitize_text(cell, kind).alias(name))
        else:
            spark_type = "bigint" if sql_type == INTEGER else "decimal(18,2)"
            out.append(sanitize_number(cell, kind).try_cast(spark_type).alias(name))
    return wide.select(*keys, *out)


def answer(table: DataFrame, query: str) -> DataFrame:
    """Answer a question on one typed DataFrame: the template becomes a DataFrame expression.

    Only names and types are read on the driver; filter and projection reach the scan.
    """
    lowered = query.lower()
    names = table.columns
    label = names[0]
    year = next((c for c in names if any(y in c for y in YEARS)), None)
    numeric = [f.name for f in table.schema.fields if isinstance(f.dataType, T.NumericType)]
    concept = next((c for c in CONCEPTS if c in lowered), None)

    def col(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    if concept:
        kept = table.filter(F.lower(col(label)).contains(concept.split()[0]))
        return kept.select(col(label), col(year)) if year else kept
    if numeric and any(w in lowered for w in AGGREGATE_WORDS):
        return table.agg(F.sum(col(numeric[0])).alias("total_sum"))
    return table.select(col(label), col(year)) if year else table


def preview(table: DataFrame, query: str, rows: int = PREVIEW_ROWS) -> DataFrame:
    """First rows of a table with the weaker fallback score, for tables that cannot be typed."""
    lowered = query.lower()
    named = any(c.lower() in lowered for c in table.columns) or "revenue" in lowered or "region" in lowered
    return table.limit(rows).withColumn("score", F.lit(0.6 if named else 0.2))


def failure_records(attempts: DataFrame) -> DataFrame:
    """Log rows for failed statements: query, SQL, error, columns and a three-row sample."""
    failed = present(attempts, ["query", "generated_sql", "table"], F.col("error"), "error")
    return failed.select(
        "query",
        "generated_sql",
        "error",
        F.col("table.columns").alias("columns"),
        F.slice("table.rows", 1, 3).alias("sample_rows"),
    )

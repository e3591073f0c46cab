"""Extracted tables: headers, cells, serialisation and checks.

A table is a nested value of one row (``columns ARRAY<STRING>``, ``rows ARRAY<ARRAY<STRING>>``), as
large as the region it came from, so everything is a column expression evaluated in place. Only
the span grid, whose input is one row per cell, groups, and it groups by (table, row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.rows import let

# Characters removed before a cell is read as a number.
_CURRENCY = "[$,€£%]"
_INTEGER = r"^[+-]?\d+$"
_FLOAT = r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"
# Without a digit a cell is no number; a sign and the zeros before a digit that follow it.
_DIGIT = "[0-9]"
_LEADING = r"^[+-]?(?:0+(?=\d))?"
# Numbers in plain notation already, but for zeros at their end.
_PLAIN = r"\A(?:0|[1-9]\d*)(?:\.\d+)?\z"
_TRAILING = r"(\.\d*?[1-9]|\.0)0*\z"
# Characters that a JSON string escapes, or that stand for bytes that are no text.
_JSON_ESCAPED = r'["\\\x00-\x1f\x{FFFD}]'
_HTML_ESCAPED = '[&<>"]'


def _column_label(index: Column) -> Column:
    return F.concat(F.lit("col_"), (index + 1).cast("string"))


def header_hierarchy(header_rows: Column, n_cols: Column) -> Column:
    """Path of header texts above each column; ``header_rows`` is rows of ``STRUCT<text, colspan>``."""
    spread = F.transform(
        header_rows,
        lambda row: F.flatten(
            F.transform(
                row,
                lambda c: F.array_repeat(
                    tx.strip(F.coalesce(c["text"], F.lit(""))), F.greatest(F.lit(1), c["colspan"])
                ),
            )
        ),
    )

    def path(rows: Column, i: Column) -> Column:
        found = F.filter(F.transform(rows, lambda row: F.get(row, i)), lambda t: t != "")
        return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(_column_label(i))))

    def paths(n: Column) -> Column:
        return F.when(n > 0, let(spread, lambda rows: F.transform(F.sequence(F.lit(0), n - 1), lambda i: path(rows, i)))).otherwise(
            F.array().cast("array<array<string>>"))

    return let(n_cols, paths)


def flatten_column_name(path: Column) -> Column:
    parts = F.transform(
        path, lambda p: F.trim(F.regexp_replace(F.lower(p), "[^a-zA-Z0-9]+", "_"), F.lit("_"))
    )
    joined = F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), "_")
    return let(joined, lambda j: F.when(j != "", j).otherwise("col"))


def dedup_columns(names: Column) -> Column:
    """Second and later uses of a name get ``_2``, ``_3`` and so on.

    Names are sorted with their places once, numbered within each run of equals, and sorted back.
    """
    placed = F.sort_array(F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("place"))))

    def opens(run: Column, p: Column) -> Column:
        return (p == 0) | (F.get(run, p - 1)["name"] != F.get(run, p)["name"])

    def numbered(run: Column, starts: Column, start: Column, g: Column) -> Column:
        last = F.coalesce(F.get(starts, g + 1), F.size(run)) - 1

        def use(p: Column) -> Column:
            name = F.get(run, p)["name"]
            unique = F.when(p == start, name).otherwise(F.concat_ws("_", name, (p - start + 1).cast("string")))
            return F.struct(F.get(run, p)["place"].alias("place"), unique.alias("name"))

        return F.transform(F.sequence(start, last), use)

    def whole(run: Column) -> Column:
        starts = F.filter(F.transform(run, lambda _, p: F.when(opens(run, p), p)), lambda p: p.isNotNull())
        groups = let(starts, lambda at: F.transform(at, lambda start, g: numbered(run, at, start, g)))
        return F.transform(F.sort_array(F.flatten(groups)), lambda u: u["name"])

    return let(placed, whole)


def _unwrapped(value: Column) -> Column:
    """``STRUCT<digits, negative>``: the cell without currency signs, whether parentheses made it negative."""

    def unwrapped(body: Column) -> Column:
        negative = body.startswith("(") & body.endswith(")") & (F.length(body) > 1)
        inner = F.when(negative, tx.strip(F.substring(body, F.lit(2), F.length(body) - 2))).otherwise(body)
        return F.struct(tx.strip(F.regexp_replace(inner, _CURRENCY, "")).alias("digits"), negative.alias("negative"))

    return let(tx.strip(value), unwrapped)


def _signed(cell: Column) -> Column:
    digits = cell["digits"]
    number = F.when(digits.rlike(_INTEGER) | digits.rlike(_FLOAT), digits).try_cast("double")
    return F.when(cell["negative"], -number).otherwise(number)


def numeric_value(value: Column) -> Column:
    """The cell as DOUBLE with accounting negatives, NULL when it is not a number."""
    return F.when(value.rlike(_DIGIT), let(_unwrapped(value), _signed))


def number_text(value: Column) -> Column:
    """The cell in plain notation (``(1,234.50)`` to ``-1234.5``), NULL when it is not a number."""

    def or_zero(text: Column) -> Column:
        return let(text, lambda t: F.when(t == "", "0").otherwise(t))

    def plain(cell: Column) -> Column:
        digits = cell["digits"]
        sign = F.when(cell["negative"] != digits.startswith("-"), "-").otherwise("")
        bare = F.regexp_replace(digits, _LEADING, "")

        def fixed(number: Column) -> Column:
            whole, fraction = F.regexp_extract(number, r"^\d*", 0), F.regexp_extract(number, r"\.(\d*)", 1)
            return F.concat(sign, or_zero(whole), F.lit("."), or_zero(F.regexp_replace(fraction, "0+$", "")))

        return F.when(digits.rlike(_INTEGER), let(bare, lambda b: F.concat(F.when(b != "0", sign).otherwise(""), b))).when(
            digits.rlike(_FLOAT), F.when(digits.rlike("[eE]"), _signed(cell).cast("string")).otherwise(let(bare, fixed)))

    usual = F.when(value.rlike(_PLAIN), F.regexp_replace(value, _TRAILING, "$1")).otherwise(let(_unwrapped(value), plain))
    return F.when(value.rlike(_DIGIT), usual)


def normalize_cell(value: Column) -> Column:
    """The cell with numbers in plain notation (``(1,234.50)`` to ``-1234.5``), others unchanged."""
    return F.coalesce(number_text(value), value)


def unit_multiplier(text: Column) -> Column:
    lowered = F.lower(text)

    def says(unit: str) -> Column:
        return lowered.contains(f"in {unit}") | lowered.contains(f"({unit})")

    return (
        F.when(says("millions"), F.lit(1_000_000))
        .when(says("thousands"), F.lit(1_000))
        .when(says("billions"), F.lit(1_000_000_000))
        .otherwise(F.lit(1))
        .cast("bigint")
    )


def split_pipe_row(line: Column) -> Column:
    return F.transform(F.split(F.trim(line, F.lit("|")), r"\|"), tx.strip)


def markdown_grid(md: Column) -> Column:
    """Rows of lines that start with a pipe, without separator rows."""
    rows = F.transform(
        F.filter(F.transform(tx.lines(md), tx.strip), lambda l: l.startswith("|")), split_pipe_row
    )
    return F.filter(rows, lambda r: F.exists(r, lambda c: ~c.rlike("^[-: ]*$")))


def table_from_grid(grid: Column) -> Column:
    """``STRUCT<columns, rows>`` when the grid has a header and at least one row, else NULL."""
    return let(
        grid,
        lambda g: F.when(
            F.size(g) >= 2,
            F.struct(
                F.get(g, F.lit(0)).alias("columns"), F.slice(g, F.lit(2), F.size(g)).alias("rows")
            ),
        ),
    )


def _padded(row: Column, n: Column) -> Column:
    return F.when(F.size(row) >= n, row).otherwise(F.concat(row, F.array_repeat(F.lit(""), n - F.size(row))))


def _pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def to_markdown(columns: Column, rows: Column) -> Column:
    widest = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))

    def body(n: Column) -> Column:
        return F.concat(
            F.array(_pipe_row(_padded(columns, n)), _pipe_row(F.array_repeat(F.lit("---"), n))),
            F.transform(rows, lambda r: _pipe_row(_padded(r, n))),
        )

    text = let(F.greatest(F.size(columns), widest), lambda n: F.array_join(body(n), "\n"))
    return F.when(F.size(columns) > 0, text).otherwise("")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def to_html(columns: Column, rows: Column) -> Column:
    def cells(tag: str, row: Column) -> Column:
        """Lines of a row that has cells: joined as they are if none needs an escape."""
        opened, closed = f"    <{tag}>", f"</{tag}>"
        escaped = F.transform(row, lambda c: F.concat(F.lit(opened), escape_html(c), F.lit(closed)))
        as_is = F.concat(F.lit(opened), F.array_join(row, f"{closed}\n{opened}"), F.lit(closed))
        # a null cell is no line; it counts as one that needs an escape
        return F.when(F.array_join(row, "", "&").rlike(_HTML_ESCAPED), F.array_join(F.concat(escaped, F.array(F.lit(""))), "\n")).otherwise(F.concat(as_is, F.lit("\n")))

    def line(row: Column) -> Column:
        return F.concat(F.lit("  <tr>\n"), F.when(F.size(row) > 0, cells("td", row)).otherwise(""), F.lit("  </tr>"))

    # no row may be null, else the table has no HTML
    body = F.flatten(F.transform(rows, lambda r: F.when(r.isNotNull(), F.array(line(r)))))
    head = F.concat(F.lit("<table>\n  <thead><tr>\n"), cells("th", columns), F.lit("  </tr></thead>\n  <tbody>"))
    text = F.array_join(F.concat(F.array(head), body, F.array(F.lit("  </tbody>"), F.lit("</table>"))), "\n")
    return F.when(F.size(columns) > 0, text).otherwise("")


def is_valid_table(columns: Column, rows: Column) -> Column:
    n = F.size(columns)
    return (n > 0) & (F.size(rows) > 0) & F.forall(rows, lambda r: F.size(r) == n)


def sanitize_stub_columns(columns: Column, rows: Column) -> Column:
    """Realign a fallback header that slid to the end, and name a generic stub ``description``.

    Both need at least a quarter of the first-column cells to hold words; cells that read as
    numbers do not count.
    """
    labels = F.filter(
        rows,
        lambda r: F.coalesce(F.get(r, F.lit(0)).rlike("[a-zA-Z]{2,}"), F.lit(False)),
    )
    wordy = F.size(labels) / F.greatest(F.size(rows), F.lit(1)) >= 0.25

    def realigned(is_wordy: Column) -> Column:
        last, first = F.element_at(columns, -1), F.element_at(columns, 1)
        shifted = (F.size(columns) > 1) & last.startswith("col") & ~first.startswith("col")
        moved = F.when(
            shifted & is_wordy, F.concat(F.array(last), F.slice(columns, F.lit(1), F.size(columns) - 1))
        ).otherwise(columns)
        return let(moved, lambda m: F.when(
            is_wordy & F.element_at(m, 1).startswith("col"), F.concat(F.array(F.lit("description")), F.slice(m, F.lit(2), F.size(m)))
        ).otherwise(m))

    return F.when((F.size(columns) > 0) & (F.size(rows) > 0), let(wordy, realigned)).otherwise(columns)


def spatial_sort(cells: Column) -> Column:
    """Cells by (top, left) of their box, falling back to their grid offsets; stable."""
    keyed = F.transform(
        cells,
        lambda c, i: F.struct(
            F.coalesce(c["bbox"]["y0"], c["row"].cast("double")).alias("y"),
            F.coalesce(c["bbox"]["x0"], c["col"].cast("double")).alias("x"),
            i.alias("i"),
            c.alias("cell"),
        ),
    )
    ordered = F.array_sort(
        keyed,
        lambda a, b: F.when(a["y"] < b["y"], -1)
        .when(a["y"] > b["y"], 1)
        .when(a["x"] < b["x"], -1)
        .when(a["x"] > b["x"], 1)
        .otherwise(a["i"] - b["i"]),
    )
    return F.transform(ordered, lambda k: k["cell"])


def header_row_count(cells: Column) -> Column:
    """How many top rows are headers: flagged rows among the first three, at least one."""
    flagged = F.transform(
        F.filter(cells, lambda c: c["column_header"] & (c["row"] < 3)), lambda c: c["row"]
    )
    return let(flagged, lambda rows: F.when(F.size(rows) > 0, F.array_max(rows) + 1).otherwise(1))


def cells_to_grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell to one row per grid row, blanks filled.

    Cells: keys plus ``row, col, row_span, col_span, cell_no, text``. The groups are single grid
    rows, so a table holding most of all cells still spreads over many tasks.
    """
    dims = cells.groupBy(*keys).agg(
        F.max(F.col("row") + F.col("row_span")).alias("n_rows"),
        F.max(F.col("col") + F.col("col_span")).alias("n_cols"),
    )
    frame = dims.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    last = cells.groupBy(*keys, "row", "col").agg(F.max_by("text", F.struct("cell_no", "text")).alias("text"))
    filled = last.groupBy(*keys, "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("by_col")
    )
    return (
        frame.join(filled, [*keys, "row"], "left")
        .withColumn(
            "cells",
            F.transform(
                F.sequence(F.lit(0), F.col("n_cols") - 1),
                lambda c: F.coalesce(F.try_element_at("by_col", c), F.lit("")),
            ),
        )
        .select(*keys, "row", "cells")
    )


def grid_of_cells(cells: Column) -> Column:
    """Rows of a table's cell array, blanks filled; of cells at one place the last counts.

    Cells are laid out in reading order with the gaps between them, so the work is that of the grid's size.
    """
    n_rows = F.array_max(F.transform(cells, lambda c: c["row"] + c["row_span"]))
    n_cols = F.array_max(F.transform(cells, lambda c: c["col"] + c["col_span"]))

    def laid_out(width: Column, height: Column) -> Column:
        inside = lambda c: (c["row"] >= 0) & (c["col"] >= 0) & (c["row"] < height) & (c["col"] < width)
        placed = F.transform(cells, lambda c, i: F.struct((c["row"] * width + c["col"]).alias("at"), i.alias("i"), inside(c).alias("ok"), F.coalesce(c["text"], F.lit("")).alias("text")))
        ordered = F.sort_array(F.filter(placed, lambda p: p["ok"]))
        last = let(ordered, lambda o: F.filter(o, lambda p, i: F.coalesce(F.get(o, i + 1)["at"] != p["at"], F.lit(True))))

        def filled(o: Column) -> Column:
            gaps = F.transform(o, lambda p, i: F.array_append(
                F.array_repeat(F.lit(""), (p["at"] - F.coalesce(F.get(o, i - 1)["at"], F.lit(-1)) - 1).cast("int")), p["text"]))
            flat = F.flatten(gaps)
            return let(flat, lambda f: F.concat(f, F.array_repeat(F.lit(""), (width * height - F.size(f)).cast("int"))))

        return let(let(last, filled), lambda f: F.transform(F.sequence(F.lit(0), height - 1), lambda r: F.slice(f, (r * width + 1).cast("int"), width.cast("int"))))

    return let(F.struct(n_cols.alias("w"), n_rows.alias("h")), lambda z: F.when((z["w"] > 0) & (z["h"] > 0), laid_out(z["w"], z["h"])))


def header_cells(cells: Column, n_header: Column) -> Column:
    """Header rows of spatially ordered cells, as rows of ``STRUCT<text, colspan>``."""
    ordered = spatial_sort(F.filter(cells, lambda c: (c["row"] >= 0) & (c["row"] < n_header)))
    return let(ordered, lambda o: F.transform(F.sequence(F.lit(0), n_header - 1), lambda r: F.transform(
        F.filter(o, lambda c: c["row"] == r), lambda c: F.struct(F.coalesce(c["text"], F.lit("")).alias("text"), c["col_span"].cast("int").alias("colspan")))))


def read_cells(rows: Column) -> Column:
    """Rows of ``STRUCT<raw, number>``: each cell as it is, and its number in plain notation or NULL; read once for all forms of a table."""
    return F.transform(rows, lambda r: F.transform(r, lambda c: F.struct(c.alias("raw"), number_text(c).alias("number"))))


def _json_cell(cell: Column) -> Column:
    """A read cell as JSON: numbers bare, other texts quoted."""
    raw = cell["raw"]
    escaped = let(F.to_json(F.array(raw)), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    quoted = F.when(raw.rlike(_JSON_ESCAPED), escaped).otherwise(F.concat(F.lit('"'), raw, F.lit('"')))
    return F.coalesce(cell["number"], quoted, F.lit("null"))


def table_json(columns: Column, header_paths: Column, cells: Column, multiplier: Column, valid: Column) -> Column:
    """The table's schema and ``read_cells`` of its rows as one JSON object, numbers as numbers."""
    rows = F.array_join(F.transform(cells, lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, _json_cell), ", "), F.lit("]"))), ", ")
    parts = {"columns": F.to_json(columns), "header_paths": F.to_json(header_paths), "rows": F.concat(F.lit("["), rows, F.lit("]")),
             "unit_multiplier": multiplier.cast("string"), "is_valid_structure": valid.cast("string")}
    pairs = [F.concat(F.lit(f'"{name}": '), value) for name, value in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def enrich(df: DataFrame, grid: str = "grid", text: str = "text", cells: str | None = None) -> DataFrame:
    """Serialise a table: columns, normalised rows, Markdown, HTML, JSON, unit multiplier, validity.

    ``cells`` names an array of ``row, col, row_span, col_span, column_header, text, bbox`` structs per
    table. With cells, headers are the flagged rows among the first three (at least one), their texts
    ordered by position on the page and spread over their spans; where ``grid`` is null or empty it is
    laid out from them. Without cells the first row is the header. Tables without a grid are left out.
    """
    if cells is not None:
        some = F.coalesce(F.size(cells) > 0, F.lit(False))
        df = df.withColumn(grid, F.when(F.size(grid) > 0, F.col(grid)).when(some, grid_of_cells(F.col(cells))))
        df = df.withColumn("_n_header", F.when(some, header_row_count(F.col(cells))).otherwise(F.lit(1)))
        df = df.withColumn("_heads", F.when(some, header_cells(F.col(cells), F.col("_n_header"))))
    g = F.col(grid)
    n_cols = F.array_max(F.transform(g, F.size))
    first_row = F.array(
        F.transform(F.get(g, F.lit(0)), lambda c: F.struct(c.alias("text"), F.lit(1).alias("colspan")))
    )
    if cells is None:
        df = df.withColumn("_n_header", F.lit(1)).withColumn("_heads", first_row)
    else:
        none = ~F.exists(F.coalesce(F.col("_heads"), F.array().cast("array<array<struct<text:string,colspan:int>>>")), lambda r: F.size(r) > 0)
        df = df.withColumn("_none", none)
        df = df.withColumn("_n_header", F.when(F.col("_none"), F.lit(1)).otherwise(F.col("_n_header"))).withColumn("_heads", F.when(F.col("_none"), first_row).otherwise(F.col("_heads"))).drop("_none")
    # a filter on a generated value is not pushed below the grid, which would be built once more for it
    df = df.select("*", F.explode_outer(F.array(F.size(g) > 0)).alias("_some")).filter("_some").drop("_some")
    return (
        df.withColumn("header_paths", header_hierarchy(F.col("_heads"), n_cols))
        .withColumn("_names", F.transform("header_paths", flatten_column_name))
        .withColumn("_unique", dedup_columns(F.col("_names")))
        .withColumn("_cells", read_cells(F.slice(g, F.col("_n_header") + 1, F.greatest(F.size(g), F.lit(1)))))
        .withColumn("rows", F.transform("_cells", lambda r: F.transform(r, lambda c: F.coalesce(c["number"], c["raw"]))))
        .withColumn("columns", sanitize_stub_columns(F.col("_unique"), F.col("rows")))
        .withColumn("table_markdown", to_markdown(F.col("columns"), F.col("rows")))
        .withColumn("table_html", to_html(F.col("columns"), F.col("rows")))
        .withColumn(
            "unit_multiplier", unit_multiplier(F.coalesce(tx.nonblank(F.col(text)), F.col("table_markdown")))
        )
        .withColumn("is_valid_structure", is_valid_table(F.col("columns"), F.col("rows")))
        .withColumn("table_json", table_json(F.col("columns"), F.col("header_paths"), F.col("_cells"), F.col("unit_multiplier"), F.col("is_valid_structure")))
        .drop("_names", "_unique", "_cells", "_heads", "_n_header")
    )


def with_region_table(regions: DataFrame) -> DataFrame:
    """Add ``table STRUCT<columns, rows>`` and ``table_markdown`` to table regions that hold a pipe grid."""
    grid = F.when(F.col("type") == "table", markdown_grid(F.col("text")))
    found = regions.withColumn("_grid", grid).withColumn("table", table_from_grid(F.col("_grid")))
    return found.withColumn("table_markdown", F.when(F.col("table").isNotNull(), F.col("text"))).drop("_grid")

"""Registered queries over ingestion, segmentation and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions.rows import unnest
from docquarry.operators import chunk as ck
from docquarry.operators import segment as sg
from docquarry.plans import inputs as I

HEAD = I.with_(I.REGIONS)


def ing_segment_regions(spark, sf):
    return I.regions(spark, sf).select(
        "document_id", "region_id", "region_idx", "type", "text", "start", "end"
    )


def ing_region_modality(spark, sf):
    return I.regions(spark, sf).groupBy("type", "modality").agg(F.count("*").alias("n"))


def ing_modality_split(spark, sf):
    return sg.modality_split(I.parsed(spark, sf))


def ing_doc_title(spark, sf):
    return sg.document_titles(I.parsed(spark, sf)).select("document_id", "title")


def ing_document_ids(spark, sf):
    docs = I.corpus(spark, sf)
    doc = sg.document_id(F.col("path"))
    region = sg.region_id(doc, F.lit(0))
    return docs.select(
        "path",
        doc.alias("document_id"),
        region.alias("region_id"),
        sg.chunk_id(region, F.lit(0)).alias("chunk_id"),
    )


def ing_region_chunks(spark, sf):
    return sg.region_chunks(I.regions(spark, sf)).drop("doc_pos", "region_idx")


def chunk_heading_binding(spark, sf):
    groups = ck.explode_groups(ck.with_groups(I.parsed(spark, sf)))
    return groups.select("document_id", "grp", "region_idx", "n_regions", "type", "text")


def chunk_field_weight(spark, sf):
    groups = ck.explode_groups(ck.with_groups(I.parsed(spark, sf)))
    return groups.groupBy("type", "field_weight").agg(F.count("*").alias("n"))


def chunk_ancestry_header(spark, sf):
    parts = F.array(F.lit(" "), F.col("lang"), F.concat(F.lit(" "), F.col("source")))
    return I.table(spark, sf, "documents").select("doc_id", ck.ancestry_header(parts).alias("header"))


def chunk_section_path(spark, sf):
    groups = ck.section_groups(ck.with_groups(I.titled(spark, sf)))
    return groups.select("document_id", "grp", "section", "ancestry_header")


def chunk_token_windows(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    return ck.token_windows(docs, size=64, overlap=16).select("doc_id", "win", "token_count", "window_text")


def chunk_section_aware(spark, sf):
    return ck.section_chunks(I.titled(spark, sf), size=48, overlap=12)


def _figures(spark, sf):
    """Regions with page numbers and boxes; short figure lines lose their text to need a caption."""
    regions = I.regions(spark, sf).withColumn("page_no", F.expr("cast(start div 3 as int) - 1"))
    return regions.withColumn(
        "bbox",
        F.when(
            F.length("text") % 2 == 0,
            F.struct(
                F.lit(0.0).alias("x0"),
                F.lit(0.0).alias("y0"),
                (F.length("text") / 4.0).cast("double").alias("x1"),
                F.col("start").cast("double").alias("y1"),
            ),
        ),
    ).withColumn(
        "text",
        F.when((F.col("type") == "figure") & (F.length("text") % 3 == 0), "figure")
        .when((F.col("type") == "figure") & (F.length("text") % 3 == 1), "")
        .otherwise(F.col("text")),
    ).withColumn("doc_title", F.when(F.length("document_id") > 0, F.col("path")))


def ing_figure_caption(spark, sf):
    out = sg.caption_figures(_figures(spark, sf))
    return out.filter(F.col("type") == "figure").select("document_id", "region_idx", "caption")


def ing_page_char_counts(spark, sf):
    return sg.page_char_counts(_figures(spark, sf))


def _page_list(spark, sf):
    """Every page of every document, as its lines number them."""
    lines = F.size(F.split("text", "\n"))
    docs = I.corpus(spark, sf).select(
        sg.document_id(F.col("path")).alias("document_id"),
        F.length("text").alias("n"),
        F.greatest(F.floor((lines - 1) / 3) - 1, F.lit(0)).cast("int").alias("last_page"),
    )
    return docs.select(
        "document_id",
        F.explode(F.sequence(F.lit(0), F.col("last_page"))).alias("page_no"),
        (F.col("n") % 2 == 0).alias("has_image"),
    )


def ing_scanned_pages(spark, sf):
    counts = sg.page_char_counts(_figures(spark, sf))
    out = sg.scanned_pages(_page_list(spark, sf), counts, min_chars=200)
    return out.select("document_id", "page_no", F.col("n_chars").cast("bigint").alias("n_chars"))


# The item classes a layout model reports, for tags found in raw pages.
_TAG_ITEMS = {"h1": "SectionHeaderItem", "p": "TextItem", "li": "ListItem", "table": "TableItem", "img": "PictureItem"}


def _layout_items(spark, sf):
    """Tagged elements of raw pages as layout items."""
    found = F.regexp_extract_all("html", F.lit(r"(<(?:h1|p|li|nav|footer|table)>[^<]*)"), F.lit(1))
    items = unnest(I.table(spark, sf, "pages"), ["page_id"], found, "raw", "item_no")
    tag = F.regexp_extract("raw", "<([a-z0-9]+)>", 1)
    lookup = F.create_map(*[F.lit(x) for pair in _TAG_ITEMS.items() for x in pair])
    return items.select(
        "page_id",
        "item_no",
        F.coalesce(F.try_element_at(lookup, tag), F.lit("GroupItem")).alias("item_type"),
        F.lit("").alias("markdown"),
        F.regexp_replace("raw", "^<[a-z0-9]+>", "").alias("item_text"),
        F.lit(None).cast("string").alias("orig"),
        F.array(
            F.struct(
                (F.col("item_no") / 10).cast("int").alias("page_no"),
                F.struct(
                    F.lit(0.0).alias("x0"),
                    F.col("item_no").cast("double").alias("y0"),
                    F.lit(1.0).alias("x1"),
                    (F.col("item_no") + 1).cast("double").alias("y1"),
                ).alias("bbox"),
            )
        ).alias("provenance"),
    )


def ing_html_layout(spark, sf):
    return sg.layout_items_to_regions(_layout_items(spark, sf)).select(
        "page_id", "item_no", "type", "text", "page_no", F.col("bbox.y1").alias("y1")
    )


QUERIES = {
    f.__name__: f
    for f in (
        ing_segment_regions,
        ing_region_modality,
        ing_modality_split,
        ing_doc_title,
        ing_document_ids,
        ing_region_chunks,
        chunk_heading_binding,
        chunk_field_weight,
        chunk_ancestry_header,
        chunk_section_path,
        chunk_token_windows,
        chunk_section_aware,
        ing_figure_caption,
        ing_page_char_counts,
        ing_scanned_pages,
        ing_html_layout,
    )
}

# Greedy binding restated as parity within maximal heading runs.
GROUPS = I.REGIONS + """,
flagged AS (
  SELECT *, (type = 'title' OR (length(text) < 60 AND text LIKE '#%')
             OR (length(text) < 50 AND NOT contains(text, chr(10)))) AS heading,
         max(region_idx) OVER (PARTITION BY doc_pos) AS last_idx
  FROM regions),
runs AS (
  SELECT *, region_idx - coalesce(max(CASE WHEN NOT heading THEN region_idx END)
            OVER (PARTITION BY doc_pos ORDER BY region_idx), -1) AS pos_in_run
  FROM flagged),
lead_flags AS (SELECT *, (heading AND pos_in_run % 2 = 1 AND region_idx < last_idx) AS leads FROM runs),
roles AS (
  SELECT *, coalesce(lag(leads) OVER (PARTITION BY doc_pos ORDER BY region_idx), false) AS follows FROM lead_flags),
grouped AS (
  SELECT *, sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER (PARTITION BY doc_pos ORDER BY region_idx) - 1 AS grp,
         CASE type WHEN 'table' THEN 3.0 WHEN 'title' THEN 1.0 ELSE 2.5 END::DOUBLE AS weight
  FROM roles),
groups AS (
  SELECT doc_pos, document_id, grp::BIGINT AS grp, min(region_idx) AS region_idx, count(*) AS n_regions,
         arg_min(type, region_idx) AS type, string_agg(text, chr(10) || chr(10) ORDER BY region_idx) AS text,
         max(weight) AS field_weight
  FROM grouped GROUP BY doc_pos, document_id, grp)"""

SECTIONS = GROUPS + """,
headed AS (
  SELECT g.*, t.title,
         CASE WHEN g.type = 'title' OR g.text LIKE '#%'
              THEN nullif(trim(regexp_replace(string_split(g.text, chr(10))[1], '^#+\\s*', '')), '') END AS head
  FROM groups g JOIN titles t USING (doc_pos)),
sections AS (
  SELECT *, concat_ws(' > ', title, last_value(head IGNORE NULLS)
            OVER (PARTITION BY doc_pos ORDER BY grp ROWS UNBOUNDED PRECEDING)) AS section
  FROM headed)"""


def _windows(source: str, key: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""tok AS (
  SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS tokens FROM {source}),
wins AS (
  SELECT *, unnest(range(0, CASE WHEN len(tokens) = 0 THEN 0 WHEN len(tokens) <= {size} THEN 1
                    ELSE 1 + ceil((len(tokens) - {size}) / {step}::DOUBLE)::BIGINT END)) AS win FROM tok),
windows AS (
  SELECT *, tokens[win * {step} + 1 : win * {step} + {size}] AS part FROM wins)"""


_FIGURES = I.REGIONS + """,
fig AS (
  SELECT document_id, doc_pos, region_idx, type, path AS doc_title, start // 3 - 1 AS page_no,
         CASE WHEN length(text) % 2 = 0 THEN length(text) / 4.0::DOUBLE END AS w, start::DOUBLE AS h,
         CASE WHEN type = 'figure' AND length(text) % 3 = 0 THEN 'figure'
              WHEN type = 'figure' AND length(text) % 3 = 1 THEN '' ELSE text END AS text
  FROM regions),
counts AS (
  SELECT document_id, page_no, sum(length(text))::BIGINT AS n_chars FROM fig WHERE page_no >= 0 GROUP BY ALL)"""

ORACLES = {
    "ing_segment_regions": HEAD
    + """SELECT document_id, document_id || '-region-' || region_idx AS region_id, region_idx, type, text, start, "end"
FROM regions""",
    "ing_region_modality": HEAD + "SELECT type, modality, count(*) AS n FROM regions GROUP BY ALL",
    "ing_modality_split": HEAD
    + """SELECT document_id, count(*) FILTER (modality = 'text') AS text_regions,
 count(*) FILTER (modality = 'table') AS table_regions, count(*) FILTER (modality = 'vision') AS vision_regions
FROM corpus c LEFT JOIN regions r USING (document_id) GROUP BY document_id""",
    "ing_doc_title": HEAD + "SELECT document_id, title FROM titles",
    "ing_document_ids": I.with_(I.CORPUS)
    + """SELECT path, document_id, document_id || '-region-0' AS region_id,
 document_id || '-region-0-chunk-0' AS chunk_id FROM corpus""",
    "ing_region_chunks": HEAD
    + """SELECT document_id || '-region-' || region_idx || '-chunk-' || region_idx AS chunk_id, document_id,
 document_id || '-region-' || region_idx AS region_id, modality, text, type AS region_type,
 stem || '.txt' AS source_path, 'docquarry-v1' AS namespace, 'rule' AS layout_source FROM regions""",
    "chunk_heading_binding": I.with_(GROUPS)
    + "SELECT document_id, grp, region_idx, n_regions, type, text FROM groups",
    "chunk_field_weight": I.with_(GROUPS)
    + "SELECT type, field_weight, count(*) AS n FROM groups GROUP BY ALL",
    "chunk_ancestry_header": "SELECT doc_id, 'Metadata Header: ' || lang || ' > ' || source || chr(10) AS header FROM documents",
    "chunk_section_path": I.with_(SECTIONS)
    + "SELECT document_id, grp, section, 'Metadata Header: ' || section || chr(10) AS ancestry_header FROM sections",
    "chunk_token_windows": I.with_(_windows("documents", "doc_id", 64, 16))
    + "SELECT doc_id, win, len(part) AS token_count, array_to_string(part, ' ') AS window_text FROM windows",
    "chunk_section_aware": I.with_(SECTIONS, _windows("sections", "document_id", 48, 12))
    + """SELECT document_id || '-' || type || '-' || (grp + 1) || '-' || (win + 1) AS chunk_id, document_id,
 document_id || '-region-' || (grp + 1) AS region_id,
 CASE type WHEN 'table' THEN 'table' WHEN 'figure' THEN 'vision' ELSE 'text' END AS modality,
 'Metadata Header: ' || section || chr(10) || array_to_string(part, ' ') AS text, section,
 'Metadata Header: ' || section AS ancestry_header, text AS parent_text, field_weight, win AS chunk_index,
 len(part) AS token_count, type AS region_type FROM windows""",
    "ing_figure_caption": I.with_(_FIGURES)
    + f"""SELECT document_id, region_idx,
 CASE WHEN length(text) > 8 THEN text ELSE
  CASE WHEN text = 'figure' THEN 'figure - ' ELSE '' END || 'Figure'
  || CASE WHEN page_no >= 0 THEN ' on page ' || (page_no + 1) ELSE '' END || ' from ' || doc_title
  || CASE WHEN w IS NOT NULL THEN ' (' || {I.rnd('w', 1)} || '×' || {I.rnd('h', 1)} || ' pts)' ELSE '' END END AS caption
FROM fig WHERE type = 'figure'""",
    "ing_page_char_counts": I.with_(_FIGURES) + "SELECT * FROM counts",
    "ing_scanned_pages": I.with_(_FIGURES)
    + """SELECT p.document_id, p.page_no, coalesce(n_chars, 0) AS n_chars
FROM (SELECT document_id, unnest(range(0, greatest((len(string_split(text, chr(10))) - 1) // 3 - 1, 0) + 1)) AS page_no FROM corpus WHERE length(text) % 2 = 0) p
LEFT JOIN counts c ON c.document_id = p.document_id AND c.page_no = p.page_no
WHERE coalesce(n_chars, 0) < 200""",
    "ing_html_layout": """WITH m AS (
  SELECT page_id, regexp_extract_all(html, '<(?:h1|p|li|nav|footer|table)>[^<]*') AS found FROM pages),
items AS (
  SELECT page_id, unnest(found) AS raw, generate_subscripts(found, 1) - 1 AS item_no FROM m),
typed AS (
  SELECT page_id, item_no, regexp_replace(raw, '^<[a-z0-9]+>', '') AS text,
         CASE regexp_extract(raw, '<([a-z0-9]+)>', 1) WHEN 'h1' THEN 'title' WHEN 'p' THEN 'body' WHEN 'li' THEN 'body'
              WHEN 'table' THEN 'table' END AS type FROM items)
SELECT page_id, item_no, type, text, item_no // 10 AS page_no, (item_no + 1)::DOUBLE AS y1 FROM typed
WHERE type IS NOT NULL AND (regexp_matches(text, '\\S') OR type = 'table')""",
}

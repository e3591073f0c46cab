"""Section-aware chunking: bind headings, carry the section path, cut overlapping windows.

Works on documents that hold a ``regions`` array and never leaves the document's own row until the
final explode, so there is no shuffle. Greedy heading binding is a left-to-right scan; a regular
expression over a one-letter-per-region string performs exactly that scan in one native call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.rows import unnest
from docquarry.operators import segment as sg


def ancestry_header(hierarchy: Column) -> Column:
    """``Metadata Header: A > B`` and a line break, or '' when nothing is left after trimming."""
    parts = F.filter(
        F.transform(hierarchy, lambda h: tx.strip(F.coalesce(h, F.lit("")))), lambda h: h != ""
    )
    return F.when(
        F.size(parts) > 0, F.concat(F.lit("Metadata Header: "), F.array_join(parts, " > "), F.lit("\n"))
    ).otherwise("")


def field_weight(region_type: Column) -> Column:
    return (
        F.when(region_type == "table", F.lit(3.0))
        .when(region_type.isin("title", "header"), F.lit(1.0))
        .otherwise(F.lit(2.5))
    )


def is_heading(region: Column) -> Column:
    body = tx.strip(region["text"])
    return (
        (region["type"] == "title")
        | ((F.length(body) < 60) & body.startswith("#"))
        | ((F.length(body) < 50) & ~body.contains("\n"))
    )


def with_groups(docs: DataFrame) -> DataFrame:
    """Add ``groups``: each heading bound to the region after it, every other region alone.

    A heading takes the next region whatever that is; the last region never leads.
    ``H.`` consumes a heading with its follower, so the replaced string marks leaders ``>`` and
    followers ``<`` the way the sequential scan would.
    """
    flags = F.array_join(F.transform("regions", lambda r: F.when(is_heading(r), "H").otherwise("B")), "")
    docs = docs.withColumn("_roles", F.regexp_replace(flags, "H.", "><"))
    roles = F.col("_roles")
    starts = F.filter(
        F.transform("regions", lambda r, i: F.when(F.substring(roles, i + 1, F.lit(1)) != "<", i)),
        lambda i: i.isNotNull(),
    )

    def group(i: Column) -> Column:
        lead = F.get("regions", i)
        members = F.slice(
            F.col("regions"), i + 1, F.when(F.substring(roles, i + 1, F.lit(1)) == ">", 2).otherwise(1)
        )
        texts = F.filter(F.transform(members, lambda r: tx.strip(r["text"])), lambda t: t != "")
        return F.struct(
            i.alias("region_idx"),
            lead["type"].alias("type"),
            F.array_join(texts, "\n\n").alias("text"),
            F.array_max(F.transform(members, lambda r: field_weight(r["type"]))).alias("field_weight"),
            F.size(members).alias("n_regions"),
        )

    return docs.withColumn("groups", F.transform(starts, group)).drop("_roles")


def explode_groups(docs: DataFrame) -> DataFrame:
    keys = ["doc_pos", sg.document_id(F.col("path")).alias("document_id")]
    return unnest(docs, keys, F.col("groups"), "g", "grp").select("doc_pos", "document_id", "grp", "g.*")


def _group_header(group: Column) -> Column:
    """Section header a group introduces, '' if none."""
    head = tx.strip(F.regexp_replace(tx.first_line(group["text"]), r"^#+" + tx.WHITESPACE_CLASS + "*", ""))
    opens = (group["type"] == "title") | group["text"].startswith("#")
    return F.when((group["text"] != "") & opens, head).otherwise("")


def section_groups(docs: DataFrame) -> DataFrame:
    """One row per non-empty group with its section path.

    Sections are the stretches between header groups: slicing the group array at those positions
    carries each header forward without a window. Needs ``doc_title`` beside ``groups``.
    """
    titled = docs.withColumn("_heads", F.transform("groups", _group_header))
    heads = F.col("_heads")
    opening = F.filter(
        F.transform("groups", lambda g, i: F.when((i == 0) | (F.get(heads, i) != ""), i)),
        lambda i: i.isNotNull(),
    )
    titled = titled.withColumn("_open", opening)
    sections = F.transform(
        "_open",
        lambda at, j: F.struct(
            at.alias("first"),
            F.get(heads, at).alias("header"),
            F.slice(
                F.col("groups"),
                at + 1,
                F.coalesce(F.get("_open", j + 1), F.size("groups")) - at,
            ).alias("members"),
        ),
    )
    title = F.coalesce(F.col("doc_title"), F.lit(""))
    hierarchy = F.filter(F.array(title, F.col("s.header")), lambda h: h != "")
    keys = ["doc_pos", sg.document_id(F.col("path")).alias("document_id"), "doc_title"]
    found = unnest(titled, keys, sections, "s").drop("_pos")
    keys = ["doc_pos", "document_id", "s.first", hierarchy.alias("hierarchy")]
    return (
        unnest(found, keys, F.col("s.members"), "g", "_k")
        .select(
            "doc_pos",
            "document_id",
            (F.col("first") + F.col("_k")).alias("grp"),
            "g.*",
            "hierarchy",
        )
        .filter(F.col("text") != "")
        .withColumn(
            "section",
            F.when(F.size("hierarchy") > 0, F.array_join("hierarchy", " > ")).otherwise(F.col("type")),
        )
        .withColumn("ancestry_header", ancestry_header(F.col("hierarchy")))
    )


def token_windows(df: DataFrame, text: str = "text", size: int = 512, overlap: int = 80) -> DataFrame:
    """Explode overlapping token windows: ``win, window_text, token_count``; none for blank text."""
    step = max(1, size - overlap)
    tokens = F.col("_tokens")
    count = F.size(tokens)
    last = F.when(count <= size, 0).otherwise(F.ceil((count - size) / F.lit(step)).cast("int"))
    starts = F.when(count > 0, F.sequence(F.lit(0), last))
    tokenised = df.withColumn("_tokens", tx.words(F.col(text)))
    return (
        unnest(tokenised, ["*"], starts, "win")
        .drop("_pos")
        .withColumn("_slice", F.slice(tokens, F.col("win") * step + 1, F.lit(size)))
        .withColumn("window_text", F.array_join("_slice", " "))
        .withColumn("token_count", F.size("_slice"))
        .drop("_tokens", "_slice")
    )


def section_chunks(docs: DataFrame, size: int = 512, overlap: int = 80) -> DataFrame:
    """Documents with ``regions`` and ``doc_title`` to section-aware chunks."""
    windows = token_windows(section_groups(with_groups(docs)), "text", size, overlap)
    number = F.col("grp") + 1
    return windows.select(
        F.concat_ws(
            "-", "document_id", "type", number.cast("string"), (F.col("win") + 1).cast("string")
        ).alias("chunk_id"),
        "document_id",
        F.concat_ws("-region-", "document_id", number.cast("string")).alias("region_id"),
        sg.modality_of(F.col("type")).alias("modality"),
        tx.strip(F.concat("ancestry_header", "window_text")).alias("text"),
        "section",
        tx.strip(F.col("ancestry_header")).alias("ancestry_header"),
        F.col("text").alias("parent_text"),
        "field_weight",
        F.col("win").alias("chunk_index"),
        "token_count",
        F.col("type").alias("region_type"),
    )

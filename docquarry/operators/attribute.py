"""Claim attribution and citation checks against a bounded evidence list, inside the answer's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions.rows import let

MIN_OVERLAP = 0.2
KEPT_EVIDENCE = 2
FLAG_THRESHOLD = 0.5

# A period ends a claim only when no word character touches it.
_CLAIM_END = r"(?<![\p{L}\p{N}_])\.(?![\p{L}\p{N}_])"


def split_claims(answer: Column) -> Column:
    body = tx.strip(F.coalesce(answer, F.lit("")))
    parts = F.filter(F.transform(F.split(body, _CLAIM_END), tx.strip), lambda c: c != "")
    return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(body)))


def entailed(claim_terms: Column, evidence_terms: Column) -> Column:
    """Shared terms make up at least a fifth of the claim's."""
    shared = F.size(F.array_intersect(claim_terms, evidence_terms))
    return (shared >= 1) & (shared / F.size(claim_terms) >= MIN_OVERLAP)


def verify_claims(answer: Column, evidence: Column) -> Column:
    """``ARRAY<STRUCT<claim, supported, supporting>>``; ``supporting`` keeps two evidence numbers."""
    terms = F.transform(evidence, lambda e: tx.ascii_terms(F.coalesce(e["text"], F.lit(""))))

    def check(claim: Column, known: Column) -> Column:
        return let(
            tx.ascii_terms(claim),
            lambda own: let(
                F.filter(
                    F.transform(known, lambda t, i: F.when(entailed(own, t), i + 1)), lambda i: i.isNotNull()
                ),
                lambda found: F.struct(
                    claim.alias("claim"),
                    (F.size(found) > 0).alias("supported"),
                    F.slice(found, 1, KEPT_EVIDENCE).alias("supporting"),
                ),
            ),
        )

    return let(terms, lambda known: F.transform(split_claims(answer), lambda c: check(c, known)))


def attribute(
    df: DataFrame, answer: str = "answer", evidence: str = "evidence", enabled: bool = True, threshold: float = FLAG_THRESHOLD
) -> DataFrame:
    """Add claims, counts, precision and status; a disabled check passes everything."""
    if not enabled:
        return (
            df.withColumn("supported_claims", F.lit(0))
            .withColumn("total_claims", F.lit(0))
            .withColumn("attribution_precision", F.lit(1.0))
            .withColumn("status", F.lit("bypassed_via_config"))
        )
    checked = df.withColumn("claims", verify_claims(F.col(answer), F.col(evidence)))
    checked = checked.withColumn("supported_claims", F.size(F.filter("claims", lambda c: c["supported"])))
    checked = checked.withColumn("total_claims", F.size("claims"))
    precision = tx.pyround(
        F.col("supported_claims") / F.greatest(F.lit(1), F.col("total_claims")), 3
    )
    return checked.withColumn("attribution_precision", precision).withColumn(
        "status", F.when(F.col("attribution_precision") >= threshold, "verified").otherwise("needs_review")
    )


def check_citations(answer: Column, evidence: Column, strict: bool = False) -> Column:
    """``STRUCT<tags, cited, supported, attribution_precision>`` of the ``[T1]``-style tags.

    A ``TAB`` tag begins with ``T`` and so is matched to text evidence; ``strict`` matches it to
    tables instead.
    """
    tags = F.regexp_extract_all(answer, F.lit(r"\[(T|TAB|FIG)\d+\]"), F.lit(1))
    wanted_tab = "table" if strict else "text"

    def modality(tag: Column) -> Column:
        return F.when(tag == "T", "text").when(tag == "TAB", wanted_tab).otherwise("vision")

    present = F.transform(evidence, lambda e: e["modality"])
    cited = let(
        present, lambda known: F.filter(tags, lambda t: F.array_contains(known, modality(t)))
    )
    return let(
        cited,
        lambda c: F.struct(
            tags.alias("tags"),
            F.transform(
                c, lambda t: F.struct(t.alias("tag"), F.array_position(present, modality(t)).alias("evidence"))
            ).alias("cited"),
            (F.size(c) > 0).alias("supported"),
            F.when(F.size(c) > 0, 1.0).otherwise(0.0).alias("attribution_precision"),
        ),
    )


def preceding_evidence(
    turns: DataFrame, key: str, order: str, item: Column, k: int = 5, block: int = 256, out: str = "evidence"
) -> DataFrame:
    """Each row with the ``item`` of the ``k`` preceding positions of its key, in order.

    A key may hold most of the table, so it is cut into blocks of positions; the last ``k`` of a
    block are copied into the next. Windows then run over pieces of bounded size.
    """
    home = F.floor(F.col(order) / block)
    reaches = F.when(F.col(order) % block >= block - k, F.array(home, home + 1)).otherwise(F.array(home))
    split = turns.withColumn("_home", home).withColumn("_piece", F.explode(reaches))
    frame = Window.partitionBy(key, "_piece").orderBy(order).rangeBetween(-k, -1)
    return (
        split.withColumn(out, F.collect_list(item).over(frame))
        .filter(F.col("_home") == F.col("_piece"))
        .drop("_home", "_piece")
    )

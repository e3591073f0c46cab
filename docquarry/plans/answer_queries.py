"""Registered queries over answer generation, attribution and instruction export."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions.rows import unnest
from docquarry.operators import attribute as at
from docquarry.operators import export as ex
from docquarry.operators import generate as ge
from docquarry.plans import answer as an
from docquarry.plans import inputs as I
from docquarry.plans import retrieval_queries as rq
from docquarry.session import cut_lineage

MAX_TOKENS = 700

_TAGS = {0: " [T1] and [TAB2]", 1: " [FIG3]", 2: " [T12] [FIG1]"}


def _turns(spark, sf):
    """Each turn as an answer with the five turns before it as evidence and a number as its SQL result."""
    turns = I.table(spark, sf, "conversations")
    modality = F.when(F.col("role") == "user", "text").when(F.col("role") == "assistant", "table").otherwise("vision")
    item = F.struct(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("document_id"),
        modality.alias("modality"),
        F.col("text").alias("text"),
    )
    rows = at.preceding_evidence(turns, "conv_id", "turn", item, 5)
    n = F.length("text")
    return rows.select(
        "conv_id",
        "turn",
        F.concat(F.lit("what follows turn "), F.col("turn").cast("string")).alias("query"),
        "text",
        F.concat(
            F.replace(F.col("text"), F.lit("."), F.lit(" .")),
            F.when(n % 4 == 0, _TAGS[0]).when(n % 4 == 1, _TAGS[1]).when(n % 4 == 2, _TAGS[2]).otherwise(""),
        ).alias("answer"),
        "evidence",
        F.when(
            n % 3 == 0,
            F.array(
                F.create_map(F.lit("item"), F.col("role"), F.lit("total_sum"), n.cast("string")),
                F.create_map(F.lit("item"), F.lit("x"), F.lit("total_sum"), F.lit(None).cast("string")),
            ),
        ).alias("sql_rows"),
    )


def gen_context_budget(spark, sf):
    rows = _turns(spark, sf)
    rows = rows.withColumn("p", ge.pack_context(F.col("query"), F.col("evidence"), MAX_TOKENS))
    return rows.select(
        "conv_id", "turn", F.col("p.used").alias("used"), F.array_join("p.blocks", "\n\n").alias("context")
    )


def gen_context_prompt(spark, sf):
    rows = _turns(spark, sf)
    first = F.when(
        F.col("sql_rows").isNotNull(), ge.sql_block(F.lit("SELECT 1"), F.get("sql_rows", F.lit(0))["total_sum"])
    )
    rows = rows.withColumn("p", ge.pack_context(F.col("query"), F.col("evidence"), MAX_TOKENS, first))
    return rows.select("conv_id", "turn", ge.context_prompt(F.col("query"), F.col("p")).alias("prompt"))


def gen_citations(spark, sf):
    rows = _turns(spark, sf)
    rows = rows.withColumn("p", ge.pack_context(F.col("query"), F.col("evidence"), MAX_TOKENS))
    found = unnest(rows, ["conv_id", "turn"], ge.citations(F.col("evidence"), F.col("p")), "c")
    return found.select("conv_id", "turn", "c.type", "c.source", "c.chunk_id")


def gen_snippet(spark, sf):
    docs = I.table(spark, sf, "documents")
    return docs.select("doc_id", ge.clean_snippet(F.col("text")).alias("snippet"), ge.estimate_tokens(F.col("text")).alias("tokens"))


def gen_template_answer(spark, sf):
    rows = _turns(spark, sf)
    return rows.select("conv_id", "turn", ge.template_answer(F.col("evidence"), F.col("sql_rows")).alias("answer"))


def gen_reasoning_extract(spark, sf):
    """Documents with their first line moved into a think block, sometimes twice."""
    docs = I.table(spark, sf, "documents")
    first = F.substring_index("text", "\n", 1)
    block = F.concat(F.lit("<think>"), first, F.lit("\nok</think>"))
    raw = F.when(F.length("text") % 3 == 0, F.col("text")).otherwise(
        F.concat(block, F.col("text"), F.when(F.length("text") % 3 == 1, block).otherwise(""))
    )
    return docs.select("doc_id", ge.extract_reasoning(raw).alias("r")).select("doc_id", "r.reasoning", "r.answer")


def gen_prompt(spark, sf):
    rows = _turns(spark, sf)
    return rows.select("conv_id", "turn", ge.citation_prompt(F.col("query"), F.col("evidence")).alias("prompt"))


def gen_tagged_answer(spark, sf):
    rows = _turns(spark, sf)
    return rows.select("conv_id", "turn", ge.tagged_answer(F.col("query"), F.col("evidence")).alias("answer"))


def attr_split_claims(spark, sf):
    found = unnest(_turns(spark, sf), ["conv_id", "turn"], at.split_claims(F.col("answer")), "claim", "n")
    return found.select("conv_id", "turn", "n", "claim")


def attr_entailment(spark, sf):
    found = unnest(_turns(spark, sf), ["conv_id", "turn"], at.verify_claims(F.col("answer"), F.col("evidence")), "c", "n")
    return found.select(
        "conv_id",
        "turn",
        "n",
        "c.supported",
        F.array_join(F.transform("c.supporting", lambda i: i.cast("string")), ",").alias("supporting"),
    )


def attr_precision(spark, sf):
    out = at.attribute(_turns(spark, sf))
    return out.select("conv_id", "turn", "supported_claims", "total_claims", "attribution_precision", "status")


def attr_citation_check(spark, sf):
    c = at.check_citations(F.col("answer"), F.col("evidence"))
    out = _turns(spark, sf).withColumn("c", c)
    return out.select(
        "conv_id",
        "turn",
        F.array_join("c.tags", ",").alias("tags"),
        F.size("c.cited").alias("n_cited"),
        "c.supported",
        "c.attribution_precision",
    )


def export_sft(spark, sf):
    out = ex.instruction_records(_turns(spark, sf))
    return out.select("conv_id", "turn", "instruction", "input", "output")


def answer_queries(spark, sf):
    store = rq.region_store(spark, sf, "tables")
    out = an.answer_queries(store.regions(spark), I.QUERY_SET, hits=rq._written_hits(spark, sf), tables=store.tables(spark))
    return out.select(
        "query_id", "sql_query", "answer", "supported_claims", "total_claims", "attribution_precision", "status"
    )


def service_answers(spark, sf):
    out = an.service_answers(rq.region_store(spark, sf).regions(spark), I.QUERY_SET, hits=cut_lineage(rq._hits(spark, sf, use_sql=False)))
    return out.select("query_id", "answer", "prompt", "attribution_precision", "status")


QUERIES = {
    f.__name__: f
    for f in (
        gen_context_budget,
        gen_context_prompt,
        gen_citations,
        gen_snippet,
        gen_template_answer,
        gen_reasoning_extract,
        gen_prompt,
        gen_tagged_answer,
        attr_split_claims,
        attr_entailment,
        attr_precision,
        attr_citation_check,
        export_sft,
        answer_queries,
        service_answers,
    )
}

TURNS = """ev0 AS (
  SELECT conv_id, turn, role, text, length(text) AS len,
    list_sort(coalesce(list({'t': turn, 'd': 'c' || conv_id || '-' || turn,
      'm': CASE role WHEN 'user' THEN 'text' WHEN 'assistant' THEN 'table' ELSE 'vision' END, 'x': text})
      OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), [])) AS ev
  FROM conversations),
turns AS (
  SELECT *, 'what follows turn ' || turn AS query,
    replace(text, '.', ' .') || CASE len % 4 WHEN 0 THEN ' [T1] and [TAB2]' WHEN 1 THEN ' [FIG3]' WHEN 2 THEN ' [T12] [FIG1]' ELSE '' END AS answer
  FROM ev0)"""


def _pack(sql: bool) -> str:
    first = "'--- DUCKDB TEXT-TO-SQL RESULT ---' || chr(10) || 'SQL Query: SELECT 1' || chr(10) || 'Rows: ' || len"
    lead = f"CASE WHEN len % 3 = 0 THEN {first} END" if sql else "NULL::VARCHAR"
    return TURNS + f""",
led AS (
  SELECT *, {lead} AS lead, {MAX_TOKENS} - 300 - greatest(1, length(query) // 4) AS budget FROM turns),
evs AS (SELECT conv_id, turn, lead, budget, generate_subscripts(ev, 1) AS n, unnest(ev) AS e FROM led),
blk AS (
  SELECT *, '--- EVIDENCE ITEM ' || n || ' [' || upper(e.m) || '] (Source: ' || e.d || ') ---' || chr(10) AS head,
         CASE WHEN lead IS NULL THEN 0 ELSE greatest(1, length(lead) // 4) END AS base FROM evs),
cum AS (
  SELECT *, base + sum(greatest(1, length(head || e.x) // 4)) OVER (PARTITION BY conv_id, turn ORDER BY n) AS upto,
         greatest(1, length(head || e.x) // 4) AS own FROM blk),
over_ AS (SELECT conv_id, turn, min(n) FILTER (upto > budget) AS stop FROM cum GROUP BY ALL),
packed AS (
  SELECT c.*, CASE WHEN stop IS NULL OR n < stop THEN head || e.x
    WHEN n = stop AND budget - (upto - own) > 50 THEN head || regexp_replace(substr(e.x, 1, ((budget - (upto - own)) * 4)::BIGINT), ' [^ ]*$', '')
      || '... [truncated (max_context_tokens={MAX_TOKENS})]' END AS block
  FROM cum c JOIN over_ USING (conv_id, turn)),
ctx AS (
  SELECT l.conv_id, l.turn, l.query, list_filter(list_concat([l.lead], coalesce(list(p.block ORDER BY p.n), [])), lambda b: b IS NOT NULL) AS blocks
  FROM led l LEFT JOIN packed p ON p.conv_id = l.conv_id AND p.turn = l.turn GROUP BY l.conv_id, l.turn, l.query, l.lead)"""


def _snip(x: str, n: int) -> str:
    body = f"trim({x}, ' ' || chr(10))"
    cut = f"regexp_replace(substr({body}, 1, {n}), ' [^ ]*$', '')"
    return f"CASE WHEN length({body}) <= {n} THEN {body} WHEN regexp_matches({cut}, '[.!?]$') THEN {cut} ELSE {cut} || '...' END"


_TERMS = "list_distinct(list_transform(regexp_extract_all({x}, '[a-zA-Z0-9]+'), lambda t: lower(t)))"
CLAIMS = TURNS + f""",
chars AS (
  SELECT conv_id, turn, ev, string_split(trim(answer, ' ' || chr(10)), '') AS cs FROM turns),
marked AS (
  SELECT conv_id, turn, ev, array_to_string(list_transform(cs, lambda c, i: CASE WHEN c = '.'
      AND NOT coalesce(regexp_matches(CASE WHEN i > 1 THEN cs[i - 1] END, '[\\p{{L}}\\p{{N}}_]'), false)
      AND NOT coalesce(regexp_matches(cs[i + 1], '[\\p{{L}}\\p{{N}}_]'), false) THEN chr(1) ELSE c END), '') AS m FROM chars),
parts AS (
  SELECT conv_id, turn, ev, list_filter(list_transform(string_split(m, chr(1)), lambda p: trim(p, ' ' || chr(10))), lambda p: p <> '') AS ps
  FROM marked),
claims AS (
  SELECT conv_id, turn, ev, generate_subscripts(p, 1) - 1 AS n, unnest(p) AS claim
  FROM (SELECT conv_id, turn, ev, CASE WHEN len(ps) > 0 THEN ps ELSE [''] END AS p FROM parts)),
terms AS (
  SELECT *, {_TERMS.format(x='claim')} AS ct, list_transform(ev, lambda e: {_TERMS.format(x='e.x')}) AS et FROM claims),
judged AS (
  SELECT *, list_filter(range(1, len(et) + 1), lambda i: len(ct) > 0 AND len(list_intersect(ct, et[i])) >= 1
     AND len(list_intersect(ct, et[i])) / len(ct)::DOUBLE >= 0.2) AS sup FROM terms)"""

ORACLES = {
    "gen_context_budget": I.with_(_pack(False))
    + """SELECT conv_id, turn, coalesce(list_sum(list_transform(blocks, lambda b: greatest(1, length(b) // 4))), 0) AS used,
 array_to_string(blocks, chr(10) || chr(10)) AS context FROM ctx""",
    "gen_context_prompt": I.with_(_pack(True))
    + f"""SELECT conv_id, turn, '{ge.CONTEXT_HEAD}' || array_to_string(blocks, chr(10) || chr(10)) || chr(10) || chr(10) || 'QUESTION: ' || query
 || '{ge.CONTEXT_TAIL}' AS prompt FROM ctx""",
    "gen_citations": I.with_(_pack(False))
    + "SELECT conv_id, turn, e.m AS type, e.d AS source, 'c-' || n AS chunk_id FROM packed WHERE block IS NOT NULL",
    "gen_snippet": f"SELECT doc_id, {_snip('text', 250)} AS snippet, greatest(1, length(text) // 4) AS tokens FROM documents",
    "gen_template_answer": I.with_(TURNS)
    + f"""SELECT conv_id, turn, CASE WHEN len % 3 <> 0 AND len(ev) = 0 THEN '{ge.NO_EVIDENCE}' ELSE
  CASE WHEN len % 3 = 0 THEN 'Based on the structured database query, **item: ' || role || ', total_sum: ' || len || '**.' || chr(10)
   ELSE 'Based on the retrieved document context:' || chr(10) || chr(10) || '> ' || {_snip('ev[1].x', 250)} || chr(10) END
  || CASE WHEN len(ev) > 0 THEN chr(10) || '{ge.FINDINGS}' || chr(10) || array_to_string(list_transform(ev[1:4], lambda e:
      '* **[' || upper(e.m) || ']** ' || {_snip('e.x', 220)} || ' [Source: ' || e.d || ']'), chr(10)) ELSE '' END
  || CASE WHEN len % 3 = 0 THEN chr(10) || '{ge.TABLE_TITLE}' || chr(10) || '| item | total_sum |' || chr(10) || '| --- | --- |' || chr(10)
      || '| ' || role || ' | ' || len || ' |' || chr(10) || '| x | None |' ELSE '' END END AS answer FROM turns""",
    "gen_reasoning_extract": """SELECT doc_id, CASE WHEN length(text) % 3 <> 0 THEN trim(string_split(text, chr(10))[1] || chr(10) || 'ok') END AS reasoning,
  trim(text, ' ' || chr(10)) AS answer FROM documents""",
    "gen_prompt": I.with_(TURNS)
    + f"""SELECT conv_id, turn, 'Question: ' || query || chr(10) || '{ge.CITE_RULE}' || chr(10) || 'Context:' || chr(10)
 || array_to_string(list_concat(list_transform(ev[1:5], lambda e, i: CASE e.m WHEN 'text' THEN '[T' WHEN 'table' THEN '[TAB' ELSE '[FIG' END || i || ']: ' || e.x),
   ['{ge.CITE_CLOSE}']), chr(10)) AS prompt FROM turns""",
    "gen_tagged_answer": I.with_(TURNS)
    + """SELECT conv_id, turn, CASE WHEN len(ev) = 0 THEN 'No supporting evidence found.' ELSE 'Based on the retrieved evidence [T1], the answer to '''
 || query || ''' is grounded in the available document context.' END AS answer FROM turns""",
    "attr_split_claims": I.with_(CLAIMS) + "SELECT conv_id, turn, n, claim FROM claims",
    "attr_entailment": I.with_(CLAIMS)
    + "SELECT conv_id, turn, n, len(sup) > 0 AS supported, array_to_string(sup[1:2], ',') AS supporting FROM judged",
    "attr_precision": I.with_(CLAIMS)
    + f""", p AS (
  SELECT conv_id, turn, count(*) FILTER (len(sup) > 0) AS supported_claims, count(*) AS total_claims FROM judged GROUP BY ALL),
r AS (SELECT *, {I.rnd('supported_claims / total_claims::DOUBLE', 3)} AS attribution_precision FROM p)
SELECT *, CASE WHEN attribution_precision >= 0.5 THEN 'verified' ELSE 'needs_review' END AS status FROM r""",
    "attr_citation_check": I.with_(TURNS)
    + """, t AS (
  SELECT conv_id, turn, ev, regexp_extract_all(answer, '\\[(T|TAB|FIG)\\d+\\]', 1) AS tags FROM turns),
c AS (
  SELECT *, len(list_filter(tags, lambda g: list_contains(list_transform(ev, lambda e: e.m), CASE WHEN g LIKE 'T%' THEN 'text' ELSE 'vision' END))) AS n_cited
  FROM t)
SELECT conv_id, turn, array_to_string(tags, ',') AS tags, n_cited, n_cited > 0 AS supported,
  CASE WHEN n_cited > 0 THEN 1 ELSE 0 END::DOUBLE AS attribution_precision FROM c""",
    "export_sft": I.with_(TURNS)
    + f"""SELECT conv_id, turn, '{ex.INSTRUCTION}' AS instruction, 'Query: ' || query || chr(10) || chr(10) || 'Evidence Context:' || chr(10)
 || array_to_string(list_transform(ev[1:3], lambda e: '[' || upper(e.m) || '] ' || e.x), chr(10) || chr(10)) AS input, answer AS output FROM turns""",
}

"""Registered queries: each applies one operator to its whole table and digests the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.llm import bpe, divergence, embedding, fingerprint, langid, licenses, linededup, lm, mixing, pii, simhash, toxicity, whitening
from docquarry.llm.common import saved, table


def vocabulary() -> str:
    """Path of the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


COSINE = 0.95


def op1_embeddings(spark, sf):
    return embedding.near_duplicates(table(spark, sf, "embeddings"), COSINE)


def op2_line_dedup(spark, sf):
    found = linededup.removed_lines(table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


def op3_fingerprint(spark, sf):
    found = fingerprint.edited_neighbours(table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("sketch", "").alias("fingerprint"),
        F.array_join("edited_sketch", "").alias("edited_fingerprint"), "near_edited", "near_next",
    )


MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS = (3.0, 1.0, 2.0), 1.5, 2.0


def op4_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS)


def op5_simhash(spark, sf):
    found = simhash.classes(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bpe(spark, sf):
    return bpe.round_trip(table(spark, sf, "documents"), vocabulary())


TOXIC_FOLDS, TOXIC_HELD_OUT = 5, 0


def op7_toxicity(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = langid.fold(F.col("doc_id"), TOXIC_FOLDS) == TOXIC_HELD_OUT
    model = toxicity.learn(docs, labels.filter(~held))
    return toxicity.detect(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "offending")


def op8_pii(spark, sf):
    found = pii.detect(table(spark, sf, "documents"), copies=True)

    def count(rank):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(rank).alias(f"n_{kind}") for rank, kind in enumerate(pii.KINDS)]
    spans = F.sort_array(F.concat("base", "terms"))
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 4, 2


def op9_language(spark, sf):
    docs = table(spark, sf, "documents")
    held = langid.fold(F.col("doc_id"), LANGUAGE_FOLDS) == LANGUAGE_HELD_OUT
    profiles = langid.learn(docs.filter(~held))
    return langid.identify(docs, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_lm(spark, sf):
    docs = table(spark, sf, "documents")
    counts = saved(lm.word_counts(docs))
    vocab = lm.vocabulary(docs, counts=counts)
    return lm.score(docs, vocab, lm.train(docs, vocab), counts=counts)


def op11_whitening(spark, sf):
    return whitening.whitened_components(table(spark, sf, "embeddings"))


def op12_divergence(spark, sf):
    return divergence.audit(table(spark, sf, "documents"))


def op13_licenses(spark, sf):
    return licenses.licences(table(spark, sf, "documents")).drop("found")


QUERIES = {
    f.__name__: f
    for f in (
        op1_embeddings, op2_line_dedup, op3_fingerprint, op4_mixing, op5_simhash, op6_bpe, op7_toxicity, op8_pii, op9_language, op10_lm,
        op11_whitening, op12_divergence, op13_licenses,
    )
}

# Words of a text, as a DuckDB expression.
_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"

def line_ctes(docs: str, t: float = linededup.THRESHOLD) -> str:
    """CTEs ending in ``worded`` (doc_id, line, first, near) for a table of documents."""
    return f"""line_rows AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content,
      unnest(range(len(string_split(text, chr(10)))))::INT AS line FROM {docs}),
  line_sets AS (SELECT doc_id, line, list_sort(list_distinct({_WORDS.format(t="lower(content)")})) AS words FROM line_rows),
  distinct_sets AS (SELECT words, len(words) AS n, min((doc_id, line)) AS spot FROM line_sets WHERE len(words) > 0 GROUP BY words),
  set_words AS (SELECT spot, n, unnest(words) AS word FROM distinct_sets),
  set_ranks AS (SELECT *, row_number() OVER (PARTITION BY spot ORDER BY freq, word) AS place
      FROM (SELECT *, count(*) OVER (PARTITION BY word) AS freq FROM set_words)),
  rare AS (SELECT * FROM set_ranks WHERE place <= n - ceil(n * {t} - 1e-9) + 1),
  set_pairs AS (SELECT DISTINCT x.spot AS x, y.spot AS y FROM rare x JOIN rare y USING (word)
      WHERE y.spot < x.spot AND least(x.n, y.n) >= {t} * greatest(x.n, y.n) - 1e-9),
  near AS (SELECT DISTINCT x FROM set_pairs JOIN distinct_sets a ON a.spot = x JOIN distinct_sets b ON b.spot = y
      WHERE len(list_intersect(a.words, b.words)) * {1 + t} >= (a.n + b.n) * {t} - 1e-9),
  worded AS (SELECT s.doc_id, s.line, d.spot = (s.doc_id, s.line) AS first, n.x IS NOT NULL AS near
      FROM line_sets s JOIN distinct_sets d USING (words) LEFT JOIN near n ON n.x = d.spot)"""


OP2_SQL = f"""WITH {line_ctes("documents")},
  removed AS (SELECT doc_id, count(*) AS n, string_agg(line, ',' ORDER BY line) AS list FROM worded WHERE NOT first OR near GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(list, '') AS removed
FROM documents LEFT JOIN removed USING (doc_id)"""

_SKETCH = f"""list_sort(list_distinct(list_transform(
    CASE WHEN len({{w}}) = 0 THEN [] ELSE range(1, greatest(len({{w}}) - {fingerprint.SHINGLE} + 1, 1) + 1) END,
    lambda i: substr(md5(array_to_string({{w}}[i:i + {fingerprint.SHINGLE - 1}], ' ')), 1, {fingerprint.DIGITS}))))[1:{fingerprint.K}]"""

_LIKENESS = f"""CASE WHEN len({{a}}) + len({{b}}) = 0 THEN 1.0 ELSE
    len(list_intersect(list_sort(list_distinct(list_concat({{a}}, {{b}})))[1:{fingerprint.K}], list_intersect({{a}}, {{b}})))::DOUBLE
    / len(list_sort(list_distinct(list_concat({{a}}, {{b}})))[1:{fingerprint.K}]) END"""

OP3_SQL = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents),
  paired AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next FROM texts WINDOW w AS (ORDER BY doc_id DESC, text)),
  edits AS (SELECT *, left(text, n_chars - n_chars // 3) || left(next, n_chars // 3) AS edited FROM paired),
  split AS (SELECT doc_id, n_chars, edited, {_WORDS.format(t="text")} AS a, {_WORDS.format(t="edited")} AS b, {_WORDS.format(t="next")} AS c FROM edits),
  sketches AS (SELECT doc_id, n_chars, edited, {_SKETCH.format(w="a")} AS fa, {_SKETCH.format(w="b")} AS fb, {_SKETCH.format(w="c")} AS fc FROM split)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(fa, '') AS fingerprint, array_to_string(fb, '') AS edited_fingerprint,
  {_LIKENESS.format(a="fa", b="fb")} AS near_edited, {_LIKENESS.format(a="fa", b="fc")} AS near_next
FROM sketches"""


def mix_ctes(docs: str) -> str:
    """CTEs ending in ``mix_plan`` (source, target, whole, cut) and ``sized`` for a table of documents."""
    w = ", ".join(str(x) for x in MIX_WEIGHTS)
    return f"""sized AS (SELECT doc_id, source, coalesce(len({_WORDS.format(t="text")}), 0)::BIGINT AS size,
      md5(coalesce(doc_id::VARCHAR, 'null') || ':{mixing.SEED}') AS place FROM {docs}),
  sums AS (SELECT source, sum(size)::BIGINT AS source_size,
      [{w}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(MIX_WEIGHTS)} + 1)::INT]::DOUBLE AS weight FROM sized GROUP BY source),
  caps AS (SELECT *, {MIX_EPOCHS} * source_size AS cap, {MIX_SHARE} * sum(source_size) OVER () AS total FROM sums),
  levels AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0)) / sum(weight) OVER r AS level FROM caps
      WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             r AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  filled AS (SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM levels)) AS target FROM levels),
  wholes AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM filled),
  places AS (SELECT source, place, sum(size) AS n FROM sized GROUP BY ALL),
  upto AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2 AS so_far FROM places),
  cuts AS (SELECT w.source, max(place) FILTER (so_far <= target - whole * source_size) AS cut
      FROM wholes w JOIN upto u ON w.source IS NOT DISTINCT FROM u.source WHERE target > whole * source_size GROUP BY w.source),
  mix_plan AS (SELECT w.*, coalesce(cut, '') AS cut FROM wholes w LEFT JOIN cuts c ON w.source IS NOT DISTINCT FROM c.source)"""


OP4_SQL = f"""WITH {mix_ctes("documents")}
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN place <= cut THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM sized s JOIN mix_plan p ON s.source IS NOT DISTINCT FROM p.source"""

OP12_SQL = rf"""WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
  doc_terms AS (SELECT lang, source, row, unnest(terms) AS term FROM docs),
  counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM doc_terms GROUP BY ALL),
  kept AS (SELECT lang, term, sum(n)::BIGINT AS total FROM counts GROUP BY ALL HAVING sum(docs) >= {divergence.LEAST_DOCS}),
  sources AS (SELECT DISTINCT lang, source FROM docs),
  dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total FROM sources g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
  sized AS (SELECT *, sum(n) OVER g AS size, sum(total) OVER g AS lang_size, count(*) OVER g AS v FROM dense WINDOW g AS (PARTITION BY lang, source)),
  shares AS (SELECT lang, source, term, n, (1 + {divergence.UNIT}::HUGEINT * (n + 2) // (size + 2 * v))::BIGINT AS p,
      (1 + {divergence.UNIT}::HUGEINT * (total + 2) // (lang_size + 2 * v))::BIGINT AS q FROM sized),
  sums AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
      FROM shares x JOIN shares y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
  parts AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM sources x JOIN sources y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {divergence.TOP}"""


def _license_sql() -> str:
    """The templates as a table, and every place of their first key word held against them."""

    def text(xs):
        return "[" + ", ".join(f"'{x}'" for x in xs) + "]"

    rows = ",\n      ".join(
        f"('{t.label}', {str(t.base).lower()}, {text(t.words)}, [{', '.join(map(str, t.key_words))}], {text(t.key_words.values())})" for t in licenses.TEMPLATES
    )
    return rf"""WITH files AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
  templates(label, base, words, places, keys) AS (VALUES
      {rows}),
  spots AS (SELECT row, unnest(words) AS word, unnest(range(len(words))) AS pos FROM files),
  starts AS (SELECT row, t.*, pos - places[1] AS start FROM spots JOIN templates t ON word = keys[1]),
  found AS (SELECT s.row, s.label, s.base, s.start,
      list_sum([CASE WHEN s.start + i >= 0 AND f.words[s.start + i + 1] = s.words[i + 1] THEN 1 ELSE 0 END FOR i IN range(len(s.words))]) / len(s.words) AS coverage
      FROM starts s JOIN files f USING (row)
      WHERE list_bool_and([s.start + s.places[i + 1] >= 0 AND coalesce(f.words[s.start + s.places[i + 1] + 1] = s.keys[i + 1], false) FOR i IN range(len(s.keys))])),
  summed AS (SELECT row, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM found GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM files LEFT JOIN summed USING (row)"""


OP13_SQL = _license_sql()

ORACLES: dict[str, str] = {
    "op2_line_dedup": OP2_SQL, "op3_fingerprint": OP3_SQL, "op4_mixing": OP4_SQL, "op12_divergence": OP12_SQL, "op13_licenses": OP13_SQL,
}

r"""Personal data: patterns, and the terms that give it away.

Patterns find the protected entities (addresses, cards, phone numbers). Other words of the text can
disclose an entity too: by information theory the share of an entity's information that a term
reveals is PMI(term, entity) / IC(entity), with PMI = log2 p(t, e) / (p(t) p(e)) and
IC = -log2 p(e), all estimated from the documents of the whole corpus. Terms over the disclosure
threshold are generalised to a placeholder, or removed, in every document that holds them.

Spans are found by splitting a text at a pattern: the lengths of the pieces between the matches give
the places. The patterns are written so that a run of characters is entered at its first only, which
finds the same leftmost matches without trying each of its suffixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import saved
from docquarry.operators.joins import bounded

# Kinds in order, and what each looks like.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PARTS = r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
# A text without this holds no match of the kind.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}++"
# A term discloses an entity if it reveals this share of its information.
DISCLOSURE, TERM_CHARS = 0.9, 3
# Most frequent terms, and entities of most documents, whose counts go to every task.
COMMON = 100_000
EPS = 1e-9

SPAN = "array<struct<start:int,end:int,value:string>>"
TERM_SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches of ``pattern`` with start and end in code points."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), pair["hit"].alias("value"))
        return F.struct(end.cast("int").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
    return F.aggregate(pairs, empty, step, lambda acc: acc["spans"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * (1 + i % 2)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), step) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def entities(text: Column) -> Column:
    """Entities of all kinds: ``start, end, value, kind`` in order of start, then kind."""

    def of(rank: int, kind: str) -> Column:
        hits = F.when(text.rlike(NEEDS[kind]), F.filter(matches(text, PATTERNS[kind]), lambda s: _passes(kind, s["value"])))
        ranked = lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["value"].alias("value"))
        return F.transform(F.coalesce(hits, F.array().cast(SPAN)), ranked)

    return F.sort_array(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)]))


def kind_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "term")]), rank + 1)


def _free(word: Column, spans: Column) -> Column:
    """Whether a match counts as a term: long enough, and not overlapping an entity."""
    apart = ~F.exists(spans, lambda s: (s["start"] < word["end"]) & (word["start"] < s["end"]))
    return (F.length(word["value"]) >= TERM_CHARS) & apart


def _outside(text: Column, spans: Column) -> Column:
    """A text without its entities, given in order, and without the runs of letters that reach into one; blanks take their place."""
    letter = lambda at: F.substring(text, at, F.lit(1)).rlike(r"\p{L}")

    def piece(at: Column, to: Column) -> Column:
        part = F.substring(text, at + 1, to - at)
        part = F.when((at > 0) & letter(at), F.regexp_replace(part, r"\A\p{L}++", "")).otherwise(part)
        return F.when((to < F.length(text)) & letter(to + 1), F.regexp_replace(part, r"(?<!\p{L})\p{L}++\z", "")).otherwise(part)

    def step(acc: Column, s: Column) -> Column:
        more = F.when(s["start"] > acc["at"], F.concat(acc["parts"], F.array(piece(acc["at"], s["start"])))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("parts"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(spans, empty, step, lambda acc: F.array_join(F.concat(acc["parts"], F.array(piece(acc["at"], F.length(text)))), " "))


def _terms(text: Column, spans: Column) -> Column:
    """Distinct terms of a whole text that stand outside its entities."""
    rest = F.when(F.size(spans) == 0, text).otherwise(_outside(text, spans))
    found = F.filter(F.regexp_extract_all(rest, F.lit(TERM), F.lit(0)), lambda w: F.length(w) >= TERM_CHARS)
    return F.array_distinct(F.transform(found, lambda w: F.lower(w)))


def _term_spans(text: Column, spans: Column, terms: Column) -> Column:
    """Spans of every mention of ``terms`` outside the entities."""
    hits, gaps = F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.split(text, TERM, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(TERM_SPAN).alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        start, value = acc["at"] + F.length(pair["gap"]), F.lower(pair["hit"])
        end = start + F.length(pair["hit"])
        word = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        span = F.struct(start.cast("int").alias("start"), F.lit(len(KINDS)).alias("rank"), end.cast("int").alias("end"), value.alias("value"))
        more = F.array_contains(terms, value) & _free(word, spans)
        return F.struct(end.cast("int").alias("at"), F.when(more, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    pairs = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
    return F.aggregate(pairs, empty, step, lambda acc: acc["spans"])


def disclosing(found: DataFrame, held: DataFrame, total: int, threshold: float = DISCLOSURE, repeated: bool = True, copies: bool = True) -> DataFrame:
    """``entity, term`` pairs whose disclosure reaches the threshold.

    ``found`` has ``doc, unit, entities, terms`` of the documents with entities, with a hash of the
    text as ``unit``; ``held`` has a row for each ``term`` of each document. ``repeated`` tells whether
    a document may have several rows. Without ``copies`` a pair that stands in several documents counts
    only if their texts differ. Terms are counted before their shuffle, so that it holds distinct terms.

    A pair reaches the threshold only if the term stands in at most ``n_e ** threshold * total ** (1 - threshold)``
    documents, ``n_e`` being those of the entity. Pairs of the ``COMMON`` most frequent terms that stand in
    more are left out before their shuffle; all others are decided after it.
    """
    counts = saved(held.groupBy("term").agg(F.count("*").alias("n_t")))
    of = found.select("doc", F.explode("entities").alias("entity")).groupBy("entity").agg(F.countDistinct("doc").alias("n_e"))
    of = saved(of)
    wide = saved(of.orderBy(F.desc("n_e"), "entity").limit(COMMON).withColumnRenamed("n_e", "docs"))
    least = wide.agg(F.min("docs")).first()[0] or 1  # no entity beside these stands in more documents
    most = F.pow(F.coalesce("docs", F.lit(least)).cast("double"), F.lit(threshold)) * F.lit(float(total) ** (1 - threshold) * (1 + EPS))
    hot = saved(counts.filter(F.col("n_t") > F.lit(float(total) ** (1 - threshold))).orderBy(F.desc("n_t"), "term").limit(COMMON))
    near = found.select("doc", "unit", "terms", F.explode("entities").alias("entity")).join(F.broadcast(wide), "entity", "left")
    near = near.select("doc", "entity", F.explode("terms").alias("term"), F.col("unit").alias("low"), F.col("unit").alias("high"), most.alias("most"))
    near = near.join(F.broadcast(hot), "term", "left").filter("n_t IS NULL OR n_t <= most")
    if repeated:
        near = near.groupBy("doc", "entity", "term").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    joint = near.groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.min("low").alias("low"), F.max("high").alias("high"))
    joint = joint if copies else joint.filter("n_te = 1 OR low < high")
    joint = saved(joint.select("entity", "term", "n_te").join(of, "entity"))
    content = F.log2(F.lit(float(total)) / F.col("n_e"))
    pmi = F.log2(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e")))
    return joint.join(counts, "term").filter((content > 0) & (pmi >= F.lit(threshold) * content)).select("entity", "term")


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = DISCLOSURE, copies: bool = False) -> DataFrame:
    """``doc_id, base, terms`` for every row: entities, and spans of the terms that disclose one of the corpus.

    See ``spans_by_text``.
    """
    return spans_by_text(docs, text, key, threshold, copies).drop("unit")


def spans_by_text(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = DISCLOSURE, copies: bool = False) -> DataFrame:
    """``doc_id, unit, base, terms`` for every row, ``unit`` being the hash of its text.

    The last two are arrays of ``start, rank, end, value`` in order; code points, end exclusive. Null texts
    are empty. Rows that repeat an id are one document in the statistics; rows come back as often as
    they occur. An empty table gives no rows. With ``copies`` pairs known from copies of one text only
    count like any other.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.sha2("text", 256).alias("unit"))
    # written down with its terms, as entities are dear to find and every pass below asks for them
    found = rows.select("doc_id", "text", "unit", entities(F.col("text")).alias("base"))
    parts = saved(found.select("doc_id", "unit", "base", _terms(F.col("text"), F.col("base")).alias("terms")))
    names = F.array_distinct(F.transform("base", lambda s: F.concat(kind_name(s["rank"]), F.lit(":"), s["value"])))
    found = parts.filter(F.size("base") > 0).select(F.struct("doc_id").alias("doc"), F.xxhash64("unit").alias("unit"), names.alias("entities"), "terms")
    ids = docs.select(F.col(key).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.count("*"), F.max("n")).first()
    held = parts.select("doc_id", F.explode("terms").alias("term"))
    repeated = (ids[1] or 0) > 1
    held = held.distinct() if repeated else held
    told = saved(disclosing(found, held, ids[0], threshold, repeated, copies).select("term").distinct())
    place = [F.col("doc_id").alias("at_doc"), F.col("unit").alias("at_unit")]
    holding = parts.select("doc_id", "unit", "base", F.explode("terms").alias("term")).join(bounded(told), "term")
    holding = saved(holding.groupBy(*place).agg(F.collect_set("term").alias("told"), F.any_value("base").alias("base")))
    at = F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("unit") == F.col("at_unit"))
    spans = rows.join(bounded(holding), at).select(*place, _term_spans(F.col("text"), F.col("base"), F.col("told")).alias("spans"))
    spans = saved(spans.dropDuplicates(["at_doc", "at_unit"]))
    joined = parts.select("doc_id", "unit", "base").join(spans, at, "left")
    return joined.select("doc_id", "unit", "base", F.coalesce("spans", F.array().cast(TERM_SPAN)).alias("terms"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["rank"]), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, remove_terms: bool = False) -> Column:
    """``text`` with entities generalised to ``[KIND]`` and terms to ``[TERM]``, or removed. Of spans that overlap the first counts."""
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    label = lambda s: F.when(s["rank"] == len(KINDS), F.lit("" if remove_terms else "[TERM]")).otherwise(F.concat(F.lit("["), F.upper(kind_name(s["rank"])), F.lit("]")))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, label(s)).alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    return F.aggregate(F.sort_array(spans), empty, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame, text: str = "text", key: str = "doc_id", remove_terms: bool = False) -> DataFrame:
    """``doc_id, text``, the text generalised; null texts stay null.

    A row is masked with the spans of its own id and text, also where ids are null or repeated.
    """
    found = spans_by_text(docs, text, key).dropDuplicates(["doc_id", "unit"])
    found = found.select(F.col("doc_id").alias("id"), F.col("unit").alias("of"), F.concat("base", "terms").alias("spans"))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("unit"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("unit") == F.col("of")), "left")
    return joined.select("doc_id", masked(F.col("text"), F.col("spans"), remove_terms).alias("text"))

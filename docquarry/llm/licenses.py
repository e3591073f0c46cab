"""Find licences in files by a positional index of their rarest words.

Each licence template is a run of words with mandatory key phrases. Document frequencies of the key words
over the whole corpus say which of a template's words are rarest; those, with their places in the
template, are the index. A file's rare licence words vote for (template, start of the template in the
file); where the postings of all indexed words of a template meet at one start, its key phrases are
verified word by word. As indexed words belong to key phrases, a template is found at a start exactly
when all its key phrases stand there: the frequencies decide what is looked up, not what is found.

Everything happens within a row, so nothing is shuffled but the counts of the key words. Words are
lower-cased and of ASCII letters, digits and anything beyond ASCII. Null texts are empty and hold no
licence; repeated rows are scanned each for itself; a phrase that stands often counts at each place; an
empty table gives no rows. The result keeps the key only, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a text whose capitals may still stand.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The only sign beyond ASCII that lower() turns into a letter of ASCII.
KELVIN = "\u212a"
# Indexed words of a template, fewer if its key phrases have no more words than that.
ANCHORS = 2


@dataclass(frozen=True)
class Template:
    """Words of a licence passage and its mandatory phrases; without any, the whole passage is one."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False
    words: list[str] = field(init=False, repr=False, compare=False)
    key_words: dict[int, str] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        words, places = self.text.split(), {}
        for phrase in self.keys or (self.text,):
            run = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(run)] == run)
            places |= {at + i: w for i, w in enumerate(run)}
        object.__setattr__(self, "words", words)
        object.__setattr__(self, "key_words", dict(sorted(places.items())))


# Base phrases with their labels, then well-known licence passages.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("epl", "eclipse public license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("source code form", "mozilla public license v 2 0")),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ("is free software", "redistribute it and or modify it", "free software foundation"),
    ),
    Template(
        "mit-grant",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge", "obtaining a copy of this software"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify and or distribute this software", "with or without fee"),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def words(text: Column) -> Column:
    """Lower-cased words of a text, none where it is null.

    Letters beyond ASCII may change their case too; no template has any.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("\ufffd"))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))


def word_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> dict[str, int]:
    """Documents that hold each key word of the templates; as many entries as the templates have such words."""
    known = sorted({w for t in templates for w in t.key_words.values()})
    held = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, known)), words(F.col(text)))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in known}


def rarest(template: Template, frequencies: dict[str, int], anchors: int = ANCHORS) -> dict[str, int]:
    """The template's indexed words with their place in it: its key words of highest inverse document frequency."""
    first = {}
    for place, word in template.key_words.items():
        first.setdefault(word, place)
    order = sorted(first, key=lambda w: (frequencies[w], w))
    return {w: first[w] for w in order[: max(1, min(anchors, len(order) - 1))]}


def scan(docs: DataFrame, frequencies: dict[str, int], templates: tuple[Template, ...] = TEMPLATES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_words, found``: templates found in each text, as an array of label, base, start and coverage.

    ``coverage`` is the share of the template's words that stand at their places.
    """
    index = [rarest(t, frequencies) for t in templates]
    postings = F.array(*[
        F.struct(F.lit(w).alias("word"), F.lit(i).alias("template"), F.lit(rel).alias("rel")) for i, picked in enumerate(index) for w, rel in picked.items()
    ])
    singles = [i for i, picked in enumerate(index) if len(picked) == 1]
    facts = F.array(*[
        F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.array(*map(F.lit, t.words)).alias("words"),
            F.array(*[F.struct(F.lit(rel).alias("rel"), F.lit(w).alias("word")) for rel, w in t.key_words.items()]).alias("keys"),
        ) for t in templates
    ])
    rows = docs.select(F.col(key).alias("_key"), words(F.col(text)).alias("_words"))

    indexed = sorted({w for picked in index for w in picked})
    spots = F.transform("_words", lambda w, i: F.when(w.isin(indexed), F.struct(w.alias("word"), i.alias("pos"))))
    rows = rows.withColumn("_spots", F.filter(spots, lambda s: s.isNotNull()))
    votes = F.flatten(F.transform("_spots", lambda s: F.transform(
        F.filter(postings, lambda p: p["word"] == s["word"]), lambda p: F.struct(p["template"].alias("template"), (s["pos"] - p["rel"]).alias("start")))))
    rows = rows.withColumn("_votes", F.sort_array(votes))
    # Postings of one template meet where equal votes lie side by side; a lone indexed word needs no second.
    agreed = F.filter("_votes", lambda v, i: v["template"].isin(singles) | (v == F.get("_votes", i - 1)))
    rows = rows.withColumn("_met", agreed)

    def stands(place: Column, word: Column) -> Column:
        return F.get("_words", place).eqNullSafe(word)

    known = F.transform("_met", lambda v: F.struct(v["start"].alias("start"), F.get(facts, v["template"]).alias("is")))
    verified = F.filter(known, lambda v: F.forall(v["is"]["keys"], lambda k: stands(v["start"] + k["rel"], k["word"])))

    def place(v: Column) -> Column:
        all_words = v["is"]["words"]
        hit = F.transform(all_words, lambda w, i: stands(v["start"] + i, w).cast("int"))
        share = F.aggregate(hit, F.lit(0), lambda a, h: a + h) / F.size(all_words)
        return F.struct(v["is"]["label"].alias("label"), v["is"]["base"].alias("base"), v["start"].cast("long").alias("start"), share.alias("coverage"))

    found = F.transform(verified, place)
    return rows.select(F.col("_key").alias(key), F.size("_words").cast("long").alias("n_words"), found.alias("found"))


def listed(found: Column) -> Column:
    """Distinct labels of an array of findings, sorted and comma-joined."""
    return F.array_join(F.sort_array(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")


def licences(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score, found`` of every document.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are the smallest and
    largest of them (null without any). ``score`` is the best coverage of a template found, 0 if none is.
    """
    rows = scan(docs, word_frequencies(docs, templates, text), templates, text, key)
    rows = rows.withColumn("_base", F.filter("found", lambda f: f["base"]))
    starts = F.transform("_base", lambda f: f["start"])
    best = F.array_max(F.transform("found", lambda f: f["coverage"]))
    return rows.select(
        key, "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(F.col("_base")).alias("base_labels"), listed(F.col("found")).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"), "found",
    )

"""Language identification by rank-order n-gram profiles.

A profile lists a language's most frequent character n-grams by rank. A document's own list is
compared with each profile: the out-of-place distance sums, over the document's n-grams, how far
their ranks differ, with a fixed penalty for those the profile lacks. The nearest profile wins.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
# N-grams of one to three characters, each character 21 bits of a 64-bit key.
SIZES = (1, 2, 3)
BITS = 21
# Entries of a profile and of a document's list.
TOP = 400
# About so many documents of each language are read to learn its profile.
SAMPLE_DOCS = 2000


@dataclass(frozen=True)
class Profiles:
    """Profiles of all languages: sorted n-gram keys, and their rank per language (-1: absent)."""

    languages: tuple[str, ...]
    keys: np.ndarray
    ranks: np.ndarray
    top: int


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each code point, 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.int64)
    for i in range(sys.maxunicode + 1):
        if (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys of the letters of ``text`` and their counts; runs of others are a space."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.concatenate(([0], _letters()[points], [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = [codes[codes > 0]]
    key = codes
    for n in SIZES[1:]:
        key = (key[:-1] << BITS) | codes[n - 1 :]
        grams.append(key)
    return np.unique(np.concatenate(grams), return_counts=True)


def _most(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """Keys by falling count, ties by key."""
    return keys[np.argsort(-counts, kind="stable")[:top]]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, list] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            found.setdefault(lang, []).append(ngrams(text))
        for lang, parts in found.items():
            keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "gram": keys, "n": counts})


def learn(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", top: int = TOP, sample_docs: int = SAMPLE_DOCS
) -> Profiles:
    """Learn a profile per language from about ``sample_docs`` documents of each.

    The sample takes documents by a hash of their ``key``, at a rate that holds the expected number
    to ``sample_docs``. Rows with a null text or language teach nothing; no rows give no profiles.
    Only the profiles, ``top`` keys per language, reach the driver.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    rate = rows.groupBy("lang").agg((F.lit(float(sample_docs)) / F.count("*")).alias("rate"))
    share = F.pmod(F.xxhash64("key"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    sample = rows.join(F.broadcast(rate), "lang").filter(share < F.col("rate")).select("lang", "text")
    counts = sample.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    best = counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < top)
    found = best.select("lang", "gram", "rank").collect()
    languages = tuple(sorted({r["lang"] for r in found}))
    keys = np.array(sorted({r["gram"] for r in found}), dtype=np.int64)
    ranks = np.full((len(keys), len(languages)), -1, dtype=np.int64)
    for r in found:
        ranks[np.searchsorted(keys, r["gram"]), languages.index(r["lang"])] = r["rank"]
    return Profiles(languages, keys, ranks, top)


def classify(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """Nearest language and 1 minus its distance as a share of the largest possible one.

    ``und`` and 0 where the text is null, has no letter, or no profile was learned. Equal distances
    go to the first language by name.
    """
    if text is None or not profiles.languages:
        return UNKNOWN, 0.0
    keys, counts = ngrams(text)
    if not len(keys):
        return UNKNOWN, 0.0
    own = _most(keys, counts, profiles.top)
    at = np.minimum(np.searchsorted(profiles.keys, own), len(profiles.keys) - 1)
    ranks = np.where((profiles.keys[at] == own)[:, None], profiles.ranks[at], -1)
    away = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))[:, None]), profiles.top).sum(axis=0)
    best = int(np.argmin(away))
    return profiles.languages[best], float(1 - away[best] / (profiles.top * len(own)))


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text.

    Null, empty and letterless texts are ``und`` with score 0; repeated rows and null ids come back
    as they are; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(x, profiles) for x in batch["text"].to_pylist()]
            langs, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], langs, scores], ["doc_id", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose language can be told; ``und`` ones go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [classify(x, profiles)[0] != UNKNOWN for x in batch[text].to_pylist()]
            yield batch.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(key: Column, folds: int) -> Column:
    """Fold of a row: crc32 of its key as text, modulo ``folds``; null keys are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)), F.lit(0))

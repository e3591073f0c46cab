"""Toxicity by multiple-instance learning: sentence scores learned from document labels.

A document is toxic if any sentence is: with sentence probabilities p_s from a logistic model of its
words, the noisy-or 1 - prod(1 - p_s) is the document's. Only documents are labelled; the gradient
of the noisy-or puts the blame on the sentences that explain the label, which can then be located.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE = regex.compile(r"[^.!?\n]+")
TOKEN = regex.compile(r"\p{L}+")
# About so many labelled documents are read to fit the model. Its words are in so many of them at
# least, and their likelihood-ratio statistic against the label is so high that chance among a
# million words would seldom reach it.
SAMPLE_DOCS, MIN_DOCS, MIN_G2 = 12_000, 5, 28.0
STEPS, RATE, START = 200, 0.15, -7.0


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and distinct lower-case words of each sentence that has a word."""
    for m in SENTENCE.finditer(text):
        if words := set(TOKEN.findall(m[0].lower())):
            yield m.start(), m.end(), words


def _telling(texts: list[str], labels: list[int], min_docs: int, min_g2: float) -> list[str]:
    """Words that occur significantly more often, or less, in toxic documents; equal texts count once."""
    seen, toxic, total = Counter(), Counter(), [0, 0]
    for text, y in sorted(set(zip(texts, labels))):
        found = set(TOKEN.findall(text.lower()))
        seen.update(found)
        total[y] += 1
        if y:
            toxic.update(found)
    words = sorted(w for w, n in seen.items() if n >= min_docs)
    n, k = np.array([seen[w] for w in words], float), np.array([toxic[w] for w in words], float)
    share = total[1] / max(1, sum(total))
    table = ((k, n * share), (n - k, n * (1 - share)), (total[1] - k, (sum(total) - n) * share), (total[0] - n + k, (sum(total) - n) * (1 - share)))
    g2 = sum(2 * o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)) for o, e in table)
    return [w for w, g in zip(words, g2) if g >= min_g2]


def fit(texts: list[str], labels: list[int], min_docs: int = MIN_DOCS, min_g2: float = MIN_G2) -> Model:
    """Fit by full-batch Adam on the noisy-or likelihood over the words that tell the labels apart."""
    vocab = {w: i for i, w in enumerate(_telling(texts, labels, min_docs, min_g2))}
    tokens, sizes, owner = [], [], []
    for d, text in enumerate(texts):
        for _, _, words in sentences(text):
            known = [vocab[w] for w in words if w in vocab]
            tokens.append(np.array(known, np.int32))
            sizes.append(len(known))
            owner.append(d)
    y = np.array(labels, float)
    if not len(y) or not len(sizes) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Model(math.log(rate / (1 - rate)), {})
    ids, at, doc = np.concatenate(tokens), np.repeat(np.arange(len(sizes)), sizes), np.array(owner)
    w, bias = np.zeros(len(vocab)), START
    m1, m2, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(at, w[ids], len(sizes))
        odds = np.bincount(doc, np.logaddexp(0, z), len(y))  # -log of the chance that no sentence is toxic
        p = np.maximum(-np.expm1(-odds), 1e-9)
        dz = (1 - y / p)[doc] / (1 + np.exp(-z)) / len(y)
        grad, gb = np.bincount(ids, dz[at], len(w)), dz.sum()
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb**2
        one, two = 1 - 0.9**step, 1 - 0.999**step
        w -= RATE * (m1 / one) / (np.sqrt(m2 / two) + 1e-4)
        bias -= RATE * (b1 / one) / (math.sqrt(b2 / two) + 1e-4)
    words = list(vocab)
    return Model(float(bias), {words[i]: float(w[i]) for i in np.flatnonzero(w)})


def learn(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS
) -> Model:
    """Fit on about ``sample_docs`` labelled documents, taken by a hash of their id.

    Ids labelled twice count as toxic if one label says so; null ids and labels teach nothing. The
    sampled texts meet in one task, whose size the sample bounds; the weights come to the driver.
    """
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).dropna()
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    rate = sample_docs / max(1, known.count())
    chosen = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(rate * 1e6))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id")  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((i, t, y) for b in batches for i, t, y in zip(*(b[c].to_pylist() for c in ("id", "text", "y"))))
        model = fit([t for _, t, _ in found], [y for _, _, y in found])
        words = ["", *model.weights]
        yield pa.RecordBatch.from_pydict({"word": words, "weight": [model.bias, *model.weights.values()]})

    found = rows.repartition(1).mapInArrow(run, "word string, weight double").collect()
    weights = {r["word"]: r["weight"] for r in found}
    return Model(weights.pop("", 0.0), weights)


def score(text: str, model: Model) -> tuple[float, list[tuple[int, int]]]:
    """Noisy-or over the sentences, and where those of probability 0.5 or more are."""
    odds, places, get = 0.0, [], model.weights.get
    for start, end, words in sentences(text):
        z = model.bias + sum(get(w, 0.0) for w in words)
        odds += math.log1p(math.exp(-abs(z))) + max(z, 0.0)
        if z >= 0:
            places.append((start, end))
    return -math.expm1(-odds), places


def detect(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, score, predicted, offending`` for every row, from its whole text.

    ``offending`` lists start and end, in code points, of the sentences found toxic. Null, empty and
    wordless texts score 0. Repeated rows and null ids come back as they are.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(x or "", model) for x in batch["text"].to_pylist()]
            places = pa.array([[{"start": a, "end": b} for a, b in at] for _, at in found], spans)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), places],
                ["doc_id", "score", "predicted", "offending"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int, offending array<struct<start:int,end:int>>")

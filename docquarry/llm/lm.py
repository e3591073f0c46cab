"""Masked pseudo-likelihood of documents under a bidirectional window network.

A small network predicts every word from the words at both sides. A document's score sums the log
probability of each of its words given the others around it. Output words are grouped in classes, so
that a probability is that of the class times that of the word within it, and sums to one exactly.
Words outside the vocabulary share outputs by hash; each has its share of the output's count in the
whole corpus, from a table of counts that grows with it and stays on Spark.
The network is trained in numpy, data-parallel: every partition trains on its own documents from the
same start, and the results are averaged.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import saved

OFFSETS = (-2, -1, 1, 2)
# Words kept by frequency; the rest share hash buckets, each by its share of the bucket's count. Together CLASSES * MEMBERS outputs.
CLASSES = MEMBERS = 64
BUCKETS = 256
HIDDEN = 24
# Every document trains at each STRIDE-th of its positions (1: all of them), in one of ROUNDS rounds.
STRIDE, ROUNDS, BATCH, RATE = 1, 2, 2048, 0.15
BLOCKS = 16
SCORE_BATCH = 8192
# Rows of an Arrow batch, and bytes of their texts, that a task holds as Python objects while it scores.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20
# Most frequent words outside the vocabulary whose counts a task holds while it scores (some 25 MB); the counts of the others are joined.
FREQUENT = 1 << 18
# Words that a task counts before it hands them on.
HELD_WORDS = 400_000


@dataclass(frozen=True)
class Vocabulary:
    ids: dict[str, int]
    classes: int = CLASSES
    members: int = MEMBERS
    buckets: int = BUCKETS

    @property
    def size(self) -> int:
        return self.classes * self.members

    def encode(self, text: str | None) -> np.ndarray:
        """Output ids of the words of a text."""
        first, get, n = self.size - self.buckets, self.ids.get, self.buckets
        return np.array([i if (i := get(w)) is not None else first + zlib.crc32(w) % n for w in _tokens(text)], np.int32)

    def rare(self, text: str | None) -> Counter:
        """Counts of the words of a text that share hash buckets."""
        return self.encode_with_rare(text)[1]

    def encode_word(self, word: bytes) -> int:
        """Output id of a word outside the vocabulary."""
        return self.size - self.buckets + zlib.crc32(word) % self.buckets

    def encode_with_rare(self, text: str | None, known: dict[bytes, int] | None = None) -> tuple[np.ndarray, Counter]:
        """Output ids of the words of a text, and counts of those that share hash buckets; the text is split once.

        ``known`` may hold numbers of more words than the vocabulary, which come back as they are and are not counted.
        """
        words, get = _tokens(text), (self.ids if known is None else known).get
        ids = np.array([get(w, -1) for w in words], np.int32)
        missing = np.flatnonzero(ids < 0)
        others = [words[i] for i in missing.tolist()]
        ids[missing] = [self.encode_word(w) for w in others]
        return ids, Counter(others)


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z and ASCII spaces only


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of at most ``SLICE_ROWS`` rows and about ``SLICE_BYTES`` of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
    at = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and (i - at >= SLICE_ROWS or held + size > SLICE_BYTES):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if len(sizes) > at:
        yield batch.slice(at)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a partition, in parts of at most about ``HELD_WORDS`` words."""

    def rows(counts: Counter) -> Iterator[pa.RecordBatch]:
        words, sums = list(counts), list(counts.values())
        for at in range(0, len(words), 50_000):
            part = pa.array(words[at : at + 50_000], pa.binary()), pa.array(sums[at : at + 50_000], pa.int64())
            yield pa.RecordBatch.from_arrays(list(part), ["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            counts.update((text.as_py() or b"").lower().split())
            if len(counts) >= HELD_WORDS:
                yield from rows(counts)
                counts = Counter()
    yield from rows(counts)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` of every word of all documents."""
    counts = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(_count_words, "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(
    docs: DataFrame, text: str = "text", classes: int = CLASSES, members: int = MEMBERS, buckets: int = BUCKETS, counts: DataFrame | None = None
) -> Vocabulary:
    """The most frequent words of all documents; only as many as the network has outputs reach the driver.

    ``counts`` may hold their ``word_counts``.
    """
    counts = word_counts(docs, text) if counts is None else counts
    best = counts.orderBy(F.desc("n"), "word").limit(classes * members - buckets).select("word").collect()
    return Vocabulary({bytes(r["word"]): i for i, r in enumerate(best)}, classes, members, buckets)


class Network:
    """``hidden = tanh(sum of context vectors + bias)``, then softmax over classes and within the class."""

    def __init__(self, vocab: Vocabulary, hidden: int = HIDDEN, flat: np.ndarray | None = None, seed: int = 1):
        c, m, v = vocab.classes, vocab.members, vocab.size
        self.members, self.pad = m, v
        self.shapes = {"ctx": (len(OFFSETS), v + 1, hidden), "b": (hidden,), "cls": (hidden, c), "cb": (c,), "out": (c, hidden, m), "ob": (c, m)}
        total = sum(int(np.prod(s)) for s in self.shapes.values())
        if flat is None:
            flat = np.random.default_rng(seed).normal(0, 0.05, total).astype(np.float32)
        self.flat, at = flat, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """Context ids of each position of one document, by offset; padded beyond its ends."""
        n, reach = len(ids), max(map(abs, OFFSETS))
        wide = np.full(n + 2 * reach, self.pad, np.int32)
        wide[reach : reach + n] = ids
        return np.stack([wide[reach + o : reach + o + n] for o in OFFSETS])

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.b + self.ctx[0].take(context[0], axis=0)
        for k in range(1, len(OFFSETS)):
            h += self.ctx[k].take(context[k], axis=0)
        return np.tanh(h, out=h)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        """Softmax of each row, in place."""
        Network._shift(z)
        np.exp(z, out=z)
        z /= z @ np.ones((z.shape[1], 1), z.dtype)
        return z

    @staticmethod
    def _shift(z: np.ndarray) -> None:
        """Subtract each row's largest score where exponentials of the scores could leave the range of a float."""
        if len(z) and not max(z.max(), -z.min()) < 60:
            z -= z.max(axis=1, keepdims=True)

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of the targets by class, and ``(class, from, to)`` of each run of one class there."""
        kind = (target // self.members).astype(np.uint16 if len(self.cb) <= 1 << 16 else np.int32)  # short numbers sort in linear time
        order = np.argsort(kind, kind="stable")
        kind = kind[order]
        at = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1], [True]))).tolist() if len(kind) else [0]
        return order, [(int(kind[i]), i, j) for i, j in zip(at, at[1:])]

    def _within(self, h: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
        """Scores of the members of each row's class; the rows of ``h`` are sorted by class."""
        z = np.empty((len(h), self.members), h.dtype)
        for c, i, j in runs:
            part = z[i:j]
            np.matmul(h[i:j], self.out[c], out=part)
            part += self.ob[c]
        return z

    @staticmethod
    def _log_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log softmax of each row of ``z`` at one place."""
        z = Network._softmax(z)
        return np.log(z[np.arange(len(z)), at] + 1e-30)

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of each target given its context."""
        order, runs = self._by_class(target)
        h, target = self._hidden(context[:, order]), target[order]
        found = self._log_at(h @ self.cls + self.cb, target // self.members)
        found += self._log_at(self._within(h, runs), target % self.members)
        out = np.empty_like(found)
        out[order] = found
        return out

    def train(self, context: np.ndarray, target: np.ndarray, squares: "Network", rate: float = RATE) -> None:
        """One Adagrad step on a batch; ``squares`` holds the sums of squared gradients."""
        if not len(target):
            return
        order, runs = self._by_class(target)
        context, target = context[:, order], target[order]
        n, total = np.arange(len(target)), len(target)
        h = self._hidden(context)
        dz = self._softmax(h @ self.cls + self.cb)
        dz[n, target // self.members] -= 1
        dz /= total
        dh = dz @ self.cls.T
        d = self._softmax(self._within(h, runs))
        d[n, target % self.members] -= 1
        d /= total

        def step(name: str, grad: np.ndarray, where=...) -> None:
            seen = getattr(squares, name)
            held = seen[where] + grad**2
            seen[where] = held
            np.sqrt(held, out=held)
            held += 1e-6
            grad = grad * rate
            grad /= held
            getattr(self, name)[where] -= grad

        classes = [c for c, _, _ in runs]
        grads = np.empty((len(runs), *self.out.shape[1:]), h.dtype)
        for grad, (c, i, j) in zip(grads, runs):
            dh[i:j] += d[i:j] @ self.out[c].T
            np.matmul(h[i:j].T, d[i:j], out=grad)
        step("out", grads, classes)
        step("ob", np.add.reduceat(d, [i for _, i, _ in runs]), classes)
        step("cls", (dz.T @ h).T)
        step("cb", dz.sum(axis=0))
        dh *= 1 - h**2
        step("b", dh.sum(axis=0))
        for k in range(len(OFFSETS)):
            keys = context[k].astype(np.uint16) if self.pad < 1 << 16 else context[k]
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            step("ctx", np.add.reduceat(dh.take(order, axis=0), at), (k, keys[at]))


def _batches(docs: Iterator[np.ndarray], net: Network, size: int, stride: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts and targets of the positions of many documents, ``size`` or so at a time."""
    parts, held = [], 0
    for i, ids in enumerate(docs):
        context, pick = net.windows(ids), slice(i % stride, None, stride)
        for at in range(0, len(ids[pick]), size):
            parts.append((context[:, pick][:, at : at + size], ids[pick][at : at + size]))
            held += len(parts[-1][1])
            if held >= size:
                yield np.concatenate([c for c, _ in parts], axis=1), np.concatenate([t for _, t in parts])
                parts, held = [], 0
    if held:
        yield np.concatenate([c for c, _ in parts], axis=1), np.concatenate([t for _, t in parts])


def _weighted_sum(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sum blocks of parameters by ``keys``, one row at a time, in the order of their learners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, weight, first = None, None, 0.0, 0

        def row():
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([key[0]], pa.int32()), "part": pa.array([key[1]], pa.int32()), "learner": pa.array([first], pa.int32()),
                 "weight": [weight], "params": [total.tobytes()]})

        for batch in batches:
            for block, part, learner, w, params in zip(*(batch[c] for c in ("block", "part", "learner", "weight", "params"))):
                now, values = (block.as_py(), part.as_py()), np.frombuffer(params.as_py(), np.float64)
                if now != key:
                    if key is not None:
                        yield row()
                    key, total, weight, first = now, np.zeros(len(values)), 0.0, learner.as_py()
                total = total + values
                weight += w.as_py()
        if key is not None:
            yield row()

    sorted_rows = rows.repartition(*keys).sortWithinPartitions("block", "part", "learner")
    return sorted_rows.mapInArrow(run, "block int, part int, learner int, weight double, params binary")


def train(docs: DataFrame, vocab: Vocabulary, text: str = "text", key: str = "doc_id", hidden: int = HIDDEN, rounds: int = ROUNDS, stride: int = STRIDE) -> Network:
    """Train on all documents: each takes part in one round, at every ``stride``-th position of its whole text.

    The parameters, whose number does not depend on the data, travel as blocks that are summed in two
    steps; only the average reaches the driver. Without words the start is returned.
    """
    rows = docs.select(F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(rounds)).alias("turn"))
    net = Network(vocab, hidden)
    for turn in range(rounds):
        start = docs.sparkSession.sparkContext.broadcast(net.flat)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, squares = Network(vocab, hidden, start.value.copy()), Network(vocab, hidden, np.full(len(start.value), 1e-6, np.float32))
            texts = (vocab.encode(x) for b in batches for x in b["text"].to_pylist())
            seen = 0
            for context, target in _batches(texts, own, BATCH, stride):
                own.train(context, target, squares)
                seen += len(target)
            learner = TaskContext.get().partitionId()
            for block, part in enumerate(np.array_split(own.flat.astype(np.float64) * seen, BLOCKS)) if seen else ():
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([block], pa.int32()), "part": pa.array([learner % 32], pa.int32()), "learner": pa.array([learner], pa.int32()),
                     "weight": [float(seen)], "params": [part.tobytes()]})

        learned = rows.filter(F.col("turn") == turn).mapInArrow(run, "block int, part int, learner int, weight double, params binary")
        parts = _weighted_sum(learned, ["block", "part"]).withColumn("part", F.lit(0))
        blocks = sorted(_weighted_sum(parts, ["block"]).collect(), key=lambda r: r["block"])
        if blocks:
            flat = np.concatenate([np.frombuffer(r["params"], np.float64) / r["weight"] for r in blocks])
            net = Network(vocab, hidden, flat.astype(np.float32))
        start.unpersist()
    return net


def score(docs: DataFrame, vocab: Vocabulary, net: Network, text: str = "text", key: str = "doc_id", counts: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_prob`` for every row, over all words of its text.

    A word outside the vocabulary has the probability of its bucket times its share of the bucket's
    count in ``counts``, the ``word_counts`` of the corpus; where they are not given, of ``docs``. A word
    that they lack has the share of a word seen once. Null, empty and wordless texts have 0 words, sum 0
    and a null mean. Repeated rows and null ids come back as they are.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(w,) for w in vocab.ids], "word binary")  # no more than the network's outputs
    rare = saved((word_counts(docs, text) if counts is None else counts).join(F.broadcast(known), "word", "left_anti"))
    totals = np.zeros(vocab.size)
    for row in rare.groupBy(F.pmod(F.crc32("word"), F.lit(vocab.buckets)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        totals[vocab.size - vocab.buckets + row["bucket"]] = np.log(row["n"])
    often = rare.filter("n > 1").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    held = spark.sparkContext.broadcast({**vocab.ids, **{bytes(r["word"]): vocab.size + i for i, r in enumerate(often)}})
    # by id: the output, and what a word's share of it adds
    outputs = np.array([*range(vocab.size), *(int(vocab.encode_word(bytes(r["word"]))) for r in often)], np.int32)
    shares = np.concatenate([-totals, np.log(np.array([r["n"] for r in often], np.float64)) - totals[outputs[vocab.size :]]])
    flat, shared = spark.sparkContext.broadcast(net.flat), spark.sparkContext.broadcast((outputs, shares))
    hidden = net.shapes["b"][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (outputs, shares) = Network(vocab, hidden, flat.value), shared.value
        for batch in (part for whole in batches for part in _slices(whole)):
            known, rare_words = zip(*(vocab.encode_with_rare(x.as_py(), held.value) for x in batch["text"]))
            sizes = np.array([len(t) for t in known], np.int64)
            sums, owner, at = np.zeros(len(sizes)), np.repeat(np.arange(len(sizes)), sizes), 0
            sums += np.bincount(owner, shares[np.concatenate(known)], len(sizes))
            for c, t in _batches((outputs[t] for t in known), own, SCORE_BATCH):
                sums += np.bincount(owner[at : at + len(t)], own.log_probs(c, t), len(sizes))
                at += len(t)
            words = pa.array([list(r.items()) for r in rare_words], pa.map_(pa.binary(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes), pa.array(sums), words], ["doc_id", "n_tokens", "log_sum", "rare"],
            )

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, log_sum double, rare map<binary,bigint>")
    # written down, as rows are told apart by a number of this run
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
    # words seen once add log 1
    more = rows.select("row", F.explode("rare").alias("word", "times")).join(rare.filter("n > 1"), "word")
    more = more.groupBy("row").agg(F.sum((F.col("times") * F.log(F.col("n").cast("double"))).cast("decimal(38,12)")).cast("double").alias("log_rare"))
    total = F.col("log_sum") + F.coalesce("log_rare", F.lit(0.0))
    found = rows.select("row", "doc_id", "n_tokens", "log_sum").join(more, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"))
    return found.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))

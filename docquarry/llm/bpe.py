"""Byte-pair encoding and decoding of whole texts.

A word's bytes are symbols of a doubly linked list. A priority queue holds the possible merges by
rank, then place; entries whose symbols have since been merged are skipped. Decoding concatenates
the vocabulary's strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the byte-level split of a text into words before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A worker forgets its encoded words when it holds so many.
CACHE_WORDS = 200_000


def byte_symbols() -> dict[int, str]:
    """Printable stand-in of each byte: itself where printable Latin-1, else the next free code from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec(dict):
    """A byte-level BPE vocabulary; as a dict it keeps words already encoded, as bytes of their ids."""

    def __init__(self, spec: dict, cache_words: int = CACHE_WORDS):
        model, symbols = spec["model"], byte_symbols()
        back = {c: b for b, c in symbols.items()}
        vocab = dict(model["vocab"])
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.cache_words = cache_words
        self.start = [vocab.get(symbols[b]) for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.strings = [b""] * (max([*vocab.values(), *special.values(), -1]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            known = all(c in back for c in token)
            self.strings[i] = bytes(back[c] for c in token) if known else token.encode()
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        longest = sorted(special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if special else None
        self.split = regex.compile(SPLIT)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one word."""
        ids = [self.start[b] for b in data]
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        merges, heap = self.merges, []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        while heap:
            rank, i, into = heapq.heappop(heap)
            j = right[i]
            if ids[i] is None or j < 0 or merges.get((ids[i], ids[j])) != (rank, into):
                continue  # stale: one of its symbols has been merged since
            ids[i], ids[j] = into, None
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if found := merges.get((into, ids[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (h := left[i]) >= 0 and (found := merges.get((ids[h], into))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return [i for i in ids if i is not None]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.cache_words:
            self.clear()
        out = np.array(self.merge(word.encode()), "<u4").tobytes()
        if len(word) <= 64:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian 32-bit integers; special tokens in the text are theirs."""
        out = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                out.append(b"".join(map(self.__getitem__, self.split.findall(piece))))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text of ``ids``; broken sequences become U+FFFD."""
        strings = self.strings
        whole = b"".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return whole.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    return Codec(json.loads(spec))


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, ids (binary, little-endian 32-bit), n_tokens`` for every row, from its whole text.

    ``path`` names a vocabulary file that the driver reads; its size does not depend on the data, and
    it is broadcast. Null and empty texts have no ids. Repeated rows come back as they are.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(spec.value)
        for batch in batches:
            found = [model.encode(x or "") for x in batch["text"].to_pylist()]
            sizes = pa.array([len(x) // 4 for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.binary()), sizes], ["doc_id", "ids", "n_tokens"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long")


def decode(encoded: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``doc_id, text`` of encoded rows; null ids give an empty text."""
    spec = encoded.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(spec.value)
        for batch in batches:
            found = [model.decode(x or b"").decode() for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids and of the text decoded from them.

    One pass, so that the ids of a text need not leave their task. Nulls count as empty texts.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(spec.value)
        for batch in batches:
            sizes, ids, back = [], [], []
            for x in batch["text"].to_pylist():
                data = model.encode(x or "")
                sizes.append(len(data) // 4)
                ids.append(hashlib.sha256(data).hexdigest())
                back.append(hashlib.sha256(model.decode(data)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

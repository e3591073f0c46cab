"""Audit how the sources of a language differ in their terms.

Every (language, source) group is a segment tree over the term ids of its language, with counts as
leaves. Trees are hash-consed: equal subtrees, of one group or of several, are one node. Two trees are
compared by walking them together from their roots; each pair of nodes that the walk meets is priced
once, however often it stands in the two trees, as its price depends on its counts alone.

Term ids run by falling count, so that the many rare terms of small sources share their nodes. A tree is
cut into blocks of neighbouring ids and groups into tiles, so a task holds a block of the trees of two
tiles, whatever the number of terms and sources; sums over blocks are made on Spark. All arithmetic is of
whole numbers.

Null texts, languages and sources count as empty text. Repeated rows are documents of their own. A group
without terms has its rows; a language without kept terms has pairs of value 0 and no terms; an empty
table gives no rows. Ties go by UTF-8. Columns other than text, lang and source are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import key_runs, ranked, saved

UNIT, LEAST_DOCS, TOP = 1_000_000_000, 10, 10
# Term ids of a block (a power of two), groups of a tile, leaf pairs walked at once.
BLOCK, TILE, WALKED = 1024, 64, 1 << 20
# Entries that a task counts before it passes them on.
ENTRIES = 1 << 18
ABSENT = -1
# Bytes of terms, A-Z lower-cased; what is no part of a term becomes a space.
_TERM = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _batch(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
    """Counts of a task's groups; the empty term stands for the group itself."""
    lang, source, term, n, docs = [], [], [], [], []
    for (group_lang, group_source), (total, holding) in groups.items():
        size = len(total) + 1
        lang += [group_lang] * size
        source += [group_source] * size
        term += [b"", *total]
        n += [0, *total.values()]
        docs += [0, *(holding[t] for t in total)]
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).view(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
        ["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    """Counts of a task, passed on whenever they hold about ``entries`` terms."""

    def fresh():
        return defaultdict(lambda: (Counter(), Counter()))

    groups, left = fresh(), entries
    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary())):
            total, holding = groups[lang, source]
            terms, before = text.as_py().translate(_TERM).split(), len(total)
            total.update(terms)
            holding.update(set(terms))
            left -= len(total) - before
            if left < 0:
                yield _batch(groups)
                groups, left = fresh(), entries
    if groups:
        yield _batch(groups)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", entries: int = ENTRIES) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in a group and documents that hold it.

    Every group also has a row of the empty term.
    """
    blank = F.lit("")
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), blank).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = texts.mapInArrow(lambda batches: _count(batches, entries), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: Column, size: Column, terms: Column) -> Column:
    """Smoothed share of a count in billionths, plus one, exact for any count."""
    wide = [c.cast("decimal(38,0)") for c in (count, size, terms)]
    return F.call_function("div", (wide[0] + 2) * UNIT, wide[1] + wide[2] * 2) + 1


def _shares(counts: np.ndarray, size: int, terms: int) -> np.ndarray:
    """``scaled`` of many counts of one group; absent leaves get 1."""
    exact = counts.astype(object) if size >= 2**62 // UNIT else counts
    return np.where(counts == ABSENT, 1, 1 + UNIT * (exact + 2) // (size + 2 * terms)).astype(np.int64)


class Forest:
    """Segment trees over the rows of ``leaves``, of which equal subtrees are one node.

    ``levels[k]`` holds the left and right children of the distinct nodes of a level, the level above
    the leaves first; ``values`` the distinct leaves; ``roots`` one node per row.
    """

    def __init__(self, leaves: np.ndarray):
        self.values, nodes = np.unique(leaves, return_inverse=True)
        nodes, known = nodes.reshape(leaves.shape), len(self.values)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while nodes.shape[1] > 1:
            made, ids = np.unique(nodes[:, ::2] * known + nodes[:, 1::2], return_inverse=True)
            self.levels.append(np.divmod(made, known))
            nodes, known = ids.reshape(nodes.shape[0], -1), len(made)
        self.roots = nodes[:, 0]

    def prices(self, first: np.ndarray, second: np.ndarray, price) -> np.ndarray:
        """Sum of ``price(pair, leaf, leaf)`` over the leaves of the trees ``first[i]`` and ``second[i]``, for each i.

        Going down, each level holds the distinct node pairs that the walks have met; going up, each is priced once.
        """
        pair, a, b = np.arange(len(first)), self.roots[first], self.roots[second]
        met: list[np.ndarray] = []
        for left, right in reversed(self.levels):
            size = int(max(left.max(), right.max())) + 1
            keys = np.concatenate([(pair * size + side[a]) * size + side[b] for side in (left, right)])
            keys, place = np.unique(keys, return_inverse=True)
            met.append(place.reshape(2, -1))
            rest, b = np.divmod(keys, size)
            pair, a = np.divmod(rest, size)
        value = price(pair, a, b)
        for left, right in reversed(met):
            value = value[left] + value[right]
        return value


def _walk(run: pa.Table, width: int, walked: int) -> Iterator[pa.RecordBatch]:
    """Divergence of the groups of two tiles within one block of ``width`` term ids."""
    heads, cells = run.filter(pa.compute.is_null(run["slot"])), run.filter(pa.compute.is_valid(run["slot"]))
    places, sizes = heads["place"].to_numpy(), heads["size"].to_pylist()
    block, terms, first_id = (heads[c][0].as_py() for c in ("block", "terms", "first_id"))
    order = np.argsort(places)
    sizes = [sizes[i] for i in order]
    ids = block * width + np.arange(width)
    leaves = np.zeros((len(places), width), np.int64)
    leaves[np.searchsorted(places[order], cells["place"].to_numpy()), cells["slot"].to_numpy()] = cells["n"].to_numpy()
    leaves[:, (ids < first_id) | (ids >= first_id + terms)] = ABSENT
    forest = Forest(leaves)
    shares = np.stack([_shares(forest.values, size, terms) for size in sizes])
    absent = forest.values == ABSENT
    tile = heads["tile"].to_numpy()[order]
    a, b = heads["a"][0].as_py(), heads["b"][0].as_py()
    names = heads["source"].take(pa.array(order)).combine_chunks()
    lefts, rights = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
    step = max(1, walked // width // max(1, len(rights)))
    for at in range(0, len(lefts), step):
        x, y = (g.ravel() for g in np.meshgrid(lefts[at : at + step], rights, indexing="ij"))
        x, y = x[x != y if a != b else x < y], y[x != y if a != b else x < y]
        if not len(x):
            continue

        def price(pair, left, right):
            p, q = shares[x[pair], left], shares[y[pair], right]
            return np.where(absent[left], 0, (p - q) ** 2 // (p + q))

        lang = pa.array([heads["lang"][0].as_py()] * len(x), pa.string())
        yield pa.RecordBatch.from_arrays([lang, names.take(pa.array(x)), names.take(pa.array(y)), pa.array(forest.prices(x, y, price))], ["lang", "source", "item", "value"])


def _pairs(groups: DataFrame, cells: DataFrame, width: int, walked: int) -> DataFrame:
    """``lang, source, item, value`` of each two sources of a language, once."""
    tiles = groups.select("lang", "tile").distinct()
    both = tiles.select("lang", F.col("tile").alias("a")).join(tiles.select("lang", F.col("tile").alias("b")), "lang").filter("a <= b")
    homes = both.select("lang", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    # Blocks of a language; -1 holds no term and gives its pairs their rows.
    spans = groups.select("lang", "terms", "first_id").distinct()
    last = F.col("first_id") + F.col("terms") - 1
    blocks = spans.select("lang", F.explode(F.when(F.col("terms") == 0, F.array(F.lit(-1).cast("long"))).otherwise(
        F.sequence(F.floor(F.col("first_id") / width), F.floor(last / width)))).alias("block"))
    key, none = ["lang", "block", "a", "b"], F.lit(None)
    heads = groups.join(homes, ["lang", "tile"]).join(blocks, "lang").select(
        *key, "tile", "place", "source", "size", "terms", "first_id", none.cast("int").alias("slot"), none.cast("long").alias("n"))
    body = cells.withColumn("block", F.floor(F.col("id") / width)).join(homes, ["lang", "tile"]).select(
        *key, "tile", "place", none.cast("string").alias("source"), none.cast("long").alias("size"), none.cast("long").alias("terms"),
        none.cast("long").alias("first_id"), (F.col("id") % width).cast("int").alias("slot"), "n")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in key_runs(batches, key):
            columns = [runs[c].combine_chunks() for c in key]
            edge = np.zeros(runs.num_rows, bool)
            edge[0] = True
            for c in columns:
                edge[1:] |= pa.compute.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            starts = [*np.flatnonzero(edge).tolist(), runs.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                yield from _walk(runs.slice(lo, hi - lo), width, walked)

    rows = heads.unionByName(body).repartition(*key).sortWithinPartitions(*key)
    walked = rows.mapInArrow(walk, "lang string, source string, item string, value long")
    return walked.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP,
    block: int = BLOCK, tile: int = TILE, walked: int = WALKED, entries: int = ENTRIES,
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair`` holds a group against each other source of its language, over all kept terms (those in
    ``least_docs`` documents of the language); part ``term`` its ``top`` terms that are above their share
    in the language. Ranks start at 1, largest value first, then by item.
    ``block`` (a power of two), ``tile``, ``walked`` and ``entries`` bound a task's memory and change no row.
    """
    counts = saved(term_counts(docs, text, lang, source, entries))
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = saved(ranked(kept.filter(F.col("docs") >= least_docs).drop("docs"), [F.col("lang"), F.desc("total"), F.col("term")], "id"))
    cells = saved(counts.filter("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total", "id"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"), F.min("id").alias("first_id"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = counts.filter("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    groups = ranked(groups, [F.col("lang"), F.col("source")], "place")
    groups = saved(groups.withColumn("tile", F.floor(F.col("place") / tile)))

    here = cells.join(groups, ["lang", "source"])
    halves = _pairs(groups, here.select("lang", "tile", "place", "id", "n"), block, walked)
    pairs = halves.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    p, q = scaled(F.col("n"), F.col("size"), F.col("terms")), scaled(F.col("total"), F.col("lang_size"), F.col("terms"))
    shares = here.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    terms = shares.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))

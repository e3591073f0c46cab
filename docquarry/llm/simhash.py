"""SimHash fingerprints and near-duplicates within a few bits, searched in BK-trees.

Two fingerprints at most r bits apart agree on one of r + 1 parts of their bits. Each value of each
part is a shard; its fingerprints form a BK-tree, whose children are keyed by their integer Hamming
distance to the parent, and a query follows only the edges within the radius. A shard that outgrows
``SHARD_ROWS`` is split into several trees, and each tree is sent to every block of the shard's
queries. Trees meet their queries by a shuffle: no fingerprint goes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import key_runs, saved
from docquarry.llm.graph import components
from docquarry.operators.joins import bounded

SEED = 42
WIDTH = 64
# Fingerprints of one tree, and of one block of queries.
SHARD_ROWS = 4096
# Shingles whose bits are counted at once.
CHUNK = 1 << 16
# Texts whose sets a task holds at once.
SLICE_ROWS = 256
# Hashes that a task counts at once, and the most frequent ones that decide the order of a set's hashes (9 MB).
COUNTED = 1 << 21
COMMON = 1 << 20
EPS = 1e-9


def shingles(text: bytes | None, size: int = 3) -> Iterator[np.ndarray]:
    """Hashes of the ``size``-word shingles of a UTF-8 text in order, at most ``CHUNK`` at a time; a shorter text is one shingle."""
    parts = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces only
    if not parts:
        return
    whole = b" ".join(parts)
    ends = np.cumsum([len(w) + 1 for w in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    step = min(size, len(parts)) - 1
    hash64 = xxhash.xxh64_intdigest
    n = len(parts) - step
    for at in range(0, n, CHUNK):
        to = min(at + CHUNK, n)
        spans = zip(starts[at:to], ends[at + step : to + step])
        yield np.fromiter((hash64(whole[s:e], SEED) for s, e in spans), np.uint64, to - at)


def _bits(ones: np.ndarray, n: int) -> int:
    """The fingerprint whose bits are set in over half of ``n`` hashes."""
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def _ones(codes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """Unsigned SimHash of the ``size``-word shingles of a UTF-8 text, repeats included."""
    ones, n = np.zeros(WIDTH, np.int64), 0
    for codes in shingles(text, size):
        n += len(codes)
        ones += _ones(codes)
    return _bits(ones, n)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """``doc_id, code`` (the fingerprint as a signed long) for every row; null texts count as empty."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [_signed(fingerprint(x.as_py(), size)) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(codes, pa.int64())], ["doc_id", "code"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, code long")


class BKTree:
    """BK-tree over integers by Hamming distance."""

    def __init__(self, codes: list[int]):
        self.codes: list[int] = []
        self.edges: list[dict[int, int]] = []
        for code in codes:
            self.add(code)

    def add(self, code: int) -> None:
        at = 0
        while at < len(self.codes):
            if not (d := (self.codes[at] ^ code).bit_count()):
                return
            if (child := self.edges[at].get(d)) is None:
                self.edges[at][d] = len(self.codes)
                break
            at = child
        self.codes.append(code)
        self.edges.append({})

    def within(self, code: int, radius: int) -> list[int]:
        """Codes at most ``radius`` bits away."""
        found, stack = [], [0] if self.codes else []
        while stack:
            at = stack.pop()
            d = (self.codes[at] ^ code).bit_count()
            if d <= radius:
                found.append(self.codes[at])
            edges = self.edges[at]
            if len(edges) <= 2 * radius + 1:
                stack.extend(c for k, c in edges.items() if d - radius <= k <= d + radius)
            else:
                stack.extend(edges[k] for k in range(max(1, d - radius), d + radius + 1) if k in edges)
        return found


def _forest(nodes: list[int], queries: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between ``nodes`` and ``queries``: as connected as all of them."""
    tree = BKTree([n & 0xFFFFFFFFFFFFFFFF for n in nodes])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for query in queries:
        for other in tree.within(query & 0xFFFFFFFFFFFFFFFF, radius):
            a, b = find(query), find(_signed(other))
            if a != b:
                root[b] = a
                yield query, _signed(other)


def links(codes: DataFrame, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``a, b``: links between distinct codes at most ``radius`` bits apart, enough of them to connect all such pairs.

    ``codes`` has one row per distinct ``code``. Nulls link with nothing.
    """
    cuts = [round(WIDTH * i / (radius + 1)) for i in range(radius + 2)]
    parts = [
        F.struct(F.lit(i).alias("part"), F.shiftrightunsigned(F.shiftleft("code", WIDTH - hi), WIDTH - hi + lo).alias("value"))
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))
    ]
    rows = codes.filter("code IS NOT NULL").select("code", F.inline(F.array(*parts)))
    sizes = rows.groupBy("part", "value").agg(F.count("*").alias("n")).filter("n > 1")
    trees = F.ceil(F.col("n") / F.lit(shard_rows)).cast("int")
    own = F.pmod(F.xxhash64("code"), F.col("trees")).cast("int")
    rows = rows.join(sizes, ["part", "value"]).withColumn("trees", trees).withColumn("own", own)
    # (tree, block) of each meeting, once for each unordered pair
    lists = F.expr("transform(sequence(0, trees - 1), i -> struct(least(i, own) AS tree, greatest(i, own) AS block))")
    rows = rows.select("part", "value", "code", "own", F.inline(lists))
    group = ["part", "value", "tree", "block"]
    rows = rows.repartition(*group).sortWithinPartitions(*group, "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in key_runs(batches, group):
            cols = [whole[c].to_numpy() for c in group]
            new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols], axis=0)))
            at = [*np.flatnonzero(new).tolist(), whole.num_rows]
            code, own, tree, block = (whole[c].to_numpy() for c in ("code", "own", "tree", "block"))
            pairs: list[tuple[int, int]] = []
            for i, j in zip(at, at[1:]):
                mine, asked = code[i:j][own[i:j] == tree[i]].tolist(), code[i:j][own[i:j] == block[i]].tolist()
                pairs.extend(_forest(mine, asked, radius))
            a, b = pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def prefix_size(n: int, likeness: float) -> int:
    """How many of the first of ``n`` hashes a set must share one of with any set of this Jaccard similarity."""
    return n - math.ceil(n * likeness - EPS) + 1


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.withColumn("unit", F.unhex(F.sha2("text", 256)))


def _shingle_set(text: bytes | None, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct hashes of a text's shingles, as sorted signed numbers, and all of them in parts."""
    parts = list(shingles(text, size))
    return np.unique(np.concatenate(parts).view(np.int64)) if parts else np.empty(0, np.int64), parts


def common_shingles(docs: DataFrame, text: str = "text", size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ``COMMON`` most frequent shingle hashes, sorted, and for each the bits of its number of texts.

    All texts are read. A task passes on what occurs twice among ``COUNTED`` hashes, which is little, so
    rare shingles may be missing. The result orders hashes: it decides what a search costs, not what it finds.
    """
    rows = docs.select(F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
            hashes = np.sort(np.concatenate(held)) if held else np.empty(0, np.int64)
            at = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1], [True]))) if len(hashes) else np.zeros(1, np.int64)
            times = np.diff(at)
            return pa.RecordBatch.from_arrays([pa.array(hashes[at[:-1]][times > 1]), pa.array(times[times > 1])], ["hash", "n"])

        held, n = [], 0
        for batch in batches:
            for value in batch["text"]:
                held.append(_shingle_set(value.as_py(), size)[0])
                n += len(held[-1])
                if n >= COUNTED:
                    yield repeated(held)
                    held, n = [], 0
        yield repeated(held)

    counts = rows.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    best = counts.orderBy(F.desc("n"), "hash").limit(COMMON).select("hash", F.length(F.bin("n")).cast("byte").alias("level")).orderBy("hash").toArrow()
    return best["hash"].to_numpy(), best["level"].to_numpy()


def prefixes(docs: DataFrame, likeness: float, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """``row, doc_id, unit, code, id, n, hashes, level`` of every row, written down.

    ``unit`` is a hash of the text and ``id`` one of its shingle set, ``n`` the size of that set and ``hashes`` its prefix
    in one order of all hashes: by level, 0 but for ``common_shingles``, then by value. ``level`` is that of the prefix's last.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text, size))
    rows = _texts(docs, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_levels = common.value
        for batch in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
            codes, ids, sizes, heads, ends = [], [], [], [], []
            for value in batch["text"]:
                own, parts = _shingle_set(value.as_py(), size)
                codes.append(_signed(_bits(sum(_ones(p) for p in parts), sum(map(len, parts)))) if parts else 0)
                ids.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                levels = np.zeros(len(own), np.int8)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    levels = np.where(known[at] == own, known_levels[at], levels)
                order = np.argsort(levels, kind="stable")[: prefix_size(len(own), likeness)]
                heads.append(own[order])
                ends.append(int(levels[order[-1]]) if len(order) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["unit"], pa.array(codes, pa.int64()), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.array(heads, pa.list_(pa.int64())), pa.array(ends, pa.int8())],
                ["doc_id", "unit", "code", "id", "n", "hashes", "level"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, unit binary, code long, id binary, n int, hashes array<bigint>, level byte")
    return saved(found.withColumn("row", F.monotonically_increasing_id()))


def _verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame, likeness: float, text: str, key: str, size: int) -> DataFrame:
    """Those of the pairs of rows ``x, y`` whose whole shingle sets have the likeness, with their codes ``a, b``."""
    rows = pairs.select(F.col("x").alias("row")).unionByName(pairs.select(F.col("y").alias("row"))).distinct()
    asked = saved(heads.select("row", "unit").join(rows, "row"))
    found = _texts(docs, text, key).join(bounded(asked.select("unit").distinct()), "unit", "left_semi").select("unit", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
            sets = [_shingle_set(x.as_py(), size)[0] for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["unit"], pa.array(sets, pa.list_(pa.int64()))], ["unit", "hashes"])

    sets = found.dropDuplicates(["unit"]).mapInArrow(run, "unit binary, hashes array<bigint>")
    sets = saved(sets.join(asked, "unit").select("row", "hashes"))
    for s in "xy":
        pairs = pairs.join(sets.select(F.col("row").alias(s), F.col("hashes").alias(f"{s}_set")), s)
    shared = F.size(F.array_intersect("x_set", "y_set"))
    enough = shared * F.lit(1 + likeness) >= (F.size("x_set") + F.size("y_set")) * F.lit(likeness) - EPS
    return saved(pairs.filter(enough).select("x", "y", "a", "b"))


def alike(
    docs: DataFrame, likeness: float, text: str = "text", size: int = 3, radius: int = 2, key: str = "doc_id", known: DataFrame | None = None,
    beside_links: bool = False,
) -> DataFrame:
    """``a, b``: codes, over ``radius`` bits apart, of texts whose shingle sets have a Jaccard similarity of ``likeness``.

    Exact, and enough to connect all such texts: two such sets share one of the first
    ``n - ceil(likeness n) + 1`` of their hashes, in an order that puts common ones last. What pairs share
    there, and what can follow it, bounds the overlap; only pairs that it lets through are verified on the
    whole sets. First each text meets, of the first and the nearest text before it at each hash, the one
    met most often: that connects a crowd of copies at a linear cost. Then only texts that are not
    connected yet meet, at hashes that such texts share. Texts without words have no shingles.
    ``known`` may hold the ``prefixes`` of ``docs``. With ``beside_links`` texts that ``links`` of the radius connect
    may be left to those.
    """
    known = prefixes(docs, likeness, text, key, size) if known is None else known
    # repeats inside a text count for its code: equal sets may have several
    heads = saved(known.filter("n > 0").dropDuplicates(["id", "code"]).select("row", "unit", "code", "n", "hashes", "level"))
    one = heads.select("row", F.shiftleft(F.col("n").cast("long"), 32).alias("at"), F.posexplode("hashes").alias("place", "hash"))
    one = one.select("row", "hash", F.col("at").bitwiseOR(F.col("place").cast("long")).alias("at"))
    group = Window.partitionBy("hash").orderBy("row")
    before, after_it = F.lag("row").over(group), F.lead("row").over(group)
    one = one.select("row", "hash", "at", F.first("row").over(group).alias("first"), before.alias("last"), after_it.alias("next"))
    # most hashes are those of one text and meet nothing
    one = saved(one.filter("last IS NOT NULL OR next IS NOT NULL").drop("next"))
    c = lambda side, name: F.col(f"{side}.{name}")
    n = lambda side: F.shiftright(c(side, "at"), 32)
    place = lambda side: c(side, "at").bitwiseAND(F.lit((1 << 32) - 1))
    near = F.least(n("x"), n("y")) >= F.greatest(n("x"), n("y")) * F.lit(likeness) - EPS
    ends = heads.select("row", "code", "n", F.struct("level", F.element_at("hashes", -1).alias("hash")).alias("end"))

    def possible(met: DataFrame) -> DataFrame:
        """Pairs ``x, y`` of rows that meet, by what they share and what can follow; ``close`` ones need no more."""
        met = met.groupBy(c("x", "row").alias("x"), c("y", "row").alias("y")).agg(F.count("*").alias("shared"), F.max(place("x")).alias("x_at"), F.max(place("y")).alias("y_at"))
        # the set whose prefix ends first shares nothing more there; the other none before its last place shared
        for s in "xy":
            met = met.join(ends.select(F.col("row").alias(s), *[F.col(f).alias(f"{s}_{f}") for f in ("code", "n", "end")]), s)
        after = lambda s: F.col(f"{s}_n") - 1 - F.col(f"{s}_at")
        beyond = lambda s: F.ceil(F.col(f"{s}_n") * F.lit(likeness) - EPS) - 1
        x_first = F.least(beyond("x"), after("y"))
        y_first = F.least(beyond("y"), after("x"))
        more = F.when(F.col("x_end") < F.col("y_end"), x_first).when(F.col("x_end") > F.col("y_end"), y_first).otherwise(F.least(x_first, y_first))
        need = F.ceil((F.col("x_n") + F.col("y_n")) * F.lit(likeness / (1 + likeness)) - EPS)
        close = F.bit_count(F.col("x_code").bitwiseXOR(F.col("y_code"))) <= radius
        met = met.filter(close | (F.col("shared") + more >= need))
        return saved(met.select("x", "y", F.col("x_code").alias("a"), F.col("y_code").alias("b"), close.alias("close")))

    held = one.select(F.col("row").alias("x"), F.explode(F.array("first", "last")).alias("y")).filter("x <> y").groupBy("x", "y").count()
    best = saved(held.groupBy("x").agg(F.max_by("y", F.struct("count", "y")).alias("y")))
    met = best.join(one.alias("x"), F.col("x") == c("x", "row")).join(one.alias("y"), (F.col("y") == c("y", "row")) & (c("x", "hash") == c("y", "hash")) & near)
    pairs = possible(met)
    first = _verified(pairs.filter("NOT close").drop("close"), heads, docs, likeness, text, key, size)
    connected = first.select("x", "y")
    if beside_links:
        connected = connected.unionByName(pairs.filter("close").select("x", "y"))
    roots = saved(components(connected, "x", "y"))
    rest = one.select("row", "hash", "at").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("component", "row"))
    mixed = rest.groupBy("hash").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    rest = saved(rest.join(mixed, "hash", "left_semi").select("row", "hash", "at", "root"))
    met = rest.alias("x").join(rest.alias("y"), (c("x", "hash") == c("y", "hash")) & (c("y", "row") < c("x", "row")) & (c("x", "root") != c("y", "root")) & near)
    pairs = possible(met).filter("NOT close").drop("close").join(best, ["x", "y"], "left_anti")
    return first.unionByName(_verified(saved(pairs), heads, docs, likeness, text, key, size)).select("a", "b").distinct()


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, radius: int = 2, likeness: float | None = None) -> DataFrame:
    """``doc_id, code, component_id`` for every row: the smallest id reachable over links of ``radius`` bits.

    With ``likeness`` texts whose shingle sets have this Jaccard similarity are linked too.

    Null, empty and wordless texts have code 0, which links like any other. Equal texts share a
    class; a null id counts for a class only if it has no other. An empty table gives no rows.
    """
    coded = saved(fingerprints(docs, text, key, size)) if likeness is None else prefixes(docs, likeness, text, key, size)
    distinct = saved(coded.groupBy("code").agg(F.min("doc_id").alias("first")))
    near = links(distinct, radius)
    found = components(near if likeness is None else near.unionByName(alike(docs, likeness, text, size, radius, key, coded, beside_links=True)))
    rooted = distinct.join(found, F.col("code") == F.col("node"), "left").select(
        "code", "first", F.coalesce("component", "code").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return coded.join(rooted.join(least, "root").select("code", "component_id"), "code").select("doc_id", "code", "component_id")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, radius: int = 2, likeness: float | None = None) -> DataFrame:
    """Rows of ``docs``, all columns, that are first of their class.

    Where rows repeat the kept id, one of them stays: the first by text, then by the rest. Rows
    without an id stay, as none can be told from another.
    """
    found = classes(docs, text, key, size, radius, likeness).filter("doc_id = component_id")
    first = saved(found.groupBy("doc_id").agg(F.count("*").alias("__rows")).withColumnRenamed("doc_id", "__first"))
    same = F.col(key) == F.col("__first")
    kept = docs.join(first.filter("__rows = 1"), same, "left_semi").unionByName(docs.filter(F.col(key).isNull()))
    if first.filter("__rows > 1").isEmpty():
        return kept
    order = [F.col(text), *(F.xxhash64(c) for c in docs.columns if c not in (text, key))]
    several = docs.join(first.filter("__rows > 1"), same, "left_semi")
    several = several.withColumn("__row", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return kept.unionByName(several.filter("__row = 1").drop("__row"))

"""Whitening, source divergence and licence scans against plain Python, with awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from docquarry.llm import divergence, licenses, queries, whitening
from docquarry.llm.common import table

SF = "/root/testdata/sf0.001"


# --- whitening -----------------------------------------------------------------------------------


def plain_whitening(rows):
    """Key, exact deviation and whitened values by exact covariance and a symmetric eigensolver."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dev = [[n * c - s for c, s in zip(row, sums)] for row in x]
    width = len(sums)
    v = np.array([[float(Fraction(sum(d[i] * d[j] for d in dev), n**3)) for j in range(width)] for i in range(width)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    with np.errstate(all="ignore"):
        white = (np.array(dev, float) / n) @ axes / np.sqrt(values)
    return sums, [sum(c * c for c in d) for d in dev], white, values / values.sum()


def test_whitening_matches_brute_force(spark):
    frame = table(spark, SF, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.select("vec_id", "embedding").collect() if r["embedding"]]
    _, deviations, white, share = plain_whitening(rows)
    found = {(r["vec_id"], r["component"]): r for r in queries.op11_whitening(spark, SF).collect()}
    assert set(found) == {(i, c) for i, _ in rows for c in range(1, 9)}
    for c in range(8):
        got = np.array([found[i, c + 1]["whitened"] for i, _ in rows])
        sign = np.sign(got @ white[:, c])
        assert np.abs(got - sign * white[:, c]).max() < 1e-8
        assert abs(found[rows[0][0], c + 1]["explained"] - share[c]) < 1e-12
    assert [found[i, 1]["deviation"] for i, _ in rows] == deviations
    assert max(r["identity_error"] for r in found.values()) < 1e-10


def test_factor_and_rotations():
    rng = np.random.default_rng(3)
    for size, rank in ((1, 1), (2, 2), (5, 3), (9, 9), (12, 0)):
        b = rng.normal(size=(size, rank)) * 10.0 ** rng.integers(-4, 4, rank)
        a = b @ b.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a, rtol=1e-9, atol=1e-9 * np.abs(a).max(initial=0))
        axes, values = whitening.jacobi(factor)
        assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-12)
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1][:rank], rtol=1e-7, atol=1e-14 * np.abs(a).max(initial=0))


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 1.0, 7.0]), (1, [0.5, 1.0, 7.0]), (None, [2.0, -1.0, 7.0]), (2, [1e30, 0.0, 7.0]), (3, [3.0, 4.0, 7.0]), (4, None), (5, []),
        (6, [nan, 1.0, 1.0]), (7, [1.0, None, 1.0]), (8, [inf, 1.0, 1.0]), (9, [1.0, 2.0]),
    ]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, key int, whitened string")
    found = whitening.whitened_components(frame).collect()
    # 2's entry is held at 2 ** 53, beside which nothing else varies to working precision.
    assert Counter((r["vec_id"], r["component"]) for r in found) == Counter((i, 1) for i in (1, 1, None, 2, 3))
    kept = [(i, [min(c, 2.0**43) for c in v]) for i, v in rows[:5]]
    exact = {r["vec_id"]: (r["deviation"], int(r["deviation_exact"])) for r in found}
    assert exact[2] == (None, plain_whitening(kept)[1][3]) and {r["n"] for r in found} == {5}
    # Without it two dimensions vary and one is constant.
    plain = whitening.whitened_components(frame.filter("vec_id IS NULL OR vec_id <> 2")).collect()
    assert Counter((r["vec_id"], r["component"]) for r in plain) == Counter((i, c) for i in (1, 1, None, 3) for c in (1, 2))
    _, deviations, white, _ = plain_whitening([rows[i] for i in (0, 1, 2, 4)])
    assert {(r["vec_id"], r["deviation"], round(abs(r["whitened"]), 9)) for r in plain if r["component"] == 1} == {
        (rows[i][0], d, round(abs(w), 9)) for i, d, w in zip((0, 1, 2, 4), deviations, white[:, 0].tolist())}
    for alike in (frame.limit(0), frame.filter("vec_id = 1"), frame.filter("vec_id = 4")):
        empty = whitening.whitened_components(alike)
        assert empty.count() == 0 and empty.columns == list(found[0].asDict())


# --- divergence ----------------------------------------------------------------------------------


def plain_audit(rows, least=10, top=10):
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = [s for x, s in groups if x == lang]

        def shares(counter, kept=kept):
            size = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // (size + 2 * len(kept)) for t in kept}

        own = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(-sum(f(own[s][t], own[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(own[s][t], whole[t]), t.encode()) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def audited(frame, **options):
    return sorted(tuple(r) for r in divergence.audit(frame, **options).collect())


def test_divergence_matches_brute_force(spark):
    frame = table(spark, SF, "documents")
    rows = [tuple(r) for r in frame.select("text", "lang", "source").collect()]
    assert audited(frame) == plain_audit(rows)


def test_divergence_over_many_blocks_and_tiles(spark):
    """Groups over several tiles and terms over several blocks, neighbours of two languages in one block."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}é" for a in "abcdefgh" for b in "pqrstuvwxyz"]
    rows = []
    for _ in range(400):
        source = min(int(rng.expovariate(0.4)), 10)
        words = [rng.choice(vocabulary[: 10 + 8 * source] if rng.random() < 0.5 else vocabulary) for _ in range(rng.randrange(30))]
        rows.append((" ".join(words), rng.choice(["en", "de", None]), f"s{source}"))
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert audited(frame, least_docs=3, block=16, tile=4, walked=64, entries=100) == plain_audit(rows, least=3)


def test_equal_subtrees_are_one_node_and_priced_once():
    leaves = np.array([[1, 2, 1, 2, 0, 0, 0, 0], [1, 2, 0, 0, 1, 2, 0, 0], [5, 5, 5, 5, 5, 5, 5, 5]])
    forest = divergence.Forest(leaves)
    # Pairs (1,2), (0,0), (5,5); above them (12,12), (00,00), (12,00), (55,55); then three roots of which two differ.
    assert [len(left) for left, _ in forest.levels] == [3, 4, 3]
    asked = []

    def price(pair, a, b):
        asked.extend(zip(pair.tolist(), forest.values[a].tolist(), forest.values[b].tolist()))
        return np.abs(forest.values[a] - forest.values[b])

    x, y = np.array([0, 0, 1]), np.array([1, 2, 2])
    assert forest.prices(x, y, price).tolist() == [6, 34, 34]
    assert len(asked) == len(set(asked)) < leaves.shape[1] * 3


def test_divergence_of_awkward_rows(spark):
    long = "alpha beta " * 50_000
    rows = [(None, None, None), ("", "en", "a"), ("12 !!", "en", "b"), (long, "en", "a"), ("ALPHAKß Éé alpha", "en", "c"), ("alpha", "de", "a"), ("alpha", "de", "a")]
    frame = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "text string, lang string, source string, n long, term string, value int")
    for least in (1, 2, 10):
        assert audited(frame, least_docs=least) == plain_audit(rows, least=least)
    assert [r[4] for r in audited(frame) if r[2] == "pair"] == [0] * 6
    assert divergence.audit(frame.limit(0)).count() == 0


def test_shares_of_huge_counts_are_exact(spark):
    size = 10**13
    counts = np.array([0, 1, 3 * 10**12, divergence.ABSENT])
    want = [1 + 10**9 * (int(c) + 2) // (size + 2 * 77) for c in counts[:3]]
    assert divergence._shares(counts, size, 77).tolist() == [*want, 1]
    row = spark.createDataFrame([(int(c), size, 77) for c in counts[:3]], "c long, s long, v long")
    assert [r[0] for r in row.select(divergence.scaled(row.c, row.s, row.v)).collect()] == want


# --- licences ------------------------------------------------------------------------------------


def plain_scan(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for t in licenses.TEMPLATES:
        for start in range(-len(t.words), len(words)):
            at = lambda i: words[i] if 0 <= i < len(words) else None  # noqa: B023, E731
            if all(at(start + rel) == w for rel, w in t.key_words.items()):
                found.append((t.label, t.base, start, sum(at(start + i) == w for i, w in enumerate(t.words)) / len(t.words)))
    return len(words), sorted(found)


def scanned(frame, **options):
    found = licenses.licences(frame, **options)
    return [(r["doc_id"], r["n_words"], sorted(tuple(f) for f in r["found"])) for r in found.collect()]


def test_licences_match_brute_force(spark):
    frame = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").filter("text rlike '(?i)licen|cc by|gnu'").collect()}
    found = {i: (n, f) for i, n, f in scanned(frame)}
    assert texts and {i: found[i] for i in texts} == {i: plain_scan(t) for i, t in texts.items()}
    assert sum(bool(f) for _, f in found.values()) == sum(bool(found[i][1]) for i in texts)


AWKWARD = [
    (1, None), (2, ""), (3, "..."), (4, "MIT License"), (4, "MIT License"), (None, "the mit\n\n** LICENSE, mit-license"), (5, "mit licenses mit LicensK"),
    (6, "Released under CC BY-NC-SA. cc  by"), (7, "gnu gnu general public license gnu general public license version 3 version 2"),
    (8, "software without restriction, obtaining a copy of this software"),
    (9, "is hereby granted, free of charge, to any persons obtaining a copy of this software and associated"),
    (10, "Permission is hereby GRANTED, free of charge, to each person obtaining a copy of this software"),
    (11, "apache license " * 30_000), (12, "mit " * 50_000), (13, "source code form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (14, "mit license mitİ license"),
]


def test_licences_in_awkward_rows(spark):
    frame = spark.createDataFrame([(*r, 1, ["x"]) for r in AWKWARD], "doc_id long, text string, n_words int, found array<string>")
    found = sorted(scanned(frame), key=str)
    assert found == sorted(((i, *plain_scan(t)) for i, t in AWKWARD), key=str)
    rows = {r["doc_id"]: r for r in licenses.licences(frame).collect()}
    assert (rows[11]["n_base"], rows[11]["first_word"], rows[11]["last_word"], rows[11]["base_labels"]) == (30_000, 0, 59_998, "apache")
    assert (rows[1]["n_base"], rows[1]["first_word"], rows[1]["labels"], rows[1]["score"]) == (0, None, "", 0.0)
    assert rows[6]["labels"] == "cc-by,cc-by-nc" and rows[7]["labels"] == "gpl,gpl-3.0"
    assert rows[9]["labels"] == "" and rows[10]["labels"] == "mit-grant" and 0 < rows[10]["score"] < 1
    assert rows[13]["labels"] == "mpl-2.0" and rows[13]["found"][0]["start"] == -1
    empty = licenses.licences(frame.limit(0))
    assert empty.count() == 0


@pytest.mark.parametrize("common", ["mit", "license", "general", "is"])
def test_frequencies_change_the_index_but_not_the_findings(spark, common):
    """Whatever words the corpus makes rare, the same places are found."""
    frame = spark.createDataFrame(AWKWARD[:11], "doc_id long, text string")
    frequencies = {w: 1000 if w == common else i for i, w in enumerate(licenses.word_frequencies(frame))}
    mit = next(t for t in licenses.TEMPLATES if t.label == "mit")
    assert list(licenses.rarest(mit, frequencies)) == (["license"] if common == "mit" else ["mit"] if common == "license" else list(licenses.rarest(mit, frequencies)))
    found = sorted(((r["doc_id"], r["n_words"], sorted(tuple(f) for f in r["found"])) for r in licenses.scan(frame, frequencies).collect()), key=str)
    assert found == sorted(((i, *plain_scan(t)) for i, t in AWKWARD[:11]), key=str)

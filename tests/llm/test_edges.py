"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm import bpe, embedding, fingerprint, graph, langid, linededup, lm, mixing, pii, simhash, toxicity
from docquarry.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, code long, node string, size string, word string"
LONG = "the cat sat on the mat. " * 4000
ROWS = [
    (1, "the cat sat on the mat\nplain words here", "en", "a", 1),
    (1, "the cat sat on the mat\nplain words here", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \n\t ", "en", "b", 3),
    (5, LONG, "en", "a", len(LONG)),
    (6, "der hund und die katze", "de", None, 5),
    (None, "lost and found", "en", "a", 4),
    (7, "12345 !!! 678", None, "c", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 9, "x", "y", "z") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (6, 0), (None, 1), (5, None), (3, 0)], "doc_id long, toxic int")


def network(docs):
    vocab = lm.vocabulary(docs, classes=4, members=8, buckets=8)
    return lm.score(docs, vocab, lm.train(docs, vocab, hidden=4))


OPERATORS = {
    "language": lambda d: langid.identify(d, langid.learn(d)),
    "encode": lambda d: bpe.encode(d, vocabulary()),
    "decode": lambda d: bpe.decode(bpe.encode(d, vocabulary()), vocabulary()),
    "round_trip": lambda d: bpe.round_trip(d, vocabulary()),
    "simhash": simhash.classes,
    "mix": lambda d: mixing.mix(d, (3.0, 1.0, 2.0), 1.5, 2.0),
    "fingerprints": fingerprint.fingerprints,
    "neighbours": fingerprint.edited_neighbours,
    "toxicity": lambda d: toxicity.detect(d, toxicity.learn(d, labels(d.sparkSession))),
    "lm": network,
    "lines": linededup.removed_lines,
    "lines_out": linededup.deduplicated,
    "pii": pii.detect,
    "sanitised": pii.sanitised,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(docs, none, name):
    found = OPERATORS[name](docs)
    assert ids(found) == ALL
    empty = OPERATORS[name](none)
    assert empty.count() == 0 and empty.columns == found.columns


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language_values(docs):
    found = by_id(OPERATORS["language"](docs))
    assert [found[i]["lang_pred"] for i in (2, 3, 4, 7)] == ["und"] * 4
    assert found[5]["lang_pred"] == "en" and found[6]["lang_pred"] == "de"
    kept = langid.accepted(docs, langid.learn(docs))
    assert kept.columns == docs.columns and ids(kept) == [1, 1, 5, 6, None]


def test_simhash_values(docs):
    found = by_id(simhash.classes(docs))
    assert found[2]["code"] == found[3]["code"] == found[4]["code"] == 0
    assert {found[i]["component_id"] for i in (2, 3, 4)} == {2}
    kept = simhash.deduplicated(docs)
    assert ids(kept) == [1, 2, 5, 6, 7, None] and kept.columns == docs.columns


def test_lines_values(docs):
    found = by_id(linededup.deduplicated(docs))
    assert found[2]["text"] is None and found[3]["text"] == "" and found[4]["text"] == " \n\t "
    assert found[1]["text"] == ROWS[0][1]
    removed = by_id(linededup.removed_lines(docs))
    assert removed[2]["n_lines"] == 0 and removed[3]["n_lines"] == 1


def test_mix_values(docs):
    found = by_id(OPERATORS["mix"](docs))
    assert found[2]["size"] == 0 and found[2]["taken"] == 0
    assert all(r["taken"] <= 2 * r["size"] for r in found.values())
    out = mixing.sampled(docs, (3.0, 1.0, 2.0), 1.5, 2.0)
    assert out.columns == docs.columns


def test_fingerprint_values(docs):
    found = by_id(OPERATORS["neighbours"](docs))
    assert found[2]["sketch"] == [] and found[3]["sketch"] == []
    assert found[4]["near_next"] == 1.0 and found[3]["n_chars"] == 0


def test_toxicity_and_lm_values(docs):
    assert by_id(OPERATORS["toxicity"](docs))[3]["score"] == 0
    found = by_id(OPERATORS["lm"](docs))
    assert found[2]["n_tokens"] == 0 and found[2]["mean_log_prob"] is None and found[5]["n_tokens"] == 24000


VECTORS = [
    (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.001]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]),
    (7, [1.0, None]), (8, []), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (None, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [float("inf"), 0.0]),
]


def test_embedding_values(spark):
    frame = spark.createDataFrame([(*v, 1, 2) for v in VECTORS], "vec_id long, embedding array<float>, node int, n int")
    found = sorted((tuple(r) for r in embedding.near_duplicates(frame).collect()), key=lambda r: (r[0] is None, r[0]))
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), *[(i, 0, i, True) for i in (4, 5, 6, 7, 8)], *[(9, 2, 9, True)] * 2,
            (10, 0, 10, True), (11, 0, 11, True), (None, 2, 9, False)]
    assert found == want
    assert embedding.near_duplicates(frame.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (201, 200), (200, 202), (0, 1)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 200: 200, 201: 200, 202: 200}


def test_merge_of_parts(spark):
    text = " ".join(f"w{i % 97}" for i in range(600))
    whole = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cut = text.split(" ")
    parts = spark.createDataFrame([(1, " ".join(cut[:300])), (1, " ".join(cut[296:]))], "doc_id long, text string")
    sketches = fingerprint.fingerprints(parts, k=32)
    merged = fingerprint.merged(sketches, "doc_id", k=32).first()["sketch"]
    assert merged == fingerprint.fingerprints(whole, k=32).first()["sketch"]
    count = fingerprint.fingerprints(whole, k=32).select(fingerprint.distinct_shingles(F.col("sketch"), 32), fingerprint.containment(F.col("sketch"), F.col("sketch"), 32)).first()
    assert abs(count[0] - 97) < 60 and count[1] == 1.0


def test_pipeline_stages_on_awkward_rows(spark, docs, none):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (plain, plain.limit(0)):
        for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = spark.createDataFrame(stage(spark, rows, "").collect(), stage(spark, rows, "").schema)
            if place < len(corpus_pipeline.STAGES) - 1:
                assert rows.columns == plain.columns


def test_unit_scales_before_squaring():
    assert np.allclose(embedding.unit(np.array([[3e200, 4e200]])), [[0.6, 0.8]])

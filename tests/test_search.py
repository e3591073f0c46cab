"""Written indexes: block search of postings and walks of neighbour graphs, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import index as ix
from docquarry.operators import proximity as px
from docquarry.operators import sparse as sp


def tokens_of(text):
    return [t for t in re.findall(r"\w{2,}", (text or "").lower()) if t not in ix.STOPWORDS]


def brute_bm25(docs, query, k):
    tokens = {i: tokens_of(t) for i, t in docs}
    avg = sum(map(len, tokens.values())) / len(tokens)
    out = {}
    for term, qtf in Counter(tokens_of(query)).items():
        df = sum(term in t for t in tokens.values())
        for i, t in tokens.items():
            tf = t.count(term)
            if tf:
                w = math.log((len(docs) - df + 0.5) / (df + 0.5) + 1)
                out[i] = out.get(i, 0) + qtf * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
    ranked = sorted(((round(s, 4), i) for i, s in out.items() if round(s, 4) > 0), key=lambda x: (-x[0], x[1]))
    return [(i, s) for s, i in ranked[:k]]


def written(spark, docs, path, modality="text", **options):
    """An index of one collection over ``docs``."""
    index = sp.SparseIndex(str(path), ("doc_pos",), ("modality",), options.pop("buckets", 4))
    units = spark.createDataFrame(docs, "doc_pos long, text string").withColumn("modality", F.lit(modality))
    sp.write_segment(units, index, **options)
    return index


def asked(spark, queries):
    return spark.createDataFrame(queries, "query_id long, query string")


def same(rows, docs, queries, k):
    for qid, query in queries:
        mine = [(r.doc_pos, r.score) for r in rows if r.query_id == qid]
        want = brute_bm25(docs, query, k)
        assert [d for d, _ in mine] == [d for d, _ in want], qid
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(mine, want))


def corpus(n, rng, size=25):
    """Zipf-like words, a word in every document, copies, and empty texts."""
    vocabulary = [f"w{i}é" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(["common", *rng.choices(vocabulary, weights, k=rng.randrange(2 * size))])) for i in range(n)]
    docs[3:6] = [(i, docs[2][1]) for i in (3, 4, 5)]
    return [*docs, (n, ""), (n + 1, None), (n + 2, "the and")]


@pytest.mark.parametrize("k", [1, 5, 40])
def test_block_search_equals_brute_force(spark, tmp_path, k):
    rng = random.Random(k)
    docs = corpus(400, rng)
    index = written(spark, docs, tmp_path / "x", range_units=8)
    queries = [(1, "common"), (2, "w0é w1é w1é"), (3, "nothing here"), (4, "the"), (5, ""), (6, docs[2][1]), (7, "W250é W3É common"), (8, "w299é w0é")]
    rows = sp.search(spark, index, asked(spark, queries), k).orderBy("query_id", "rank").collect()
    same(rows, docs, queries, k)
    assert all(r.rank >= 1 for r in rows)


def test_block_search_with_joined_terms_and_ranges(spark, tmp_path, monkeypatch):
    """More terms and ranges than a filter names: the joins in their place give the same rows."""
    monkeypatch.setattr(sp, "LITERALS", 1)
    docs = corpus(150, random.Random(9))
    index = written(spark, docs, tmp_path / "x", range_units=16)
    queries = [(i, d) for i, d in docs if d][:20]
    same(sp.search(spark, index, asked(spark, queries), 6).orderBy("query_id", "rank").collect(), docs, queries, 6)


def test_collections_are_searched_apart(spark, tmp_path):
    text, table = corpus(60, random.Random(1)), corpus(90, random.Random(2), size=5)
    index = sp.SparseIndex(str(tmp_path / "x"), ("doc_pos",), ("modality",))
    units = [spark.createDataFrame(d, "doc_pos long, text string").withColumn("modality", F.lit(m)) for m, d in (("text", text), ("table", table))]
    sp.write_segment(units[0].unionByName(units[1]), index, range_units=32)
    queries = [(1, "common w0é"), (2, "w7é")]
    rows = sp.search(spark, index, asked(spark, queries), 4).orderBy("query_id", "rank").collect()
    same([r for r in rows if r.modality == "text"], text, queries, 4)
    same([r for r in rows if r.modality == "table"], table, queries, 4)
    stats = {r.modality: (r.n_units, r.avgdl) for r in sp.collection_stats(sp.read_blocks(spark, index), ("modality",)).collect()}
    assert stats["table"] == (93, sum(len(tokens_of(t)) for _, t in table) / 93)


def test_bounds_cover_their_blocks_for_any_setting(spark, tmp_path):
    index = written(spark, corpus(200, random.Random(4)), tmp_path / "x", range_units=16)
    blocks = sp.read_blocks(spark, index).filter("term is not null")
    for avgdl, k1, b in ((12.5, 1.5, 0.75), (3.0, 0.5, 1.0), (100.0, 2.0, 0.0)):
        top = lambda c: F.array_max(F.transform(c, lambda d: ix.bm25_part(d["tf"], d["dl"], F.lit(avgdl), k1, b)))  # noqa: B023, E731
        assert blocks.filter(F.abs(top("impacts") - top("docs")) > 1e-12).count() == 0
    assert blocks.filter(F.size("impacts") > F.size("docs")).count() == 0


def test_search_reads_index_files_of_its_terms_only(spark, tmp_path):
    """No text in the plan, pruned folders and pushed terms; a rare strong match leaves most postings of a common word unread."""
    rng = random.Random(6)
    docs = [(i, " ".join(["common"] * rng.randrange(1, 3) + [f"x{rng.randrange(50)}"] * rng.randrange(1, 60))) for i in range(2000)]
    docs += [(5000 + i, "common zebra zebra") for i in range(12)]
    index = written(spark, docs, tmp_path / "x", range_units=32, buckets=16)
    read = []
    original = sp._only

    def spied(blocks, values):
        read.append((values.columns[0], values.count()))
        return original(blocks, values)

    sp._only = spied
    try:
        found = sp.search(spark, index, asked(spark, [(1, "zebra common")]), 10)
    finally:
        sp._only = original
    same(found.orderBy("rank").collect(), docs, [(1, "zebra common")], 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.replace("text:", "") and "PartitionFilters: [" in plan and re.search(r"PushedFilters: \[[^\]]*In\(term", plan.replace("`", ""))
    ranges = sp.read_blocks(spark, index).select("range").distinct().count()
    seeds, chosen = [n for column, n in read if column == "range"]
    assert chosen < ranges / 4 and seeds <= 10


# --- neighbour graphs ----------------------------------------------------------------------------


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_graph_search_finds_neighbours_and_scores_few(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    raw = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    df = vectors_of(spark, [(i, v.tolist()) for i, v in enumerate(raw)])
    px.build_graph(df, str(tmp_path / "g"), shard_rows=1500)
    queries = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    found = px.search_graph(spark, str(tmp_path / "g"), queries, 10)
    rows = found.collect()
    assert Counter(r.query_id for r in rows) == {q: 10 for q in range(0, 3000, 20)}
    assert all(abs(r.score - float(unit[r.vec_id].astype(float) @ raw[r.query_id].astype(float))) < 1e-3 for r in rows)
    recall = px.recall(found, ix.dense_top_k(vectors_of(spark, [(i, v.tolist()) for i, v in enumerate(unit)]), queries, 10))
    assert recall.count() == 150 and recall.agg(F.avg("recall")).first()[0] >= 0.9
    assert np.mean([r.scored for r in rows]) < 3000 / 4


def test_graph_of_awkward_vectors(spark, tmp_path):
    """Crowds of equal vectors, unusable and zero vectors, null and repeated ids, two lengths, more queries than a block."""
    nan = float("nan")
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(300)] + [(i, [0.0, 1.0, 0.1 * i]) for i in range(400, 420)]
    rows += [(500, None), (501, []), (502, [nan, 1.0, 0.0]), (503, [1.0, None, 0.0]), (504, [0.0, 0.0, 0.0]), (None, [0.0, 0.0, 1.0]), (7, [1.0, 0.0, 0.5]), (600, [1.0, 1.0])]
    df = vectors_of(spark, rows)
    px.build_graph(df, str(tmp_path / "g"), shard_rows=100)
    held = spark.read.parquet(str(tmp_path / "g")).select(F.explode("ids").alias("i"))
    assert Counter(r.i for r in held.collect()) == Counter(i for i, v in rows if i not in (500, 501, 502, 503))
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.5]), (2, [0.0, 0.0, 2.0]), (3, [0.0, 1.0]), (4, []), (5, [1.0] * 9)], "query_id long, qv array<double>")
    found = px.search_graph(spark, str(tmp_path / "g"), queries, 5).collect()
    mine = {q: [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in range(1, 6)}
    assert mine[1] == [0, 1, 2, 3, 4] and mine[2][0] is None and mine[3] == [600] and mine[4] == mine[5] == []
    px.build_graph(df.limit(0), str(tmp_path / "e"))
    assert px.search_graph(spark, str(tmp_path / "e"), queries, 5).count() == 0


def test_levels_link_every_node_and_stay_bounded():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 6))
    graph = px.Graph.build(v / np.linalg.norm(v, axis=1, keepdims=True), m=6, ef_build=32)
    for i, by_level in enumerate(graph.links):
        assert len(by_level) == graph.level[i] + 1
        for level, near in enumerate(by_level):
            assert len(near) <= (12 if level == 0 else 6) and i not in near and all(graph.level[j] >= level for j in near)
    found = [graph.walk(graph.vectors[i], 20)[0][0][1] == i for i in range(500)]
    assert np.mean(found) > 0.95
    assert px.Graph.build(v[:1]).walk(v[0], 5)[0][0][1] == 0


# --- substrings ----------------------------------------------------------------------------------

TEXTS = [
    (0, 0, "body", "Revenue grew; the revenues of Région-Nord rose"), (0, 1, "table", "| x | revenue |\n| --- | --- |"), (1, 0, "body", None),
    (1, 1, "title", ""), (1, 2, "body", "  \t\n "), (2, 0, "figure", "a ab abc abcd ABCDE"), (2, 1, "body", "an em space　here and\x1cthere"),
    (3, 0, "body", "x" * 5000 + "needle" + "y" * 5000), (3, 1, "body", "日本語のテキスト 🙂🙂"), (40_000, 0, "body", "abc " * 3000), (40_001, 0, "table", "the abc"),
]
TERMS = ["revenue", "RÉGION", "a", "ab", "abc", "abcd", "bcde", "space", "needley", "xn", "本語の", "🙂", "zzz", "abz", "em", "|", "---", "grew;", "missingterm", "nthere"]


def test_substring_index_equals_contains(spark, tmp_path, monkeypatch):
    from docquarry.operators import substring as ss

    frame = spark.createDataFrame(TEXTS, "doc_pos long, region_idx int, type string, text string").withColumn("query_id", F.lit(1))
    index = ss.SubstringIndex(str(tmp_path / "w"), buckets=4)
    ss.build(frame, index)
    terms = spark.createDataFrame([(t.lower(),) for t in [*TERMS, ""]], "term string")
    want = {(t.lower(), d, r, k) for t in TERMS for d, r, k, x in TEXTS if x and t.lower() in x.lower()}
    found = ss.term_units(spark, index, terms)
    rows = [(r.term, r.doc_pos, r.region_idx, r.type) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "text" not in plan
    only = ss.term_units(spark, index, terms, ("table",)).collect()
    assert {(r.term, r.doc_pos, r.region_idx, r.type) for r in only} == {w for w in want if w[3] == "table"}
    monkeypatch.setattr(ss, "LITERALS", 1)
    assert {(r.term, r.doc_pos, r.region_idx, r.type) for r in ss.term_units(spark, index, terms).collect()} == want


def test_two_thousand_queries_from_the_word_index(spark, tmp_path):
    from docquarry.operators import substring as ss

    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdé", k=rng.randrange(1, 7))) for _ in range(150)]
    texts = [(i, 0, "body", " ".join(rng.choices(vocabulary, k=rng.randrange(12)))) for i in range(200)]
    queries = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(4))).upper()) for i in range(2000)]
    index = ss.SubstringIndex(str(tmp_path / "w"))
    ss.build(spark.createDataFrame(texts, "doc_pos long, region_idx int, type string, text string"), index)
    found = {(r.query_id, r.doc_pos): (r.found, r.n_terms) for r in ss.found_terms(spark, index, asked(spark, queries)).collect()}
    want = {}
    for q, query in queries:
        terms = query.lower().split()
        for d, _, _, text in texts:
            n = sum(t in text for t in terms)
            if n:
                want[q, d] = (n, len(terms))
    assert found == want


# --- replaced documents --------------------------------------------------------------------------


def as_units(docs):
    """Two units per document: its halves by line."""
    half = F.posexplode(F.split("text", "\n", 2)).alias("region_idx", "part")
    return docs.select("doc_pos", half).select(F.lit("text").alias("modality"), "doc_pos", "region_idx", F.col("part").alias("text"))


def units_in_force(versions):
    return [((d, i), part) for d, t in versions.items() if t is not None for i, part in enumerate(t.split("\n", 1))]


def test_replaced_and_removed_documents(spark, tmp_path):
    from docquarry.operators import segments as sg

    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    text = lambda: "\n".join(" ".join(rng.choices(words, k=rng.randrange(1, 15))) for _ in range(rng.randrange(1, 3)))
    index, now = sg.index_at(str(tmp_path / "log")), {}
    queries = [(1, "w1 w2 w3"), (2, "w7"), (3, "w0 w0 w39 w12")]
    schema = "doc_pos long, text string, version int"
    for epoch in range(6):
        batch = {d: text() for d in rng.sample(range(60), 25)}
        batch |= {d: now.get(d, text()) for d in rng.sample(range(60), 10)}  # some as they are
        batch |= {d: None for d in rng.sample(range(60), 4)}
        rows = [(d, t, 2) for d, t in batch.items()] + [(d, "w1 w1 old", 1) for d in list(batch)[:5]] + [(None, "w1", 1)]
        frame = spark.createDataFrame(rows, schema)
        for _ in range(2):  # the second does nothing
            sg.apply_epoch(frame, index, epoch, as_units, F.col("version"), fanout=3)
        now |= batch
        units = units_in_force(now)
        stats = sg.live_stats(spark, index, sg.segments(spark, index)[1]).first()
        assert stats.n_units == len(units) and abs(stats.avgdl - np.mean([len(tokens_of(t)) for _, t in units])) < 1e-9
        found = sg.search(spark, index, asked(spark, queries), 50).collect()
        alive = {q: {u for u, t in units if set(tokens_of(query)) & set(tokens_of(t))} for q, query in queries}
        for q, _ in queries:
            mine = [(r.doc_pos, r.region_idx) for r in found if r.query_id == q]
            assert len(mine) == len(set(mine)) == min(50, len(alive[q])) and set(mine) <= alive[q]
    version, live = sg.segments(spark, index)
    assert [s["level"] for s in live] != [0] * 6 and version > 6 and [(s["first"], s["last"]) for s in live][-1][1] == 5

    sg.compact(spark, index)
    _, live = sg.segments(spark, index)
    assert len(live) == 1 and sg.dead_units(spark, index, live).count() == 0
    sg.vacuum(spark, index)
    batch = sp.SparseIndex(str(tmp_path / "batch"), ("doc_pos", "region_idx"), ("modality",))
    sp.write_segment(as_units(spark.createDataFrame([(d, t) for d, t in now.items() if t is not None], "doc_pos long, text string")), batch)
    columns = ["modality", "term", "doc_pos", "region_idx", "tf", "dl"]
    rows = [sorted(map(tuple, b.select("modality", "term", F.inline("docs")).select(columns).collect()), key=str)
            for b in (sp.read_blocks(spark, index), sp.read_blocks(spark, batch))]
    assert rows[0] == rows[1]
    ends = [sorted(map(tuple, r.select("query_id", "rank", "doc_pos", "region_idx", "score").collect()))
            for r in (sg.search(spark, index, asked(spark, queries), 10), sp.search(spark, batch, asked(spark, queries), 10))]
    assert ends[0] == ends[1]


def test_an_epoch_that_broke_off_is_applied_again(spark, tmp_path, monkeypatch):
    from docquarry.operators import segments as sg

    index = sg.index_at(str(tmp_path / "log"))
    frame = lambda rows: spark.createDataFrame(rows, "doc_pos long, text string")
    sg.apply_epoch(frame([(1, None), (2, None)]), index, 0, as_units)  # nothing to hold yet
    assert sg.search(spark, index, asked(spark, [(1, "alpha")])).count() == 0
    sg.apply_epoch(frame([(1, "alpha beta"), (2, "beta")]), index, 1, as_units)
    with monkeypatch.context() as broken:
        broken.setattr(sg, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            sg.apply_epoch(frame([(1, "gamma"), (3, "alpha")]), index, 2, as_units)
    hits = lambda: {(r.doc_pos, r.query_id) for r in sg.search(spark, index, asked(spark, [(1, "alpha"), (2, "gamma")])).collect()}
    assert hits() == {(1, 1)}
    sg.apply_epoch(frame([(1, "gamma"), (3, "alpha")]), index, 2, as_units)
    assert hits() == {(1, 2), (3, 1)}


# --- event time, counts and sequences ------------------------------------------------------------


def test_windows_go_on_after_a_restart_and_drop_what_is_too_late(spark, tmp_path):
    from datetime import datetime, timedelta

    from docquarry.streaming import ingest as si
    from docquarry.streaming import windows as sw

    start = datetime(2024, 1, 1)
    rng = random.Random(2)
    rows = [(start + timedelta(seconds=rng.randrange(6 * 3600)), rng.choice("ab"), rng.randrange(1000) / 100) for _ in range(300)]
    rows.sort()
    parts = [[r for i, r in enumerate(rows) if i < 150 and i % 9], [r for i, r in enumerate(rows) if i >= 150 or not i % 9]]
    schema = "ts timestamp, k string, value double"
    kinds = {"tumbling": sw.tumbling("1 hour"), "sliding": sw.sliding("1 hour", "20 minutes"), "session": sw.session("5 minutes")}
    for name, window in kinds.items():
        source, out, state = (str(tmp_path / f"{name}-{x}") for x in ("src", "out", "state"))
        beat = [(start + timedelta(days=9), None, None)]
        for i, part in enumerate([*parts, beat, [(start, "a", 5.0)], [(start + timedelta(days=30), None, None)]]):
            spark.createDataFrame(part, schema).write.mode("append").parquet(source)
            stream = si.document_stream(spark, source, schema)
            sw.start_windows(sw.windowed(stream, window, ["k"], "6 hours"), out, state, once=True).awaitTermination()
            if i == 0:
                assert spark.read.parquet(out).count() == 0
        batch = sw.windowed(spark.createDataFrame(rows, schema), window, ["k"])
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))


def test_observed_counts_come_from_the_run(spark, tmp_path):
    from docquarry.sources.observed import ObservedRun

    run = ObservedRun(spark)
    rows = run.stage(spark.range(1000), "read", F.col("id") % 10 == 0)
    kept = run.stage(rows.filter("id % 2 = 0"), "kept")
    with pytest.raises(ValueError):
        run.stage(kept, "read")
    assert run.run(lambda: kept.write.parquet(str(tmp_path / "x"))) is None
    found = {r.stage: r for r in run.metrics().collect()}
    assert (found["read"].rows, found["read"].failures, found["kept"].rows, found["kept"].failures) == (1000, 100, 500, 0)
    assert found["read"].seconds > 0 and abs(found["read"].rows_per_second - 1000 / found["read"].seconds) < 1e-6


def test_rouge_l_equals_the_table_of_prefixes(spark):
    from docquarry.operators import evaluate as ev

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
        return row[-1]

    rng = random.Random(3)
    cases = [("", ""), (None, "a"), ("a", None), ("The cat SAT", "the cat sat"), ("a b c", "x y"), ("x " * 3000, "x " * 2000)]
    cases += [(" ".join(rng.choices("abcdefg", k=rng.randrange(150))), " ".join(rng.choices("abcdefg", k=rng.randrange(150)))) for _ in range(60)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, pred string, truth string")
    found = {r.i: (r.lcs, r.rouge_l) for r in ev.rouge_l(frame, ["i"]).collect()}
    for i, (a, b) in enumerate(cases):
        a, b = (a or "").lower().split(), (b or "").lower().split()
        lcs = plain(a, b) if len(a) < 1000 else min(len(a), len(b))
        assert found[i] == (lcs, round(lcs / max(1, len(b)), 4))


# --- the region store, the cut before fusion, and tables of cells --------------------------------


def test_store_gives_the_hits_of_a_scan(spark, tmp_path):
    from docquarry.operators import retrieve as rv
    from docquarry.operators import store as st
    from docquarry.plans import inputs as I

    regions = I.regions(spark, "/root/testdata/sf0.001").filter("doc_pos < 60")
    store = st.RegionStore(str(tmp_path / "store"))
    st.write_store(regions, store)
    queries = [*I.QUERY_SET, (11, ""), (12, "item item revenue figure"), (13, "TOTAL assets of ε")]
    for options in ({}, {"use_sql": False}, {"route_all": True}):
        want = rv.region_hits(regions, queries, **options)
        found = st.hits(spark, store, queries, **options)
        rows = [sorted((tuple(x if not isinstance(x, float) else round(x, 12) for x in r) for r in df.select(want.columns).collect()), key=str) for df in (want, found)]
        assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("k", [1, 3, 8])
def test_cut_before_fusion_changes_no_row(spark, monkeypatch, k):
    from dataclasses import replace

    from docquarry.config import EngineConfig
    from docquarry.plans import hybrid as hy
    from docquarry.plans import inputs as I

    regions = I.regions(spark, "/root/testdata/sf0.001").filter("doc_pos < 80")
    config = EngineConfig()
    config = replace(config, reranker=replace(config.reranker, final_top_k=k))
    hits = hy.written_hits(regions, I.QUERY_SET, config)
    kept = hy.reachable(hits, config, True).count()
    runs = []
    for whole in (False, True):
        if whole:
            monkeypatch.setattr(hy, "reachable", lambda hits, *_: hits)
        both = (hy.hybrid_retrieve(regions, I.QUERY_SET, config, hits), hy.query_service(regions, I.QUERY_SET, config))
        runs.append([sorted(map(tuple, df.select("query_id", "rank", "item_id", "modality", "score", "rank_score").collect())) for df in both])
    assert runs[0] == runs[1] and runs[0][0] and kept < hits.count()


def test_tables_of_cells(spark):
    import json

    from docquarry.operators import tables as tb

    kind = "t int, text string, grid array<array<string>>, cells array<struct<row:int,col:int,row_span:int,col_span:int,column_header:boolean,text:string,bbox:struct<y0:double,x0:double>>>"
    box = lambda y, x: (float(y), float(x))
    segments = [  # header cells out of order on the page, a shared heading, a cell written twice
        (1, 1, 1, 1, True, "Q2 2024", box(20, 200)), (1, 0, 1, 1, True, "Q1 2024", box(20, 100)), (0, 0, 1, 2, True, "Revenue by Segment", box(10, 100)),
        (0, 2, 1, 1, True, "Operating Expenses", box(10, 300)), (1, 2, 1, 1, True, "Total", box(20, 300)), (2, 0, 1, 1, False, "(1,234.50)", None),
        (2, 2, 1, 1, False, "$5,000", None), (3, 1, 1, 1, False, "old", None), (3, 1, 1, 1, False, 'say "hi"', None), (3, 2, 1, 1, False, None, None)]
    rows = [
        (1, "in millions", None, segments),
        (2, None, [["a", "b"], ["x", "1"]], []),
        (3, None, None, []),
        (4, None, [["name", "n"], ["y", "2"], ["z", "3"]], [(0, 0, 1, 1, False, "Name", None), (0, 1, 1, 1, False, "N", None)]),
        (5, None, None, [(5, 0, 1, 1, False, "late", None)]),
        (6, None, [["h"]], None),
    ]
    found = {r.t: r for r in tb.enrich(spark.createDataFrame(rows, kind), cells="cells").collect()}
    assert set(found) == {1, 2, 4, 5, 6}
    one = json.loads(found[1].table_json)
    assert one["columns"] == ["revenue_by_segment_q1_2024", "revenue_by_segment_q2_2024", "operating_expenses_total"]
    assert one["header_paths"] == [["Revenue by Segment", "Q1 2024"], ["Revenue by Segment", "Q2 2024"], ["Operating Expenses", "Total"]]
    assert one["rows"] == [[-1234.5, "", 5000], ["", 'say "hi"', ""]] and one["unit_multiplier"] == 1_000_000 and one["is_valid_structure"] is True
    assert found[1].rows == [["-1234.5", "", "5000"], ["", 'say "hi"', ""]] and found[1].table_markdown.startswith("| revenue_by_segment_q1_2024 |")
    assert json.loads(found[2].table_json)["rows"] == [["x", 1]] and found[2].columns == ["a", "b"]
    assert found[4].columns == ["name", "n"] and [len(r) for r in found[4].rows] == [2, 2]
    assert json.loads(found[5].table_json)["rows"] == [[""]] * 4 + [["late"]]  # its first row is the header
    assert found[6].rows == [] and not found[6].is_valid_structure
    plain = tb.enrich(spark.createDataFrame(rows, kind).filter("t = 2")).first()
    assert plain.table_json == found[2].table_json


def test_dense_search_as_matrices_keeps_ties_and_odd_vectors(spark, monkeypatch):
    """Each tile passes on k rows per query; copies, ties, nulls and other lengths rank as by plain sums."""
    monkeypatch.setattr(ix, "TILE_ROWS", 40)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 5)).round(2).tolist()
    rows = [*enumerate(base), *((100 + i, base[i % 3]) for i in range(30)), (200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [1.0, 2.0]), (203, [float("nan")] * 5), (None, base[0])]
    asked = [(i, base[i]) for i in range(0, 60, 7)] + [(900, None), (901, [1.0, 2.0]), (902, [float("inf")] * 5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id long, qv array<double>")

    def score(q, v):
        if q is None or v is None or len(q) != len(v) or None in v:
            return None
        return float(np.rint(sum(a * b for a, b in zip(q, v)) * 1e4) / 1e4)

    def place(row):
        s, i = row
        rank = (2, 0.0) if s is None else (0, 0.0) if np.isnan(s) else (1, -s)
        return rank, i is not None, i or 0

    found = {}
    for r in ix.dense_top_k(vectors, queries, 8).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert len(found) == len(asked)
    for name, q in asked:
        want = sorted(((score(q, v), i) for i, v in rows), key=place)[:8]
        assert repr(found[name]) == repr(want), name
    met = ix._met(vectors.filter("vec_id < 200"), queries.filter("query_id < 900"), "vec_id", "embedding", 4, 40, 90, 9)
    assert ix._best_scores(*met, 2).groupBy("query_id").count().filter("count > 6").count() == 0


def test_scan_of_one_batch_equals_the_index(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["red", "green", "blue", "tin", "oak", "fir", "elm", "the"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:50], None, "", "the of"])]
    docs = spark.createDataFrame(rows, "doc_pos long, text string").repartition(5)
    queries = spark.createDataFrame([(1, "red tin tin"), (2, "oak"), (2, "fir oak"), (3, "nowhere"), (4, ""), (None, "elm"), (5, "the green blue elm")], "query_id long, query string")
    index = sp.SparseIndex(str(tmp_path / "x"), ("doc_pos",), ("modality",))
    sp.write_segment(docs.selectExpr("'text' AS modality", "doc_pos", "text"), index, range_units=32)
    monkeypatch.setattr(sp, "SCAN_UNITS", 16)
    columns = ["query_id", "rank", "doc_pos", "score"]
    for k in (1, 7, 400):
        want = sorted(map(tuple, sp.search(spark, index, queries, k).select(*columns).collect()))
        assert want and sorted(map(tuple, sp.scan(docs, queries, k).select(*columns).collect())) == want
    assert sp.scan(docs.unionByName(docs.limit(1)), queries) is None and sp.scan(docs.selectExpr("nullif(doc_pos, 3) AS doc_pos", "text"), queries) is None
    monkeypatch.setattr(sp, "SCAN_TERMS", 3)
    assert sp.scan(docs, queries) is None


def test_word_index_in_passes_finds_the_same(spark, tmp_path, monkeypatch):
    """Written by blocks of documents and looked up bucket by bucket, each with its shuffle files freed."""
    from docquarry.operators import joins
    from docquarry.operators import substring as ss

    rows = [(None if i == 9 else i % 40 - 3, i, "text" if i % 3 else "table", f"Alpha w{i} beta{i % 7} gamma an") for i in range(60)] + [(2, 99, "text", None)]
    units = spark.createDataFrame(rows, "doc_pos long, region_idx int, type string, text string")
    queries = spark.createDataFrame([(1, "an alpha w1"), (2, "beta3 zzz a"), (3, "mm")], "query_id long, query string")

    def found(name, blocks, limit):
        freed, free = [], ss.freed_shuffles
        monkeypatch.setattr(ss, "BLOCK_BITS", blocks)
        monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(ss, "freed_shuffles", lambda session: freed.append(1) or free(session))
        index = ss.SubstringIndex(f"{tmp_path}/{name}", buckets=4)
        ss.build(units, index)
        out = sorted(map(repr, ss.found_terms(spark, index, queries).collect()))
        words = sorted((r["word"], r["type"], r["doc_pos"], r["region_idx"]) for r in spark.read.parquet(f"{index.path}/words").selectExpr("word", "type", "inline(units)").fillna(-99).collect())
        monkeypatch.setattr(ss, "freed_shuffles", free)
        return out, words, len(freed)

    whole, parts = found("whole", 62, 200_000), found("parts", 2, 5)
    assert whole[:2] == parts[:2] and len(whole[0]) > 100
    assert (whole[2], parts[2]) == (3, 8 + 1 + 4)  # passes over documents, the grams, buckets

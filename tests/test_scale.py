"""Hot keys: one group holds most rows, and results must equal brute force without special cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import attribute as at
from docquarry.operators import benchmark as bm
from docquarry.operators import evaluate as ev
from docquarry.operators import index as ix
from docquarry.operators import ranking
from docquarry.operators import tables as tb
from docquarry.operators import tablesql as ts

random.seed(5)


def test_exact_rank_of_a_hot_group(spark):
    rows = [(0 if random.random() < 0.9 else 1, random.choice([0.5, 0.9, 0.9, 0.9]), p, i) for p in range(900) for i in range(2)]
    df = spark.createDataFrame(rows, "q long, score double, doc_pos long, region_idx int")
    ranked = ranking.exact_rank(df, ["q"], [("score", False)], block_bits=4)
    got = {(r.q, r.doc_pos, r.region_idx): r["rank"] for r in ranked.collect()}
    for q in (0, 1):
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[1], r[2], r[3]))
        assert [got[(r[0], r[2], r[3])] for r in mine] == list(range(1, len(mine) + 1))


def test_top_k_limits_each_partition_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("q"), F.col("id").alias("s"))
    plan = ranking.top_k(df, ["q"], [F.col("s").desc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_evidence_of_one_long_conversation(spark):
    turns = [(0, t, f"t{t}") for t in range(0, 700, 1) if t % 13] + [(1, t, f"u{t}") for t in range(4)]
    df = spark.createDataFrame(turns, "conv long, turn long, text string")
    out = at.preceding_evidence(df, "conv", "turn", F.col("text"), 5, block=16).collect()
    assert len(out) == len(turns)
    texts = {(c, t): x for c, t, x in turns}
    for r in out:
        assert r.evidence == [texts[(r.conv, t)] for t in range(r.turn - 5, r.turn) if (r.conv, t) in texts]


def test_passages_are_found_in_every_holder(spark):
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(random.choices(words, k=random.randint(1, 40))) for _ in range(120)]
    passages = [t[random.randint(0, 5) : random.randint(30, 60)] for t in texts if len(t) > 70][:30]
    passages += [" ".join(t.split()[:4]) for t in texts if len(t.split()) > 6][:20]
    passages = [(i, p) for i, p in enumerate(passages) if len(p.split()) >= 3]
    docs = [(i, t) for i, t in enumerate(texts)] + [(200 + i, texts[0] + " tail") for i in range(60)]
    got = bm.containing_documents(
        spark.createDataFrame(docs, "doc_pos long, text string"), spark.createDataFrame(passages, "query_id long, query string")
    )
    want = {(q, d) for q, p in passages for d, t in docs if p in t}
    assert {(r.query_id, r.doc_pos) for r in got.collect()} == want


def test_credit_goes_to_unseen_ids(spark):
    results = spark.createDataFrame(
        [(1, r, d, "x y") for r, d in enumerate(["ab", "a", "zz", "b", "ab"], 1)], "query_id long, rank int, document_id string, text string"
    )
    qrels = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, rel_id string, rel_pos long")
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    rows = ev.query_rows(queries, results, qrels)
    m = {r.query_id: r for r in ev.retrieval_metrics(rows).collect()}
    # Rank 1 credits a, rank 2 finds a already seen, rank 4 credits b.
    ideal = 1 + 1 / math.log2(3)
    assert m[1].ndcg_at_5 == round((1 + 1 / math.log2(5)) / ideal, 4)
    assert m[1].map_at_10 == round((1 + 2 / 4) / 2, 4)
    assert (m[1].recall_at_5, m[1].precision_at_5, m[1].mrr) == (1.0, 0.8, 1.0)
    assert (m[1].avg_gold_rank, m[1].gold_rank_variance) == (3.0, 2.5)
    assert (m[2].recall_at_5, m[2].ndcg_at_5, m[2].result_count, m[2].avg_gold_rank) == (0.0, 0.0, 0, None)


def test_percentiles_take_the_floor_index(spark):
    values = [round(random.random() * 30, 2) for _ in range(1001)]
    df = spark.createDataFrame([(v,) for v in values], "latency_ms double")
    row = ev.latency_percentiles(df).collect()[0]
    ordered = sorted(values)
    assert (row.latency_p50_ms, row.latency_p90_ms, row.latency_p99_ms) == tuple(ordered[int(1001 * p)] for p in (0.5, 0.9, 0.99))


def test_grid_of_one_huge_table(spark):
    cells = [(7, r, c, 1, 1, r * 10 + c, f"{r}.{c}") for r in range(300) for c in range(5) if (r + c) % 3]
    df = spark.createDataFrame(cells, "t long, row int, col int, row_span int, col_span int, cell_no int, text string")
    got = {r["row"]: r.cells for r in tb.cells_to_grid(df, ["t"]).collect()}
    assert len(got) == 300
    assert all(got[r] == [f"{r}.{c}" if (r + c) % 3 else "" for c in range(5)] for r in range(300))


def test_dense_search_equals_brute_force(spark):
    import numpy as np

    vectors = [(i, [random.uniform(-1, 1) for _ in range(8)]) for i in range(150)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    asked = [(q, [random.uniform(-1, 1) for _ in range(8)]) for q in range(200)]
    rows = ix.dense_top_k(df, spark.createDataFrame(asked, "query_id long, qv array<double>"), 5).orderBy("query_id", "rank").collect()
    for q, query in asked:
        exact = sorted(((round(float(np.dot(np.float32(v).astype(float), query)), 4), i) for i, v in vectors), key=lambda x: (-x[0], x[1]))
        assert [(r.vec_id, r.score) for r in rows if r.query_id == q] == [(i, s) for s, i in exact[:5]]


def test_passages_of_any_length_are_found(spark):
    docs = spark.createDataFrame([(1, "say hello world now"), (2, "another one, hello worlds"), (3, "x"), (4, "a b c d e f g h i j")], "doc_pos long, text string")
    asked = ["hello world", "other", "x", "ne, hel", "b c d", "a b c d e f g h i", "", "  ", "missing", "c d e f g h"]
    passages = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    found = {tuple(r) for r in bm.containing_documents(docs, passages).collect()}
    texts = {r["doc_pos"]: r["text"] for r in docs.collect()}
    assert found == {(i, d) for i, q in enumerate(asked) if q.strip() for d, t in texts.items() if q in t}


def test_column_names_of_long_headers(spark):
    names = ["ab", "cd", "ab", "", "ab", ""] + [f"n{i % 700}" for i in range(4000)]
    found = spark.createDataFrame([(names,)], "names array<string>").select(tb.dedup_columns(F.col("names"))).first()[0]
    seen, want = {}, []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        want.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    assert found == want


def test_statements_that_fail_are_previewed(spark):
    cases = [
        (["a", "A"], [["1", "2"]], "show", "repeated column name", 0.2),
        (["n", "m"], [["x", "9" * 20], ["y", "1"]], "zzz", "number out of range", 0.2),
        (["n", "amount"], [["x", "(1,008)"], ["y", "$5.50"], ["z"], ["w", "N/A", "more"]], "show amount", None, 0.9),
    ]
    frame = spark.createDataFrame([(c[0], c[1], c[2]) for c in cases], "columns array<string>, rows array<array<string>>, query string")
    c = {n: F.col(n) for n in ("columns", "rows", "query")}
    types = ts.infer_types(c["columns"], c["rows"])
    plan = ts.template_plan(c["query"], c["columns"], types)
    error = ts.statement_error(plan, c["columns"], c["rows"], types)
    found = frame.select(error.alias("error"), ts.match_score(c["query"], c["columns"], error.isNotNull()).alias("score"), ts.template_result(plan, c["columns"], c["rows"], types).alias("rows")).collect()
    assert [(r["error"], r["score"]) for r in found] == [(c[3], c[4]) for c in cases]
    assert [dict(x) for x in found[1]["rows"]] == [{"n": "x", "m": "9" * 20}, {"n": "y", "m": "1"}]
    assert [x["amount"] for x in found[2]["rows"]] == ["-1008.00", "5.50", None, None]


def test_cells_are_cleaned_once(spark):
    """A lambda's body evaluates whatever it repeats again, so each step of a cell's typing stands there once."""
    frame = spark.createDataFrame([], "columns array<string>, rows array<array<string>>, v string, t string")
    for value in (ts.infer_types(F.col("columns"), F.col("rows")), ts.sanitize_number(F.col("v"), F.col("t")), ts._out_of_range(F.col("v"), F.col("t"))):
        plan = frame.select(value.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("[,$€£%]") == 1, plan


def test_word_searches_do_not_wait_for_tables(spark, tmp_path, monkeypatch):
    from docquarry.operators import store as st
    from docquarry.plans import retrieval_queries as rq

    rows = [(i, f"Title {i}\n\nthe body and that of {i}\nalpha beta g", "en", "web", 10) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    def fail(*_):
        raise AssertionError("not asked for")

    monkeypatch.setattr(st, "write_tables", fail)
    monkeypatch.setitem(rq._PARTS, "tables", fail)
    assert rq.ret_text_keyword(spark, str(tmp_path)).count() > 0 and rq.idx_word_grams(spark, str(tmp_path)).count() > 0
    monkeypatch.undo()
    assert rq.ret_table_sql(spark, str(tmp_path)).count() > 0


def test_postings_of_a_bucket_are_dealt_on(spark, monkeypatch):
    """The postings of one bucket are sorted and packed by several tasks, with one shuffle, and make the same blocks."""
    from docquarry.operators import sparse as sp

    index = sp.SparseIndex("", ("doc_pos",), buckets=1)
    units = spark.createDataFrame([(i, " ".join(f"word{(i * j) % 50}" for j in range(20))) for i in range(300)], "doc_pos long, text string")
    packed = sp.packed(sp.unit_postings(units, index, range_units=32), index)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = packed.filter("term is not null").select(F.spark_partition_id().alias("p")).distinct().count()
        plan = packed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert tasks > 2 and plan.count("Exchange hashpartitioning(bucket") == 1
    found = packed.groupBy("term", "range").count()
    assert found.filter("count > 1").count() == 0 and packed.agg(F.sum("n")).first()[0] == sp.unit_postings(units, index).count()


def test_one_batch_of_searches_writes_no_word_index(spark, tmp_path, monkeypatch):
    """Queries that fuse the hits of one batch score them in a pass over the regions."""
    from docquarry.operators import store as st
    from docquarry.plans import answer_queries as aq
    from docquarry.plans import inputs as I
    from docquarry.plans import retrieval_queries as rq

    rows = [(i, f"Title {i}\n\nthe body and that of {i}\nalpha beta g\nTable: revenue\n| item | revenue 2024 |\n| --- | --- |\n| a | {i} |", "en", "web", 10) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)

    def fail(*_):
        raise AssertionError("not asked for")

    monkeypatch.setitem(rq._PARTS, "words", fail)
    monkeypatch.setitem(rq._PARTS, "tables", fail)
    queries = (rq.fuse_normalize, rq.fuse_rrf, rq.fuse_late, rq.fuse_batches, rq.hybrid_retrieve, rq.query_service, aq.service_answers)
    assert all(query(spark, sf).count() > 0 for query in queries)
    monkeypatch.undo()
    columns = ["query_id", "doc_pos", "region_idx", "batch", "score", "jaccard"]
    want = st.hits(spark, rq.region_store(spark, sf, "words", "tables"), I.QUERY_SET).select(*columns)
    found = rq._written_hits(spark, sf).select(*columns)
    assert found.count() > 0 and found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


def test_documents_of_one_id_are_one_unit_in_fusion(spark, tmp_path):
    from docquarry.operators import store as st
    from docquarry.plans import inputs as I
    from docquarry.plans import retrieval_queries as rq

    rows = [(i % 3, "Title\n\nthe body and that\nTable: revenue\n| item | revenue 2024 |\n| --- | --- |\n| a | 1 |", "en", "web", 10) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    want = st.hits(spark, rq.region_store(spark, sf, "words", "tables"), I.QUERY_SET)
    found = rq._written_hits(spark, sf).select(*want.columns)
    assert found.count() > 0 and found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


def _box(y, x):
    return {"y0": float(y), "x0": float(x)}


CELL = "struct<row:int,col:int,row_span:int,col_span:int,column_header:boolean,text:string,bbox:struct<y0:double,x0:double>>"


def test_tables_of_cells_are_laid_out_and_read_once(spark):
    """The grid, its heads and the numbers of its cells stand once in the plan, however many forms of the table are asked for."""
    from docquarry.operators import tables as tb

    cells = [
        (3, 0, 1, 1, False, "old", None), (1, 1, 1, 1, True, "B", _box(2, 5)), (1, 0, 1, 1, True, "A", _box(2, 1)), (0, 0, 1, 2, True, "Top", _box(1, 1)),
        (2, 0, 1, 1, False, "(1,5)", _box(0, 9)), (3, 0, 1, 1, False, "x", None), (None, None, 1, 1, False, "lost", None), (2, 3, 1, 1, False, "9.50", None)]
    frame = spark.createDataFrame([(1, "t", None, cells), (2, "t", None, [])], f"t int, text string, grid array<array<string>>, cells array<{CELL}>")
    out = tb.enrich(frame.repartition(2), cells="cells")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[$,€£%]") == 1 and plan.count("array_sort(") == 1 and plan.count("sort_array(") == 3, plan  # two of them order the names
    row = out.collect()
    assert [r.t for r in row] == [1] and row[0].rows == [["-15", "", "", "9.5"], ["x", "", "", ""]]
    assert row[0].header_paths == [["Top", "A"], ["Top", "B"], ["col_3"], ["col_4"]]


def test_grids_are_built_once_for_all_forms_of_a_table(spark, tmp_path):
    """Documents as tables: no second grid for the filter of empty ones, and one reading of each cell."""
    from docquarry.plans import table_queries as tq

    rows = [(1, "a b\n1 (2,30)\n\"q\" <x> & 007 1.50", "en", "web", 10), (2, " ", "en", "web", 1), (3, None, "en", "web", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = tq.tbl_enrich(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1 and plan.count("[$,€£%]") == 1, plan
    (row,) = out.collect()
    assert row.table_html.count("<tr>") == 3 and row.table_json.endswith('"is_valid_structure": false}') and row.doc_id == 1


@pytest.mark.parametrize("text_key", [False, True])
def test_blocks_are_pieces_of_sorted_batches(text_key):
    """Blocks over the ends of batches, blocks whose hashes are equal, nulls, and keys that are no integers."""
    import pyarrow as pa

    from docquarry.operators import sparse as sp

    rng = random.Random(3)
    rows = [(t, f"{'n' if t is None else t}", rng.randint(1, 4), rng.randint(1, 6), (str(i) if text_key else i)) for i, t in enumerate(rng.choice([None, "a", "b", "c", "d"]) for _ in range(200))]
    rows += [("e", "e", 1, 2, None)] * (not text_key)
    number = {"n": -5, "a": 1, "b": 1, "c": 1, "d": 7, "e": 9}  # three blocks share a hash
    rows.sort(key=lambda r: number[r[1]])
    names = ["_hash", "term", "range", "tf", "dl", "key"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string() if text_key else pa.int64()]
    columns = [[number[r[1]] for r in rows], [r[0] for r in rows], [0] * len(rows), *[[r[i] for r in rows] for i in (2, 3, 4)]]
    table = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)
    for size in (1, 7, 500):
        found = [r for b in sp._blocks(iter(table.to_batches(max_chunksize=size)), ["term", "range"], ["key"]) for r in b.to_pylist()]
        assert len(found) == len({r[0] for r in rows})
        for block in found:
            mine = [r for r in rows if r[0] == block["term"]]
            mine.sort(key=lambda r: (r[4] is not None, r[4] or 0), reverse=True)
            mine.sort(key=lambda r: (-r[2], r[3]))
            assert [tuple(d.values()) for d in block["docs"]] == [(r[2], r[3], r[4]) for r in mine]
            assert (block["n"], block["tokens"]) == (len(mine), sum(r[3] for r in mine))
            best = [r for i, r in enumerate(mine) if all(r[3] < o[3] for o in mine[:i])]
            assert [tuple(d.values()) for d in block["impacts"]] == [(r[2], r[3]) for r in best]

"""Cases that a shortened operator gets wrong."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm import linededup, lm, pii, queries, simhash


def test_ip_parts_of_zeros(spark):
    values = ["10.0.0.1", "0.0.0.0", "00.000.0.0", "127.0.0.1", "8.8.8.0", "192.168.0.256", "1.2.3.0256", "000.0.0.0000255"]
    frame = spark.createDataFrame(list(enumerate(f"at {v} now" for v in values)), "doc_id long, text string")
    found = {r["doc_id"]: [s["value"] for s in r["base"]] for r in pii.detect(frame).collect()}
    assert found == {i: [v] if all(int(p) <= 255 for p in v.split(".")) else [] for i, v in enumerate(values)}


def test_terms_anywhere_in_a_document_disclose(spark):
    far = " ".join(["the weather and rain"] * 20)
    filler = [(100 + i, f"the weather number w{i} and rain") for i in range(200)]
    told = [(i, f"Zorblatt wrote {i}a. {far} zed@mail.example.com {far} of zorblatt") for i in range(2)]
    alone = (7, "a page on ZORBLATT without the address")
    once = (8, f"Quandle {far} reads q@mail.example.com")
    frame = spark.createDataFrame([*filler, *told, alone, once], "doc_id long, text string")
    found = {r["doc_id"]: r["terms"] for r in pii.detect(frame).collect()}
    for i, text in [*told, alone]:
        spans = {(s["start"], s["end"]) for s in found[i] if s["value"] == "zorblatt"}
        assert spans == {(m.start(), m.end()) for m in re.finditer("zorblatt", text, re.I)}
        assert not {s["value"] for s in found[i]} & {"the", "weather", "and", "rain", "zed"}
    assert {s["value"] for s in found[8]} == {"quandle", "reads"}
    assert all(found[i] == [] for i, _ in filler)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(frame).collect()}
    assert all("zorblatt" not in clean[i].lower() for i in (0, 1, 7))


def test_rows_are_masked_with_their_own_spans(spark):
    """Rows of one id, or of none, keep no personal data of theirs and lose nothing to another row's spans."""
    rows = [(1, "mail a@b.c now"), (1, "n x@yy.zz"), (None, "n x@yy.zz"), (None, "call +1 (202) 555-0143 or 10.0.0.1"), (1, "mail a@b.c now"), (2, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["text"]) for r in pii.sanitised(frame, remove_terms=True).collect()), key=str)
    base = {(r["doc_id"], r["unit"]): r for r in pii.spans_by_text(frame).collect()}
    assert len(base) == 6
    for (_, text), want in zip(rows, ["[EMAIL]", "[EMAIL]", "[EMAIL]", "[PHONE]", "[EMAIL]"]):
        assert not any(text in (t or "") for _, t in found) and any(want in (t or "") for _, t in found)
    assert not any(x in (t or "") for _, t in found for x in ("@", "555", "0.0"))
    assert len(found) == len(rows) and [t for i, t in found if i == 2] == [None] and (None, "") in found


def test_lm_trains_at_every_position_as_registered(spark):
    texts = [np.arange(n, dtype=np.int32) % 7 for n in (1, 2, 3, 50)]
    net = lm.Network(lm.Vocabulary({}, classes=2, members=8, buckets=2), hidden=3)
    assert sum(len(target) for _, target in lm._batches(iter(texts), net, lm.BATCH, lm.STRIDE)) == 56
    rng = random.Random(2)
    sentence = "one two three four five six seven eight".split()
    rows = [(i, " ".join(sentence * 60) if i < 60 else " ".join(rng.sample(sentence * 60, 480))) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    vocab = lm.vocabulary(frame)
    scores = {r["doc_id"]: r["mean_log_prob"] for r in lm.score(frame, vocab, lm.train(frame, vocab)).collect()}
    assert min(scores[i] for i in range(60)) > max(scores[i] for i in range(60, 80))


def test_lm_tells_rare_words_of_a_bucket_apart(spark):
    seen = {"rareone": 1, "raretwo": 6, "rarefew": 3}
    rows = [(i, f"the one {w} of the two") for i, w in enumerate(w for w, n in seen.items() for _ in range(n))]
    frame = spark.createDataFrame([*rows, (None, "the"), (90, None)], "doc_id long, text string")
    vocab = lm.vocabulary(frame, classes=1, members=5, buckets=1)
    assert set(vocab.ids) == {b"the", b"one", b"of", b"two"}
    net = lm.train(frame, vocab, hidden=4)
    found = {r["doc_id"]: r for r in lm.score(frame, vocab, net).collect()}
    text = dict(rows)
    sums = {text[i].split()[2]: found[i]["log_likelihood"] for i in text}
    assert np.isclose(sums["raretwo"] - sums["rareone"], np.log(6)) and np.isclose(sums["rarefew"] - sums["rareone"], np.log(3))
    ids = vocab.encode(text[0])
    plain = net.log_probs(net.windows(ids), ids).sum()
    assert np.isclose(sums["rareone"], plain + np.log(1 / 10), atol=1e-4)
    assert found[None]["n_tokens"] == 1 and tuple(found[90]) == (90, 0, 0.0, None)


def test_near_documents_match_brute_force_on_jaccard(spark):
    rng = random.Random(9)
    rows, bases = [], [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (30, 300, 1000)]
    for base in bases:
        for changes in (0, 1, 2, 4, 6, 10, 20, 40):
            for wrap in (7, 11):
                words = list(base)
                for at in rng.sample(range(len(words)), min(changes, len(words))):
                    words[at] = f"new{rng.randrange(10**6)}"
                rows.append((len(rows), "\n".join(" ".join(words[k : k + wrap]) for k in range(0, len(words), wrap)), "en", "s", 1))

    def grams(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [grams(t) for _, t, *_ in rows]
    codes = [simhash.fingerprint(t.encode(), 5) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    missed = 0
    for i in range(len(rows)):
        for j in range(i):
            near, bits = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]), (codes[i] ^ codes[j]).bit_count()
            missed += near and bits > 2
            if near or bits <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert missed > 0
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["doc_id"] for r in corpus_pipeline.unique_documents(spark, frame, "").collect()]
    assert sorted(kept) == [i for i in range(len(rows)) if find(i) == i]


def test_lines_of_rows_without_an_id_of_their_own(spark):
    known = "alpha beta gamma delta epsilon"
    rows = [
        (1, known), (None, f"{known}\nown words of the first row here"), (None, "quite another text that is unique\nsecond of it alone"),
        (5, "some row that repeats its id"), (5, f"{known}\nlast row with words nowhere else"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in linededup.deduplicated(frame).collect()]
    cut = lambda t, first: t if first else "\n".join(x for x in t.split("\n") if x != known)
    assert sorted(found, key=str) == sorted([(i, cut(t, i == 1)) for i, t in rows], key=str)
    assert sorted(r["removed"] for r in linededup.removed_lines(frame).collect()) == [[], [], [], [0], [0]]


def test_terms_known_from_copies_only_disclose(spark, tmp_path):
    """The registered query keeps every pair that meets the threshold, also where one text's copies alone hold it."""
    filler = [(100 + i, f"the weather number w{i} and rain") for i in range(60)]
    copies = [(50 + i, "same page by Quill q@mail.example.com") for i in range(5)]
    frame = spark.createDataFrame([*filler, *copies], "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["spans"] for r in queries.op8_pii(spark, str(tmp_path)).collect()}
    assert all(found[i] == "term:0:4,term:5:9,term:13:18,email:19:37" for i in range(50, 55))
    assert all(found[i] == "" for i, _ in filler)


def test_lm_holds_few_rows_of_a_batch(spark, monkeypatch):
    """A batch is scored in slices bounded by rows and bytes, in order; sums do not depend on them."""
    texts = ["a b", None, "", "c " * 40, "d e f", "g", "h i"] * 3
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    monkeypatch.setattr(lm, "SLICE_ROWS", 4)
    monkeypatch.setattr(lm, "SLICE_BYTES", 20)
    parts = list(lm._slices(batch))
    assert [i for p in parts for i in p["doc_id"].to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= 4 for p in parts) and all(p.num_rows == 1 or sum(len(x or "") for x in p["text"].to_pylist()) <= 20 for p in parts)
    assert not list(lm._slices(batch.slice(0, 0)))
    vocab = lm.Vocabulary({b"a": 0, b"c": 1, b"d": 2}, classes=2, members=4, buckets=2)
    assert all(list(vocab.encode_with_rare(t)[0]) == list(vocab.encode(t)) and vocab.rare(t) == Counter(w.encode() for w in (t or "").split() if w not in "acd") for t in texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    net = lm.Network(vocab, hidden=3)
    runs = []
    for rows in (1, 1000):
        monkeypatch.setattr(lm, "SLICE_ROWS", rows)
        monkeypatch.setattr(lm, "SLICE_BYTES", 1 << 20)
        runs.append({r["doc_id"]: (r["n_tokens"], r["log_likelihood"]) for r in lm.score(frame, vocab, net).collect()})
    assert len(runs[0]) == len(texts) and all(runs[0][i][0] == n and np.isclose(runs[0][i][1], x) for i, (n, x) in runs[1].items())


def _words_of(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_alike_links_all_similar_texts_and_builds_few_whole_sets(spark, monkeypatch):
    """Texts that share some shingles only are told apart by their prefixes; links connect what brute force connects."""
    rng = random.Random(5)
    common, rows = _words_of(rng, 12), []
    for base in (_words_of(rng, rng.randrange(60, 200)) for _ in range(12)):
        for changes in (0, 1, 1, 2, 4, 6):  # a chain of copies around the likeness
            base = list(base)
            for _ in range(changes):
                base[rng.randrange(len(base))] = f"n{rng.randrange(10**6)}"
            rows.append(base)
    rows += [common + _words_of(rng, rng.randrange(60, 120)) for _ in range(80)]
    rows += [["Same"] * 9, ["same"] * 30, [], ["a", "b"]]
    texts = [" ".join(r) for r in rows]
    sets = [{s for part in simhash.shingles(t.encode(), 5) for s in part.tolist()} for t in texts]
    codes = [simhash._signed(simhash.fingerprint(t.encode(), 5)) for t in texts]
    links = [
        (codes[i], codes[j]) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and ((codes[i] ^ codes[j]) & (1 << 64) - 1).bit_count() > 2
    ]
    built, write = [], simhash.saved

    def counted(df):
        result = write(df)
        if result.columns == ["row", "hashes"]:
            built.append(result.count())
        return result

    monkeypatch.setattr(simhash, "saved", counted)
    frame = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    found = [tuple(r) for r in simhash.alike(frame, 0.8, size=5).collect()]

    def parts(pairs):
        root = {}
        for a, b in pairs:
            for x in (a, b):
                root.setdefault(x, x)
            old, new = root[a], root[b]
            root = {x: new if r == old else r for x, r in root.items()}
        return {frozenset(x for x, r in root.items() if r == one) for one in root.values()}

    assert parts(found) == parts(links) and len(links) > 20
    assert {frozenset(p) for p in found} <= {frozenset(p) for p in links}
    assert max(built) <= 80  # of 156 texts; those that share 8 of their shingles need no whole set


def test_terms_of_a_long_text_with_an_entity_take_linear_time(spark):
    """Words that run into an entity are no terms; 40,000 words beside one entity take seconds."""
    rows = [(0, "éa@b.com wort"), (1, "wort a@b.é a@b.comé end"), (2, "abc\n1.2.3.4abc def"), (3, "x@y.com,+49 30 1234567890 tel"), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", pii.entities(F.col("text")).alias("base"))
    found = {r[0]: r[1] for r in frame.select("doc_id", pii._terms(F.col("text"), F.col("base"))).collect()}
    assert found == {0: ["wort"], 1: ["wort", "end"], 2: ["abc", "def"], 3: ["tel"], 4: []}
    words = " ".join("abcdefghij"[i % 7 :] + "xyz"[i % 3 :] + chr(97 + i % 26) for i in range(40_000))
    long = spark.createDataFrame([(0, f"{words} a@b.com {words}")], "doc_id long, text string").select("text", pii.entities(F.col("text")).alias("base"))
    start = time.monotonic()
    assert long.select(F.size(pii._terms(F.col("text"), F.col("base")))).first()[0] > 100
    assert time.monotonic() - start < 8


def test_pairs_of_common_terms_are_left_out_before_their_shuffle(spark, monkeypatch):
    """A term of more documents than any pair over the threshold can have is not counted beside each entity; pairs are those of brute force."""
    rng = random.Random(2)
    rows = [(i, f"alpha beta word{rng.randrange(40)} only{i} " + (f"user{i % 9}@mail.com" if i % 3 else "")) for i in range(200)]
    written, write = [], pii.saved

    def kept(df):
        result = write(df)
        written.append(result)
        return result

    monkeypatch.setattr(pii, "saved", kept)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: {s["value"].lower() for s in r["terms"]} for r in pii.detect(frame, copies=True).collect()}
    held = {i: {w for w in t.split() if "@" not in w} for i, t in rows}
    held = {i: {"".join(c for c in w if c.isalpha()) for w in ws} for i, ws in held.items()}
    n, pairs = len(rows), set()
    docs_of = {e: [i for i, t in rows if t.endswith(e)] for e in {t.split()[-1] for _, t in rows if "@" in t}}
    for e, docs in docs_of.items():
        for t in set().union(*held.values()):
            n_te, n_t = sum(t in held[i] for i in docs), sum(t in ws for ws in held.values())
            if n_te and math.log2(n_te * n / (n_t * len(docs))) >= 0.9 * math.log2(n / len(docs)):
                pairs.add(t)
    assert found == {i: ws & pairs for i, ws in held.items()}
    joint = next(w for w in written if "n_te" in w.columns)
    assert joint.filter("term IN ('alpha', 'beta')").isEmpty()


def test_crowds_and_common_shingles_make_few_pairs(spark, monkeypatch):
    """Copies of one text, and texts with a common passage, meet in proportion to their number; links stay those of brute force."""
    rng = random.Random(6)
    base, passage = _words_of(rng, 120), _words_of(rng, 40)
    rows = []
    for i in range(120):  # each over 2 bits from most others, yet alike
        words = list(base)
        for at in rng.sample(range(0, 120, 10), 1):
            words[at] = f"n{i}"
        rows.append(words)
    rows += [passage + _words_of(rng, 60) for _ in range(120)]
    rows += [rows[0][:100] + _words_of(rng, 20), rows[1][5:]]
    texts = [" ".join(r) for r in rows]
    sets = [{s for part in simhash.shingles(t.encode(), 5) for s in part.tolist()} for t in texts]
    alike = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(alike) > 5000
    paired, write = [], simhash.saved

    def counted(df):
        result = write(df)
        if {"x", "y"} <= set(result.columns):
            paired.append(result.count())
        return result

    monkeypatch.setattr(simhash, "saved", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = {r["doc_id"]: r["component_id"] for r in simhash.classes(frame, size=5, likeness=0.8).collect()}
    root = list(range(len(texts)))
    codes = [simhash.fingerprint(t.encode(), 5) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (i, j) in alike or (codes[i] ^ codes[j]).bit_count() <= 2:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert found == dict(enumerate(root))
    assert max(paired) <= 2 * len(texts)


def test_lm_joins_counts_of_few_words(spark, monkeypatch):
    """Counts of frequent words outside the vocabulary are held by the tasks; sums are those of a join of all of them."""
    texts = [f"a b {' '.join(f'r{(i * k) % 11}' for k in range(6))} only{i}" for i in range(30)] + [None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocab = lm.Vocabulary({b"a": 0, b"b": 1}, classes=2, members=4, buckets=3)
    net, runs, written, write = lm.Network(vocab, hidden=3), [], [], lm.saved

    def counted(df):
        result = write(df)
        if "rare" in result.columns:
            written.append(result.select(F.explode("rare")).count())
        return result

    monkeypatch.setattr(lm, "saved", counted)
    for most in (0, 4, lm.FREQUENT):
        monkeypatch.setattr(lm, "FREQUENT", most)
        runs.append({r["doc_id"]: (r["n_tokens"], r["log_likelihood"]) for r in lm.score(frame, vocab, net).collect()})
    assert written[0] > written[1] > written[2] == 30
    counts = Counter(w for t in texts for w in (t or "").split())
    totals = Counter()
    for w, n in counts.items():
        totals[int(vocab.encode(w)[0])] += n if w not in "ab" else 0
    for run in runs:
        for i, t in enumerate(texts):
            ids = vocab.encode(t)
            want = net.log_probs(net.windows(ids), ids).sum() + sum(math.log(counts[w] / totals[vocab.encode(w)[0]]) for w in (t or "").split() if w not in "ab")
            assert run[i][0] == len(ids) and np.isclose(run[i][1], want, rtol=1e-5)


def test_lm_steps_match_the_plain_ones(spark):
    """A step and scores of a whole batch at once are those of one class at a time, also for scores out of a float's range."""
    rng = np.random.default_rng(4)
    vocab = lm.Vocabulary({}, classes=4, members=8, buckets=32)
    for scale in (1, 400):
        net, squares = lm.Network(vocab, 5, seed=3), lm.Network(vocab, 5, np.full(lm.Network(vocab, 5).flat.size, 1e-6, np.float32))
        net.flat *= scale
        context, target = rng.integers(0, 33, (4, 300)), rng.integers(0, 24, 300)
        h = np.tanh(net.b + sum(net.ctx[k, context[k]] for k in range(4))).astype(np.float64)
        soft = lambda z: np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)
        p, n = soft(h @ net.cls + net.cb), np.arange(300)
        q = soft(np.einsum("nh,nhm->nm", h, net.out[target // 8]) + net.ob[target // 8])
        assert np.allclose(net.log_probs(context, target), np.log(p[n, target // 8] + 1e-30) + np.log(q[n, target % 8] + 1e-30), rtol=1e-3, atol=1e-4)
        p[n, target // 8] -= 1
        want = h.T @ p / 300
        before = net.cls.copy()
        net.train(context, target, squares)
        assert np.allclose(before - net.cls, lm.RATE * want / (np.sqrt(1e-6 + want**2) + 1e-6), atol=2e-3 * scale)
        assert np.isfinite(net.flat).all() and (net.out[3] == lm.Network(vocab, 5, seed=3).out[3] * np.float32(scale)).all()

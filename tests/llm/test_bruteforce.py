"""Operators and the pipeline against brute force, round trips and held-out rows on the smallest tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from docquarry.llm import bpe, embedding, linededup, lm, pii, queries, simhash, toxicity
from docquarry.llm.common import table

SF = "/root/testdata/sf0.001"
TRICKY = [
    "", " ", "a", "  lead", "don't we'll I'M", "tab\t\tnew\n\n line \r\n end ", "<|endoftext|>x<|endoftext|><|endoftext|> y",
    "ÀÉÎ õü ß", "日本語 テキスト", "🙂🙂 family 👨‍👩‍👧", "a" * 3000, "ab" * 2000, "é" * 500, "x y z\u0085w\x1cq", "١٢٣ ½ Ⅷ", "_-_ !!! ???", "‍﻿\x00\x01",
]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(queries.vocabulary())
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def coded(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    back = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_bpe_matches_library(spark, tokenizer, texts):
    rng = random.Random(3)
    noise = ["".join(rng.choice("ab \n.'é1日 🙂") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate([*TRICKY, *noise, *list(texts.values())[:60]])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip(frame, queries.vocabulary()).collect()}
    assert found == {i: coded(tokenizer, t) for i, t in rows}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(frame, queries.vocabulary()), queries.vocabulary()).collect()}
    assert back == dict(rows)


def simhash_of(text, size):
    w = words(text)
    if not w:
        return 0
    codes = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def test_simhash_matches_brute_force(spark, texts):
    codes = {i: simhash_of(t, 3) for i, t in texts.items()}
    ids = sorted(codes)
    groups = union_find(ids, ((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (codes[a] ^ codes[b]).bit_count() <= 2))
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash(spark, SF).collect()}
    assert found == {i: (f"{codes[i]:016x}", groups[i]) for i in ids}


def test_crowded_shard_is_split_without_losing_links(spark):
    rng = random.Random(5)
    codes = sorted({rng.getrandbits(12) << 3 for _ in range(400)})
    frame = spark.createDataFrame([(c,) for c in codes], "code long")
    found = simhash.links(frame, 2, shard_rows=16).collect()
    near = [(a, b) for k, a in enumerate(codes) for b in codes[k + 1 :] if (a ^ b).bit_count() <= 2]
    assert {(min(r), max(r)) for r in map(tuple, found)} <= set(near)
    assert union_find(codes, map(tuple, found)) == union_find(codes, near)


@pytest.mark.parametrize(("dim", "threshold", "tile"), [(64, 0.95, 64), (10, 0.9, 32), (3, 0.99, 2048)])
def test_embeddings_match_brute_force(spark, dim, threshold, tile):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(12, dim))
    x = np.concatenate([rng.normal(size=(150, dim)), np.repeat(centres, 15, 0) + rng.normal(size=(180, dim)) * 0.2, np.repeat(centres[:2], 20, 0)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.near_duplicates(frame, threshold, tile=tile).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    groups = union_find(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(np.triu(near, 1))])
    assert found == {i: (int(near[i].sum()) - 1, groups[i]) for i in range(len(x))}


@pytest.mark.parametrize("whole", [True, False])
def test_embedding_passes_are_bounded_and_find_all(spark, monkeypatch, whole):
    """Both ways to join, in many passes of few rows, and each pass frees its shuffle files; crowded cells are gone through several times."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=24)
    x = np.concatenate([rng.normal(size=(150, 24)), centre + rng.normal(size=(120, 24)) * 0.12])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen, kept, freed = [], embedding._passes, embedding.freed_shuffles
    monkeypatch.setattr(embedding, "PASS_TIMES", 1)
    monkeypatch.setattr(embedding, "PASS_ROWS", 300)
    monkeypatch.setattr(embedding, "ROW_COST", 1e9)
    monkeypatch.setattr(embedding, "WHOLE_TILES", 8 if whole else 10**6)  # so many tiles cost more than any grid
    monkeypatch.setattr(embedding, "WHOLE_ROWS", 1)

    def passes(sizes, limit):
        seen.append((limit, {r["dim"]: r["block"] for r in sizes.collect()}, sizes.selectExpr("sum(rows * tiles)").first()[0], kept(sizes, limit)))
        return seen[-1][3]

    monkeypatch.setattr(embedding, "_passes", passes)
    monkeypatch.setattr(embedding, "freed_shuffles", lambda session: seen.append(None) or freed(session))
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.near_duplicates(frame, 0.95, tile=32).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    groups = union_find(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(np.triu(near, 1))])
    assert near.sum() > len(x) * 5 and found == {i: (int(near[i].sum()) - 1, groups[i]) for i in range(len(x))}
    limit, blocks, moved, parts = seen[0]
    assert limit == 300 and moved > 5 * limit and len(parts) >= moved / limit and seen.count(None) == len(parts)
    assert any(times > 1 for _, times, _ in parts) and (set(blocks.values()) == {0}) == whole
    for picked, times, _ in parts:
        assert sum(p[0] == picked and p[1] == times for p in parts) == times


def lines_gone(texts):
    """Lines that an earlier line matches: every pair of word sets is compared."""
    places = [(i, n, frozenset(words(s.lower()))) for i, t in sorted(texts.items()) if t is not None for n, s in enumerate(t.split("\n"))]
    seen, sizes, gone = set(), defaultdict(list), defaultdict(list)
    for i, n, s in places:
        if not s:
            continue
        near = s in seen or any(len(s & o) * 10 >= 8 * len(s | o) for k in range(math.ceil(0.8 * len(s)), int(len(s) / 0.8) + 1) for o in sizes[k])
        if s not in seen:
            seen.add(s)
            sizes[len(s)].append(s)
        if near:
            gone[i].append(n)
    return gone


def test_lines_match_brute_force(spark, texts):
    gone = lines_gone(texts)
    found = {r["doc_id"]: r["removed"] for r in linededup.removed_lines(table(spark, SF, "documents")).collect()}
    assert found == {i: gone[i] for i in texts}


def test_crowd_of_line_variants(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(30)]
    crowd = [" ".join([*rng.sample(base, 30 - k), *(f"n{rng.randrange(40)}" for _ in range(k))]) for k in (rng.randrange(5) for _ in range(120))]
    rows = dict(enumerate(crowd))
    found = {r["doc_id"]: r["removed"] for r in linededup.removed_lines(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    gone = lines_gone(rows)
    assert found == {i: gone[i] for i in rows}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fits:
                out.append((m.start(), rank, m.end(), m[0]))
    return sorted(out)


def test_entities_match_plain_patterns(spark, texts):
    rng = random.Random(4)
    noise = ["".join(rng.choice("ab_.@@-+ 0159()é🙂") for _ in range(rng.randrange(80))) for _ in range(400)]
    cards = ["4111 1111 1111 1111", "x4111-1111-1111-1111,", "4111111111111112", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "001.2.3.255 1.2.3.256", "+1 (234) 567-8901)", "a" * 20000 + "@", "1 " * 9000]
    rows = list(enumerate([*cards, *noise, *texts.values(), None]))
    found = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: base_spans(t) for i, t in rows}


def test_terms_that_disclose(spark):
    filler = [(100 + i, f"the weather number w{i} and rain") for i in range(60)]
    told = [(i, f"note {i}x about Zorblatt at zed@mail.example.com and the rest") for i in range(4)]
    copies = [(50 + i, "same page by Quill q@mail.example.com") for i in range(5)]
    frame = spark.createDataFrame([*filler, *told, *copies], "doc_id long, text string")
    found = {r["doc_id"]: [s["value"] for s in r["terms"]] for r in pii.detect(frame).collect()}
    assert all("zorblatt" in found[i] and "the" not in found[i] and "and" not in found[i] for i in range(4))
    assert all(found[i] == [] for i in [*range(50, 55), *range(100, 160)])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(frame).collect()}
    assert "[EMAIL]" in clean[0] and "zed@" not in clean[0] and "[TERM]" in clean[0]


def test_language_held_out(spark):
    found = queries.op9_language(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.97 * len(found) > 0


def test_toxicity_held_out_and_places(spark):
    bad = ["vilex", "grotz", "snarb"]
    rng = random.Random(6)
    rows = []
    for i in range(500):
        parts = [" ".join(f"w{rng.randrange(300)}" for _ in range(8)) for _ in range(rng.randrange(3, 9))]
        toxic = i % 4 == 0
        if toxic:
            parts[rng.randrange(len(parts))] += f" {rng.choice(bad)} end"
        rows.append((i, ". ".join(parts) + ".", int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(frame, frame.filter("doc_id % 5 <> 0"))
    found = {r["doc_id"]: r for r in toxicity.detect(frame, model).collect()}
    for i, text, toxic in rows:
        assert found[i]["predicted"] == toxic
        places = [text[s["start"] : s["end"]] for s in found[i]["offending"]]
        assert len(places) == toxic and all(any(b in p for b in bad) for p in places)


def test_toxicity_gradient_is_that_of_noisy_or():
    texts, labels = ["a b. c d", "c d. e f", "a c. b"] * 20, [1, 0, 1] * 20
    model = toxicity.fit(texts, labels, min_docs=1)
    value = toxicity.score("a b. c d", model)[0]
    z = [model.bias + sum(model.weights.get(w, 0.0) for w in s) for s in ({"a", "b"}, {"c", "d"})]
    assert value == pytest.approx(1 - np.prod([1 - 1 / (1 + math.exp(-x)) for x in z]))
    assert toxicity.score("e f", model)[0] < 0.5 < value


def test_network_probabilities_sum_to_one_and_gradient():
    vocab = lm.Vocabulary({}, classes=3, members=4, buckets=12)
    net = lm.Network(vocab, hidden=5)
    context = np.tile(np.array([[1], [2], [3], [lm.Network(vocab, 5).pad]]), (1, 12))
    assert np.exp(net.log_probs(context, np.arange(12))).sum() == pytest.approx(1, abs=1e-5)
    target, before = np.full(12, 7), net.log_probs(context, np.full(12, 7)).mean()
    for _ in range(20):
        net.train(context, target, lm.Network(vocab, 5, np.full(len(net.flat), 1e-6, np.float32)), 0.01)
    assert net.log_probs(context, target).mean() > before


def test_lm_prefers_text_in_order(spark):
    rng = random.Random(2)
    sentence = "one two three four five six seven eight".split()
    rows = [(i, " ".join(sentence * 6) if i < 60 else " ".join(rng.sample(sentence * 6, 48))) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = lm.vocabulary(frame, classes=4, members=8, buckets=4)
    scores = {r["doc_id"]: r["mean_log_prob"] for r in lm.score(frame, vocab, lm.train(frame, vocab, hidden=8, stride=1, rounds=3)).collect()}
    assert min(scores[i] for i in range(60)) > max(scores[i] for i in range(60, 80))


def mixed(docs):
    """``doc_id -> copies`` of a mix: water-filling and the seeded cut, one source at a time."""
    sized = {i: (s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), hashlib.md5(f"{i}:7".encode()).hexdigest()) for i, t, s in docs}
    sums = Counter()
    for s, n, _ in sized.values():
        sums[s] += n
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    total, target, free = 1.5 * sum(sums.values()), {}, set(names)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 2 * sums[s]}
        if not over:
            break
        target |= {s: 2.0 * sums[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    out = {}
    for s in names:
        whole = int(target[s] // sums[s]) if sums[s] else 0
        rest, seen = target[s] - whole * sums[s], 0
        for i in sorted((i for i in sized if sized[i][0] == s), key=lambda i: sized[i][2]):
            out[i] = whole + (rest > 0 and seen + sized[i][1] / 2 <= rest)
            seen += sized[i][1]
    return out


def test_pipeline_matches_brute_force(spark, tokenizer):
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in table(spark, SF, "documents").collect()}
    docs = {i: d for i, d in docs.items() if any(c.isalpha() for c in d[0] or "")}
    gone = lines_gone({i: t for i, (t, _) in docs.items()})
    docs = {i: ("\n".join(x for n, x in enumerate(t.split("\n")) if n not in set(gone[i])), s) for i, (t, s) in docs.items()}
    codes = {i: simhash_of(t, 5) for i, (t, _) in docs.items()}
    ids = sorted(codes)
    groups = union_find(ids, ((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (codes[a] ^ codes[b]).bit_count() <= 2))
    docs = {i: d for i, d in docs.items() if groups[i] == i}
    copies = mixed([(i, t, s) for i, (t, s) in docs.items()])
    want = Counter((i, *coded(tokenizer, docs[i][0])) for i in docs for _ in range(copies[i]))
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing", "BPE"]

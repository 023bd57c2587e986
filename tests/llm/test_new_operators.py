"""Spelling variants, divergence audit and nearest neighbours against plain Python, and their edges."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from fleetgauge.llm import byte_tokens, divergence, neighbours, quality_model, spelling, toxicity, trie

SF = "/root/testdata/sf0.01"


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return len(longer) == len(shorter) + 1 and any(longer[:k] + longer[k + 1 :] == shorter for k in range(len(longer)))


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc", bytes([97, 223, 255])])
def test_trie_finds_all_words_within_one_edit(alphabet):
    draw = random.Random(len(alphabet))
    words = sorted({bytes(draw.choice(alphabet) for _ in range(draw.randint(1, 7))) for _ in range(300)} | {alphabet[:1] * 60, alphabet[:1] * 61})
    asked = words + [alphabet[:1] * 59, b"zz", bytes(reversed(alphabet)) * 2]
    for cut in (len(words), 7):
        got = []
        for lo in range(0, len(words), cut):
            shard = words[lo : lo + cut]
            built = trie.Trie.build(shard)
            for part, chars, size in trie.blocks_of(asked):
                row, word = trie.near(built, chars, size)
                got += [(part[a], shard[b]) for a, b in zip(row, word, strict=True)]
        assert len(got) == len(set(got))
        assert set(got) == {(k, b) for k, a in enumerate(asked) for b in words if apart_by_one(a, b)}


def slow_variants(rows, noise=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    near = defaultdict(list)
    by_cut = defaultdict(set)
    for w in n:
        for x in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}:
            by_cut[x].add(w)
    for together in by_cut.values():
        for a in together:
            near[a] += [b for b in together if b not in near[a] and apart_by_one(a, b)]
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize(("size", "round_bytes"), [(1 << 18, 1 << 25), (200, 20_000)])
def test_spelling_variants(spark, size, round_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in spelling.variants(docs, size, round_bytes).collect()]
    expected = slow_variants([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert len(got) == len(set(got)) and set(got) == expected


def test_spelling_chains_and_edges(spark, edge_docs, no_docs):
    texts = [(1, "abcdefg " * 2000 + "abcdefgh " * 200 + "abcdefghi " * 20 + "abcdefghij " * 2), (1, "ABCDEFG ÀBCDEFG×÷"), (None, "zzzzzzz zzzzzzy"), (2, None), (3, ""), (4, "q" * 50_000), (4, "q" * 50_000)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS form")
    got = {tuple(r) for r in spelling.variants(rows, noise=1 << 40).collect()}
    assert got == slow_variants(texts, 1 << 40)
    assert {r[0]: r[2] for r in got}["abcdefghij"] == "abcdefg"
    assert {tuple(r) for r in spelling.variants(edge_docs).collect()} == slow_variants([(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    assert spelling.variants(no_docs).count() == 0


def slow_audit(rows, top=200):
    groups, counts, docs = set(), Counter(), Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    found = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for x, t in docs if x == lang and docs[x, t] >= 3)
        sources = sorted(s for x, s in groups if x == lang)

        def chances(n, kept=kept):
            total = sum(n) + len(kept)
            return [1 + 10**9 * (k + 1) // total for k in n]

        of = {s: [counts[lang, s, t] for t in kept] for s in sources}
        p = {s: chances(n) for s, n in of.items()}
        whole = chances([sum(of[s][k] for s in sources) for k in range(len(kept))])
        for s in sources:
            pairs = [(sum((x - y) ** 2 // y for x, y in zip(p[s], p[o], strict=True)), o) for o in sources if o != s]
            terms = [((x - y) ** 2 // y, t) for x, y, t, n in zip(p[s], whole, kept, of[s], strict=True) if n and x > y]
            for part, listed in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(listed, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        found.add((lang, s, part, item, value, rank))
    return found


@pytest.mark.parametrize(("block", "slice_"), [(200_000, 64), (300, 3)])
def test_divergence(spark, block, slice_):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    got = [tuple(r) for r in divergence.audit(docs, block=block, slice_=slice_).collect()]
    expected = slow_audit([(r["text"], r["lang"], r["source"]) for r in docs.collect()])
    assert len(got) == len(set(got)) and set(got) == expected


def test_divergence_edges(spark, edge_docs, no_docs):
    assert divergence.audit(no_docs).count() == 0
    rows = [r for r in edge_docs.select("text", "lang", "source").collect()]
    assert {tuple(r) for r in divergence.audit(edge_docs).collect()} == slow_audit([tuple(r) for r in rows])
    alike = [("a b c", "xx", s) for s in "pqr"] + [("K Kk", "xx", "p"), (None, "yy", "p"), (None, "yy", "q"), ("a b", None, None)]
    docs = spark.createDataFrame(alike, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "3 AS block")
    assert {tuple(r) for r in divergence.audit(docs).collect()} == slow_audit(alike)


def test_large_counts_stay_exact():
    of = np.array([8 * 10**15, 3, 10**12 + 7])
    n = np.array([7 * 10**15 + 123, 1, 10**12])
    assert divergence.probability(n, of).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, of, strict=True)]


def test_byte_terms():
    texts = ["Ab-c é×x", "", "yz", "yZ9", " \U0001f600 K"]
    data = [t.encode() for t in texts]
    flat = byte_tokens.lowered(np.frombuffer(b"".join(data), np.uint8))
    start, stop, text = byte_tokens.boundaries(flat, np.cumsum([len(x) for x in data]))
    got = [(int(k), flat[a:b].tobytes().decode()) for a, b, k in zip(start, stop, text, strict=True)]
    assert got == [(0, "ab"), (0, "c"), (0, "é×x"), (2, "yz"), (3, "yz"), (4, "\U0001f600"), (4, "k")]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    data = np.frombuffer(b"one two six one eleven two", np.uint8)
    start, stop, _ = byte_tokens.boundaries(data, np.array([len(data)]))
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x: len(x))
    first, group = byte_tokens.group_slices(data, start, stop)
    words = [data[a:b].tobytes() for a, b in zip(start, stop, strict=True)]
    assert [words[first[g]] for g in group] == words and len(first) == 4


def product(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += float(x) * float(y)
    return total


def slow_neighbours(rows, top=20):
    vectors = {k: np.array(v) for k, v in rows}
    found = {}
    for q in vectors:
        if q % 20 == 0:
            scored = sorted((-product(vectors[q], v), k) for k, v in vectors.items() if k != q)
            found[q] = [(k, -s) for s, k in scored[:top]]
    return found


def recall(got, expected):
    return sum(len({x[0] for x in got[q]} & {x[0] for x in e}) for q, e in expected.items()) / max(1, sum(map(len, expected.values())))


def by_query(df):
    found = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = by_query(neighbours.search(rows))
    expected = slow_neighbours([(r["vec_id"], r["embedding"]) for r in rows.collect()])
    assert got.keys() == expected.keys() and all(len(x) == 20 for x in got.values())
    assert recall(got, expected) >= 0.9
    exact = {(q, k): s for q, e in expected.items() for k, s in e}
    assert all(s == exact[q, k] for q, e in got.items() for k, s in e if (q, k) in exact)


def test_neighbours_of_unequal_length_and_skewed_lists(spark):
    rng = np.random.default_rng(3)
    vectors = np.r_[rng.normal(size=(900, 24)) * rng.lognormal(0, 1, (900, 1)), np.tile(rng.normal(size=24), (600, 1)), 5 + rng.normal(size=(600, 24)) * 0.01]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got, expected = by_query(neighbours.search(rows)), slow_neighbours([(k, v.tolist()) for k, v in enumerate(vectors)])
    assert recall({q: [(round(s, 9),) for _, s in e] for q, e in got.items()}, {q: [(round(s, 9),) for _, s in e] for q, e in expected.items()}) >= 0.9


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(20, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 0.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, []), (9, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (40, [0.0, 2.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [3.0, 0.0, 0.0])]
    rows = spark.createDataFrame(odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS list", "2 AS x", "3 AS bound")
    assert dict(by_query(neighbours.search(rows))) == {20: [(1, 1.0), (2, 1.0), (40, 0.0)], 40: [(1, 0.0), (2, 0.0), (20, 0.0)]}
    assert neighbours.search(rows.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    assert neighbours.search(rows.limit(0)).count() == 0 and neighbours.search(rows.where("vec_id < 20")).count() == 0
    assert neighbours.search(rows.where("vec_id = 20")).count() == 0


def test_abandoned_candidates_are_beyond_the_bound():
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(50, 64)), rng.normal(size=(400, 64))
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    apart = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    bounds = np.sort(apart, axis=1)[:, 19]
    row, col = neighbours.scan(q @ turn, bounds, x @ turn, np.zeros((50, 400), bool), 20)
    kept = set(zip(row.tolist(), col.tolist(), strict=True))
    wanted = set(zip(*np.nonzero(apart <= bounds[:, None]), strict=True))
    assert all(apart[p] <= bounds[p[0]] * (1 + 1e-6) for p in kept)
    assert len(wanted & kept) >= 0.97 * len(wanted)


def test_batches_are_cut_by_size(spark):
    texts = pa.table({"lang": ["a", "b"], "source": ["p", "q"], "text": [b"one two two", b"\xff\xfe three"]}).to_batches()[0]
    found = divergence._counted(texts)
    assert sorted(zip(found["lang"].to_pylist(), found["n"].to_pylist(), found["n_docs"].to_pylist(), strict=True)) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 1), ("b", 0, 0), ("b", 1, 1), ("b", 1, 1)]


def test_training_samples_are_bounded_by_rows(spark, monkeypatch):
    rows = [(k, f"the valve of test {k} was opened " * 3) for k in range(30)] + [(3, "the same id again " * 5)] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, 20).count() <= 20
    seen = []
    fit = quality_model.fit_scorer
    monkeypatch.setattr(quality_model, "fit_scorer", lambda train: seen.append(train.count()) or fit(train))
    assert quality_model.classify(docs, sample=10).count() == len(rows)
    assert all(n <= 10 for n in seen)

"""Joins, repeats, embeddings, language model."""

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from diamondlap.llm import embedding_dedup, graph, lm_score, ngram_join, segments, suffix_dedup, text

VOCAB = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("ba", "de", "fi", "go", "hu", "zo", "é")]


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def edited(base, seed, edits):
    rnd, w = random.Random(seed), base.split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(999)}"
    return " ".join(w)


# --- words and shingles ------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab É.,\n_9", max_size=30), min_size=1, max_size=6))
def test_words_and_shingles_equal_plain_python(texts):
    hashes, bounds = text.word_hashes([t.encode() for t in texts])
    marks, at = text.shingles(hashes, bounds)
    own = [brute.words(t) for t in texts]
    assert list(np.diff(bounds)) == [len(w) for w in own]
    flat = [w for ws in own for w in ws]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    sets = [brute.shingles(t) for t in texts]
    flat = [s for ss in sets for s in ss]
    assert list(np.diff(at)) == [len(s) for s in sets]
    assert len(set(zip(flat, marks.tolist()))) == len(set(flat)) == len(set(marks.tolist()))


# --- components and groups ---------------------------------------------------

def test_components_of_chains_stars_and_rings(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "node bigint, root bigint")).collect()}
    want = brute.roots({n for e in edges for n in e}, edges)
    assert got == want
    assert graph.components(spark.createDataFrame([], "node bigint, root bigint")).count() == 0


def test_dealt_groups_compare_every_pair_once(spark):
    rows = spark.createDataFrame([(k % 2, n, 1) for k in range(2) for n in range(100 * k, 100 * k + 37)] + [(5, 999, 1)], "key bigint, node bigint, weight bigint")
    for limit in (5, 100):
        out = graph.join_within(rows, "key", limit, lambda r: np.ones((r.num_rows, r.num_rows), bool)).collect()
        links, low = Counter(), {}
        for r in out:
            links[r["node"]] += r["links"]
            low[r["node"]] = min(low.get(r["node"], 10**9), r["root"])
        assert len(links) == 74 and set(links.values()) == {36}
        assert low[36] == 0 and low[136] == 100


# --- n-gram join -------------------------------------------------------------

def join_cases():
    texts = {}
    for k in range(12):
        base = prose(k, 60 + 10 * k)
        for j in range(6):
            texts[100 * k + j] = edited(base, 100 * k + j, j // 2)
    common = prose(77, 40)
    texts |= {5000 + k: common + " " + prose(5000 + k, 50) for k in range(40)}  # a passage that many share
    texts |= {6000: None, 6001: "", 6002: "... !!", 6003: "one", 6004: "One!", 6005: "a b c d", 6006: "a b c d e", 6007: "A, b. c d", 6008: "x " * 3000, 6009: "x " * 4000}
    return texts


def test_join_equals_brute_force(spark, docs, monkeypatch):
    texts = join_cases()
    frame = docs(list(texts.items()), ("class_id string", "own"))
    want = brute.join({d: t for d, t in texts.items()})
    for limit in (ngram_join.CLUSTER, 3):
        monkeypatch.setattr(ngram_join, "CLUSTER", limit)
        monkeypatch.setattr(ngram_join, "BRANCH", 4 if limit == 3 else 2048)
        got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngram_join.join_similar(frame).collect()}
        assert got == want


def test_one_document_of_each_class_stays(docs):
    texts = join_cases()
    rows = list(texts.items()) + [(0, texts[0]), (0, texts[0]), (None, texts[0]), (None, "alone without id"), (9000, prose(9000, 30)), (9000, prose(9000, 30))]
    frame = docs(rows, ("class_id string", "own"))
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    root = {d: r for d, (_, r) in brute.join(texts).items()}
    want = [(d, t) for d, t in texts.items() if root[d] == d] + [(None, texts[0]), (None, "alone without id"), (9000, prose(9000, 30))]
    assert got == sorted(want, key=str)


def test_join_of_an_empty_table(docs):
    assert ngram_join.join_similar(docs([])).count() == 0 and ngram_join.keep_one(docs([])).count() == 0


def test_prefix_gets_shorter_as_recall_asks():
    lengths = [ngram_join.prefix_length(recall=r) for r in (0.5, 0.95, 0.999, 0.9999999)]
    assert lengths == sorted(lengths, reverse=True) and lengths[0] == ngram_join.PATH and lengths[-1] < 3
    p = ngram_join.prefix_length()
    assert 1 - (1 - 0.8**p) ** ngram_join.TREES >= ngram_join.RECALL


# --- repeated byte strings ---------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=120), st.integers(1, 20))
def test_suffix_array_marks_what_repeats(s, length):
    raw = s.encode()
    if not raw:
        return
    array = suffix_dedup.SuffixArray(np.frombuffer(raw, np.uint8), length)
    keys = [raw[i : i + length] for i in array.order]
    padded = [k + bytes(length - len(k)) for k in keys]
    assert padded == sorted(padded)
    common = array.common(stride=7)
    for a, b in zip(array.order, array.order[1:]):
        n = 0
        while n < length and a + n < len(raw) and b + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert min(common[b], len(raw) - max(a, b)) == n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=60), min_size=1, max_size=4), st.integers(4, 12))
def test_segments_hold_every_window_once_and_equal_windows_share_owner_and_place(raws, length):
    found = segments.segments(raws, length, gram=3)
    seen = {}
    for t, first, windows, owner in zip(found.text, found.first, found.windows, found.owner):
        for i in range(first, first + windows):
            assert (t, i) not in seen
            seen[t, i] = owner
    assert set(seen) == {(t, i) for t, r in enumerate(raws) for i in range(len(r) - length + 1)}
    by_string = {}
    for (t, i), owner in seen.items():
        assert by_string.setdefault(raws[t][i : i + length], owner) == owner


def test_long_texts_are_cut_with_overlap():
    raw = np.random.default_rng(2).integers(97, 100, segments.CHUNK + 5000).astype(np.uint8).tobytes()
    found = segments.segments([b"short", raw, b""], 200)
    assert set(found.text) == {1} and found.windows.sum() == len(raw) - 199
    assert list(found.first + found.windows) == sorted(found.first + found.windows)


def repeat_cases():
    passage, line = prose(1, 90), "the very common line of all texts, not long enough"
    texts = {k: prose(100 + k, 30) + line + prose(200 + k, 30) for k in range(30)}
    texts |= {100 + k: prose(300 + k, 20) + passage[k : len(passage) - 3 * k] + prose(400 + k, 20) for k in range(25)}
    texts |= {200: None, 201: "", 202: "a" * 199, 203: "a" * 200, 204: "b" * 201, 205: "xyz" * 300, 206: passage + passage, 207: prose(5, 80), 208: prose(5, 80), 209: "é" * 150}
    return texts


@pytest.mark.parametrize("shard", [suffix_dedup.SHARD, 4])
def test_repeats_equal_brute_force(docs, shard):
    texts = repeat_cases()
    rows = list(texts.items()) + [(300, prose(9, 60)), (300, prose(9, 60)), (None, prose(8, 60))]
    frame = docs(rows, ("starts string", "own"))
    want = sorted(
        ((d, len((t or "").encode()), gone, runs, hashlib.sha256(kept).hexdigest())
         for (d, t), (kept, gone, runs) in zip(rows, brute.repeated([(t or "").encode() for _, t in rows], 200))), key=str,
    )
    got = sorted((tuple(r) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(frame, shard=shard)).collect()), key=str)
    assert got == want


def test_repeats_of_short_strings_and_of_nothing(docs):
    rows = [(k, "".join(random.Random(k).choice("ab") for _ in range(80))) for k in range(12)]
    want = {d: (gone, runs, hashlib.sha256(kept).hexdigest()) for (d, _), (kept, gone, runs) in zip(rows, brute.repeated([t.encode() for _, t in rows], 9))}
    found = suffix_dedup.digests(suffix_dedup.remove_repeats(docs(rows), length=9, gram=4, shard=3))
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found.collect()} == want
    assert suffix_dedup.digests(suffix_dedup.remove_repeats(docs([]))).count() == 0


# --- embeddings --------------------------------------------------------------

def vector_cases(dim=24):
    rnd = np.random.default_rng(4)
    out, n = {}, 0
    for _ in range(40):
        center = rnd.standard_normal(dim)
        for _ in range(8):
            out[n] = [float(x) for x in (center + rnd.standard_normal(dim) * rnd.choice([0.1, 0.3, 0.5])).astype(np.float32)]
            n += 1
    out |= {1000 + k: out[0] for k in range(30)}  # copies
    out |= {2000: [2 * x for x in out[0]], 2001: [-x for x in out[0]], 2002: None, 2003: [], 2004: [0.0] * dim, 2005: [math.nan] + out[1][1:],
            2006: [None] + out[1][1:], 2007: [math.inf] + out[1][1:], 2008: out[2][:5], 2009: out[2][:5], 2010: [1e-30] * dim, 2011: [1e30] * dim}
    return out


def test_vectors_equal_brute_force(spark, monkeypatch):
    vectors = vector_cases()
    frame = spark.createDataFrame([(k, v, "own") for k, v in vectors.items()], "vec_id bigint, embedding array<float>, kept string")
    want = brute.cosine_links(vectors)
    for group in (embedding_dedup.GROUP, 5):
        monkeypatch.setattr(embedding_dedup, "GROUP", group)
        rows = embedding_dedup.link_vectors(frame, recall=1 - 1e-9).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_vectors_recall_and_no_false_link(spark):
    vectors = vector_cases()
    frame = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>")
    want = brute.cosine_links(vectors)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.link_vectors(frame).collect()}
    assert all(got[k] <= want[k][0] for k in got)
    assert sum(got.values()) >= 0.95 * sum(n for n, _ in want.values())


def test_vectors_without_ids_and_none_at_all(spark):
    schema = "vec_id bigint, embedding array<float>"
    rows = embedding_dedup.link_vectors(spark.createDataFrame([(None, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (None, None)], schema)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(None, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (None, 0, None, True)], key=str)
    assert embedding_dedup.link_vectors(spark.createDataFrame([], schema)).count() == 0


def test_signs_and_tables_follow_the_number_of_classes():
    few, many = embedding_dedup.tables_and_signs(10_000), embedding_dedup.tables_and_signs(10_000_000)
    assert many[1] == few[1] + 10 and many[0] > few[0]
    for tables, signs in (few, many):
        assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** signs) ** tables >= embedding_dedup.RECALL


# --- language model ----------------------------------------------------------

def check_scores(texts, rows):
    own = brute.token_counts(texts)
    counts = Counter(t for d in texts if d is None or zlib.crc32(str(d).encode()) % 7 != 2 for t in own[d])
    total, distinct = sum(counts.values()), len(counts)
    for r in rows:
        mine = own[r["doc_id"]]
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(mine), sum(counts[t] > 0 for t in mine), total)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in mine)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r["score"] <= 0 and math.isfinite(r["score"])


def test_base_counts_equal_brute_force_and_the_model_is_better(table, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 500)  # most tokens go through the join
    texts = {r["doc_id"]: r["text"] for r in table("documents").collect()}
    rows = lm_score.score_texts(table("documents")).collect()
    assert len(rows) == len(texts)
    check_scores(texts, rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_odd_texts(docs):
    texts = {1: None, 2: "", 3: " \t\x0b", 4: "ÀB\xa0c AB\x1cc", None: "null id", 5: "word " * 60_000, 6: "word"}
    frame = docs(list(texts.items()), ("token string", "own"))
    rows = lm_score.score_texts(frame).collect()
    check_scores(texts, rows)
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {1: 1, 2: 1, 3: 1, 4: 3, None: 3, 5: 60_001, 6: 2}
    assert lm_score.score_texts(docs([])).count() == 0


def test_probabilities_sum_to_one_over_classes_and_tokens():
    known = lm_score.Vocabulary(
        np.array([5, 9], np.uint64), np.array([3, 1]), np.array([0, 1]), np.ones(lm_score.SURFACES, np.int64),
        np.log10(np.array([3 + 1 + 1.0, 1 + 1 + 1.0] + [1.0] * (lm_score.CLASSES - 2))), 4, 2,
    )
    weights = np.random.default_rng(1).standard_normal((lm_score.FEATURES, lm_score.CLASSES)).astype(np.float32)
    p = lm_score.probabilities(weights, np.array([[1, 2, 3, 4], [5, 6, 7, 8]]))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    seen = 10 ** (np.log10(known.counts + 1.0) - known.log_total[known.classes])  # each known token, then one unknown
    assert seen[0] + 10 ** -known.log_total[0] == pytest.approx(1) and seen[1] + 10 ** -known.log_total[1] == pytest.approx(1)


def test_grouped_sums():
    rnd = np.random.default_rng(6)
    rows = np.sort(rnd.zipf(1.3, 2000).clip(max=300))
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    times = np.diff(np.append(first, len(rows)))
    values, order = rnd.standard_normal((700, 5)).astype(np.float32), rnd.integers(0, 700, 2000)
    want = [values[order[a : a + n]].sum(axis=0) for a, n in zip(first, times)]
    assert np.allclose(lm_score.grouped_sums(values, order, first, times), want, atol=1e-4)


def test_lookup_finds_exactly_its_keys():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64)) << np.uint64(1)
    lookup = lm_score.Lookup(keys)
    assert (lookup.find(keys) == np.arange(len(keys))).all()
    assert (lookup.find(keys + np.uint64(1)) == -1).all()
    assert (lm_score.Lookup(keys[:0]).find(keys) == -1).all()

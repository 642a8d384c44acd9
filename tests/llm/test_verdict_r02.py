"""Cases of the second verdict: long candidates, clashing names, text ids, rows without ids, the forest's recall."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from diamondlap.llm import decontamination, embedding_dedup, graph, lm_score, ngram_join, secret_scan

LONG = {
    "directories": "A1" + "/a" * 500_000 + "/", "x": "x" * 1_000_000, "dashes": "a-" * 10_000, "hex": "f0" * 10_000,
    "access": "AKIA" + "A7" * 10_000, "assign": "token=" + "a/" * 10_000, "quotes": "secret = '" * 500, "random": "aB1+x9Zq" * 3 + "k3Vt0Rw7pLm2",
}


def test_patterns_stand_long_repetition(docs):
    rows = [(k, t) for k, t in enumerate(LONG.values())] + [(99, None)]
    got = {r["doc_id"]: r for r in secret_scan.scan(docs(rows)).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, t in rows[:-1]:
        want = Counter(kind for _, kind, _ in brute.base_spans(t))
        assert (got[k]["n_assign"], got[k]["n_access"], got[k]["n_hex"]) == (want[0], want[1], want[2])


def test_directories_are_matched_as_before(docs):
    """Two or more directories of small letters, a slash behind the last; what follows stays."""
    key = "9fKx82LmQz7TnB4vR1pWc3Yd"
    rows = [(0, f"/ab/cd/{key}"), (1, f"/ab/{key}"), (2, f"/ab/cd/ef{key}"), (3, "/ab/cd/ef/gh/ij/kl/mn/op/qr")]
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs(rows)).collect()}
    assert spans[0] == "entropy_base64:7:31" and spans[3] == ""
    assert all(spans[k] for k in (1, 2))


def test_helper_columns_do_not_clash(docs):
    frame = docs([(1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (3, "token=abcdef12")])
    for name in ("_id", "_copy_key", "_key", "_row", "_secret_spans", "_spans_assign", "__secret_spans_assign", "keep", "node", "text_key"):
        frame = frame.withColumn(name, F.lit("own"))
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    masked = secret_scan.redact(frame)
    assert masked.columns == frame.columns and {r["text"] for r in masked.collect() if r["doc_id"] == 3} == {"[SECRET]"}


def test_items_with_text_ids(spark, docs):
    text = " ".join(f"w{k}" for k in range(30))
    items = spark.createDataFrame([("first", text), ("second", "quite another text of some words that occurs nowhere at all")], "item_id string, text string")
    found = decontamination.find_leaks(docs([(1, f"before {text} behind"), (2, "nothing here")]), items).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(1, "first")]


def test_five_thousand_rows_without_id(docs):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    base = [" ".join(rnd.choice(words) for _ in range(40)) for _ in range(2500)]
    rows = [(None, t) for t in base] + [(None, t + " more") for t in base]  # each has one near copy
    got = ngram_join.join_similar(docs(rows))
    assert got.count() == 5000 and {r["n_links"] for r in got.collect()} == {1}
    assert ngram_join.keep_one(docs(rows)).count() == 2500


def near_pairs(seed, pairs, words=120):
    """Pairs of texts, the second with some words of the first changed, and their exact similarity."""
    rnd, out = random.Random(seed), []
    vocabulary = [f"v{k}" for k in range(50_000)]
    for _ in range(pairs):
        first = [rnd.choice(vocabulary) for _ in range(words)]
        second = list(first)
        for place in rnd.sample(range(words), rnd.randint(1, 3)):
            second[place] = rnd.choice(vocabulary)
        a, b = set(brute.shingles(" ".join(first))), set(brute.shingles(" ".join(second)))
        out.append((" ".join(first), " ".join(second), len(a & b) / len(a | b)))
    return out


def test_recall_at_the_threshold_and_above(docs):
    pairs = near_pairs(3, 1500)
    rows = [(2 * k + side, p[side]) for k, p in enumerate(pairs) for side in (0, 1)]
    links = {r["doc_id"]: r["n_links"] for r in ngram_join.join_similar(docs(rows)).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        own = [links[2 * k] for k, p in enumerate(pairs) if low <= p[2] < high]
        assert not own or sum(own) / len(own) >= 0.995
    assert all(links[2 * k] == 0 for k, p in enumerate(pairs) if p[2] < 0.8)


def test_prefixes_are_shortened_until_the_recall_is_reached():
    def tree(depth, sizes):
        return {"depth": depth, "keys": list(range(100 * depth, 100 * depth + 5)), "sizes": sizes + [None] * (5 - len(sizes))}

    assert ngram_join.shortened([tree(6, [9, 8, 7, 6])], 0.8, 0.9995) == []  # the eleven other trees do
    all_hot = [tree(6, [50 - k, 40 - k, 30 - k, 20 - k, 10 - k]) for k in range(ngram_join.TREES)]
    opened = ngram_join.shortened(all_hot, 0.8, 0.9995)
    assert opened
    depth = [6] * ngram_join.TREES
    for key in opened:
        assert key % 100 < 4  # shorter than before


def test_a_hot_branch_is_opened_where_recall_needs_it(docs, monkeypatch):
    """Every branch is over the limit, so all prefixes are lengthened first and shortened again."""
    monkeypatch.setattr(ngram_join, "BRANCH", 3)
    rnd = random.Random(5)
    base = [rnd.choice(["a", "b", "c", "d", "e"]) + str(rnd.randrange(60)) for _ in range(150)]
    texts = {}
    for k in range(60):
        own = list(base)
        for place in rnd.sample(range(150), rnd.randint(0, 4)):
            own[place] = f"x{k}"
        texts[k] = " ".join(own)
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngram_join.join_similar(docs(list(texts.items()))).collect()}
    assert got == brute.join(texts)


def test_hot_keys_are_joined_like_all_others(spark, monkeypatch):
    rows = spark.range(5000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    found = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = graph.join_spread(rows, found, "k", F.col("n") > 1000)
    assert got.count() == 5000 and {(r["n"], r["count"]) for r in got.groupBy("n").count().collect()} == {(2501, 2501), (1, 2499)}


def test_sketches_let_no_near_pair_pass_by():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 64))
    y = x + rng.standard_normal((4000, 64)) * 0.45
    cosine = (x * y).sum(axis=1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    planes = rng.standard_normal((64, embedding_dedup.SKETCH))
    apart = ((x @ planes > 0) != (y @ planes > 0)).sum(axis=1)
    assert (apart[cosine >= 0.9] <= embedding_dedup.most_apart()).all() and (cosine >= 0.9).sum() > 1000


def test_forward_pass_by_hand():
    """Class probabilities of every position, from given weights, with plain Python."""
    rng = np.random.default_rng(2)
    weights = rng.standard_normal((lm_score.FEATURES, lm_score.CLASSES)).astype(np.float32)
    hashes, _, bounds = lm_score.tokens([b"one two three two one", b"", b"two"])
    rows = lm_score.features(hashes, bounds)
    got = lm_score.probabilities(weights, rows)
    for own, p in zip(rows.tolist(), got):
        x = [sum(float(weights[r][c]) for r in own) + float(weights[0][c]) for c in range(lm_score.CLASSES)]
        total = sum(math.exp(v) for v in x)
        assert p == pytest.approx([math.exp(v) / total for v in x], rel=1e-4)


def language_by_hand(text, profiles):
    """Rank-order profile of a text against the learned ones by out-of-place distance."""
    from diamondlap.llm import language_id

    counts = Counter(int(g) for g in language_id.grams(text.encode()))
    own = [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][: language_id.PROFILE]
    return {lang: sum(abs(k - p.index(g)) if g in p else language_id.PROFILE for k, g in enumerate(own)) for lang, p in profiles.items()}, len(own)


def test_language_of_every_document_by_hand(table):
    from diamondlap.llm import language_id

    frame = table("documents")
    learned = frame.where(~F.coalesce(language_id.remainder("doc_id", 4) == 2, F.lit(False)))
    profiles = {k: [int(g) for g in v] for k, v in language_id.learn(learned).items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(frame).collect()}
    checked = 0
    for r in frame.collect():
        lang, score = got[r["doc_id"]]
        if lang == "und":
            assert score == 0 and not any(c.isalpha() for c in r["text"] or "")
            continue
        far, size = language_by_hand(r["text"], profiles)
        assert far[lang] == min(far.values()) and score == pytest.approx(1 - far[lang] / (language_id.PROFILE * size))
        checked += 1
    assert checked > 150

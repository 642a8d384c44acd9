"""Exact dedup, prefix trie and whitening against brute force, and their corner cases."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from check import connect, rows_of
from diamondlap.llm import exact_dedup, prefix_trie, whitening
from diamondlap.llm.queries import ORACLE, QUERIES

TALK = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_exact_dedup"])
def test_query_equals_its_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = connect(sf_dir).execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


# exact dedup

def brute_repeats(docs):
    groups = defaultdict(list)
    for place, (doc_id, text) in enumerate(docs):
        body = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        groups[hashlib.sha256(body.encode()).hexdigest()].append((doc_id is not None, doc_id or 0, place, doc_id))
    out = []
    for sha, rows in groups.items():
        best = max(r[:2] for r in rows)
        out += [(d, best[1] if best[0] else None, len(rows), sha) for _, _, _, d in rows]
    return sorted(out, key=str), {sha for sha in groups}


DOCS = [(5, "Abc"), (2, "aBC"), (9, "abc"), (9, "abc"), (1, None), (3, ""), (None, "x"), (None, "X"), (4, "É"), (6, "é"), (7, "long " * 300_000), (8, "LONG " * 300_000), (8, "y")]


@pytest.mark.parametrize("history", [None, "true", "false", "doc_id % 2 = 0"])
def test_repeats_by_brute_force(spark, docs, history):
    df = docs(DOCS)
    got = exact_dedup.find_repeats(df, None if history is None else F.expr(history), shard=2).collect()
    want, groups = brute_repeats(DOCS)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == want
    kept = [r for r in got if r.kept]
    assert {r.text_sha256 for r in kept} == groups and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in kept)
    if history in ("true", "false"):
        assert {r.member for r in got} == {history == "true"}


def test_hot_text_and_many_shards(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("t"), F.col("id") % 9000)).alias("text"))
    got = exact_dedup.find_repeats(df, shard=512)
    assert got.count() == 30_000
    hot = got.where(F.col("text_sha256") == hashlib.sha256(b"hot").hexdigest()).agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(hot) == (10_000, 29_997, 29_997, 1)
    assert got.groupBy("text_sha256").agg(F.sum(F.col("kept").cast("int")).alias("k"), F.max("doc_id").alias("m"), F.max("keep_id").alias("i")).where("k != 1 or m != i").isEmpty()


def test_empty_table_and_clashing_names(spark, docs):
    assert exact_dedup.find_repeats(docs([])).count() == 0
    df = docs(DOCS).selectExpr("*", "1 AS digest", "2 AS `count`", "3 AS row", "4 AS old", "5 AS shard")
    kept = exact_dedup.drop_repeats(df, shard=2)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 4, 6, 8, 8, 9]
    words = docs([(1, "a"), (2, "b")]).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert exact_dedup.find_repeats(words).count() == 2


def test_perfect_hash_is_minimal_and_rejects_others():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    levels, slots = exact_dedup.perfect_hash(exact_dedup._words(keys))
    assert sorted(slots) == list(range(5000))
    assert (exact_dedup.look_up(levels, exact_dedup._words(keys)) == slots).all()
    with pytest.raises(ValueError):
        exact_dedup.perfect_hash(exact_dedup._words(keys[:1] * 2))


# prefix trie

def brute_trie(rows, shared=True):
    talks = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            talks[c].append(((t is not None, t or 0), role or "", text or ""))
    talks = {c: [(r, x) for _, r, x in sorted(t, key=lambda v: v[0])] for c, t in talks.items()}
    paths = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6 if shared else 0
        paths[c] = tuple(talks.get(c - c % 100, [])[:h] + own[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                kids[p[: d - 1]].add(p[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, m in members.items():
        ended = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def talk_rows(seed, convs=150, longest=40):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        n = int(rng.integers(0, longest)) if c % 5 else longest
        shared = int(rng.integers(0, n + 1))
        for t in range(n):
            rows.append((c, t, ("user", "assistant", None)[t % 3], "same" * (t % 4) if t < shared else str(rng.integers(0, 3))))
    return rows


@pytest.mark.parametrize("single,group_bytes,group_rows", [(8, 1 << 25, 16), (2, 0, 1), (1, 4000, 2), (64, 1, 1)])
def test_trie_by_brute_force_whatever_the_windows(spark, single, group_bytes, group_rows):
    rows = talk_rows(single)
    talks = prefix_trie.with_shared_heads(prefix_trie.turns_of(spark.createDataFrame(rows, TALK)))
    assert trie_rows(prefix_trie.build_trie(talks, single, group_bytes, group_rows)) == brute_trie(rows)


def test_trie_of_nulls_ties_and_missing_hosts(spark):
    rows = [(101, None, None, "a"), (101, 0, "user", None), (202, 5, "x", "y"), (7, 0, "", ""), (0, 0, "u", "😀é"), (0, 0, "u", "😀é"), (None, 0, "u", "t"), (300, None, None, None)]
    df = spark.createDataFrame(rows, TALK).selectExpr("*", "1 AS keys", "2 AS turns", "3 AS host")
    got = trie_rows(prefix_trie.build_trie(prefix_trie.with_shared_heads(prefix_trie.turns_of(df))))
    assert got == brute_trie(rows)
    empty = spark.createDataFrame([], TALK)
    assert prefix_trie.build_trie(prefix_trie.turns_of(empty)).count() == 0


def test_conversations_of_hundreds_of_turns(spark):
    rows = [(c, t, "user", f"{t}" if t < 250 else f"{t} {c}") for c in range(6) for t in range(300 + c)]
    got = trie_rows(prefix_trie.build_trie(prefix_trie.turns_of(spark.createDataFrame(rows, TALK))))
    assert got == brute_trie(rows, shared=False)


# whitening

def brute_whitening(vectors):
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    xs = {k: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for k, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(xs.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    z = [[n * x[i] - sums[i] for i in range(d)] for x in fit]
    v = np.array([[float(Decimal(sum(r[i] * r[j] for r in z)) / Decimal(n**3)) for j in range(d)] for i in range(d)])
    return xs, n, sums, v


def test_whitening_by_exact_sums(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 20)) * np.linspace(0.2, 3, 20)
    vectors = [(i, [float(c) for c in row]) for i, row in enumerate(base)] + [(100, [float(c) for c in base[0]])]
    vectors += [(101, None), (102, []), (103, [float("nan")] * 20), (104, [None] + [1.0] * 19), (105, [float("inf")] * 20)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS x", "2 AS dim")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df.repartition(7)).collect()}
    xs, n, sums, v = brute_whitening(vectors)
    assert set(got) == {(k, j) for k in xs for j in range(1, 17)}
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    for k, x in xs.items():
        z = np.array([n * a - s for a, s in zip(x, sums)], dtype=object)
        assert {got[k, j].deviation for j in range(1, 17)} == {sum(int(a) ** 2 for a in z)}
        w = np.array([float(a) / n for a in z]) @ q[:, :16] / np.sqrt(e[:16])
        assert np.allclose(np.abs(w), [abs(got[k, j].whitened) for j in range(1, 17)], rtol=1e-7, atol=1e-9)
    one = got[0, 1]
    assert one.n == n == 60 and abs(one.explained / (e[0] / np.trace(v)) - 1) < 1e-10 and one.identity_error < 1e-10
    signs = {j: {np.sign(got[k, j].whitened * 1.0) for k in (0, 100)} for j in range(1, 17)}
    assert all(len(s) == 1 for s in signs.values())


def test_clustered_eigenvalues_are_refined():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    for values in (
        np.concatenate([np.full(10, 5.0), 5 + 1e-9 * np.arange(10), 3 + 1e-5 * np.arange(14), np.linspace(1e-6, 1e-3, 14)]),
        np.concatenate([np.ones(24), np.zeros(24)]), 10.0 ** -np.arange(48.0) * 1e12,
    ):
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        e, x = whitening.refined(v)
        assert np.abs(x.T @ x - np.eye(48)).max() < 1e-14
        assert np.abs(v @ x - x * e).max() < 1e-14 * np.abs(v).max() and (np.diff(e) <= 1e-15 * np.abs(v).max()).all()
        assert np.allclose(e, np.linalg.eigvalsh(v)[::-1], atol=1e-14 * np.abs(v).max())


def test_whitening_of_flat_and_small_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert sorted((r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(1, 1, 0, None, None, None)] * 2 + [(2, 1, 0, None, None, None)] * 2
    mixed = [(1, [1.0]), (2, [2.0]), (3, [1.0, 5.0]), (4, [2.0, 5.0]), (5, [1e30, -1e30])]
    got = whitening.whiten(spark.createDataFrame(mixed, schema)).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in got) == [(1, 1, 2), (2, 1, 2), (3, 1, 3), (3, 2, 3), (4, 1, 3), (4, 2, 3), (5, 1, 3), (5, 2, 3)]
    assert abs(next(r.whitened for r in got if r.vec_id == 1)) == pytest.approx(1)


def test_whitening_query_on_the_given_table(spark, sf_dir):
    rows = QUERIES["op13_whitening"](spark, sf_dir)
    one = rows.agg(F.count("*"), F.countDistinct("vec_id"), F.max("identity_error"), F.min("n")).first()
    assert one[0] == 16 * one[1] and one[2] < 1e-8 and one[3] > 100

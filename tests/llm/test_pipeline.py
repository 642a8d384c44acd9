"""The pipeline stage by stage against brute force, and the registered queries."""

import re

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from diamondlap.llm import bpe
from diamondlap.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs.columns, docs.collect())]
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, sf_dir), name)
        out.append((name, docs.columns, docs.collect()))
    return out


def test_all_stages_but_the_last_return_documents(stages):
    assert [name for name, _, _ in stages[1:]] == ["language_id", "ngram_jaccard_join", "decontamination", "secret_scan", "byte_bpe"]
    assert all(columns == stages[0][1] for _, columns, _ in stages[:-1])


def test_documents_with_a_language_stay(stages):
    assert {r["doc_id"] for r in stages[1][2]} == {r["doc_id"] for r in stages[0][2] if re.search(r"[^\W\d_]", r["text"] or "")}


def test_one_document_of_each_group_stays(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[1][2]}
    want = {d for d, (_, root) in brute.join(texts).items() if d == root}
    assert {r["doc_id"] for r in stages[2][2]} == want and len(want) < len(texts)


def test_documents_without_benchmark_items_stay(stages, table):
    items = {r["item_id"]: r["text"] for r in table("benchmark").collect()}
    texts = {r["doc_id"]: r["text"] for r in stages[2][2]}
    shared = {s for t in items.values() for s in brute.shingles(t)}
    near = {d: t for d, t in texts.items() if shared & set(brute.shingles(t))}
    gone = {d for d, _ in brute.leaks(near, items)}
    assert gone and {r["doc_id"] for r in stages[3][2]} == set(texts) - gone


def test_secrets_are_gone_and_other_texts_as_they_were(stages):
    before, after = ({r["doc_id"]: r for r in stages[k][2]} for k in (3, 4))
    assert set(before) == set(after)
    for d, r in after.items():
        assert not any(k for _, k, _ in brute.base_spans(r["text"])) or "[SECRET]" in r["text"]
        if not brute.base_spans(before[d]["text"]) and "[SECRET]" not in r["text"]:
            assert r == before[d]
        elif brute.base_spans(before[d]["text"]):
            assert "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
            for a, _, b in brute.base_spans(before[d]["text"]):
                assert before[d]["text"][a:b] not in r["text"]


def test_ids_are_the_library_s(stages):
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in stages[4][2]}
    assert {r["doc_id"] for r in stages[5][2]} == set(texts)
    for r in stages[5][2]:
        assert bytes(r["ids"]) == np.array(encoding.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)

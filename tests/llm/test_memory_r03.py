"""Memory of a worker in the language stage."""

import tracemalloc

import numpy as np
import pyarrow as pa

from diamondlap.llm import language_id


def test_learning_a_language_holds_the_n_grams_of_little_text():
    """Of a batch of 4 MB; a worker keeps what it once took, also for the stages after."""
    words = [f"{chr(97 + i % 26)}{i * 7919 % 100_003:x}word" for i in range(5000)]
    batch = pa.record_batch([pa.array(["x"] * 80), pa.array([" ".join(words[k * 20 :] + words)[:50_000] for k in range(80)])], names=["lang", "text"])
    tracemalloc.start()
    try:
        out = list(language_id.count_grams(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    found = {g: n for b in out for g, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())}
    whole, counts = np.unique(np.concatenate([language_id.grams(t.encode()) for t in batch.column(1).to_pylist()]), return_counts=True)
    assert found == dict(zip(whole.tolist(), counts.tolist())) and peak < 80_000_000

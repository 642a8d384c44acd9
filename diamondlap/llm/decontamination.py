"""Benchmark items found in documents by SimHash windows.

An item is its five-word shingles, weighted by how often it has them. Over a
document slides a window as long as the item; its fingerprint (SimHash, 128 bits)
is looked up in an index that has, for each of eight 16-bit blocks, every block
value within BLOCK_RADIUS bits of an item's. Two fingerprints no further apart
than RADIUS agree in some block to BLOCK_RADIUS bits, so no item within RADIUS is
missed. Candidates are then compared exactly: the weighted Jaccard similarity of
window and item, SIMILARITY or more.

Windows are formed only where enough of their shingles occur in some item to
reach that similarity at all; this leaves out none that could be accepted.

The items reach the executors in blocks of at most BLOCK_WORDS words, as many as
the measured size of the benchmark needs; every document meets every block. No
row is shuffled.

Defined cases: a null or empty text, of a document or of an item, has no shingle
and matches nothing. A text of one to four words is a single shingle, so an item
that short is found only as a whole document. A document shorter than the item
is one window. Of several windows of a document the most similar, then the first
one stands for the item. Repeated documents are reported each row, items of the
same text each by its own item_id. Texts of any length are read in slices, whole
texts each. Without items nothing is found, an empty table gives no rows. find_leaks()
reads no other columns, drop_leaks() keeps them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from diamondlap.llm.text import SIMILARITY, WORDS, byte_slices, mix, text_shingles

BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 16, 4
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BLOCK_WORDS = 2_000_000  # of the benchmark, in one pass over the documents
INDEXED = 1_000  # items in one index
SLICE = 1_000_000


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of shingles[s : s + size] for each s, as BLOCKS 16-bit blocks; a tied bit is 0."""
    bits = np.empty((len(shingles), 2), np.uint64)
    bits[:, 0] = mix(shingles + np.uint64(1))
    bits[:, 1] = mix(shingles ^ np.uint64(0xD6E8FEB86659FD93))
    signs = np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int32) * 2 - 1
    sums = np.zeros((len(shingles) + 1, signs.shape[1]), np.int32)
    np.cumsum(signs, axis=0, out=sums[1:])
    return np.packbits(sums[starts + size] - sums[starts] > 0, axis=1).view(np.uint16)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity: each shingle weighs as often as it occurs."""
    values, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    n, m = np.bincount(place[: len(a)], minlength=len(values)), np.bincount(place[len(a) :], minlength=len(values))
    return float(np.minimum(n, m).sum() / np.maximum(n, m).sum())


class Leak(NamedTuple):
    row: int
    item_id: int
    similarity: float
    distance: int
    first_shingle: int
    shingles: int


class Index:
    """Multi-index of the fingerprints of some items."""

    def __init__(self, items: list[np.ndarray]):
        self.marks = np.concatenate([fingerprints(s, np.zeros(1, np.int64), len(s)) for s in items])
        masks = [sum(1 << b for b in c) for k in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), k)]
        masks = np.array(masks, np.uint16)
        self.heads, self.items = [], []
        for block in range(BLOCKS):
            near = (self.marks[:, block][:, None] ^ masks[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            self.items.append((order // len(masks)).astype(np.int32))
            self.heads.append(np.searchsorted(near[order], np.arange((1 << BLOCK_BITS) + 1)))

    def near(self, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items within RADIUS of a fingerprint, and their distances."""
        found = [self.items[k][self.heads[k][v] : self.heads[k][v + 1]] for k, v in enumerate(mark.astype(np.int64))]
        items = np.unique(np.concatenate(found))
        distance = np.bitwise_count(self.marks[items] ^ mark).sum(axis=1)
        return items[distance <= RADIUS], distance[distance <= RADIUS]


class Items:
    """One block of a benchmark."""

    def __init__(self, ids: list[int], texts: list[bytes], threshold: float):
        shingles, bounds = text_shingles(texts)
        own = [shingles[a:b] for a, b in zip(bounds, bounds[1:])]
        held = [(i, s) for i, s in zip(ids, own) if len(s)]
        self.threshold = threshold
        self.ids, self.shingles = [i for i, _ in held], [s for _, s in held]
        self.all = np.unique(shingles)
        self.sizes = sorted({len(s) for s in self.shingles})
        self.table = np.zeros(1 << 22, bool)
        self.table[(self.all & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self._index: dict[int, Index] = {}

    def __getstate__(self):
        return self.__dict__ | {"table": np.packbits(self.table), "_index": {}}

    def __setstate__(self, state):
        self.__dict__ |= state | {"table": np.unpackbits(state["table"]).astype(bool)}

    def index(self, part: int) -> Index:
        if part not in self._index:
            if len(self._index) >= 2:
                self._index.clear()
            self._index[part] = Index(self.shingles[part * INDEXED : (part + 1) * INDEXED])
        return self._index[part]

    def known(self, shingles: np.ndarray) -> np.ndarray:
        """Whether each shingle occurs in some item."""
        out = self.table[(shingles & np.uint64((1 << 22) - 1)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.all, shingles[maybe]), len(self.all) - 1)
        out[maybe] = self.all[at] == shingles[maybe]
        return out

    def windows(self, known: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """(item size, window starts, window size) of the windows of one document that could reach the threshold."""
        total = np.concatenate(([0], np.cumsum(known)))
        for size in self.sizes:
            width = min(size, len(known))
            least = self.threshold * (size + width) / (1 + self.threshold)
            starts = np.flatnonzero(total[width:] - total[: len(total) - width] >= least - 1e-9)
            if len(starts):
                yield size, starts, width

    def leaks(self, texts: list[bytes]) -> Iterator[Leak]:
        """The best window of every document for every item it holds."""
        if not self.ids:
            return
        shingles, bounds = text_shingles(texts)
        known = self.known(shingles)
        total = np.concatenate(([0], np.cumsum(known)))
        for row in np.flatnonzero(total[bounds[1:]] > total[bounds[:-1]]):
            own, hits = shingles[bounds[row] : bounds[row + 1]], known[bounds[row] : bounds[row + 1]]
            best: dict[int, Leak] = {}
            for size, starts, width in self.windows(hits):
                for part in range(-(-len(self.ids) // INDEXED)):
                    self._compare(int(row), own, size, starts, width, part, best)
            yield from best.values()

    def _compare(self, row: int, own: np.ndarray, size: int, starts: np.ndarray, width: int, part: int, best: dict[int, Leak]) -> None:
        low, high = int(starts[0]), int(starts[-1]) + width
        index = self.index(part)
        for start, mark in zip(starts, fingerprints(own[low:high], starts - low, width)):
            for item, distance in zip(*index.near(mark)):
                item += part * INDEXED
                if len(self.shingles[item]) != size:
                    continue
                alike = similarity(own[start : start + width], self.shingles[item])
                if alike >= self.threshold and (item not in best or alike > best[item].similarity):
                    best[item] = Leak(row, self.ids[item], alike, int(distance), int(start), width)


def item_blocks(benchmark: DataFrame, threshold: float, limit: int = BLOCK_WORDS) -> Iterator[Items]:
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    words = items.agg(F.sum(F.size(F.split("text", r"\W+")))).first()[0] or 0
    count = -(-words // limit) or 1
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in rows], [r["text"].encode("utf-8", "replace") for r in rows], threshold)


LEAKS = T.StructType([
    T.StructField("similarity", T.DoubleType()), T.StructField("distance", T.IntegerType()),
    T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()),
])


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per document and item found in it: where, how similar, how far apart the fingerprints."""
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", benchmark.schema["item_id"].dataType), *LEAKS.fields])
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for items in item_blocks(benchmark, threshold):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                found = [leak._replace(row=first + leak.row) for first, texts in byte_slices(batch.column(1), SLICE) for leak in held.value.leaks(texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([x.row for x in found], pa.int64())), pa.array([x.item_id for x in found], item_type),
                        pa.array([x.similarity for x in found], pa.float64()), pa.array([x.distance for x in found], pa.int32()),
                        pa.array([x.first_shingle for x in found], pa.int64()),
                        pa.array([x.shingles + WORDS - 1 for x in found], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "similarity", "distance", "first_word", "n_words"],
                )

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Documents in which no item is found, with all their columns as they are."""
    at, schema = docs.columns.index("text"), docs.schema
    for items in item_blocks(benchmark, threshold):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, texts in byte_slices(batch.column(at), SLICE):
                    clean[[first + leak.row for leak in held.value.leaks(texts)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs

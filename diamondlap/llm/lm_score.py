"""Log probabilities of texts under a hashed maximum-entropy language model.

The probability of a token is that of its class, given the tokens before it,
times that of the token within its class. Class probabilities are a softmax over
CLASSES classes of summed weights; a position's features are the token before,
the two before together, and the tokens two and three back alone (skips), hashed
to FEATURES rows of weights. Within a class a token's features are its identity
alone, for which the maximum-entropy solution is its smoothed relative frequency.

Counts of tokens are taken over the whole training corpus and joined with every
token of every text; the FREQUENT most frequent tokens are looked up in the tasks
instead, so only rare ones are shuffled. Classes come from the neighbours of
frequent tokens (k-means of their counts next to the most frequent ones), other
tokens take the class most common for their last two bytes. Weights are trained
in rounds over the whole training corpus: every task goes through its texts in
sparse batches of gradient steps from the current weights, and each feature's
changes are averaged over the tasks by how often these saw it. Only the weights,
counts for the most frequent tokens and class totals reach the driver; their
sizes are fixed.

A token is known by a 64-bit hash. Its count is the training count of its hash.

Defined cases: a null or empty text is one end token. A null doc_id counts as
training text. Repeated rows count and are scored each. Without training tokens
every probability within a class is one, and so is the base. An empty table
gives no rows. Very long texts are scored as a whole, in batches of positions. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diamondlap.llm.language_id import remainder
from diamondlap.llm.text import byte_slices, joined, mix, prefix_hash, span_hash
from diamondlap.sources.staging import stage

CLASSES = 32
FEATURES = 1 << 15  # at most 1 << 16
FREQUENT = 1 << 18
CLUSTERED, NEIGHBOURS = 8_192, 16  # tokens that are clustered, and by how many others on either side
ROUNDS = 2  # over all training texts
STEP = 0.8
BATCH = 16_384
SURFACES = 4_096
CHUNK = 1 << 14
SALTS = 64

END = np.uint64(0x656E64)
START = np.uint64(0x7374617274)
_SALT = np.array([0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], np.uint64)

_SPACE_BYTE = np.zeros(256, bool)
_SPACE_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and surface (a number for the last two bytes) of every token, ends included, and each text's first."""
    data, starts = joined([t.lower() for t in texts])  # of bytes: A-Z only
    inside = ~_SPACE_BYTE[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        change = np.concatenate(([0], change))
    begin, end = change[0::2], change[1::2]
    hashes = span_hash(prefix_hash(data.astype(np.uint64)), begin, end)
    before = data[np.maximum(end - 2, 0)].astype(np.int64) * (end - begin > 1)
    surface = (data[end - 1].astype(np.int64) * 31 + before) % (SURFACES - 1) + 1
    words = np.searchsorted(begin, starts)
    text = np.repeat(np.arange(len(texts)), np.diff(words))
    out = np.full(len(begin) + len(texts), END, np.uint64)
    out_surface = np.zeros(len(out), np.int64)
    place = np.arange(len(begin)) + text
    out[place], out_surface[place] = hashes, surface
    return out, out_surface, words + np.arange(len(texts) + 1)


class Lookup:
    """Row of each key in a fixed list, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], step)
            free = np.flatnonzero(self.rows[slot] < 0)
            slots, first = np.unique(slot[free], return_index=True)
            own = left[free[first]]
            self.keys[slots], self.rows[slots] = keys[own], own
            left, step = np.setdiff1d(left, own, assume_unique=True), step + 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys >> np.uint64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys, 0)
        out = np.where(self.keys[slot] == keys, self.rows[slot], -1).astype(np.int64)
        left, step = np.flatnonzero((out < 0) & (self.rows[slot] >= 0)), 1
        while len(left):
            slot = self._slot(keys[left], step)
            same = (self.keys[slot] == keys[left]) & (self.rows[slot] >= 0)
            out[left[same]] = self.rows[slot[same]]
            left, step = left[~same & (self.rows[slot] >= 0)], step + 1
        return out


class Vocabulary(NamedTuple):
    """What the tasks know of the training corpus."""

    keys: np.ndarray  # of the most frequent tokens, most frequent first
    counts: np.ndarray
    classes: np.ndarray  # of these tokens
    by_surface: np.ndarray  # class of the other tokens
    log_total: np.ndarray  # log10(N + V + 1) of each class
    tokens: int  # N
    distinct: int  # V

    def classes_of(self, row: np.ndarray, surface: np.ndarray) -> np.ndarray:
        out = self.by_surface[surface]
        known = row >= 0
        out[known] = self.classes[row[known]]
        return out


def partition_sums(docs: DataFrame, size: int, add, parts: int = 1) -> np.ndarray:
    """Sum over the tasks of the vectors of `size` floats that add(batches) gives; texts stay where they are.

    Adds up in two steps, chunk by chunk, so that no task takes the vectors of all others.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS
        vector = add(batches)
        if vector is None:
            return
        for k in range(0, size, CHUNK):
            raw = vector[k : k + CHUNK].astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([salt], pa.int64()), pa.array([raw], pa.binary())], names=["chunk", "salt", "raw"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for chunk, salt, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = np.frombuffer(raw, np.float32).astype(np.float64)
                key = (chunk, salt)
                sums[key] = sums[key] + own if key in sums else own
        for (chunk, salt), own in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([salt], pa.int64()), pa.array([own.astype(np.float32).tobytes()], pa.binary())], names=["chunk", "salt", "raw"]
            )

    schema = "chunk bigint, salt bigint, raw binary"
    rows = docs.mapInArrow(emit, schema).repartition("chunk", "salt").mapInArrow(total, schema)
    rows = rows.withColumn("salt", F.lit(0).cast("bigint")).repartition("chunk").mapInArrow(total, schema)
    out = np.zeros(size)
    for row in rows.collect():
        own = np.frombuffer(row["raw"], np.float32)
        out[row["chunk"] : row["chunk"] + len(own)] += own
    return out


def count_tokens(docs: DataFrame) -> DataFrame:
    """token (hash), surface, n over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            keys = np.concatenate([h[0] for h in held])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n = np.add.reduceat(np.concatenate([h[2] for h in held])[order], first)
            return keys[first], np.concatenate([h[1] for h in held])[order][first], n

        def emit(rows):
            for k in range(0, len(rows[0]), 200_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0][k : k + 200_000].view(np.int64)), pa.array(rows[1][k : k + 200_000].astype(np.int32)), pa.array(rows[2][k : k + 200_000])],
                    names=["token", "surface", "n"],
                )

        for batch in batches:
            for _, texts in byte_slices(batch.column(0), 1_000_000):
                keys, surface, _ = tokens(texts)
                held.append((keys, surface, np.ones(len(keys), np.int64)))
                if len(held) >= 16:
                    held = [merged()]
                    if len(held[0][0]) > 2_000_000:
                        yield from emit(held.pop())
        if held:
            yield from emit(merged())

    return docs.select("text").mapInArrow(count, "token bigint, surface int, n bigint").groupBy("token").agg(F.first("surface").alias("surface"), F.sum("n").alias("n"))


def neighbour_counts(docs: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """How often each of the CLUSTERED most frequent tokens stands after and before each of the NEIGHBOURS first."""
    keys = docs.sparkSession.sparkContext.broadcast(frequent[:CLUSTERED])
    width = 2 * NEIGHBOURS

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        lookup, out = Lookup(keys.value), np.zeros(CLUSTERED * width)
        for batch in batches:
            for _, texts in byte_slices(batch.column(0), 1_000_000):
                hashes, _, _ = tokens(texts)  # ends keep texts apart
                row = lookup.find(hashes)
                left, right = row[:-1], row[1:]
                for own, other, shift in ((right, left, 0), (left, right, NEIGHBOURS)):
                    ok = (own >= 0) & (other >= 0) & (other < NEIGHBOURS)
                    out += np.bincount(own[ok] * width + other[ok] + shift, minlength=len(out))
        return out

    return partition_sums(docs.select("text"), CLUSTERED * width, add).reshape(CLUSTERED, width)[: len(frequent)]


def cluster(counts: np.ndarray, weight: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """k-means of the rows by the square roots of their shares; seeded by the heaviest rows apart from each other."""
    share = np.sqrt((counts + 0.1) / (counts + 0.1).sum(axis=1, keepdims=True))
    centers = share[:1]
    heavy = np.sqrt(weight / weight.sum())
    for _ in range(1, min(k, len(share))):
        apart = 1 - (share @ centers.T).max(axis=1)
        centers = np.vstack((centers, share[np.argmax(apart * heavy)]))
    label = np.zeros(len(share), np.int64)
    for _ in range(rounds):
        label = np.argmax(share @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, label, share * heavy[:, None])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centers)
    return label


def vocabulary(docs: DataFrame, counts: DataFrame) -> Vocabulary:
    """docs: training texts; counts: of count_tokens(), written."""
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    keys = np.asarray(top.column("token").combine_chunks()).astype(np.int64).view(np.uint64)
    n = np.asarray(top.column("n").combine_chunks()).astype(np.int64)
    surface = np.asarray(top.column("surface").combine_chunks()).astype(np.int64)
    totals = counts.groupBy("surface").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    classes, by_surface = np.ones(len(keys), np.int64), np.ones(SURFACES, np.int64)
    if len(keys):
        few = min(CLUSTERED, len(keys))
        label = 1 + cluster(neighbour_counts(docs, keys)[:few], n[:few].astype(float), CLASSES - 1)
        votes = np.zeros((SURFACES, CLASSES))
        np.add.at(votes, (surface[:few], label), np.log1p(n[:few]))
        votes += votes.sum(axis=0) * 1e-9  # a surface without clustered tokens takes the heaviest class
        votes[:, 0] = 0
        by_surface = votes.argmax(axis=1)
        classes = by_surface[surface]
        classes[:few] = label
        classes[keys == END] = 0
    total, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in totals:  # as if all tokens went by surface, then the frequent ones by their own class
        total[by_surface[r["surface"]]] += r["n"]
        distinct[by_surface[r["surface"]]] += r["v"]
    for sign, own in ((-1, by_surface[surface]), (1, classes)):
        np.add.at(total, own, sign * n)
        np.add.at(distinct, own, sign)
    return Vocabulary(keys, n, classes, by_surface, np.log10(total + distinct + 1.0), int(total.sum()), int(distinct.sum()))


def features(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Four feature rows of each token; row 0 is left to the bias."""
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))

    def back(k: int) -> np.ndarray:
        out = np.full(len(hashes), START, np.uint64)
        out[k:] = hashes[:-k]
        out[place < k] = START
        return out

    one, two, three = back(1), back(2), back(3)
    keys = (one ^ _SALT[0], one * _SALT[1] + two, two ^ _SALT[2], three ^ _SALT[3])
    return np.stack([1 + (mix(k) % np.uint64(FEATURES - 1)).astype(np.int32) for k in keys], axis=1)


def probabilities(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    x = weights.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        x += weights.take(rows[:, k], axis=0)
    x += weights[0]
    np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def grouped_sums(values: np.ndarray, order: np.ndarray, first: np.ndarray, times: np.ndarray, few: int = 8) -> np.ndarray:
    """Sums of values[order] over the runs that begin at `first`. Most runs are short: their
    first rows are added up for all runs at once, then their second ones, and so on."""
    out = values.take(order[first], axis=0)
    for k in range(1, few):
        own = np.flatnonzero(times > k)
        out[own] += values.take(order[first[own] + k], axis=0)
    long = np.flatnonzero(times > few)
    if len(long):
        rest = times[long] - few
        start = np.cumsum(rest) - rest
        place = np.repeat(first[long] + few - start, rest) + np.arange(rest.sum())
        out[long] += np.add.reduceat(values.take(order[place], axis=0), start, axis=0)
    return out


def learn(weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, label: np.ndarray) -> None:
    """One batch of gradient steps; a feature's step shrinks with the root of how often it was seen."""
    gradient = probabilities(weights, rows)
    gradient[np.arange(len(label)), label] -= 1
    flat = rows.T.ravel().astype(np.uint16)  # sorted by its digits, not by comparisons
    order = np.argsort(flat, kind="stable")
    sorted_rows = flat[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
    own = sorted_rows[first].astype(np.int64)
    times = np.diff(np.concatenate((first, [len(flat)])))
    seen[own] += times
    seen[0] += len(label)
    sums = grouped_sums(gradient, order % len(label), first, times)
    sums *= (STEP / np.sqrt(times * seen[own])).astype(np.float32)[:, None]
    weights[own] -= sums
    weights[0] -= STEP * gradient.sum(axis=0) / np.sqrt(len(label) * seen[0])


def train(docs: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after some rounds over all training texts."""
    context = docs.sparkSession.sparkContext
    words = context.broadcast(known)
    weights = np.zeros((FEATURES, CLASSES), np.float32)
    for _ in range(rounds):
        now = context.broadcast(weights)

        def add(batches: Iterator[pa.RecordBatch], now=now) -> np.ndarray:
            known, own, seen = words.value, now.value.copy(), np.zeros(FEATURES, np.float32)
            lookup = Lookup(known.keys)
            for batch in batches:
                for _, texts in byte_slices(batch.column(0), 1_000_000):
                    hashes, surface, bounds = tokens(texts)
                    label = known.classes_of(lookup.find(hashes), surface)
                    rows = features(hashes, bounds)
                    for k in range(0, len(hashes), BATCH):
                        learn(own, seen, rows[k : k + BATCH], label[k : k + BATCH])
            return np.concatenate((((own - now.value) * seen[:, None]).ravel(), seen))

        sums = partition_sums(docs.select("text"), FEATURES * (CLASSES + 1), add)
        change, seen = sums[: FEATURES * CLASSES].reshape(FEATURES, CLASSES), sums[FEATURES * CLASSES :]
        weights = (weights + change / np.maximum(seen, 1)[:, None]).astype(np.float32)
        now.unpersist()
    return weights


PARTS = "row bigint, doc_id {}, held_out boolean, token bigint, times bigint, n_tokens bigint, n_known bigint, log_counts double, log_classes double"


def score_parts(docs: DataFrame, known: Vocabulary, weights: np.ndarray) -> DataFrame:
    """A row per text with what its frequent tokens add, and a row per text and rare token."""
    context = docs.sparkSession.sparkContext
    words, held_weights = context.broadcast(known), context.broadcast(weights)
    names = [c.split()[0] for c in PARTS.format("x").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = words.value, held_weights.value
        lookup, log_count = Lookup(known.keys), np.log10(known.counts + 1.0)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for start, texts in byte_slices(batch.column(2), 1_000_000):
                hashes, surface, bounds = tokens(texts)
                at = lookup.find(hashes)
                label = known.classes_of(at, surface)
                rows = features(hashes, bounds)
                of_class = np.empty(len(hashes))
                for k in range(0, len(hashes), BATCH):
                    p = probabilities(w, rows[k : k + BATCH])
                    of_class[k : k + BATCH] = np.log10(np.maximum(p[np.arange(len(p)), label[k : k + BATCH]], 1e-30))
                of_class -= known.log_total[label]
                counts = np.where(at >= 0, log_count[np.maximum(at, 0)] if len(log_count) else 0.0, 0.0)
                owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
                rare = at < 0
                pairs = np.empty(int(rare.sum()), [("owner", np.int64), ("token", np.int64)])
                pairs["owner"], pairs["token"] = owner[rare], hashes[rare].view(np.int64)
                order = np.lexsort((pairs["token"], pairs["owner"]))
                pairs = pairs[order]
                new = np.ones(len(pairs), bool)
                new[1:] = pairs[1:] != pairs[:-1]
                first = np.flatnonzero(new)
                times = np.diff(np.concatenate((first, [len(pairs)])))
                pairs = pairs[first]
                n, m = len(texts), len(pairs)
                begin = bounds[:-1]  # every text has an end token, so none is empty
                sums = [np.add.reduceat(x, begin) for x in ((at >= 0).astype(np.int64), counts, of_class)]
                no_long, no_double = pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64())
                whole = [
                    pa.array(row + np.arange(n)), batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.nulls(n, pa.int64()),
                    pa.nulls(n, pa.int64()), pa.array(np.diff(bounds)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]),
                ]
                yield pa.RecordBatch.from_arrays(whole, names=names)
                if m:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row + pairs["owner"]), pa.nulls(m, batch.column(0).type), pa.nulls(m, pa.bool_()), pa.array(pairs["token"]),
                            pa.array(times), no_long, no_long, no_double, no_double,
                        ],
                        names=names,
                    )
                row += n

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, PARTS.format(docs.schema["doc_id"].dataType.simpleString()))


def score_texts(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """One row per document: token counts, unigram base score and the model's score, both log10."""
    held_out = F.coalesce(remainder("doc_id", folds) == fold, F.lit(False))
    docs = docs.select("doc_id", held_out.alias("held_out"), "text")
    training = docs.where(~F.col("held_out"))
    counts = stage(count_tokens(training), "counts")
    known = vocabulary(training, counts)
    parts = stage(score_parts(docs, known, train(training, known)), "parts")
    rare = parts.where("token is not null").select("row", "token", "times").join(counts.select("token", "n"), "token", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("rare_counts"),
    )
    texts = parts.where("token is null").join(rare, "row", "left")
    log_counts = F.col("log_counts") + F.coalesce("rare_counts", F.lit(0.0))
    log_all = float(np.log10(known.tokens + known.distinct + 1.0))
    return texts.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"), (log_counts - F.col("n_tokens") * log_all).alias("base_score"),
        (log_counts + F.col("log_classes")).alias("score"),
    )

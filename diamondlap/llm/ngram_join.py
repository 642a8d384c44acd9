"""Similarity join of texts by the Jaccard similarity of their five-word shingles.

Copies (texts of the same words in the same order) form one class first. An LSH
forest describes a class by TREES paths of PATH MinHash values each. The paths of
a tree are sorted over all tasks, so that a branch, the classes whose paths begin
alike, is a run of neighbours; classes that share not even the shortest prefix with
a neighbour are done with this tree.

A branch is as short a prefix as may be, from SHORTEST values on. One that holds
more than BRANCH classes is not compared as it is: its classes go on to longer
prefixes, where branches are smaller but a pair is found less likely. What a class
can then be found by follows from its prefixes in all trees. If that is less than
the target recall, prefixes of the class are shortened again, the one with the
smallest branch first, until the target is reached; the branches opened so are
compared whole, whatever they hold.

Candidates are the pairs of a branch whose signatures make similarity possible at
all (MARGIN below the threshold, over five standard deviations). They hang together
in clusters, and within clusters all pairs are compared exactly by their sets of
shingles. Branches and clusters of any size are dealt over many tasks, see graph.py.
What comes out is one row per document, not pairs.

Defined cases: a text without a word (null and empty ones too) links with
nothing. Shorter texts than five words have one shingle; of very long texts all
shingles count, and a task holds about SLICE bytes of text besides. Repeated rows and
documents without doc_id are copies like any others; a class whose documents
all lack a doc_id has a null class_id. An empty table gives no rows. Other
columns are not read by join_similar() and kept by keep_one(), whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diamondlap.llm.graph import components, hot_limit, join_spread, join_within, small
from diamondlap.llm.names import free_names
from diamondlap.llm.text import SIMILARITY, WORDS, byte_slices, mix, prefix_hash, shingles, span_hash, word_hashes
from diamondlap.sources.staging import stage

TREES, PATH = 12, 6
SHORTEST = 2  # values of a prefix
STEP = 4  # bytes of a value
RECALL = 0.9995
MARGIN = 0.25
BRANCH = 2_048  # classes of a branch, and rows of one part of it that are compared at once with as many others
CLUSTER, CLUSTER_BYTES = 512, 4 << 20  # rows and bytes of a part of a cluster
SLICE = 1_000_000

_rng = np.random.default_rng(20_240_229)
_FACTORS = _rng.integers(1, 1 << 63, TREES * PATH, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, TREES * PATH, dtype=np.uint64)


def prefix_length(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, path: int = PATH) -> int:
    """The longest prefix that reaches the target recall if it is used in every tree."""
    length = path
    while length > 1 and 1 - (1 - similarity**length) ** trees < recall:
        length -= 1
    return length


def class_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit key of each text's word sequence."""
    return span_hash(prefix_hash(mix(hashes ^ np.uint64(0xA0761D6478BD642F))), bounds[:-1], bounds[1:]).view(np.int64)


def signatures(marks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text with shingles: its path in every tree, as bytes, and one other byte of each MinHash value."""
    full = np.flatnonzero(np.diff(bounds))
    least = np.empty((len(full), TREES * PATH), np.uint64)
    for k in range(TREES * PATH):
        least[:, k] = np.minimum.reduceat((marks ^ _OFFSETS[k]) * _FACTORS[k], bounds[full])
    least = mix(least)
    return (least & np.uint64(0xFFFFFFFF)).astype(np.uint32), (least >> np.uint64(56)).astype(np.uint8)


def describe(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, hash of the text, node (class key; null without words), paths and signature as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in byte_slices(batch.column(1), SLICE):
                hashes, bounds = word_hashes(texts)
                node = class_keys(hashes, bounds)
                marks, at = shingles(hashes, bounds, words)
                full = np.flatnonzero(np.diff(at))
                both = [None] * len(texts)
                if len(full):
                    for row, path, mark in zip(full, *signatures(marks, at)):
                        both[row] = path.tobytes() + mark.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), batch.column(2).slice(first, len(texts)), pa.array(node, mask=np.diff(at) == 0), pa.array(both, pa.binary())],
                    names=["doc_id", "text_key", "node", "marks"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_key()).mapInArrow(run, f"doc_id {kind}, text_key bigint, node bigint, marks binary")


def text_key():
    return F.xxhash64("text").alias("text_key")


def tries(classes: DataFrame) -> DataFrame:
    """tree, path and node of the classes that share the shortest prefix with another one: the paths of
    each tree are sorted by range over all tasks, and each is compared with its neighbours."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [m[: TREES * PATH * STEP] for m in batch.column(1).to_pylist()]
            for tree in range(TREES):
                own = [m[tree * PATH * STEP : (tree + 1) * PATH * STEP] for m in raw]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), tree, np.int32)), pa.array(own, pa.binary()), batch.column(0)], names=["tree", "path", "node"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows at either end of a slice are kept, as their neighbours lie in other slices."""
        held, last_shared = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            tree = np.asarray(batch.column(0))
            start = np.frombuffer(b"".join(p[: SHORTEST * STEP] for p in batch.column(1).to_pylist()), f"V{SHORTEST * STEP}")
            shared = (tree[1:] == tree[:-1]) & (start[1:] == start[:-1])
            keep = np.concatenate(([last_shared], shared)) | np.concatenate((shared, [False]))
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
            held, last_shared = batch.slice(batch.num_rows - 1), bool(shared[-1]) if len(shared) else last_shared
        if held is not None:
            yield held

    schema = "tree int, path binary, node bigint"
    rows = classes.select("node", "marks").mapInArrow(paths, schema)
    return rows.repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node").mapInArrow(neighbours, schema)


def lost(similarity: float, prefix: int) -> float:
    """Logarithm of the probability that a pair of this similarity differs in a prefix."""
    return math.log1p(-(similarity**prefix))


def shortened(branches: list[dict], similarity: float, recall: float) -> list[int]:
    """Keys of the branches to be opened so that a class is found with the target recall. branches holds, for each tree whose
    shortest branch is too large: depth, the prefix gone on to, and by prefix the key and size of the larger branches."""
    depth = [b["depth"] for b in branches]
    log_lost = sum(lost(similarity, d) for d in depth) + (TREES - len(depth)) * lost(similarity, SHORTEST)
    target = math.log1p(-recall) + 1e-9
    while log_lost > target and any(d > SHORTEST for d in depth):
        k = min((k for k in range(len(depth)) if depth[k] > SHORTEST), key=lambda k: (branches[k]["sizes"][depth[k] - 1 - SHORTEST] or 0, depth[k]))
        log_lost += lost(similarity, depth[k] - 1) - lost(similarity, depth[k])
        depth[k] -= 1
    return [b["keys"][d - SHORTEST] for b, d in zip(branches, depth) if d < b["depth"]]


def branches(rows: DataFrame, similarity: float, recall: float, limit: int) -> DataFrame:
    """branch (key) and node of the classes in the branches to be compared."""
    depths = range(SHORTEST, PATH + 1)
    keyed = rows.withColumns({f"k{d}": F.xxhash64("tree", F.lit(d), F.substring("path", 1, d * STEP)) for d in depths})
    every = keyed.select(F.explode(F.array(*(F.col(f"k{d}") for d in depths))).alias("key"))
    large = stage(every.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > limit), "large")
    if large.isEmpty():
        return keyed.select(F.col(f"k{SHORTEST}").alias("branch"), "node")

    def with_depth(closed: DataFrame) -> DataFrame:
        """The shortest prefix whose branch is not closed, or the longest."""
        out, closed = keyed, small(closed)
        for d in depths:
            out = out.join(closed.select(F.col("key").alias(f"k{d}"), F.col("size").alias(f"n{d}")), f"k{d}", "left")
        return out.withColumn("depth", F.coalesce(*(F.when(F.col(f"n{d}").isNull(), d) for d in depths), F.lit(PATH)))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [key for trees in batch.column(0).to_pylist() for key in shortened(trees, similarity, recall)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["key"])

    tree = F.struct("depth", F.array(*(F.col(f"k{d}") for d in depths)).alias("keys"), F.array(*(F.col(f"n{d}") for d in depths)).alias("sizes"))
    going_on = with_depth(large).where(F.col("depth") > SHORTEST).groupBy("node").agg(F.collect_list(tree).alias("trees"), F.max("depth").alias("most"))  # TREES at most
    going_on = going_on.where(F.col("most") > prefix_length(similarity, recall))  # the others reach the target as they are
    needed = stage(going_on.select("trees").mapInArrow(opened, "key bigint").distinct(), "opened")
    final = with_depth(stage(large.join(needed, "key", "left_anti"), "closed"))
    own = F.coalesce(*(F.when(F.col("depth") == d, F.col(f"k{d}")) for d in depths))
    return final.select(own.alias("branch"), "node")


def alike_marks(least: float):
    """Pairs of a branch whose signatures agree in the share that a similarity of `least` makes."""

    def compare(rows: pa.RecordBatch) -> np.ndarray:
        marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        need = marks.shape[1] * (least + (1 - least) / 256)
        same = np.zeros((len(marks), len(marks)), np.uint8)
        for k in range(marks.shape[1]):
            same += marks[:, k][:, None] == marks[:, k][None, :]
        return same >= need

    return compare


def alike_sets(threshold: float, columns: int = 4_096):
    """Pairs of a cluster whose sets of shingles are similar, by products of their incidence matrix."""

    def compare(rows: pa.RecordBatch) -> np.ndarray:
        sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.float64)
        owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
        _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[place] > 1  # the others are in no intersection
        number = np.cumsum(count > 1) - 1
        owner, place = owner[shared], number[place[shared]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        common = np.zeros((len(sets), len(sets)))
        for low in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
            a, b = np.searchsorted(place, (low, low + columns))
            held = np.zeros((len(sets), columns), np.float32)
            held[owner[a:b], place[a:b] - low] = 1
            common += held @ held.T
        return common / (sizes[:, None] + sizes[None, :] - common) >= threshold

    return compare


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """cluster, node, weight and the sorted distinct shingles of one document of each wanted class.

    wanted(first_id, text_key, node, weight, cluster) names a document by its id and the hash of its text; repeated rows
    of it are taken once, and a text of that hash but another class is left out by its class key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sets, kept = np.asarray(batch.column(1)), [], []
            for first, texts in byte_slices(batch.column(0), SLICE):
                hashes, bounds = word_hashes(texts)
                right = class_keys(hashes, bounds) == node[first : first + len(texts)]
                marks, at = shingles(hashes, bounds, words)
                for row in np.flatnonzero(right):
                    sets.append(np.unique(marks[at[row] : at[row + 1]]).tobytes())
                    kept.append(first + row)
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(3), rows.column(1), rows.column(2), pa.array(sets, pa.binary())], names=["cluster", "node", "weight", "shingles"])

    found = docs.select("doc_id", "text", text_key()).join(wanted, "text_key").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    once = found.groupBy("node").agg(F.first("text").alias("text"), F.first("weight").alias("weight"), F.first("cluster").alias("cluster"))
    return once.select("text", "node", "weight", "cluster").mapInArrow(run, "cluster bigint, node bigint, weight bigint, shingles binary")


def linked(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """join_similar() and, for every class of copies, the class that stays of those it hangs together
    with: `stays` among documents with a doc_id, `stays_null` among those without."""
    described = stage(describe(docs), "described")
    worded = described.where("node is not null")
    classes = stage(
        worded.groupBy("node")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("null_first"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("least"),
             F.max(F.col("doc_id").isNull()).alias("no_id"), F.count("*").alias("weight"), F.first("marks").alias("marks"))
        .withColumn("first", F.coalesce("least", "null_first"))
        .select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("text_key"), "no_id", "weight", "marks"), "classes",
    )
    rows = stage(tries(classes), "tries")
    signature = F.substring("marks", TREES * PATH * STEP + 1, TREES * PATH).alias("marks")
    members = branches(rows, threshold, recall, BRANCH).join(classes.select("node", signature), "node").withColumn("weight", F.lit(1).cast("long"))
    candidates = join_within(members, "branch", BRANCH, alike_marks(threshold - MARGIN))
    clusters = components(candidates.select("node", "root")).withColumnRenamed("root", "cluster")
    wanted = stage(classes.select("first_id", "text_key", "node", "weight").join(clusters, "node").select("first_id", "text_key", "node", "weight", "cluster"), "wanted")
    sets = stage(shingle_sets(docs, small(wanted)), "sets")
    links = stage(join_within(sets, "cluster", CLUSTER, alike_sets(threshold), size=F.length("shingles"), most=CLUSTER_BYTES), "links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = stage(components(links.select("node", "root")), "roots")
    own = F.when(F.col("first_id").isNotNull(), F.struct("first_id", "node"))
    own_null = F.when(F.col("no_id"), F.col("node"))
    ids = stage(roots.join(classes.select("node", "first_id", "no_id"), "node").groupBy("root").agg(
        F.min("first_id").alias("class_id"), F.min(own)["node"].alias("stays"), F.min(own_null).alias("stays_null"), F.count("*").alias("size")
    ), "ids")
    of_roots = join_spread(roots, ids, "root", F.col("size") > hot_limit(roots.count())).drop("size")
    known = classes.select("node", "first_id", "no_id", "weight").join(counts, "node", "left").join(of_roots, "node", "left")
    known = stage(known.select(
        "node", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("root").isNull(), own["node"]).otherwise(F.col("stays")).alias("stays"),
        F.when(F.col("root").isNull(), own_null).otherwise(F.col("stays_null")).alias("stays_null"),
    ), "known")
    out = join_spread(worded.select("doc_id", "node"), known, "node", F.col("weight") > hot_limit(described.count())).select(
        "doc_id", F.col("node").alias("copy_key"), "n_links", "class_id", "stays", "stays_null"
    )
    wordless = described.where("node is null").select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"))
    return out.unionByName(wordless, allowMissingColumns=True)


def join_similar(docs: DataFrame, threshold: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: copy_key, n_links (other documents of similarity >= threshold, copies
    included) and class_id, the least doc_id it hangs together with over such links."""
    return linked(docs, threshold, recall).drop("stays", "stays_null")


def with_copy_key(docs: DataFrame, into: str) -> DataFrame:
    """docs with the class key of each text, null without words."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [pa.array([], pa.int64())]
            for _, texts in byte_slices(batch.column(at), SLICE):
                hashes, bounds = word_hashes(texts)
                keys.append(pa.array(class_keys(hashes, bounds), mask=np.diff(bounds) == 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(keys)], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.LongType())]))


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one with the least doc_id, with all its columns as they are.

    Rows are told apart by doc_id and words, so texts that only share a doc_id are
    judged each. Of the documents of a class without doc_id one stays besides the
    one with a doc_id. Of rows of the same doc_id and words one stays, the first by
    its columns as JSON. Texts without a word all stay.
    """
    copy, own_id, key = free_names(docs, "_copy_key", "_id", "_key")
    found = linked(docs, threshold, RECALL).where("copy_key is not null")
    with_id = F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("class_id")) & (F.col("copy_key") == F.col("stays"))
    without_id = F.col("doc_id").isNull() & (F.col("copy_key") == F.col("stays_null"))
    keep = F.coalesce(with_id | without_id, F.lit(False)).alias("keep")
    found = stage(found.select(F.col("doc_id").alias(own_id), F.col("copy_key").alias(key), keep), "joined")
    same = (F.col(copy) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(own_id))
    dropped = small(stage(found.where("not keep").select(own_id, key).distinct(), "dropped"))
    kept = with_copy_key(docs, copy).join(dropped, same, "left_anti")
    again = stage(found.where("keep").groupBy(own_id, key).agg(F.count("*").alias("rows")).where("rows > 1").select(own_id, key), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    again = small(again)
    row, (held,) = F.struct(*docs.columns), free_names(docs, "_row")
    one = kept.join(again, same, "left_semi").groupBy("doc_id", copy).agg(F.min_by(row, F.to_json(row)).alias(held))
    return kept.join(again, same, "left_anti").select(*docs.columns).unionByName(one.select(f"{held}.*").select(*docs.columns))

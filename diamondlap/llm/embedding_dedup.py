"""Near-duplicate vectors by random-hyperplane signs, checked by exact cosine.

Equal vectors form one class first: they are grouped by a 128-bit digest, and the
bytes of a class are compared. In each of several tables a class falls into the
bucket of its signs against random hyperplanes. Within a bucket classes are compared
by further signs (SKETCH of them): pairs whose signs differ in no more places than
those of a pair that is only just near enough may, five standard deviations beyond the
expectation, are candidates. Candidates hang together in clusters, and within a
cluster all pairs are compared by cosine in double precision. So only keys and
signs are dealt over the tables, and each vector goes once to its cluster. Buckets
and clusters of any size are dealt over many tasks, see graph.py.

The number of signs of a bucket grows with the logarithm of the number of classes, so
that buckets keep their size, and the number of tables follows from the recall to be
reached for a pair that is only just near enough. Vectors are not centred: that would
change their angles, and with them the recall.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component link with nothing, nor do vectors of different lengths. Repeated rows
are copies like any others. Rows without vec_id count as links of others, but
are no component's id; a component whose rows all lack one has a null id. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diamondlap.llm.graph import components, hot_limit, join_spread, join_within
from diamondlap.sources.staging import stage

COSINE = 0.9
RECALL = 0.997
BUCKET = 256  # classes that a bucket has on average
GROUP, GROUP_BYTES = 2_048, 16 << 20  # of a bucket or cluster that are compared at once with as many others
SKETCH = 256  # signs
SEED = 71_993


def tables_and_signs(classes: int, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    signs = max(1, round(math.log2(max(classes, 2) / bucket)))
    agree = (1 - math.acos(cosine) / math.pi) ** signs
    return math.ceil(math.log(1 - recall) / math.log(1 - agree)), signs


def as_matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Usable vectors by their length: (rows, matrix in double precision)."""
    by: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for row, scalar in enumerate(column):
        values = scalar.values
        if values is None or not len(values) or values.null_count:
            continue
        x = np.asarray(values, np.float64)
        if np.isfinite(x).all() and x.any():
            rows, vectors = by.setdefault(len(x), ([], []))
            rows.append(row)
            vectors.append(x + 0.0)  # no negative zero
    return {n: (np.array(rows), np.stack(vectors)) for n, (rows, vectors) in by.items()}


def keyed(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, key (digest of the vector; null if unusable) and the vector's bytes in double precision."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, raw = [None] * batch.num_rows, [None] * batch.num_rows
            for rows, matrix in as_matrix(batch.column(1)).values():
                for row, x in zip(rows, matrix):
                    raw[row] = x.tobytes()
                    key[row] = xxhash.xxh3_128_digest(raw[row])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "key", "vector"])

    kind = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    return rows.mapInArrow(run, f"vec_id {kind}, key binary, vector binary")


def most_apart(cosine: float = COSINE, signs: int = SKETCH) -> int:
    """Signs in which a pair of this cosine differs at most, but for five standard deviations."""
    share = math.acos(cosine) / math.pi
    return math.ceil(share * signs + 5 * math.sqrt(share * (1 - share) * signs))


def buckets(classes: DataFrame, tables: int, signs: int) -> DataFrame:
    """One row per class and table, with the class's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column(1).to_pylist()
            length = np.array([len(r) // 8 for r in raw])
            for n in np.unique(length):
                if n not in planes:
                    planes[n] = np.random.default_rng([SEED, int(n)]).standard_normal((int(n), tables * signs + SKETCH))
                own = np.flatnonzero(length == n)
                matrix = np.frombuffer(b"".join([raw[k] for k in own]), np.float64).reshape(len(own), n)
                bits = matrix / np.abs(matrix).max(axis=1, keepdims=True) @ planes[n] > 0
                codes = bits[:, : tables * signs].reshape(len(own), tables, signs) @ (1 << np.arange(signs, dtype=np.int64))
                sketch = pa.array([b.tobytes() for b in np.packbits(bits[:, tables * signs :], axis=1)], pa.binary())
                node, one = batch.column(0).take(pa.array(own)), pa.array(np.ones(len(own), np.int64))
                for t in range(tables):
                    key = (codes[:, t] * tables + t) * 1_000_003 + n
                    yield pa.RecordBatch.from_arrays([pa.array(key), node, one, sketch], names=["bucket", "node", "weight", "sketch"])

    return classes.select("node", "vector").mapInArrow(run, "bucket bigint, node bigint, weight bigint, sketch binary")


def alike(apart: int):
    """Pairs of a bucket whose sketches differ in at most `apart` signs."""

    def compare(rows: pa.RecordBatch) -> np.ndarray:
        signs = np.unpackbits(np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(rows.num_rows, -1), axis=1)
        signs = signs.astype(np.float32) * 2 - 1
        return signs @ signs.T >= SKETCH - 2 * apart

    return compare


def near(cosine: float):
    """Pairs of a cluster at or above the cosine; of different lengths none is."""

    def compare(rows: pa.RecordBatch) -> np.ndarray:
        raw = rows.column("vector").to_pylist()
        length = np.array([len(r) // 8 for r in raw])
        out = np.zeros((len(raw), len(raw)), bool)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            x = np.frombuffer(b"".join(raw[k] for k in own), np.float64).reshape(len(own), n)
            x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
            norm = np.sqrt((x * x).sum(axis=1))
            out[np.ix_(own, own)] = (x @ x.T) / norm[:, None] / norm[None, :] >= cosine
        return out

    return compare


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row per vector: n_links (other vectors of cosine >= `cosine` that were found), component_id, kept."""
    described = stage(keyed(vectors, vec_id, embedding), "vectors")
    usable = described.where("key is not null")
    found = usable.groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.min("vector").alias("vector"), F.max("vector").alias("other"))
    classes = stage(found.withColumn("node", F.monotonically_increasing_id()), "classes")
    if not classes.where("vector != other").isEmpty():
        raise RuntimeError("two vectors have the same 128-bit digest")
    count = classes.count()
    tables, signs = tables_and_signs(count, cosine, recall)
    candidates = join_within(buckets(classes, tables, signs), "bucket", GROUP, alike(most_apart(cosine)))
    clusters = components(candidates.select("node", "root")).withColumnRenamed("root", "cluster")
    members = stage(classes.select("node", "weight", "vector").join(clusters, "node"), "members")
    links = stage(join_within(members, "cluster", GROUP, near(cosine), size=F.length("vector"), most=GROUP_BYTES), "links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = stage(components(links.select("node", "root")), "roots")
    ids = stage(roots.join(classes.select("node", "first_id"), "node").groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("size")), "ids")
    of_roots = join_spread(roots, ids, "root", F.col("size") > hot_limit(roots.count())).select("node", "root", "component_id")
    known = classes.select("key", "node", "first_id", "weight").join(counts, "node", "left").join(of_roots, "node", "left")
    known = stage(known.select(
        "key", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
    ), "known")
    out = join_spread(usable.select("vec_id", "key"), known, "key", F.col("weight") > hot_limit(described.count())).select("vec_id", "n_links", "component_id")
    unusable = described.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(unusable).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

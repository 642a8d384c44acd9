"""Comparing rows within groups of any size, and connected components of the links.

A group larger than a limit is dealt into parts, and every pair of parts becomes
a group of its own, so no task holds more than two parts of any group. What a
group yields is one row per member that has a link, never its pairs: the summed
weight of its links there, and the least member it hangs together with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diamondlap.sources.staging import stage

LINKED = "node bigint, links bigint, root bigint"
BROADCAST_ROWS = 1_000_000  # of two or three long columns, about 40 MB
HOT_ROWS, HOT_KEYS = 1_000, 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than `rows` rows; df should be a written table."""
    return F.broadcast(df) if df.count() <= rows else df


def hot_limit(rows: int) -> int:
    """The number of rows above which a key counts as hot; there are at most HOT_KEYS such keys."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def join_spread(rows: DataFrame, found: DataFrame, key: str, large: Column) -> DataFrame:
    """rows joined with found, which has one row per key and should be a written table. Keys that `large` says
    are hot are sent to the rows (see hot_limit()), all others are joined as usual; a row without its key is left out."""
    hot = F.broadcast(found.where(large))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(found.where(~large), key))


def dealt(rows: DataFrame, key: str, node: str, limit: int, size: Column | None = None, most: int = 0) -> DataFrame:
    """rows with i and j, the parts of its group that a row meets; part is its own. Sorted by group within partitions.
    A part has about `limit` rows at most, and if `size` is given, about `most` of it."""
    wanted = F.ceil(F.count("*") / limit)
    if size is not None:
        wanted = F.least(F.greatest(wanted, F.ceil(F.sum(size) / most)), F.count("*"))
    hot = stage(rows.groupBy(key).agg(wanted.cast("int").alias("parts")).where("parts > 1"), "hot")
    out = rows.join(small(hot), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    out = out.withColumn("part", F.pmod(F.xxhash64(node, F.lit(7)), F.col("parts")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    out = out.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("parts", "other")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as the work grows faster than the bytes by which tasks would be put together
    return out.repartition(tasks, key, "i", "j").sortWithinPartitions(key, "i", "j", node)


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int = 2) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """(rows, first, end) of every run of `least` or more rows with equal keys in sorted batches."""
    held = None

    def runs(rows: pa.RecordBatch, last: bool):
        columns = [np.asarray(rows.column(k)) for k in keys]
        change = np.zeros(max(rows.num_rows - 1, 0), bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        bounds = np.concatenate(([0], np.flatnonzero(change) + 1, [rows.num_rows]))
        done = len(bounds) - 1 - (not last)
        many = np.flatnonzero(np.diff(bounds[: done + 1]) >= least) if done > 0 else []
        return [(rows, int(bounds[k]), int(bounds[k + 1])) for k in many], int(bounds[done]) if done >= 0 else 0

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None and held.num_rows:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        found, cut = runs(batch, last=False)
        yield from found
        held = batch.slice(cut)
    if held is not None and held.num_rows:
        yield from runs(held, last=True)[0]


def compared(i: np.ndarray, j: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which pairs (row, later row) of a group of parts i and j meet here: all of one part, or those across two."""
    n = len(part)
    out = np.triu(np.ones((n, n), bool), 1)
    return out if i[0] == j[0] else out & (part[:, None] != part[None, :])


def linked(node: np.ndarray, weight: np.ndarray, links: np.ndarray) -> pa.RecordBatch | None:
    """LINKED rows from a group's upper triangle of links."""
    a, b = np.nonzero(links)
    if not len(a):
        return None
    total = np.zeros(len(node), np.int64)
    np.add.at(total, a, weight[b])
    np.add.at(total, b, weight[a])
    root = node.copy()
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if np.array_equal(before, root):
            break
    own = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(total[own]), pa.array(root[own])], names=["node", "links", "root"])


def join_within(
    rows: DataFrame, key: str, limit: int, compare: Callable[[pa.RecordBatch], np.ndarray | None], node: str = "node", weight: str = "weight",
    size: Column | None = None, most: int = 0,
) -> DataFrame:
    """LINKED rows of all groups with equal `key`.

    rows need a long key, a long node and a long weight; compare() gets the rows
    of a group and gives the matrix of its links, of which the pairs that meet
    elsewhere are left out. A node given twice in a group is taken once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, first, end in groups(batches, (key, "i", "j")):
            own = held.slice(first, end - first)
            nodes = np.asarray(own.column(node))
            once = np.concatenate(([True], nodes[1:] != nodes[:-1]))
            if not once.all():
                own = own.filter(pa.array(once))
                nodes = nodes[once]
            if len(nodes) < 2:
                continue
            links = compare(own)
            if links is None or not links.any():
                continue
            links &= compared(*(np.asarray(own.column(c)) for c in ("i", "j", "part")))
            out = linked(nodes, np.asarray(own.column(weight)), links)
            if out is not None:
                yield out

    return dealt(rows, key, node, limit, size, most).mapInArrow(run, LINKED)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node each node hangs together with, for all nodes of edges(node, root).

    Alternating large-star and small-star rounds on written tables; no edges or
    labels reach the driver, only their count and checksum.
    """
    edges = stage(edges.where(F.col("node") != F.col("root")).select("node", "root").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        large = _star(edges.union(edges.select("root", "node")), larger_only=True)
        ordered = large.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root"))
        edges = stage(_star(ordered.where("node != root").distinct(), larger_only=False).where("node != root").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("root").alias("node"), "root").distinct()
    return edges.union(roots)


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Hang the neighbours of every node (the larger ones only, or all and the node itself) on its least neighbour."""
    least = stage(edges.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("least"), F.count("*").alias("degree")), "least")
    if least.count() <= BROADCAST_ROWS:
        joined = edges.join(F.broadcast(least), "node")
    else:
        edges = stage(edges, "edges")
        joined = join_spread(edges, least, "node", F.col("degree") > hot_limit(edges.count()))
    if larger_only:
        return joined.where(F.col("root") > F.col("node")).select(F.col("root").alias("node"), F.col("least").alias("root"))
    return joined.select(F.col("root").alias("node"), F.col("least").alias("root")).union(least.select("node", F.col("least").alias("root")))

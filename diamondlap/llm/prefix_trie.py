"""Prefix trie of conversations, by peeling their last turns.

A conversation is the list of its turns; each of its prefixes has a key, the
SHA-256 of the key before it and of the turn (role and text). Conversations with
the same key are members of one node.

From the greatest depth on, the conversations that end at a depth and the nodes
that survived the depth below are grouped by their key at this depth; a group is
a node, and its sums are complete. The last turn is then taken off each node and
what is left survives to the next depth, so nodes are found and aggregated in one
pass. Down to depth SINGLE every depth is one aggregation, with partial sums, so a
first turn that a third of all conversations share does not meet in one task.
Below, depths are peeled in windows that double: (8, 16], (16, 32] and so on.
Conversations with the same key at the beginning of a window are peeled in one
task, depth by depth; where they are more than a task should hold (GROUP_BYTES of
keys), the lower half of the window is peeled first, down to single depths. So a
trie of depth m takes about SINGLE + log2(m) rounds.

Defined cases: a null role or text is empty. Turns are ordered by turn (null
first), turns of equal number by their digest; repeated rows are turns each. Rows
without conv_id belong to no conversation and are left out. A conversation without
turns is a member of the root. An empty table has no node, not even a root. Texts
of any length are digested where they are read; of a turn 32 bytes and a length go
on, and these are held by one row per conversation. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diamondlap.llm.graph import small
from diamondlap.sources.staging import stage

SINGLE = 8
GROUP_BYTES, GROUP_ROWS = 32 << 20, 16  # a group of more of both is peeled by smaller windows
CHUNK = 50_000  # ids digested at once
HOT_CHILDREN = 1_000
ROOT = b""
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
PATH = "keys array<binary>, chars array<bigint>"
NODE = "key binary, parent binary, depth int, conv_id bigint, " + ", ".join(f"{c} bigint" for c in SUMS)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and turns array<struct<digest, chars>>, in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("turns"))
    return held.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def with_shared_heads(talks: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversation c gets, for its first h turns, those of conversation c - c % every; h = crc32(c) % most."""
    own, key = F.col("turns"), F.col("conv_id")
    heads = talks.where(key % every == 0).select(key.alias("host"), F.slice(own, 1, most - 1).alias("head"))
    h = (F.crc32(key.cast("string")) % most).cast("int")
    rest = F.slice(own, h + 1, F.greatest(F.size(own) - h, F.lit(0)))
    none = F.slice(own, 1, 0)
    return talks.join(heads, key - key % every == F.col("host"), "left").select(
        "conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), h), none), rest).alias("turns")
    )


def chained(talks: DataFrame) -> DataFrame:
    """conv_id, depth, keys and chars of all prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column(1)
            items = turns.flatten()
            sizes = np.diff(np.asarray(turns.offsets))
            digests, keys = items.field("digest").to_pylist(), []
            at = 0
            for n in sizes:
                key = ROOT
                for digest in digests[at : at + n]:
                    key = hashlib.sha256(key + digest).digest()
                    keys.append(key)
                at += n
            bounds = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(bounds, pa.array(keys, pa.binary())),
                 pa.ListArray.from_arrays(bounds, items.field("chars"))], names=["conv_id", "depth", "keys", "chars"],
            )

    return talks.select("conv_id", "turns").mapInArrow(run, f"conv_id bigint, depth int, {PATH}")


def leaf_key() -> Column:
    return F.coalesce(F.try_element_at("keys", F.lit(-1)), F.lit(bytearray(ROOT)))


def _sum(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, groups, values)
    return out


def peel_rows(rows: pa.Table, low: int) -> pa.Table:
    """Nodes (key) of all depths above `low` of rows that are closed under equal keys, and what survives at depth `low` (keys)."""
    rows = rows.combine_chunks()
    depth = rows["depth"].to_numpy()
    start = np.concatenate(([0], np.cumsum(depth[:-1], dtype=np.int64)))
    coded = rows["keys"].chunk(0).flatten().dictionary_encode()
    names, code = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    length = np.asarray(rows["chars"].chunk(0).flatten())
    given = {c: rows[c].to_numpy() for c in ("conv_id", *SUMS)}
    empty = np.zeros(0, np.int64)
    live, path = {c: empty for c in given}, empty
    nodes = []
    for d in range(int(depth.max()), low, -1):
        ended = np.flatnonzero(depth == d)
        live = {c: np.concatenate((live[c], given[c][ended])) for c in live}
        path = np.concatenate((path, ended))
        own, first, group = np.unique(code[start[path] + d - 1], return_index=True, return_inverse=True)
        n, path = len(own), path[first]
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, group, live["conv_id"])
        convs, children, leaves, saved = (_sum(group, live[c], n) for c in SUMS)
        leaves = np.where(children == 0, 1, leaves)
        saved = saved + (convs - 1) * length[start[path] + d - 1]
        parent = names.take(pa.array(code[start[path] + d - 2])) if d > 1 else pa.array([ROOT] * n, pa.binary())
        nodes.append([names.take(pa.array(own)), parent, pa.array(np.full(n, d, np.int32)), *(pa.array(x) for x in (least, convs, children, leaves, saved))])
        live = dict(zip(live, (least, convs, np.ones(n, np.int64), leaves, saved)))
    columns = ["key", "parent", "depth", "conv_id", *SUMS]
    found = pa.concat_tables([pa.table(x, names=columns) for x in nodes])
    none = pa.nulls(found.num_rows, pa.list_(pa.binary())), pa.nulls(found.num_rows, pa.list_(pa.int64()))
    found = found.append_column("keys", none[0]).append_column("chars", none[1])
    m = len(path)
    cut = np.arange(m + 1, dtype=np.int32) * low
    at = pa.array((start[path][:, None] + np.arange(low)).ravel(), pa.int64())
    left = pa.table(
        [pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(np.full(m, low, np.int32)), *(pa.array(live[c]) for c in ("conv_id", *SUMS)),
         pa.ListArray.from_arrays(pa.array(cut), names.take(pa.array(code)).take(at)), pa.ListArray.from_arrays(pa.array(cut), pa.array(length).take(at))],
        names=[*columns, "keys", "chars"],
    )
    return pa.concat_tables([found, left])


def closed_tables(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches cut so that no table ends within a run of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key)
        change = np.flatnonzero(np.asarray(pc.not_equal(values.slice(1), values.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)))
        if held and values[0] != held[-1].column(key)[held[-1].num_rows - 1]:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _peel_tasks(rows: DataFrame, low: int) -> DataFrame:
    """peel_rows() of each group of equal keys at depth low + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in closed_tables(batches, "top"):
            yield from peel_rows(table, low).combine_chunks().to_batches()

    dealt = rows.repartition("top").sortWithinPartitions("top")
    return stage(dealt.mapInArrow(run, f"{NODE}, {PATH}"), "peeled")


def _rows(df: DataFrame) -> DataFrame:
    return df.select("depth", "conv_id", *SUMS, "keys", "chars")


def _peel_one(rows: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of one depth and what survives of them, by an aggregation."""
    merged = rows.groupBy(F.get("keys", F.lit(depth - 1)).alias("key")).agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in SUMS), F.first("keys").alias("keys"), F.first("chars").alias("chars")
    )
    merged = merged.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")))
    merged = merged.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.get("chars", F.lit(depth - 1)))
    found = stage(merged.select("*", F.lit(depth).alias("depth")), "depth")
    parent = F.get("keys", F.lit(depth - 2)) if depth > 1 else F.lit(bytearray(ROOT))
    nodes = found.select("key", parent.alias("parent"), "depth", "conv_id", *SUMS)
    left = found.withColumns({
        "depth": F.lit(depth - 1), "n_children": F.lit(1).cast("long"), "keys": F.slice("keys", 1, depth - 1), "chars": F.slice("chars", 1, depth - 1),
    })
    return [nodes], _rows(left)


def peel(rows: DataFrame, low: int, high: int, group_bytes: int = GROUP_BYTES, group_rows: int = GROUP_ROWS) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the nodes of depths low + 1 .. high, and what survives at depth low, from rows of these depths."""
    if high - low == 1:
        return _peel_one(rows, high)
    rows = rows.withColumn("top", F.get("keys", F.lit(low)))
    sizes = rows.groupBy("top").agg(F.count("*").alias("rows"), F.sum(F.size("keys") * 40).alias("bytes"))
    hot = stage(sizes.where((F.col("bytes") > group_bytes) & (F.col("rows") > group_rows)).select("top"), "hot")
    if hot.isEmpty():
        done = _peel_tasks(rows, low)
        return [done.where("key is not null").select("key", "parent", "depth", "conv_id", *SUMS)], _rows(done.where("key is null"))
    hot, middle = small(hot), (low + high) // 2
    done = _peel_tasks(rows.join(hot, "top", "left_anti"), low)
    large = stage(_rows(rows.join(hot, "top", "left_semi")), "large")
    lower, left = peel(large.where(F.col("depth") > middle), middle, high, group_bytes, group_rows)
    upper, left = peel(left.unionByName(large.where(F.col("depth") <= middle)), low, middle, group_bytes, group_rows)
    nodes = done.where("key is not null").select("key", "parent", "depth", "conv_id", *SUMS)
    return [nodes, *lower, *upper], _rows(done.where("key is null")).unionByName(left)


def ends(paths: DataFrame) -> DataFrame:
    """key and ends_sha256: the digest of the ids, in ascending order, of the conversations that end at a node.

    Ids are sorted by range over all tasks and joined to chunks there; what one task reads of a node are its chunks.
    """

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1).to_pylist()
            runs = pc.run_end_encode(keys)
            begin, out = 0, []
            for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                out += [(key, ids[k], ",".join(map(str, ids[k : min(k + CHUNK, end)]))) for k in range(begin, end, CHUNK)]
                begin = end
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["key", "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    rows = paths.select(leaf_key().alias("key"), "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = rows.mapInArrow(chunked, "key binary, first bigint, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digested, "key binary, ends_sha256 string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id; those with very many children are sent to them, so that these stay where they are."""
    large = F.col("n_children") > HOT_CHILDREN
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = small(stage(parents.where(large).drop("n_children"), "hot"))
    cold = parents.where(~large).drop("n_children")
    rest = nodes.join(hot, "parent", "left_anti")
    return nodes.join(hot, "parent").unionByName(rest.join(cold, "parent", "left"), allowMissingColumns=True)


def build_trie(talks: DataFrame, single: int = SINGLE, group_bytes: int = GROUP_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per node of talks(conv_id, turns), whose conv_ids are distinct: conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = stage(chained(talks), "paths")
    ended = stage(
        paths.groupBy(leaf_key().alias("leaf")).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"), F.first("keys").alias("keys"),
            F.first("chars").alias("chars"), *(F.lit(0).cast("long").alias(c) for c in SUMS[1:]),
        ).drop("leaf"), "ended",
    )
    high = ended.agg(F.max("depth")).first()[0]
    found, left = [], None
    while high:
        low = high - 1
        if high > single:
            low = single
            while low * 2 < high:
                low *= 2
        here = _rows(ended.where((F.col("depth") > low) & (F.col("depth") <= high)))
        tables, left = peel(here if left is None else left.unionByName(here), low, high, group_bytes, group_rows)
        found += tables
        high = low
    at_root = _rows(ended.where("depth = 0"))
    at_root = at_root if left is None else left.unionByName(at_root)
    root = at_root.agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in SUMS)).where("conv_id is not null")
    nodes = root.select(
        F.lit(bytearray(ROOT)).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"), "conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"), "saved_tokens",
    )
    for table in found:
        nodes = nodes.unionByName(table)
    nodes = stage(nodes, "nodes")
    return with_parents(nodes).join(ends(paths), "key", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *SUMS,
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )

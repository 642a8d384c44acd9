"""Exact duplicates, by a minimal perfect hash over the digests of a history.

Texts are equal if they are after lower-casing A-Z; their SHA-256 stands for
them. The distinct digests of the history are dealt over shards. A shard is one
row of the index: a minimal perfect hash (bit arrays, level by level: a digest
that falls alone on a bit of a level has that bit's rank as its slot, the others
go on to the next level) and, slot by slot, the whole digest, the locator of the
row that stays (doc_id and row number) and how many rows there are. What arrives
is first aggregated by digest, so a text that a third of all rows share costs one
row per input task; then each shard looks its arrivals up. A slot counts only if
its digest is the same in all 32 bytes. Members join the group of their slot;
the others make up groups of their own.

The answer goes back to the rows by digest; digests of very large groups are
broadcast (at most HOT_GROUPS of them), so their rows stay where they are.

Defined cases: a null text is empty. Of equal texts the row with the largest
doc_id stays (a null one is the least), of several such rows the last one, so
every group keeps exactly one row, however often a row is repeated. Rows without
doc_id are documents like others. Very long texts are digested where they are
read and never moved. An empty table gives no rows, an empty history an index
without shards. Other columns are not read by find_repeats(); drop_repeats()
keeps them as they are, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diamondlap.llm.names import free_names
from diamondlap.llm.text import BASE, mix
from diamondlap.sources.staging import stage

SHARD = 1 << 16  # digests of a shard, about
SPREAD = 2.0  # bits of a level for each digest that reaches it
LEAST_BITS = 64
MOST_LEVELS = 200  # only equal digests stay together so long
HOT_ROWS, HOT_GROUPS = 1_000, 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), 256))


def shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def _places(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    own = np.uint64((level + 1) * int(BASE) % 2**64)
    return (mix(words[:, level % 4] + own) % np.uint64(bits)).astype(np.int64)


def perfect_hash(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The levels' bits, and the slot of each key: 0 .. keys-1, each once."""
    slots, levels, left, used = np.zeros(len(words), np.int64), [], np.arange(len(words)), 0
    while len(left):
        if len(levels) == MOST_LEVELS:
            raise ValueError("digests of a history must be distinct")
        bits = max(LEAST_BITS, int(SPREAD * len(left)))
        at = _places(words[left], len(levels), bits)
        once = np.bincount(at, minlength=bits) == 1
        alone = once[at]
        slots[left[alone]] = used + (np.cumsum(once) - 1)[at[alone]]
        used += int(once.sum())
        levels.append(once)
        left = left[~alone]
    return levels, slots


def look_up(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """The slot where each key would be, -1 if it is certainly none."""
    out, left, used = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, once in enumerate(levels):
        at = _places(words[left], level, len(once))
        hit = once[at]
        out[left[hit]] = used + (np.cumsum(once) - 1)[at[hit]]
        used += int(once.sum())
        left = left[~hit]
    return out


def numbered(docs: DataFrame, history: Column) -> DataFrame:
    """row, doc_id, digest and whether the row is of the history, written once."""
    return stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", digest_of(F.col("text")).alias("digest"),
            F.coalesce(history, F.lit(False)).alias("old"),
        ), "digests",
    )


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: locator of the row that stays (doc_id, row) and size."""
    best = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("size"))
    return best.select("digest", "best.doc_id", "best.row", "size")


def _later(a: tuple, b: tuple) -> bool:
    """Whether locator a (doc_id, row) comes after b; a null doc_id is the least."""
    if (a[0] is None) != (b[0] is None):
        return b[0] is None
    return a > b if a[0] is not None else a[1] > b[1]


def build_index(found: DataFrame, shards: int) -> DataFrame:
    """One row per shard from found(digest, doc_id, row, size), whose digests are distinct."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        digests = rows["digest"].to_pylist()
        levels, slots = perfect_hash(_words(digests))
        order = pa.array(np.argsort(slots))
        held = {c: [rows[c].take(order).to_pylist()] for c in ("doc_id", "row", "size")}
        return pa.table(
            {
                "shard": rows["shard"].slice(0, 1), "n_bits": [[len(b) for b in levels]], "bits": [[np.packbits(b).tobytes() for b in levels]],
                "digests": [b"".join(rows["digest"].take(order).to_pylist())],
                "ids": pa.array(held["doc_id"], pa.list_(rows.schema.field("doc_id").type)), "rows": held["row"], "sizes": held["size"],
            }
        )

    schema = f"shard int, n_bits array<bigint>, bits array<binary>, digests binary, ids array<{kind}>, rows array<bigint>, sizes array<bigint>"
    return found.withColumn("shard", shard_of(F.col("digest"), shards)).groupBy("shard").applyInArrow(build, schema)


def merge(index: DataFrame, arrived: DataFrame, shards: int) -> DataFrame:
    """One row per digest of the index or of arrived(digest, doc_id, row, size): locator of the row
    that stays, size, and `member`, whether the index held the digest."""
    kind = arrived.schema["doc_id"].dataType.simpleString()

    def probe(shard: pa.Table, new: pa.Table) -> pa.Table:
        new = new.combine_chunks()
        id_type = new.schema.field("doc_id").type
        columns = {c: new[c].to_pylist() for c in ("digest", "doc_id", "row", "size")}
        members = np.zeros(new.num_rows, bool)
        if shard.num_rows:
            own = shard.to_pylist()[0]
            levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(own["bits"], own["n_bits"])]
            held = [own["digests"][k : k + 32] for k in range(0, len(own["digests"]), 32)]
            seen = np.zeros(len(held), bool)
            for i, slot in enumerate(look_up(levels, _words(columns["digest"]))):
                if slot >= 0 and held[slot] == columns["digest"][i]:  # all bytes
                    members[i] = seen[slot] = True
                    before, now = (own["ids"][slot], own["rows"][slot]), (columns["doc_id"][i], columns["row"][i])
                    if _later(before, now):
                        columns["doc_id"][i], columns["row"][i] = before
                    columns["size"][i] += own["sizes"][slot]
            rest = np.flatnonzero(~seen)
            columns["digest"] += [held[k] for k in rest]
            for c, name in (("doc_id", "ids"), ("row", "rows"), ("size", "sizes")):
                columns[c] += [own[name][k] for k in rest]
            members = np.concatenate((members, np.ones(len(rest), bool)))
        return pa.table(
            [pa.array(columns["digest"], pa.binary()), pa.array(columns["doc_id"], id_type), pa.array(columns["row"], pa.int64()),
             pa.array(columns["size"], pa.int64()), pa.array(members)], names=["digest", "doc_id", "row", "size", "member"],
        )

    new = arrived.withColumn("shard", shard_of(F.col("digest"), shards))
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(probe, f"digest binary, doc_id {kind}, row bigint, size bigint, member boolean")


def judged(docs: DataFrame, history: Column, shard: int = SHARD) -> DataFrame:
    """row, doc_id, digest of every row, and keep_id, group_size, kept, member."""
    rows = numbered(docs, history)
    old, new = stage(grouped(rows.where("old")), "history"), stage(grouped(rows.where("not old")), "arrived")
    shards = max(1, math.ceil(max(old.count(), new.count()) / shard))
    index = stage(build_index(old, shards), "index")
    groups = stage(merge(index, new, shards).select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("size").alias("group_size"), "member"), "groups")
    large = F.col("group_size") > max(HOT_ROWS, rows.count() // HOT_GROUPS)  # so there are at most HOT_GROUPS of them
    hot, rows = F.broadcast(groups.where(large)), rows.drop("old")
    out = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(groups.where(~large), "digest"))
    return out.withColumn("kept", F.col("row") == F.col("keep_row")).drop("keep_row")


def earlier_half(docs: DataFrame) -> Column:
    """Whether doc_id lies in the lower half of the range of ids: these rows came first. Ids that are no numbers have no such half."""
    if not isinstance(docs.schema["doc_id"].dataType, T.NumericType):
        return F.lit(False)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.lit(False) if low is None else F.col("doc_id") <= F.lit(low + (high - low) // 2)


def find_repeats(docs: DataFrame, history: Column | None = None, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 and member (the history held the text).

    history says which rows are the history, by default the earlier half; the groups do not depend on it.
    """
    found = judged(docs, earlier_half(docs) if history is None else history, shard)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"), "member")


def drop_repeats(docs: DataFrame, history: Column | None = None, shard: int = SHARD) -> DataFrame:
    """The documents that stay, with all their columns as they are."""
    digest, count = free_names(docs, "digest", "count")
    stays = judged(docs, earlier_half(docs) if history is None else history, shard).where("kept")
    stays = stays.select(F.col("doc_id").alias("stays_id"), F.col("digest").alias("stays_digest"))
    same = (F.col(digest) == F.col("stays_digest")) & F.col("doc_id").eqNullSafe(F.col("stays_id"))
    kept = docs.withColumn(digest, digest_of(F.col("text"))).join(stays, same, "left_semi")
    again = stage(kept.groupBy("doc_id", digest).agg(F.count("*").alias(count)).where(F.col(count) > 1).select(F.col("doc_id").alias("stays_id"), F.col(digest).alias("stays_digest")), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    row = F.struct(*docs.columns)
    one = kept.join(again, same, "left_semi").groupBy("doc_id", digest).agg(F.min_by(row, F.to_json(row)).alias(count)).select(f"{count}.*")
    return kept.join(again, same, "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))

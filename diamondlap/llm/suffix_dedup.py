"""Byte strings that repeat, within and across documents, found by suffix arrays.

Texts are cut into segments by content (segments.py), so that equal strings of
`length` bytes lie at the same place of segments with the same owner. An owner
that occurs once holds nothing repeated. Where all segments of an owner are
equal, or a segment occurs twice, all its strings are repeated. Only the
distinct segments of the other owners are compared byte by byte: dealt by owner
into shards, each shard sorts its suffixes by prefix doubling, refining only
groups that are still tied (Larsson and Sadakane), takes common prefixes of
neighbours in text order (Kasai), and marks windows that share `length` bytes. An
owner with more than SHARD segments is dealt over several shards; each gives the
sorted digests of its distinct strings, in as many ranges as there are shards, and
the digests of a range are looked up among those of all shards by binary search,
so the work stays in proportion to the strings.

Overlapping occurrences count, and strings are judged on the input. Each byte of
a repeated string is removed.

Defined cases: a null text is empty. Texts shorter than `length` have no window
and lose nothing. Repeated rows are occurrences of their strings like any others
and get equal results. An empty table gives no rows. Other columns are not read.
Equal hashes (64 bits, of owner and segment together 128) count as equal content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diamondlap.llm.graph import groups, hot_limit
from diamondlap.llm.segments import segments
from diamondlap.llm.text import byte_slices, prefix_hash, span_hash
from diamondlap.sources.staging import stage

LENGTH = 200
GRAM = 48
SHARD = 1_024  # segments of one owner in one shard
SORTED_BYTES = 1_000_000  # of whole shards, sorted together
RUNS_BROADCAST, SEGMENTS_BROADCAST = 2_000_000, 1_000_000  # of 16 and 40 bytes
SLICE = 1_000_000


class SuffixArray:
    """Suffixes of data in the order of their first `length` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.length, n = length, len(data)
        padded = np.concatenate((data, np.zeros(length + 8, np.uint8)))
        self.words = np.zeros(n + length, np.uint64)  # the eight bytes from each position, first byte highest
        for k in range(8):
            self.words = (self.words << np.uint64(8)) | padded[k : k + n + length]
        first = min(8, length)
        key = self.words[:n] >> np.uint64(64 - 8 * first)
        self.order = np.argsort(key, kind="stable")
        self.rank = np.empty(n + length, np.int64)  # place of the first suffix of its group
        self.rank[n:] = -1 - np.arange(length)  # past the end: each its own
        self._number(np.arange(n), key[self.order])
        done = first
        while done < length:
            shift = min(done, length - done)
            self._refine(shift)
            done += shift

    def _number(self, places: np.ndarray, keys: np.ndarray) -> None:
        """New ranks of the suffixes at these places of the order, which are sorted by keys."""
        new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        start = places[np.flatnonzero(new)]
        self.rank[self.order[places]] = start[np.cumsum(new) - 1]

    def _refine(self, shift: int) -> None:
        n = len(self.order)
        ranks = self.rank[self.order]
        tied = np.zeros(n, bool)
        same = ranks[1:] == ranks[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        places = np.flatnonzero(tied)
        own = self.order[places]
        key = self.rank[own] * (n + self.length + 1) + self.rank[own + shift] + self.length + 1
        sort = np.argsort(key, kind="stable")
        self.order[places] = own[sort]
        self._number(places, key[sort])

    def common(self, stride: int = 64) -> np.ndarray:
        """Bytes, `length` at most, that each suffix shares with the one before it in order; by position.

        Kasai: a suffix shares at least one byte less than the suffix one position
        before it does, as long as the one before that, also moved on, still is
        before it in order, which the cut at `length` bytes may change. Every
        stride-th position goes on at once.
        """
        n = len(self.order)
        before = np.full(n, -1, np.int64)
        before[self.order[1:]] = self.order[:-1]
        out = np.zeros(n, np.int64)
        for s in range(min(stride, n)):
            at = np.arange(s, n, stride)
            at = at[before[at] >= 0]
            other = before[at]
            held = np.zeros(len(at), np.int64)
            if s:
                still = (before[at - 1] >= 0) & (self.rank[before[at - 1] + 1] <= self.rank[at])
                held[still] = np.maximum(out[at[still] - 1] - 1, 0)
            going = np.arange(len(at))
            while len(going):
                here = held[going]
                differ = self.words[at[going] + here] ^ self.words[other[going] + here]
                equal = np.full(len(going), 8)
                for k in range(8):
                    equal[(differ >> np.uint64(56 - 8 * k)) != 0] = np.minimum(equal[(differ >> np.uint64(56 - 8 * k)) != 0], k)
                held[going] = np.minimum(here + equal, self.length)
                going = going[(equal == 8) & (held[going] < self.length)]
            out[at] = held
        return out

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each suffix shares `length` bytes with another, and whether it is the first of those in order."""
        shares = self.common()[self.order] >= self.length
        first = np.empty(len(shares), bool)
        many = np.empty(len(shares), bool)
        first[self.order] = ~shares
        many[self.order] = shares | np.concatenate((shares[1:], [False]))
        return many, first


def text_key() -> Column:
    return F.xxhash64("doc_id", "text")


def cut_texts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per segment: key of the document, first window, windows, owner, segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for first, texts in byte_slices(batch.column(1), SLICE):
                found = segments(texts, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[first + found.text]), pa.array(found.first.astype(np.int64)), pa.array(found.windows.astype(np.int32)),
                        pa.array(found.owner.view(np.int64)), pa.array(found.segment.view(np.int64)),
                    ],
                    names=["key", "first", "windows", "owner", "segment"],
                )

    return docs.select("key", "text").mapInArrow(run, "key bigint, first bigint, windows int, owner bigint, segment bigint")


def cut_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted segments; wanted has a list of them for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            fields = {f.name: flat.field(k) for k, f in enumerate(flat.type)}
            first, windows = np.asarray(fields["first"]), np.asarray(fields["windows"])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            raw, text, last = [], b"", -1
            for row, a, m in zip(owner, first, windows):
                if row != last:
                    text, last = batch.column(0)[int(row)].as_buffer().to_pybytes(), row
                raw.append(text[a : a + m + length - 1])
            yield pa.RecordBatch.from_arrays(
                [fields["owner"], fields["segment"], fields["n"], batch.column(2).take(pa.array(owner)), fields["first"], fields["windows"], pa.array(raw, pa.binary())],
                names=["owner", "segment", "n", "key", "first", "windows", "raw"],
            )

    found = docs.select("key", "text").join(wanted, "key").select("text", "list", "key")
    return found.mapInArrow(run, "owner bigint, segment bigint, n bigint, key bigint, first bigint, windows int, raw binary")


MARKS = "owner bigint, range int, key bigint, first bigint, windows bigint, strings binary"  # a run, or a shard's strings
STRINGS = np.dtype([("digest", np.uint64), ("key", np.int64), ("first", np.int64), ("single", np.int64)])


def compare_bytes(rows: DataFrame, length: int) -> DataFrame:
    """MARKS of segments dealt by owner and part."""

    def marks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        raw = rows.column("raw").to_pylist()
        sizes = np.array([len(r) for r in raw])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(raw), np.uint8)
        many, first = SuffixArray(data, length).repeated()
        windows = np.asarray(rows.column("windows")).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), windows)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        # A suffix that is not a window may begin past its segment's last one and share bytes with the next segment's.
        at = starts[row] + offset
        inside = np.zeros(len(data), bool)
        inside[at] = True
        if not inside[many].all():
            many, first = _among(data, at, length)
        else:
            many, first = many[at], first[at]
        once = np.asarray(rows.column("n")) == 1  # the others are repeated as a whole
        key, base = np.asarray(rows.column("key")), np.asarray(rows.column("first"))
        hit = many & once[row]
        begin = hit.copy()
        begin[1:] &= ~(hit[:-1] & (row[1:] == row[:-1]))
        heads, total = np.flatnonzero(begin), np.cumsum(hit)
        ends = np.append(heads[1:], len(hit))
        run = total[ends - 1] - total[heads] + 1 if len(heads) else heads
        if len(heads):
            none = pa.nulls(len(heads))
            yield pa.RecordBatch.from_arrays(
                [none.cast(pa.int64()), none.cast(pa.int32()), pa.array(key[row[heads]]), pa.array(base[row[heads]] + offset[heads]), pa.array(run), none.cast(pa.binary())],
                names=names,
            )
        parts, owner = np.asarray(rows.column("parts")), np.asarray(rows.column("owner"))
        if (parts > 1).any():
            tells = np.flatnonzero((parts[row] > 1) & first)  # one window of each distinct string
            at, row, offset = at[tells], row[tells], offset[tells]
            strings = np.empty(len(tells), STRINGS)
            strings["digest"] = span_hash(prefix_hash(data.astype(np.uint64) + np.uint64(1)), at, at + length)
            strings["key"], strings["first"], strings["single"] = key[row], base[row] + offset, ~many[tells] & once[row]
            place = (strings["digest"] >> np.uint64(32)).astype(np.int64) * parts[row] >> 32
            order = np.lexsort((strings["digest"], place, owner[row]))
            strings, place, owner = strings[order], place[order], owner[row][order]
            bounds = np.flatnonzero((owner[1:] != owner[:-1]) | (place[1:] != place[:-1])) + 1
            for a, b in zip([0, *bounds], [*bounds, len(strings)]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([owner[a]]), pa.array([place[a]], pa.int32()), *[pa.nulls(1, pa.int64())] * 3, pa.array([strings[a:b].tobytes()], pa.binary())], names=names
                )

    names = [c.split()[0] for c in MARKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, first, end in groups(batches, ("owner", "part"), least=1):
            own = batch.slice(first, end - first)
            segment = np.asarray(own.column("segment"))
            once = np.concatenate(([True], segment[1:] != segment[:-1]))
            if not once.all():
                own = own.filter(pa.array(once))
            held.append(own)
            size += own.column("raw").nbytes
            if size >= SORTED_BYTES:
                yield from marks(held)
                held, size = [], 0
        if held:
            yield from marks(held)

    return rows.mapInArrow(run, MARKS)


def _among(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """As SuffixArray.repeated(), but only the suffixes at `at` count."""
    suffixes = SuffixArray(data, length)
    place = np.full(len(data), -1, np.int64)
    place[at] = np.arange(len(at))
    own = place[suffixes.order]
    rank = suffixes.rank[suffixes.order][own >= 0]
    own = own[own >= 0]
    same = rank[1:] == rank[:-1]
    many, first = np.zeros(len(at), bool), np.ones(len(at), bool)
    many[own[1:][same]] = True
    many[own[:-1][same]] = True
    first[own[1:][same]] = False
    return many, first


def merge_shards(marks: DataFrame) -> DataFrame:
    """Windows whose string another shard of the same owner has as well: key, first, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b in groups(batches, ("owner", "range")):
            strings = np.frombuffer(b"".join(batch.column(2).slice(a, b - a).to_pylist()), STRINGS)
            digests = np.sort(strings["digest"], kind="stable")  # of runs that are sorted already
            count = np.searchsorted(digests, strings["digest"], "right") - np.searchsorted(digests, strings["digest"], "left")
            hit = strings[(count > 1) & (strings["single"] == 1)]  # a shard gives each string once
            if len(hit):
                columns = [pa.array(np.ascontiguousarray(hit[c])) for c in ("key", "first")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.ones(len(hit), np.int64))], names=["key", "first", "windows"])

    rows = marks.where("strings is not null").select("owner", "range", "strings")
    rows = rows.repartition("owner", "range").sortWithinPartitions("owner", "range")
    return rows.mapInArrow(run, "key bigint, first bigint, windows bigint")


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """key and the byte runs (starts, ends) of its text to be removed, for documents that have any."""
    cut = cut_texts(docs, length, gram)
    owners = cut.groupBy("owner").agg(F.count("*").alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high"))
    owners = stage(owners.where("n > 1").select("owner", (F.col("low") == F.col("high")).alias("pure")), "owners")
    again = stage(cut.join(owners, "owner"), "again")
    mixed = again.where(~F.col("pure"))
    distinct = mixed.groupBy("owner", "segment").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("key", "first", "windows")))
    distinct = stage(distinct, "distinct")
    hot = stage(distinct.groupBy("owner").count().where(F.col("count") > shard).select("owner", F.ceil(F.col("count") / shard).cast("int").alias("parts")), "hot")
    wanted = stage(distinct.groupBy("key").agg(F.collect_list(F.struct("owner", "segment", "n", "first", "windows")).alias("list")), "wanted")
    wanted = F.broadcast(wanted) if distinct.count() <= SEGMENTS_BROADCAST else wanted
    shards = cut_bytes(docs, wanted, length).join(hot, "owner", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    shards = shards.withColumn("part", F.pmod(F.xxhash64("segment"), F.col("parts")).cast("int"))
    marks = stage(compare_bytes(shards.repartition("owner", "part").sortWithinPartitions("owner", "part", "segment"), length), "marks")
    repeated = distinct.where("n > 1").select("owner", "segment", "n")
    hot_ones = F.broadcast(repeated.where(F.col("n") > hot_limit(again.count())).drop("n"))  # their rows stay where they are
    both = ["owner", "segment"]
    copies = mixed.join(hot_ones, both, "left_semi").unionByName(mixed.join(hot_ones, both, "left_anti").join(repeated, both, "left_semi"))
    runs = (
        again.where("pure").select("key", "first", F.col("windows").cast("long"))
        .union(copies.select("key", "first", F.col("windows").cast("long")))
        .union(marks.where("strings is null").select("key", "first", "windows"))
        .union(merge_shards(marks))
    )
    listed = runs.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("first", "windows"))).alias("list"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets)
            flat = lists.flatten()
            first, windows = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            end = first + windows + (length - 1)
            starts, ends = [], []
            for a, b in zip(offsets - offsets[0], offsets[1:] - offsets[0]):
                reach = np.maximum.accumulate(end[a:b])
                new = np.concatenate(([True], first[a + 1 : b] > reach[:-1]))
                head = np.flatnonzero(new)
                starts.append(first[a:b][head])
                ends.append(reach[np.append(head[1:], b - a) - 1])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, kind), pa.array(ends, kind)], names=["key", "starts", "ends"])

    return listed.mapInArrow(merge, "key bigint, starts array<bigint>, ends array<bigint>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, text and the byte runs of every document that are to be removed."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", text_key())
    runs = stage(repeated_runs(docs, length, gram, shard), "runs")
    size = runs.agg(F.sum(F.size("starts"))).first()[0] or 0
    runs = F.broadcast(runs) if size <= RUNS_BROADCAST else runs
    return docs.join(runs, "key", "left").select("doc_id", "text", "starts", "ends")


def digests(found: DataFrame) -> DataFrame:
    """Bytes, removed bytes, removed runs and the digest of what is kept, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, ends in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                starts, ends = starts or [], ends or []
                digest = hashlib.sha256()
                for a, b in zip([0, *ends], [*starts, len(raw)]):
                    digest.update(raw[a:b])
                out.append((len(raw), sum(ends) - sum(starts), len(starts), digest.hexdigest()))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))] if out else None
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")

"""URL rules looked up in a sorted array of 64-bit digests.

A rule is a host and a path beginning. It fits urls of its host and of all
subdomains whose path starts with the rule's; of several rules the one with the
longest string wins (of equal ones the longer host, of one rule given twice the
blocking). Each task maps the sorted digests of the rules into memory from an
unlinked file, looks up all (host suffix, path beginning) pairs of a batch of
urls by one binary search, and compares the stored string of every digest found,
so that a collision cannot match.

The rules go to the executors in blocks of at most BLOCK_BYTES, as many blocks
as their measured size needs; every url meets every block.

Defined cases: a null url or one without `://` has an empty host and path and
fits no rule. A url that no rule fits gets the default verdict. Null or empty
rule hosts are left out, a null rule path is empty. Repeated rows are judged
each. Of a very long url all suffixes and beginnings that a rule may have are looked up.
An empty table gives no rows. Columns other than page_id and url are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diamondlap.sources.staging import stage

BLOCK_BYTES = 64 << 20
BLOCKS_A_PASS = 8  # blocks applied before the rows are written
RULE = "host string, path string, verdict string"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


class Block(NamedTuple):
    """Rules sorted by digest; strings are host, a zero byte and path."""

    digests: bytes
    strings: list[str]
    verdicts: list[str]
    path_lengths: list[int]
    longest_host: int


def _key(host: str, path: str) -> str:
    return f"{host}\0{path}"


def _block(rows: list) -> Block:
    rules: dict[str, str] = {}
    for r in rows:
        key = _key(r["host"], r["path"])
        rules[key] = "block" if "block" in (r["verdict"], rules.get(key)) else r["verdict"]
    order = sorted((xxhash.xxh64_intdigest(k), k) for k in rules)
    return Block(
        np.array([d for d, _ in order], np.uint64).tobytes(), [k for _, k in order], [rules[k] for _, k in order],
        sorted({len(k.partition("\0")[2]) for k in rules}), max((len(k.partition("\0")[0]) for k in rules), default=0),
    )


def blocks(rules: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    rules = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").where(F.col("host") != "")
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    count = -(-size // limit) or 1
    for k in range(count):
        yield _block(rules.where(F.pmod(F.xxhash64("host", "path"), F.lit(count)) == k).collect())


def candidates(host: str, path: str, block: Block) -> list[str]:
    """Every (host suffix, path beginning) that a rule of this block could be, no longer than its rules."""
    if not host:
        return []
    suffixes, at = [], len(host)
    while True:
        at = host.rfind(".", 0, at)
        if len(host) - at - 1 > block.longest_host:
            break
        suffixes.append(host[at + 1 :])
        if at < 0:
            break
    return [_key(h, path[:n]) for n in block.path_lengths if n <= len(path) for h in suffixes]


def find(keys: list[str], digests: np.ndarray, block: Block) -> np.ndarray:
    """Row of each key among the rules, -1 if it is none."""
    wanted = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
    at = np.searchsorted(digests, wanted)
    out = np.full(len(keys), -1, np.int64)
    for i in np.flatnonzero((at < len(digests)) & (digests[np.minimum(at, len(digests) - 1)] == wanted) if len(digests) else []):
        row = at[i]
        while row < len(digests) and digests[row] == wanted[i]:  # past keys that only share the digest
            if block.strings[row] == keys[i]:
                out[i] = row
                break
            row += 1
    return out


def _apply(urls: DataFrame, block: Block) -> DataFrame:
    held = urls.sparkSession.sparkContext.broadcast(block)
    names = urls.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        with tempfile.TemporaryFile() as file:
            file.write(block.digests or b"\0")
            file.flush()
            digests = np.memmap(file, np.uint64, "r", shape=(len(block.strings),)) if block.strings else np.zeros(0, np.uint64)
            for batch in batches:
                columns = {n: batch.column(i).to_pylist() for i, n in enumerate(names) if n in ("host", "path", "rule", "verdict", "rule_host")}
                keys, owner = [], []
                for i, (host, path) in enumerate(zip(columns["host"], columns["path"])):
                    own = candidates(host, path, block)
                    keys += own
                    owner += [i] * len(own)
                for key, i, row in zip(keys, owner, find(keys, digests, block)):
                    if row >= 0:
                        host, _, path = key.partition("\0")
                        best = columns["rule"][i]
                        if best is None or (len(host) + len(path), len(host)) > (len(best), columns["rule_host"][i]):
                            columns["rule"][i], columns["rule_host"][i] = host + path, len(host)
                            columns["verdict"][i] = block.verdicts[row]
                out = [pa.array(columns[n], batch.schema.field(i).type) if n in columns else batch.column(i) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return urls.mapInArrow(judge, urls.schema)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", limit: int = BLOCK_BYTES) -> DataFrame:
    """pages(page_id, url) with host, path, rule and verdict."""
    urls = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("rule_host"),
    )
    urls = urls.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", "verdict", "rule_host")
    for k, block in enumerate(blocks(rules, limit)):
        urls = _apply(stage(urls, "urls") if k and not k % BLOCKS_A_PASS else urls, block)
    return urls.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def example_rules(pages: DataFrame) -> DataFrame:
    """The rules of the registered query."""
    rows = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "verdict")])
    return pages.sparkSession.createDataFrame(rows, schema)

"""Byte-level BPE as a monoid: encodings of halves are joined to that of the whole.

A piece of text (a match of the pre-split pattern) is encoded by halves. Two
neighbouring encodings are joined by encoding anew a window of bytes around the
seam, a few tokens wide on either side. The tokens outside the window stay if
the pairs of tokens at its two borders encode to themselves: an encoding by
ranks is right exactly if each pair of neighbours in it is (the pairs inside the
halves and inside the window are, since those are encodings). Otherwise the
window grows to twice the tokens; at the latest it covers the whole piece, which
is then encoded by plain merging. Decoding concatenates bytes up a tree.

Pieces are encoded separately, so a text's ids are its pieces' ids in a row. A
space between two characters that are not white space always begins a piece, so
texts without longer runs of white space are cut there first. Encodings of such
words and of pieces are kept in tables of bounded size in each worker; dropping
them costs time only.

Defined cases: a null or empty text has no ids. Every text decodes to its own
bytes. Repeated rows are encoded each; an empty table gives no rows. round_trip() reads
no other columns, so one named `ids` does not meet the ids it gives.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF = 24  # bytes encoded by plain merging
SEAM = 3  # tokens on either side of a seam that are encoded anew first
KEPT = 150_000  # encodings that a table keeps at least, and at most twice as many

# White space as the rank files' own library splits it: without the separators 0x1C to 0x1F.
_SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def splitter(pattern: str = public_tokenizers.PATTERN) -> regex.Pattern:
    pattern = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
    return regex.compile(pattern)


class Kept(dict):
    """Results of make(key); when full, those not asked for since the last time are dropped."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) > 64:
            return found
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF, seam: int = SEAM, kept: int = KEPT):
        self.ranks = ranks
        self.split = splitter(pattern)
        self.leaf, self.seam, self.kept = leaf, seam, kept
        self.stable: dict[tuple[bytes, bytes], bool] = {}
        self.pieces = Kept(self._piece, kept)
        self.words = Kept(self._pieces, kept)
        self.spaced = Kept(lambda word: self._pieces(" " + word), kept)
        self.runs = re.compile(f"[{_SPACE}]{{2}}")

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain merging: the pair of lowest rank, the leftmost of equal ones, until none has a rank."""
        if len(piece) > 2 * self.leaf:
            return self._merge_queued(piece)
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2]) for i in range(len(piece) - 1)]
        while True:
            best, at = None, -1
            for i, rank in enumerate(pairs):
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _merge_queued(self, piece: bytes) -> list[bytes]:
        """merge() with the pairs in a queue by rank and place."""
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        queue = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, end = heappop(queue)
            middle = after[i]
            if middle >= n or middle < 0 or after[middle] != end:
                continue  # one of the two is gone or longer by now
            after[i], after[middle] = end, -1
            if end < n:
                before[end] = i
                rank = ranks.get(piece[i : after[end]])
                if rank is not None:
                    heappush(queue, (rank, i, after[end]))
            if i:
                rank = ranks.get(piece[before[i] : end])
                if rank is not None:
                    heappush(queue, (rank, before[i], end))
        parts, i = [], 0
        while i < n:
            parts.append(piece[i : after[i]])
            i = after[i]
        return parts

    def keeps(self, left: bytes, right: bytes) -> bool:
        """Whether these two neighbours encode to themselves."""
        found = self.stable.get((left, right))
        if found is None:
            if len(self.stable) >= self.kept:
                self.stable.clear()
            found = self.stable[left, right] = self.merge(left + right) == [left, right]
        return found

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Encoding of the bytes of left and right together."""
        if not left or not right:
            return left or right
        width = self.seam
        while True:
            head, tail = max(len(left) - width, 0), min(width, len(right))
            if not head and tail == len(right):
                return self.merge(b"".join(left + right)) if not self.keeps(left[-1], right[0]) else left + right
            window = b"".join(left[head:] + right[:tail])
            middle = self.merge(window)
            if (not head or self.keeps(left[head - 1], middle[0])) and (tail == len(right) or self.keeps(middle[-1], right[tail])):
                return left[:head] + middle + right[tail:]
            width *= 2

    def tree(self, piece: bytes) -> list[bytes]:
        if len(piece) <= self.leaf:
            return self.merge(piece)
        middle = len(piece) // 2
        return self.join(self.tree(piece[:middle]), self.tree(piece[middle:]))

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return _packed([whole] if whole is not None else [self.ranks[t] for t in self.tree(raw)])

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if self.runs.search(text):
            return self._pieces(text)
        out, line_end = [], self.pieces["\n"]
        for line in text.split("\n"):
            word, *more = line.split(" ")
            out.append(self.words[word])
            out.extend(map(self.spaced.__getitem__, more))
            out.append(line_end)
        return b"".join(out[:-1])


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {rank: token for token, rank in ranks.items()}

    def decode(self, ids: bytes, leaf: int = 1 << 16) -> bytes:
        """Bytes of the ids: a tree of concatenations with leaves of `leaf` ids."""
        parts = [b"".join(map(self.tokens.__getitem__, _unpacked(ids[i : i + 4 * leaf]))) for i in range(0, len(ids), 4 * leaf)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if _BIG:
        out.byteswap()
    return out.tobytes()


def _unpacked(ids: bytes) -> array:
    out = array("I")
    out.frombytes(ids)
    if _BIG:
        out.byteswap()
    return out


_BIG = array("I", [1]).tobytes()[0] == 0
_encoders: dict[str, tuple[Encoder, Decoder]] = {}


def coder(vocabulary: str) -> tuple[Encoder, Decoder]:
    """Of this worker; a vocabulary is a file that comes with the installed package."""
    if vocabulary not in _encoders:
        ranks = load_ranks(public_tokenizers.path(vocabulary))
        _encoders[vocabulary] = Encoder(ranks), Decoder(ranks)
    return _encoders[vocabulary]


def _texts(column: pa.Array) -> Iterator[str]:
    for scalar in column:
        yield scalar.as_py() or ""


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with column `ids`: the ids of `text` as little-endian 32-bit integers."""
    docs = docs.drop("ids")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = coder(vocabulary)
        for batch in batches:
            ids = pa.array([encoder.encode(t) for t in _texts(batch.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType())]))


def detokenize(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """tokens with column `decoded`: the bytes that `ids` stand for."""
    tokens = tokens.drop("decoded")
    at = tokens.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = coder(vocabulary)
        for batch in batches:
            raw = pa.array([decoder.decode(i.as_py() or b"") for i in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Counts and digests of every document's ids and of the bytes they decode to, and the ids if asked for.

    Encodes and decodes in one pass over the rows, so that the bytes do not leave
    the task.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coder(vocabulary)
        for batch in batches:
            count, of_ids, of_bytes, all_ids = [], [], [], []
            for text in _texts(batch.column(1)):
                ids = encoder.encode(text)
                count.append(len(ids) // 4)
                if with_ids:
                    all_ids.append(ids)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(decoder.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(all_ids, pa.binary())] * with_ids, names=names)

    types = (T.LongType(), T.StringType(), T.StringType(), T.BinaryType())
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in zip(names[1:], types))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)

"""Language identification by rank-order profiles.

A language's profile is the order of its most frequent letter n-grams (one to
three letters, word ends marked) over all its training texts. A text's own most
frequent n-grams are compared to each profile: every n-gram adds the number of
places it is out of, or the full profile length if the profile lacks it. The
nearest profile is the prediction.

An n-gram is its code points in 21 bits each, so n-grams of any scripts stay
apart. Tasks count them in sorted arrays of HELD n-grams at most, Spark adds these
up, and only the profiles reach the driver.

The pipeline keeps a text whose score reaches a share (NEAR) of what is usual for
texts of its language and length: the median over the beginnings of all labelled
texts, cut at PIECES letters. A text is held against the longest piece that is no
longer than itself; one of fewer letters than the shortest must reach MIN_SCORE.

Defined cases: a null text, an empty one or one without letters is `und` with
score 0, and so is every text if nothing could be learned. Equal distances go to
the smaller language name, equal n-gram counts to the smaller n-gram. Repeated
rows are predicted each, texts of any length as a whole. A null doc_id counts as not held out. Columns other
than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diamondlap.llm.text import byte_slices

PROFILE = 300
MIN_SCORE = 0.02  # the pipeline rejects what scores less against every profile, however short
PIECES = (3, 8, 32, 128, 512, 2048)  # letters of the pieces by which the pipeline learns what clean texts score
NEAR = 0.5  # share of the usual score that a text as long as the piece must reach
UNDECIDED = "und"
SLICE = 500_000  # bytes of text whose n-grams (some 24 bytes each, sorted in copies) a task holds at once
HELD = 1_000_000  # n-grams a task counts before it passes them on
END = 1  # marks a word end; no letter
_BITS = 21

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def symbols(raw: bytes) -> np.ndarray:
    """Code points of the letters in lower case, one END around and between words."""
    text = raw.decode("utf-8", "replace").lower()
    ids = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    x = np.full(len(ids) + 2, END, np.int64)
    x[1:-1] = np.where(letters()[ids], ids, END)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != END) | (x[:-1] != END)
    return x[keep]


def ngrams(x: np.ndarray) -> np.ndarray:
    """All n-grams of one, two and three symbols. Empty without letters."""
    if len(x) < 3:
        return x[:0]
    two = (x[:-1] << _BITS) | x[1:]
    three = ((two[:-1] << _BITS) | x[2:])[x[1:-1] != END]
    return np.concatenate((x[x != END], two, three))


def grams(raw: bytes) -> np.ndarray:
    return ngrams(symbols(raw))


def most_frequent(found: np.ndarray, limit: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order; equal counts by n-gram."""
    gram, count = np.unique(found, return_counts=True)
    key = np.arange(len(gram)) - count.astype(np.int64) * len(gram)
    if len(key) > limit:
        nearest = np.argpartition(key, limit - 1)[:limit]
        return gram[nearest[np.argsort(key[nearest])]]
    return gram[np.argsort(key)]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of (lang, text) rows and how often each occurs, added up as far as HELD allows."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush():
        for name, (gram, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram)), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, texts in byte_slices(batch.column(1), SLICE):
            by: dict[str, list[np.ndarray]] = {}
            for name, raw in zip(langs[first:], texts):
                by.setdefault(name, []).append(grams(raw))
            for name, parts in by.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                if name in held:
                    gram, place = np.unique(np.concatenate((held[name][0], gram)), return_inverse=True)
                    total = np.zeros(len(gram), np.int64)
                    np.add.at(total, place, np.concatenate((held[name][1], n)))
                    n = total
                held[name] = gram, n.astype(np.int64)
                if sum(len(g) for g, _ in held.values()) > HELD:
                    yield from flush()
    yield from flush()


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Profile of every language over all rows; at most `profile` n-grams each reach the driver."""

    counted = (
        docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(lang).alias("lang"), F.col(text).alias("text"))
        .mapInArrow(count_grams, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= profile).collect()
    out: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append((r["place"], r["gram"]))
    return {name: np.array([g for _, g in sorted(out[name])], np.int64) for name in sorted(out)}


class Ranks:
    """Place of every n-gram in every profile, read as [profile, n-gram]; `profile` where it is absent."""

    def __init__(self, profiles: dict[str, np.ndarray], profile: int):
        self.gram = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.place = np.full((len(profiles), len(self.gram) + 1), profile, np.int16)
        for row, own in enumerate(profiles.values()):
            self.place[row, np.searchsorted(self.gram, own)] = np.arange(len(own))

    def __getitem__(self, at: tuple) -> np.ndarray:
        row, gram = at
        if not len(self.gram):
            return self.place[row, np.zeros_like(gram)]
        column = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        return self.place[row, np.where(self.gram[column] == gram, column, len(self.gram))]


def ranks(profiles: dict[str, np.ndarray], profile: int = PROFILE) -> Ranks:
    return Ranks(profiles, profile)


def nearest(raw: bytes, names: list[str], table: Ranks, profile: int = PROFILE) -> tuple[str, float]:
    return nearest_profile(ngrams(symbols(raw)), names, table, profile)


def nearest_profile(found: np.ndarray, names: list[str], table: Ranks, profile: int = PROFILE) -> tuple[str, float]:
    own = most_frequent(found, profile)
    if not len(own) or not names:
        return UNDECIDED, 0.0
    place = table[:, own].astype(np.int32)
    out_of_place = np.where(place == profile, profile, np.abs(place - np.arange(len(own)))).sum(axis=1)
    best = int(np.argmin(out_of_place))
    return names[best], 1.0 - float(out_of_place[best]) / (profile * len(own))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", profile: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score; columns of these names in docs are replaced."""
    names = list(profiles)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(profiles, profile)
        for batch in batches:
            found = [nearest(raw, names, table, profile) for _, texts in byte_slices(batch.column(at), SLICE) for raw in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(label, T.StructType([*docs.schema.fields, *added]))


def remainder(doc_id: str, modulus: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def identify(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Prediction for every document, learned from those outside the held-out fold."""
    held_out = F.coalesce(remainder("doc_id", folds) == fold, F.lit(False))
    profiles = learn(docs.where(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return predict(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")


def beginning(x: np.ndarray, n: int) -> np.ndarray | None:
    """The words of x that hold its first n letters; None if it has fewer."""
    at = np.flatnonzero(x != END)
    if len(at) < n:
        return None
    ends = np.flatnonzero(x == END)
    return x[: ends[np.searchsorted(ends, at[n - 1])] + 1]


def least_scores(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", lang: str = "lang") -> np.ndarray:
    """What a text must score, by language (as in profiles) and length (as in PIECES)."""
    names = list(profiles)
    steps = 100

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(profiles)
        seen = np.zeros((len(names), len(PIECES), steps + 1), np.int64)
        for batch in batches:
            for _, texts in byte_slices(batch.column(0), SLICE):
                for raw in texts:
                    x = symbols(raw)
                    for k, n in enumerate(PIECES):
                        piece = beginning(x, n)
                        if piece is None:
                            break
                        name, score = nearest_profile(ngrams(piece), names, table)
                        seen[names.index(name), k, int(score * steps)] += 1
        row, k, step = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (row, k, step, seen[row, k, step])], names=["row", "piece", "step", "n"])

    out = np.full((len(names), len(PIECES)), MIN_SCORE)
    if not names:
        return out
    seen = np.zeros((len(names), len(PIECES), steps + 1), np.int64)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text)
    counted = labelled.mapInArrow(count, "row bigint, piece bigint, step bigint, n bigint")
    for r in counted.groupBy("row", "piece", "step").agg(F.sum("n").alias("n")).collect():
        seen[r["row"], r["piece"], r["step"]] = r["n"]
    for row in range(len(names)):
        for k in range(len(PIECES)):
            total = np.cumsum(seen[row, k])
            if total[-1]:
                out[row, k] = max(MIN_SCORE, NEAR * int(np.searchsorted(total, (total[-1] + 1) // 2)) / steps)
            elif k:  # no labelled text is as long: held against the longest there is
                out[row, k] = out[row, k - 1]
    return out


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language can be told, with all their columns as they are.

    Learned from all labelled documents. Rejects those without a letter and those
    far from every profile for their length. Repeated rows are judged alike.
    """
    profiles = learn(docs)
    names = list(profiles)
    least = least_scores(docs, profiles)
    schema, at = docs.schema, docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(profiles)
        for batch in batches:
            keep = []
            for _, texts in byte_slices(batch.column(at), SLICE):
                for raw in texts:
                    x = symbols(raw)
                    name, score = nearest_profile(ngrams(x), names, table)
                    size = int(np.searchsorted(PIECES, int((x != END).sum()), "right")) - 1
                    keep.append(name != UNDECIDED and score >= (least[names.index(name), size] if size >= 0 else MIN_SCORE))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(judge, schema)

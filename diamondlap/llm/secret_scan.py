"""Secrets in text, found with DataFrame functions alone.

Base kinds are patterns (assign, access, hex). The method adds strings that look
random: over each candidate string a window of WINDOW characters slides, the
counts of its characters are updated by the one that enters and the one that
leaves, and with them the window's Shannon entropy. Windows at or above the
threshold of their character class (hex, base64) make up a span. Listed parts
(digit, letter and keyboard sequences, placeholders, `data/` at the beginning,
two or more directories of small letters) are cut out of a candidate, and each
piece between them is judged as if it stood alone: pieces that are plain words,
plain numbers, UUIDs or repetitions are left out. Base spans stay.

Spans are code points, end exclusive, ordered by start, then kind in the order
of KINDS, then end.

Positions come from the lengths of the matches and of the pieces between them,
added up in two levels so that a text with very many matches stays cheap.

Defined cases: a null text is empty and has no span. Repeated rows are scanned
each, an empty table gives no rows, other columns are not read by scan() and are
kept by redact(), whatever their names. A text without spans is returned by redact()
as it is. No pattern recurses, so a match may be as long as the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diamondlap.llm.names import free_names

# The base patterns and the least lengths of their matches.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters and more
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

WINDOW = 20
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
CLASSES = {  # kind: (candidate pattern, what it must hold as well, least entropy in bits)
    "entropy_hex": (rf"[0-9A-Fa-f]{{{WINDOW},}}", r"^(?=.*[0-9])(?=.*[A-Fa-f])", 3.0),
    "entropy_base64": (rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", 3.8),
}
ALLOWED = (
    r"^[A-Za-z_=/+-]+$", r"^[0-9_=/+-]+$", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", r"^(.{1,4})\1+.{0,3}$",
)
# A repeated group is possessive: a plain one is matched by recursion, as deep as the text is long.
LISTED = r"(?i:0123456789|abcdefghij|qwertyuiop|example|placeholder|x{6,}|changeme)|^data/|(?:/[a-z]+(?=/)){2,}+/"

SPAN = "struct<start:int,rank:int,end:int>"
_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, first: Column) -> Column:
    """first, then first plus each partial sum; one element more than values."""
    start = F.array(first.cast("int"))
    return F.aggregate(values, start, lambda acc, v: F.concat(acc, F.array((F.element_at(acc, -1) + v).cast("int"))))


def offsets(lengths: Column) -> Column:
    """Sum of the lengths before each element."""

    def two_levels(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, v: (a + v).cast("int")))
        return let(
            _running(sums, F.lit(0)),
            lambda base: F.flatten(F.transform(blocks, lambda b, i: F.slice(_running(b, F.get(base, i)), 1, F.size(b)))),
        )

    count = F.ceil(F.size(lengths) / F.lit(_BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(lengths, k * _BLOCK + 1, F.lit(_BLOCK)))
    return let(blocks, two_levels)


def matches(text: Column, hits: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the matches `hits` of pattern in text, from left to right."""
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    lengths = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda gap, hit: F.struct(gap.alias("gap"), F.length(hit).alias("own")))

    def place(both: Column) -> Column:
        return let(
            offsets(F.transform(both, lambda x: x["gap"] + x["own"])),
            lambda at: F.transform(
                hits,
                lambda hit, i: F.struct(
                    (F.get(at, i) + F.get(both, i)["gap"]).alias("start"),
                    (F.get(at, i) + F.get(both, i)["gap"] + F.get(both, i)["own"]).alias("end"), hit.alias("hit"),
                ),
            ),
        )

    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.when(F.size(hits) > 0, let(lengths, place)).otherwise(none)


def _x_log_x(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def random_windows(candidate: Column, least: float) -> Column:
    """array<struct<a, b>> of the unions of windows whose entropy is at least `least`, within the candidate."""
    most = WINDOW * (F.log2(F.lit(float(WINDOW))) - least) + 1e-9  # entropy = log2(w) - sum(c log2 c) / w

    def slide(x: Column) -> Column:
        def bump(counts: Column, symbol: Column, by: int) -> Column:
            return F.transform(counts, lambda c, i: F.when(i == symbol, c + by).otherwise(c))

        def enter(state: Column, symbol: Column) -> Column:
            own = F.get(state["counts"], symbol)
            return F.struct(
                bump(state["counts"], symbol, 1).alias("counts"), (state["total"] + _x_log_x(own + 1) - _x_log_x(own)).alias("total"),
                state["a"].alias("a"), state["b"].alias("b"), state["out"].alias("out"),
            )

        def leave(state: Column, symbol: Column) -> Column:
            own = F.get(state["counts"], symbol)
            return F.struct(
                bump(state["counts"], symbol, -1).alias("counts"), (state["total"] + _x_log_x(own - 1) - _x_log_x(own)).alias("total"),
                state["a"].alias("a"), state["b"].alias("b"), state["out"].alias("out"),
            )

        def judge(state: Column, i: Column) -> Column:
            """Window ending with character i: open a span, lengthen it, or close it where the next one cannot touch it."""
            start, end = i - (WINDOW - 1), i + 1
            hit = (start >= 0) & (state["total"] <= most)
            apart = hit & (state["a"] >= 0) & (start > state["b"])
            pair = F.array(F.struct(state["a"].alias("a"), state["b"].alias("b")))
            return F.struct(
                state["counts"].alias("counts"), state["total"].alias("total"),
                F.when(hit & ((state["a"] < 0) | apart), start).otherwise(state["a"]).cast("int").alias("a"),
                F.when(hit, end).otherwise(state["b"]).cast("int").alias("b"),
                F.when(apart, F.concat(state["out"], pair)).otherwise(state["out"]).alias("out"),
            )

        def step(state: Column, i: Column) -> Column:
            gone = F.when(i >= WINDOW, leave(state, F.get(x, i - WINDOW))).otherwise(state)
            return let(let(gone, lambda s: enter(s, F.get(x, i))), lambda s: judge(s, i))

        start = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("a"), F.lit(-1).alias("b"),
            F.array().cast("array<struct<a:int,b:int>>").alias("out"),
        )
        return F.aggregate(
            F.sequence(F.lit(0), F.size(x) - 1), start, step,
            lambda s: F.when(s["a"] >= 0, F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))).otherwise(s["out"]),
        )

    symbols = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    return let(symbols, slide)


def _spans(found: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))


def _random_spans(text: Column, hits: Column, kind: str) -> Column:
    pattern, holds, least = CLASSES[kind]

    def suspicious(m: Column) -> Column:
        ok = (F.length(m["hit"]) >= WINDOW) & m["hit"].rlike(holds)
        for allowed in ALLOWED:
            ok = ok & ~m["hit"].rlike(allowed)
        return ok

    def pieces(m: Column) -> Column:
        """What lies before, between and behind the listed parts."""

        def piece(listed: Column, i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(listed, i - 1)["end"])
            end = F.when(i == F.size(listed), F.length(m["hit"])).otherwise(F.get(listed, i)["start"])
            return F.struct(
                (m["start"] + begin).cast("int").alias("start"), (m["start"] + end).cast("int").alias("end"),
                F.substr(m["hit"], begin + 1, end - begin).alias("hit"),
            )

        listed = matches(m["hit"], F.regexp_extract_all(m["hit"], F.lit(LISTED), F.lit(0)), LISTED)
        cut = let(listed, lambda x: F.transform(F.sequence(F.lit(0), F.size(x)), lambda i: piece(x, i)))
        return F.when(m["hit"].rlike(LISTED), cut).otherwise(F.array(m))

    def spans(m: Column) -> Column:
        return F.transform(
            random_windows(m["hit"], least),
            lambda w: F.struct((m["start"] + w["a"]).cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (m["start"] + w["b"]).cast("int").alias("end")),
        )

    candidates = F.filter(matches(text, hits, pattern), lambda m: m["hit"].rlike(holds))
    return F.flatten(F.transform(F.filter(F.flatten(F.transform(candidates, pieces)), suspicious), spans))


def with_spans(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """docs with the ordered spans (start, rank of the kind, end) of all kinds in column `into`."""
    names = free_names(docs, *(f"_{into}_{k}" for k in KINDS))
    whole = F.coalesce(F.col(text), F.lit(""))
    patterns = (ASSIGN, ACCESS, HEX, *(CLASSES[k][0] for k in KINDS[3:]))
    docs = docs.withColumns({n: F.regexp_extract_all(whole, F.lit(p), F.lit(0)) for n, p in zip(names, patterns)})
    assigned = F.filter(matches(whole, F.col(names[0]), ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= ASSIGN_VALUE)
    parts = [
        _spans(assigned, "assign"), _spans(matches(whole, F.col(names[1]), ACCESS), "access"), _spans(matches(whole, F.col(names[2]), HEX), "hex"),
        *(_random_spans(whole, F.col(n), k) for n, k in zip(names[3:], KINDS[3:])),
    ]
    any_hit = sum((F.size(n) for n in names), F.lit(0)) > 0
    none = F.array().cast(f"array<{SPAN}>")
    return docs.withColumn(into, F.when(any_hit, F.array_sort(F.concat(*parts))).otherwise(none)).drop(*names)


def listed(spans: Column) -> Column:
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans as text."""
    found = with_spans(docs.select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["rank"] < 3)

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    counts = [count(rank) for rank in range(3)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by mark (overlapping spans by one), and n_chars to match."""
    columns, (spans,) = docs.columns, free_names(docs, "_secret_spans")
    found = with_spans(docs, into=spans)

    def cover(spans: Column) -> Column:
        """Spans that overlap as one."""
        none = F.array().cast("array<struct<a:int,b:int>>")
        one = lambda s: F.array(F.struct(s["start"].alias("a"), s["end"].alias("b")))

        def add(acc: Column, s: Column) -> Column:
            last = F.element_at(acc, -1)
            longer = F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["end"]).alias("b")))
            return F.when(F.size(acc) == 0, one(s)).when(s["start"] >= last["b"], F.concat(acc, one(s))).otherwise(
                F.concat(F.slice(acc, 1, F.size(acc) - 1), longer)
            )

        return F.aggregate(spans, none, add)

    def rebuilt(covers: Column) -> Column:
        def piece(i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(covers, i - 1)["b"])
            end = F.when(i == F.size(covers), F.length("text")).otherwise(F.get(covers, i)["a"])
            return F.substr(F.col("text"), begin + 1, end - begin)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(covers)), piece), mark)

    has = F.size(spans) > 0
    found = found.withColumn("text", F.when(has, let(cover(F.col(spans)), rebuilt)).otherwise(F.col("text")))
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.when(has, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*columns)

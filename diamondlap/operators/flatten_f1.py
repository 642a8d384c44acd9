"""Formula documents to tables.

`raw` holds season, round, source, event_type, circuit_id and the text in
`data`, or is what parse() made of it; all numbers in the feed are quoted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from diamondlap.functions.groups import first_per_key
from diamondlap.functions.scalars import duration_ms, safe_float, safe_int, safe_long
from diamondlap.sources import schemas
from diamondlap.sources.parsed import ParsedDocuments, write_parsed

Documents = DataFrame | ParsedDocuments

KEYS = ["season", "round"]
SOURCE = "jolpica"


#: What is read of a document by its event type. Laps come flat or in pages, and the two
#: differ only in the case of one field; a document is parsed as that whose name it holds.
SCHEMAS = {
    "results": schemas.F1_RESULTS, "qualifying": schemas.F1_QUALIFYING, "pit_stops": schemas.F1_PIT_STOPS,
    "laps": schemas.F1_LAPS, "lap_pages": schemas.F1_LAP_PAGES,
}
LAPS = {"laps": '"laps"', "lap_pages": '"Laps"'}


def _of_type(rows: DataFrame, event_type: str) -> DataFrame:
    return rows.filter((F.col("source") == SOURCE) & (F.col("event_type") == ("lap_times" if event_type in LAPS else event_type)))


def parse(raw: DataFrame) -> ParsedDocuments:
    """Parse each document once into the column of its event type."""
    event = F.col("event_type")
    of_kind = lambda name: (event == "lap_times") & F.col("data").contains(LAPS[name]) if name in LAPS else event == name
    rows = raw.filter((F.col("source") == SOURCE) & event.isin("lap_times", *SCHEMAS))
    held = [F.when(of_kind(name), F.from_json("data", schema)).alias(name) for name, schema in SCHEMAS.items()]
    return write_parsed(rows.select(*KEYS, "source", "event_type", "circuit_id", *held), list(SCHEMAS), "rounds-parsed")


def _docs(raw: Documents, event_type: str) -> DataFrame:
    """Keys and parsed documents, as `d`."""
    schema = SCHEMAS[event_type]
    if isinstance(raw, ParsedDocuments):
        return _of_type(raw.rows(event_type, schema), event_type).select(*KEYS, "circuit_id", F.col(event_type).alias("d"))
    return _of_type(raw, event_type).select(*KEYS, "circuit_id", F.from_json("data", schema).alias("d"))


def races(raw: Documents) -> DataFrame:
    """One row per round that has results; the richer race fields when present."""
    rows = _docs(raw, "results").filter(F.size(F.coalesce("d.results", F.array())) > 0)
    rows = rows.select(
        *KEYS, F.coalesce("circuit_id", "d.race.Circuit.circuitId").alias("circuit_id"),
        F.col("d.race.raceName").alias("race_name"), F.col("d.race.Circuit.circuitName").alias("circuit_name"),
        F.col("d.race.Circuit.Location.country").alias("country"),
        F.col("d.race.Circuit.Location.locality").alias("locality"),
        F.col("d.race.date").alias("race_date"), F.col("d.race.time").alias("race_time"), F.col("d.race.url").alias("url"),
    )
    return first_per_key(rows, KEYS, [F.col("circuit_id").asc_nulls_last()])


def results(raw: Documents) -> DataFrame:
    rows = _docs(raw, "results").select(*KEYS, F.explode("d.results").alias("r"))
    whole = {
        "grid": "grid", "position": "position", "position_order": "positionOrder", "laps": "laps",
        "fastest_lap_rank": "FastestLap.rank",
    }
    return rows.select(
        *KEYS, F.col("r.Driver.driverId").alias("driver_id"), F.col("r.Constructor.constructorId").alias("constructor_id"),
        F.col("r.positionText").alias("position_text"), "r.status",
        *[safe_int(f"r.{path}").alias(name) for name, path in whole.items()],
        safe_float("r.points").alias("points"), safe_long("r.Time.millis").alias("time_millis"),
        F.col("r.Time.time").alias("time_display"), F.col("r.FastestLap.Time.time").alias("fastest_lap_time"),
        safe_float("r.FastestLap.AverageSpeed.speed").alias("fastest_lap_speed"),
    )


def qualifying(raw: Documents) -> DataFrame:
    rows = _docs(raw, "qualifying").select(*KEYS, F.explode("d.qualifying").alias("q"))
    return rows.select(
        *KEYS, F.col("q.Driver.driverId").alias("driver_id"), F.col("q.Constructor.constructorId").alias("constructor_id"),
        safe_int("q.position").alias("position"), F.col("q.Q1").alias("q1_time"), F.col("q.Q2").alias("q2_time"),
        F.col("q.Q3").alias("q3_time"),
    )


def lap_times(raw: Documents) -> DataFrame:
    """Flat laps, or pages of laps that hold timings."""
    entry = lambda lap, t: F.struct(
        lap.alias("lap"), t["driverId"].alias("driverId"), t["position"].alias("position"), t["time"].alias("time")
    )
    paged = F.flatten(F.transform(
        F.coalesce("d.Laps", F.array()),
        lambda page: F.transform(F.coalesce(page["Timings"], F.array()), lambda t: entry(page["number"], t)),
    ))
    flat = F.transform(F.coalesce("d.laps", F.array()), lambda t: entry(t["lap"], t))
    rows = _docs(raw, "laps").select(*KEYS, F.explode(flat).alias("l")).unionByName(_docs(raw, "lap_pages").select(*KEYS, F.explode(paged).alias("l")))
    return rows.select(
        *KEYS, F.col("l.driverId").alias("driver_id"), safe_int("l.lap").alias("lap"),
        safe_int("l.position").alias("position"), F.col("l.time").alias("time_display"),
        duration_ms("l.time").alias("time_millis"),
    )


def pit_stops(raw: Documents) -> DataFrame:
    rows = _docs(raw, "pit_stops").select(*KEYS, F.explode("d.pit_stops").alias("s"))
    return rows.select(
        *KEYS, F.col("s.driverId").alias("driver_id"), safe_int("s.stop").alias("stop"), safe_int("s.lap").alias("lap"),
        F.col("s.time").alias("time_of_day"), F.col("s.duration").alias("duration_display"),
        duration_ms("s.duration").alias("duration_millis"),
    )


def _named(raw: Documents, part: str, key: str, columns: list) -> DataFrame:
    """Distinct people or teams over results and qualifying; the earliest round
    wins and is never updated by a later one."""
    seen = [
        _docs(raw, event).select(*KEYS, F.lit(i).alias("src"), F.explode(f"d.{event}").alias("x"))
        .select(*KEYS, "src", f"x.{part}.*")
        for i, event in enumerate(("results", "qualifying"))
    ]
    rows = seen[0].unionByName(seen[1]).filter(F.coalesce(F.col(key), F.lit("")) != "")
    return first_per_key(rows, key, [F.col("season"), F.col("round"), F.col("src")]).select(*columns)


def drivers(raw: Documents) -> DataFrame:
    return _named(raw, "Driver", "driverId", [
        F.col("driverId").alias("driver_id"), safe_int("permanentNumber").alias("permanent_number"), "code",
        F.col("givenName").alias("given_name"), F.col("familyName").alias("family_name"),
        F.col("dateOfBirth").alias("date_of_birth"), "nationality", "url",
    ])


def constructors(raw: Documents) -> DataFrame:
    return _named(raw, "Constructor", "constructorId", [
        F.col("constructorId").alias("constructor_id"), "name", "nationality", "url",
    ])


TABLES = {
    "races": races, "results": results, "qualifying": qualifying, "lap_times": lap_times,
    "pit_stops": pit_stops, "drivers": drivers, "constructors": constructors,
}


def flatten_f1(raw: DataFrame, season: int | None = None, round: int | None = None) -> dict[str, DataFrame]:
    """All tables of the chosen rounds; documents are parsed once for all of them."""
    for name, value in (("season", season), ("round", round)):
        if value is not None:
            raw = raw.filter(F.col(name) == value)
    docs = parse(raw)
    return {name: build(docs) for name, build in TABLES.items()}

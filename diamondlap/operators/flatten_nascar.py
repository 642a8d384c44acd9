"""Stock-car documents to tables.

`raw` holds season, series_id, race_id, endpoint_type and the text in `data`, or
is what parse() made of it. Only races with a weekend feed are flattened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from diamondlap.functions import codes
from diamondlap.functions.scalars import json_root_is_array, map_code, safe_float, safe_int, text_or_null, trimmed
from diamondlap.sources import schemas
from diamondlap.sources.parsed import ParsedDocuments, write_parsed

Documents = DataFrame | ParsedDocuments

KEYS = ["race_id", "season", "series_id"]


def _endpoint(raw: DataFrame, endpoint: str) -> DataFrame:
    return raw.filter(F.col("endpoint_type") == endpoint)


def _stops() -> Column:
    """The root is either the list itself or an object holding it."""
    return F.when(
        json_root_is_array("data"), F.from_json("data", f"ARRAY<{schemas.PIT_STOP}>")
    ).otherwise(F.from_json("data", f"pit_stops ARRAY<{schemas.PIT_STOP}>")["pit_stops"])


def _stats() -> Column:
    """An object root reads as a list of one."""
    return F.get(F.from_json("data", f"ARRAY<STRUCT<{schemas.DRIVER_STATS.replace(' ', ': ', 1)}>>"), F.lit(0))


#: How the text of an endpoint is read.
READ = {
    "weekend_feed": lambda: F.from_json("data", schemas.WEEKEND_FEED), "lap_times": lambda: F.from_json("data", schemas.LAP_TIMES),
    "pit_stops": _stops, "driver_stats": _stats,
}


def parse(raw: DataFrame) -> ParsedDocuments:
    """Parse each document once, as its endpoint asks for, into the column of that name."""
    held = [F.when(F.col("endpoint_type") == name, read()).alias(name) for name, read in READ.items()]
    return write_parsed(raw.filter(F.col("endpoint_type").isin(*READ)).select(*KEYS, "endpoint_type", *held), list(READ), "races-parsed")


def _parsed(raw: Documents, endpoint: str, schema: T.DataType | str | None = None) -> DataFrame:
    """Keys and the parsed documents, as `d`, of an endpoint; `schema` names what is read of them, if not all."""
    if isinstance(raw, ParsedDocuments):
        kind = schema or {"weekend_feed": schemas.WEEKEND_FEED, "lap_times": schemas.LAP_TIMES, "driver_stats": schemas.DRIVER_STATS}[endpoint]
        return _endpoint(raw.rows(endpoint, kind), endpoint).select(*KEYS, F.col(endpoint).alias("d"))
    return _endpoint(raw, endpoint).select(*KEYS, READ[endpoint]().alias("d"))


def _with_feed(raw: Documents, endpoint: str, schema: T.DataType | str | None = None) -> DataFrame:
    feeds = _endpoint(raw.rows() if isinstance(raw, ParsedDocuments) else raw, "weekend_feed").select(*KEYS)
    return _parsed(raw, endpoint, schema).join(feeds, KEYS, "left_semi")


def _first_race(raw: Documents) -> DataFrame:
    return (
        _parsed(raw, "weekend_feed").select(*KEYS, F.get("d.weekend_race", F.lit(0)).alias("w"))
        .filter(F.col("w").isNotNull())
    )


def races(raw: Documents) -> DataFrame:
    whole = {
        "track_id": "track_id", "scheduled_laps": "scheduled_laps", "actual_laps": "actual_laps",
        "caution_count": "number_of_cautions", "caution_laps": "number_of_caution_laps",
        "lead_changes": "number_of_lead_changes", "leaders_count": "number_of_leaders",
    }
    return _first_race(raw).select(
        *KEYS, "w.race_name", "w.track_name",
        F.left(text_or_null("w.race_date"), F.lit(10)).alias("race_date"),
        *[safe_int(f"w.{path}").alias(name) for name, path in whole.items()],
        safe_float("w.actual_distance").alias("total_miles"),
        F.lit(None).cast("string").alias("track_type"),
    )


def did_not_finish(status: Column) -> Column:
    return ~F.lower(F.coalesce(status, F.lit(""))).isin("running", "")


def results(raw: Documents) -> DataFrame:
    rows = _first_race(raw).select(*KEYS, F.explode("w.results").alias("r"))
    whole = {
        "driver_id": "driver_id", "start_position": "starting_position", "finish_position": "finishing_position",
        "laps_completed": "laps_completed", "laps_led": "laps_led", "points": "points_earned",
        "playoff_points": "playoff_points_earned", "pit_stop_count": "num_pit_stops",
    }
    return rows.select(
        *KEYS, F.col("r.driver_fullname").alias("driver_name"), trimmed("r.official_car_number").alias("car_number"),
        "r.team_name", F.col("r.car_make").alias("manufacturer"), "r.finishing_status",
        did_not_finish(F.col("r.finishing_status")).alias("dnf"),
        *[safe_int(f"r.{path}").alias(name) for name, path in whole.items()],
        safe_float("r.average_running_position").alias("avg_position"),
        safe_float("r.average_speed").alias("avg_speed"),
    )


def laps(raw: Documents) -> DataFrame:
    """Driver laps; a lap without a number is left out."""
    drivers = _with_feed(raw, "lap_times").select(*KEYS, F.explode("d.laps").alias("v"))
    return drivers.select(*KEYS, "v.NASCARDriverID", "v.FullName", "v.Number", F.explode("v.Laps").alias("l")).select(
        *KEYS, safe_int("NASCARDriverID").alias("driver_id"), F.col("FullName").alias("driver_name"),
        trimmed("Number").alias("car_number"), safe_int("l.Lap").alias("lap_number"),
        safe_int("l.RunningPos").alias("position"), safe_float("l.LapTime").alias("lap_time"),
        safe_float("l.LapSpeed").alias("lap_speed"),
    ).filter(F.col("lap_number").isNotNull())


def pit_stops(raw: Documents) -> DataFrame:
    stops = T.ArrayType(T.StructType.fromDDL(schemas.PIT_STOP))
    return _with_feed(raw, "pit_stops", stops).select(*KEYS, F.explode("d").alias("s")).select(
        *KEYS, F.lit(None).cast("int").alias("driver_id"), "s.driver_name",
        trimmed("s.vehicle_number").alias("car_number"), safe_int("s.pit_in_rank").alias("stop_number"),
        safe_int("s.lap_count").alias("lap"), safe_float("s.total_duration").alias("duration_seconds"),
    )


def lead_changes(raw: Documents) -> DataFrame:
    return _first_race(raw).select(*KEYS, F.explode("w.race_leaders").alias("l")).select(
        *KEYS, safe_int("l.start_lap").alias("lap"), trimmed("l.car_number").alias("car_number")
    )


def driver_stats(raw: Documents) -> DataFrame:
    """Loop statistics."""
    return _with_feed(raw, "driver_stats").select(*KEYS, F.explode("d.drivers").alias("s")).select(
        *KEYS, safe_int("s.driver_id").alias("driver_id"), safe_float("s.avg_ps").alias("avg_running_position"),
        safe_int("s.fast_laps").alias("fastest_lap_number"), safe_int("s.quality_passes").alias("quality_passes"),
        safe_int("s.passes_gf").alias("green_flag_passes"), safe_int("s.passed_gf").alias("green_flag_passed"),
        safe_int("s.passing_diff").alias("quality_pass_differential"), safe_float("s.rating").alias("driver_rating"),
    )


def snapshot(feeds: DataFrame) -> DataFrame:
    """Live feeds (race_id, season, series_id, snapshot_at, data) to one row per
    car. Tyre age counts laps since the last completed stop."""
    d = F.from_json("data", schemas.LIVE_FEED)
    rows = feeds.select(*KEYS, "snapshot_at", d.alias("d")).select(
        *KEYS, "snapshot_at", F.coalesce("d.lap_number", F.lit(0)).alias("lap"),
        F.coalesce("d.number_of_race_laps", F.lit(0)).alias("total_laps"), "d.flag_state",
        F.explode("d.vehicles").alias("v"),
    )
    stops = F.transform(F.coalesce("v.pit_stops", F.array()), lambda s: s["pit_in_lap_count"])
    last = F.array_max(F.filter(stops, lambda lap: lap > 0))
    rows = rows.withColumn("last_pit_lap", last)
    size = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    return rows.select(
        *KEYS, "snapshot_at", "lap", "total_laps", "flag_state",
        F.col("v.driver.driver_id").alias("driver_id"), F.col("v.driver.full_name").alias("driver_name"),
        trimmed("v.vehicle_number").alias("car_number"), F.col("v.vehicle_manufacturer").alias("manufacturer"),
        F.col("v.running_position").alias("position"), "v.laps_completed", size("v.pit_stops").alias("pit_stops"),
        size("v.laps_led").alias("laps_led"), "v.last_lap_time", "v.last_lap_speed", "v.best_lap_time",
        "v.best_lap_speed", F.coalesce("v.status", F.lit("")).alias("status"), F.col("v.delta").alias("delta_leader"),
        "last_pit_lap",
        F.when(F.col("lap") != 0, F.col("lap") - F.col("last_pit_lap")).alias("tire_age"),
    )


def flags(feeds: DataFrame) -> DataFrame:
    """Lap and flag of every feed document."""
    d = F.from_json("data", schemas.LIVE_FEED)
    return feeds.select(
        *KEYS, "snapshot_at", F.coalesce(d["lap_number"], F.lit(0)).alias("lap"),
        F.coalesce(d["number_of_race_laps"], F.lit(0)).alias("total_laps"),
        map_code(F.coalesce(d["flag_state"], F.lit(0)), codes.FLAG_NAMES).alias("flag"),
    )


def explore_race(raw: DataFrame) -> DataFrame:
    """Endpoints stored and missing per race, with the shape of the main ones.

    At most one row per endpoint type is gathered for a race.
    """
    is_list = json_root_is_array("data")
    on = lambda endpoint, value: F.max(F.when(F.col("endpoint_type") == endpoint, value))
    records = lambda endpoint: on(endpoint, F.when(is_list, F.json_array_length("data"))).cast("bigint")
    stored = F.array_sort(F.collect_set("endpoint_type"))
    wanted = F.array(*[F.lit(e) for e in codes.RACE_ENDPOINTS])
    return raw.groupBy(*KEYS).agg(
        stored.alias("stored_endpoints"),
        on("weekend_feed", F.json_object_keys("data")).alias("weekend_feed_keys"),
        records("lap_times").alias("total_lap_records"),
        records("pit_stops").alias("total_pit_records"),
    ).select(
        *KEYS, map_code("series_id", codes.SERIES_NAMES).alias("series"), "stored_endpoints",
        F.array_except(wanted, "stored_endpoints").alias("missing_endpoints"),
        "weekend_feed_keys", "total_lap_records", "total_pit_records",
    )


def list_races(raw: DataFrame, year: int | None = None, series: int | None = None) -> DataFrame:
    """Races with a stored weekend feed, newest season first."""
    rows = _endpoint(raw, "weekend_feed")
    if year is not None:
        rows = rows.filter(F.col("season") == year)
    if series is not None:
        rows = rows.filter(F.col("series_id") == series)
    return rows.select(
        "race_id", map_code("series_id", codes.SERIES_NAMES).alias("series"), "season", "fetched_at"
    ).orderBy(F.col("season").desc(), "race_id")


TABLES = {
    "races": races, "results": results, "laps": laps, "pit_stops": pit_stops,
    "lead_changes": lead_changes, "driver_stats": driver_stats,
}


def flatten_nascar(raw: DataFrame, season: int | None = None, series_id: int | None = None, race_id: int | None = None) -> dict[str, DataFrame]:
    """All tables of the chosen races; documents are parsed once for all of them."""
    for name, value in (("season", season), ("series_id", series_id), ("race_id", race_id)):
        if value is not None:
            raw = raw.filter(F.col(name) == value)
    docs = parse(raw)
    return {name: build(docs) for name, build in TABLES.items()}

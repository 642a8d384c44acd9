"""Batch jobs: land, flatten, derive and check over a warehouse folder.

Any scheduler can call them. Each does one pass over the documents it is given,
however many games or races they hold.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from diamondlap.operators import flatten_f1, flatten_mlb, flatten_nascar, pitch_value as pv, quality, stuff, tendencies as td
from diamondlap.sources import landing, sinks
from diamondlap.sources.staging import stage
from diamondlap.streaming import games as live


def table(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    """A stored table; one of the flattened tables may still be without rows."""
    if name not in flatten_mlb.TABLES:
        return spark.read.parquet(f"{warehouse}/{name}")
    no_documents = spark.createDataFrame([], "game_pk INT, game_date STRING, data STRING")
    schema = flatten_mlb.TABLES[name](no_documents).schema
    return sinks.read_table(spark, f"{warehouse}/{name}", schema)


def mlb_daily(spark: SparkSession, landing_dir: str, warehouse: str, run: int | None = None, schedule_dir: str | None = None) -> DataFrame:
    """Land a folder of game documents, refresh the tables of changed games and
    return the verdict per day of those games. Coverage is judged against the
    finished games of the schedule documents in `schedule_dir`; the days these
    know are judged too, stored or not. Without them only stored games count. Repeating a failed job under its
    `run` number takes up where it stopped; by default every call is a new run."""
    run = time.time_ns() if run is None else run
    docs = landing.read_documents(spark, landing_dir)
    docs = docs.withColumn("game_pk", F.get_json_object("data", "$.gamePk").try_cast("int"))
    taken = live.store_games(docs.select("game_pk", "data", "fetched_at"), run, warehouse)
    tables = live.flatten_games(taken, warehouse)
    days = tables["games"].select("game_date").distinct()
    due = None
    if schedule_dir is not None:
        due = landing.schedule_games(landing.read_documents(spark, schedule_dir)).select("game_pk", "game_date")
        days = days.union(due.select("game_date")).distinct()
    games = table(spark, warehouse, "games").join(days, "game_date", "left_semi")
    at_bats, pitches, runners = (table(spark, warehouse, n) for n in ("at_bats", "pitches", "runners"))
    return quality.verdict(quality.run_checks(games, games if due is None else due, at_bats, pitches, runners))


def season_tables(spark: SparkSession, warehouse: str, batting: DataFrame | None = None, pitching: DataFrame | None = None) -> None:
    """Store season statistics; the seasons given replace their stored rows."""
    for name, rows in (("season_batting", batting), ("season_pitching", pitching)):
        if rows is not None:
            sinks.replace_scope(rows, f"{warehouse}/{name}", ["season"], ["season"])


def grade_projections(spark: SparkSession, warehouse: str, projections: str, actuals: DataFrame, keys: Sequence[str]) -> None:
    """Fill the actual columns of stored projections from finished games; those
    without a result yet stay as they are. The graded table replaces the last one."""
    stored = spark.read.parquet(projections)
    columns = [c for c in actuals.columns if c not in keys]
    open_columns = [F.lit(None).cast(actuals.schema[c].dataType).alias(c) for c in columns if c not in stored.columns]
    graded = sinks.update_from(stored.select("*", *open_columns), actuals, keys, columns)
    graded.write.mode("overwrite").parquet(f"{warehouse}/graded_projections")


def build_tendencies(spark: SparkSession, warehouse: str, seasons: Sequence[int] | None = None, min_type: int = 50, min_zone: int = 20) -> None:
    """Replace the tendency tables of the given seasons, or of all that have games or stored rows. A
    season whose groups fall below the minimum has no rows any more."""
    pitches, at_bats, games = (table(spark, warehouse, n) for n in ("pitches", "at_bats", "games"))
    for name, rows in (
        ("batter_pitch_type_tendencies", td.pitch_type_tendencies(pitches, at_bats, games, seasons, min_type)),
        ("batter_zone_tendencies", td.zone_tendencies(pitches, at_bats, games, seasons, min_zone)),
    ):
        path = f"{warehouse}/{name}"
        if seasons is not None:
            replaced = spark.createDataFrame([(s,) for s in seasons], "season INT")
        else:
            replaced = games.select("season").union(sinks.read_table(spark, path, "season INT").select("season")).distinct()
        sinks.replace_scope(rows, path, ["season"], ["season"], keys=replaced)


def score_range(
    spark: SparkSession, warehouse: str, season: int | None = None, start: str | None = None,
    end: str | None = None, game_pk: int | None = None,
) -> None:
    """Score a season, a range of days or one game; only the games chosen are
    replaced, also those that have no scores any more. Types are normalised over the scope that was loaded."""
    pitches, at_bats, games = (table(spark, warehouse, n) for n in ("pitches", "at_bats", "games"))
    tt = table(spark, warehouse, "batter_pitch_type_tendencies")
    chosen = td.load_pitches(pitches, at_bats, games, season, start, end, game_pk)
    scope = ("season",) if game_pk is None else ("game_pk",)
    scores = pv.score_pitches(chosen, tt, td.linear_weights(spark), scope=scope)
    replaced = games.filter(td.game_scope(season, start, end, game_pk)).select("season", "game_pk")
    sinks.replace_scope(scores, f"{warehouse}/pitch_quality_scores", ["season"], ["season", "game_pk"], keys=replaced)


def train_stuff(spark: SparkSession, warehouse: str, seasons: Sequence[int] | None = None, min_pitches: int = 100) -> None:
    """Fit the pitch-quality models and store their coefficients as a table."""
    pitches, at_bats, games = (table(spark, warehouse, n) for n in ("pitches", "at_bats", "games"))
    features = stuff.engineer(stuff.stuff_features(pitches, at_bats, games, seasons, min_pitches))
    stuff.fit_ridge(features).write.mode("overwrite").parquet(f"{warehouse}/stuff_models")


def nascar_weekend(spark: SparkSession, landing_dir: str, warehouse: str) -> DataFrame:
    """Land race documents kept under season=/series_id=/race_id=/endpoint_type=
    folders, refresh the races they belong to and return the landing report."""
    new = landing.read_documents(spark, landing_dir).select(*landing.RACE_KEYS, "data", "fetched_at")
    return _land_and_flatten(new, warehouse, "nascar", landing.land_races, ["season", "series_id", "race_id"], flatten_nascar.flatten_nascar)


def f1_weekend(spark: SparkSession, landing_dir: str, warehouse: str) -> DataFrame:
    """The same for formula rounds under season=/round=/source=/event_type=."""
    new = landing.read_documents(spark, landing_dir)
    if "circuit_id" not in new.columns:
        new = new.withColumn("circuit_id", F.lit(None).cast("string"))
    new = new.select(*landing.ROUND_KEYS, "circuit_id", "data", "fetched_at")
    return _land_and_flatten(new, warehouse, "f1", landing.land_rounds, ["season", "round"], flatten_f1.flatten_f1)


def _land_and_flatten(new: DataFrame, warehouse: str, sport: str, land, scope: list[str], flatten) -> DataFrame:
    """Documents and tables are stored by race or round, and only those that came are read and written."""
    spark = new.sparkSession
    raw_path, report_path = f"{warehouse}/{sport}/raw", f"{warehouse}/{sport}/last_report"
    came = stage(new.select(*scope).distinct(), "came")
    table_rows, report = land(new, sinks.read_parts(spark, raw_path, new.schema, scope, came))
    report.write.mode("overwrite").parquet(report_path)
    sinks.replace_scope(table_rows, raw_path, scope, scope, keys=came)
    raw = sinks.read_parts(spark, raw_path, new.schema, scope, came)
    for name, rows in flatten(raw).items():
        path = f"{warehouse}/{sport}/{name}"
        if set(scope) <= set(rows.columns):
            sinks.replace_scope(rows, path, scope, scope, keys=came)
        else:
            key = [c for c in ("driver_id", "constructor_id") if c in rows.columns][:1]
            have = sinks.read_table(spark, path, rows.schema)
            sinks.append(sinks.insert_ignore(rows, have, key, [F.col(key[0])]), path)
    return spark.read.parquet(report_path)

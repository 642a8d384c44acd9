"""Data-quality checks.

Each check returns rows (check, scope, level, found, wanted): scope is the day or
season checked, level 0 passes, 1 warns, 2 fails. Checks run for every scope at
once and can be narrowed by filtering their inputs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from diamondlap.functions.groups import top_k_per_group
from diamondlap.functions.scalars import half_up

PASS, WARN, FAIL = 0, 1, 2
LEVEL_NAMES = {PASS: "pass", WARN: "warn", FAIL: "fail"}


def _report(df: DataFrame, name: str, scope: str, level: Column, found, wanted) -> DataFrame:
    return df.select(
        F.lit(name).alias("check"), F.col(scope).cast("string").alias("scope"), level.cast("int").alias("level"),
        found.cast("double").alias("found"), wanted.cast("double").alias("wanted"),
    )


def check_coverage(games: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Stored games against finished scheduled ones, per day. `scheduled` holds
    one row per game with game_date; a day it does not know is a warning."""
    have = games.groupBy("game_date").agg(F.count(F.lit(1)).alias("stored"))
    want = scheduled.groupBy("game_date").agg(F.count(F.lit(1)).alias("due"))
    rows = have.join(want, "game_date", "full_outer").na.fill(0, ["stored"])
    level = (
        F.when(F.col("due").isNull(), WARN)
        .when(F.col("stored") == F.col("due"), PASS)
        .when(F.col("stored") >= F.col("due") * 0.95, WARN)
        .otherwise(FAIL)
    )
    return _report(rows, "game coverage", "game_date", level, F.col("stored"), F.col("due"))


def check_totals(season_batting: DataFrame, at_bats: DataFrame, games: DataFrame) -> DataFrame:
    """Plate appearances of the season table against the feed, per season. The
    feed may be up to 50 ahead while the season table catches up."""
    ours = at_bats.join(games.filter(F.col("game_type") == "R").select("game_pk", "season"), "game_pk").groupBy(
        "season"
    ).agg(F.count(F.lit(1)).alias("feed"))
    theirs = season_batting.groupBy("season").agg(F.sum("pa").alias("listed"))
    rows = ours.join(theirs, "season", "full_outer")
    diff = F.nullif(F.col("listed"), F.lit(0)) - F.nullif(F.col("feed"), F.lit(0))
    level = (
        F.when(diff.isNull(), WARN).when(diff == 0, PASS).when(diff > 0, FAIL)
        .when(diff >= -50, WARN).otherwise(FAIL)
    )
    return _report(rows, "season totals", "season", level, F.col("feed"), F.col("listed"))


def player_discrepancies(season_batting: DataFrame, at_bats: DataFrame, games: DataFrame, over: int = 5, k: int = 20, by_name: bool = False) -> DataFrame:
    """The k players of each season whose two counts differ most.

    Joined by player id, or by lower-cased name where the sources' ids differ.
    """
    key = F.lower("player_name") if by_name else F.col("player_id")
    regular = games.filter(F.col("game_type") == "R").select("game_pk", "season")
    ours = (
        at_bats.join(regular, "game_pk")
        .select("season", F.col("batter_id").alias("player_id"), F.col("batter_name").alias("player_name"))
        .withColumn("key", key.cast("string"))
        .groupBy("season", "key").agg(
            F.max("player_id").alias("a_id"), F.max("player_name").alias("a_name"), F.count(F.lit(1)).alias("feed_pa"),
        )
    )
    theirs = (
        season_batting.select("season", F.col("mlbam_id").alias("player_id"), "player_name", "pa")
        .withColumn("key", key.cast("string"))
        .groupBy("season", "key").agg(
            F.max("player_id").alias("b_id"), F.max("player_name").alias("b_name"), F.sum("pa").alias("listed_pa"),
        )
    )
    rows = ours.join(theirs, ["season", "key"], "full_outer").select(
        "season", F.coalesce("a_name", "b_name").alias("player_name"), F.coalesce("a_id", "b_id").cast("bigint").alias("player_id"),
        F.coalesce("feed_pa", F.lit(0)).cast("bigint").alias("feed_pa"),
        F.coalesce("listed_pa", F.lit(0)).cast("bigint").alias("listed_pa"),
    ).withColumn("diff", F.col("feed_pa") - F.col("listed_pa")).filter(F.abs("diff") > over)
    order = [F.abs("diff").desc(), F.col("player_name"), F.col("player_id")]
    return top_k_per_group(rows, "season", order, k)


def check_rows_per_game(at_bats: DataFrame, games: DataFrame, low: float = 25, high: float = 45) -> DataFrame:
    """At-bats per game that has any, per day."""
    per_game = at_bats.groupBy("game_pk").agg(F.count(F.lit(1)).alias("n"))
    rows = per_game.join(games.groupBy("game_pk", "game_date").agg(F.count(F.lit(1)).alias("times")), "game_pk").groupBy("game_date").agg(
        F.sum(F.col("n") * F.col("times")).alias("n"), F.count(F.lit(1)).alias("games")
    )
    per = half_up(F.col("n") / F.nullif(F.col("games"), F.lit(0)), 1)
    level = F.when(per.isNull(), WARN).when(per.between(low, high), PASS).when(per < low, FAIL).otherwise(WARN)
    return _report(rows, "at-bats per game", "game_date", level, per, F.lit(low))


def pitch_counts(games: DataFrame, pitches: DataFrame) -> DataFrame:
    """Pitches of every stored game, none included."""
    counted = pitches.groupBy("game_pk").agg(F.count(F.lit(1)).alias("pitch_count"))
    return games.join(counted, "game_pk", "left").select(
        "game_pk", "game_date", F.concat_ws(" @ ", "away_team_abbrev", "home_team_abbrev").alias("matchup"),
        F.coalesce("pitch_count", F.lit(0)).cast("bigint").alias("pitch_count"),
    )


def check_pitch_counts(games: DataFrame, pitches: DataFrame, least: int = 200) -> DataFrame:
    """Games below `least` pitches, per day."""
    rows = pitch_counts(games, pitches).groupBy("game_date").agg(
        F.sum(F.when(F.col("pitch_count") < least, 1).otherwise(0)).alias("short")
    )
    return _report(rows, "short games", "game_date", F.when(F.col("short") > 0, FAIL).otherwise(PASS), F.col("short"), F.lit(0))


def column_coverage(games: DataFrame, pitches: DataFrame) -> DataFrame:
    """Share of pitches with spin, exit speed and location, per day."""
    share = lambda c: half_up(F.count(c) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100, 1)
    rows = pitches.join(games.select("game_pk", "game_date"), "game_pk").groupBy("game_date").agg(
        F.count(F.lit(1)).cast("bigint").alias("pitches"), share("spin_rate").alias("spin_pct"),
        share("launch_speed").alias("launch_pct"), share("px").alias("location_pct"),
    )
    return rows.select(
        "*", (F.col("spin_pct") > 80).alias("spin_ok"), (F.col("launch_pct") > 5).alias("launch_ok"),
        (F.col("location_pct") > 90).alias("location_ok"),
    )


def check_column_coverage(games: DataFrame, pitches: DataFrame) -> DataFrame:
    rows = column_coverage(games, pitches)
    level = F.when(F.col("location_pct") < 80, FAIL).when(F.col("spin_pct") < 50, WARN).otherwise(PASS)
    return _report(rows, "measured columns", "game_date", level, F.col("location_pct"), F.lit(80))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).cast("bigint").alias("copies")).filter(F.col("copies") > 1)


def check_duplicates(games: DataFrame) -> DataFrame:
    rows = games.groupBy("game_date", "game_pk").agg(F.count(F.lit(1)).alias("c")).groupBy("game_date").agg(
        F.sum(F.when(F.col("c") > 1, 1).otherwise(0)).alias("n")
    )
    return _report(rows, "duplicate games", "game_date", F.when(F.col("n") > 0, FAIL).otherwise(PASS), F.col("n"), F.lit(0))


def check_status(games: DataFrame) -> DataFrame:
    """Games not final, per day; a game without status is not counted."""
    rows = games.groupBy("game_date").agg(F.sum(F.when(F.col("status") != "Final", 1).otherwise(0)).alias("n"))
    return _report(rows, "unfinished games", "game_date", F.when(F.col("n") > 0, WARN).otherwise(PASS), F.col("n"), F.lit(0))


def check_children(games: DataFrame, children: DataFrame, name: str = "runner data") -> DataFrame:
    """Games that have any child row against games stored, per day."""
    with_any = children.select("game_pk").distinct().withColumn("has", F.lit(1))
    rows = games.select("game_pk", "game_date").join(with_any, "game_pk", "left").groupBy("game_date").agg(
        F.countDistinct(F.when(F.col("has") == 1, F.col("game_pk"))).alias("have"), F.count(F.lit(1)).alias("stored")
    )
    level = F.when(F.col("have") == F.col("stored"), PASS).otherwise(WARN)
    return _report(rows, name, "game_date", level, F.col("have"), F.col("stored"))


def verdict(checks: list[DataFrame]) -> DataFrame:
    """Worst level per scope with the number of warnings and failures."""
    every = reduce(lambda a, b: a.unionByName(b), checks)
    worst = F.max("level")
    count = lambda level: F.sum(F.when(F.col("level") == level, 1).otherwise(0)).cast("bigint")
    return every.groupBy("scope").agg(
        F.when(worst == FAIL, "failed").when(worst == WARN, "passed with warnings").otherwise("passed").alias("verdict"),
        count(WARN).alias("warnings"), count(FAIL).alias("failures"),
    )


def run_checks(games, scheduled, at_bats, pitches, runners, low=25, high=45, least=200) -> list[DataFrame]:
    """All per-day checks."""
    return [
        check_coverage(games, scheduled), check_rows_per_game(at_bats, games, low, high),
        check_pitch_counts(games, pitches, least), check_column_coverage(games, pitches),
        check_duplicates(games), check_status(games), check_children(games, runners),
    ]

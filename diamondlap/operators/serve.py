"""Read queries over stored score rows and pitch tables.

Every read works for all seasons, pitchers and games at once; the optional
filters only narrow it, and reach the scan as plain predicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from diamondlap.functions import codes
from diamondlap.functions.groups import first_per_key, laid, top_k_per_group
from diamondlap.functions.scalars import (
    all_of, between_dates, half_up, match_text, match_unaccented, rate, ratio,
)


def _scores(sc: DataFrame, season=None, pitcher_id=None, game_type="R", pitch_type=None) -> DataFrame:
    return sc.filter(all_of([
        F.col("season") == season if season is not None else None,
        F.col("pitcher_id") == pitcher_id if pitcher_id is not None else None,
        F.col("game_type") == game_type if game_type is not None else None,
        F.col("pitch_type_code") == pitch_type if pitch_type is not None else None,
    ]))


def mean_of(column: str, digits: int, name: str | None = None) -> Column:
    return half_up(F.avg(column), digits).alias(name or column)


def _total_pitches(name="total_pitches") -> Column:
    return F.sum("pitches_thrown").cast("bigint").alias(name)


def _games() -> Column:
    return F.countDistinct("game_pk").cast("bigint").alias("games")


def leaderboard(
    sc: DataFrame, season: int | None = None, game_type: str = "R", min_pitches: int = 200,
    pitch_type: str | None = None, k: int = 200,
) -> DataFrame:
    """Best k pitcher x type rows of each season by mean score.

    The mean is over game rows, each counting once whatever its pitch count.
    """
    rows = (
        _scores(sc, season, None, game_type, pitch_type)
        .groupBy("season", "pitcher_id", "pitch_type_code")
        .agg(
            F.max("pitcher_name").alias("pitcher_name"),
            _total_pitches(),
            mean_of("value_plus", 1, "season_value_plus"),
            mean_of("avg_velo", 1),
            mean_of("whiff_rate", 3),
            mean_of("csw_rate", 3),
            mean_of("hard_hit_rate", 3),
            _games(),
        )
        .filter(F.col("total_pitches") >= min_pitches)
    )
    order = [
        F.col("season_value_plus").desc_nulls_first(), F.col("total_pitches").desc(),
        F.col("pitcher_id"), F.col("pitch_type_code"),
    ]
    if season is not None:
        return rows.orderBy(*order).limit(k)
    return top_k_per_group(rows, "season", order, k)


def profile(sc: DataFrame, season: int | None = None, pitcher_id: int | None = None) -> DataFrame:
    """A pitcher's season by pitch type, all game types."""
    return _scores(sc, season, pitcher_id, None).groupBy("season", "pitcher_id", "pitch_type_code").agg(
        _total_pitches(),
        mean_of("value_plus", 1, "season_value_plus"),
        mean_of("avg_velo", 1),
        mean_of("avg_spin", 0),
        mean_of("whiff_rate", 3),
        mean_of("csw_rate", 3),
        mean_of("hard_hit_rate", 3),
        _games(),
    )


COMPARED = {
    "value_plus": 1, "avg_velo": 1, "avg_spin": 0, "avg_hmov": 2, "avg_ivb": 2,
    "whiff_rate": 3, "csw_rate": 3, "hard_hit_rate": 3,
}
CHANGES = {"value_plus": 1, "avg_velo": 1, "avg_hmov": 2, "avg_ivb": 2}


def season_compare(sc: DataFrame, season_a: int, season_b: int, pitcher_id: int | None = None) -> DataFrame:
    """Two regular seasons side by side per pitcher and type, with changes.

    Each season is aggregated by itself, in one pass with one distinct count; of the
    few rows that leaves, the second aggregation puts two beside each other, which
    gives the rows a full outer join would.
    """
    per_season = _scores(sc, None, pitcher_id).filter(F.col("season").isin(season_a, season_b)).groupBy("pitcher_id", "pitch_type_code", "season").agg(
        F.sum("pitches_thrown").cast("bigint").alias("pitches"), F.nullif(F.countDistinct("game_pk"), F.lit(0)).cast("bigint").alias("games"),
        *[mean_of(c, d) for c, d in COMPARED.items()],
    )
    beside = [
        F.max(F.when(F.col("season") == season, F.col(c))).alias(f"{c}_{tag}")
        for tag, season in (("a", season_a), ("b", season_b)) for c in ("pitches", "games", *COMPARED)
    ]
    return per_season.groupBy("pitcher_id", "pitch_type_code").agg(*beside).select(
        "*", *[half_up(F.col(f"{c}_b") - F.col(f"{c}_a"), d).alias(f"{c}_change") for c, d in CHANGES.items()]
    )


def game_log(
    sc: DataFrame, games: DataFrame, at_bats: DataFrame, season: int | None = None,
    pitcher_id: int | None = None,
) -> DataFrame:
    """One row per pitcher and game with the opponent and a list of pitch types.

    The visiting side bats in the top half, so whoever pitches there is at home.
    """
    rows = _scores(sc, season, pitcher_id)
    line = F.struct(
        (-F.col("pitches_thrown")).alias("order"), "pitch_type_code", "pitches_thrown",
        half_up("value_plus", 1).alias("value_plus"), half_up("avg_velo", 1).alias("avg_velo"),
        half_up("whiff_rate", 3).alias("whiff_rate"), half_up("csw_rate", 3).alias("csw_rate"),
        half_up("avg_spin", 0).alias("avg_spin"), half_up("avg_hmov", 2).alias("avg_hmov"),
        half_up("avg_ivb", 2).alias("avg_ivb"),
    )
    totals = rows.groupBy("pitcher_id", "season", "game_pk").agg(
        F.max("game_date").alias("game_date"),
        _total_pitches(),
        mean_of("value_plus", 1, "avg_value_plus"),
        mean_of("avg_velo", 1),
        mean_of("whiff_rate", 3),
        mean_of("csw_rate", 3),
        mean_of("hard_hit_rate", 3),
        # One entry per pitch type: a handful per pitcher and game.
        F.array_sort(F.collect_list(line)).alias("__lines"),
    )
    sides = at_bats.filter(F.col("pitcher_id").isNotNull())
    if pitcher_id is not None:
        sides = sides.filter(F.col("pitcher_id") == pitcher_id)
    sides = sides.groupBy("game_pk", "pitcher_id").agg(
        F.max(F.col("half_inning") == "top").alias("is_home")
    )
    clubs = games.select("game_pk", "home_team_abbrev", "away_team_abbrev")
    opponent = F.when(F.col("is_home"), F.col("away_team_abbrev")).otherwise(F.col("home_team_abbrev"))
    return (
        totals.join(sides, ["game_pk", "pitcher_id"], "left")
        .join(clubs, "game_pk", "left")
        .select(
            *[c for c in totals.columns if c != "__lines"],
            F.when(F.col("is_home").isNotNull(), opponent).alias("opponent"),
            "is_home",
            F.transform("__lines", lambda x: x.dropFields("order")).alias("pitches"),
        )
    )


def pitcher_search(at_bats: DataFrame, text: str, k: int = 10) -> DataFrame:
    """First k pitchers by name whose name contains text, accents ignored."""
    return (
        at_bats.filter(match_unaccented("pitcher_name", text) & F.col("pitcher_id").isNotNull())
        .select("pitcher_id", "pitcher_name").distinct()
        .orderBy("pitcher_name", "pitcher_id").limit(k)
    )


def batter_rows(tt: DataFrame, at_bats: DataFrame, name: str, season: int | None = None) -> DataFrame:
    """Tendency rows of the first batter, by id, whose name contains the text."""
    one = (
        at_bats.filter(match_text("batter_name", name) & F.col("batter_id").isNotNull())
        .select("batter_id", "batter_name").distinct()
        .orderBy("batter_id", "batter_name").limit(1)
    )
    rows = tt if season is None else tt.filter(F.col("season") == season)
    return rows.join(F.broadcast(one), "batter_id").select(
        "batter_id", "batter_name", "season", "pitch_type_code", "whiff_rate", "chase_rate",
        "hard_hit_rate", "avg_exit_velo", "csw_rate",
    )


def batter_lookup(tt: DataFrame, at_bats: DataFrame, name: str, season: int | None = None) -> DataFrame:
    """The same as one map per season, keyed by pitch type."""
    rows = batter_rows(tt, at_bats, name, season)
    entry = F.struct("whiff_rate", "chase_rate", "hard_hit_rate", "avg_exit_velo", "csw_rate")
    # One entry per pitch type and season of one batter.
    return rows.groupBy("batter_id", "batter_name", "season").agg(
        F.map_from_entries(F.collect_list(F.struct("pitch_type_code", entry))).alias("tendencies")
    )


def _pitch_lines(pitches: DataFrame, at_bats: DataFrame) -> DataFrame:
    names = at_bats.select("game_pk", "at_bat_index", "pitcher_name")
    return pitches.filter(F.col("pitch_type_code").isNotNull()).hint("merge").join(names, ["game_pk", "at_bat_index"])  # both grow with the games


def in_game_stats(pitches: DataFrame, at_bats: DataFrame, min_pitches: int = 5, k: int | None = 10, tasks: int | None = None) -> DataFrame:
    """Pitcher x type lines of each game; the k longest, or all. With `tasks` all of a game is made in one of so many."""
    rows = (
        laid(_pitch_lines(pitches, at_bats), tasks, "game_pk")
        .groupBy("game_pk", "pitcher_name", "pitch_type_code")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("pitches"),
            half_up(F.avg("start_speed"), 1).alias("avg_velo"),
            half_up(rate(F.col("call_code").isin(*codes.CSW)), 3).alias("csw_rate"),
        )
        .filter(F.col("pitches") >= min_pitches)
    )
    if k is None:
        return rows
    order = [F.col("pitches").desc(), F.col("pitcher_name"), F.col("pitch_type_code")]
    return top_k_per_group(rows, "game_pk", order, k)


def poll_pitcher_stats(pitches: DataFrame, at_bats: DataFrame, min_pitches: int = 5) -> DataFrame:
    """Lines as polled during a game: here whiffs are per pitch, not per swing."""
    call = F.col("call_code")
    return (
        _pitch_lines(pitches, at_bats)
        .groupBy("game_pk", "pitcher_id", "pitcher_name", "pitch_type_code")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("pitches"),
            half_up(rate(call.isin(*codes.CSW)), 3).alias("csw_rate"),
            half_up(rate(call.isin(*codes.WHIFF)), 3).alias("whiff_rate"),
            half_up(F.avg("start_speed"), 1).alias("avg_velo"),
            half_up(F.avg("spin_rate"), 0).alias("avg_spin"),
        )
        .filter(F.col("pitches") >= min_pitches)
    )


def pitches_today(
    pitches: DataFrame, games: DataFrame, day: str | None = None, pitcher_id: int | None = None,
    min_pitches: int = 5,
) -> DataFrame:
    """A pitcher's lines by type for one day, or for every day."""
    days = games.select("game_pk", "game_date").filter(between_dates("game_date", day, day))
    rows = pitches.filter(F.col("pitch_type_code").isNotNull())
    if pitcher_id is not None:
        rows = rows.filter(F.col("pitcher_id") == pitcher_id)
    call = F.col("call_code")
    return (
        rows.join(days, "game_pk")
        .groupBy("game_date", "pitcher_id", "pitch_type_code")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("pitches"),
            half_up(F.avg("start_speed"), 1).alias("avg_velo"),
            half_up(rate(call.isin(*codes.CSW)), 3).alias("csw_rate"),
            half_up(ratio(call.isin(*codes.WHIFF), call.isin(*codes.SWING)), 3).alias("whiff_rate"),
        )
        .filter(F.col("pitches") >= min_pitches)
    )


def score(linescore: DataFrame) -> DataFrame:
    """Runs of both sides and the inning reached, per game."""
    runs = lambda half: F.sum(F.when(F.col("half_inning") == half, F.col("runs")).otherwise(0))
    return linescore.groupBy("game_pk").agg(
        F.coalesce(runs("top"), F.lit(0)).cast("bigint").alias("away_score"),
        F.coalesce(runs("bottom"), F.lit(0)).cast("bigint").alias("home_score"),
        F.max("inning").alias("inning"),
    )


def game_board(
    schedule: DataFrame, linescore: DataFrame, pitches: DataFrame, at_bats: DataFrame, min_pitches: int = 5, k: int = 10,
    tasks: int | None = None,
) -> DataFrame:
    """Running and finished games with their score and longest pitcher lines. `tasks` is for large tables, whose rows
    would be sorted in too large pieces by the session's number of tasks."""
    shown = laid(schedule.filter(F.col("status").isin(*codes.LIVE_STATES, *codes.FINAL_STATES)), tasks, "game_pk")
    keys = shown.select("game_pk")
    thrown = laid(pitches.join(keys, "game_pk", "left_semi"), tasks, "game_pk", "at_bat_index")
    lines = in_game_stats(thrown, at_bats, min_pitches, k, tasks)
    # At most k lines per game by construction.
    listed = lines.groupBy("game_pk").agg(
        F.array_sort(F.collect_list(F.struct(
            (-F.col("pitches")).alias("order"), "pitcher_name", "pitch_type_code", "pitches",
            "avg_velo", "csw_rate",
        ))).alias("__lines")
    )
    return (
        shown.join(score(linescore), "game_pk", "left")
        .join(listed, "game_pk", "left")
        .select(
            *[c for c in shown.columns if c not in ("away_score", "home_score", "inning")],
            F.coalesce("away_score", F.lit(0)).alias("away_score"),
            F.coalesce("home_score", F.lit(0)).alias("home_score"),
            "inning",
            F.col("status").isin(*codes.LIVE_STATES).alias("is_live"),
            F.col("status").isin(*codes.FINAL_STATES).alias("is_final"),
            F.coalesce(
                F.transform("__lines", lambda x: x.dropFields("order")), F.array()
            ).alias("pitcher_stats"),
        )
    )


def flatten_counts(games: DataFrame, at_bats: DataFrame, pitches: DataFrame) -> DataFrame:
    """At-bats and pitches per stored game, games without any included."""
    per = lambda df, name: df.groupBy("game_pk").agg(F.count(F.lit(1)).cast("bigint").alias(name))
    return (
        games.select(
            "game_pk", "status",
            F.concat_ws(" @ ", "away_team_abbrev", "home_team_abbrev").alias("matchup"),
        )
        .join(per(at_bats, "at_bats"), "game_pk", "left")
        .join(per(pitches, "pitches"), "game_pk", "left")
        .na.fill(0, ["at_bats", "pitches"])
    )


def pitch_mix(sc: DataFrame, season: int | None = None, min_pitches: int = 50) -> DataFrame:
    """Each pitcher's types with at least min_pitches, and their share of use."""
    rows = (
        _scores(sc, season)
        .groupBy("season", "pitcher_id", "pitch_type_code")
        .agg(
            mean_of("value_plus", 1),
            mean_of("whiff_rate", 3),
            mean_of("csw_rate", 3),
            mean_of("hard_hit_rate", 3),
            mean_of("avg_velo", 1),
            _total_pitches(),
        )
        .filter(F.col("total_pitches") >= min_pitches)
    )
    # The window runs over one row per pitch type of a pitcher's season.
    arsenal = Window.partitionBy("season", "pitcher_id")
    return rows.withColumn("usage", F.col("total_pitches") / F.sum("total_pitches").over(arsenal))


def batter_k(box: DataFrame, games: DataFrame, season: int | None = None, min_ab: int = 50) -> DataFrame:
    """Strikeouts per at-bat over a regular season."""
    wanted = games.filter(all_of([
        F.col("game_type") == "R", F.col("season") == season if season is not None else None,
    ])).select("game_pk", "season")
    return (
        box.join(wanted, "game_pk")
        .groupBy("season", F.col("player_id").alias("batter_id"))
        .agg(
            F.sum("strikeouts").alias("__so"), F.sum("at_bats").cast("bigint").alias("at_bats"),
        )
        .filter(F.col("at_bats") >= min_ab)
        .select("season", "batter_id", "at_bats",
                (F.col("__so") / F.nullif(F.col("at_bats"), F.lit(0))).alias("batter_k_pct"))
    )


def rolling_scores(sc: DataFrame, days: int = 30) -> DataFrame:
    """Mean score of the last `days` days as of every day a pitcher threw a type.

    Rows are first summed per day, so the window holds one row per day however
    many game rows there are.
    """
    daily = (
        sc.filter(F.col("game_type") == "R")
        .groupBy("pitcher_id", "pitch_type_code", "game_date")
        .agg(
            F.sum("value_plus").alias("__sum"), F.count("value_plus").alias("__n"),
            F.sum("pitches_thrown").alias("__pitches"),
        )
        .withColumn("__day", F.unix_date(F.to_date("game_date")))
    )
    span = (
        Window.partitionBy("pitcher_id", "pitch_type_code").orderBy("__day").rangeBetween(-(days - 1), 0)
    )
    return daily.select(
        "pitcher_id", "pitch_type_code", "game_date",
        F.sum("__n").over(span).cast("bigint").alias("games"),
        F.sum("__pitches").over(span).cast("bigint").alias("pitches"),
        half_up(F.sum("__sum").over(span) / F.nullif(F.sum("__n").over(span), F.lit(0)), 1).alias("value_plus"),
    )


def rolling_starts(sc: DataFrame, n: int = 5) -> DataFrame:
    """Mean score over each pitcher's last n games per type."""
    rows = sc.filter(F.col("game_type") == "R")
    newest = [F.col("game_date").desc(), F.col("game_pk").desc()]
    return top_k_per_group(rows, ["pitcher_id", "pitch_type_code"], newest, n).groupBy(
        "pitcher_id", "pitch_type_code"
    ).agg(
        F.count(F.lit(1)).cast("bigint").alias("games"),
        F.min("game_date").alias("since"),
        mean_of("value_plus", 1),
    )


def latest_name(at_bats: DataFrame, who: str = "pitcher") -> DataFrame:
    """One name per player id (the greatest, as MAX picks)."""
    return at_bats.filter(F.col(f"{who}_id").isNotNull()).groupBy(f"{who}_id").agg(
        F.max(f"{who}_name").alias(f"{who}_name")
    )


def first_name_row(at_bats: DataFrame) -> DataFrame:
    """One row per pitcher, picked by a stated order."""
    rows = at_bats.select("pitcher_id", "pitcher_name").dropna()
    return first_per_key(rows, "pitcher_id", [F.col("pitcher_name")])

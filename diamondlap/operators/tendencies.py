"""Batter tendencies by pitch type and by zone, and the season weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from diamondlap.functions import codes
from diamondlap.functions.groups import join_back
from diamondlap.functions.scalars import all_of, between_dates, half_up, in_zone, rate, ratio


def pitch_context(
    pitches: DataFrame, at_bats: DataFrame, games: DataFrame, columns: Sequence[str | Column],
    games_where: Column | None = None, at_bats_where: Column | None = None,
    pitches_where: Column | None = None, by_game: bool = False,
) -> DataFrame:
    """Pitches with their at-bat and game, inner joined.

    At-bats meet games first: both are far smaller than pitches, so the pitch
    rows are shuffled once (or not at all when both are stored in buckets). Neither side is broadcast: both
    grow with the games, and files of many columns tell too little of what a few of them take up in memory.
    The two-column key spreads one very long game over many tasks. With `by_game` all rows of a game meet in one
    task instead, as its at-bats do when they meet the game, and what is grouped by game afterwards stays where it
    is; that takes effect where the result is written by staging.stage_by_game.
    """
    p = pitches if pitches_where is None else pitches.filter(pitches_where)
    a = at_bats if at_bats_where is None else at_bats.filter(at_bats_where)
    g = games if games_where is None else games.filter(games_where)
    # A column held by more than one table is taken from the finest of them.
    a = a.select("game_pk", "at_bat_index", *[c for c in a.columns if c not in pitches.columns])
    g = g.select("game_pk", *[c for c in g.columns if c not in {*a.columns, *pitches.columns}])
    if by_game:
        p, a = p.repartition("game_pk"), a.hint("merge")
    return p.hint("merge").join(a.join(g, "game_pk"), ["game_pk", "at_bat_index"]).select(*columns)


def game_scope(
    season: int | None = None, start: str | None = None, end: str | None = None, game_pk: int | None = None,
    game_types: Sequence[str] | None = ("R", "S"),
) -> Column | None:
    """The condition on games that a scope stands for; none if it holds all."""
    return all_of([
        F.col("game_type").isin(*game_types) if game_types is not None else None,
        F.col("season") == season if season is not None else None,
        between_dates("game_date", start, end),
        F.col("game_pk") == game_pk if game_pk is not None else None,
    ])


def load_pitches(
    pitches: DataFrame, at_bats: DataFrame, games: DataFrame, season: int | None = None,
    start: str | None = None, end: str | None = None, game_pk: int | None = None,
    game_types: Sequence[str] | None = ("R", "S"), pitch_types: Sequence[str] = codes.PITCH_TYPES,
    by_game: bool = False,
) -> DataFrame:
    """Scorable pitches of the chosen scope; batted-ball facts only when in play. `by_game` as in pitch_context."""
    in_play = F.col("call_code") == codes.IN_PLAY
    batted = lambda name: F.when(in_play, F.col(name)).alias(name)
    # The batter is the at-bat's; the copy on the pitch row gives way to it.
    slim = pitches.drop("batter_id")
    return pitch_context(
        slim, at_bats, games,
        [
            "game_pk", "game_date", "game_type", "season", "pitcher_id", "pitcher_name",
            "pitch_type_code", "call_code", "zone", "start_speed", "spin_rate", "pfx_x",
            "pfx_z", "batter_id", batted("launch_speed"), batted("launch_angle"),
            batted("event_type"),
        ],
        games_where=game_scope(season, start, end, game_pk, game_types),
        at_bats_where=F.col("batter_id").isNotNull(),
        pitches_where=F.col("pitch_type_code").isin(*pitch_types) & F.col("call_code").isNotNull(), by_game=by_game,
    )


def _tendency_rows(pitches, at_bats, games, seasons, pitches_where, key, by_game=False) -> DataFrame:
    return pitch_context(
        pitches.drop("batter_id"), at_bats, games,
        ["batter_id", key, "season", "call_code", "launch_speed", "launch_angle", "is_in_play",
         *(["zone"] if key != "zone" else [])],
        games_where=all_of([
            F.col("game_type") == "R",
            F.col("season").isin(*seasons) if seasons is not None else None,
        ]),
        at_bats_where=F.col("batter_id").isNotNull(),
        pitches_where=pitches_where & F.col("call_code").isNotNull(), by_game=by_game,
    )


def _shared_rates() -> dict[str, Column]:
    call, speed = F.col("call_code"), F.col("launch_speed")
    in_play, swing = F.col("is_in_play"), call.isin(*codes.SWING)
    return {
        "swing_rate": half_up(rate(swing), 4),
        "whiff_rate": half_up(ratio(call.isin(*codes.WHIFF), swing), 4),
        "contact_rate": half_up(ratio(call.isin(*codes.CONTACT), swing), 4),
        "in_play_rate": half_up(rate(call == codes.IN_PLAY), 4),
        "hard_hit_rate": half_up(ratio(speed >= codes.HARD_HIT, in_play), 4),
        "avg_exit_velo": half_up(F.avg(F.when(in_play, speed)), 2),
    }


def pitch_type_tendencies(
    pitches: DataFrame, at_bats: DataFrame, games: DataFrame,
    seasons: Sequence[int] | None = None, min_pitches: int = 50, with_woba: DataFrame | None = None,
    by_game: bool = False,
) -> DataFrame:
    """Batter x pitch type x season rates over regular-season games. `by_game` as in pitch_context.

    `with_woba` (a linear-weights table) adds the measured mean weight on
    contact; without it avg_woba_on_contact stays NULL and readers default it.
    """
    rows = _tendency_rows(
        pitches, at_bats, games, seasons, F.col("pitch_type_code").isin(*codes.PITCH_TYPES),
        "pitch_type_code", by_game,
    )
    call = F.col("call_code")
    speed, angle, in_play = F.col("launch_speed"), F.col("launch_angle"), F.col("is_in_play")
    outside = ~in_zone("zone")
    barrel = (speed >= codes.BARREL_SPEED) & angle.between(*codes.BARREL_ANGLE)
    out = (
        rows.groupBy("batter_id", "pitch_type_code", "season")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("pitches_faced"),
            *[c.alias(n) for n, c in _shared_rates().items()],
            half_up(ratio(call.isin(*codes.SWING) & outside, outside), 4).alias("chase_rate"),
            half_up(rate(call.isin(*codes.CSW)), 4).alias("csw_rate"),
            half_up(F.avg(F.when(in_play, angle)), 2).alias("avg_launch_angle"),
            half_up(ratio(barrel, in_play), 4).alias("barrel_rate"),
        )
        .filter(F.col("pitches_faced") >= min_pitches)
    )
    if with_woba is None:
        return out.withColumn("avg_woba_on_contact", F.lit(None).cast("double"))
    contact = woba_on_contact(pitches, at_bats, games, with_woba, seasons)
    return out.join(contact, ["batter_id", "pitch_type_code", "season"], "left")


def woba_on_contact(pitches, at_bats, games, weights: DataFrame, seasons=None) -> DataFrame:
    """Mean linear weight of the balls a batter put in play, outs worth zero."""
    rows = pitch_context(
        pitches.drop("batter_id"), at_bats, games,
        ["batter_id", "pitch_type_code", "season", "event_type"],
        games_where=all_of([
            F.col("game_type") == "R",
            F.col("season").isin(*seasons) if seasons is not None else None,
        ]),
        at_bats_where=F.col("batter_id").isNotNull(),
        pitches_where=F.col("call_code") == codes.IN_PLAY,
    )
    event = F.lower("event_type")
    worth = F.lit(0.0)
    for name in codes.HIT_EVENTS:
        worth = F.when(event == name, F.col(codes.EVENT_WEIGHT[name][0])).otherwise(worth)
    return (
        with_season_weights(rows, weights)
        .groupBy("batter_id", "pitch_type_code", "season")
        .agg(half_up(F.avg(worth), 4).alias("avg_woba_on_contact"))
    )


def zone_tendencies(
    pitches: DataFrame, at_bats: DataFrame, games: DataFrame,
    seasons: Sequence[int] | None = None, min_pitches: int = 20,
) -> DataFrame:
    """Batter x zone x season rates over regular-season games."""
    rows = _tendency_rows(pitches, at_bats, games, seasons, F.col("zone").between(1, 14), "zone")
    take = ~F.col("call_code").isin(*codes.SWING)
    return (
        rows.groupBy("batter_id", "zone", "season")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("pitches_faced"),
            *[c.alias(n) for n, c in _shared_rates().items()],
            half_up(rate(take), 4).alias("take_rate"),
        )
        .filter(F.col("pitches_faced") >= min_pitches)
    )


def linear_weights(spark: SparkSession, seasons: Sequence[int] = tuple(codes.LINEAR_WEIGHTS)) -> DataFrame:
    """Season weights; a season without its own takes the default season's."""
    fallback = codes.LINEAR_WEIGHTS[codes.DEFAULT_WEIGHT_SEASON]
    rows = [(int(s), *codes.LINEAR_WEIGHTS.get(int(s), fallback)) for s in seasons]
    schema = "season INT, " + ", ".join(f"{c} DOUBLE" for c in codes.WEIGHT_COLUMNS)
    return spark.createDataFrame(rows, schema)


def with_season_weights(df: DataFrame, weights: DataFrame, season_col: str = "season") -> DataFrame:
    """Attach the weight columns of each row's season; any season without its own
    takes the default season's. Both joins are with the few weight rows."""
    own = F.broadcast(weights.select(F.col("season").alias("__season"), F.struct(*codes.WEIGHT_COLUMNS).alias("__own")))
    fallback = own.filter(F.col("__season") == codes.DEFAULT_WEIGHT_SEASON).select(
        F.col("__season").alias("__default_season"), F.col("__own").alias("__default")
    )
    rows = df.withColumn("__wanted", F.lit(codes.DEFAULT_WEIGHT_SEASON))
    rows = rows.join(own, F.col(season_col) == F.col("__season"), "left")
    rows = rows.join(F.broadcast(fallback), F.col("__wanted") == F.col("__default_season"), "left")
    chosen = F.coalesce("__own", "__default")
    return rows.select(*df.columns, *[chosen[c].alias(c) for c in codes.WEIGHT_COLUMNS])

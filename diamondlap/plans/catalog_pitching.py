"""Tendencies, pitch value and score queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from diamondlap.functions import codes
from diamondlap.functions.scalars import half_up
from diamondlap.operators import pitch_value as pv, tendencies as td
from diamondlap.plans.registry import n, query, r
from diamondlap.plans.tables import Tables, with_views
from diamondlap.sources.staging import stage_by_game

MIN_FACED = 3

TYPES = "('FF','SI','SL','CH','FC','ST','CU','FS','KC')"
SWING = "('S','W','T','F','D','E','X')"
WHIFF = "('S','W','T')"
CSW = "('S','W','T','C')"
CONTACT = "('F','D','E','X')"
JOINED = (
    "FROM pitches p JOIN at_bats a ON a.game_pk = p.game_pk AND a.at_bat_index = p.at_bat_index "
    "JOIN games g ON g.game_pk = p.game_pk"
)
PITCH_VIEWS = ["games", "at_bats", "pitches"]


def _rate(cond: str) -> str:
    return f"avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END)"


def _ratio(a: str, b: str) -> str:
    return f"sum(CASE WHEN {a} THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN {b} THEN 1.0 ELSE 0.0 END), 0)"


_SHARED = ", ".join([
    f"{r(_rate(f'p.call_code IN {SWING}'), 4)} AS swing_rate",
    f"{r(_ratio(f'p.call_code IN {WHIFF}', f'p.call_code IN {SWING}'), 4)} AS whiff_rate",
    f"{r(_ratio(f'p.call_code IN {CONTACT}', f'p.call_code IN {SWING}'), 4)} AS contact_rate",
    f"{r(_rate('p.call_code = ' + repr('X')), 4)} AS in_play_rate",
    f"{r(_ratio('p.launch_speed >= 95', 'p.is_in_play'), 4)} AS hard_hit_rate",
    f"{r('avg(CASE WHEN p.is_in_play THEN p.launch_speed END)', 2)} AS avg_exit_velo",
])
_OUT = "p.zone NOT BETWEEN 1 AND 9"


def tt_select(min_faced: int) -> str:
    return (
        f"SELECT a.batter_id, p.pitch_type_code, g.season, {n('count(*)')} AS pitches_faced, {_SHARED}, "
        f"{r(_ratio(f'p.call_code IN {SWING} AND {_OUT}', _OUT), 4)} AS chase_rate, "
        f"{r(_rate(f'p.call_code IN {CSW}'), 4)} AS csw_rate, "
        f"{r('avg(CASE WHEN p.is_in_play THEN p.launch_angle END)', 2)} AS avg_launch_angle, "
        f"{r(_ratio('p.launch_speed >= 98 AND p.launch_angle BETWEEN 26 AND 30', 'p.is_in_play'), 4)} AS barrel_rate "
        f"{JOINED} WHERE g.game_type = 'R' AND p.pitch_type_code IN {TYPES} AND p.call_code IS NOT NULL "
        f"AND a.batter_id IS NOT NULL GROUP BY a.batter_id, p.pitch_type_code, g.season HAVING count(*) >= {min_faced}"
    )


TZ = (
    f"SELECT a.batter_id, p.zone, g.season, {n('count(*)')} AS pitches_faced, {_SHARED}, "
    f"{r(_rate(f'p.call_code NOT IN {SWING}'), 4)} AS take_rate {JOINED} "
    f"WHERE g.game_type = 'R' AND p.zone BETWEEN 1 AND 14 AND p.call_code IS NOT NULL "
    f"AND a.batter_id IS NOT NULL GROUP BY a.batter_id, p.zone, g.season HAVING count(*) >= {MIN_FACED}"
)

_W = codes.WEIGHT_COLUMNS
LW = "lw AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join([str(s), *[f"CAST({v} AS DOUBLE)" for v in w]]) + ")"
    for s, w in codes.LINEAR_WEIGHTS.items()
) + f") AS x(season, {', '.join(_W)}))"

LOADED = (
    "loaded AS (SELECT p.game_pk, g.game_date, g.game_type, g.season, p.pitcher_id, a.pitcher_name, "
    "p.pitch_type_code, p.call_code, p.zone, p.start_speed, p.spin_rate, p.pfx_x, p.pfx_z, a.batter_id, "
    "CASE WHEN p.call_code = 'X' THEN p.launch_speed END AS launch_speed, "
    "CASE WHEN p.call_code = 'X' THEN p.launch_angle END AS launch_angle, "
    f"CASE WHEN p.call_code = 'X' THEN a.event_type END AS event_type {JOINED} "
    f"WHERE g.game_type IN ('R','S') AND p.pitch_type_code IN {TYPES} AND p.call_code IS NOT NULL "
    "AND a.batter_id IS NOT NULL)"
)


def _weight(src: str) -> str:
    return (
        f"CASE v.event_type WHEN 'single' THEN {src}weight_single WHEN 'double' THEN {src}weight_double "
        f"WHEN 'triple' THEN {src}weight_triple WHEN 'home_run' THEN {src}weight_hr "
        f"WHEN 'grounded_into_double_play' THEN {src}weight_out * 2 WHEN 'sac_fly' THEN {src}weight_out * 0.5 "
        f"ELSE {src}weight_out END"
    )


def _bonus(edge: str) -> str:
    """Without a league rate the bonus is unknown; greatest() alone would read
    the missing edge as zero."""
    return f"(1 + CASE WHEN ({edge}) IS NULL THEN NULL ELSE greatest(0, {edge}) END)"


def _value(weight: str, whiff: str, chase: str, hard: str) -> str:
    return (
        f"CASE WHEN v.call_code IN {WHIFF} THEN 0.170 * {_bonus(whiff)} "
        f"WHEN v.call_code = 'C' THEN 0.025 * {_bonus(chase)} "
        "WHEN v.call_code IN ('F','D','E','L') THEN 0.020 WHEN v.call_code IN ('B','*B','H') THEN -0.040 "
        f"WHEN v.call_code = 'X' THEN -({weight}) * CASE "
        "WHEN v.launch_speed >= 95 AND v.event_type IN ('single','double','triple','home_run') "
        f"THEN {_bonus(hard)} WHEN v.launch_speed >= 95 THEN 0.5 "
        "WHEN v.launch_speed < 85 THEN 0.85 ELSE 1.0 END "
        "WHEN v.call_code = 'M' THEN -0.150 ELSE 0.0 END"
    )


_EDGE = lambda league, own: f"c.{league} - coalesce(nullif(t.{own}, 0), c.{league})"
VALUED = ", ".join([
    f"tt AS ({tt_select(MIN_FACED)})",
    LW,
    LOADED,
    "league AS (SELECT season, count(*) AS n_rows, avg(nullif(whiff_rate, 0)) AS lwh, "
    "avg(nullif(chase_rate, 0)) AS lch, avg(nullif(hard_hit_rate, 0)) AS lhh FROM tt GROUP BY season)",
    "ctx AS (SELECT s.season, s.season - CASE WHEN coalesce(o.n_rows, 0) > 100 THEN 0 ELSE 1 END AS ts "
    "FROM (SELECT DISTINCT season FROM games) s LEFT JOIN league o ON o.season = s.season)",
    "valued AS (SELECT v.*, CAST(" + _value(
        _weight("w."), _EDGE("lwh", "whiff_rate"), _EDGE("lch", "chase_rate"), _EDGE("lhh", "hard_hit_rate")
    ) + " AS DOUBLE) AS value FROM loaded v JOIN ctx x ON x.season = v.season LEFT JOIN league c ON c.season = x.ts "
    "LEFT JOIN tt t ON t.season = x.ts AND t.batter_id = v.batter_id AND t.pitch_type_code = v.pitch_type_code "
    "JOIN lw w ON w.season = CASE WHEN x.ts IN (2023, 2024, 2025) THEN x.ts ELSE 2024 END)",
    "game_rows AS (SELECT game_pk, game_date, game_type, season, pitcher_id, pitcher_name, pitch_type_code, "
    f"{n('count(value)')} AS pitches_thrown, avg(value) AS avg_value, avg(start_speed) AS avg_velo, "
    "avg(spin_rate) AS avg_spin, avg(pfx_x) AS avg_hmov, avg(pfx_z) AS avg_ivb, "
    f"sum(CASE WHEN call_code IN {WHIFF} THEN 1.0 ELSE 0 END) / greatest(sum(CASE WHEN call_code IN {SWING} THEN 1.0 ELSE 0 END), 1) AS whiff_rate, "
    f"avg(CASE WHEN call_code = 'C' THEN 1.0 ELSE 0 END) AS cs_rate, avg(CASE WHEN call_code IN {CSW} THEN 1.0 ELSE 0 END) AS csw_rate, "
    "avg(CASE WHEN call_code = 'X' THEN 1.0 ELSE 0 END) AS in_play_rate, "
    "avg(CASE WHEN launch_speed >= 95 THEN 1.0 ELSE 0 END) AS hard_hit_rate "
    "FROM valued GROUP BY ALL HAVING count(value) >= 1)",
])


def normalised(scope: str, source: str = "game_rows", min_rows: int = 3) -> str:
    return (
        f"means AS (SELECT {scope}, pitch_type_code, avg(avg_value) AS m, count(avg_value) AS k FROM {source} "
        f"GROUP BY {scope}, pitch_type_code), "
        f"lgv AS (SELECT {scope}, avg(value) AS lv FROM valued GROUP BY {scope}), "
        f"scored AS (SELECT s.*, CASE WHEN abs(CASE WHEN k >= {min_rows} THEN m ELSE lv END) < 0.0001 THEN 100.0 ELSE "
        + r(f"avg_value / abs(CASE WHEN k >= {min_rows} THEN m ELSE lv END) * 100", 1)
        + f" END AS value_plus FROM {source} s JOIN means USING ({scope}, pitch_type_code) JOIN lgv USING ({scope}))"
    )


def six(df: DataFrame, *columns: str) -> DataFrame:
    """Unrounded means cut to six places, so that summing order cannot show."""
    return df.select(*[half_up(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def sql_six(names, rounded) -> str:
    return ", ".join(f"{r(c, 6)} AS {c}" if c in rounded else c for c in names)


def tendencies(t: Tables, by_game: bool = False) -> DataFrame:
    return td.pitch_type_tendencies(t.pitches, t.at_bats, t.games, min_pitches=MIN_FACED, by_game=by_game)


def loaded(t: Tables, **scope) -> DataFrame:
    return td.load_pitches(t.pitches, t.at_bats, t.games, **scope)


def stored_tendencies(t: Tables) -> DataFrame:
    """As tendencies() gives them, written once: scoring reads them for the batters and for the league."""
    return stage_by_game(tendencies(t, by_game=True), "tendencies")


def scored(t: Tables, scope=("season",)) -> DataFrame:
    return pv.score_pitches(
        loaded(t, by_game=True), stored_tendencies(t), td.linear_weights(t.spark), scope=scope
    )


LOADED_COLUMNS = [
    "game_pk", "game_date", "game_type", "season", "pitcher_id", "pitcher_name", "pitch_type_code",
    "call_code", "zone", "start_speed", "spin_rate", "pfx_x", "pfx_z", "batter_id", "launch_speed",
    "launch_angle", "event_type",
]
GAME_ROW = [
    "game_pk", "game_date", "game_type", "season", "pitcher_id", "pitcher_name", "pitch_type_code",
    "pitches_thrown", "avg_value", "avg_velo", "avg_spin", "avg_hmov", "avg_ivb", "whiff_rate",
    "cs_rate", "csw_rate", "in_play_rate", "hard_hit_rate",
]
MEANS = GAME_ROW[8:]


@query("j01_load_pitches", with_views(
    PITCH_VIEWS, f"SELECT {sql_six(LOADED_COLUMNS, ['pfx_x', 'pfx_z'])} FROM loaded", LOADED))
def _(t):
    return six(loaded(t), "pfx_x", "pfx_z").select(*LOADED_COLUMNS)


@query("p03_load_pitches_date_range", with_views(
    PITCH_VIEWS,
    f"SELECT season, game_type, {n('count(*)')} AS pitches, min(game_date) AS first_day, max(game_date) AS last_day "
    "FROM loaded WHERE game_date >= '2021-04-01' AND game_date <= '2023-09-30' GROUP BY season, game_type", LOADED))
def _(t):
    return loaded(t, start="2021-04-01", end="2023-09-30").groupBy("season", "game_type").agg(
        F.count(F.lit(1)).cast("bigint").alias("pitches"),
        F.min("game_date").alias("first_day"), F.max("game_date").alias("last_day"),
    )


@query("a01_pitch_type_tendencies", with_views(PITCH_VIEWS, tt_select(MIN_FACED)))
def _(t):
    return tendencies(t).drop("avg_woba_on_contact")


@query("a01_woba_on_contact", with_views(
    PITCH_VIEWS,
    f"SELECT a.batter_id, p.pitch_type_code, g.season, " + r(
        "avg(CASE a.event_type WHEN 'single' THEN w.weight_single WHEN 'double' THEN w.weight_double "
        "WHEN 'triple' THEN w.weight_triple WHEN 'home_run' THEN w.weight_hr ELSE 0 END)", 4)
    + f" AS avg_woba_on_contact {JOINED} JOIN lw w ON w.season = CASE WHEN g.season IN (2023, 2024, 2025) THEN g.season ELSE 2024 END "
    "WHERE g.game_type = 'R' AND p.call_code = 'X' AND a.batter_id IS NOT NULL "
    "GROUP BY a.batter_id, p.pitch_type_code, g.season", LW))
def _(t):
    return td.woba_on_contact(t.pitches, t.at_bats, t.games, td.linear_weights(t.spark))


@query("a02_zone_tendencies", with_views(PITCH_VIEWS, TZ))
def _(t):
    return td.zone_tendencies(t.pitches, t.at_bats, t.games, min_pitches=MIN_FACED)


@query("s13_linear_weights_by_season", with_views(
    ["games"],
    "SELECT s.season, " + ", ".join(f"w.{c}" for c in _W) + " FROM (SELECT DISTINCT season FROM games) s "
    "JOIN lw w ON w.season = CASE WHEN s.season IN (2023, 2024, 2025) THEN s.season ELSE 2024 END", LW))
def _(t):
    return td.with_season_weights(t.games.select("season").distinct(), td.linear_weights(t.spark))


@query("s13_weights_of_any_season", with_views(
    ["games"],
    "SELECT s.season, " + ", ".join(f"w.{c}" for c in _W) + " FROM (SELECT DISTINCT CAST(season + 100 AS INT) AS season FROM games) s "
    "JOIN lw w ON w.season = 2024", LW))
def _(t):
    """Seasons far from those with weights of their own."""
    seasons = t.games.select((F.col("season") + 100).cast("int").alias("season")).distinct()
    return td.with_season_weights(seasons, td.linear_weights(t.spark))


@query("m01_pitch_value", with_views(
    PITCH_VIEWS,
    f"SELECT game_pk, pitcher_id, batter_id, pitch_type_code, call_code, event_type, {r('value', 6)} AS value FROM valued",
    VALUED))
def _(t):
    out = pv.pitch_value(loaded(t), stored_tendencies(t), td.linear_weights(t.spark))
    return six(out, "value").select(
        "game_pk", "pitcher_id", "batter_id", "pitch_type_code", "call_code", "event_type", "value"
    )


@query("a03_per_game", with_views(PITCH_VIEWS, f"SELECT {sql_six(GAME_ROW, MEANS)} FROM game_rows", VALUED))
def _(t):
    valued = pv.pitch_value(loaded(t, by_game=True), stored_tendencies(t), td.linear_weights(t.spark))
    return six(stage_by_game(pv.per_game(valued), "game_rows"), *MEANS).select(*GAME_ROW)


@query("a04_season_scores", with_views(
    PITCH_VIEWS,
    f"SELECT game_pk, season, pitcher_id, pitch_type_code, pitches_thrown, {r('avg_value', 6)} AS avg_value, value_plus FROM scored",
    VALUED + ", " + normalised("season")))
def _(t):
    return six(scored(t), "avg_value").select(
        "game_pk", "season", "pitcher_id", "pitch_type_code", "pitches_thrown", "avg_value", "value_plus"
    )


@query("a04_single_game_scores", with_views(
    PITCH_VIEWS,
    "SELECT game_pk, pitcher_id, pitch_type_code, value_plus FROM scored",
    VALUED + ", " + normalised("game_pk")))
def _(t):
    return scored(t, scope=("game_pk",)).select("game_pk", "pitcher_id", "pitch_type_code", "value_plus")


@query("a05_type_summary", with_views(
    PITCH_VIEWS,
    f"SELECT pitch_type_code, {n('count(avg_value)')} AS n_rows, {r('avg(value_plus)', 1)} AS avg_value_plus FROM scored GROUP BY pitch_type_code",
    VALUED + ", " + normalised("season")))
def _(t):
    return pv.type_summary(scored(t))


_LIVE = (
    LOADED.replace("WHERE g.game_type IN ('R','S')", "WHERE g.status = 'In Progress'")
    + f", tt AS ({tt_select(MIN_FACED)}), "
    "valued AS (SELECT v.*, CAST(" + _value(
        "CASE v.event_type WHEN 'single' THEN 0.888 WHEN 'double' THEN 1.271 WHEN 'triple' THEN 1.616 "
        "WHEN 'home_run' THEN 2.101 WHEN 'grounded_into_double_play' THEN -0.196 WHEN 'sac_fly' THEN -0.049 ELSE -0.098 END",
        "0.267 - coalesce(nullif(t.whiff_rate, 0), 0.267)", "0.310 - coalesce(nullif(t.chase_rate, 0), 0.310)",
        "0.395 - coalesce(nullif(t.hard_hit_rate, 0), 0.395)",
    ) + " AS DOUBLE) AS value FROM loaded v LEFT JOIN tt t ON t.season = v.season - 1 AND t.batter_id = v.batter_id "
    "AND t.pitch_type_code = v.pitch_type_code)"
)
LIVE_VALUE_COLUMNS = "game_pk, pitcher_id, batter_id, pitch_type_code, call_code, event_type"


def live_pitches(t: Tables) -> DataFrame:
    return td.load_pitches(t.pitches, t.at_bats, t.games.filter(F.col("status") == "In Progress"), game_types=None)


@query("m02_live_pitch_value", with_views(
    PITCH_VIEWS, f"SELECT {LIVE_VALUE_COLUMNS}, {r('value', 6)} AS value FROM valued", _LIVE))
def _(t):
    return six(pv.live_pitch_value(live_pitches(t), tendencies(t)), "value").select(
        *LIVE_VALUE_COLUMNS.split(", "), "value"
    )


@query("a14_live_pitcher_scores", with_views(
    [*PITCH_VIEWS, "scores"],
    "SELECT d.game_pk, d.pitcher_id, d.pitcher_name, d.pitch_type_code, pitches_today, avg_velo_today, avg_spin_today, "
    "avg_hmov_today, avg_ivb_today, zone_pct_today, csw_today, whiff_today, chase_today, "
    + r("value_today / abs(nullif(y.m, 0)) * 100", 1) + " AS value_plus_live, "
    "s.value_plus_season, s.avg_velo_season, s.whiff_season, s.csw_season, s.avg_hmov_season, s.avg_ivb_season, "
    "s.avg_spin_season, s.season_pitches, "
    + ", ".join(f"{r(f'd.{a} - s.{b}', k)} AS {c}" for a, b, k, c in [
        ("avg_velo_today", "avg_velo_season", 1, "velo_delta"), ("whiff_today", "whiff_season", 3, "whiff_delta"),
        ("avg_hmov_today", "avg_hmov_season", 2, "hmov_delta"), ("avg_ivb_today", "avg_ivb_season", 2, "ivb_delta"),
        ("avg_spin_today", "avg_spin_season", 0, "spin_delta")])
    + " FROM today d LEFT JOIN types y ON y.season = d.season - 1 AND y.pitch_type_code = d.pitch_type_code "
    "LEFT JOIN prior s ON s.season = d.season - 1 AND s.pitcher_id = d.pitcher_id AND s.pitch_type_code = d.pitch_type_code",
    _LIVE + ", today AS (SELECT game_pk, season, pitcher_id, pitcher_name, pitch_type_code, "
    f"{n('count(value)')} AS pitches_today, avg(value) AS value_today, {r('avg(start_speed)', 1)} AS avg_velo_today, "
    f"{r('avg(spin_rate)', 0)} AS avg_spin_today, {r('avg(pfx_x)', 2)} AS avg_hmov_today, {r('avg(pfx_z)', 2)} AS avg_ivb_today, "
    f"{r('avg(CASE WHEN zone BETWEEN 1 AND 9 THEN 1.0 ELSE 0 END)', 3)} AS zone_pct_today, "
    f"{r(f'avg(CASE WHEN call_code IN {CSW} THEN 1.0 ELSE 0 END)', 3)} AS csw_today, "
    + r(f"sum(CASE WHEN call_code IN {WHIFF} THEN 1.0 ELSE 0 END) / greatest(sum(CASE WHEN call_code IN {SWING} THEN 1.0 ELSE 0 END), 1)", 3)
    + f" AS whiff_today, {r(f'avg(CASE WHEN call_code IN {SWING} THEN 1.0 ELSE 0 END)', 3)} AS chase_today "
    "FROM valued GROUP BY game_pk, season, pitcher_id, pitcher_name, pitch_type_code), "
    "types AS (SELECT season, pitch_type_code, avg(avg_value) AS m FROM scores WHERE game_type = 'R' GROUP BY ALL), "
    "prior AS (SELECT season, pitcher_id, pitch_type_code, "
    f"{r('avg(value_plus)', 1)} AS value_plus_season, {r('avg(avg_velo)', 1)} AS avg_velo_season, {r('avg(whiff_rate)', 3)} AS whiff_season, "
    f"{r('avg(csw_rate)', 3)} AS csw_season, {r('avg(avg_hmov)', 2)} AS avg_hmov_season, {r('avg(avg_ivb)', 2)} AS avg_ivb_season, "
    f"{r('avg(avg_spin)', 0)} AS avg_spin_season, {n('sum(pitches_thrown)')} AS season_pitches "
    "FROM scores WHERE game_type = 'R' GROUP BY season, pitcher_id, pitch_type_code)"))
def _(t):
    return pv.live_scores(live_pitches(t), tendencies(t), t.scores)


@query("a15_type_means", with_views(
    ["scores"],
    f"SELECT season, pitch_type_code, {r('avg(avg_value)', 6)} AS type_value FROM scores WHERE game_type = 'R' GROUP BY season, pitch_type_code"))
def _(t):
    return six(pv.type_means(t.scores), "type_value")


@query("a15_league_value_with_default", with_views(
    ["scores"],
    f"SELECT season, {r('coalesce(nullif(avg(avg_value), 0), 0.0358)', 6)} AS league_value FROM scores WHERE game_type = 'R' GROUP BY season"))
def _(t):
    return six(pv.type_means(t.scores, by_type=False), "league_value")

"""Landing and flattening queries: documents built from the tables must come
back as the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from diamondlap.operators import flatten_f1 as f1, flatten_mlb as mlb, flatten_nascar as nascar, matchup
from diamondlap.plans import documents as docs
from diamondlap.plans.documents import LAP_TIME
from diamondlap.plans.registry import n, query, r
from diamondlap.plans.tables import VIEWS
from diamondlap.sources import landing, sinks
from diamondlap.sources.staging import stage

_P = {c.rsplit(" AS ", 1)[1]: c.rsplit(" AS ", 1)[0] for c in VIEWS["pitches"].columns}
_TYPE = "CASE o_orderstatus WHEN 'P' THEN 'S' ELSE 'R' END"
_STATUS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'In Progress' ELSE 'Final' END"
_DATE = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_AWAY = "concat('T', CAST(o_custkey % 30 AS STRING))"
_HOME = "concat('T', CAST((o_custkey + 7) % 30 AS STRING))"


@query("t01_games", (
    f"SELECT o_orderkey AS game_pk, {_DATE} AS game_date, {_TYPE} AS game_type, CAST(year(o_orderdate) AS INT) AS season, {_STATUS} AS status, "
    f"'N' AS double_header, CAST(o_custkey % 2 + 1 AS INT) AS game_number, 'night' AS day_night, {_AWAY} AS away_team_abbrev, {_HOME} AS home_team_abbrev, "
    "CAST(o_custkey % 8 AS INT) AS away_score, CAST(o_custkey % 6 AS INT) AS home_score, CAST(NULL AS INT) AS away_errors, 1 AS home_errors, "
    "CAST(o_custkey % 50 AS INT) AS venue_id, CAST(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 50 + o_orderkey % 50 END AS INT) AS weather_temp, "
    "CAST(o_custkey AS INT) AS winning_pitcher_id, CAST(NULL AS INT) AS losing_pitcher_id, "
    "CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey + 1 END AS INT) AS save_pitcher_id, o_orderkey % 100 = 0 AS no_hitter, 9 AS scheduled_innings FROM orders"))
def _(t):
    return mlb.games(docs.game_documents(t)).select(
        "game_pk", "game_date", "game_type", "season", "status", "double_header", "game_number", "day_night",
        "away_team_abbrev", "home_team_abbrev", "away_score", "home_score", "away_errors", "home_errors", "venue_id",
        "weather_temp", "winning_pitcher_id", "losing_pitcher_id", "save_pitcher_id", "no_hitter", "scheduled_innings",
    )


@query("t02_at_bats", (
    "SELECT l_orderkey AS game_pk, l_linenumber AS at_bat_index, 1 AS inning, 'top' AS half_inning, l_partkey AS batter_id, concat('B ', CAST(l_partkey AS STRING)) AS batter_name, "
    "l_suppkey AS pitcher_id, 'L' AS bat_side, CAST(NULL AS STRING) AS pitch_hand, CASE WHEN l_returnflag = 'R' THEN 'strikeout' ELSE 'single' END AS event_type, "
    "l_partkey % 3 AS rbi, l_returnflag = 'R' AS has_out, l_partkey % 4 AS balls, l_partkey % 3 AS strikes FROM lineitem"))
def _(t):
    return mlb.at_bats(docs.play_documents(t)).select(
        "game_pk", "at_bat_index", "inning", "half_inning", "batter_id", "batter_name", "pitcher_id", "bat_side",
        "pitch_hand", "event_type", "rbi", "has_out", "balls", "strikes",
    )


@query("t03_pitches", (
    "SELECT l_orderkey AS game_pk, l_linenumber AS at_bat_index, 1 AS pitch_index, 1 AS pitch_number, l_suppkey AS pitcher_id, l_partkey AS batter_id, "
    + ", ".join(f"{_P[c]} AS {c}" for c in ("pitch_type_code", "call_code", "is_in_play", "zone", "start_speed", "spin_rate", "px", "pfx_x"))
    + f", CASE WHEN {_P['is_in_play']} THEN {_P['launch_speed']} END AS launch_speed, CASE WHEN {_P['is_in_play']} THEN {_P['launch_angle']} END AS launch_angle FROM lineitem"))
def _(t):
    return mlb.pitches(docs.play_documents(t)).select(
        "game_pk", "at_bat_index", "pitch_index", "pitch_number", "pitcher_id", "batter_id", "pitch_type_code",
        "call_code", "is_in_play", "zone", "start_speed", "spin_rate", "px", "pfx_x", "launch_speed", "launch_angle",
    )


@query("t04_runners", (
    "SELECT l_orderkey AS game_pk, l_linenumber AS at_bat_index, l_partkey AS runner_id, '1B' AS start_base, '2B' AS end_base, FALSE AS is_out, "
    "CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE l_suppkey END AS responsible_pitcher_id FROM lineitem "
    "UNION ALL SELECT l_orderkey, l_linenumber, l_partkey + 1, NULL, '1B', FALSE, NULL FROM lineitem"))
def _(t):
    return mlb.runners(docs.play_documents(t)).select(
        "game_pk", "at_bat_index", "runner_id", "start_base", "end_base", "is_out", "responsible_pitcher_id"
    )


@query("t05_linescore", (
    "SELECT o_orderkey AS game_pk, 1 AS inning, 'top' AS half_inning, o_custkey % 3 AS runs, 1 AS hits FROM orders "
    "UNION ALL SELECT o_orderkey, 1, 'bottom', o_custkey % 4, 2 FROM orders UNION ALL SELECT o_orderkey, 2, 'top', 1, o_custkey % 5 FROM orders "
    "UNION ALL SELECT o_orderkey, 2, 'bottom', 0, 0 FROM orders WHERE o_orderkey % 2 <> 0"))
def _(t):
    return mlb.linescore(docs.game_documents(t)).select("game_pk", "inning", "half_inning", "runs", "hits")


_PLAYERS = " UNION ALL ".join(
    f"SELECT o_orderkey AS game_pk, o_orderkey * 10 + {k} AS player_id, {team} % 30 AS team_id, {slot} AS slot FROM orders"
    for k, team, slot in ((1, "o_custkey", 0), (2, "o_custkey", 1), (6, "(o_custkey + 7)", 0), (7, "(o_custkey + 7)", 1))
)


@query("t06_box_batting", (
    "SELECT game_pk, player_id, team_id, CASE WHEN player_id % 3 = 0 THEN NULL ELSE 100 * (player_id % 9 + 1) END AS batting_order, player_id % 6 AS at_bats, "
    "player_id % 3 AS strikeouts, player_id % 4 AS hits, CASE WHEN player_id % 4 = 0 THEN NULL ELSE 0.25 END AS avg, CAST(NULL AS INT) AS total_bases "
    f"FROM ({_PLAYERS}) WHERE player_id % 5 <> 0"))
def _(t):
    return mlb.box_batting(docs.game_documents(t)).select(
        "game_pk", "player_id", "team_id", "batting_order", "at_bats", "strikeouts", "hits", "avg", "total_bases"
    )


@query("t07_box_pitching", (
    "SELECT game_pk, player_id, team_id, CAST(5.2 AS DOUBLE) AS innings_pitched, player_id % 20 AS outs, CAST(NULL AS DOUBLE) AS era "
    f"FROM ({_PLAYERS}) WHERE player_id % 2 = 0"))
def _(t):
    return mlb.box_pitching(docs.game_documents(t)).select("game_pk", "player_id", "team_id", "innings_pitched", "outs", "era")


@query("t08_box_fielding", (
    f"SELECT game_pk, player_id, team_id, player_id % 7 AS put_outs, 1 AS passed_balls, CAST(0.98 AS DOUBLE) AS fielding_pct FROM ({_PLAYERS})"))
def _(t):
    return mlb.box_fielding(docs.game_documents(t)).select("game_pk", "player_id", "team_id", "put_outs", "passed_balls", "fielding_pct")


@query("t09_fielding_credits", (
    "SELECT l_orderkey AS game_pk, l_linenumber AS at_bat_index, l_suppkey AS player_id, '6' AS position_code, 'f_assist' AS credit FROM lineitem "
    "UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey + 1, '3', 'f_putout' FROM lineitem"))
def _(t):
    return mlb.fielding_credits(docs.play_documents(t)).select("game_pk", "at_bat_index", "player_id", "position_code", "credit")


_READABLE = "(SELECT * FROM orders WHERE o_orderkey % 97 <> 1)"


@query("t10_flatten_all_tables", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, {n(count)} AS n_rows FROM {source}" for name, count, source in (
        ("games", "count(*)", _READABLE), ("at_bats", "count(*) + count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END)", _READABLE),
        ("pitches", "count(*)", _READABLE), ("runners", "2 * count(*)", _READABLE), ("fielding_credits", "2 * count(*)", _READABLE),
        ("linescore", "4 * count(*) - count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END)", _READABLE),
        ("boxscore_fielding", "4 * count(*)", _READABLE),
        ("boxscore_batting", "count(*)", f"({_PLAYERS}) WHERE player_id % 5 <> 0 AND game_pk % 97 <> 1"),
        ("boxscore_pitching", "count(*)", f"({_PLAYERS}) WHERE player_id % 2 = 0 AND game_pk % 97 <> 1"),
        ("rejects", "count(*)", "orders WHERE o_orderkey % 97 = 1"),
    )
))
def _(t):
    tables = mlb.flatten_mlb(docs.full_game_documents(t))
    counts = [df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select(F.lit(k).alias("table_name"), "n_rows") for k, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("t29_explore_game", (
    f"SELECT l_orderkey AS game_pk, {n('1')} AS total_at_bats, {n('1')} AS total_pitches, {_P['pitch_type_code']} AS pitch_types FROM lineitem"))
def _(t):
    return mlb.explore_game(docs.play_documents(t)).select(
        "game_pk", "total_at_bats", "total_pitches", F.array_join("pitch_types_seen", ",").alias("pitch_types")
    )


@query("w06_lineup_from_document", (
    "SELECT o_orderkey AS game_pk, side, o_orderkey * 10 + k AS batter_id, 1 AS batting_order, concat('Player ', CAST(o_orderkey * 10 + k AS STRING)) AS batter_name, "
    "CASE WHEN (o_orderkey * 10 + k) % 2 = 0 THEN 'L' ELSE 'R' END AS bat_side FROM orders, (VALUES ('away', 1), ('home', 6)) AS v(side, k)"))
def _(t):
    return matchup.lineup(mlb.batting_sides(docs.game_documents(t)))


# --- landing -------------------------------------------------------------------

def _stored_games(t):
    """Games already stored: the filled orders, one state behind for small customers."""
    late, rest = (
        landing.game_header(docs.game_documents(t, where=f"o_orderstatus = 'F' AND o_custkey % 10 {sign} 0")) for sign in ("=", "<>")
    )
    return stage(late.withColumn("status", F.lit("Preview")).unionByName(rest), "stored")


@query("s01_land_games_report", (
    "SELECT o_orderkey AS game_pk, a AS action, a <> 'skipped' AND (a = 'inserted' OR late) AS status_changed FROM (SELECT *, "
    f"CASE WHEN o_orderstatus <> 'F' THEN 'inserted' WHEN NOT late AND {_STATUS} = 'Final' THEN 'skipped' ELSE 'updated' END AS a "
    "FROM (SELECT *, o_custkey % 10 = 0 AS late FROM orders))"))
def _(t):
    return landing.land_games(docs.game_documents(t), _stored_games(t))[1]


@query("s01_land_games_table", f"SELECT o_orderkey AS game_pk, {_DATE} AS game_date, {_STATUS} AS status, {_AWAY} AS away_team, {_HOME} AS home_team FROM orders")
def _(t):
    return landing.land_games(docs.game_documents(t), _stored_games(t))[0].select("game_pk", "game_date", "status", "away_team", "home_team")


_EP = "(VALUES ('weekend_feed'), ('lap_times'), ('pit_stops'), ('driver_stats')) AS v(endpoint_type)"
_RK = "CAST(2020 + event_id % 6 AS INT) AS season, CAST(1 + event_id % 3 AS INT) AS series_id, CAST(event_id AS INT) AS race_id"


@query("s02_land_races", (
    f"SELECT {_RK}, endpoint_type, CASE WHEN endpoint_type = 'lap_times' OR event_type = 'click' THEN 'updated' ELSE 'inserted' END AS action FROM events, {_EP}"))
def _(t):
    new = docs.race_documents(t)
    clicks = t.base("events").filter("event_type = 'click'").select(F.col("event_id").cast("int").alias("race_id"))
    stored = new.filter("endpoint_type = 'lap_times'").unionByName(
        new.filter("endpoint_type <> 'lap_times'").join(clicks, "race_id", "left_semi")
    )
    return landing.land_races(new, stored)[1]


@query("s03_land_rounds_wraps_lists", (
    "SELECT CAST(2020 + event_id % 6 AS INT) AS season, CAST(event_id AS INT) AS round, "
    f"{n('count(*)')} AS documents, {n('0')} AS list_roots FROM events, (VALUES (1), (2), (3), (4)) AS v(k) GROUP BY event_id"))
def _(t):
    new = docs.round_documents(t)
    bare = new.withColumn("data", F.when(F.col("event_type") == "results", F.concat(F.lit(" ["), "data", F.lit("]"))).otherwise(F.col("data")))
    table, _ = landing.land_rounds(bare, new)
    return table.groupBy("season", "round").agg(
        F.count(F.lit(1)).cast("bigint").alias("documents"),
        F.sum(F.when(F.ltrim("data").startswith("["), 1).otherwise(0)).cast("bigint").alias("list_roots"),
    )


@query("s04_schedule_games", (
    "SELECT o_orderkey AS game_pk, CAST(CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS STRING) AS game_date, 'Final' AS status, "
    f"{_AWAY} AS away, {_HOME} AS home, CAST(o_custkey % 9 + 1 AS INT) AS inning FROM orders WHERE o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')"))
def _(t):
    return landing.schedule_games(docs.schedule_documents(t)).drop("inning_state")


@query("s05_schedule_board", (
    "SELECT o_orderkey AS game_pk, CAST(CAST(o_orderdate AS DATE) + k AS STRING) AS game_date, o_orderpriority = '1-URGENT' AS is_live, "
    "o_orderpriority = '2-HIGH' AS is_preview, o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AS is_final, CAST(o_custkey % 8 AS INT) AS away_score, 0 AS home_score, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'Starter' END AS away_starter, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS board_rank "
    "FROM orders, (VALUES (0), (1)) AS v(k) WHERE k = 0 OR o_orderkey % 3 = 0"))
def _(t):
    return landing.schedule_board(docs.schedule_documents(t)).select(
        "game_pk", "game_date", "is_live", "is_preview", "is_final", "away_score", "home_score",
        F.col("away_probable.name").alias("away_starter"), "board_rank",
    )


@query("s06_season_races", (
    "SELECT k AS series_id, event_id AS race_id, CASE WHEN event_id % 3 = 0 THEN concat('Race ', CAST(event_id AS STRING)) ELSE concat('Race at ', event_type) END AS race_name, "
    "CAST(CAST(ts AS DATE) AS STRING) AS race_date, 300 AS scheduled_laps FROM events, (VALUES (1), (2)) AS v(k) WHERE event_id <> 0"))
def _(t):
    return landing.season_races(docs.season_schedule_documents(t)).drop("track_name")


@query("s06_recent_rounds", (
    "SELECT 2024 AS season, event_id AS round, CAST(CAST(ts AS DATE) AS STRING) AS date FROM events "
    "WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') BETWEEN 0 AND 7 AND event_type <> 'click'"))
def _(t):
    schedule = t.base("events").selectExpr("2024 AS season", "event_id AS round", "CAST(CAST(ts AS DATE) AS STRING) AS date")
    stored = t.base("events").filter("event_type = 'click'").selectExpr("2024 AS season", "event_id AS round", "'results' AS event_type")
    return landing.recent_rounds(schedule, "2024-01-20", stored=stored)


@query("s06_current_race", (
    "SELECT event_id AS race_id, CAST(CAST(ts AS DATE) AS STRING) AS race_date FROM events "
    "WHERE event_type = 'error' AND CAST(CAST(ts AS DATE) AS STRING) <= '2024-01-20' ORDER BY race_date DESC, event_id DESC LIMIT 1"))
def _(t):
    schedule = t.base("events").selectExpr("event_id AS race_id", "CAST(CAST(ts AS DATE) AS STRING) AS race_date")
    live = t.base("events").filter("event_type = 'error'").selectExpr("event_id AS race_id")
    return landing.current_race(schedule, live, "2024-01-20")


@query("f02_eastern_yesterday", (
    "SELECT event_id, CAST(CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) - 1 AS STRING) AS day FROM events"))
def _(t):
    return t.base("events").select("event_id", landing.eastern_date(F.col("ts").cast("timestamp"), 1).alias("day"))


# --- stock-car and formula documents -------------------------------------------

@query("t11_races", (
    f"SELECT {_RK}, concat('Race ', CAST(event_id AS STRING)) AS race_name, event_type AS track_name, CAST(event_id % 50 AS INT) AS track_id, CAST(CAST(ts AS DATE) AS STRING) AS race_date, "
    f"CAST(100 + event_id % 300 AS INT) AS scheduled_laps, CAST(CASE WHEN event_id % 2 = 1 THEN NULL ELSE event_id % 300 END AS INT) AS actual_laps, value AS total_miles FROM events"))
def _(t):
    return nascar.races(docs.race_documents(t)).select(
        "season", "series_id", "race_id", "race_name", "track_name", "track_id", "race_date", "scheduled_laps", "actual_laps", "total_miles"
    )


@query("t12_results", (
    f"SELECT {_RK}, user_id AS driver_id, concat('D ', CAST(user_id AS STRING)) AS driver_name, CAST(user_id % 100 AS STRING) AS car_number, CAST(event_id % 40 AS INT) AS start_position, "
    "CAST(user_id % 40 AS INT) AS finish_position, event_id % 4 = 2 AS dnf, CAST(event_id % 60 AS INT) AS points, CASE WHEN event_id % 2 = 1 THEN NULL ELSE value END AS avg_position FROM events"))
def _(t):
    return nascar.results(docs.race_documents(t)).select(
        "season", "series_id", "race_id", "driver_id", "driver_name", "car_number", "start_position", "finish_position", "dnf", "points", "avg_position"
    )


@query("t13_laps", (
    f"SELECT {_RK}, user_id AS driver_id, 0 AS lap_number, 3 AS position, CAST(NULL AS DOUBLE) AS lap_time, CAST(NULL AS DOUBLE) AS lap_speed FROM events "
    f"UNION ALL SELECT {_RK}, user_id, CAST(1 + event_id % 200 AS INT), CAST(user_id % 40 AS INT), value, 100 + value FROM events"))
def _(t):
    return nascar.laps(docs.race_documents(t)).select("season", "series_id", "race_id", "driver_id", "lap_number", "position", "lap_time", "lap_speed")


@query("t14_pit_stops", (
    f"SELECT {_RK}, concat('D ', CAST(user_id AS STRING)) AS driver_name, CAST(user_id % 100 AS STRING) AS car_number, CAST(event_id % 5 AS INT) AS stop_number, CAST(event_id % 200 AS INT) AS lap, value AS duration_seconds FROM events"))
def _(t):
    return nascar.pit_stops(docs.race_documents(t)).drop("driver_id")


@query("t15_lead_changes", (
    f"SELECT {_RK}, 0 AS lap, CAST(user_id % 100 AS STRING) AS car_number FROM events UNION ALL SELECT {_RK}, CAST(event_id % 90 AS INT), '7' FROM events"))
def _(t):
    return nascar.lead_changes(docs.race_documents(t))


@query("t16_driver_stats", (
    f"SELECT {_RK}, user_id AS driver_id, value AS avg_running_position, CAST(event_id % 30 AS INT) AS green_flag_passes, 60 + value AS driver_rating, CAST(NULL AS INT) AS quality_passes FROM events"))
def _(t):
    return nascar.driver_stats(docs.race_documents(t)).select(
        "season", "series_id", "race_id", "driver_id", "avg_running_position", "green_flag_passes", "driver_rating", "quality_passes"
    )


_PIT = "greatest(CASE WHEN event_id % 50 > 0 THEN event_id % 50 END, CASE WHEN event_id % 30 > 0 THEN event_id % 30 END)"


@query("t17_snapshot", (
    f"SELECT CAST(dayofyear(ts) AS INT) AS race_id, event_id % 200 AS lap, user_id AS driver_id, CAST(user_id AS STRING) AS car_number, 1 AS position, 3 AS pit_stops, 2 AS laps_led, 100 + value AS best_lap_speed, "
    f"{_PIT} AS last_pit_lap, CASE WHEN event_id % 200 <> 0 THEN event_id % 200 - {_PIT} END AS tire_age FROM events UNION ALL "
    "SELECT CAST(dayofyear(ts) AS INT), event_id % 200, user_id + 1000, '99', 2, 0, 0, 90 + value, NULL, NULL FROM events"))
def _(t):
    return nascar.snapshot(docs.live_feed_documents(t)).select(
        "race_id", "lap", "driver_id", "car_number", "position", "pit_stops", "laps_led", "best_lap_speed", "last_pit_lap", "tire_age"
    )


@query("t18_flatten_race_tables", (
    "SELECT x AS table_name, CAST(k * (SELECT count(*) FROM events) AS BIGINT) AS n_rows FROM "
    "(VALUES ('races', 1), ('results', 1), ('laps', 2), ('pit_stops', 1), ('lead_changes', 2), ('driver_stats', 1)) AS v(x, k)"))
def _(t):
    tables = nascar.flatten_nascar(docs.race_documents(t))
    return reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select(F.lit(k).alias("table_name"), "n_rows") for k, df in tables.items()
    ])


_FK = "CAST(2020 + event_id % 6 AS INT) AS season, CAST(event_id AS INT) AS round"
_MS = (
    "CAST(CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 3600000 + (event_id % 60) * 60000 + 3456 "
    "WHEN 3 THEN (event_id % 60) * 1000 + event_id % 1000 ELSE (event_id % 3) * 60000 + (user_id % 60) * 1000 + event_id % 1000 END AS BIGINT)"
)


@query("t21_f1_races", f"SELECT {_FK}, concat('circuit', CAST(event_id % 24 AS STRING)) AS circuit_id FROM events")
def _(t):
    return f1.races(docs.round_documents(t)).select("season", "round", "circuit_id")


@query("t22_f1_results", (
    f"SELECT {_FK}, concat('d', CAST(user_id AS STRING)) AS driver_id, concat('c', CAST(user_id % 12 AS STRING)) AS constructor_id, event_id % 20 AS grid, "
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 20 + 1 END AS position, CASE WHEN event_id % 7 = 0 THEN 'R' ELSE CAST(event_id % 20 + 1 AS STRING) END AS position_text, "
    "CAST(event_id % 26 AS DOUBLE) AS points, event_id % 70 AS laps, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 5000000 + event_id END AS time_millis, "
    f"{r('200 + value', 6)} AS fastest_lap_speed FROM events"))
def _(t):
    return f1.results(docs.round_documents(t)).select(
        "season", "round", "driver_id", "constructor_id", "grid", "position", "position_text", "points", "laps", "time_millis",
        F.round("fastest_lap_speed", 6).alias("fastest_lap_speed"),
    )


@query("t23_f1_qualifying", f"SELECT {_FK}, concat('d', CAST(user_id AS STRING)) AS driver_id, event_id % 20 + 1 AS position, {LAP_TIME} AS q1_time FROM events")
def _(t):
    return f1.qualifying(docs.round_documents(t)).select("season", "round", "driver_id", "position", "q1_time")


@query("t24_f1_lap_times", f"SELECT {_FK}, concat('d', CAST(user_id AS STRING)) AS driver_id, event_id % 70 AS lap, event_id % 20 AS position, {LAP_TIME} AS time_display, {_MS} AS time_millis FROM events")
def _(t):
    return f1.lap_times(docs.round_documents(t))


@query("t25_f1_pit_stops", f"SELECT {_FK}, concat('d', CAST(user_id AS STRING)) AS driver_id, 1 AS stop, event_id % 70 AS lap, {_MS} AS duration_millis FROM events")
def _(t):
    return f1.pit_stops(docs.round_documents(t)).select("season", "round", "driver_id", "stop", "lap", "duration_millis")


@query("t26_f1_drivers", "SELECT DISTINCT concat('d', CAST(user_id AS STRING)) AS driver_id, user_id % 99 AS permanent_number, concat('F', CAST(user_id AS STRING)) AS family_name FROM events")
def _(t):
    return f1.drivers(docs.round_documents(t)).select("driver_id", "permanent_number", "family_name")


@query("t27_f1_constructors", "SELECT DISTINCT concat('c', CAST(user_id % 12 AS STRING)) AS constructor_id, concat('Team ', CAST(user_id % 12 AS STRING)) AS name FROM events")
def _(t):
    return f1.constructors(docs.round_documents(t)).select("constructor_id", "name")


@query("t28_flatten_f1_tables", (
    "SELECT x AS table_name, CAST((SELECT count(*) FROM events) AS BIGINT) AS n_rows FROM (VALUES ('races'), ('results'), ('qualifying'), ('lap_times'), ('pit_stops')) AS v(x) "
    f"UNION ALL SELECT 'drivers', {n('count(DISTINCT user_id)')} FROM events UNION ALL SELECT 'constructors', {n('count(DISTINCT user_id % 12)')} FROM events"))
def _(t):
    tables = f1.flatten_f1(docs.round_documents(t))
    return reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select(F.lit(k).alias("table_name"), "n_rows") for k, df in tables.items()
    ])


@query("t30_explore_race", (
    f"SELECT {_RK}, CASE event_id % 3 WHEN 0 THEN 'Cup Series' WHEN 1 THEN 'Xfinity Series' ELSE 'Truck Series' END AS series, 'driver_stats,lap_times,pit_stops,weekend_feed' AS stored, "
    f"'lap_notes,advanced_stats' AS missing, 'weekend_race' AS feed_keys, {n('CASE WHEN event_id % 2 = 1 THEN 1 END')} AS total_pit_records FROM events"))
def _(t):
    return nascar.explore_race(docs.race_documents(t)).select(
        "season", "series_id", "race_id", "series", F.array_join("stored_endpoints", ",").alias("stored"),
        F.array_join("missing_endpoints", ",").alias("missing"), F.array_join("weekend_feed_keys", ",").alias("feed_keys"), "total_pit_records",
    )


@query("t30_list_races", (
    "SELECT event_id AS race_id, CASE event_id % 3 WHEN 0 THEN 'Cup Series' WHEN 1 THEN 'Xfinity Series' ELSE 'Truck Series' END AS series, 2020 + event_id % 6 AS season FROM events"))
def _(t):
    return nascar.list_races(docs.race_documents(t)).select("race_id", "series", "season")


# --- sinks as queries ------------------------------------------------------------

@query("s11_insert_ignore", (
    "SELECT l_orderkey AS game_pk, min(l_partkey) AS batter_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey"))
def _(t):
    new = t.base("lineitem").selectExpr("l_orderkey AS game_pk", "l_partkey AS batter_id")
    stored = t.base("orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS game_pk")
    return sinks.insert_ignore(new, stored, ["game_pk"], [F.col("batter_id")])


@query("s12_update_from_join", (
    "SELECT o_orderkey AS game_pk, CASE WHEN k IS NOT NULL THEN q ELSE -1 END AS actual_pa, k IS NOT NULL AS updated FROM orders o LEFT JOIN "
    f"(SELECT l_orderkey, 1 AS k, {n('max(CASE WHEN l_returnflag = ' + repr('R') + ' THEN l_partkey END)')} AS q FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey"))
def _(t):
    target = t.base("orders").selectExpr("o_orderkey AS game_pk", "CAST(-1 AS BIGINT) AS actual_pa")
    src = t.base("lineitem").groupBy(F.col("l_orderkey").alias("game_pk")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("actual_pa")
    )
    return sinks.update_from(target, src, ["game_pk"], ["actual_pa"])


@query("s13_upsert_last_wins", (
    "SELECT o_orderkey AS game_pk, coalesce(m, -1) AS part FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_partkey) AS m FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey"))
def _(t):
    stored = t.base("orders").selectExpr("o_orderkey AS game_pk", "CAST(-1 AS BIGINT) AS part")
    new = t.base("lineitem").selectExpr("l_orderkey AS game_pk", "l_partkey AS part")
    return sinks.upsert(new, stored, ["game_pk"], [F.col("part").desc()], t.tasks("lineitem"))


@query("s14_insert_new_first_wins", (
    "SELECT o_orderkey AS game_pk, CAST(-1 AS BIGINT) AS part FROM orders WHERE o_orderstatus = 'F' UNION ALL "
    "SELECT l_orderkey, min(l_partkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey"))
def _(t):
    stored = t.base("orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS game_pk", "CAST(-1 AS BIGINT) AS part")
    new = t.base("lineitem").selectExpr("l_orderkey AS game_pk", "l_partkey AS part")
    return sinks.insert_new(new, stored, ["game_pk"], [F.col("part")])

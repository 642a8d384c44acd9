"""Read queries over scores, pitches and games."""

from __future__ import annotations

from pyspark.sql import functions as F

from diamondlap.functions import groups
from diamondlap.functions.scalars import half_up
from diamondlap.operators import serve
from diamondlap.plans.catalog_pitching import CSW, MIN_FACED, PITCH_VIEWS, SWING, WHIFF, six, tendencies, tt_select
from diamondlap.plans.registry import n, query, r
from diamondlap.plans.tables import with_views

_BOARD = (
    f"max(pitcher_name) AS pitcher_name, {n('sum(pitches_thrown)')} AS total_pitches, "
    f"{r('avg(value_plus)', 1)} AS season_value_plus, {r('avg(avg_velo)', 1)} AS avg_velo, "
    f"{r('avg(whiff_rate)', 3)} AS whiff_rate, {r('avg(csw_rate)', 3)} AS csw_rate, "
    f"{r('avg(hard_hit_rate)', 3)} AS hard_hit_rate, {n('count(DISTINCT game_pk)')} AS games"
)
_ORDER = "season_value_plus DESC NULLS FIRST, total_pitches DESC, pitcher_id, pitch_type_code"


def _leaderboard(where: str, min_pitches: int, k: int) -> str:
    return (
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY "
        f"{_ORDER}) AS rn FROM (SELECT season, pitcher_id, pitch_type_code, {_BOARD} FROM scores "
        f"WHERE game_type = 'R' {where} GROUP BY season, pitcher_id, pitch_type_code "
        f"HAVING sum(pitches_thrown) >= {min_pitches})) WHERE rn <= {k}"
    )


@query("a06_leaderboard", with_views(["scores"], _leaderboard("", 5, 200)))
def _(t):
    return serve.leaderboard(t.scores, min_pitches=5)


@query("a06_leaderboard_of_one_pitch_type", with_views(["scores"], _leaderboard("AND pitch_type_code = 'SL'", 5, 30)))
def _(t):
    return serve.leaderboard(t.scores, min_pitches=5, pitch_type="SL", k=30)


@query("l01_leaderboard_single_season", with_views(
    ["scores"], _leaderboard("AND season = 2024", 5, 30)))
def _(t):
    return serve.leaderboard(t.scores, season=2024, min_pitches=5, k=30)


@query("a07_profile", with_views(
    ["scores"],
    f"SELECT season, pitcher_id, pitch_type_code, {n('sum(pitches_thrown)')} AS total_pitches, "
    f"{r('avg(value_plus)', 1)} AS season_value_plus, {r('avg(avg_velo)', 1)} AS avg_velo, {r('avg(avg_spin)', 0)} AS avg_spin, "
    f"{r('avg(whiff_rate)', 3)} AS whiff_rate, {r('avg(csw_rate)', 3)} AS csw_rate, {r('avg(hard_hit_rate)', 3)} AS hard_hit_rate, "
    f"{n('count(DISTINCT game_pk)')} AS games FROM scores GROUP BY season, pitcher_id, pitch_type_code"))
def _(t):
    return serve.profile(t.scores)


def _season_side(tag, season):
    cols = ", ".join(f"{r(f'avg({c})', d)} AS {c}_{tag}" for c, d in serve.COMPARED.items())
    return (
        f"s{tag} AS (SELECT pitcher_id, pitch_type_code, {n('sum(pitches_thrown)')} AS pitches_{tag}, "
        f"{n('count(DISTINCT game_pk)')} AS games_{tag}, {cols} FROM scores "
        f"WHERE season = {season} AND game_type = 'R' GROUP BY pitcher_id, pitch_type_code)"
    )


@query("a08_season_compare", with_views(
    ["scores"],
    "SELECT coalesce(sa.pitcher_id, sb.pitcher_id) AS pitcher_id, coalesce(sa.pitch_type_code, sb.pitch_type_code) AS pitch_type_code, "
    + ", ".join(f"{c}_{s}" for s in "ab" for c in ["pitches", "games", *serve.COMPARED]) + ", "
    + ", ".join(f"{r(f'{c}_b - {c}_a', d)} AS {c}_change" for c, d in serve.CHANGES.items())
    + " FROM sa FULL OUTER JOIN sb ON sb.pitcher_id = sa.pitcher_id AND sb.pitch_type_code = sa.pitch_type_code",
    _season_side("a", 2023) + ", " + _season_side("b", 2024)))
def _(t):
    return serve.season_compare(t.scores, 2023, 2024)


@query("a09_game_log", with_views(
    ["scores", "games", "at_bats"],
    f"SELECT s.pitcher_id, s.season, s.game_pk, max(s.game_date) AS game_date, {n('sum(pitches_thrown)')} AS total_pitches, "
    f"{r('avg(value_plus)', 1)} AS avg_value_plus, {r('avg(avg_velo)', 1)} AS avg_velo, {r('avg(whiff_rate)', 3)} AS whiff_rate, "
    f"{r('avg(csw_rate)', 3)} AS csw_rate, {r('avg(hard_hit_rate)', 3)} AS hard_hit_rate, "
    "max(CASE WHEN d.home THEN g.away_team_abbrev WHEN NOT d.home THEN g.home_team_abbrev END) AS opponent, "
    "bool_or(d.home) AS is_home, "
    "string_agg(concat(s.pitch_type_code, ':', CAST(s.pitches_thrown AS STRING)), ',' ORDER BY s.pitches_thrown DESC, s.pitch_type_code) AS pitch_list, "
    f"{r('sum(' + r('s.avg_velo', 1) + ')', 1)} AS listed_velo "
    "FROM scores s LEFT JOIN (SELECT game_pk, pitcher_id, bool_or(half_inning = 'top') AS home FROM at_bats GROUP BY ALL) d "
    "ON d.game_pk = s.game_pk AND d.pitcher_id = s.pitcher_id LEFT JOIN games g ON g.game_pk = s.game_pk "
    "WHERE s.game_type = 'R' GROUP BY s.pitcher_id, s.season, s.game_pk"))
def _(t):
    out = serve.game_log(t.scores, t.games, t.at_bats)
    item = lambda x: F.concat(x["pitch_type_code"], F.lit(":"), x["pitches_thrown"].cast("string"))
    velo = F.aggregate(
        F.transform("pitches", lambda x: x["avg_velo"]), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))
    )
    return out.select(
        "*", F.array_join(F.transform("pitches", item), ",").alias("pitch_list"), half_up(velo, 1).alias("listed_velo")
    ).drop("pitches")


@query("l04_pitcher_search_unaccented", with_views(
    ["at_bats"],
    "SELECT DISTINCT pitcher_id, pitcher_name FROM at_bats WHERE lower(strip_accents(pitcher_name)) LIKE '%jose p1%' "
    "AND pitcher_id IS NOT NULL ORDER BY pitcher_name, pitcher_id LIMIT 10"))
def _(t):
    return serve.pitcher_search(t.at_bats, "JOSE p1")


_ONE_BATTER = (
    "one AS (SELECT DISTINCT batter_id, batter_name FROM at_bats WHERE lower(batter_name) LIKE '%b11%' "
    "AND batter_id IS NOT NULL ORDER BY batter_id, batter_name LIMIT 1), tt AS (" + tt_select(MIN_FACED) + ")"
)


@query("a10_batter_lookup", with_views(
    PITCH_VIEWS,
    "SELECT batter_id, batter_name, season, pitch_type_code, whiff_rate, chase_rate, hard_hit_rate, avg_exit_velo, csw_rate "
    "FROM tt JOIN one USING (batter_id)", _ONE_BATTER))
def _(t):
    out = serve.batter_lookup(tendencies(t), t.at_bats, "b11")
    return out.select("batter_id", "batter_name", "season", F.explode("tendencies").alias("pitch_type_code", "e")).select(
        "batter_id", "batter_name", "season", "pitch_type_code", "e.*"
    )


_LINES = "FROM pitches p JOIN at_bats a ON a.game_pk = p.game_pk AND a.at_bat_index = p.at_bat_index WHERE p.pitch_type_code IS NOT NULL"
_IN_GAME = (
    f"SELECT p.game_pk, a.pitcher_name, p.pitch_type_code, {n('count(*)')} AS pitches, {r('avg(p.start_speed)', 1)} AS avg_velo, "
    f"{r(f'avg(CASE WHEN p.call_code IN {CSW} THEN 1.0 ELSE 0 END)', 3)} AS csw_rate {_LINES} "
    "GROUP BY p.game_pk, a.pitcher_name, p.pitch_type_code HAVING count(*) >= 2"
)


@query("a11_in_game_stats", with_views(
    ["pitches", "at_bats"],
    f"SELECT * FROM ({_IN_GAME}) QUALIFY row_number() OVER (PARTITION BY game_pk ORDER BY pitches DESC, pitcher_name, pitch_type_code) <= 2"))
def _(t):
    return serve.in_game_stats(t.pitches, t.at_bats, min_pitches=2, k=2)


@query("a11_poll_pitcher_stats", with_views(
    ["pitches", "at_bats"],
    f"SELECT p.game_pk, p.pitcher_id, a.pitcher_name, p.pitch_type_code, {n('count(*)')} AS pitches, "
    f"{r(f'avg(CASE WHEN p.call_code IN {CSW} THEN 1.0 ELSE 0 END)', 3)} AS csw_rate, "
    f"{r(f'avg(CASE WHEN p.call_code IN {WHIFF} THEN 1.0 ELSE 0 END)', 3)} AS whiff_rate, "
    f"{r('avg(p.start_speed)', 1)} AS avg_velo, {r('avg(p.spin_rate)', 0)} AS avg_spin {_LINES} "
    "GROUP BY p.game_pk, p.pitcher_id, a.pitcher_name, p.pitch_type_code HAVING count(*) >= 2"))
def _(t):
    return serve.poll_pitcher_stats(t.pitches, t.at_bats, min_pitches=2)


_SCORE = (
    f"SELECT game_pk, {n('sum(CASE WHEN half_inning = ' + repr('top') + ' THEN runs ELSE 0 END)')} AS away_score, "
    f"{n('sum(CASE WHEN half_inning = ' + repr('bottom') + ' THEN runs ELSE 0 END)')} AS home_score, "
    "max(inning) AS inning FROM linescore GROUP BY game_pk"
)


@query("a12_score", with_views(["linescore"], _SCORE))
def _(t):
    return serve.score(t.linescore)


@query("a13_pitches_today", with_views(
    ["pitches", "games"],
    f"SELECT g.game_date, p.pitcher_id, p.pitch_type_code, {n('count(*)')} AS pitches, {r('avg(p.start_speed)', 1)} AS avg_velo, "
    f"{r(f'avg(CASE WHEN p.call_code IN {CSW} THEN 1.0 ELSE 0 END)', 3)} AS csw_rate, "
    + r(f"sum(CASE WHEN p.call_code IN {WHIFF} THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN p.call_code IN {SWING} THEN 1.0 ELSE 0 END), 0)", 3)
    + " AS whiff_rate FROM pitches p JOIN games g ON g.game_pk = p.game_pk WHERE p.pitch_type_code IS NOT NULL "
    "GROUP BY g.game_date, p.pitcher_id, p.pitch_type_code HAVING count(*) >= 2"))
def _(t):
    return serve.pitches_today(t.pitches, t.games, min_pitches=2)


@query("a16_pitch_mix", with_views(
    ["scores"],
    f"SELECT season, pitcher_id, pitch_type_code, value_plus, whiff_rate, csw_rate, hard_hit_rate, avg_velo, total_pitches, {r('u', 6)} AS usage FROM mix",
    "mix AS (SELECT *, total_pitches / sum(total_pitches) OVER (PARTITION BY season, pitcher_id) AS u FROM ("
    f"SELECT season, pitcher_id, pitch_type_code, {r('avg(value_plus)', 1)} AS value_plus, {r('avg(whiff_rate)', 3)} AS whiff_rate, "
    f"{r('avg(csw_rate)', 3)} AS csw_rate, {r('avg(hard_hit_rate)', 3)} AS hard_hit_rate, {r('avg(avg_velo)', 1)} AS avg_velo, "
    f"{n('sum(pitches_thrown)')} AS total_pitches FROM scores WHERE game_type = 'R' GROUP BY season, pitcher_id, pitch_type_code "
    "HAVING sum(pitches_thrown) >= 5))"))
def _(t):
    return six(serve.pitch_mix(t.scores, min_pitches=5), "usage")


@query("a17_batter_k_rate", with_views(
    ["box_batting", "games"],
    f"SELECT g.season, b.player_id AS batter_id, {n('sum(b.at_bats)')} AS at_bats, "
    f"{r('sum(b.strikeouts) / nullif(sum(b.at_bats), 0)', 6)} AS batter_k_pct FROM box_batting b JOIN games g ON g.game_pk = b.game_pk "
    "WHERE g.game_type = 'R' GROUP BY g.season, b.player_id HAVING sum(b.at_bats) >= 10"))
def _(t):
    return six(serve.batter_k(t.box_batting, t.games, min_ab=10), "batter_k_pct")


@query("a28_game_board", with_views(
    ["games", "linescore", "pitches", "at_bats"],
    "SELECT g.game_pk, g.status, coalesce(s.away_score, 0) AS away_score, coalesce(s.home_score, 0) AS home_score, s.inning, "
    "g.status = 'In Progress' AS is_live, g.status = 'Final' AS is_final, "
    f"{n('coalesce(l.lines, 0)')} AS lines, coalesce(l.names, '') AS names FROM games g LEFT JOIN s ON s.game_pk = g.game_pk "
    "LEFT JOIN (SELECT game_pk, count(*) AS lines, string_agg(pitcher_name, ',' ORDER BY pitches DESC, pitcher_name, pitch_type_code) AS names FROM "
    f"(SELECT * FROM ({_IN_GAME}) QUALIFY row_number() OVER (PARTITION BY game_pk ORDER BY pitches DESC, pitcher_name, pitch_type_code) <= 3) GROUP BY game_pk) l "
    "ON l.game_pk = g.game_pk", f"s AS ({_SCORE})"))
def _(t):
    out = serve.game_board(t.games.select("game_pk", "status"), t.linescore, t.pitches, t.at_bats, min_pitches=2, k=3, tasks=t.tasks("lineitem"))
    return out.select(
        "game_pk", "status", "away_score", "home_score", "inning", "is_live", "is_final",
        F.size("pitcher_stats").cast("bigint").alias("lines"),
        F.array_join(F.transform("pitcher_stats", lambda x: x["pitcher_name"]), ",").alias("names"),
    )


@query("a29_flatten_counts", with_views(
    ["games", "at_bats", "pitches"],
    "SELECT g.game_pk, g.status, concat(g.away_team_abbrev, ' @ ', g.home_team_abbrev) AS matchup, "
    f"{n('coalesce(a.k, 0)')} AS at_bats, {n('coalesce(p.k, 0)')} AS pitches FROM games g "
    "LEFT JOIN (SELECT game_pk, count(*) AS k FROM at_bats GROUP BY game_pk) a ON a.game_pk = g.game_pk "
    "LEFT JOIN (SELECT game_pk, count(*) AS k FROM pitches GROUP BY game_pk) p ON p.game_pk = g.game_pk"))
def _(t):
    return serve.flatten_counts(t.games, t.at_bats, t.pitches)


@query("w10_rolling_scores_30_days", with_views(
    ["scores"],
    f"SELECT pitcher_id, pitch_type_code, game_date, {n('sum(c) OVER w')} AS games, {n('sum(p) OVER w')} AS pitches, "
    + r("sum(s) OVER w / nullif(sum(c) OVER w, 0)", 1) + " AS value_plus FROM (SELECT pitcher_id, pitch_type_code, game_date, "
    "sum(value_plus) AS s, count(value_plus) AS c, sum(pitches_thrown) AS p FROM scores WHERE game_type = 'R' "
    "GROUP BY pitcher_id, pitch_type_code, game_date) WINDOW w AS (PARTITION BY pitcher_id, pitch_type_code "
    "ORDER BY CAST(game_date AS DATE) RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)"))
def _(t):
    return serve.rolling_scores(t.scores)


@query("w10_rolling_last_5_games", with_views(
    ["scores"],
    f"SELECT pitcher_id, pitch_type_code, {n('count(*)')} AS games, min(game_date) AS since, {r('avg(value_plus)', 1)} AS value_plus FROM "
    "(SELECT * FROM scores WHERE game_type = 'R' QUALIFY row_number() OVER (PARTITION BY pitcher_id, pitch_type_code "
    "ORDER BY game_date DESC, game_pk DESC) <= 5) GROUP BY pitcher_id, pitch_type_code"))
def _(t):
    return serve.rolling_starts(t.scores)


@query("w02_group_stats_attached", with_views(
    ["scores"],
    f"SELECT game_pk, pitcher_id, pitch_type_code, {r('avg(avg_value) OVER (PARTITION BY season, pitch_type_code)', 6)} AS type_mean, "
    f"{n('count(avg_value) OVER (PARTITION BY season, pitch_type_code)')} AS type_rows FROM scores"))
def _(t):
    out = groups.attach_group_stats(t.scores, ["season", "pitch_type_code"], "avg_value", "type_mean", "type_rows")
    return six(out.select("game_pk", "pitcher_id", "pitch_type_code", "type_mean", "type_rows"), "type_mean")


@query("w07_share_of_total", with_views(
    ["scores"],
    f"SELECT season, pitch_type_code, p AS pitches, {r('p / sum(p) OVER (PARTITION BY season)', 6)} AS share FROM "
    f"(SELECT season, pitch_type_code, {n('sum(pitches_thrown)')} AS p FROM scores GROUP BY season, pitch_type_code)"))
def _(t):
    used = t.scores.groupBy("season", "pitch_type_code").agg(F.sum("pitches_thrown").cast("bigint").alias("pitches"))
    return six(groups.share(used, "season", "pitches"), "share")


@query("w08_first_per_key", with_views(
    ["at_bats"],
    "SELECT pitcher_id, min(pitcher_name) AS pitcher_name FROM at_bats WHERE pitcher_id IS NOT NULL GROUP BY pitcher_id"))
def _(t):
    return serve.first_name_row(t.at_bats)


@query("l04_distinct_pitch_types", with_views(
    ["pitches"], "SELECT DISTINCT pitch_type_code FROM pitches WHERE pitch_type_code IS NOT NULL ORDER BY 1"))
def _(t):
    return t.pitches.select("pitch_type_code").dropna().distinct().orderBy("pitch_type_code")

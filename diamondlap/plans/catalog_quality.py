"""Quality checks, the pitch-quality model, set operations and scalar functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from diamondlap.functions import codes, groups, scalars as s
from diamondlap.operators import marcel as mc, quality as q, serve, stuff, validation
from diamondlap.plans import documents as docs
from diamondlap.plans.catalog_matchup import _corr
from diamondlap.plans.catalog_pitching import CSW, PITCH_VIEWS, SWING, TYPES, WHIFF, six
from diamondlap.plans.documents import LAP_TIME
from diamondlap.plans.registry import n, query, r
from diamondlap.plans.tables import with_views
from diamondlap.sources import season_stats

_D = lambda e: f"CAST({e} AS DOUBLE)"


DUE = "game_pk % 50 <> 0 OR status = 'Final'"
EXTRA = "status = 'Final' AND (game_pk % 40 = 7 OR game_date LIKE '%-13')"


def scheduled(t):
    """Due games: stored ones, on some days more than that, on one day none at all."""
    games = t.games.filter("game_date NOT LIKE '%-28'").select("game_pk", "game_date", "status")
    more = games.filter(EXTRA).withColumn("game_pk", -F.col("game_pk"))
    return games.filter(DUE).unionByName(more).select("game_pk", "game_date")


_SCHEDULE = f"SELECT game_date FROM games WHERE game_date NOT LIKE '%-28' AND ({DUE}) UNION ALL SELECT game_date FROM games WHERE game_date NOT LIKE '%-28' AND {EXTRA}"


_Q01 = (
    "SELECT 'game coverage' AS check, game_date AS scope, CAST(CASE WHEN due IS NULL THEN 1 WHEN stored = due THEN 0 WHEN stored >= due * 0.95 THEN 1 ELSE 2 END AS INT) AS level, "
    f"{_D('stored')} AS found, {_D('due')} AS wanted FROM (SELECT coalesce(a.game_date, b.game_date) AS game_date, coalesce(a.c, 0) AS stored, b.c AS due FROM "
    "(SELECT game_date, count(*) AS c FROM games WHERE status = 'Final' GROUP BY game_date) a FULL OUTER JOIN "
    f"(SELECT game_date, count(*) AS c FROM ({_SCHEDULE}) GROUP BY game_date) b ON b.game_date = a.game_date)"
)


@query("q01_coverage", with_views(["games"], _Q01))
def _(t):
    return q.check_coverage(t.games.filter("status = 'Final'"), scheduled(t))


@query("q02_season_totals", with_views(
    ["games", "at_bats", "season_batting"],
    "SELECT 'season totals' AS check, CAST(season AS STRING) AS scope, CAST(CASE WHEN d IS NULL THEN 1 WHEN d = 0 THEN 0 WHEN d > 0 THEN 2 WHEN d >= -50 THEN 1 ELSE 2 END AS INT) AS level, "
    f"{_D('feed')} AS found, {_D('listed')} AS wanted FROM (SELECT *, nullif(listed, 0) - nullif(feed, 0) AS d FROM (SELECT coalesce(a.season, b.season) AS season, a.c AS feed, b.c AS listed FROM "
    "(SELECT g.season, count(*) AS c FROM at_bats x JOIN games g ON g.game_pk = x.game_pk WHERE g.game_type = 'R' GROUP BY g.season) a FULL OUTER JOIN "
    "(SELECT season, sum(pa) AS c FROM season_batting GROUP BY season) b ON b.season = a.season))"))
def _(t):
    return q.check_totals(t.season_batting, t.at_bats, t.games)


@query("q03_player_discrepancies", with_views(
    ["games", "at_bats", "season_batting"],
    f"SELECT * FROM (SELECT coalesce(a.season, b.season) AS season, coalesce(a.nm, b.nm) AS player_name, coalesce(a.id, b.id) AS player_id, {n('coalesce(a.c, 0)')} AS feed_pa, "
    f"{n('coalesce(b.c, 0)')} AS listed_pa, {n('coalesce(a.c, 0) - coalesce(b.c, 0)')} AS diff FROM (SELECT g.season, lower(batter_name) AS k, max(batter_id) AS id, max(batter_name) AS nm, count(*) AS c "
    "FROM at_bats x JOIN games g ON g.game_pk = x.game_pk WHERE g.game_type = 'R' GROUP BY g.season, lower(batter_name)) a FULL OUTER JOIN "
    "(SELECT season, lower(player_name) AS k, max(mlbam_id) AS id, max(player_name) AS nm, sum(pa) AS c FROM season_batting GROUP BY season, lower(player_name)) b ON b.season = a.season AND b.k = a.k) "
    "WHERE abs(diff) > 5 QUALIFY row_number() OVER (PARTITION BY season ORDER BY abs(diff) DESC, player_name, player_id) <= 20"))
def _(t):
    return q.player_discrepancies(t.season_batting, t.at_bats, t.games, by_name=True)


@query("q04_rows_per_game", with_views(
    ["games", "at_bats"],
    f"SELECT 'at-bats per game' AS check, game_date AS scope, CAST(CASE WHEN per BETWEEN 2.5 AND 4.0 THEN 0 WHEN per < 2.5 THEN 2 ELSE 1 END AS INT) AS level, per AS found, {_D('2.5')} AS wanted FROM "
    f"(SELECT g.game_date, {r('count(*) / count(DISTINCT g.game_pk)', 1)} AS per FROM at_bats a JOIN games g ON g.game_pk = a.game_pk GROUP BY g.game_date)"))
def _(t):
    return q.check_rows_per_game(t.at_bats, t.games, 2.5, 4.0)


@query("q05_short_games", with_views(
    ["games", "pitches"],
    f"SELECT g.game_pk, g.game_date, concat(away_team_abbrev, ' @ ', home_team_abbrev) AS matchup, {n('coalesce(c, 0)')} AS pitch_count FROM games g LEFT JOIN "
    "(SELECT game_pk, count(*) AS c FROM pitches GROUP BY game_pk) p ON p.game_pk = g.game_pk WHERE coalesce(c, 0) < 3"))
def _(t):
    return q.pitch_counts(t.games, t.pitches).filter("pitch_count < 3")


@query("q06_column_coverage", with_views(
    ["games", "pitches"],
    "SELECT *, spin_pct > 80 AS spin_ok, launch_pct > 5 AS launch_ok, location_pct > 90 AS location_ok FROM (SELECT g.game_date, "
    f"{n('count(*)')} AS pitches, {r('count(spin_rate) / count(*) * 100', 1)} AS spin_pct, {r('count(launch_speed) / count(*) * 100', 1)} AS launch_pct, "
    f"{r('count(px) / count(*) * 100', 1)} AS location_pct FROM pitches p JOIN games g ON g.game_pk = p.game_pk GROUP BY g.game_date)"))
def _(t):
    return q.column_coverage(t.games, t.pitches)


@query("q07_duplicate_keys", with_views(
    ["pitches"], f"SELECT game_pk, at_bat_index, {n('count(*)')} AS copies FROM pitches GROUP BY game_pk, at_bat_index HAVING count(*) > 1"))
def _(t):
    return q.duplicate_keys(t.pitches, ["game_pk", "at_bat_index"])


@query("q08_unfinished_games", with_views(
    ["games"], f"SELECT 'unfinished games' AS check, game_date AS scope, CAST(max(CASE WHEN status <> 'Final' THEN 1 ELSE 0 END) AS INT) AS level, "
    f"{_D('sum(CASE WHEN status <> ' + repr('Final') + ' THEN 1 ELSE 0 END)')} AS found, {_D('0')} AS wanted FROM games GROUP BY game_date"))
def _(t):
    return q.check_status(t.games)


@query("q09_children_present", with_views(
    ["games", "runners"],
    f"SELECT 'runner data' AS check, game_date AS scope, CAST(CASE WHEN count(x.game_pk) = count(*) THEN 0 ELSE 1 END AS INT) AS level, {_D('count(x.game_pk)')} AS found, {_D('count(*)')} AS wanted "
    "FROM games g LEFT JOIN (SELECT DISTINCT game_pk FROM runners) x ON x.game_pk = g.game_pk GROUP BY game_date"))
def _(t):
    return q.check_children(t.games, t.runners)


_LOC = r("count(px) / count(*) * 100", 1)
_SPIN = r("count(spin_rate) / count(*) * 100", 1)
_PER = r("count(*) / count(DISTINCT g.game_pk)", 1)


@query("q10_verdict", with_views(
    ["games", "at_bats", "pitches", "runners"],
    f"SELECT scope, CASE max(level) WHEN 2 THEN 'failed' WHEN 1 THEN 'passed with warnings' ELSE 'passed' END AS verdict, {n('sum(CASE level WHEN 1 THEN 1 ELSE 0 END)')} AS warnings, "
    f"{n('sum(CASE level WHEN 2 THEN 1 ELSE 0 END)')} AS failures FROM (SELECT scope, level FROM ({_Q01.replace("WHERE status = 'Final' GROUP BY game_date) a", "GROUP BY game_date) a")}) "
    f"UNION ALL SELECT game_date, CASE WHEN per BETWEEN 1 AND 45 THEN 0 WHEN per < 1 THEN 2 ELSE 1 END FROM (SELECT g.game_date, {_PER} AS per FROM at_bats a JOIN games g ON g.game_pk = a.game_pk GROUP BY g.game_date) "
    "UNION ALL SELECT game_date, CASE WHEN min(coalesce(c, 0)) < 1 THEN 2 ELSE 0 END FROM games g LEFT JOIN (SELECT game_pk, count(*) AS c FROM pitches GROUP BY game_pk) p ON p.game_pk = g.game_pk GROUP BY game_date "
    f"UNION ALL SELECT game_date, CASE WHEN loc < 80 THEN 2 WHEN spin < 50 THEN 1 ELSE 0 END FROM (SELECT g.game_date, {_LOC} AS loc, {_SPIN} AS spin FROM pitches p JOIN games g ON g.game_pk = p.game_pk GROUP BY g.game_date) "
    "UNION ALL SELECT game_date, max(CASE WHEN status <> 'Final' THEN 1 ELSE 0 END) FROM games GROUP BY game_date "
    "UNION ALL SELECT game_date, CASE WHEN count(x.game_pk) = count(*) THEN 0 ELSE 1 END FROM games g LEFT JOIN (SELECT DISTINCT game_pk FROM runners) x ON x.game_pk = g.game_pk GROUP BY game_date) "
    "GROUP BY scope"))
def _(t):
    return q.verdict(q.run_checks(t.games, scheduled(t), t.at_bats, t.pitches, t.runners, low=1, least=1))


@query("q11_missing_from_map", with_views(
    ["at_bats"],
    "SELECT batter_id, max(batter_name) AS batter_name, 'Batter' AS first_name, substr(max(batter_name), 8) AS last_name FROM at_bats "
    "WHERE batter_id IS NOT NULL AND batter_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY batter_id"))
def _(t):
    known = t.base("supplier").select(F.col("s_suppkey").alias("mlbam_id"))
    return season_stats.missing_from_map(t.at_bats, known)


# --- season tables ---------------------------------------------------------------

_RAW = (
    "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey % 200 AS STRING) END AS IDfg", "CAST(p_partkey AS STRING) AS mlbamID", "p_name AS Name", "p_brand AS Team",
    "CAST(p_size AS STRING) AS G", "CASE WHEN p_partkey % 5 = 0 THEN 'nan' WHEN p_partkey % 5 = 1 THEN '' ELSE CAST(p_size * 3 AS STRING) END AS PA",
    "CASE WHEN p_partkey % 4 = 0 THEN 'NaN' ELSE CAST(p_retailprice AS STRING) END AS wOBA", "CASE WHEN p_partkey % 3 = 0 THEN 'bad' ELSE CAST(p_retailprice / 10 AS STRING) END AS IP",
    "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE '0.1' END AS `Barrel%`", "'0.2' AS `Barrels%`", "CAST(p_retailprice AS STRING) AS `K%`",
)
_IDS = "CAST(CASE WHEN p_partkey % 7 = 0 OR p_partkey % 200 = 0 THEN p_partkey ELSE p_partkey % 200 END AS INT) AS mlbam_id, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 200 = 0 THEN NULL ELSE CAST(p_partkey % 200 AS STRING) END AS fg_id"
_BARREL = "CAST(CASE WHEN p_partkey % 2 = 0 THEN 0.2 ELSE 0.1 END AS DOUBLE) AS barrel_pct"


@query("s07_season_batting", (
    f"SELECT 2025 AS season, p_name AS player_name, p_brand AS team, {_IDS}, p_size AS games, CAST(CASE WHEN p_partkey % 5 < 2 THEN NULL ELSE p_size * 3 END AS INT) AS pa, "
    f"CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice END AS woba, {_BARREL}, CAST(NULL AS DOUBLE) AS sprint_speed FROM part"))
def _(t):
    return season_stats.load_season_batting(t.base("part").selectExpr(*_RAW), 2025).select(
        "season", "player_name", "team", "mlbam_id", "fg_id", "games", "pa", "woba", "barrel_pct", "sprint_speed"
    )


@query("s08_season_pitching", (
    f"SELECT 2025 AS season, p_name AS player_name, {_IDS}, {r('CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice / 10 END', 4)} AS ip, p_retailprice AS k_pct, {_BARREL} FROM part"))
def _(t):
    out = season_stats.load_season_pitching(t.base("part").selectExpr(*_RAW), 2025)
    return out.select("season", "player_name", "mlbam_id", "fg_id", F.round("ip", 4).alias("ip"), "k_pct", "barrel_pct")


@query("s09_player_id_map", (
    "SELECT CAST(m AS INT) AS mlbam_id, CAST(nullif(fg, 0) AS INT) AS fangraphs_id, bb AS bbref_id FROM (SELECT l_partkey % 997 AS m, l_suppkey AS fg, l_returnflag AS bb FROM lineitem "
    "QUALIFY row_number() OVER (PARTITION BY l_partkey % 997 ORDER BY l_suppkey, l_returnflag) = 1) WHERE m > 0"))
def _(t):
    register = t.base("lineitem").selectExpr(
        "CAST(l_partkey % 997 AS DOUBLE) AS key_mlbam", "CAST(l_suppkey AS DOUBLE) AS key_fangraphs", "l_returnflag AS key_bbref",
        "'A' AS name_first", "'B' AS name_last", "CAST(NULL AS DOUBLE) AS birth_year",
    )
    return season_stats.build_id_map(register).select("mlbam_id", "fangraphs_id", "bbref_id")


# --- pitch-quality model -----------------------------------------------------------

MIN_THROWN = 5
_MEAN = ["avg_velo", "std_velo", "avg_hmov", "avg_vmov", "avg_spin", "avg_x0", "avg_z0", "std_x0", "std_z0", "avg_break_total",
         "csw_rate", "whiff_rate", "same_hand_pct", "csw_same_hand", "csw_opp_hand"]
_FEATS = (
    f"feats AS (SELECT p.pitcher_id, p.pitch_type_code, CAST(year(CAST(g.game_date AS DATE)) AS INT) AS season, {n('count(*)')} AS pitches, avg(p.start_speed) AS avg_velo, stddev_samp(p.start_speed) AS std_velo, "
    "avg(p.pfx_x) AS avg_hmov, avg(p.pfx_z) AS avg_vmov, avg(p.spin_rate) AS avg_spin, avg(p.x0) AS avg_x0, avg(p.z0) AS avg_z0, stddev_samp(p.x0) AS std_x0, stddev_samp(p.z0) AS std_z0, "
    f"avg(sqrt(p.pfx_x * p.pfx_x + p.pfx_z * p.pfx_z)) AS avg_break_total, avg(CASE WHEN p.call_code IN {CSW} THEN 1.0 ELSE 0 END) AS csw_rate, "
    f"sum(CASE WHEN p.call_code IN {WHIFF} THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN p.call_code IN {SWING} THEN 1.0 ELSE 0 END), 0) AS whiff_rate, "
    "avg(CASE WHEN a.bat_side = a.pitch_hand THEN 1.0 ELSE 0 END) AS same_hand_pct, "
    f"avg(CASE WHEN a.bat_side = a.pitch_hand THEN CASE WHEN p.call_code IN {CSW} THEN 1.0 ELSE 0 END END) AS csw_same_hand, "
    f"avg(CASE WHEN a.bat_side <> a.pitch_hand THEN CASE WHEN p.call_code IN {CSW} THEN 1.0 ELSE 0 END END) AS csw_opp_hand "
    "FROM pitches p JOIN at_bats a ON a.game_pk = p.game_pk AND a.at_bat_index = p.at_bat_index JOIN games g ON g.game_pk = p.game_pk "
    f"WHERE p.pitch_type_code IN {TYPES} AND p.start_speed IS NOT NULL AND p.pfx_x IS NOT NULL AND p.pfx_z IS NOT NULL AND p.spin_rate IS NOT NULL AND p.x0 IS NOT NULL AND p.z0 IS NOT NULL "
    f"AND a.bat_side IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_THROWN})"
)


def features(t):
    return stuff.stuff_features(t.pitches, t.at_bats, t.games, min_pitches=MIN_THROWN)


@query("a26_stuff_features", with_views(
    PITCH_VIEWS, "SELECT pitcher_id, pitch_type_code, season, pitches, " + ", ".join(f"{r(c, 6)} AS {c}" for c in _MEAN) + " FROM feats", _FEATS))
def _(t):
    return six(features(t), *_MEAN)


@query("a27_csw_by_type", with_views(
    PITCH_VIEWS, f"SELECT pitch_type_code, {r('avg(csw_rate)', 6)} AS csw_rate FROM feats GROUP BY pitch_type_code", _FEATS))
def _(t):
    return six(stuff.csw_by_type(features(t)), "csw_rate")


_Z = {"avg_velo": "velo_z", "avg_hmov": "hmov_z", "avg_vmov": "vmov_z", "avg_spin": "spin_z", "avg_break_total": "break_z", "rc": "release_consistency_z"}


@query("w01_z_scores", with_views(
    PITCH_VIEWS,
    "SELECT pitcher_id, pitch_type_code, season, " + ", ".join(
        r(f"({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0)", 5) + f" AS {z}" for c, z in _Z.items())
    + " FROM (SELECT *, 1 / (coalesce(std_x0, 0.1) + coalesce(std_z0, 0.1) + 0.01) AS rc FROM feats) WINDOW w AS (PARTITION BY pitch_type_code)", _FEATS))
def _(t):
    out = stuff.engineer(features(t))
    return out.select("pitcher_id", "pitch_type_code", "season", *[s.half_up(z, 5).alias(z) for z in _Z.values()])


_ROWS = (
    "zf AS (SELECT *, " + ", ".join(f"({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0) AS x{i}" for i, c in enumerate(_Z, 1))
    + " FROM (SELECT *, 1 / (coalesce(std_x0, 0.1) + coalesce(std_z0, 0.1) + 0.01) AS rc FROM feats) WINDOW w AS (PARTITION BY pitch_type_code)), "
    "fr AS (SELECT *, csw_rate AS y, ntile(5) OVER (PARTITION BY pitch_type_code ORDER BY season, pitcher_id) - 1 AS fold FROM zf WHERE "
    + " AND ".join(f"x{i} IS NOT NULL" for i in range(1, 7)) + " AND csw_rate IS NOT NULL)"
)


def _ridge(key: str, train: str, alpha: float = 5.0) -> str:
    """SQL for the regression of each group: standardise, add the penalty to the
    normal equations and eliminate one unknown at a time."""
    ids = range(1, 7)
    parts = [
        f"st AS (SELECT {key}, count(*) AS n, avg(y) AS my, " + ", ".join(f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in ids) + f" FROM {train} GROUP BY {key})",
        f"zz AS (SELECT {key}, " + ", ".join(f"(x{i} - m{i}) / s{i} AS z{i}" for i in ids) + f", y - my AS c FROM {train} JOIN st USING ({key}))",
        f"e0 AS (SELECT {key}, [" + ", ".join(
            "[" + ", ".join([f"sum(z{i} * z{j})" + (f" + {alpha}" if i == j else "") for j in ids] + [f"sum(z{i} * c)"]) + "]" for i in ids
        ) + f"] AS m FROM zz GROUP BY {key})",
    ]
    for k in ids:
        parts.append(
            f"e{k} AS (SELECT {key}, [" + ", ".join(
                "[" + ", ".join(
                    f"m[{k}][{j}] / m[{k}][{k}]" if i == k else f"m[{i}][{j}] - m[{i}][{k}] * m[{k}][{j}] / m[{k}][{k}]" for j in range(1, 8)
                ) + "]" for i in ids
            ) + f"] AS m FROM e{k - 1})"
        )
    parts.append(
        f"mdl AS (SELECT {key}, n, my, " + ", ".join(f"m[{i}][7] / s{i} AS w{i}" for i in ids)
        + ", my - (" + " + ".join(f"m[{i}][7] / s{i} * m{i}" for i in ids) + f") AS b FROM e6 JOIN st USING ({key}))"
    )
    return ", ".join(parts)


_PRED = "b + " + " + ".join(f"w{i} * x{i}" for i in range(1, 7))
_BIG = "tr AS (SELECT *, pitch_type_code AS g FROM fr WHERE pitch_type_code IN (SELECT pitch_type_code FROM fr GROUP BY pitch_type_code HAVING count(*) >= 30))"
_MODELS = ", ".join([_FEATS, _ROWS, _BIG, _ridge("g", "tr")])


def _r2(eval_rows: str) -> str:
    return f"SELECT g, count(*) AS n, 1 - sum(pow(y - ({_PRED}), 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM {eval_rows} JOIN mdl USING (g) GROUP BY g"


_SCORES = (
    "SELECT pitcher_id, pitch_type_code AS pitch_type, season, pitches, "
    f"{r('(' + _PRED + ') / my * 100', 1)} AS stuff_plus, {r(_PRED, 6)} AS predicted_csw, "
    + ", ".join(f"{r(c, 6)} AS {c}" for c in ("csw_rate", "avg_velo", "avg_spin", "avg_hmov", "avg_vmov", "whiff_rate"))
    + " FROM zf JOIN mdl ON mdl.g = zf.pitch_type_code WHERE " + " AND ".join(f"x{i} IS NOT NULL" for i in range(1, 7))
)


@query("m11_ridge_models", with_views(
    PITCH_VIEWS,
    f"SELECT m.g AS pitch_type_code, m.n, {r('my', 6)} AS league_csw, {r('b', 6)} AS intercept, "
    + ", ".join(f"{r(f'w{i}', 6)} AS w_{c}" for i, c in enumerate(stuff.FEATURES, 1)) + f", {r('r2', 6)} AS train_r2 FROM mdl m JOIN ({_r2('tr')}) q ON q.g = m.g", _MODELS))
def _(t):
    return six(stuff.fit_ridge(stuff.engineer(features(t))), "league_csw", "intercept", *[f"w_{c}" for c in stuff.FEATURES], "train_r2")


_SHOWN = ["predicted_csw", "csw_rate", "avg_velo", "avg_spin", "avg_hmov", "avg_vmov", "whiff_rate"]


@query("m11_stuff_scores", with_views(PITCH_VIEWS, _SCORES, _MODELS))
def _(t):
    f = stuff.engineer(features(t))
    return six(stuff.score_ridge(f, stuff.fit_ridge(f)), *_SHOWN)


@query("l03_top_stuff_scores", with_views(
    PITCH_VIEWS, f"SELECT * FROM ({_SCORES}) ORDER BY stuff_plus DESC NULLS FIRST, pitches DESC, pitcher_id, pitch_type, season LIMIT 20", _MODELS))
def _(t):
    f = stuff.engineer(features(t))
    return six(stuff.top_scores(stuff.score_ridge(f, stuff.fit_ridge(f))), *_SHOWN)


_HELD = ", ".join([
    _FEATS, _ROWS, _BIG.replace("tr AS", "big AS").replace(", pitch_type_code AS g", ""),
    "tr AS (SELECT b.* EXCLUDE (fold), concat(pitch_type_code, '|fold ', CAST(h.f AS STRING)) AS g FROM big b JOIN (SELECT unnest(range(0, 5)) AS f) h ON h.f <> b.fold)",
    "ev AS (SELECT *, concat(pitch_type_code, '|fold ', CAST(fold AS STRING)) AS g FROM big)", _ridge("g", "tr"),
])
_PARTS = f"SELECT split_part(g, '|', 1) AS pitch_type_code, split_part(g, '|', 2) AS part, n, {r('r2', 6)} AS r2 FROM ({_r2('ev')})"


@query("m11_cross_validation", with_views(PITCH_VIEWS, _PARTS, _HELD))
def _(t):
    return six(stuff.ridge_r2(stuff.engineer(features(t)), "folds"), "r2")


_COMMON = ", ".join([
    _FEATS, _ROWS, _BIG.replace("tr AS", "big AS").replace(", pitch_type_code AS g", ""),
    "nx AS (SELECT pitch_type_code, season, lead(season) OVER (PARTITION BY pitch_type_code ORDER BY season) AS nxt FROM (SELECT DISTINCT pitch_type_code, season FROM big))",
    "cm AS (SELECT a.pitch_type_code, a.pitcher_id, a.season, n.nxt, concat(a.pitch_type_code, '|', CAST(a.season AS STRING), ' to ', CAST(n.nxt AS STRING)) AS g "
    "FROM big a JOIN nx n ON n.pitch_type_code = a.pitch_type_code AND n.season = a.season JOIN big b ON b.pitch_type_code = a.pitch_type_code AND b.pitcher_id = a.pitcher_id AND b.season = n.nxt "
    "QUALIFY count(*) OVER (PARTITION BY a.pitch_type_code, a.season) >= 20)",
    "tr AS (SELECT b.*, c.g FROM big b JOIN cm c ON c.pitch_type_code = b.pitch_type_code AND c.pitcher_id = b.pitcher_id AND c.season = b.season)",
    "ev AS (SELECT b.*, c.g FROM big b JOIN cm c ON c.pitch_type_code = b.pitch_type_code AND c.pitcher_id = b.pitcher_id AND c.nxt = b.season)", _ridge("g", "tr"),
])


@query("j14_cross_season_r2", with_views(PITCH_VIEWS, _PARTS, _COMMON))
def _(t):
    return six(stuff.ridge_r2(stuff.engineer(features(t)), "seasons"), "r2")


def _apart(ctes: str, tag: str) -> str:
    """The same chain under names of its own, without the shared first part."""
    own = ctes.removeprefix(f"{_FEATS}, {_ROWS}, ")
    return re.sub(r"\b(tr|ev|st|zz|e[0-6]|mdl|nx|cm|big)\b", rf"\1_{tag}", own)


@query("m11_evaluation", with_views(
    PITCH_VIEWS,
    f"SELECT g AS pitch_type_code, n, {r('train_r2', 6)} AS train_r2, {r('cv', 6)} AS cv_r2, {r('cs', 6)} AS cv_r2_std, {r('se', 6)} AS cross_season_r2 FROM "
    f"(SELECT g, n, r2 AS train_r2 FROM ({_r2('tr')})) JOIN (SELECT split_part(g, '|', 1) AS g, avg(r2) AS cv, stddev_pop(r2) AS cs FROM ({_apart(_r2('ev'), 'f')}) GROUP BY 1) USING (g) "
    f"LEFT JOIN (SELECT split_part(g, '|', 1) AS g, avg(r2) AS se FROM ({_apart(_r2('ev'), 's')}) GROUP BY 1) USING (g)",
    ", ".join([_MODELS, _apart(_HELD, "f"), _apart(_COMMON, "s")])))
def _(t):
    f = stuff.engineer(features(t))
    return six(stuff.evaluate(f, stuff.fit_ridge(f)), "cv_r2", "cv_r2_std", "cross_season_r2", "train_r2").select(
        "pitch_type_code", "n", "train_r2", "cv_r2", "cv_r2_std", "cross_season_r2"
    )


_METRIC = (
    "metric AS (SELECT pitcher_id, season, sum(pitches_thrown) AS pitches, sum(value_plus * pitches_thrown) / nullif(sum(pitches_thrown), 0) AS value_plus FROM scores "
    "WHERE game_type = 'R' GROUP BY pitcher_id, season), "
    "outcomes AS (SELECT n.pitcher_id, s.* FROM season_pitching s JOIN (SELECT pitcher_id, max(pitcher_name) AS nm FROM at_bats GROUP BY pitcher_id) n ON lower(n.nm) = lower(s.player_name))"
)


def _corr_sql(lag):
    return " UNION ALL ".join(
        f"SELECT 'value_plus' AS metric, '{b}' AS outcome, {r(_corr('m.value_plus', f'o.{b}'), 3)} AS pearson, {n('count(*)')} AS n FROM metric m JOIN outcomes o "
        f"ON o.pitcher_id = m.pitcher_id AND o.season = m.season + {lag} WHERE m.pitches >= 20 AND o.ip >= 30" for b in ("fip", "siera", "k_pct", "war")
    )


def _validate(t, lag):
    outcomes = mc.pitcher_season_by_name(t.season_pitching, serve.latest_name(t.at_bats))
    return validation.validation_corr(
        validation.season_metric(t.scores), outcomes, ["value_plus"], ["fip", "siera", "k_pct", "war"], lag, min_pitches=20, min_ip=30
    )


@query("m12_validation_same_season", with_views(["scores", "season_pitching", "at_bats"], _corr_sql(0), _METRIC))
def _(t):
    return _validate(t, 0)


@query("m12_validation_next_season", with_views(["scores", "season_pitching", "at_bats"], _corr_sql(1), _METRIC))
def _(t):
    return _validate(t, 1)


# --- predicates ------------------------------------------------------------------------

@query("p01_membership", with_views(
    ["pitches"],
    f"SELECT pitch_type_code, {n('count(*)')} AS pitches, {n(f'sum(CASE WHEN call_code NOT IN {SWING} THEN 1 ELSE 0 END)')} AS takes FROM pitches WHERE pitch_type_code IN {TYPES} GROUP BY pitch_type_code"))
def _(t):
    takes = s.count_if(~F.col("call_code").isin(*codes.SWING))
    return t.pitches.filter(F.col("pitch_type_code").isin(*codes.PITCH_TYPES)).groupBy("pitch_type_code").agg(
        F.count(F.lit(1)).cast("bigint").alias("pitches"), takes.alias("takes")
    )


@query("p02_in_and_out_of_zone", with_views(
    ["pitches"],
    f"SELECT pitcher_id, {n('sum(CASE WHEN zone BETWEEN 1 AND 9 THEN 1 ELSE 0 END)')} AS inside, {n('sum(CASE WHEN zone NOT BETWEEN 1 AND 9 THEN 1 ELSE 0 END)')} AS outside, "
    f"{n('count(*) - count(zone)')} AS unknown FROM pitches GROUP BY pitcher_id"))
def _(t):
    return t.pitches.groupBy("pitcher_id").agg(
        s.count_if(s.in_zone("zone")).alias("inside"), s.count_if(~s.in_zone("zone")).alias("outside"),
        s.count_if(F.col("zone").isNull()).alias("unknown"),
    )


@query("p05_names_without_accents", with_views(
    ["at_bats"], f"SELECT pitcher_name, {n('count(*)')} AS n FROM at_bats WHERE contains(lower(strip_accents(pitcher_name)), 'angel p') GROUP BY pitcher_name"))
def _(t):
    return t.at_bats.filter(s.match_unaccented("pitcher_name", "ÀNGEL p")).groupBy("pitcher_name").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("p12_guards", with_views(
    ["results", "races"],
    f"SELECT r.season, {n('count(*)')} AS n FROM results x JOIN races r ON r.race_id = x.race_id WHERE x.finish_position > 0 AND x.race_id <> 5 AND r.season >= 2023 GROUP BY r.season"))
def _(t):
    kept = t.results.filter((F.col("finish_position") > 0) & (F.col("race_id") != 5)).drop("season")
    return kept.join(t.races.filter("season >= 2023").select("race_id", "season"), "race_id").groupBy("season").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


# --- set operations ------------------------------------------------------------------

@query("u01_union_by_name", with_views(
    ["scores"], f"SELECT pitch_type_code, {n('count(*)')} AS n_rows FROM scores WHERE game_type IN ('R', 'S') GROUP BY pitch_type_code"))
def _(t):
    parts = [t.scores.filter(F.col("game_type") == g).select("pitch_type_code", "pitcher_id") for g in ("R", "S")]
    return parts[0].unionByName(parts[1]).groupBy("pitch_type_code").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@query("u02_pitchers_in_both_seasons", with_views(
    ["scores"], "SELECT DISTINCT pitcher_id, pitch_type_code FROM scores WHERE season = 2023 INTERSECT SELECT DISTINCT pitcher_id, pitch_type_code FROM scores WHERE season = 2024"))
def _(t):
    of = lambda y: t.scores.filter(F.col("season") == y).select("pitcher_id", "pitch_type_code")
    return of(2023).intersect(of(2024))


@query("j07_keys_without_match", with_views(
    ["games", "pitches"], "SELECT DISTINCT game_pk FROM games WHERE game_pk NOT IN (SELECT game_pk FROM pitches)"))
def _(t):
    return groups.missing_keys(t.games, t.pitches, "game_pk")


@query("j08_rows_with_match", with_views(
    ["games", "pitches"], "SELECT game_pk, season, status FROM games WHERE game_pk IN (SELECT game_pk FROM pitches WHERE call_code = 'M')"))
def _(t):
    return groups.with_keys(t.games, t.pitches.filter("call_code = 'M'"), "game_pk").select("game_pk", "season", "status")


@query("u04_union_without_copies", (
    "SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, user_id FROM events WHERE event_type = 'click' UNION "
    "SELECT CAST(CAST(ts AS DATE) AS STRING), user_id FROM events WHERE event_type = 'view'"))
def _(t):
    of = lambda k: t.base("events").filter(F.col("event_type") == k).selectExpr("CAST(CAST(ts AS DATE) AS STRING) AS day", "user_id")
    return of("click").union(of("view")).dropDuplicates()


@query("j03_lookup_with_defaults", with_views(
    ["at_bats", "season_batting"],
    "SELECT a.game_pk, a.at_bat_index, CAST(coalesce(nullif(b.pa, 0), 7) AS DOUBLE) AS pa FROM at_bats a LEFT JOIN (SELECT mlbam_id, pa FROM season_batting WHERE season = 2020) b ON b.mlbam_id = a.batter_id"))
def _(t):
    table = t.season_batting.filter("season = 2020").select(F.col("mlbam_id").alias("batter_id"), "pa")
    return groups.lookup(t.at_bats.select("game_pk", "at_bat_index", "batter_id"), table, ["batter_id"], {"pa": 7}).select("game_pk", "at_bat_index", "pa")


# --- scalar functions ------------------------------------------------------------------

@query("f01_text", (
    "SELECT c_custkey, lower(c_name) AS low, left(c_name, 8) AS head, split_part(c_name, '#', 2) AS tail, contains(lower(c_mktsegment), 'build') AS building, "
    "upper(c_mktsegment) || '!' AS loud FROM customer"))
def _(t):
    return t.base("customer").select(
        "c_custkey", F.lower("c_name").alias("low"), F.left(F.col("c_name"), F.lit(8)).alias("head"),
        F.get(F.split("c_name", "#", 2), F.lit(1)).alias("tail"), s.match_text("c_mktsegment", "BUILD").alias("building"),
        F.concat(F.upper("c_mktsegment"), F.lit("!")).alias("loud"),
    )


@query("f02_dates", (
    "SELECT o_orderkey, CAST(year(CAST(d AS DATE)) AS INT) AS y, CAST(date_diff('day', CAST(d AS DATE), DATE '2001-08-01') AS INT) AS age, CAST(CAST(d AS DATE) - 1 AS STRING) AS yesterday, "
    "d >= '1998-01-01' AND d <= '1998-12-31' AS in_1998 FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders)"))
def _(t):
    d = F.to_date("d")
    return t.base("orders").selectExpr("o_orderkey", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS d").select(
        "o_orderkey", F.year(d).alias("y"), F.datediff(F.lit("2001-08-01").cast("date"), d).alias("age"),
        F.date_sub(d, 1).cast("string").alias("yesterday"), s.between_dates("d", "1998-01-01", "1998-12-31").alias("in_1998"),
    )


@query("f03_math", (
    f"SELECT l_orderkey, l_linenumber, l_partkey, {r('l_extendedprice / 7', 1)} AS tenth, {r('-l_extendedprice / 8', 2)} AS negative, {r('sqrt(pow(l_discount, 2) + pow(l_tax, 2))', 6)} AS hyp, "
    "greatest(0, least(0.05, l_discount)) AS clipped, abs(l_quantity - 25) AS off FROM lineitem"))
def _(t):
    c = F.col
    return t.base("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", s.half_up(c("l_extendedprice") / 7, 1).alias("tenth"),
        s.half_up(-c("l_extendedprice") / 8, 2).alias("negative"),
        s.half_up(F.sqrt(F.pow(c("l_discount"), F.lit(2.0)) + F.pow(c("l_tax"), F.lit(2.0))), 6).alias("hyp"),
        F.greatest(F.lit(0.0), F.least(F.lit(0.05), c("l_discount"))).alias("clipped"), F.abs(c("l_quantity") - 25).alias("off"),
    )


@query("f04_defaults", (
    "SELECT event_id, coalesce(nullif(CAST(event_id % 3 AS DOUBLE), 0), 9.5) AS a, coalesce(nullif(CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END, 0), 1.0) AS b FROM events"))
def _(t):
    return t.base("events").select(
        "event_id", s.truthy_or(F.col("event_id") % 3, 9.5).alias("a"),
        s.truthy_or(F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value")), 1.0).alias("b"),
    )


_MIXED = "CASE event_id % 6 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN 'nan' WHEN 2 THEN '' WHEN 3 THEN 'DNF' WHEN 4 THEN concat(' ', CAST(event_id AS STRING)) ELSE CAST(value AS STRING) END"


@query("f05_safe_casts", (
    "SELECT event_id, CAST(CASE WHEN event_id % 6 IN (0, 4) THEN event_id END AS INT) AS whole, "
    "CAST(CASE event_id % 6 WHEN 0 THEN event_id WHEN 4 THEN event_id WHEN 5 THEN value END AS DOUBLE) AS number FROM events"))
def _(t):
    m = F.expr(_MIXED)
    # Text of a whole-valued double reads as a number but not as an integer.
    return t.base("events").select("event_id", s.safe_int(m).alias("whole"), s.safe_float(m).alias("number"))


@query("f06_durations", (
    "SELECT event_id, CAST(CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 3600000 + (event_id % 60) * 60000 + 3456 "
    "WHEN 3 THEN (event_id % 60) * 1000 + event_id % 1000 ELSE (event_id % 3) * 60000 + (user_id % 60) * 1000 + event_id % 1000 END AS BIGINT) AS ms FROM events"))
def _(t):
    return t.base("events").select("event_id", s.duration_ms(F.expr(LAP_TIME)).alias("ms"))


@query("f07_first_match_wins", (
    "SELECT event_id, CASE WHEN value <= 30 THEN 'early' WHEN value <= 100 THEN 'mid' ELSE 'late' END AS segment FROM events"))
def _(t):
    from diamondlap.operators.racing import lap_segment

    return t.base("events").select("event_id", lap_segment(F.col("value")).alias("segment"))


@query("f08_value_map", (
    "SELECT event_id, event_type, CAST(CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.1 ELSE -0.1 END AS DOUBLE) AS weight FROM events"))
def _(t):
    return t.base("events").select("event_id", "event_type", s.map_code("event_type", {"click": 0.5, "view": 0.1}, -0.1).alias("weight"))


@query("f09_json_paths", (
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(NULL AS STRING) AS missing, 'k' AS keys, FALSE AS is_list FROM events"))
def _(t):
    p = F.from_json("props", "k INT, nested STRUCT<x: STRING>")
    return t.base("events").select(
        "event_id", p["k"].alias("k"), p["nested"]["x"].alias("missing"),
        F.array_join(F.json_object_keys("props"), ",").alias("keys"), s.json_root_is_array("props").alias("is_list"),
    )


@query("f10_arrays", (
    "SELECT event_id, CASE WHEN event_id % 50 > 0 OR event_id % 30 > 0 THEN greatest(event_id % 50, event_id % 30) END AS last_stop, 3 AS stops, 0 AS first_stop FROM events"))
def _(t):
    stops = F.array(F.lit(0).cast("bigint"), F.col("event_id") % 50, F.col("event_id") % 30)
    return t.base("events").select(
        "event_id", F.array_max(F.filter(stops, lambda x: x > 0)).alias("last_stop"), F.size(stops).alias("stops"),
        F.get(stops, F.lit(0)).alias("first_stop"),
    )


@query("f11_maps", (
    "SELECT o_orderkey, concat('Player ', CAST(o_orderkey * 10 + 1 AS STRING)) AS away_name, CAST(NULL AS STRING) AS nobody, 4 AS players FROM orders"))
def _(t):
    from diamondlap.operators.flatten_mlb import batting_sides

    sides = batting_sides(docs.game_documents(t))
    both = sides.groupBy("game_pk").agg(
        F.first(F.when(F.col("side") == "away", F.col("players")), True).alias("a"),
        F.first(F.when(F.col("side") == "home", F.col("players")), True).alias("h"),
    ).select(F.col("game_pk").alias("o_orderkey"), F.map_concat("a", "h").alias("m"))
    key = lambda k: F.concat(F.lit("ID"), (F.col("o_orderkey") * 10 + k).cast("string"))
    return both.select(
        "o_orderkey", F.try_element_at("m", key(1))["name"].alias("away_name"),
        F.try_element_at("m", key(9))["name"].alias("nobody"), F.size("m").alias("players"),
    )

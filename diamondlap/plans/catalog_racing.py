"""Racing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from diamondlap.functions import codes, groups
from diamondlap.functions.scalars import map_code
from diamondlap.operators import racing
from diamondlap.plans.catalog_serve import six
from diamondlap.plans.registry import n, query, r
from diamondlap.plans.tables import with_views

RACE_VIEWS = ["races", "results", "driver_stats"]
_JOIN = (
    "FROM results res JOIN races r ON r.race_id = res.race_id JOIN driver_stats ds ON ds.race_id = res.race_id "
    "AND ds.driver_id = res.driver_id WHERE res.series_id = 1 AND res.finish_position > 0"
)


def _profile(scope: str, where: str = "") -> str:
    mean = lambda e, a: f"{r(f'avg({e})', 1)} AS {a}"
    return (
        f"SELECT {scope} res.driver_name, res.manufacturer, " + ", ".join([
            mean("res.finish_position", "avg_finish"), mean("res.start_position", "avg_start"),
            mean("res.finish_position - res.start_position", "avg_pos_gained"), mean("ds.quality_passes", "avg_quality_passes"),
            mean("ds.green_flag_passes", "avg_gf_passes"), mean("ds.green_flag_passed", "avg_gf_passed"),
            mean("ds.quality_pass_differential", "avg_pass_diff"), mean("ds.driver_rating", "avg_rating"),
        ]) + f", {n('count(*)')} AS races {_JOIN} {where} GROUP BY {scope} res.driver_name, res.manufacturer"
    )


@query("a20_track_profile", with_views(RACE_VIEWS, _profile("r.track_name,")))
def _(t):
    return racing.track_profile(t.results, t.races, t.driver_stats)


@query("p04_track_profile_by_pattern", with_views(
    RACE_VIEWS, _profile("", "AND r.track_name ILIKE '%RACEWAY%' AND r.race_name ILIKE '%spring%'")))
def _(t):
    return racing.track_profile(t.results, t.races, t.driver_stats, track="RACEWAY", race="spring")


@query("a21_manufacturer_index", with_views(
    RACE_VIEWS,
    f"SELECT m.track_name, manufacturer, drivers, entries, avg_rating, {r('avg_rating / fr * 100', 1)} AS rating_plus, avg_finish, "
    f"{r('ff / nullif(avg_finish, 0) * 100', 1)} AS finish_plus, avg_qp, {r('avg_qp / fq * 100', 1)} AS qp_plus, pass_ratio, "
    f"{r('pass_ratio / nullif(fp, 0) * 100', 1)} AS pass_ratio_plus FROM "
    f"(SELECT r.track_name, res.manufacturer, {n('count(DISTINCT res.driver_name)')} AS drivers, {n('count(*)')} AS entries, "
    f"{r('avg(ds.driver_rating)', 2)} AS avg_rating, {r('avg(res.finish_position)', 1)} AS avg_finish, {r('avg(ds.quality_passes)', 1)} AS avg_qp, "
    f"{r('avg(ds.green_flag_passes / nullif(ds.green_flag_passed, 0))', 3)} AS pass_ratio {_JOIN} AND res.manufacturer IS NOT NULL GROUP BY r.track_name, res.manufacturer) m "
    "JOIN (SELECT r.track_name, avg(ds.driver_rating) AS fr, avg(res.finish_position) AS ff, avg(ds.quality_passes) AS fq, "
    f"avg(ds.green_flag_passes / nullif(ds.green_flag_passed, 0)) AS fp {_JOIN} GROUP BY r.track_name) f ON f.track_name = m.track_name"))
def _(t):
    return racing.manufacturer_index(t.results, t.races, t.driver_stats)


@query("j06_manufacturer_index_pooled", with_views(
    RACE_VIEWS,
    f"SELECT manufacturer, drivers, entries, avg_rating, {r('avg_rating / fr * 100', 1)} AS rating_plus, avg_finish, "
    f"{r('ff / nullif(avg_finish, 0) * 100', 1)} AS finish_plus, avg_qp, {r('avg_qp / fq * 100', 1)} AS qp_plus, pass_ratio, "
    f"{r('pass_ratio / nullif(fp, 0) * 100', 1)} AS pass_ratio_plus FROM "
    f"(SELECT res.manufacturer, {n('count(DISTINCT res.driver_name)')} AS drivers, {n('count(*)')} AS entries, "
    f"{r('avg(ds.driver_rating)', 2)} AS avg_rating, {r('avg(res.finish_position)', 1)} AS avg_finish, {r('avg(ds.quality_passes)', 1)} AS avg_qp, "
    f"{r('avg(ds.green_flag_passes / nullif(ds.green_flag_passed, 0))', 3)} AS pass_ratio {_JOIN} AND r.track_name ILIKE '%a%' AND res.manufacturer IS NOT NULL GROUP BY res.manufacturer) m "
    "CROSS JOIN (SELECT avg(ds.driver_rating) AS fr, avg(res.finish_position) AS ff, avg(ds.quality_passes) AS fq, "
    f"avg(ds.green_flag_passes / nullif(ds.green_flag_passed, 0)) AS fp {_JOIN} AND r.track_name ILIKE '%a%') f"))
def _(t):
    return racing.manufacturer_index(t.results, t.races, t.driver_stats, track="a")


_SEG = (
    "seg AS (SELECT r.track_name, l.driver_name, CASE WHEN l.lap_number <= 30 THEN 'early' WHEN l.lap_number <= 100 THEN 'mid' ELSE 'late' END AS segment, "
    f"{r('avg(l.lap_speed)', 3)} AS speed FROM laps l JOIN races r ON r.race_id = l.race_id WHERE l.series_id = 1 AND l.lap_speed > 100 AND l.lap_number > 0 "
    "GROUP BY ALL HAVING count(*) > 3), "
    "wide AS (SELECT track_name, driver_name, max(CASE segment WHEN 'early' THEN speed END) AS lap_early, "
    "max(CASE segment WHEN 'mid' THEN speed END) AS lap_mid, max(CASE segment WHEN 'late' THEN speed END) AS lap_late FROM seg GROUP BY track_name, driver_name)"
)


@query("a22_lap_segments", with_views(["races", "laps"], "SELECT * FROM wide", _SEG))
def _(t):
    return racing.lap_segments(t.laps, t.races, min_laps=3)


@query("w09_profile_bars", with_views(
    [*RACE_VIEWS, "laps"],
    f"SELECT *, CASE WHEN drop_off < 1 THEN 'low' WHEN drop_off > 2 THEN 'high' WHEN drop_off IS NOT NULL THEN 'medium' END AS drop_band FROM "
    f"(SELECT p.*, lap_early, lap_mid, lap_late, {r('coalesce(avg_rating, 0) / max(coalesce(avg_rating, 0)) OVER (PARTITION BY p.track_name) * 100', 4)} AS rating_pct, "
    f"{r('greatest(0, least(100, (avg_pass_diff + 20) / 50 * 100))', 4)} AS pass_efficiency, "
    "CASE WHEN avg_pass_diff > 5 THEN 'good' WHEN avg_pass_diff > -5 THEN 'even' WHEN avg_pass_diff IS NOT NULL THEN 'poor' END AS pass_band, "
    f"CASE WHEN lap_mid IS NOT NULL THEN {r('lap_early - lap_late', 2)} END AS drop_off FROM ({_profile('r.track_name,')}) p "
    "LEFT JOIN wide w ON w.track_name = p.track_name AND w.driver_name = p.driver_name)", _SEG))
def _(t):
    profile = racing.driver_profile(t.results, t.races, t.driver_stats, t.laps, min_laps=3)
    return racing.profile_bars(profile, ["track_name"])


def _hist(tag, cond, since):
    return (
        f"{tag} AS (SELECT e.race_id, res.driver_name, avg(res.finish_position) AS f, avg(res.avg_position) AS u, count(*) AS k "
        f"FROM races e JOIN races r ON {cond} AND r.season >= {since} AND r.race_id <> e.race_id "
        "JOIN results res ON res.race_id = r.race_id WHERE res.finish_position > 0 GROUP BY e.race_id, res.driver_name)"
    )


def _sql_blend(s, t1, t2, a):
    return f"CASE WHEN st.k >= 2 THEN {s} * 0.50 + {t1} * 0.30 + {a} * 0.20 WHEN ty.k >= 3 THEN {t2} * 0.65 + {a} * 0.35 ELSE {a} END"


_HISTORY = ", ".join([
    _hist("st", "r.track_name = e.track_name", 2023), _hist("ty", "r.track_type = e.track_type", 2024), _hist("al", "TRUE", 2024),
    "hist AS (SELECT coalesce(st.race_id, ty.race_id, al.race_id) AS race_id, coalesce(st.driver_name, ty.driver_name, al.driver_name) AS driver_name, "
    f"coalesce(nullif({_sql_blend('st.f', 'coalesce(ty.f, al.f, 20)', 'ty.f', 'coalesce(al.f, 20)')}, 0), 20) AS hist_avg_finish, "
    "coalesce(nullif(" + _sql_blend(
        "coalesce(st.u, st.f)", "coalesce(ty.u, ty.f, al.f, 20)", "coalesce(ty.u, ty.f)", "coalesce(al.u, al.f, 20)")
    + f", 0), 20) AS hist_avg_running, {n('coalesce(st.k, 0)')} AS same_track_races, {n('coalesce(ty.k, 0)')} AS same_type_races, "
    f"{n('coalesce(al.k, 0)')} AS all_track_races FROM al FULL OUTER JOIN ty ON ty.race_id = al.race_id AND ty.driver_name = al.driver_name "
    "FULL OUTER JOIN st ON st.race_id = coalesce(ty.race_id, al.race_id) AND st.driver_name = coalesce(ty.driver_name, al.driver_name))",
])


def entries(t):
    return t.live_snapshots.select("race_id", "driver_name")


@query("a23_history_blend", with_views(
    ["races", "results", "live_snapshots"],
    f"SELECT h.race_id, h.driver_name, {r('hist_avg_finish', 6)} AS hist_avg_finish, {r('hist_avg_running', 6)} AS hist_avg_running, "
    "same_track_races, same_type_races, all_track_races FROM hist h SEMI JOIN live_snapshots s ON s.race_id = h.race_id AND s.driver_name = h.driver_name",
    _HISTORY))
def _(t):
    return six(racing.history_blend(entries(t), t.results, t.races), "hist_avg_finish", "hist_avg_running")


@query("j05_race_history_full_outer", with_views(
    ["races", "results"],
    f"SELECT race_id, driver_name, {r('hist_avg_finish', 6)} AS hist_avg_finish, {r('hist_avg_running', 6)} AS hist_avg_running, "
    "same_track_races, same_type_races, all_track_races FROM hist WHERE race_id = 15", _HISTORY))
def _(t):
    return six(racing.race_history(t.results, t.races, 15), "hist_avg_finish", "hist_avg_running")


_VARIANCE = (
    f"var AS (SELECT race_id, driver_name, {r('stddev_samp(last_lap_speed)', 3)} AS speed_stddev, {r('avg(last_lap_speed)', 3)} AS speed_avg, "
    f"{n('count(*)')} AS lap_samples FROM live_snapshots WHERE last_lap_speed > 0 AND lap > 5 GROUP BY race_id, driver_name)"
)


@query("a24_speed_variance", with_views(["live_snapshots"], "SELECT * FROM var", _VARIANCE))
def _(t):
    return racing.speed_variance(t.live_snapshots)


_LATEST = "newest AS (SELECT s.* FROM live_snapshots s JOIN (SELECT race_id, max(snapshot_at) AS m FROM live_snapshots GROUP BY race_id) x ON x.race_id = s.race_id AND x.m = s.snapshot_at)"


@query("w03_latest_snapshot", with_views(
    ["live_snapshots"], "SELECT race_id, snapshot_at, driver_name, position, lap FROM newest", _LATEST))
def _(t):
    return groups.latest(t.live_snapshots, "race_id", "snapshot_at").select(
        "race_id", "snapshot_at", "driver_name", "position", "lap"
    )


@query("w05_field_best_and_size", with_views(
    ["live_snapshots"],
    "SELECT race_id, snapshot_at, driver_name, max(best_lap_speed) OVER w AS field_best, "
    f"{n('count(*) OVER w')} AS field_size FROM live_snapshots WINDOW w AS (PARTITION BY race_id, snapshot_at)"))
def _(t):
    return groups.field_stats(t.live_snapshots, ["race_id", "snapshot_at"], "best_lap_speed").select(
        "race_id", "snapshot_at", "driver_name", "field_best", "field_size"
    )


_PROJECTION = ", ".join([
    _HISTORY, _VARIANCE, _LATEST,
    "b0 AS (SELECT s.*, r.track_name, r.track_type, count(*) OVER (PARTITION BY s.race_id) AS fs, max(best_lap_speed) OVER (PARTITION BY s.race_id) AS fb, "
    "coalesce(nullif(r.actual_laps, 0), nullif(r.scheduled_laps, 0), nullif(s.total_laps, 0), 400) AS tl FROM newest s LEFT JOIN races r ON r.race_id = s.race_id)",
    "b1 AS (SELECT *, CASE WHEN lap < 5 THEN 0.0 ELSE least(1.0, lap / tl) END AS p, coalesce(nullif(position, 0), fs) AS cur FROM b0)",
    "b2 AS (SELECT b.*, h.hist_avg_finish, h.same_track_races, h.same_type_races, v.speed_stddev, v.lap_samples, "
    "greatest(1.0, least(fs, cur * CASE WHEN p >= 0.8 THEN 0.85 + 0.13 * ((p - 0.8) / 0.2) ELSE 0.3 + 0.55 * p END "
    "+ coalesce(h.hist_avg_finish, cur) * 0.4 * (1 - p) + coalesce(h.hist_avg_running, h.hist_avg_finish, cur) * 0.3 * (1 - p) "
    "+ coalesce((best_lap_speed - fb) / fb * 5 * (1 - p), 0) "
    "+ CASE WHEN tire_age <= 20 THEN -1.5 * (1 - tire_age / 20) * (1 - p) WHEN tire_age >= 50 THEN 2.0 * least(1.0, (tire_age - 50) / 40) * (1 - p) ELSE 0 END)) AS raw "
    "FROM b1 b LEFT JOIN hist h ON h.race_id = b.race_id AND h.driver_name = b.driver_name LEFT JOIN var v ON v.race_id = b.race_id AND v.driver_name = b.driver_name)",
    f"proj AS (SELECT race_id, track_name, snapshot_at, lap, {n('tl')} AS total_laps, {r('p * 100', 1)} AS race_pct, driver_name, car_number, "
    f"{n('cur')} AS current_position, {r('raw', 1)} AS projected_score, nullif(delta_leader, 0) AS delta_leader, hist_avg_finish, "
    f"{n('coalesce(same_track_races, 0)')} AS same_track_races, {n('coalesce(same_type_races, 0)')} AS same_type_races, tire_age, speed_stddev, "
    f"{n('coalesce(lap_samples, 0)')} AS lap_samples FROM b2)",
    "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY race_id ORDER BY projected_score, current_position, driver_name) AS INT) AS projected_finish FROM proj)",
])
_PROJ_VIEWS = ["races", "results", "live_snapshots"]
_PROJ_COLS = [
    "race_id", "track_name", "snapshot_at", "lap", "total_laps", "race_pct", "driver_name", "car_number", "current_position",
    "projected_score", "projected_finish", "delta_leader", "same_track_races", "same_type_races", "tire_age", "speed_stddev", "lap_samples",
]


def projected(t):
    return racing.live_projection(
        t.live_snapshots, racing.history_blend(entries(t), t.results, t.races),
        racing.speed_variance(t.live_snapshots), t.races,
    ).withColumn("total_laps", F.col("total_laps").cast("bigint"))


@query("m08_live_projection", with_views(
    _PROJ_VIEWS, f"SELECT {', '.join(_PROJ_COLS)}, {r('hist_avg_finish', 6)} AS hist_avg_finish FROM ranked", _PROJECTION))
def _(t):
    return six(projected(t).select(*_PROJ_COLS, "hist_avg_finish"), "hist_avg_finish")


@query("m10_confidence", with_views(
    _PROJ_VIEWS,
    f"SELECT race_id, driver_name, projected_finish, " + r(
        "least(95.0, race_pct / 100 * 40 + CASE WHEN hist_avg_finish IS NOT NULL THEN 15 ELSE 0 END "
        "+ CASE WHEN speed_stddev IS NOT NULL AND lap_samples > 10 THEN greatest(0, least(35, (6 - speed_stddev) * 7)) ELSE 0 END "
        "+ CASE WHEN delta_leader < 5 THEN 10 ELSE 0 END)", 4) + " AS confidence FROM ranked", _PROJECTION))
def _(t):
    return racing.confidence(projected(t)).select("race_id", "driver_name", "projected_finish", "confidence")


_TRACK_HISTORY = (
    f"SELECT res.driver_name, res.driver_id, {r('avg(res.finish_position)', 2)} AS hist_avg_finish, {r('avg(res.avg_position)', 2)} AS hist_avg_running, "
    f"{r('avg(ds.driver_rating)', 2)} AS hist_rating FROM results res JOIN races r ON r.race_id = res.race_id LEFT JOIN driver_stats ds "
    "ON ds.race_id = res.race_id AND ds.driver_id = res.driver_id WHERE r.track_name ILIKE '%oval%' AND res.finish_position > 0 GROUP BY res.driver_name, res.driver_id"
)


@query("a25_track_history", with_views(RACE_VIEWS, _TRACK_HISTORY))
def _(t):
    return racing.track_history(t.results, t.races, t.driver_stats, track="oval")


@query("m09_poll_projection", with_views(
    [*RACE_VIEWS, "live_snapshots"],
    f"SELECT race_id, snapshot_at, driver_id, driver_name, {n('cur')} AS current_position, {r('greatest(1.0, least(fs, cur * (0.3 + 0.55 * p) + hf * 0.4 * (1 - p) + hr * 0.3 * (1 - p) + coalesce((best_lap_speed - fb) / fb * 5 * (1 - p), 0)))', 1)} AS projected_finish, "
    f"hist_avg_finish, hist_rating, {r('p * 100', 1)} AS race_pct FROM (SELECT *, coalesce(hist_avg_finish, fs / 2) AS hf, coalesce(hist_avg_running, hist_avg_finish, fs / 2) AS hr FROM "
    "(SELECT s.*, h.hist_avg_finish, h.hist_avg_running, h.hist_rating, lap / total_laps AS p, count(*) OVER w AS fs, max(best_lap_speed) OVER w AS fb, "
    "coalesce(nullif(position, 0), count(*) OVER w) AS cur FROM live_snapshots s LEFT JOIN th h ON h.driver_id = s.driver_id WINDOW w AS (PARTITION BY s.race_id, s.snapshot_at)))",
    f"th AS ({_TRACK_HISTORY})"))
def _(t):
    history = racing.track_history(t.results, t.races, t.driver_stats, track="oval")
    return racing.poll_projection(t.live_snapshots, history).select(
        "race_id", "snapshot_at", "driver_id", "driver_name", "current_position", "projected_finish",
        "hist_avg_finish", "hist_rating", "race_pct",
    )


@query("w04_rank_in_race", with_views(
    ["laps"],
    "SELECT race_id, driver_id, lap_number, lap_speed, CAST(row_number() OVER (PARTITION BY race_id ORDER BY lap_speed, driver_id, lap_number) AS INT) AS place FROM laps"))
def _(t):
    return groups.rank_in_group(
        t.laps, "race_id", [F.col("lap_speed"), F.col("driver_id"), F.col("lap_number")], out="place",
    ).select("race_id", "driver_id", "lap_number", "lap_speed", "place")


@query("f12_code_labels", with_views(
    ["races", "live_snapshots"],
    "SELECT r.race_id, CASE r.series_id WHEN 1 THEN 'Cup Series' WHEN 2 THEN 'Xfinity Series' WHEN 3 THEN 'Truck Series' END AS series, s.flag, "
    "CASE s.flag WHEN 0 THEN 'none' WHEN 1 THEN 'green' WHEN 2 THEN 'yellow' WHEN 3 THEN 'red' WHEN 4 THEN 'checkered' WHEN 8 THEN 'warm up' "
    "WHEN 9 THEN 'pre-race' ELSE CAST(s.flag AS STRING) END AS flag_name FROM races r JOIN (SELECT DISTINCT race_id, CAST(lap % 11 AS INT) AS flag FROM live_snapshots) s "
    "ON s.race_id = r.race_id"))
def _(t):
    flags = t.live_snapshots.select("race_id", (F.col("lap") % 11).alias("flag")).distinct()
    return t.races.join(flags, "race_id").select(
        "race_id", map_code("series_id", codes.SERIES_NAMES).alias("series"), "flag",
        map_code("flag", codes.FLAG_NAMES).alias("flag_name"),
    )

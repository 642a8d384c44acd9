"""Projection and grading queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from diamondlap.operators import marcel as mc, matchup, serve
from diamondlap.plans.catalog_pitching import MIN_FACED, tendencies, tt_select
from diamondlap.plans.catalog_serve import six
from diamondlap.plans.registry import n, query, r
from diamondlap.plans.tables import Tables, with_views

MIN_MIX, MIN_AB, MIN_IP = 5, 10, 30


def lineups(t: Tables) -> DataFrame:
    """Every batter a pitcher faced, as that game's lineup row, with the season
    whose rates count: the one before the game's."""
    before = t.games.select("game_pk", (F.col("season") - 1).cast("int").alias("season"))
    return t.at_bats.filter(F.col("batter_id").isNotNull()).join(before, "game_pk").select(
        "game_pk", "season", "pitcher_id", "batter_id", F.col("at_bat_index").alias("batting_order")
    )


def mix(t: Tables) -> DataFrame:
    return serve.pitch_mix(t.scores, min_pitches=MIN_MIX)


def tend(t: Tables) -> DataFrame:
    return tendencies(t)


def k_rates(t: Tables) -> DataFrame:
    return serve.batter_k(t.box_batting, t.games, min_ab=MIN_AB)


def pitcher_rates(t: Tables) -> DataFrame:
    return mc.pitcher_season_by_name(t.season_pitching, serve.latest_name(t.at_bats))


VIEWS = ["games", "at_bats", "pitches", "scores", "box_batting", "season_pitching"]
_WH = "coalesce(nullif(t.whiff_rate, 0), 0.267)"
_BASE = ", ".join([
    f"tt AS (SELECT * FROM ({tt_select(MIN_FACED)}) WHERE pitches_faced >= {MIN_FACED})",
    "mix AS (SELECT *, total_pitches / sum(total_pitches) OVER (PARTITION BY season, pitcher_id) AS usage FROM ("
    f"SELECT season, pitcher_id, pitch_type_code, {r('avg(value_plus)', 1)} AS value_plus, {r('avg(whiff_rate)', 3)} AS whiff_rate, "
    f"{r('avg(csw_rate)', 3)} AS csw_rate, {r('avg(hard_hit_rate)', 3)} AS hard_hit_rate, {r('avg(avg_velo)', 1)} AS avg_velo, "
    f"sum(pitches_thrown) AS total_pitches FROM scores WHERE game_type = 'R' "
    f"GROUP BY season, pitcher_id, pitch_type_code HAVING sum(pitches_thrown) >= {MIN_MIX}))",
    "lineups AS (SELECT a.game_pk, CAST(g.season - 1 AS INT) AS season, a.pitcher_id, a.batter_id, a.at_bat_index AS batting_order FROM at_bats a "
    "JOIN games g ON g.game_pk = a.game_pk WHERE a.batter_id IS NOT NULL)",
    "bk AS (SELECT g.season, b.player_id AS batter_id, sum(b.strikeouts) / nullif(sum(b.at_bats), 0) AS k FROM box_batting b "
    f"JOIN games g ON g.game_pk = b.game_pk WHERE g.game_type = 'R' GROUP BY g.season, b.player_id HAVING sum(b.at_bats) >= {MIN_AB})",
    "nm AS (SELECT pitcher_id, max(pitcher_name) AS nm FROM at_bats GROUP BY pitcher_id)",
    f"pk AS (SELECT s.season, n.pitcher_id, s.k_pct AS k, s.ip FROM season_pitching s JOIN nm n ON lower(n.nm) = lower(s.player_name) WHERE s.ip >= {MIN_IP})",
    "faced AS (SELECT l.*, m.pitch_type_code, m.usage, m.value_plus, m.avg_velo, m.whiff_rate AS pw, m.csw_rate AS pc, m.hard_hit_rate AS ph, "
    f"{_WH} / 0.267 AS adj, t.batter_id IS NOT NULL AS known, coalesce(nullif(pk.k, 0), 0.23) AS kp, coalesce(nullif(bk.k, 0), 0.227) AS kb, "
    "least(0.40, coalesce(pk.ip, 0) / 200) AS ipw, coalesce(nullif(t.hard_hit_rate, 0), 0.395) AS bh, coalesce(nullif(t.contact_rate, 0), 0.78) AS ct, "
    "coalesce(nullif(t.barrel_rate, 0), 0.08) AS br, coalesce(nullif(t.avg_exit_velo, 0), 88.0) AS ev, t.pitches_faced "
    "FROM lineups l JOIN mix m ON m.season = l.season AND m.pitcher_id = l.pitcher_id "
    "LEFT JOIN tt t ON t.season = l.season AND t.batter_id = l.batter_id AND t.pitch_type_code = m.pitch_type_code "
    "LEFT JOIN pk ON pk.season = l.season AND pk.pitcher_id = l.pitcher_id LEFT JOIN bk ON bk.season = l.season AND bk.batter_id = l.batter_id)",
])
_LK = (
    "k0 AS (SELECT game_pk, season, pitcher_id, batter_id, batting_order, max(kp) AS kp, max(kb) AS kb, max(ipw) AS ipw, bool_or(has_any) AS has_any, "
    "sum(pw * adj * usage) / sum(usage) AS wh, sum(pc * adj * usage) / sum(usage) AS cs, sum(adj * usage) AS ow, sum(value_plus * usage) AS vp "
    "FROM (SELECT f.*, (f.season, f.batter_id) IN (SELECT (season, batter_id) FROM tt) AS has_any FROM faced f) GROUP BY game_pk, season, pitcher_id, batter_id, batting_order), "
    "lk AS (SELECT game_pk, season, pitcher_id, batter_id, batting_order, "
    + r("least(0.65, greatest(0.05, kp * ow * ipw + kb * (kp / 0.227) * 0.35 + least(0.60, cs * 0.75) * (1 - ipw - 0.35)))", 3)
    + f" AS projected_k_pct, {r('wh', 3)} AS projected_whiff_rate, {r('cs', 3)} AS projected_csw, {r('vp', 1)} AS weighted_value_plus, "
    f"has_any AS has_tendency_data, {r('kp * 100', 1)} AS pitcher_k_pct, {r('ipw', 2)} AS ip_anchor_weight FROM k0)"
)


def projected_lineups(t: Tables) -> DataFrame:
    return matchup.lineup_k(
        lineups(t), mix(t), tend(t), k_rates(t), pitcher_rates(t), min_faced=MIN_FACED, min_ip=MIN_IP
    )


@query("m03_lineup_strikeouts", with_views(VIEWS, "SELECT * FROM lk", _BASE + ", " + _LK))
def _(t):
    return projected_lineups(t)


@query("m03_lineup_totals", with_views(
    VIEWS,
    f"SELECT game_pk, pitcher_id, {r('avg(projected_k_pct)', 3)} AS avg_k_pct, {r('avg(projected_k_pct) * 18', 1)} AS projected_ks_6inn, "
    f"{r('avg(projected_k_pct) * 27', 1)} AS projected_ks_9inn, {n('count(*)')} AS lineup_size FROM lk GROUP BY game_pk, pitcher_id",
    _BASE + ", " + _LK))
def _(t):
    return matchup.lineup_totals(projected_lineups(t))


_KB = "least(0.65, greatest(0.05, kp * adj * ipw + kb * (kp / 0.227) * 0.35 + least(0.60, least(0.65, coalesce(nullif(pc, 0), 0.30) * adj) * 0.75) * (1 - ipw - 0.35)))"
_VP = "coalesce(nullif(value_plus, 0), 100)"
_PAIR = (
    f"pp AS (SELECT *, {_KB} AS k, bh * 0.6 + coalesce(nullif(ph, 0), 0.395) * 0.4 AS hh, 100.0 / greatest({_VP}, 50) AS sup FROM "
    "(SELECT DISTINCT ON (season, pitcher_id, batter_id, pitch_type_code) * FROM faced)), "
    "pw AS (SELECT *, (1 - k) * ct * 0.380 * sup AS woba FROM pp)"
)


def pairs(t: Tables) -> DataFrame:
    return lineups(t).select("season", "pitcher_id", "batter_id").distinct()


def versus(t: Tables) -> DataFrame:
    return matchup.batter_vs_pitcher(
        pairs(t), mix(t), tend(t), k_rates(t), pitcher_rates(t), min_faced=MIN_FACED, min_ip=MIN_IP
    )


@query("m04_batter_vs_pitcher", with_views(
    VIEWS,
    f"SELECT season, pitcher_id, batter_id, {r('sum(k * usage) / sum(usage) * 100', 1)} AS projected_k_pct, "
    f"{r('sum(woba * usage) / sum(usage)', 3)} AS projected_woba, {r('sum(hh * usage) / sum(usage) * 100', 1)} AS projected_hard_hit_pct, "
    f"{r('sum(tb * up / 100)', 3)} AS projected_tb_per_pa, {r('sum(tb * up / 100) * 3.5', 2)} AS projected_tb_game, "
    f"{r('max(kp) * 100', 1)} AS pitcher_k_pct, {r('max(ipw)', 2)} AS ip_anchor_weight FROM "
    f"(SELECT *, {r('woba * 1.3', 3)} AS tb, {r('usage * 100', 1)} AS up FROM pw) GROUP BY season, pitcher_id, batter_id",
    _BASE + ", " + _PAIR))
def _(t):
    return versus(t).drop("pitch_breakdown")


@query("m04_pitch_breakdown", with_views(
    VIEWS,
    f"SELECT season, pitcher_id, batter_id, pitch_type_code, {r('usage * 100', 1)} AS usage_pct, avg_velo, {_VP} AS value_plus, "
    f"{r('least(0.80, coalesce(nullif(pw, 0), 0.267) * adj) * 100', 1)} AS adj_whiff_pct, {r('k * 100', 1)} AS adj_k_pct, "
    f"{r('hh * 100', 1)} AS adj_hard_hit_pct, {r('br * sup * 100', 1)} AS adj_barrel_pct, {r('ev', 1)} AS batter_avg_ev, "
    f"{r('woba', 3)} AS exp_woba, {r('woba * 1.3', 3)} AS exp_tb_per_pa, {r('0.380 * sup', 3)} AS woba_on_contact, "
    f"known AS has_tendency_data, {n('coalesce(pitches_faced, 0)')} AS pitches_faced FROM pw", _BASE + ", " + _PAIR))
def _(t):
    return versus(t).select("season", "pitcher_id", "batter_id", F.explode("pitch_breakdown").alias("p")).select(
        "season", "pitcher_id", "batter_id", "p.*"
    )


_SNAP = (
    "s0 AS (SELECT *, least(0.60, least(0.65, coalesce(nullif(pc, 0), 0.30) * adj) * 0.75) AS k, "
    f"bh * 0.6 + coalesce(nullif(ph, 0), 0.395) * 0.4 AS hh, 100.0 / greatest({_VP}, 50) AS sup FROM faced), "
    "s1 AS (SELECT game_pk, season, pitcher_id, batter_id, batting_order, sum(k * usage) / sum(usage) AS k, sum(hh * usage) / sum(usage) AS hh, "
    f"sum((1 - k) * ct * 0.380 * sup * usage) / sum(usage) AS woba, sum({_VP} * usage) AS vp FROM s0 GROUP BY game_pk, season, pitcher_id, batter_id, batting_order), "
    f"snap AS (SELECT game_pk, season, pitcher_id, batter_id, batting_order, {r('vp', 1)} AS pitcher_value_plus, "
    f"{r('CASE WHEN k <> 0 THEN k / 0.75 ELSE 0.267 END', 3)} AS batter_whiff_rate, {r('hh', 3)} AS batter_hard_hit_rate, "
    f"CAST(0.38 AS DOUBLE) AS batter_woba_on_contact, {r('k', 3)} AS proj_k_pct, {r('woba', 3)} AS proj_woba, {r('woba * 1.3', 3)} AS proj_tb_per_pa, "
    f"{r('woba * 1.3 * 3.5', 2)} AS proj_tb_game, {r('hh', 3)} AS proj_hard_hit_pct FROM s1)"
)


def snapshots(t: Tables) -> DataFrame:
    return matchup.snapshot_projections(lineups(t), mix(t), tend(t), min_faced=MIN_FACED)


@query("m05_snapshot_projections", with_views(VIEWS, "SELECT * FROM snap", _BASE + ", " + _SNAP))
def _(t):
    return snapshots(t)


_ACT = (
    "act AS (SELECT game_pk, player_id AS batter_id, CAST(at_bats + coalesce(hit_by_pitch, 0) + coalesce(sac_flies, 0) AS INT) AS actual_pa, "
    "CAST(coalesce(strikeouts, 0) AS INT) AS actual_strikeouts, hits AS actual_hits, CAST(coalesce(total_bases, 0) AS INT) AS actual_total_bases, "
    "home_runs AS actual_home_runs, coalesce(strikeouts, 0) / at_bats AS actual_k_pct, "
    "coalesce(total_bases, 0) / (at_bats + coalesce(hit_by_pitch, 0) + coalesce(sac_flies, 0)) AS actual_tb_per_pa "
    "FROM box_batting WHERE at_bats > 0)"
)


@query("m06_actuals", with_views(
    ["box_batting"],
    "SELECT game_pk, batter_id, actual_pa, actual_strikeouts, actual_hits, actual_total_bases, actual_home_runs, "
    f"{r('actual_k_pct', 6)} AS actual_k_pct, {r('actual_tb_per_pa', 6)} AS actual_tb_per_pa FROM act", _ACT))
def _(t):
    return six(matchup.actuals(t.box_batting), "actual_k_pct", "actual_tb_per_pa")


def graded(t: Tables) -> DataFrame:
    seasons = t.games.select("game_pk", "season")
    return matchup.grade(snapshots(t).drop("season").join(seasons, "game_pk"), t.box_batting)


def _corr(a, b):
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


def _metrics(by: str) -> str:
    mse = lambda a, b: f"avg(pow({a} - {b}, 2))"
    k = lambda a, b: mse(a, b)
    return ", ".join([
        *([by] if by else []),
        f"{n('count(*)')} AS n", f"{n('count(DISTINCT game_pk)')} AS games", f"{n('count(DISTINCT pitcher_id)')} AS pitchers",
        f"{r('avg(abs(proj_k_pct - actual_k_pct))', 3)} AS mae_k", f"{r('sqrt(' + k('proj_k_pct', 'actual_k_pct') + ')', 3)} AS rmse_k",
        f"{r(_corr('proj_k_pct', 'actual_k_pct'), 3)} AS pearson_k", f"{r('avg(abs(0.227 - actual_k_pct))', 3)} AS mae_k_naive",
        f"{r('1 - ' + k('proj_k_pct', 'actual_k_pct') + ' / nullif(' + k('0.227', 'actual_k_pct') + ', 0)', 3)} AS skill_score_k",
        f"{r('avg(abs(proj_tb_per_pa - actual_tb_per_pa))', 3)} AS mae_tb", f"{r('sqrt(' + k('proj_tb_per_pa', 'actual_tb_per_pa') + ')', 3)} AS rmse_tb",
        f"{r(_corr('proj_tb_per_pa', 'actual_tb_per_pa'), 3)} AS pearson_tb", f"{r('avg(abs(0.260 - actual_tb_per_pa))', 3)} AS mae_tb_naive",
        f"{r('1 - ' + k('proj_tb_per_pa', 'actual_tb_per_pa') + ' / nullif(' + k('0.260', 'actual_tb_per_pa') + ', 0)', 3)} AS skill_score_tb",
        f"{r('avg(pow(CASE WHEN actual_k_pct > 0 THEN 1.0 ELSE 0.0 END - least(proj_k_pct * 2.5, 0.99), 2))', 3)} AS brier_k",
        f"{r('avg(pow(CASE WHEN actual_total_bases > 0 THEN 1.0 ELSE 0.0 END - least(proj_tb_game / 3.0, 0.99), 2))', 3)} AS brier_tb_any",
        f"{r('avg(CASE WHEN proj_k_pct >= 0.28 THEN actual_k_pct END)', 3)} AS actual_k_high_proj",
        f"{r('avg(CASE WHEN proj_k_pct BETWEEN 0.20 AND 0.27 THEN actual_k_pct END)', 3)} AS actual_k_mid_proj",
        f"{r('avg(CASE WHEN proj_k_pct < 0.20 THEN actual_k_pct END)', 3)} AS actual_k_low_proj",
        f"{n('count(CASE WHEN proj_k_pct >= 0.28 THEN 1 END)')} AS n_high_k_proj",
        f"{n('count(CASE WHEN proj_k_pct BETWEEN 0.20 AND 0.27 THEN 1 END)')} AS n_mid_k_proj",
        f"{n('count(CASE WHEN proj_k_pct < 0.20 THEN 1 END)')} AS n_low_k_proj",
    ])


_GRADED = "SELECT p.* EXCLUDE (season), g.season, a.* EXCLUDE (game_pk, batter_id) FROM snap p JOIN games g ON g.game_pk = p.game_pk JOIN act a ON a.game_pk = p.game_pk AND a.batter_id = p.batter_id WHERE a.actual_pa >= 1"


@query("m06_grading_by_season", with_views(
    VIEWS, f"SELECT {_metrics('season')} FROM ({_GRADED}) GROUP BY season", _BASE + ", " + _SNAP + ", " + _ACT))
def _(t):
    return matchup.grading_metrics(graded(t), ["season"], min_pa=1)


@query("a18_grading_overall", with_views(
    VIEWS, f"SELECT {_metrics('')} FROM ({_GRADED}) WHERE actual_pa >= 2", _BASE + ", " + _SNAP + ", " + _ACT))
def _(t):
    return matchup.grading_metrics(graded(t))


@query("a18_grading_by_game", with_views(
    VIEWS, f"SELECT {_metrics('game_pk')} FROM ({_GRADED}) GROUP BY game_pk", _BASE + ", " + _SNAP + ", " + _ACT))
def _(t):
    return matchup.grading_metrics(graded(t), ["game_pk"], min_pa=1)


_RATES = ["k_pct", "bb_pct", "fip", "era", "siera"]
_MARCEL = ", ".join([
    "wts AS (SELECT * FROM (VALUES (1, 5.0), (2, 4.0), (3, 3.0)) AS x(lag, w))",
    "wr AS (SELECT lower(s.player_name) AS player, CAST(s.season + x.lag AS INT) AS projected_season, "
    + ", ".join(f"sum(s.{c} * w * ip) / nullif(sum(w * ip), 0) AS w_{c}" for c in _RATES)
    + ", sum(ip * w) / nullif(sum(w), 0) AS w_ip, sum(w * ip) AS tw FROM season_pitching s, wts x WHERE s.ip >= 10 "
    "GROUP BY lower(s.player_name), s.season + x.lag)",
    "lg AS (SELECT season + 1 AS projected_season, " + ", ".join(f"avg({c}) AS lg_{c}" for c in _RATES)
    + " FROM season_pitching WHERE ip >= 50 GROUP BY season + 1)",
    "rel AS (SELECT w.*, lg.* EXCLUDE (projected_season), CASE WHEN tw > 0 THEN 1 - 200.0 / (w_ip + 200.0) ELSE 0 END AS rel "
    "FROM wr w LEFT JOIN lg ON lg.projected_season = w.projected_season WHERE nullif(w_k_pct, 0) IS NOT NULL)",
    "mc AS (SELECT player, projected_season, " + ", ".join(
        f"{r(f'(rel * w_{c} + (1 - rel) * lg_{c}) * {s}', d)} AS proj_{c}"
        for c, s, d in [("k_pct", 100, 1), ("bb_pct", 100, 1), ("fip", 1, 2), ("era", 1, 2), ("siera", 1, 2)])
    + f", {r('rel', 3)} AS reliability FROM rel)",
])


@query("m07_marcel", with_views(["season_pitching"], "SELECT * FROM mc", _MARCEL))
def _(t):
    return mc.marcel(t.season_pitching)


@query("a19_weighted_rates", with_views(
    ["season_pitching"],
    "SELECT player, projected_season, " + ", ".join(f"{r(f'w_{c}', 6)} AS w_{c}" for c in _RATES)
    + f", {r('w_ip', 6)} AS w_ip, {r('tw', 6)} AS total_weight FROM wr", _MARCEL))
def _(t):
    return six(mc.weighted_rates(t.season_pitching), *[f"w_{c}" for c in _RATES], "w_ip", "total_weight")


@query("m07_marcel_with_score_context", with_views(
    ["season_pitching", "at_bats", "scores"],
    "SELECT n.pitcher_id, m.projected_season, m.player, proj_k_pct, proj_bb_pct, proj_fip, proj_era, proj_siera, reliability, "
    "c.prior_value_plus, c.prior_pitches FROM mc m LEFT JOIN (SELECT pitcher_id, lower(max(pitcher_name)) AS nm FROM at_bats GROUP BY pitcher_id) n "
    "ON n.nm = m.player LEFT JOIN (SELECT pitcher_id, season + 1 AS ps, "
    f"{r('avg(value_plus)', 1)} AS prior_value_plus, {n('sum(pitches_thrown)')} AS prior_pitches FROM scores WHERE game_type = 'R' GROUP BY pitcher_id, season) c "
    "ON c.pitcher_id = n.pitcher_id AND c.ps = m.projected_season", _MARCEL))
def _(t):
    return mc.with_score_context(mc.marcel(t.season_pitching), t.scores, serve.latest_name(t.at_bats))


@query("j09_rates_by_player_name", with_views(
    ["season_pitching", "at_bats"],
    "SELECT n.pitcher_id, s.season, s.player_name, s.ip FROM season_pitching s JOIN "
    "(SELECT pitcher_id, max(pitcher_name) AS nm FROM at_bats GROUP BY pitcher_id) n ON lower(n.nm) = lower(s.player_name)"))
def _(t):
    return mc.pitcher_season_by_name(t.season_pitching, serve.latest_name(t.at_bats)).select(
        "pitcher_id", "season", "player_name", "ip"
    )

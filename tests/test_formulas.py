"""Hand-worked cases for the formulas."""

import math

import pytest
from pyspark.sql import Window, functions as F

from helpers import rows
from diamondlap.functions import codes, groups, scalars as s
from diamondlap.operators import marcel, matchup, pitch_value as pv, racing, serve, tendencies as td

PITCH = (
    "game_pk INT, game_date STRING, game_type STRING, season INT, pitcher_id INT, pitcher_name STRING, "
    "pitch_type_code STRING, call_code STRING, zone INT, start_speed DOUBLE, spin_rate INT, pfx_x DOUBLE, pfx_z DOUBLE, "
    "batter_id INT, launch_speed DOUBLE, launch_angle DOUBLE, event_type STRING"
)
TT = "batter_id INT, pitch_type_code STRING, season INT, pitches_faced BIGINT, whiff_rate DOUBLE, chase_rate DOUBLE, hard_hit_rate DOUBLE"


def pitch(call, batter=1, speed=None, event=None, game=1, kind="FF", pitcher=10, season=2023, name="P"):
    return (game, "2023-05-01", "R", season, pitcher, name, kind, call, 5, 95.0, 2200, 1.0, 2.0, batter, speed, 10.0, event)


def tendencies(spark, own=(0.2, 0.25, 0.3), season=2023, league=(0.267, 0.310, 0.395)):
    """Batter 1 with the given rates and one other row that makes the plain mean
    of the table equal to `league`."""
    other = tuple(2 * m - o for m, o in zip(league, own))
    return spark.createDataFrame([(1, "FF", season, 60, *own), (2, "FF", season, 60, *other)], TT)


VALUES = [
    ("S", None, None, 0.170 * 1.067),
    ("C", None, None, 0.025 * 1.06),
    ("X", 101.0, "field_out", 0.049),
    ("X", 101.0, "single", -0.888 * 1.095),
    ("X", 80.0, "field_out", 0.098 * 0.85),
    ("X", 90.0, "home_run", -2.101),
    ("X", None, "sac_fly", 0.049),
    ("X", 90.0, "grounded_into_double_play", 0.196),
    ("X", 90.0, None, 0.098),
    ("X", 90.0, "unheard_of", 0.098),
    ("F", None, None, 0.020), ("L", None, None, 0.020), ("D", None, None, 0.020), ("E", None, None, 0.020),
    ("B", None, None, -0.040), ("*B", None, None, -0.040), ("H", None, None, -0.040),
    ("M", None, None, -0.150), ("Z", None, None, 0.0),
]


def test_pitch_value(spark):
    df = spark.createDataFrame([pitch(c, 1, speed, event, game=i) for i, (c, speed, event, _) in enumerate(VALUES)], PITCH)
    got = rows(pv.pitch_value(df, tendencies(spark), td.linear_weights(spark), rows_needed=1))
    got = {r["game_pk"]: r["value"] for r in got}
    for i, case in enumerate(VALUES):
        assert got[i] == pytest.approx(case[3], abs=1e-9), case


def test_harder_hitter_gives_no_bonus(spark):
    df = spark.createDataFrame([pitch("S")], PITCH)
    got = pv.pitch_value(df, tendencies(spark, own=(0.3, 0.4, 0.5)), td.linear_weights(spark), rows_needed=1).first()["value"]
    assert got == pytest.approx(0.170)


def test_unknown_batter_and_zero_rate_take_the_league_rate(spark):
    df = spark.createDataFrame([pitch("S", batter=99), pitch("C", batter=99)], PITCH)
    got = sorted(r["value"] for r in pv.pitch_value(df, tendencies(spark), td.linear_weights(spark), rows_needed=1).collect())
    assert got == pytest.approx([0.025, 0.170])


def test_season_with_few_tendencies_borrows_the_one_before(spark):
    tt = tendencies(spark, season=2023).unionByName(tendencies(spark, own=(0.1, 0.1, 0.1), season=2024))
    df = spark.createDataFrame([pitch("S", season=2024)], PITCH)
    lw = td.linear_weights(spark)
    assert pv.pitch_value(df, tt, lw, rows_needed=2).first()["value"] == pytest.approx(0.170 * 1.067)
    assert pv.pitch_value(df, tt, lw, rows_needed=1).first()["value"] == pytest.approx(0.170 * 1.167)
    assert pv.pitch_value(df, tt, lw, 1, tendency_season_offset=-1).first()["value"] == pytest.approx(0.170 * 1.067)


def test_season_without_any_tendencies(spark):
    df = spark.createDataFrame([pitch("S", season=2010), pitch("X", season=2010, speed=90.0, event="single"), pitch("B", season=2010)], PITCH)
    got = [r["value"] for r in pv.pitch_value(df, tendencies(spark), td.linear_weights(spark)).collect()]
    assert got[0] is None and got[1] == pytest.approx(-0.885) and got[2] == pytest.approx(-0.04)


def test_live_value_uses_fixed_league_and_plain_bunts(spark):
    tt = tendencies(spark, season=2022)
    df = spark.createDataFrame([pitch("S"), pitch("X", speed=0.0, event="sac_bunt"), pitch("X", speed=96.0, event="DOUBLE")], PITCH)
    got = [r["value"] for r in pv.live_pitch_value(df, tt).collect()]
    assert got == pytest.approx([0.170 * 1.067, 0.098, -1.271 * 1.095])


def test_game_rows_and_scale(spark):
    df = spark.createDataFrame(
        [pitch("B"), pitch("C", batter=9), pitch("B", name=None), pitch("B", game=2, kind="SL"), pitch("F", game=3, kind="SL")], PITCH
    )
    valued = pv.pitch_value(df, tendencies(spark), td.linear_weights(spark), rows_needed=1)
    game = rows(pv.per_game(valued), "game_pk")
    assert [g["pitches_thrown"] for g in game] == [2, 1, 1]  # the row without a name is left out
    assert game[0]["whiff_rate"] == 0.0 and game[0]["cs_rate"] == 0.5
    scored = {g["game_pk"]: g["value_plus"] for g in rows(pv.normalise(pv.per_game(valued), 0.02), "game_pk")}
    # Two rows of a type are too few: the league value is the base.
    assert scored[2] == pytest.approx(-200.0) and scored[3] == pytest.approx(100.0)
    flat = {g["game_pk"]: g["value_plus"] for g in rows(pv.normalise(pv.per_game(valued), 0.00001))}
    assert set(flat.values()) == {100.0}


def test_type_mean_normalises_to_its_sign(spark):
    df = spark.createDataFrame([pitch("B", game=i) for i in range(3)] + [pitch("C", game=i, kind="SL", batter=9) for i in range(3)], PITCH)
    valued = pv.pitch_value(df, tendencies(spark), td.linear_weights(spark), rows_needed=1)
    out = rows(pv.normalise(pv.per_game(valued), 1.0))
    assert {(r["pitch_type_code"], r["value_plus"]) for r in out} == {("FF", -100.0), ("SL", 100.0)}


def test_score_pitches_matches_brute_force(spark):
    import random

    rng = random.Random(3)
    data = [
        pitch(rng.choice(["S", "C", "B", "F", "X", "M"]), rng.randint(1, 3), rng.choice([None, 80.0, 99.0]), rng.choice(["single", "field_out", None]),
              rng.randint(1, 4), rng.choice(["FF", "SL"]), rng.randint(1, 2), 2023, rng.choice(["P", "P", None]))
        for _ in range(200)
    ]
    df = spark.createDataFrame(data, PITCH)
    tt, lw = tendencies(spark), td.linear_weights(spark)
    got = {(r["game_pk"], r["pitcher_id"], r["pitch_type_code"]): r["value_plus"] for r in pv.score_pitches(df, tt, lw, rows_needed=1).collect()}
    pdf = pv.pitch_value(df, tt, lw, rows_needed=1).toPandas()
    league = pdf["value"].mean()
    agg = pdf.dropna(subset=["pitcher_name"]).groupby(["game_pk", "pitcher_id", "pitch_type_code"])["value"].mean()
    by_type = agg.groupby("pitch_type_code").agg(["mean", "count"])
    for key, value in agg.items():
        base = by_type.loc[key[2], "mean"] if by_type.loc[key[2], "count"] >= 3 else league
        assert got[key] == pytest.approx(value / abs(base) * 100, abs=0.0501)


def test_tendency_rates_without_swings(spark):
    p = spark.createDataFrame(
        [(1, 0, 5, "FF", "B", False, None, None, 12), (1, 0, 5, "FF", "C", False, None, None, None)],
        "game_pk INT, at_bat_index INT, pitcher_id INT, pitch_type_code STRING, call_code STRING, is_in_play BOOLEAN, launch_speed DOUBLE, launch_angle DOUBLE, zone INT",
    )
    ab = spark.createDataFrame([(1, 0, 7, 3, 4)], "game_pk INT, at_bat_index INT, batter_id INT, away_score INT, home_score INT")
    g = spark.createDataFrame([(1, "R", 2024, 1, 2)], "game_pk INT, game_type STRING, season INT, away_score INT, home_score INT")
    r = td.pitch_type_tendencies(p, ab, g, min_pitches=1).first()
    assert (r["swing_rate"], r["whiff_rate"], r["chase_rate"], r["csw_rate"], r["hard_hit_rate"]) == (0.0, None, 0.0, 0.5, None)
    z = rows(td.zone_tendencies(p, ab, g, min_pitches=1))
    assert [(r["zone"], r["swing_rate"] + r["take_rate"]) for r in z] == [(12, 1.0)]


# --- racing ---------------------------------------------------------------------

SNAP = (
    "race_id INT, snapshot_at STRING, driver_id INT, driver_name STRING, car_number STRING, manufacturer STRING, lap INT, total_laps INT, "
    "position INT, laps_completed INT, laps_led INT, pit_stops INT, best_lap_speed DOUBLE, last_lap_speed DOUBLE, delta_leader DOUBLE, tire_age INT, last_pit_lap INT"
)
HIST = "race_id INT, driver_name STRING, hist_avg_finish DOUBLE, hist_avg_running DOUBLE, same_track_races BIGINT, same_type_races BIGINT"
VAR = "race_id INT, driver_name STRING, speed_stddev DOUBLE, speed_avg DOUBLE, lap_samples BIGINT"
RACE = "race_id INT, track_name STRING, track_type STRING, scheduled_laps INT, actual_laps INT"


H = (20.0, 16.0, 3, 4)


def project(spark, cases):
    """D1's projected row per case; each case is a race of its own."""
    snaps, history, races = [], [], []
    for race, c in enumerate(cases):
        lap, position, field, total = c["lap"], c.get("position", 10), c.get("field", 40), c.get("total", 150)
        snaps.append((race, "t2", 1, "D1", "1", "Ford", lap, total, position, lap, 0, 0, None, 150.0, 0.0, c.get("tire"), None))
        snaps += [(race, "t2", i, f"X{i}", str(i), "Ford", lap, total, None, lap, 0, 0, None, 150.0, 3.0, None, None) for i in range(2, field + 1)]
        snaps.append((race, "t1", 1, "D1", "1", "Ford", 1, total, 1, 1, 0, 0, None, 150.0, 0.0, None, None))
        if c.get("history", H):
            history.append((race, "D1", *c.get("history", H)))
        if c.get("meta", (200, None)):
            races.append((race, "T", "short", *c.get("meta", (200, None))))
    out = racing.live_projection(
        spark.createDataFrame(snaps, SNAP), spark.createDataFrame(history, HIST),
        spark.createDataFrame([(0, "D1", 1.5, 150.0, 20)], VAR), spark.createDataFrame(races, RACE),
    )
    return {r["race_id"]: r for r in out.filter("driver_name = 'D1'").collect()}


def test_live_projection_branches(spark):
    late = 10 * 0.575 + 20 * 0.2 + 16 * 0.15
    cases = [
        (4, None, 10 * 0.3 + 20 * 0.4 + 16 * 0.3),
        (100, None, late),
        (159, None, 10 * (0.3 + 0.55 * 0.795) + 20 * 0.4 * 0.205 + 16 * 0.3 * 0.205),
        (160, None, 10 * 0.85 + 20 * 0.08 + 16 * 0.06),
        (200, None, 10 * 0.98),
        (100, 0, late - 0.75), (100, 20, late), (100, 35, late), (100, 50, late), (100, 90, late + 1.0), (100, 300, late + 1.0),
    ]
    got = project(spark, [{"lap": lap, "tire": tire} for lap, tire, _ in cases])
    for i, case in enumerate(cases):
        assert got[i]["projected_score"] == pytest.approx(math.floor(case[2] * 10 + 0.5 + 1e-9) / 10), case


def test_live_projection_fallbacks(spark):
    got = project(spark, [
        {"lap": 100, "history": None}, {"lap": 100, "meta": None}, {"lap": 100, "meta": (0, 0), "total": 0},
        {"lap": 100, "meta": (200, 250)}, {"lap": 200, "position": None, "field": 5, "history": None},
        {"lap": 1, "tire": 0, "position": 1, "history": (1.0, 1.0, 2, 2)},
    ])
    assert got[0]["projected_score"] == pytest.approx(10 * 0.575 + 10 * 0.35, abs=0.051) and got[0]["has_history"] is False
    assert [got[i]["total_laps"] for i in (1, 2, 3)] == [150, 400, 250]
    assert got[4]["current_position"] == 5 and got[4]["projected_score"] == pytest.approx(4.9)
    assert got[5]["projected_score"] == 1.0


def test_live_projection_rank_is_whole(spark):
    snaps = [(1, "t", i, f"D{i}", str(i), "Ford", 10, 100, i, 10, 0, 0, 150.0 + i, 150.0, 1.0, None, None) for i in range(1, 31)]
    out = racing.live_projection(spark.createDataFrame(snaps, SNAP), spark.createDataFrame([], HIST), spark.createDataFrame([], VAR), spark.createDataFrame([], RACE))
    assert sorted(r["projected_finish"] for r in out.collect()) == list(range(1, 31))


def test_confidence(spark):
    base = "race_pct DOUBLE, hist_avg_finish DOUBLE, speed_stddev DOUBLE, lap_samples BIGINT, delta_leader DOUBLE"
    cases = [((50.0, 5.0, 1.0, 11, 1.0), 20 + 15 + 35 + 10), ((100.0, 5.0, 0.5, 20, 1.0), 95), ((0.0, None, 9.0, 20, None), 0),
             ((0.0, None, 5.0, 20, 5.0), 7), ((0.0, None, 1.0, 10, 4.9), 10)]
    out = racing.confidence(spark.createDataFrame([c for c, _ in cases], base)).collect()
    assert [r["confidence"] for r in out] == pytest.approx([e for _, e in cases])


def test_poll_projection_uses_half_field_without_history(spark):
    snaps = [(1, "t", i, f"D{i}", str(i), "Ford", 0, 0, None, 0, 0, 0, None, 0.0, 0.0, None, None) for i in range(1, 5)]
    hist = spark.createDataFrame([("D1", 1, 3.0, None, 80.0), ("D2", 77, 1.0, 2.0, None)], "driver_name STRING, driver_id INT, hist_avg_finish DOUBLE, hist_avg_running DOUBLE, hist_rating DOUBLE")
    out = {r["driver_name"]: r for r in racing.poll_projection(spark.createDataFrame(snaps, SNAP), hist).collect()}
    assert out["D1"]["projected_finish"] == pytest.approx(4 * 0.3 + 3 * 0.4 + 3 * 0.3)
    assert out["D2"]["projected_finish"] == pytest.approx(4 * 0.3 + 1 * 0.4 + 2 * 0.3)  # found by name
    assert out["D3"]["projected_finish"] == pytest.approx(4 * 0.3 + 2 * 0.7) and out["D3"]["hist_avg_finish"] is None


# --- matchups ---------------------------------------------------------------------

def test_grading_of_equal_projections(spark):
    graded = spark.createDataFrame(
        [(1, 1, 0.25, 0.5, 1.5, 0.5, 0.5, 1, 4), (1, 2, 0.25, 0.5, 1.5, 0.0, 1.0, 0, 4), (1, 3, 0.25, 0.5, 1.5, 1.0, 0.0, 0, 1)],
        "game_pk INT, pitcher_id INT, proj_k_pct DOUBLE, proj_tb_per_pa DOUBLE, proj_tb_game DOUBLE, actual_k_pct DOUBLE, actual_tb_per_pa DOUBLE, actual_total_bases INT, actual_pa INT",
    )
    r = matchup.grading_metrics(graded).first()
    assert (r["n"], r["mae_k"], r["pearson_k"], r["n_mid_k_proj"], r["n_high_k_proj"]) == (2, 0.25, None, 2, 0)
    assert r["brier_k"] == pytest.approx((0.375**2 + 0.625**2) / 2, abs=5e-4)
    assert r["skill_score_k"] == pytest.approx(1 - 0.0625 / ((0.273**2 + 0.227**2) / 2), abs=5e-4)


def test_marcel_hand_case(spark):
    rows_ = [(2025, "A B", 200.0, 0.30, 0.08, 3.0, 3.0, 3.0), (2024, "A B", 100.0, 0.20, 0.08, 4.0, 4.0, 4.0),
             (2025, "Z", 60.0, 0.10, 0.10, 5.0, 5.0, 5.0), (2023, "A B", 9.0, 0.9, 0.9, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows_, "season INT, player_name STRING, ip DOUBLE, k_pct DOUBLE, bb_pct DOUBLE, fip DOUBLE, era DOUBLE, siera DOUBLE")
    got = marcel.marcel(df, 2026).filter("player = 'a b'").first()
    w_ip = (200 * 5 + 100 * 4) / 9
    rel = 1 - 200 / (w_ip + 200)
    k = (0.30 * 5 * 200 + 0.20 * 4 * 100) / (5 * 200 + 4 * 100)
    assert got["reliability"] == pytest.approx(rel, abs=6e-4)
    assert got["proj_k_pct"] == pytest.approx((rel * k + (1 - rel) * 0.20) * 100, abs=0.051)


# --- helpers ------------------------------------------------------------------------

def test_durations_and_casts(spark):
    texts = ["1:23:06.801", "1:22.670", "23.456", "", "DNF", None, "82.670", "1:xx", "1:2:3:4"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t STRING").select(s.duration_ms("t")).collect()]
    assert got == [4986801, 82670, 23456, None, None, None, 82670, None, 1000]
    values = [("7", 7, 7.0), ("7.5", None, 7.5), ("nan", None, None), ("", None, None), ("x", None, None), (" 8 ", 8, 8.0)]
    out = spark.createDataFrame([(v[0],) for v in values], "t STRING").select(s.safe_int("t").alias("i"), s.safe_float("t").alias("f")).collect()
    assert [(r["i"], r["f"]) for r in out] == [v[1:] for v in values]


def test_half_up_ties(spark):
    got = spark.range(1).select(*[s.half_up(F.lit(v), d) for v, d in ((101.14999999999999, 1), (2.675, 2), (-0.125, 2), (0.5, 0))]).first()
    assert list(got) == [101.2, 2.68, -0.13, 1.0]


def test_unaccented_match(spark):
    df = spark.createDataFrame([("José Núñez",), ("Joe",), (None,)], "n STRING")
    assert [r[0] for r in df.filter(s.match_unaccented("n", "nunez")).collect()] == ["José Núñez"]


def test_rank_in_slices_equals_plain_rank(spark):
    import random

    rng = random.Random(1)
    data = [(rng.choice("aaab"), round(rng.random() * 5, 1), i) for i in range(500)]
    df = spark.createDataFrame(data, "g STRING, v DOUBLE, id INT")
    got = {r["id"]: r["rank"] for r in groups.rank_in_group(df, "g", [F.col("v"), F.col("id")]).collect()}
    for g in "ab":
        for place, (_, _, i) in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: (d[1], d[2])), 1):
            assert got[i] == place


@pytest.mark.parametrize("partitions", ["8", "200"])
def test_rank_in_slices_of_many_rows_with_payload(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        hot = F.when(F.col("id") % 3 > 0, 0).otherwise(F.xxhash64("id") % 50)  # two thirds in one group
        df = spark.range(400_000).select(
            hot.alias("g"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).alias("v"), "id", F.sha2(F.col("id").cast("string"), 256).alias("payload")
        )
        order = [F.col("v").desc(), F.col("id")]
        got = groups.rank_in_group(df, "g", order)
        want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy(*order))).select("id", "want")
        both = got.join(want, "id", "full")
        assert both.where("rank is null or want is null or rank != want").count() == 0
        assert got.count() == 400_000 and got.where(F.sha2(F.col("id").cast("string"), 256) != F.col("payload")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_group_helpers_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 4.0)], "g STRING, v DOUBLE")
    out = rows(groups.attach_group_stats(df, "g", "v"), "g", "v")
    assert [(r["group_mean"], r["group_count"]) for r in out] == [(2.0, 2), (2.0, 2), (4.0, 1)]
    assert {r["share"] for r in rows(groups.share(df, (), "v"))} == {0.125, 0.375, 0.5}


def test_game_log_side_and_search(spark):
    sc = spark.createDataFrame([(1, "2024-04-01", 2024, "R", 5, "FF", 10, 100.0, 95.0, 0.1, 0.2, 0.3, 2200.0, 1.0, 2.0), (1, "2024-04-01", 2024, "R", 5, "SL", 20, 110.0, 85.0, 0.1, 0.2, 0.3, 2200.0, 1.0, 2.0)],
        "game_pk INT, game_date STRING, season INT, game_type STRING, pitcher_id INT, pitch_type_code STRING, pitches_thrown BIGINT, value_plus DOUBLE, avg_velo DOUBLE, whiff_rate DOUBLE, csw_rate DOUBLE, hard_hit_rate DOUBLE, avg_spin DOUBLE, avg_hmov DOUBLE, avg_ivb DOUBLE")
    g = spark.createDataFrame([(1, "HOM", "AWY")], "game_pk INT, home_team_abbrev STRING, away_team_abbrev STRING")
    for half, home, opponent in (("top", True, "AWY"), ("bottom", False, "HOM")):
        ab = spark.createDataFrame([(1, 5, half)], "game_pk INT, pitcher_id INT, half_inning STRING")
        r = serve.game_log(sc, g, ab).first()
        assert (r["is_home"], r["opponent"], r["avg_value_plus"], [p["pitch_type_code"] for p in r["pitches"]]) == (home, opponent, 105.0, ["SL", "FF"])


def test_linear_weights_default(spark):
    got = {r["season"]: r["weight_hr"] for r in td.linear_weights(spark, [2023, 1999]).collect()}
    assert got == {2023: 2.101, 1999: codes.LINEAR_WEIGHTS[2024][6]}


def test_a_hot_batter_and_game_keep_every_row(spark):
    """A third of all pitches fall to one at-bat of one game."""
    n = 3000
    p = spark.range(n).selectExpr(
        "CAST(IF(id % 3 = 0, 0, id % 50) AS INT) AS game_pk", "CAST(IF(id % 3 = 0, 0, id % 4) AS INT) AS at_bat_index", "1 AS pitcher_id", "'FF' AS pitch_type_code",
        "IF(id % 2 = 0, 'S', 'X') AS call_code", "id % 2 = 1 AS is_in_play", "100D AS launch_speed", "28D AS launch_angle", "CAST(id % 14 + 1 AS INT) AS zone",
    )
    ab = spark.range(200).selectExpr("CAST(id % 50 AS INT) AS game_pk", "CAST(floor(id / 50) AS INT) AS at_bat_index", "CAST(IF(id = 0, 0, 1 + id % 3) AS INT) AS batter_id")
    g = spark.range(50).selectExpr("CAST(id AS INT) AS game_pk", "'R' AS game_type", "2024 AS season")
    got = {r["batter_id"]: r["pitches_faced"] for r in td.pitch_type_tendencies(p, ab, g, min_pitches=1).collect()}
    pdf = p.toPandas().merge(ab.toPandas(), on=["game_pk", "at_bat_index"])
    assert got == pdf.groupby("batter_id").size().to_dict() and sum(got.values()) == n
    zones = td.zone_tendencies(p, ab, g, min_pitches=1).groupBy().sum("pitches_faced").first()[0]
    assert zones == n

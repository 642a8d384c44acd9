"""Keyed writes, quality checks, the regression and validation."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from diamondlap.operators import quality as q, stuff, validation
from diamondlap.plans.tables import Tables
from diamondlap.sources import sinks, staging

ROW = "season INT, game_pk INT, v STRING"


def test_replace_scope_keeps_the_rest(spark, tmp_path):
    path = str(tmp_path / "t")
    put = lambda data: sinks.replace_scope(spark.createDataFrame(data, ROW), path, ["season"], ["season", "game_pk"])
    stored = lambda: sorted((r["season"], r["game_pk"], r["v"]) for r in spark.read.parquet(path).collect())
    put([(2023, 1, "a"), (2023, 2, "a"), (2024, 3, "a")])
    put([(2023, 2, "b"), (2023, 2, "c"), (2023, 4, "b")])
    assert stored() == [(2023, 1, "a"), (2023, 2, "b"), (2023, 2, "c"), (2023, 4, "b"), (2024, 3, "a")]
    put([(2023, 2, "b"), (2023, 2, "c"), (2023, 4, "b")])
    assert len(stored()) == 5


def test_upsert_insert_and_update(spark):
    df = lambda data: spark.createDataFrame(data, "k INT, v INT")
    old, new = df([(1, 10), (2, 20)]), df([(2, 21), (2, 22), (3, 30)])
    key = lambda d: sorted((r["k"], r["v"]) for r in d.collect())
    assert key(sinks.upsert(new, old, ["k"], [F.col("v").desc()])) == [(1, 10), (2, 22), (3, 30)]
    assert key(sinks.insert_new(new, old, ["k"], [F.col("v")])) == [(1, 10), (2, 20), (3, 30)]
    once = sinks.insert_new(new, old, ["k"], [F.col("v")])
    assert key(sinks.insert_new(new, once, ["k"], [F.col("v")])) == key(once)
    out = sinks.update_from(old, spark.createDataFrame([(2, None), (9, 1)], "k INT, v INT"), ["k"], ["v"])
    assert sorted((r["k"], r["v"], r["updated"]) for r in out.collect()) == [(1, 10, False), (2, None, True)]


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows_ = spark.range(1000).selectExpr("CAST(id % 50 AS INT) AS game_pk", "CAST(id % 7 AS INT) AS at_bat_index", "id AS x")
        for name in ("b_pitches", "b_at_bats"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            sinks.write_bucketed(rows_.withColumnRenamed("x", name), name, ["game_pk", "at_bat_index"], 4)
        joined = spark.table("b_pitches").join(spark.table("b_at_bats"), ["game_pk", "at_bat_index"])
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in ("b_pitches", "b_at_bats"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_work_folder_follows_the_session(spark):
    assert staging.work_dir(spark).startswith("/tmp")
    assert staging.stage(spark.range(3), "x").count() == 3

    def session(master, shared=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: shared if key == "spark.checkpoint.dir" else default),
            sparkContext=SimpleNamespace(master=master, applicationId="a"),
        )

    assert staging.work_dir(session("spark://host", "s3://shared/x/")) == "s3://shared/x"
    with pytest.raises(ValueError):
        staging.work_dir(session("spark://host"))


GAME = "game_pk INT, game_date STRING, game_type STRING, season INT, status STRING, away_team_abbrev STRING, home_team_abbrev STRING"


def test_quality_levels(spark):
    day = lambda d, n, status="Final", start=0: [(start + i, d, "R", 2024, status, "A", "H") for i in range(n)]
    games = spark.createDataFrame(day("d1", 20) + day("d2", 19, start=100) + day("d3", 10, start=200) + [(300, "d4", "R", 2024, "Live", "A", "H")] * 2, GAME)
    due = spark.createDataFrame([("d1",)] * 20 + [("d2",)] * 20 + [("d3",)] * 20 + [("d5",)], "game_date STRING")
    level = lambda df: {r["scope"]: r["level"] for r in df.collect()}
    assert level(q.check_coverage(games, due)) == {"d1": 0, "d2": 1, "d3": 2, "d4": 1, "d5": 2}
    assert level(q.check_duplicates(games)) == {"d1": 0, "d2": 0, "d3": 0, "d4": 2}
    assert level(q.check_status(games))["d4"] == 1
    one = games.filter("game_pk IN (0, 100, 200)")
    ab = spark.createDataFrame([(0,)] * 30 + [(100,)] * 24 + [(200,)] * 46, "game_pk INT")
    assert level(q.check_rows_per_game(ab, one)) == {"d1": 0, "d2": 2, "d3": 1}
    p = spark.createDataFrame([(0, 1, 1.0, 1.0)] * 200 + [(100, None, None, 1.0)] * 199, "game_pk INT, spin_rate INT, launch_speed DOUBLE, px DOUBLE")
    assert level(q.check_pitch_counts(one, p)) == {"d1": 0, "d2": 2, "d3": 2}
    assert level(q.check_column_coverage(one, p)) == {"d1": 0, "d2": 1}
    assert level(q.check_children(one, ab.filter("game_pk = 0"))) == {"d1": 0, "d2": 1, "d3": 1}
    verdict = {r["scope"]: r["verdict"] for r in q.verdict([q.check_coverage(games, due), q.check_status(games)]).collect()}
    assert verdict == {"d1": "passed", "d2": "passed with warnings", "d3": "failed", "d4": "passed with warnings", "d5": "failed"}


def test_season_totals_levels(spark):
    games = spark.createDataFrame([(s, "d", "R", s, "Final", "A", "H") for s in (1, 2, 3, 4)], GAME)
    ab = spark.createDataFrame([(s,) for s in (1, 2, 3, 4) for _ in range(100)], "game_pk INT")
    listed = spark.createDataFrame([(1, 100), (2, 101), (3, 50), (4, 49)], "season INT, pa INT")
    assert {r["scope"]: r["level"] for r in q.check_totals(listed, ab, games).collect()} == {"1": 0, "2": 2, "3": 1, "4": 2}
    assert {r["level"] for r in q.check_totals(listed.filter("season > 9"), ab, games).collect()} == {1}


def ridge(x, y, alpha=5.0):
    """Standardise with population deviation, then ridge with free intercept."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd == 0, 1, sd)
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda a: y.mean() + ((a - mean) / sd) @ w


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


@pytest.fixture(scope="module")
def feature_rows(spark):
    rng = np.random.default_rng(5)
    data = []
    for kind, n in (("FF", 43), ("SL", 37), ("CU", 12)):
        for season in (2022, 2023, 2024):
            for pid in range(n):
                if rng.random() < 0.15:
                    continue
                x = rng.normal(size=6)
                y = 0.3 + 0.02 * x[0] - 0.01 * x[3] + 0.02 * rng.normal()
                data.append((pid, kind, season, 100, *map(float, x), float(y), 95.0, 2200.0, 1.0, 2.0, 0.25))
    schema = "pitcher_id INT, pitch_type_code STRING, season INT, pitches BIGINT, " + ", ".join(f"{c} DOUBLE" for c in stuff.FEATURES) + ", csw_rate DOUBLE, avg_velo DOUBLE, avg_spin DOUBLE, avg_hmov DOUBLE, avg_vmov DOUBLE, whiff_rate DOUBLE"
    df = spark.createDataFrame(data, schema)
    return df, df.toPandas().sort_values(["pitch_type_code", "season", "pitcher_id"]).reset_index(drop=True)


def test_ridge_equals_dense_solution(feature_rows):
    df, pdf = feature_rows
    model = stuff.fit_ridge(df, min_rows=40)
    got = {r["pitch_type_code"]: r for r in model.collect()}
    assert set(got) == {"FF", "SL"}
    cols = list(stuff.FEATURES)
    scored = {(r["pitcher_id"], r["pitch_type"], r["season"]): r for r in stuff.score_ridge(df, model).collect()}
    for kind, g in pdf[pdf.pitch_type_code != "CU"].groupby("pitch_type_code"):
        x, y = g[cols].to_numpy(), g["csw_rate"].to_numpy()
        p = ridge(x, y)(x)
        assert got[kind]["train_r2"] == pytest.approx(r2(y, p), abs=1e-9)
        for (_, row), expect in zip(g.iterrows(), p):
            s = scored[(row.pitcher_id, kind, row.season)]
            assert s["predicted_csw"] == pytest.approx(expect, abs=1e-9)
            assert s["stuff_plus"] == pytest.approx(expect / y.mean() * 100, abs=0.0501)


def test_folds_and_seasons_equal_brute_force(feature_rows):
    df, pdf = feature_rows
    cols = list(stuff.FEATURES)
    folds = {(r["pitch_type_code"], r["part"]): r["r2"] for r in stuff.ridge_r2(df, "folds", min_rows=40).collect()}
    seasons = {(r["pitch_type_code"], r["part"]): r["r2"] for r in stuff.ridge_r2(df, "seasons", min_rows=40).collect()}
    expect_folds, expect_seasons = {}, {}
    for kind, g in pdf[pdf.pitch_type_code != "CU"].groupby("pitch_type_code"):
        x, y = g[cols].to_numpy(), g["csw_rate"].to_numpy()
        for i, held in enumerate(np.array_split(np.arange(len(g)), 5)):
            rest = np.setdiff1d(np.arange(len(g)), held)
            expect_folds[(kind, f"fold {i}")] = r2(y[held], ridge(x[rest], y[rest])(x[held]))
        for a in (2022, 2023):
            one, two = (g[g.season == s].set_index("pitcher_id") for s in (a, a + 1))
            both = one.index.intersection(two.index)
            if len(both) >= 20:
                m = ridge(one.loc[both, cols].to_numpy(), one.loc[both, "csw_rate"].to_numpy())
                expect_seasons[(kind, f"{a} to {a + 1}")] = r2(two.loc[both, "csw_rate"].to_numpy(), m(two.loc[both, cols].to_numpy()))
    assert folds == pytest.approx(expect_folds, abs=1e-8)
    assert seasons == pytest.approx(expect_seasons, abs=1e-8)
    best = stuff.evaluate(df, stuff.fit_ridge(df, min_rows=40), min_rows=40).filter("pitch_type_code = 'FF'").first()
    assert best["cv_r2"] == pytest.approx(np.mean([v for (k, _), v in expect_folds.items() if k == "FF"]), abs=1e-8)


def test_validation_lag(spark):
    metric = spark.createDataFrame([(p, 2024, 600, float(p)) for p in range(5)] + [(9, 2024, 10, 1.0)], "pitcher_id INT, season INT, pitches INT, m DOUBLE")
    outcome = spark.createDataFrame([(p, s, 60.0, -2.0 * p + s, 1.0) for p in range(5) for s in (2024, 2025)], "pitcher_id INT, season INT, ip DOUBLE, fip DOUBLE, flat DOUBLE")
    got = {r["outcome"]: (r["pearson"], r["n"]) for r in validation.validation_corr(metric, outcome, ["m"], ["fip", "flat"], lag=1, min_pitches=500, min_ip=50).collect()}
    assert got == {"fip": (-1.0, 5), "flat": (None, 5)}


def test_plans_push_filters_and_prune_columns(spark, sf_dir):
    from diamondlap.operators import serve

    t = Tables(spark, sf_dir)
    plan = q.pitch_counts(t.games.filter("status = 'Final'"), t.pitches)._jdf.queryExecution().executedPlan().toString()
    scans = [l for l in plan.splitlines() if "FileScan" in l]
    assert any("ReadSchema: struct<l_orderkey:bigint>" in l for l in scans), scans
    top = serve.leaderboard(t.scores, min_pitches=1, k=5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in top

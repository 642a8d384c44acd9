"""Live jobs on staged files: restart, no copies, end of race, score once."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import rows
from diamondlap.operators import pitch_value as pv, tendencies as td
from diamondlap.plans import jobs
from diamondlap.streaming import feeds as fd, games as live, race, status

HISTORY = "driver_name STRING, driver_id INT, hist_avg_finish DOUBLE, hist_avg_running DOUBLE, hist_rating DOUBLE"


def feed(lap, flag=1):
    cars = [{"vehicle_number": str(i), "running_position": i, "best_lap_speed": 150.0 + i, "driver": {"driver_id": i, "full_name": f"D{i}"}, "pit_stops": []} for i in (1, 2, 3)]
    return json.dumps({"lap_number": lap, "number_of_race_laps": 200, "flag_state": flag, "vehicles": cars})


def test_race_stream_restarts_and_stops(spark, tmp_path):
    folder = tmp_path / "in" / "season=2026" / "series_id=1" / "race_id=77"
    folder.mkdir(parents=True)
    out, src = str(tmp_path / "out"), str(tmp_path / "in")
    history = spark.createDataFrame([("D1", 1, 5.0, 6.0, 90.0)], HISTORY)
    (folder / "a.json").write_text(feed(0))
    first = race.RaceStream(race.race_feeds(spark, src), out, history)
    first.run()
    assert race.unfinished(spark, out).count() == 1
    (folder / "b.json").write_text(feed(160))
    (folder / "c.json").write_text(feed(200, flag=4))
    second = race.RaceStream(race.race_feeds(spark, src), out, history, every="1 second")
    second.run(check_seconds=1)
    assert race.unfinished(spark, out).isEmpty() and not second.query.isActive
    snaps = spark.read.parquet(f"{out}/live_snapshots")
    assert sorted((r["lap"], r["n"]) for r in snaps.groupBy("lap").agg(F.count("*").alias("n")).collect()) == [(0, 3), (160, 3), (200, 3)]
    assert {r["race_id"] for r in snaps.collect()} == {77}
    assert {(r["lap"], r["flag"]) for r in spark.read.parquet(f"{out}/flags").collect()} == {(0, "green"), (160, "green"), (200, "checkered")}
    assert spark.read.parquet(f"{out}/poll_projections").count() == 9


def game(pk, state, calls, order=(21, 22), season="2024"):
    plays = [{
        "about": {"atBatIndex": i, "halfInning": "top"}, "result": {"eventType": "single" if c == "X" else "strikeout"},
        "matchup": {"batter": {"id": 20 + i % 3, "fullName": f"B{20 + i % 3}"}, "pitcher": {"id": 9, "fullName": "Nine"}, "batSide": {"code": "L"}, "pitchHand": {"code": "R"}},
        "playEvents": [{"isPitch": True, "details": {"code": c, "isInPlay": c == "X", "type": {"code": "FF"}}, "pitchData": {"startSpeed": 95.0}, "hitData": {"launchSpeed": 99.0} if c == "X" else {}}],
    } for i, c in enumerate(calls)]
    side = {"team": {"id": 1}, "battingOrder": list(order), "pitchers": [], "players": {f"ID{i}": {"person": {"id": i, "fullName": f"B{i}"}} for i in order}}
    doc = {
        "gamePk": pk,
        "gameData": {"game": {"type": "R", "season": season}, "datetime": {"originalDate": f"{season}-05-01"}, "status": {"detailedState": state},
                     "teams": {"away": {"abbreviation": "AAA"}, "home": {"abbreviation": "HHH"}}},
        "liveData": {"plays": {"allPlays": plays}, "boxscore": {"teams": {"away": side, "home": {"team": {"id": 2}, "pitchers": [9], "players": {}}}}},
    }
    return json.dumps(doc)


@pytest.fixture(scope="module")
def reference(spark):
    tt = spark.createDataFrame([(20, "FF", 2023, 50, 0.2, 0.3, 0.4, 0.1, 0.38, 0.7, 88.0, 10.0), (21, "FF", 2023, 50, 0.3, 0.2, 0.3, 0.1, 0.38, 0.7, 88.0, 10.0)],
        "batter_id INT, pitch_type_code STRING, season INT, pitches_faced BIGINT, whiff_rate DOUBLE, chase_rate DOUBLE, hard_hit_rate DOUBLE, barrel_rate DOUBLE, avg_woba_on_contact DOUBLE, contact_rate DOUBLE, avg_exit_velo DOUBLE, avg_launch_angle DOUBLE")
    sc = spark.createDataFrame([(i, "2023-05-01", 2023, "R", 9, "Nine", "FF", 60, 0.05, 110.0, 95.0, 0.2, 0.3, 0.35) for i in (1, 2)],
        "game_pk INT, game_date STRING, season INT, game_type STRING, pitcher_id INT, pitcher_name STRING, pitch_type_code STRING, pitches_thrown BIGINT, avg_value DOUBLE, value_plus DOUBLE, avg_velo DOUBLE, whiff_rate DOUBLE, csw_rate DOUBLE, hard_hit_rate DOUBLE")
    return live.Reference(tt, td.linear_weights(spark), sc)


def test_game_stream_scores_once_and_keeps_first_projection(spark, tmp_path, reference):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "game_pk INT, data STRING, fetched_at STRING"

    def arrive(*docs):
        rows_ = spark.createDataFrame(list(docs), schema).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
        rows_.write.mode("append").parquet(src)
        stream = fd.table_stream(spark, src, rows_.schema)
        live.game_stream(stream, out, reference).awaitTermination()

    arrive((1, game(1, "In Progress", "SC"), "2024-05-01 20:00:00"), (2, game(2, "Final", "SX", order=()), "2024-05-01 20:00:00"))
    arrive((1, game(1, "Final", "SCXB", order=(21, 22, 20)), "2024-05-01 22:00:00"), (2, game(2, "Final", "SSSS"), "2024-05-01 22:00:00"))
    arrive((1, game(1, "Final", "S"), "2024-05-02 22:00:00"))

    report = {(r["game_pk"], r["epoch"]): (r["action"], r["status_changed"]) for r in spark.read.parquet(f"{out}/report").collect()}
    assert report == {(1, 0): ("inserted", True), (2, 0): ("inserted", True), (1, 1): ("updated", True), (2, 1): ("skipped", False), (1, 2): ("skipped", False)}
    pitches = spark.read.parquet(f"{out}/pitches")
    assert {r["game_pk"]: r["count"] for r in pitches.groupBy("game_pk").count().collect()} == {1: 4, 2: 2}
    scores = rows(spark.read.parquet(f"{out}/scores"), "game_pk")
    assert [(s["game_pk"], s["epoch"], s["pitches_thrown"]) for s in scores] == [(1, 1, 4), (2, 0, 2)]
    # The prior season's mean value, 0.05, is the base of a single game's few rows.
    whiff = 0.170 * (1 + 0.25 - 0.20)
    single = -0.888 * (1 + 0.35 - 0.30)
    assert scores[1]["avg_value"] == pytest.approx((whiff + single) / 2, abs=1e-9)
    assert scores[1]["value_plus"] == pytest.approx((whiff + single) / 2 / 0.05 * 100, abs=0.051)
    projections = spark.read.parquet(f"{out}/matchup_projections")
    assert sorted((r["game_pk"], r["batter_id"], r["batting_order"], r["epoch"]) for r in projections.collect()) == [(1, 21, 1, 0), (1, 22, 2, 0)]


def test_repeated_batch_finishes_what_a_lost_one_began(spark, tmp_path, reference):
    """The driver dies after the documents were stored but before flattening."""
    out = str(tmp_path / "out")
    batch = spark.createDataFrame([(1, game(1, "Final", "SX"), "2024-05-01 20:00:00")], "game_pk INT, data STRING, fetched_at STRING")
    batch = batch.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    live.store_games(batch, 0, out)
    for _ in range(2):
        live.game_batch(batch, 0, out, reference)
    assert spark.read.parquet(f"{out}/pitches").count() == 2
    assert spark.read.parquet(f"{out}/scores").count() == 1
    assert [r["action"] for r in spark.read.parquet(f"{out}/report").collect()] == ["inserted"]


def test_games_without_rows_lose_their_stored_ones_and_other_days_stay(spark, tmp_path):
    out = str(tmp_path / "out")
    taken = lambda *docs: spark.createDataFrame(
        [(pk, day, "Final", "A", "H", game(pk, "Final", calls).replace("2024-05-01", day), None) for pk, day, calls in docs], live.RAW_SCHEMA)
    live.flatten_games(taken((7, "2024-05-01", "SX"), (8, "2024-05-01", "S"), (9, "2024-05-02", "SSS"), (10, "2024-05-03", "X")), out)
    files = lambda day: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "out").glob(f"*/part={day}/*.parquet")}
    before = files("2024-05-02")
    live.flatten_games(taken((7, "2024-05-01", ""), (10, "2024-05-03", "")), out)
    count = lambda table: {r["game_pk"]: r["count"] for r in spark.read.parquet(f"{out}/{table}").groupBy("game_pk").count().collect()}
    assert count("pitches") == {8: 1, 9: 3} and count("at_bats") == {8: 1, 9: 3}
    assert count("games") == {7: 1, 8: 1, 9: 1, 10: 1}
    assert files("2024-05-02") == before and before
    live.flatten_games(taken((9, "2024-05-04", "SS")), out)  # moved to another day
    assert count("pitches") == {8: 1, 9: 2} and not spark.read.parquet(f"{out}/games").filter("game_pk = 9 and part = '2024-05-02'").count()


def test_season_tables_and_grading(spark, tmp_path):
    house = str(tmp_path / "house")
    put = lambda rows_: jobs.season_tables(spark, house, batting=spark.createDataFrame(rows_, "season INT, mlbam_id INT, pa INT"))
    put([(2023, 1, 10), (2024, 1, 20)])
    put([(2024, 2, 30)])
    assert sorted((r["season"], r["mlbam_id"]) for r in spark.read.parquet(f"{house}/season_batting").collect()) == [(2023, 1), (2024, 2)]
    stored = str(tmp_path / "projections")
    spark.createDataFrame([(1, 5, 0.3), (2, 5, 0.2)], "game_pk INT, batter_id INT, projected DOUBLE").write.parquet(stored)
    actuals = spark.createDataFrame([(1, 5, 2)], "game_pk INT, batter_id INT, actual_strikeouts INT")
    jobs.grade_projections(spark, house, stored, actuals, ["game_pk", "batter_id"])
    graded = spark.read.parquet(f"{house}/graded_projections").collect()
    assert sorted((r["game_pk"], r["actual_strikeouts"], r["updated"]) for r in graded) == [(1, 2, True), (2, None, False)]


def test_coverage_against_the_schedule(spark, tmp_path):
    landing, schedule, house = tmp_path / "landing", tmp_path / "schedule", str(tmp_path / "house")
    landing.mkdir()
    schedule.mkdir()
    (landing / "1.json").write_text(game(1, "Final", "SCXBSC"))
    due = [{"gamePk": pk, "status": {"detailedState": "Final"}} for pk in (1, 2, 3)]
    (schedule / "s.json").write_text(json.dumps({"dates": [{"date": "2024-05-01", "games": due}, {"date": "2024-05-09", "games": [{"gamePk": 4, "status": {"detailedState": "Final"}}]}]}))
    verdict = {r["scope"]: r["verdict"] for r in jobs.mlb_daily(spark, str(landing), house, schedule_dir=str(schedule)).collect()}
    assert verdict == {"2024-05-01": "failed", "2024-05-09": "failed"}


def test_batch_jobs(spark, tmp_path):
    landing, house = tmp_path / "landing", str(tmp_path / "house")
    landing.mkdir()
    for pk, calls in ((1, "SCXBSC"), (2, "XXSSB"), (3, "CCBB")):
        (landing / f"{pk}.json").write_text(game(pk, "Final", calls))
    (landing / "bad.json").write_text("{oops")
    verdict = rows(jobs.mlb_daily(spark, str(landing), house))
    assert [(v["scope"], v["verdict"]) for v in verdict] == [("2024-05-01", "failed")]
    assert spark.read.parquet(f"{house}/games").count() == 3
    jobs.build_tendencies(spark, house, min_type=1, min_zone=1)
    jobs.score_range(spark, house, season=2024)
    scores = rows(spark.read.parquet(f"{house}/pitch_quality_scores"), "game_pk")
    # No season has enough tendencies, so only calls that need none have a value.
    assert [s["pitches_thrown"] for s in scores] == [1, 1, 2]
    jobs.score_range(spark, house, game_pk=2)
    again = rows(spark.read.parquet(f"{house}/pitch_quality_scores"), "game_pk")
    assert [s["game_pk"] for s in again] == [1, 2, 3] and again[0]["value_plus"] == scores[0]["value_plus"]


def test_weekend_jobs(spark, tmp_path):
    house = str(tmp_path / "house")
    base = tmp_path / "n"
    for kind, doc in (("weekend_feed", {"weekend_race": [{"race_name": "R", "results": [{"driver_id": 1}]}]}), ("pit_stops", [{"vehicle_number": "1"}])):
        d = base / "season=2024" / "series_id=1" / "race_id=5" / f"endpoint_type={kind}"
        d.mkdir(parents=True)
        (d / "x.json").write_text(json.dumps(doc))
    for _ in range(2):
        report = jobs.nascar_weekend(spark, str(base), house)
    assert {r["action"] for r in report.collect()} == {"updated"}
    assert [spark.read.parquet(f"{house}/nascar/{t}").count() for t in ("raw", "races", "results", "pit_stops")] == [2, 1, 1, 1]
    f1 = tmp_path / "f"
    d = f1 / "season=2024" / "round=3" / "source=jolpica" / "event_type=results"
    d.mkdir(parents=True)
    (d / "x.json").write_text(json.dumps({"results": [{"Driver": {"driverId": "a"}, "Constructor": {"constructorId": "c"}, "position": "1"}]}))
    for _ in range(2):
        jobs.f1_weekend(spark, str(f1), house)
    assert [spark.read.parquet(f"{house}/f1/{t}").count() for t in ("races", "results", "drivers", "constructors")] == [1, 1, 1, 1]


def test_a_poll_reads_and_writes_the_day_of_its_game_only(spark, tmp_path):
    """All files of the other days are spoilt, so reading one of them would fail."""
    out = str(tmp_path / "out")

    def poll(epoch, *docs):
        batch = spark.createDataFrame([(pk, game(pk, state, calls).replace("2024-05-01", day)) for pk, day, state, calls in docs], "game_pk INT, data STRING")
        live.game_batch(batch.withColumn("fetched_at", F.lit(f"2024-05-0{epoch + 1} 20:00:00").cast("timestamp")), epoch, out, None)

    poll(0, (1, "2024-05-01", "In Progress", "S"), (2, "2024-05-02", "In Progress", "SS"), (3, "2024-05-03", "Final", "SSS"))
    for path in (tmp_path / "out").glob("*/part=2024-05-0[13]/*.parquet"):
        path.write_bytes(b"spoilt")
    poll(1, (2, "2024-05-02", "Final", "SSSS"))
    pitches = spark.read.parquet(f"{out}/pitches/part=2024-05-02")
    assert {r["game_pk"] for r in pitches.collect()} == {2} and pitches.count() == 4
    poll(2, (2, "2024-05-02", "Final", "S"), (3, "2024-05-03", "Final", "S"))  # final ones are known from the index alone
    report = {r["game_pk"]: r["action"] for r in spark.read.parquet(f"{out}/report/epoch=2").collect()}
    assert report == {2: "skipped", 3: "skipped"}


def test_status_state_outlives_a_restart_and_goes_after_the_game(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def poll(keep, *docs):
        rows_ = spark.createDataFrame([(pk, game(pk, state, "")) for pk, state in docs], "game_pk INT, data STRING").withColumn("fetched_at", F.current_timestamp())
        rows_.write.mode("append").parquet(src)
        status.watch_status(fd.table_stream(spark, src, rows_.schema), out, keep).awaitTermination()

    poll(3600, (1, "In Progress"), (2, "Preview"))
    poll(0, (1, "Final"), (2, "Preview"))
    seen = spark.read.option("basePath", f"{out}/status").parquet(f"{out}/status")
    got = {(r["game_pk"], r["epoch"]): (r["action"], r["before"], r["status_changed"]) for r in seen.collect()}
    assert got == {(1, 0): ("inserted", None, True), (2, 0): ("inserted", None, True), (1, 1): ("updated", "In Progress", True), (2, 1): ("updated", "Preview", False)}
    poll(0, (2, "In Progress"))  # the timer of game 1 runs out with this batch
    poll(0, (1, "Final"))
    last = spark.read.parquet(f"{out}/status/epoch=3").collect()
    assert [(r["game_pk"], r["action"]) for r in last] == [(1, "inserted")]

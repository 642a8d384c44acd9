"""Documents with the oddities feeds have."""

import json

from helpers import rows
from diamondlap.operators import flatten_f1 as f1, flatten_mlb as mlb, flatten_nascar as nascar, matchup
from diamondlap.sources import landing, season_stats


def game(pk, doc):
    return (pk, "2024-04-01", doc if isinstance(doc, str) else json.dumps(doc))


def raw_games(spark, *docs):
    return spark.createDataFrame([game(i, d) for i, d in enumerate(docs)], "game_pk INT, game_date STRING, data STRING")


FULL = {
    "gameData": {
        "game": {"type": "R", "season": "2024", "gameNumber": 1}, "status": {"detailedState": "Final"},
        "teams": {"away": {"id": 1, "abbreviation": "AAA"}, "home": {"id": 2, "abbreviation": "HHH"}},
        "weather": {"temp": "", "condition": "Dome"},
    },
    "liveData": {
        "linescore": {"currentInning": 9, "innings": [{"num": 1, "away": {"runs": 2, "hits": 1}, "home": {"runs": 0}}, {"num": 9, "away": {"runs": 1}, "home": {}}]},
        "plays": {"allPlays": [
            {"about": {"atBatIndex": 0, "halfInning": "top"}, "matchup": {"batter": {"id": 7, "fullName": "Bat"}, "pitcher": {"id": 8}},
             "result": {"eventType": "single"},
             "playEvents": [
                 {"isPitch": True, "details": {"code": "B", "type": {"code": "FF"}}, "pitchData": {"startSpeed": 95, "breaks": {"spinRate": 2200}}},
                 {"isPitch": False, "details": {"description": "pickoff"}},
                 {"isPitch": True, "details": {"code": "X", "isInPlay": True, "type": {"code": "SL"}}, "hitData": {"launchSpeed": 101.5, "coordinates": {"coordX": 1.0}}}],
             "runners": [{"movement": {"start": None, "end": "1B"}, "details": {"runner": {"id": 7}, "responsiblePitcher": None}},
                         {"movement": {"end": "2B", "isOut": True}, "details": {"runner": {"id": 9}, "responsiblePitcher": {"id": 8}},
                          "credits": [{"player": {"id": 4}, "position": {"code": "6"}, "credit": "f_assist"}]}]},
            {"about": {"atBatIndex": 1}},
        ]},
        "boxscore": {"teams": {"away": {
            "team": {"id": 1}, "battingOrder": [7, 8, 99], "pitchers": [8],
            "players": {
                "ID7": {"person": {"id": 7, "fullName": "Bat"}, "battingOrder": "301", "batSide": {"code": "L"},
                        "stats": {"batting": {"atBats": 3, "avg": ".---", "hits": "1"}, "pitching": {}, "fielding": {"putOuts": 2, "fielding": "1.000"}}},
                "ID8": {"person": {"id": 8}, "stats": {"batting": {}, "pitching": {"inningsPitched": "5.2", "era": "3.10"}}},
                "IDx": {"person": {}, "stats": {"batting": {"atBats": 1}}},
            }}, "home": {"pitchers": [55]}}},
    },
}


def test_game_tables(spark):
    raw = raw_games(spark, FULL, {}, "{not json")
    t = mlb.flatten_mlb(raw)
    head = rows(t["games"], "game_pk")
    assert [h["game_pk"] for h in head] == [0, 1]
    assert (head[0]["season"], head[0]["weather_temp"], head[0]["status"], head[0]["home_score"]) == (2024, None, "Final", None)
    assert rows(t["rejects"]) == [{"game_pk": 2, "reason": "unreadable document"}]
    assert [(r["at_bat_index"], r["batter_id"], r["event_type"]) for r in rows(t["at_bats"], "at_bat_index")] == [(0, 7, "single"), (1, None, None)]
    thrown = rows(t["pitches"], "pitch_index")
    assert [(p["pitch_index"], p["pitch_type_code"], p["start_speed"], p["spin_rate"], p["launch_speed"]) for p in thrown] == [(0, "FF", 95.0, 2200, None), (2, "SL", None, None, 101.5)]
    assert [(r["runner_id"], r["responsible_pitcher_id"]) for r in rows(t["runners"], "runner_id")] == [(7, None), (9, 8)]
    assert [(r["inning"], r["half_inning"], r["runs"]) for r in rows(t["linescore"], "inning", "half_inning")] == [(1, "bottom", 0), (1, "top", 2), (9, "top", 1)]
    bat = rows(t["boxscore_batting"])
    assert [(b["player_id"], b["batting_order"], b["at_bats"], b["hits"], b["avg"]) for b in bat] == [(7, 300, 3, 1, None)]
    assert [(p["player_id"], p["innings_pitched"], p["era"]) for p in rows(t["boxscore_pitching"])] == [(8, 5.2, 3.1)]
    assert [(f["player_id"], f["put_outs"], f["fielding_pct"]) for f in rows(t["boxscore_fielding"])] == [(7, 2, 1.0)]
    assert [(c["player_id"], c["credit"]) for c in rows(t["fielding_credits"])] == [(4, "f_assist")]
    seen = rows(mlb.explore_game(raw.filter("game_pk = 0")))[0]
    assert (seen["total_at_bats"], seen["total_pitches"], seen["pitch_types_seen"]) == (2, 2, ["FF", "SL"])


def test_lineup_leaves_out_pitchers_and_strangers(spark):
    sides = mlb.batting_sides(raw_games(spark, FULL))
    out = rows(matchup.lineup(sides))
    assert [(r["batter_id"], r["batting_order"], r["batter_name"], r["bat_side"]) for r in out] == [(7, 1, "Bat", "L")]
    status = {r["side"]: r["status"] for r in matchup.lineup_status(sides).collect()}
    assert status == {"away": "posted", "home": "lineup_not_posted"}
    assert {r["side"]: r["starter_id"] for r in sides.collect()} == {"away": 55, "home": 8}


RAW_RACE = "season INT, series_id INT, race_id INT, endpoint_type STRING, data STRING"


def test_race_tables(spark):
    result = {"driver_id": "4", "driver_fullname": "D", "official_car_number": " 9 ", "finishing_position": 3, "average_running_position": "4.5"}
    docs = [
        (2024, 1, 10, "weekend_feed", {"weekend_race": [{"race_name": "R", "race_date": "2024-05-01T15:00", "actual_distance": "400.5",
            "results": [dict(result, finishing_status=s) for s in ("Running", "", "Accident")], "race_leaders": [{"start_lap": 0, "car_number": 9}]}]}),
        (2024, 1, 10, "lap_times", {"laps": [{"NASCARDriverID": 4, "Number": "9", "Laps": [{"Lap": 0}, {"Lap": None}, {"Lap": "1", "LapSpeed": "150.5"}]}]}),
        (2024, 1, 10, "pit_stops", [{"vehicle_number": "9", "pit_in_rank": 1, "total_duration": "12.5"}]),
        (2024, 1, 10, "driver_stats", {"drivers": [{"driver_id": 4, "rating": 101.5, "passes_gf": "3"}]}),
        (2024, 1, 11, "pit_stops", {"pit_stops": [{"vehicle_number": "8"}]}),  # no weekend feed
        (2024, 1, 12, "weekend_feed", {"weekend_race": []}),
        (2024, 1, 12, "pit_stops", {"pit_stops": [{"vehicle_number": " 7"}, {"vehicle_number": None}]}),
        (2024, 1, 12, "driver_stats", [{"drivers": [{"driver_id": "5", "rating": "bad"}]}]),
    ]
    raw = spark.createDataFrame([(*d[:4], json.dumps(d[4])) for d in docs], RAW_RACE)
    t = nascar.flatten_nascar(raw)
    assert [(r["race_id"], r["race_date"], r["total_miles"]) for r in rows(t["races"])] == [(10, "2024-05-01", 400.5)]
    assert sorted((r["finishing_status"], r["dnf"], r["car_number"]) for r in rows(t["results"])) == [("", False, "9"), ("Accident", True, "9"), ("Running", False, "9")]
    assert [(r["lap_number"], r["lap_speed"]) for r in rows(t["laps"], "lap_number")] == [(0, None), (1, 150.5)]
    assert sorted((r["race_id"], r["car_number"]) for r in rows(t["pit_stops"])) == [(10, "9"), (12, ""), (12, "7")]
    assert sorted((r["driver_id"], r["driver_rating"]) for r in rows(t["driver_stats"], "driver_id")) == [(4, 101.5), (5, None)]
    seen = {r["race_id"]: r for r in nascar.explore_race(raw).collect()}
    assert seen[11]["missing_endpoints"] == ["weekend_feed", "lap_times", "lap_notes", "driver_stats", "advanced_stats"]
    assert seen[10]["total_pit_records"] == 1 and seen[12]["total_pit_records"] is None


def test_snapshot_tire_age(spark):
    feed = {"lap_number": 50, "number_of_race_laps": 200, "flag_state": 4, "vehicles": [
        {"vehicle_number": 9, "pit_stops": [{"pit_in_lap_count": 0}, {"pit_in_lap_count": 30}, {"pit_in_lap_count": 12}], "laps_led": [{}, {}], "driver": {"driver_id": 1}},
        {"vehicle_number": None, "pit_stops": [], "driver": {"driver_id": 2}}, {"driver": {"driver_id": 3}, "pit_stops": [{"pit_in_lap_count": 0}]}]}
    raw = spark.createDataFrame([(1, 2024, 1, "t", json.dumps(feed))], "race_id INT, season INT, series_id INT, snapshot_at STRING, data STRING")
    out = rows(nascar.snapshot(raw), "driver_id")
    assert [(r["car_number"], r["last_pit_lap"], r["tire_age"], r["pit_stops"], r["laps_led"]) for r in out] == [("9", 30, 20, 3, 2), ("", None, None, 0, 0), ("", None, None, 1, 0)]
    assert nascar.flags(raw).first()["flag"] == "checkered"


def test_formula_tables(spark):
    docs = [
        (2024, 1, "jolpica", "results", "monza", {"results": [{"Driver": {"driverId": "a", "permanentNumber": ""}, "Constructor": {"constructorId": "c"}, "position": "", "points": "25.5", "Time": {"millis": "123"}}]}),
        (2024, 1, "other", "results", "x", {"results": [{"Driver": {"driverId": "zz"}}]}),
        (2024, 2, "jolpica", "results", "spa", {"results": []}),
        (2024, 1, "jolpica", "qualifying", "monza", {"qualifying": [{"Driver": {"driverId": "b"}, "Constructor": {"constructorId": "c", "name": "later"}, "Q1": "1:22.670"}]}),
        (2024, 1, "jolpica", "lap_times", "monza", {"Laps": [{"number": "1", "Timings": [{"driverId": "a", "position": "2", "time": "1:22.670"}]}]}),
        (2024, 2, "jolpica", "lap_times", "spa", {"laps": [{"lap": 3, "driverId": "a", "position": 1, "time": None}]}),
    ]
    raw = spark.createDataFrame([(*d[:5], json.dumps(d[5])) for d in docs], "season INT, round INT, source STRING, event_type STRING, circuit_id STRING, data STRING")
    t = f1.flatten_f1(raw)
    assert [(r["round"], r["circuit_id"]) for r in rows(t["races"])] == [(1, "monza")]
    assert [(r["driver_id"], r["position"], r["points"], r["time_millis"]) for r in rows(t["results"])] == [("a", None, 25.5, 123)]
    assert [(r["lap"], r["time_millis"]) for r in rows(t["lap_times"], "lap")] == [(1, 82670), (3, None)]
    assert sorted(r["driver_id"] for r in rows(t["drivers"])) == ["a", "b"]
    assert [(r["constructor_id"], r["name"]) for r in rows(t["constructors"])] == [("c", None)]


RAW = "game_pk INT, data STRING, fetched_at STRING"


def test_landing_upserts(spark):
    def doc(state):
        return json.dumps({"gamePk": 5, "gameData": {"status": {"detailedState": state}}})

    new = spark.createDataFrame([(1, doc("Final"), "t2"), (1, doc("Live"), "t1"), (2, doc("Final"), "t2"), (3, doc("Final"), "t2"), (None, doc("Live"), "t0")], RAW)
    stored = landing.game_header(spark.createDataFrame([(1, doc("Live"), "t0"), (2, doc("Final"), "t0"), (9, doc("Live"), "t0")], RAW))
    table, report = landing.land_games(new, stored)
    assert {r["game_pk"]: (r["action"], r["status_changed"]) for r in report.collect()} == {1: ("updated", True), 2: ("skipped", False), 3: ("inserted", True), 5: ("inserted", True)}
    assert {r["game_pk"]: (r["status"], r["fetched_at"]) for r in table.collect()} == {1: ("Final", "t2"), 2: ("Final", "t0"), 3: ("Final", "t2"), 5: ("Live", "t0"), 9: ("Live", "t0")}
    again, report = landing.land_games(new, table, skip_final=False)
    assert again.count() == 5 and {r["action"] for r in report.collect()} == {"updated"}


def test_schedules(spark):
    g = lambda pk, state: {"gamePk": pk, "status": {"detailedState": state}, "teams": {"away": {"team": {"name": "A"}}, "home": {"team": {"name": "H"}}}}
    doc = {"dates": [{"date": "2024-05-01", "games": [g(1, "Final"), g(2, "Delayed")]}, {"date": "2024-05-02", "games": [g(1, "Final"), g(3, "Warmup"), g(4, "Game Over")]}]}
    docs = spark.createDataFrame([(json.dumps(doc),)], "data STRING")
    assert [(r["game_pk"], r["game_date"]) for r in landing.schedule_games(docs).collect()] == [(1, "2024-05-02")]
    assert [r["game_pk"] for r in landing.schedule_board(docs).collect()] == [2, 3, 1, 4, 1]
    season = spark.createDataFrame([(json.dumps({"series_1": [{"race_id": 7, "race_name": None}, {"race_id": None}], "series_2": [{"race_id": "8", "race_name": "X"}], "other": []}),)], "data STRING")
    assert sorted((r["series_id"], r["race_id"], r["race_name"]) for r in landing.season_races(season).collect()) == [(1, 7, "Race 7"), (2, 8, "X")]


def test_current_race(spark):
    races = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01"), (3, "2024-03-01")], "race_id INT, race_date STRING")
    live = lambda *ids: spark.createDataFrame([(i,) for i in ids], "race_id INT")
    pick = lambda day, *ids: landing.current_race(races, live(*ids), day).first()["race_id"]
    assert pick("2024-02-15", 1, 3) == 1 and pick("2024-02-15") == 2 and pick("2023-01-01") == 3 and pick("2023-01-01", 1) == 1


def test_season_tables_and_register(spark):
    raw = spark.createDataFrame([("A", "0", "77", "nan", "0.0", "0.3"), ("B", "12", "9", "5", "0.1", "0.2")], "Name STRING, IDfg STRING, mlbamID STRING, PA STRING, `Barrel%` STRING, `Barrels%` STRING")
    out = rows(season_stats.load_season_batting(raw, 2024), "player_name")
    assert [(r["mlbam_id"], r["fg_id"], r["pa"], r["barrel_pct"]) for r in out] == [(77, None, None, 0.3), (12, "12", 5, 0.1)]
    register = spark.createDataFrame([(1.0, 5.0, "b", "F", "L", float("nan")), (1.0, 3.0, "a", "F", "L", 1990.0), (0.0, 9.0, None, "X", "Y", None), (float("nan"), 2.0, None, "X", "Y", None)],
        "key_mlbam DOUBLE, key_fangraphs DOUBLE, key_bbref STRING, name_first STRING, name_last STRING, birth_year DOUBLE")
    assert [(r["mlbam_id"], r["fangraphs_id"], r["birth_year"]) for r in season_stats.build_id_map(register).collect()] == [(1, 3, 1990)]
    ab = spark.createDataFrame([(1, "Known One"), (2, "New de la Cruz"), (None, "x")], "batter_id INT, batter_name STRING")
    missing = season_stats.missing_from_map(ab, spark.createDataFrame([(1,)], "mlbam_id INT")).collect()
    assert [(r["batter_id"], r["first_name"], r["last_name"]) for r in missing] == [(2, "New", "de la Cruz")]

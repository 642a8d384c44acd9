"""Schemas of the feed documents.

A missing path parses to NULL. Leaves a feed may send quoted or unquoted are
strings here and cast where they are selected.
"""

# --- fixed values: document field names --------------------------------------
_CLUB = "STRUCT<id: INT, name: STRING, abbreviation: STRING>"
_LINE = "STRUCT<runs: INT, hits: INT, errors: INT>"
_HALF = "STRUCT<runs: INT, hits: INT, errors: INT, leftOnBase: INT>"
_BY_NAME = "STRUCT<id: INT, fullName: STRING>"
_CODE = "STRUCT<code: STRING>"

_PITCH_DATA = (
    "STRUCT<startSpeed: DOUBLE, endSpeed: DOUBLE, zone: INT, strikeZoneTop: DOUBLE, strikeZoneBottom: DOUBLE, "
    "coordinates: STRUCT<pX: DOUBLE, pZ: DOUBLE, pfxX: DOUBLE, pfxZ: DOUBLE, x0: DOUBLE, y0: DOUBLE, z0: DOUBLE, "
    "vX0: DOUBLE, vY0: DOUBLE, vZ0: DOUBLE, aX: DOUBLE, aY: DOUBLE, aZ: DOUBLE>, "
    "breaks: STRUCT<breakAngle: DOUBLE, breakLength: DOUBLE, breakY: DOUBLE, spinRate: STRING, spinDirection: STRING>>"
)
_EVENT = (
    "STRUCT<isPitch: BOOLEAN, pitchNumber: INT, playId: STRING, pfxId: STRING, "
    "details: STRUCT<code: STRING, description: STRING, isStrike: BOOLEAN, isBall: BOOLEAN, isInPlay: BOOLEAN, "
    "type: STRUCT<code: STRING, description: STRING>>, "
    f"pitchData: {_PITCH_DATA}, "
    "hitData: STRUCT<launchSpeed: DOUBLE, launchAngle: DOUBLE, totalDistance: DOUBLE, trajectory: STRING, "
    "hardness: STRING, coordinates: STRUCT<coordX: DOUBLE, coordY: DOUBLE>>, "
    "count: STRUCT<balls: INT, strikes: INT>>"
)
_RUNNER_DETAILS = (
    f"STRUCT<playIndex: INT, runner: {_BY_NAME}, responsiblePitcher: STRUCT<id: INT>, event: STRING, "
    "eventType: STRING, isScoringEvent: BOOLEAN, rbi: BOOLEAN, earned: BOOLEAN, teamUnearned: BOOLEAN>"
)
_MOVEMENT = "STRUCT<start: STRING, `end`: STRING, outBase: STRING, isOut: BOOLEAN, outNumber: INT>"
_CREDIT = "STRUCT<player: STRUCT<id: INT>, position: STRUCT<code: STRING, name: STRING>, credit: STRING>"


def _plays(fields: str) -> str:
    return f"liveData STRUCT<plays: STRUCT<allPlays: ARRAY<STRUCT<{fields}>>>>"


def _box(player: str, rest: str = "") -> str:
    side = f"STRUCT<team: STRUCT<id: INT>, {rest}players: MAP<STRING, STRUCT<{player}>>>"
    return f"liveData STRUCT<boxscore: STRUCT<teams: STRUCT<away: {side}, home: {side}>>>"


# A table reads its own part of the game document; the parser skips the rest.
GAME_HEADER = (
    "gameData STRUCT<game: STRUCT<type: STRING, season: STRING, doubleHeader: STRING, gameNumber: INT>, "
    "datetime: STRUCT<originalDate: STRING, dayNight: STRING>, status: STRUCT<detailedState: STRING>, "
    f"teams: STRUCT<away: {_CLUB}, home: {_CLUB}>, venue: STRUCT<id: INT, name: STRING>, "
    "weather: STRUCT<temp: STRING, condition: STRING, wind: STRING>, "
    "flags: STRUCT<noHitter: BOOLEAN, perfectGame: BOOLEAN>>, "
    "liveData STRUCT<linescore: STRUCT<currentInning: INT, inningState: STRING, scheduledInnings: INT, "
    f"teams: STRUCT<away: {_LINE}, home: {_LINE}>>, "
    "decisions: STRUCT<winner: STRUCT<id: INT>, loser: STRUCT<id: INT>, save: STRUCT<id: INT>>>"
)
# What landing reads of a game document.
GAME_NAMES = (
    "gamePk STRING, gameData STRUCT<datetime: STRUCT<originalDate: STRING>, status: STRUCT<detailedState: STRING>, "
    "teams: STRUCT<away: STRUCT<abbreviation: STRING>, home: STRUCT<abbreviation: STRING>>>"
)
GAME_INNINGS = f"liveData STRUCT<linescore: STRUCT<innings: ARRAY<STRUCT<num: INT, away: {_HALF}, home: {_HALF}>>>>"
GAME_AT_BATS = _plays(
    "result: STRUCT<event: STRING, eventType: STRING, description: STRING, rbi: INT, awayScore: INT, homeScore: INT>, "
    "about: STRUCT<atBatIndex: INT, inning: INT, halfInning: STRING, isScoringPlay: BOOLEAN, hasOut: BOOLEAN, captivatingIndex: INT>, "
    f"matchup: STRUCT<batter: {_BY_NAME}, pitcher: {_BY_NAME}, batSide: {_CODE}, pitchHand: {_CODE}>, "
    "count: STRUCT<balls: INT, strikes: INT, outs: INT>"
)
GAME_EVENTS = _plays(
    "about: STRUCT<atBatIndex: INT>, matchup: STRUCT<batter: STRUCT<id: INT>, pitcher: STRUCT<id: INT>>, "
    f"playEvents: ARRAY<{_EVENT}>"
)
GAME_RUNNERS = _plays(
    f"about: STRUCT<atBatIndex: INT>, runners: ARRAY<STRUCT<movement: {_MOVEMENT}, details: {_RUNNER_DETAILS}>>"
)
GAME_CREDITS = _plays(f"about: STRUCT<atBatIndex: INT>, runners: ARRAY<STRUCT<credits: ARRAY<{_CREDIT}>>>")
GAME_SIDES = _box(
    f"person: STRUCT<fullName: STRING>, batSide: {_CODE}", "battingOrder: ARRAY<INT>, pitchers: ARRAY<INT>, "
)
GAME_SUMMARY = GAME_HEADER[:-1] + (
    ", plays: STRUCT<allPlays: ARRAY<STRUCT<playEvents: ARRAY<STRUCT<isPitch: BOOLEAN, "
    "details: STRUCT<type: STRUCT<code: STRING>>>>>>>>"
)


def game_box(kind: str) -> str:
    """Box score with one kind of statistics: batting, pitching or fielding."""
    return _box(f"person: STRUCT<id: INT>, battingOrder: STRING, stats: STRUCT<{kind}: MAP<STRING, STRING>>")


_SCHEDULED = "STRUCT<team: STRUCT<name: STRING, abbreviation: STRING>, probablePitcher: STRUCT<id: INT, fullName: STRING>>"
SCHEDULE = (
    "dates ARRAY<STRUCT<date: STRING, games: ARRAY<STRUCT<gamePk: INT, gameType: STRING, "
    f"status: STRUCT<detailedState: STRING>, teams: STRUCT<away: {_SCHEDULED}, home: {_SCHEDULED}>, "
    "linescore: STRUCT<currentInning: INT, inningState: STRING, "
    "teams: STRUCT<away: STRUCT<runs: INT>, home: STRUCT<runs: INT>>>>>>>"
)


def _strings(*names: str) -> str:
    return ", ".join(f"{n}: STRING" for n in names)


_RESULT = "STRUCT<" + _strings(
    "driver_id", "driver_fullname", "official_car_number", "team_name", "car_make", "starting_position",
    "finishing_position", "laps_completed", "laps_led", "finishing_status", "points_earned",
    "playoff_points_earned", "average_running_position", "average_speed", "num_pit_stops",
) + ">"
WEEKEND_FEED = (
    "weekend_race ARRAY<STRUCT<" + _strings(
        "race_name", "track_name", "track_id", "race_date", "scheduled_laps", "actual_laps",
        "number_of_cautions", "number_of_caution_laps", "number_of_lead_changes", "number_of_leaders",
        "actual_distance",
    ) + f", results: ARRAY<{_RESULT}>, race_leaders: ARRAY<STRUCT<start_lap: STRING, car_number: STRING>>>>"
)
LAP_TIMES = (
    "laps ARRAY<STRUCT<NASCARDriverID: STRING, FullName: STRING, Number: STRING, Manufacturer: STRING, "
    "Laps: ARRAY<STRUCT<Lap: STRING, RunningPos: STRING, LapTime: STRING, LapSpeed: STRING>>>>"
)
PIT_STOP = "STRUCT<" + _strings("driver_name", "vehicle_number", "pit_in_rank", "lap_count", "total_duration") + ">"
DRIVER_STATS = "drivers ARRAY<STRUCT<" + _strings(
    "driver_id", "avg_ps", "fast_laps", "quality_passes", "passes_gf", "passed_gf", "passing_diff", "rating",
) + ">>"
RACE_SCHEDULE = "MAP<STRING, ARRAY<STRUCT<" + _strings(
    "race_id", "race_name", "race_date", "track_name", "scheduled_laps",
) + ">>>"
LIVE_FEED = (
    "lap_number INT, number_of_race_laps INT, flag_state INT, vehicles ARRAY<STRUCT<vehicle_number: STRING, "
    "vehicle_manufacturer: STRING, running_position: INT, laps_completed: INT, last_lap_time: DOUBLE, "
    "last_lap_speed: DOUBLE, best_lap_time: DOUBLE, best_lap_speed: DOUBLE, status: STRING, delta: DOUBLE, "
    "driver: STRUCT<driver_id: INT, full_name: STRING>, laps_led: ARRAY<STRUCT<start_lap: INT, end_lap: INT>>, "
    "pit_stops: ARRAY<STRUCT<pit_in_lap_count: INT>>>>"
)

_DRIVER = "STRUCT<" + _strings(
    "driverId", "permanentNumber", "code", "givenName", "familyName", "dateOfBirth", "nationality", "url",
) + ">"
_CONSTRUCTOR = "STRUCT<" + _strings("constructorId", "name", "nationality", "url") + ">"
F1_RESULTS = (
    f"results ARRAY<STRUCT<Driver: {_DRIVER}, Constructor: {_CONSTRUCTOR}, "
    + _strings("grid", "position", "positionText", "positionOrder", "points", "laps", "status")
    + ", Time: STRUCT<millis: STRING, time: STRING>, FastestLap: STRUCT<rank: STRING, "
    "Time: STRUCT<time: STRING>, AverageSpeed: STRUCT<speed: STRING>>>>, "
    "race STRUCT<" + _strings("raceName", "date", "time", "url")
    + ", Circuit: STRUCT<circuitId: STRING, circuitName: STRING, Location: STRUCT<country: STRING, locality: STRING>>>"
)
F1_QUALIFYING = (
    f"qualifying ARRAY<STRUCT<Driver: {_DRIVER}, Constructor: {_CONSTRUCTOR}, " + _strings("position", "Q1", "Q2", "Q3") + ">>"
)
# Two documents differ only in the case of one field, so they are parsed apart.
F1_LAPS = "laps ARRAY<STRUCT<lap: STRING, driverId: STRING, position: STRING, time: STRING>>"
F1_LAP_PAGES = (
    "Laps ARRAY<STRUCT<number: STRING, Timings: ARRAY<STRUCT<driverId: STRING, position: STRING, time: STRING>>>>"
)
F1_PIT_STOPS = "pit_stops ARRAY<STRUCT<" + _strings("driverId", "stop", "lap", "time", "duration") + ">>"
F1_SCHEDULE = "races ARRAY<STRUCT<" + _strings("season", "round", "raceName", "date") + ">>"

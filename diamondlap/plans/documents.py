"""Feed documents built from the given tables, one small document per row.

Only played_documents() gathers a group, the line items of an order; all others
scale like the scan itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from diamondlap.functions.groups import laid
from diamondlap.plans.tables import VIEWS, Tables


def _spread(df: DataFrame) -> DataFrame:
    """Writing JSON is slow work per row, so the narrow rows are dealt out first."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _json(expr: str):
    return F.expr(f"to_json({expr})").alias("data")


def _player(pid: str, offset: int) -> str:
    """A player entry; stats are text, as the feed sends them."""
    return (
        f"named_struct('person', named_struct('id', CAST({pid} AS INT), 'fullName', concat('Player ', CAST({pid} AS STRING))), "
        f"'batSide', named_struct('code', CASE WHEN {pid} % 2 = 0 THEN 'L' ELSE 'R' END), "
        f"'battingOrder', CASE WHEN {pid} % 3 = 0 THEN NULL ELSE CAST(100 * ({pid} % 9 + 1) + {offset} AS STRING) END, "
        "'stats', named_struct("
        f"'batting', CASE WHEN {pid} % 5 = 0 THEN map() ELSE map('atBats', CAST({pid} % 6 AS STRING), 'strikeOuts', CAST({pid} % 3 AS STRING), "
        f"'hits', CAST({pid} % 4 AS STRING), 'avg', CASE WHEN {pid} % 4 = 0 THEN '.---' ELSE '.250' END) END, "
        f"'pitching', CASE WHEN {pid} % 2 = 0 THEN map('inningsPitched', '5.2', 'outs', CAST({pid} % 20 AS STRING), 'era', '-.--') ELSE map() END, "
        f"'fielding', map('putOuts', CAST({pid} % 7 AS STRING), 'passedBall', '1', 'fielding', '.980')))"
    )


def game_documents(t: Tables, plays: str = "", where: str = "true") -> DataFrame:
    """One game document per order (of those `where` names): header, innings and box score, and `plays` if given, SQL of more fields of liveData.

    The document is too long for one generated method to be compiled by the JVM. Batting orders are made over a
    list, which keeps Spark from generating one method for all of it."""
    club = lambda key: f"named_struct('id', CAST({key} % 30 AS INT), 'name', concat('Club ', CAST({key} % 30 AS STRING)), 'abbreviation', concat('T', CAST({key} % 30 AS STRING)))"
    side = lambda key, base: (
        f"named_struct('team', named_struct('id', CAST({key} % 30 AS INT)), "
        f"'battingOrder', transform(array(1, 2), k -> CAST({base} + k AS INT)), 'pitchers', array(CAST({base} + 2 AS INT)), "
        f"'players', map(concat('ID', CAST({base} + 1 AS STRING)), {_player(f'({base} + 1)', 0)}, "
        f"concat('ID', CAST({base} + 2 AS STRING)), {_player(f'({base} + 2)', 1)}))"
    )
    return _spread(t.base("orders").filter(where)).select(
        F.col("o_orderkey").cast("int").alias("game_pk"),
        F.expr("CAST(CAST(o_orderdate AS DATE) AS STRING)").alias("game_date"),
        _json(
            "named_struct('gamePk', o_orderkey, 'gameData', named_struct("
            "'game', named_struct('type', CASE o_orderstatus WHEN 'P' THEN 'S' ELSE 'R' END, 'season', CAST(year(o_orderdate) AS STRING), "
            "'doubleHeader', 'N', 'gameNumber', CAST(o_custkey % 2 + 1 AS INT)), "
            "'datetime', named_struct('originalDate', CAST(CAST(o_orderdate AS DATE) AS STRING), 'dayNight', 'night'), "
            "'status', named_struct('detailedState', CASE o_orderpriority WHEN '1-URGENT' THEN 'In Progress' ELSE 'Final' END), "
            f"'teams', named_struct('away', {club('o_custkey')}, 'home', {club('(o_custkey + 7)')}), "
            "'venue', named_struct('id', CAST(o_custkey % 50 AS INT), 'name', concat('Park ', CAST(o_custkey % 50 AS STRING))), "
            "'weather', named_struct('temp', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(50 + o_orderkey % 50 AS STRING) END, 'condition', 'Clear'), "
            "'flags', named_struct('noHitter', o_orderkey % 100 = 0)), "
            "'liveData', named_struct(" + plays + "'linescore', named_struct('currentInning', 9, 'scheduledInnings', 9, "
            "'teams', named_struct('away', named_struct('runs', CAST(o_custkey % 8 AS INT)), 'home', named_struct('runs', CAST(o_custkey % 6 AS INT), 'errors', 1)), "
            "'innings', array("
            "named_struct('num', 1, 'away', named_struct('runs', CAST(o_custkey % 3 AS INT), 'hits', 1), 'home', named_struct('runs', CAST(o_custkey % 4 AS INT), 'hits', 2)), "
            "named_struct('num', 2, 'away', named_struct('runs', 1, 'hits', CAST(o_custkey % 5 AS INT)), 'home', CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE named_struct('runs', 0, 'hits', 0) END))), "
            "'decisions', named_struct('winner', named_struct('id', CAST(o_custkey AS INT)), 'save', CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE named_struct('id', CAST(o_custkey + 1 AS INT)) END), "
            f"'boxscore', named_struct('teams', named_struct('away', {side('o_custkey', 'o_orderkey * 10')}, 'home', {side('(o_custkey + 7)', '(o_orderkey * 10 + 5)')}))))"
        ),
        F.expr("CAST(o_orderdate AS TIMESTAMP)").alias("fetched_at"),
    )


def full_game_documents(t: Tables) -> DataFrame:
    """Game documents with plays as well: one with a pitch and runners, and for every second game one without.
    Every 97th text breaks off."""
    play = (
        "named_struct('about', named_struct('atBatIndex', {n}, 'halfInning', 'top'), "
        "'matchup', named_struct('batter', named_struct('id', CAST(o_custkey AS INT)), 'pitcher', named_struct('id', CAST(o_custkey + 1 AS INT))), "
        "'playEvents', {events}, 'runners', {runners})"
    )
    events = (
        "array(named_struct('isPitch', FALSE, 'details', named_struct('code', '1', 'type', named_struct('code', CAST(NULL AS STRING)))), "
        "named_struct('isPitch', TRUE, 'details', named_struct('code', 'C', 'type', named_struct('code', 'FF'))))"
    )
    credit = lambda who, kind: f"named_struct('player', named_struct('id', CAST({who} AS INT)), 'position', named_struct('code', '6'), 'credit', '{kind}')"
    runner = "named_struct('movement', named_struct('end', '{base}'), 'details', named_struct('runner', named_struct('id', CAST(o_custkey AS INT))), 'credits', {credits})"
    credits = f"array({credit('o_custkey', 'f_assist')}, {credit('o_custkey + 1', 'f_putout')})"
    runners = (
        f"array({runner.format(base='1B', credits=credits)}, "
        f"{runner.format(base='2B', credits='NULL')})"
    )
    full, bare = play.format(n=0, events=events, runners=runners), play.format(n=1, events="NULL", runners="NULL")
    docs = game_documents(t, f"'plays', named_struct('allPlays', CASE WHEN o_orderkey % 2 = 0 THEN array({full}, {bare}) ELSE array({full}) END), ")
    return docs.withColumn("data", F.when(F.col("game_pk") % 97 == 1, F.substring("data", 1, 60)).otherwise(F.col("data")))


def played_documents(t: Tables, status: str = "status") -> DataFrame:
    """One document per game of the domain views, with all its plays and pitches, so that scoring the
    documents must give what scoring the views gives. `status` is SQL over the games.

    At-bats and pitches are views of the same line items. These are dealt out by game once, and pitches, at-bats and
    plays are gathered where they lie; items without a game belong to no document."""
    pitch, at_bat = VIEWS["pitches"], VIEWS["at_bats"]
    cols = {c.rsplit(" AS ", 1)[1]: c.rsplit(" AS ", 1)[0] for c in pitch.columns}
    event = (
        f"named_struct('isPitch', TRUE, 'details', named_struct('code', {cols['call_code']}, 'isInPlay', {cols['is_in_play']}, 'type', named_struct('code', {cols['pitch_type_code']})), "
        f"'pitchData', named_struct('startSpeed', {cols['start_speed']}, 'zone', {cols['zone']}, 'coordinates', named_struct('pfxX', {cols['pfx_x']}, 'pfxZ', {cols['pfx_z']}), "
        f"'breaks', named_struct('spinRate', CAST({cols['spin_rate']} AS STRING))), 'hitData', named_struct('launchSpeed', {cols['launch_speed']}, 'launchAngle', {cols['launch_angle']}))"
    )
    items = t.base(pitch.source).filter("l_orderkey IS NOT NULL")
    items = laid(items, t.tasks(pitch.source) or int(t.spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    thrown = f"CASE WHEN l_linenumber IS NOT NULL THEN collect_list({event}) END AS events"  # a pitch without number is of no at-bat
    at_bats = items.groupBy(*[F.expr(k) for k in at_bat.group_by]).agg(*[F.expr(c) for c in [*at_bat.columns, thrown]])
    play = F.expr(
        "named_struct('about', named_struct('atBatIndex', at_bat_index, 'inning', inning, 'halfInning', half_inning), 'result', named_struct('eventType', event_type), "
        "'matchup', named_struct('batter', named_struct('id', CAST(batter_id AS INT), 'fullName', batter_name), "
        "'pitcher', named_struct('id', CAST(pitcher_id AS INT), 'fullName', pitcher_name), 'batSide', named_struct('code', bat_side), "
        "'pitchHand', named_struct('code', pitch_hand)), 'playEvents', events)"
    )
    plays = at_bats.groupBy("game_pk").agg(F.collect_list(play).alias("plays"))
    return t.games.join(plays, "game_pk", "left").select(
        F.col("game_pk").cast("int").alias("game_pk"),
        _json(
            "named_struct('gamePk', game_pk, 'gameData', named_struct('game', named_struct('type', game_type, 'season', CAST(season AS STRING)), "
            f"'datetime', named_struct('originalDate', game_date), 'status', named_struct('detailedState', {status})), "
            "'liveData', named_struct('plays', named_struct('allPlays', plays)))"
        ),
        F.expr("CAST(concat(game_date, ' 12:00:00') AS TIMESTAMP)").alias("fetched_at"),
    )


def lineup_documents(t: Tables, turn: int) -> DataFrame:
    """One document per order of a game that has not begun: two orders of batters, which
    change with `turn`, and a starter on each side."""
    batter = lambda k: f"CAST(80 + (o_orderkey * 7 + {k} + {turn}) % 160 AS INT)"
    starter = lambda k: f"CAST((o_orderkey * 2 + {k}) % 80 AS INT)"
    player = lambda b: f"concat('ID', CAST({b} AS STRING)), named_struct('person', named_struct('fullName', 'X'))"
    side = lambda first, k: (
        f"named_struct('battingOrder', array({batter(first)}, {batter(first + 1)}), 'pitchers', array({starter(k)}), "
        f"'players', map({player(batter(first))}, {player(batter(first + 1))}))"
    )
    return _spread(t.base("orders")).select(
        F.col("o_orderkey").cast("int").alias("game_pk"),
        _json(
            "named_struct('gamePk', o_orderkey, 'gameData', named_struct('game', named_struct('type', 'R', 'season', '2026'), "
            "'datetime', named_struct('originalDate', concat('2026-', lpad(CAST(o_orderkey % 12 + 1 AS STRING), 2, '0'), '-01')), "
            "'status', named_struct('detailedState', 'Preview')), "
            f"'liveData', named_struct('boxscore', named_struct('teams', named_struct('away', {side(0, 0)}, 'home', {side(2, 1)}))))"
        ),
        F.expr(f"CAST('2026-01-0{turn + 1} 12:00:00' AS TIMESTAMP)").alias("fetched_at"),
    )


def play_documents(t: Tables) -> DataFrame:
    """One single-play game document per line item: a non-pitch event, then the
    pitch, and two runners of whom one has fielding credits."""
    src = _spread(t.base("lineitem"))
    cols = {c.rsplit(" AS ", 1)[1]: c.rsplit(" AS ", 1)[0] for c in _pitch_view()}
    return src.select(
        F.col("l_orderkey").cast("int").alias("game_pk"), F.lit(None).cast("string").alias("game_date"),
        _json(
            "named_struct('liveData', named_struct('plays', named_struct('allPlays', array(named_struct("
            "'result', named_struct('eventType', CASE WHEN l_returnflag = 'R' THEN 'strikeout' ELSE 'single' END, 'rbi', CAST(l_partkey % 3 AS INT)), "
            "'about', named_struct('atBatIndex', CAST(l_linenumber AS INT), 'inning', 1, 'halfInning', 'top', 'hasOut', l_returnflag = 'R'), "
            "'matchup', named_struct('batter', named_struct('id', CAST(l_partkey AS INT), 'fullName', concat('B ', CAST(l_partkey AS STRING))), "
            "'pitcher', named_struct('id', CAST(l_suppkey AS INT), 'fullName', concat('P ', CAST(l_suppkey AS STRING))), 'batSide', named_struct('code', 'L')), "
            "'count', named_struct('balls', CAST(l_partkey % 4 AS INT), 'strikes', CAST(l_partkey % 3 AS INT)), "
            "'playEvents', array(named_struct('isPitch', FALSE, 'pitchNumber', CAST(NULL AS INT), 'details', NULL, 'pitchData', NULL, 'hitData', NULL), "
            "named_struct('isPitch', TRUE, 'pitchNumber', CAST(1 AS INT), "
            f"'details', named_struct('code', {cols['call_code']}, 'isInPlay', {cols['is_in_play']}, 'type', named_struct('code', {cols['pitch_type_code']})), "
            f"'pitchData', named_struct('startSpeed', {cols['start_speed']}, 'zone', {cols['zone']}, 'coordinates', named_struct('pfxX', {cols['pfx_x']}, 'pX', {cols['px']}), "
            f"'breaks', named_struct('spinRate', {cols['spin_rate']})), "
            f"'hitData', CASE WHEN {cols['is_in_play']} THEN named_struct('launchSpeed', {cols['launch_speed']}, 'launchAngle', {cols['launch_angle']}) END)), "
            "'runners', array(named_struct('movement', named_struct('start', '1B', 'end', '2B', 'isOut', FALSE), "
            "'details', named_struct('runner', named_struct('id', CAST(l_partkey AS INT)), 'responsiblePitcher', CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE named_struct('id', CAST(l_suppkey AS INT)) END), "
            "'credits', array(named_struct('player', named_struct('id', CAST(l_suppkey AS INT)), 'position', named_struct('code', '6'), 'credit', 'f_assist'), "
            "named_struct('player', named_struct('id', CAST(l_suppkey + 1 AS INT)), 'position', named_struct('code', '3'), 'credit', 'f_putout'))), "
            "named_struct('movement', named_struct('start', NULL, 'end', '1B', 'isOut', FALSE), "
            "'details', named_struct('runner', named_struct('id', CAST(l_partkey + 1 AS INT)), 'responsiblePitcher', NULL), 'credits', NULL)))))))"
        ),
        F.expr("CAST(l_shipdate AS TIMESTAMP)").alias("fetched_at"),
    )


def _pitch_view():
    from diamondlap.plans.tables import VIEWS

    return VIEWS["pitches"].columns


def schedule_documents(t: Tables) -> DataFrame:
    """One schedule per order; every third game is listed on two dates."""
    game = (
        "named_struct('gamePk', CAST(o_orderkey AS INT), 'status', named_struct('detailedState', "
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'In Progress' WHEN '2-HIGH' THEN 'Preview' WHEN '3-MEDIUM' THEN 'Game Over' ELSE 'Final' END), "
        "'teams', named_struct('away', named_struct('team', named_struct('name', 'A', 'abbreviation', concat('T', CAST(o_custkey % 30 AS STRING))), "
        "'probablePitcher', CASE WHEN o_orderkey % 2 = 0 THEN named_struct('id', CAST(o_custkey AS INT), 'fullName', 'Starter') END), "
        "'home', named_struct('team', named_struct('name', 'H', 'abbreviation', concat('T', CAST((o_custkey + 7) % 30 AS STRING))))), "
        "'linescore', named_struct('currentInning', CAST(o_custkey % 9 + 1 AS INT), 'teams', named_struct('away', named_struct('runs', CAST(o_custkey % 8 AS INT)))))"
    )
    day = lambda shift: f"named_struct('date', CAST(date_add(CAST(o_orderdate AS DATE), {shift}) AS STRING), 'games', array({game}))"
    return _spread(t.base("orders")).select(
        _json(f"named_struct('dates', CASE WHEN o_orderkey % 3 = 0 THEN array({day(0)}, {day(1)}) ELSE array({day(0)}) END)")
    )


RACE_KEYS = ["CAST(2020 + event_id % 6 AS INT) AS season", "CAST(1 + event_id % 3 AS INT) AS series_id", "CAST(event_id AS INT) AS race_id"]


def race_documents(t: Tables) -> DataFrame:
    """Four documents per event, which stands for a race. Numbers come quoted or
    not, and list roots alternate with object roots."""
    odd = "event_id % 2 = 1"
    number = lambda e: f"CAST({e} AS STRING)"
    docs = {
        "weekend_feed": (
            "to_json(named_struct('weekend_race', array(named_struct('race_name', concat('Race ', CAST(event_id AS STRING)), 'track_name', event_type, "
            f"'track_id', {number('event_id % 50')}, 'race_date', concat(CAST(CAST(ts AS DATE) AS STRING), 'T12:00:00'), "
            f"'scheduled_laps', CAST(100 + event_id % 300 AS INT), 'actual_laps', CASE WHEN {odd} THEN 'n/a' ELSE {number('event_id % 300')} END, "
            "'actual_distance', value, 'results', array(named_struct("
            f"'driver_id', {number('user_id')}, 'driver_fullname', concat('D ', CAST(user_id AS STRING)), 'official_car_number', concat(' ', CAST(user_id % 100 AS STRING), ' '), "
            "'car_make', 'Ford', 'starting_position', CAST(event_id % 40 AS INT), 'finishing_position', CAST(user_id % 40 AS INT), "
            "'finishing_status', CASE event_id % 4 WHEN 0 THEN 'Running' WHEN 1 THEN '' WHEN 2 THEN 'Accident' ELSE NULL END, "
            f"'points_earned', {number('event_id % 60')}, 'average_running_position', CASE WHEN {odd} THEN 'nan' ELSE {number('value')} END)), "
            f"'race_leaders', array(named_struct('start_lap', '0', 'car_number', {number('user_id % 100')}), named_struct('start_lap', {number('event_id % 90')}, 'car_number', '7'))))))"
        ),
        "lap_times": (
            f"to_json(named_struct('laps', array(named_struct('NASCARDriverID', CAST(user_id AS INT), 'FullName', concat('D ', CAST(user_id AS STRING)), 'Number', {number('user_id % 100')}, "
            "'Laps', array(named_struct('Lap', 0, 'RunningPos', 3, 'LapTime', CAST(NULL AS DOUBLE), 'LapSpeed', CAST(NULL AS DOUBLE)), "
            "named_struct('Lap', CAST(1 + event_id % 200 AS INT), 'RunningPos', CAST(user_id % 40 AS INT), 'LapTime', value, 'LapSpeed', 100 + value), "
            "named_struct('Lap', CAST(NULL AS INT), 'RunningPos', 1, 'LapTime', value, 'LapSpeed', value))))))"
        ),
        "pit_stops": (
            f"CASE WHEN {odd} THEN to_json(array(named_struct('driver_name', concat('D ', CAST(user_id AS STRING)), 'vehicle_number', {number('user_id % 100')}, "
            f"'pit_in_rank', {number('event_id % 5')}, 'lap_count', CAST(event_id % 200 AS INT), 'total_duration', value))) "
            f"ELSE to_json(named_struct('pit_stops', array(named_struct('driver_name', concat('D ', CAST(user_id AS STRING)), 'vehicle_number', {number('user_id % 100')}, "
            f"'pit_in_rank', {number('event_id % 5')}, 'lap_count', CAST(event_id % 200 AS INT), 'total_duration', value)))) END"
        ),
        "driver_stats": (
            f"CASE WHEN {odd} THEN to_json(array(named_struct('drivers', array(named_struct('driver_id', user_id, 'avg_ps', value, 'passes_gf', {number('event_id % 30')}, 'rating', 60 + value))))) "
            f"ELSE to_json(named_struct('drivers', array(named_struct('driver_id', user_id, 'avg_ps', value, 'passes_gf', {number('event_id % 30')}, 'rating', 60 + value)))) END"
        ),
    }
    pairs = ", ".join(f"named_struct('endpoint_type', '{k}', 'data', {v})" for k, v in docs.items())
    return _spread(t.base("events")).select(
        *[F.expr(k) for k in RACE_KEYS], F.expr("CAST(ts AS TIMESTAMP)").alias("fetched_at"),
        F.explode(F.expr(f"array({pairs})")).alias("x"),
    ).select("season", "series_id", "race_id", "x.endpoint_type", "x.data", "fetched_at")


LAP_TIME = (
    "CASE event_id % 10 WHEN 0 THEN 'DNF' WHEN 1 THEN '' WHEN 2 THEN concat('1:', lpad(CAST(event_id % 60 AS STRING), 2, '0'), ':03.456') "
    "WHEN 3 THEN concat(CAST(event_id % 60 AS STRING), '.', lpad(CAST(event_id % 1000 AS STRING), 3, '0')) "
    "ELSE concat(CAST(event_id % 3 AS STRING), ':', lpad(CAST(user_id % 60 AS STRING), 2, '0'), '.', lpad(CAST(event_id % 1000 AS STRING), 3, '0')) END"
)


def round_documents(t: Tables) -> DataFrame:
    """Four formula documents per event, which stands for a round."""
    person = "named_struct('driverId', concat('d', CAST(user_id AS STRING)), 'permanentNumber', CAST(user_id % 99 AS STRING), 'givenName', 'Given', 'familyName', concat('F', CAST(user_id AS STRING)))"
    team = "named_struct('constructorId', concat('c', CAST(user_id % 12 AS STRING)), 'name', concat('Team ', CAST(user_id % 12 AS STRING)))"
    docs = {
        "results": (
            f"to_json(named_struct('results', array(named_struct('Driver', {person}, 'Constructor', {team}, 'grid', CAST(event_id % 20 AS STRING), "
            "'position', CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(event_id % 20 + 1 AS STRING) END, 'positionText', CASE WHEN event_id % 7 = 0 THEN 'R' ELSE CAST(event_id % 20 + 1 AS STRING) END, "
            "'points', CAST(event_id % 26 AS STRING), 'laps', CAST(event_id % 70 AS STRING), 'status', 'Finished', 'Time', CASE WHEN event_id % 7 = 0 THEN NULL ELSE named_struct('millis', CAST(5000000 + event_id AS STRING), 'time', 'x') END, "
            "'FastestLap', named_struct('rank', CAST(event_id % 20 AS STRING), 'AverageSpeed', named_struct('speed', CAST(200 + value AS STRING)))))))"
        ),
        "qualifying": (
            f"to_json(named_struct('qualifying', array(named_struct('Driver', {person}, 'Constructor', {team}, 'position', CAST(event_id % 20 + 1 AS STRING), 'Q1', {LAP_TIME}))))"
        ),
        "lap_times": (
            "CASE WHEN event_id % 2 = 0 THEN to_json(named_struct('laps', array(named_struct('lap', CAST(event_id % 70 AS INT), 'driverId', concat('d', CAST(user_id AS STRING)), 'position', CAST(event_id % 20 AS INT), "
            f"'time', {LAP_TIME})))) ELSE to_json(named_struct('Laps', array(named_struct('number', CAST(event_id % 70 AS STRING), 'Timings', array(named_struct('driverId', concat('d', CAST(user_id AS STRING)), 'position', CAST(event_id % 20 AS STRING), 'time', {LAP_TIME})))))) END"
        ),
        "pit_stops": (
            f"to_json(named_struct('pit_stops', array(named_struct('driverId', concat('d', CAST(user_id AS STRING)), 'stop', '1', 'lap', CAST(event_id % 70 AS STRING), 'time', '14:05:11', 'duration', {LAP_TIME}))))"
        ),
    }
    pairs = ", ".join(f"named_struct('event_type', '{k}', 'data', {v})" for k, v in docs.items())
    return _spread(t.base("events")).select(
        F.expr("CAST(2020 + event_id % 6 AS INT)").alias("season"), F.col("event_id").cast("int").alias("round"),
        F.lit("jolpica").alias("source"), F.expr("concat('circuit', CAST(event_id % 24 AS STRING))").alias("circuit_id"),
        F.expr("CAST(ts AS TIMESTAMP)").alias("fetched_at"), F.explode(F.expr(f"array({pairs})")).alias("x"),
    ).select("season", "round", "source", "x.event_type", "circuit_id", "x.data", "fetched_at")


def live_feed_documents(t: Tables) -> DataFrame:
    """One live feed per event with two cars, one of them with pit stops."""
    return _spread(t.base("events")).select(
        F.expr("CAST(dayofyear(ts) AS INT)").alias("race_id"), F.lit(2024).alias("season"), F.lit(1).alias("series_id"),
        F.expr("CAST(ts AS TIMESTAMP)").alias("snapshot_at"),
        _json(
            "named_struct('lap_number', CAST(event_id % 200 AS INT), 'number_of_race_laps', 200, 'flag_state', CAST(event_id % 10 AS INT), 'vehicles', array("
            "named_struct('vehicle_number', concat(' ', CAST(user_id AS STRING)), 'running_position', 1, 'best_lap_speed', 100 + value, 'delta', CAST(0 AS DOUBLE), "
            "'driver', named_struct('driver_id', CAST(user_id AS INT), 'full_name', concat('D ', CAST(user_id AS STRING))), "
            "'laps_led', array(named_struct('start_lap', 1), named_struct('start_lap', 9)), "
            "'pit_stops', array(named_struct('pit_in_lap_count', 0), named_struct('pit_in_lap_count', CAST(event_id % 50 AS INT)), named_struct('pit_in_lap_count', CAST(event_id % 30 AS INT)))), "
            "named_struct('vehicle_number', '99', 'running_position', 2, 'best_lap_speed', 90 + value, 'delta', value, "
            "'driver', named_struct('driver_id', CAST(user_id + 1000 AS INT), 'full_name', 'Other'), 'laps_led', NULL, 'pit_stops', NULL)))"
        ),
    )


def season_schedule_documents(t: Tables) -> DataFrame:
    """One season schedule per event, two series keys and one other key."""
    race = "named_struct('race_id', CAST(event_id AS STRING), 'race_name', CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('Race at ', event_type) END, 'race_date', CAST(CAST(ts AS DATE) AS STRING), 'scheduled_laps', '300')"
    return _spread(t.base("events")).select(
        _json(f"map('series_1', array({race}), 'series_2', array({race}, named_struct('race_id', CAST(NULL AS STRING), 'race_name', 'x', 'race_date', 'x', 'scheduled_laps', 'x')), 'notes', array({race}))")
    )

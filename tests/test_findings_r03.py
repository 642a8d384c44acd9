"""What the findings of round three asked for."""

import re
from pathlib import Path
from types import SimpleNamespace

import pyarrow.parquet as pq
from pyspark.sql import Row, functions as F

from diamondlap.operators import flatten_mlb as mlb, serve, tendencies as td
from diamondlap.plans import catalog_streaming as cs
from diamondlap.plans.documents import full_game_documents, game_documents, play_documents
from diamondlap.plans.tables import Tables
from diamondlap.sources import landing, sinks, staging
from diamondlap.streaming import feeds as fd, status


def test_a_staged_batch_is_read_by_several_tasks(spark, tmp_path, sf_dir):
    """A batch of one file is one task's work, however many cores there are."""
    seen = []
    stream = cs.staged_stream(Tables(spark, sf_dir), spark.range(5000).withColumn("x", F.repeat(F.lit("x"), 500)), "spread", 3)
    fd.start(stream, str(tmp_path / "out"), lambda batch, epoch: seen.append((batch.select(F.spark_partition_id()).distinct().count(), batch.count()))).awaitTermination()
    assert len(seen) == 3 and sum(n for _, n in seen) == 5000 and all(tasks > 1 for tasks, _ in seen)


def test_a_header_is_read_in_one_pass(spark):
    """One parse gives all fields; odd documents give what single look-ups gave."""
    docs = [
        '{"gamePk": 5, "gameData": {"datetime": {"originalDate": "2024-05-01"}, "status": {"detailedState": "Final"}, "teams": {"away": {"abbreviation": "A"}, "home": {"abbreviation": "H"}}}}',
        '{"gamePk": "6", "gameData": {"datetime": 3, "status": {"detailedState": {"x": 1}}, "teams": {"away": [], "home": {"abbreviation": 7}}}}',
        '[{"gamePk": 8}]', '\n[{"gamePk": 8}]', '{"gamePk": 9, "gameData": {"status"', "", None, '{"gamePk": 4.5}', '{"gamePk": null, "gameData": null}',
    ]
    new = spark.createDataFrame([(d, "t") for d in docs], "data STRING, fetched_at STRING")
    header = landing.game_header(new)
    at = lambda path: F.get_json_object("data", path)
    want = new.select(
        at("$.gamePk").try_cast("int").alias("game_pk"), at("$.gameData.datetime.originalDate").alias("game_date"),
        at("$.gameData.status.detailedState").alias("status"), at("$.gameData.teams.away.abbreviation").alias("away_team"),
        at("$.gameData.teams.home.abbreviation").alias("home_team"), "data", "fetched_at",
    )
    assert [tuple(r) for r in header.collect()] == [tuple(r) for r in want.collect()]
    assert header._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_pitches_and_at_bats_are_not_broadcast(spark):
    """Both grow with the games; the driver would have to hold one of them."""
    p = spark.createDataFrame([(1, 1, "FF")], "game_pk INT, at_bat_index INT, pitch_type_code STRING")
    a = spark.createDataFrame([(1, 1, 5)], "game_pk INT, at_bat_index INT, batter_id INT")
    g = spark.createDataFrame([(1, 2024)], "game_pk INT, season INT")
    joined = td.pitch_context(p, a, g, ["game_pk", "batter_id", "season"])
    lines = [x for x in joined._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in x and "at_bat_index" in x]
    assert len(lines) == 1 and "SortMergeJoin" in lines[0] and joined.collect() == [(1, 5, 2024)]


class Group:
    """State of one group in memory, with a count of the calls for it."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def test_state_is_asked_for_once_per_group_of_games():
    group, now = Group(), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 1000)
    games = status.GameStatus(5)
    games.init(group)
    doc = lambda game, state, at=1.0, digest=0: Row(game_pk=game, status=state, fetched_at=at, digest=digest)
    first = list(games.handleInputRows((0,), iter([doc(i, "Final" if i % 2 else "Live") for i in range(500)] + [doc(0, "Old", 0.5)]), now))
    assert len(first) == 500 and {r["action"] for r in first} == {"inserted"} and group.calls <= 4
    second = {r["game_pk"]: r for r in games.handleInputRows((0,), iter([doc(1, "Live"), doc(2, "Final", 2.0), doc(2, "Live")]), now)}
    assert second[1]["action"] == "skipped" and (second[2]["before"], second[2]["status"], second[2]["status_changed"]) == ("Live", "Final", True)
    games.handleExpiredTimer((0,), now, SimpleNamespace(getExpiryTimeInMs=lambda: group.timers[-1]))
    assert len(group.value[0]) == 249 and set(group.value[1]) == {"Live"}


def largest_method(df, capsys) -> int:
    """Bytes of the longest method that Spark generates for df; the JVM compiles none beyond 8,000."""
    capsys.readouterr()
    df.explain("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)), default=0)


def test_tables_of_many_columns_are_compiled(spark, tmp_path, capsys):
    """Methods that the JVM leaves uncompiled took most of the time of pitches."""
    spark.createDataFrame([(1, "2024-05-01", "{}")], "game_pk INT, game_date STRING, data STRING").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert largest_method(mlb.pitches(docs), capsys) <= 8000
    assert largest_method(mlb.box_batting(docs), capsys) <= 8000
    assert largest_method(mlb.box_pitching(docs), capsys) <= 8000


def test_events_keep_their_place_and_odd_spins(spark):
    """Null events and events that are no pitches count for the place, unreadable spins are missing."""
    event = lambda pitch, spin: f'{{"isPitch": {pitch}, "pitchNumber": 1, "pitchData": {{"breaks": {{"spinRate": {spin}, "spinDirection": "7.9"}}}}}}'
    events = ", ".join(["null", event("false", 5), event("true", '"x"'), event("true", 2100), event("true", '"NaN"'), event("null", 1)])
    data = f'{{"liveData": {{"plays": {{"allPlays": [null, {{"about": {{"atBatIndex": 3}}, "playEvents": [{events}]}}, {{"playEvents": []}}]}}}}}}'
    docs = spark.createDataFrame([(1, None, data), (2, None, None), (3, None, "{")], "game_pk INT, game_date STRING, data STRING")
    rows = mlb.pitches(docs).select("game_pk", "at_bat_index", "pitch_index", "spin_rate", "spin_direction")
    assert sorted(map(tuple, rows.collect())) == [(1, 3, 2, None, 7), (1, 3, 3, 2100, 7), (1, 3, 4, None, 7)]


def test_documents_are_not_written_inside_the_parser(spark, sf_dir):
    """The parser evaluates its argument row by row without compiled code, so the text is a column before."""
    for table in (mlb.at_bats, mlb.pitches, mlb.runners, mlb.fielding_credits):
        plan = table(play_documents(Tables(spark, sf_dir)))._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "from_json" in x and "StructsToJson" in x]


def test_scored_games_are_grouped_where_their_pitches_were_joined(spark):
    """One shuffle of the pitches, by game; game rows need no other, and the rows are those of the other layout."""
    p = spark.createDataFrame(
        [(g, i % 4, i, "FF" if i % 3 else "SL", "S", 90.0, 5) for g in range(30) for i in range(12)] + [(1, None, 7, "FF", "X", None, None)],
        "game_pk INT, at_bat_index INT, pitcher_id INT, pitch_type_code STRING, call_code STRING, start_speed DOUBLE, zone INT",
    ).selectExpr("*", "0 AS spin_rate", "0.5 AS pfx_x", "0.5 AS pfx_z", "95.0 AS launch_speed", "10.0 AS launch_angle", "1 AS batter_id")
    a = spark.createDataFrame([(g, i, g, "P", "single") for g in range(30) for i in (0, 1, 2, 2)], "game_pk INT, at_bat_index INT, batter_id INT, pitcher_name STRING, event_type STRING")
    g = spark.createDataFrame([(k, "2024-05-01", "R", 2024) for k in range(25)], "game_pk INT, game_date STRING, game_type STRING, season INT")
    keys = ["game_pk", "game_date", "pitcher_id", "pitch_type_code"]
    count = lambda by_game: td.load_pitches(p, a, g, by_game=by_game).groupBy(*keys).agg(F.count("zone").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with staging.joined_in_place(spark):
            plan = count(True)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(game_pk") == 3  # pitches, at-bats and games, by no other column
        assert all("game_date" not in x and "at_bat_index" not in x for x in plan.splitlines() if "hashpartitioning" in x)
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
        got = staging.stage_by_game(count(True), "by-game").collect()
        assert sorted(got) == sorted(count(False).collect()) and len(got) > 25
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_game_documents_are_compiled(spark, sf_dir, capsys):
    """The text of a game was made by one method that the JVM leaves uncompiled."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan shows no methods before it is run
    try:
        for docs in (game_documents, full_game_documents):
            assert largest_method(docs(Tables(spark, sf_dir)), capsys) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_parsed_documents_are_written_without_dictionaries(spark, tmp_path):
    """Building one for each of some two hundred columns took a fifth of the time of parsing and writing."""
    raw = spark.createDataFrame([(i, None, f'{{"gameData": {{"game": {{"type": "{"RS"[i % 2]}"}}}}}}') for i in range(2000)], "game_pk INT, game_date STRING, data STRING")
    parsed = mlb.parse(raw)
    encodings = {
        e for file in Path(parsed.path).glob("*.parquet") for meta in [pq.ParquetFile(file).metadata]
        for group in range(meta.num_row_groups) for c in range(meta.num_columns) for e in meta.row_group(group).column(c).encodings
    }
    assert encodings and not [e for e in encodings if "DICTIONARY" in e]
    assert {r[0]: r[1] for r in mlb.games(parsed).groupBy("game_type").count().collect()} == {"R": 1000, "S": 1000}


def sorted_over(df) -> list[int]:
    """The numbers of tasks that a plan shuffles to."""
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\), ", df._jdf.queryExecution().executedPlan().toString())]


class Large(Tables):
    """Tables that take a hundred rows for a task's work."""

    def tasks(self, name):
        return max(-(-self.base(name).count() // 100), 4)


def test_tasks_follow_the_rows_of_a_table(spark, sf_dir, monkeypatch):
    assert Tables(spark, sf_dir).tasks("lineitem") is None
    rows = Tables(spark, sf_dir).base("lineitem").count()
    monkeypatch.setattr("diamondlap.plans.tables.ROWS_OF_A_TASK", 500)
    assert Tables(spark, sf_dir).tasks("lineitem") == -(-rows // 500) > 4
    monkeypatch.setattr("diamondlap.plans.tables.ROWS_OF_A_TASK", rows // 3)
    assert Tables(spark, sf_dir).tasks("lineitem") == 4  # never fewer than the session's


def test_upserts_of_large_tables_are_sorted_in_more_tasks(spark):
    """The session's number of tasks sorted ever larger pieces; a null key is never stored twice nor lost."""
    new = spark.createDataFrame([(i % 70, i) for i in range(300)] + [(None, 1), (None, 2)], "k INT, v INT")
    old = spark.createDataFrame([(i, -1) for i in range(50, 90)] + [(None, -1)], "k INT, v INT")
    many = sinks.upsert(new, old, ["k"], [F.col("v").desc()], 13)
    assert sorted_over(many) and set(sorted_over(many)) == {13}
    want = [(i, 280 + i if i < 20 else 210 + i) for i in range(70)] + [(i, -1) for i in range(70, 90)]
    for got in (many, sinks.upsert(new, old, ["k"], [F.col("v").desc()])):
        rows = [tuple(r) for r in got.collect()]
        assert sorted(r for r in rows if r[0] is not None) == want
        assert sorted(r[1] for r in rows if r[0] is None) == [-1, 2]


def test_scores_of_large_tables_stay_where_their_games_lie(spark, sf_dir):
    """Score rows were sorted, and games of a pitcher's season counted, in the session's number of tasks."""
    tables = Large(spark, sf_dir)
    many = serve.profile(tables.scores)
    assert [n for n in sorted_over(many) if n != 4] == [tables.tasks("lineitem")] and len(sorted_over(many)) == 2
    assert sorted(map(str, many.collect())) == sorted(map(str, serve.profile(Tables(spark, sf_dir).scores).collect()))


def test_the_board_of_large_tables_is_made_in_more_tasks(spark, sf_dir):
    """Pitches, lines and games of the board were sorted in the session's number of tasks."""
    board = lambda t, tasks=None: serve.game_board(t.games.select("game_pk", "status"), t.linescore, t.pitches, t.at_bats, 2, 3, tasks)
    large = Large(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        many = board(large, large.tasks("lineitem"))
        assert set(sorted_over(many)) == {large.tasks("lineitem")}
        assert sorted(map(str, many.collect())) == sorted(map(str, board(Tables(spark, sf_dir)).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

"""What the findings of round four asked for."""

import json
import time
from datetime import datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from diamondlap.operators import pitch_value as pv, tendencies as td
from diamondlap.plans import catalog_streaming as cs, documents as docs
from diamondlap.plans.tables import Tables
from diamondlap.sources import sinks, staging
from diamondlap.streaming import games as live

ITEM = "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE"
ORDER = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderdate TIMESTAMP, o_orderpriority STRING"


@pytest.fixture
def odd_tables(spark, tmp_path):
    """Games with several pitches an at-bat, without any, twice, without a key; pitches without a game or a number."""
    items = [(k, n, 10 * k + n + i, k + i, 3.0 + i, 0.05, 0.02) for k in (1, 2, 97) for n in (1, 2) for i in range(3)]
    items += [(None, 1, 5, 5, 5.0, 0.05, 0.02), (2, None, 6, 6, 6.0, 0.05, 0.02), (1, 1, 11, 1, 3.0, 0.05, 0.02)]
    orders = [(k, 5, "F", datetime(1995, 1, 2), p) for k, p in ((1, "1-URGENT"), (2, "2-HIGH"), (2, "2-HIGH"), (3, "2-HIGH"), (97, None), (None, "5-LOW"))]
    spark.createDataFrame(items, ITEM).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(orders, ORDER).write.parquet(str(tmp_path / "orders.parquet"))
    return Tables(spark, str(tmp_path))


def test_played_documents_gather_items_where_they_lie(spark, odd_tables):
    """F1. Pitches were gathered apart and joined with their at-bats. The documents hold what the views hold."""
    made = docs.played_documents(odd_tables)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "at_bat_index" not in " ".join(x for x in plan.splitlines() if "Join" in x) and plan.count("Exchange hashpartitioning(l_orderkey") == 1
    got = {}
    for r in made.collect():
        doc = json.loads(r["data"])
        plays = doc["liveData"]["plays"].get("allPlays", [])
        got.setdefault(r["game_pk"], []).append(sorted((str(p["about"].get("atBatIndex")), p["matchup"]["batter"].get("id"), len(p.get("playEvents", []))) for p in plays))
    thrown = {(r["game_pk"], r["at_bat_index"]): r["count"] for r in odd_tables.pitches.groupBy("game_pk", "at_bat_index").count().collect() if r["at_bat_index"] is not None}
    at_bats = {}
    for r in odd_tables.at_bats.collect():
        at_bats.setdefault(r["game_pk"], []).append((str(r["at_bat_index"]), r["batter_id"], thrown.get((r["game_pk"], r["at_bat_index"]), 0)))
    assert got == {1: [sorted(at_bats[1])], 2: [sorted(at_bats[2], key=str)] * 2, 3: [[]], 97: [sorted(at_bats[97], key=str)], None: [[]]}
    assert ("None", 14, 0) in [(a, 14, n) for a, _, n in got[2][0]] and got[1][0][0][2] == 4


def test_documents_of_a_running_game_differ_in_the_state_alone(spark, odd_tables):
    """F1. Documents of both polls were built from the items, each."""
    last = docs.played_documents(odd_tables)
    over = F.replace("data", F.lit('"detailedState":"Final"'), F.lit('"detailedState":"In Progress"'))
    first = last.withColumn("data", F.when(F.col("game_pk") % 2 == 0, over).otherwise(F.col("data")))
    want = docs.played_documents(odd_tables, "CASE WHEN game_pk % 2 = 0 THEN 'In Progress' ELSE status END")
    state = lambda df: sorted((str(r["game_pk"]), json.loads(r["data"])["gameData"]["status"]["detailedState"], len(r["data"])) for r in df.collect())
    assert state(first) == state(want) and ("2", "In Progress") in {s[:2] for s in state(first)}


def test_scores_of_games_are_made_where_their_rows_lie(spark):
    """F1. Game rows were written, grouped anew and joined with their means. Both ways give the same."""
    data = [(g, 2024, t, v) for g in (1, 2, None) for t in ("FF", "SL") for v in ((0.1, 0.3, None, -0.2) if t == "FF" else (0.5, None))]
    rows = spark.createDataFrame(data, "game_pk INT, season INT, pitch_type_code STRING, avg_value DOUBLE")
    league = spark.createDataFrame([(1, 0.05), (2, 0.04), (None, 0.03)], "game_pk INT, league_value DOUBLE")
    own = F.when(F.col("game_pk") == 1, 0.05).when(F.col("game_pk") == 2, 0.04).otherwise(0.03)
    window = pv.normalise(rows.repartition(3, "game_pk"), own, scope=("game_pk",))
    assert window._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(str, window.collect())) == sorted(map(str, pv.normalise(rows, league, scope=("game_pk",)).collect()))


def document(pk, state, day="2024-05-01", events=1):
    plays = [{"about": {"atBatIndex": 0}, "matchup": {"pitcher": {"id": 9, "fullName": "Nine"}, "batter": {"id": 20}},
              "playEvents": [{"isPitch": True, "details": {"code": "S", "type": {"code": "FF"}}, "pitchData": {"startSpeed": 90.0}}] * events}]
    return json.dumps({"gamePk": pk, "gameData": {"game": {"type": "R", "season": "2024"}, "datetime": {"originalDate": day}, "status": {"detailedState": state}},
                       "liveData": {"plays": {"allPlays": plays}}})


def batch_of(spark, *made):
    rows = spark.createDataFrame(list(made), "game_pk INT, data STRING")
    return rows.withColumn("fetched_at", F.current_timestamp())


def staged(spark):
    """What the working folder holds."""
    return {p.name for p in Path(staging.work_dir(spark)).glob("*")}


def reference(spark):
    tt = "batter_id INT, pitch_type_code STRING, season INT, pitches_faced BIGINT, whiff_rate DOUBLE, chase_rate DOUBLE, hard_hit_rate DOUBLE, barrel_rate DOUBLE, avg_woba_on_contact DOUBLE, contact_rate DOUBLE, avg_exit_velo DOUBLE, avg_launch_angle DOUBLE"
    sc = "game_pk INT, game_date STRING, season INT, game_type STRING, pitcher_id INT, pitcher_name STRING, pitch_type_code STRING, pitches_thrown BIGINT, avg_value DOUBLE, value_plus DOUBLE, avg_velo DOUBLE, whiff_rate DOUBLE, csw_rate DOUBLE, hard_hit_rate DOUBLE"
    return live.Reference(spark.createDataFrame([(20, "FF", 2023, 50, 0.2, 0.3, 0.4, 0.1, 0.38, 0.7, 88.0, 10.0)], tt), td.linear_weights(spark), spark.createDataFrame([(1, "x", 2023, "R", 9, "Nine", "FF", 60, 0.05, 110.0, 95.0, 0.2, 0.3, 0.35)], sc))


def test_a_batch_leaves_no_working_folders_and_packs_its_texts(spark, tmp_path):
    """F2. Texts lay in the working folder until the application ended, next to those taken and stored, with the parsed documents."""
    out, before = str(tmp_path / "out"), staged(spark)
    live.game_batch(batch_of(spark, *[(i, document(i, "Final", f"2024-05-0{i % 2 + 1}", 5)) for i in range(40)]), 0, out, None)
    assert staged(spark) == before
    kinds = {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for t in ("raw", "taken", "pitches") for f in Path(out).glob(f"{t}/*/*.parquet")}
    assert kinds == {"ZSTD"}
    assert {str(r["part"]): r["count"] for r in spark.read.parquet(f"{out}/in_game").groupBy("part").count().collect()} == {"2024-05-01": 20, "2024-05-02": 20}


def test_scratch_folders_go_with_their_scope(spark):
    """F2. Also when it fails; folders of an outer scope stay until that ends."""
    with staging.scratch(spark):
        outer = staging.stage(spark.range(3), "outer")
        with pytest.raises(ZeroDivisionError), staging.scratch(spark):
            inner = staging.fresh_path(spark, "inner")
            staging.save(spark.range(2), inner)
            raise ZeroDivisionError
        assert not Path(inner).exists() and outer.count() == 3
        path = Path(outer.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent
    assert not path.exists()


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_shuffles_go_when_their_rows_are_written(spark, tmp_path):
    """F3. They lay on disk until the driver collected garbage, some thirty of a batch at a time."""
    before = shuffle_files(spark)
    sinks.overwrite_partitions(spark.range(3000).selectExpr("id % 3 AS part", "id"), str(tmp_path / "t"), ["part"])
    staging.stage(spark.range(1000).groupBy(F.col("id") % 7).count(), "grouped")
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("part").count().filter("count = 1000").count() == 3


def test_rows_of_a_game_need_not_look_up_their_part(spark, tmp_path, reference_tables=("games", "at_bats", "pitches")):
    """F3. Each of nine tables was joined with the places of its games, which are as many as the games."""
    made = [(i, None if i == 5 else f"2024-05-0{i % 3 + 1}", document(i, "Final", events=2), "x") for i in range(6)]
    taken = spark.createDataFrame([(pk, day, "Final", "A", "H", text, None) for pk, day, text, _ in made], live.RAW_SCHEMA)
    asked = []
    real = sinks.replace_scope
    watch = lambda df, path, *a, **k: (asked.append((Path(path).name, df._jdf.queryExecution().optimizedPlan().toString())), real(df, path, *a, **k))[1]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(sinks, "replace_scope", watch)
        live.flatten_games(taken, str(tmp_path / "out"), live.MONTH)
    assert len(asked) >= 10 and not [name for name, plan in asked if name not in ("in_game", "tables_index") and "Join" in plan]
    for table in reference_tables:
        rows = spark.read.schema("game_pk INT, part STRING").parquet(str(tmp_path / "out" / table)).distinct().collect()
        assert {r["game_pk"]: r["part"] for r in rows} == {i: "unknown" if i == 5 else "2024-05" for i in range(6)}


def test_final_games_are_scored_without_working_folders(spark, tmp_path):
    """F3. The rows to be scored were written to the working folder first and stayed there."""
    out, ref = str(tmp_path / "out"), reference(spark)
    before = staged(spark)
    live.game_batch(batch_of(spark, (1, document(1, "Final", events=4)), (2, document(2, "In Progress"))), 0, out, ref)
    assert staged(spark) == before
    scores = spark.read.parquet(f"{out}/scores").collect()
    assert [(s["game_pk"], s["pitches_thrown"]) for s in scores] == [(1, 4)] and "league_value" not in scores[0].asDict()
    assert scores[0]["value_plus"] == pytest.approx(abs(scores[0]["avg_value"]) / 0.05 * 100, abs=0.051)


@pytest.mark.parametrize("sent", [1_000_000, 0])
@pytest.mark.parametrize("few", [16, 0])
def test_stored_texts_give_way_in_all_ways_of_writing(spark, tmp_path, monkeypatch, sent, few):
    """F4. Stored texts were shuffled by game and again by partition, all at once."""
    monkeypatch.setattr(sinks, "SENT_KEYS", sent)
    monkeypatch.setattr(sinks, "FEW_PARTS", few)
    path = str(tmp_path / "t")
    rows = lambda data: spark.createDataFrame(data, "game_pk INT, data STRING, part STRING")
    keys = lambda data: spark.createDataFrame(data, "game_pk INT, part STRING")
    sinks.replace_texts(rows([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "a", "z"), (5, "a", "z")]), path, "part", "game_pk", keys([(i, "x") for i in (1, 2)]))
    untouched = {p: p.stat().st_mtime_ns for p in Path(path).glob("part=z/*.parquet")}
    # 2 moves from x to y, 3 goes, 6 is new; z is not named and stays as it is
    sinks.replace_texts(rows([(2, "b", "y"), (6, "b", "w")]), path, "part", "game_pk", keys([(2, "x"), (2, "y"), (3, "y"), (6, "w")]))
    stored = sorted(tuple(r) for r in spark.read.parquet(path).select("game_pk", "data", "part").collect())
    assert stored == [(1, "a", "x"), (2, "b", "y"), (4, "a", "z"), (5, "a", "z"), (6, "b", "w")]
    assert untouched and untouched == {p: p.stat().st_mtime_ns for p in Path(path).glob("part=z/*.parquet")}
    sinks.replace_texts(rows([]), path, "part", "game_pk", keys([]))
    assert spark.read.parquet(path).count() == 5


def test_stored_texts_are_not_shuffled(spark, tmp_path):
    """F4. One poll of many games shuffled all texts of its years twice."""
    texts = []
    real = sinks.save
    with pytest.MonkeyPatch.context() as m:
        m.setattr(sinks, "save", lambda df, path, *a, **k: (texts.append(df._jdf.queryExecution().executedPlan().toString()) if path.endswith("/raw") else None, real(df, path, *a, **k)))
        for epoch, state in enumerate(("In Progress", "Final")):
            live.store_games(batch_of(spark, *[(i, document(i, state)) for i in range(30)]), epoch, str(tmp_path / "out"), live.YEAR)
    assert len(texts) == 2 and not [p for p in texts if "SortMergeJoin" in p or "REBALANCE" in p]
    moved = [x for p in texts for x in p.splitlines() if "Exchange" in x and "BroadcastExchange" not in x]
    assert len(moved) <= 1  # of the keys, which are made distinct and sent


def test_a_stream_keeps_the_texts_taken_last_only(spark, tmp_path):
    """F4. What every batch took stayed, besides the stored documents. Runs that may be repeated in any order keep theirs."""
    names = lambda out: sorted(p.name for p in (tmp_path / out / "taken").glob("epoch=*"))
    for epoch, state in enumerate(("Preview", "In Progress", "Final")):
        for out, last_only in (("stream", True), ("runs", False)):
            live.store_games(batch_of(spark, (1, document(1, state)), (2, document(2, state))), epoch, str(tmp_path / out), last_only=last_only)
    assert names("stream") == ["epoch=2"] and names("runs") == ["epoch=0", "epoch=1", "epoch=2"]
    for out in ("stream", "runs"):
        changes = live.status_changes(str(tmp_path / out / "report"), spark).collect()
        assert sorted((r["game_pk"], r["epoch"]) for r in changes) == [(pk, e) for pk in (1, 2) for e in (0, 1, 2)]
        assert {r["status"] for r in spark.read.parquet(str(tmp_path / out / "raw")).collect()} == {"Final"}


def test_files_of_a_finished_poll_are_deleted(spark, sf_dir):
    """F4. The files of both polls stayed until the application ended."""
    tables, seen = Tables(spark, sf_dir), []

    def watch(stream):
        out = staging.fresh_path(spark, "seen") if not seen else seen[0]
        seen.append(out)
        return stream.select("game_pk").writeStream.option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start(f"{out}/rows")

    before = staged(spark)
    cs.polled(tables, watch)
    folder = next(Path(staging.work_dir(spark)) / p for p in staged(spark) - before if p.startswith("status-"))
    orders = tables.base("orders").count()
    assert spark.read.parquet(f"{seen[0]}/rows").count() == 2 * orders
    for _ in range(50):
        if spark.read.parquet(str(folder)).count() == orders:
            break
        time.sleep(0.2)
    assert spark.read.parquet(str(folder)).count() == orders

"""Landing of feed documents and reading of schedules.

Documents come from a landing folder; `data` keeps the text as received.
Landing returns the table to store and a report row per incoming document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from diamondlap.functions import codes
from diamondlap.functions.groups import first_per_key, with_keys
from diamondlap.functions.scalars import json_root_is_array, safe_int
from diamondlap.sources import schemas
from diamondlap.sources.staging import stage

RACE_KEYS = ["season", "series_id", "race_id", "endpoint_type"]
ROUND_KEYS = ["season", "round", "source", "event_type"]
BROKEN = "_broken"


def read_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """One row per file: its text, arrival time and name; folder names such as
    season=2025 become columns."""
    return (
        spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "false").text(path, wholetext=True)
        .withColumnRenamed("value", "data")
        .withColumn("fetched_at", F.col("_metadata.file_modification_time"))
        .withColumn("file_name", F.col("_metadata.file_name"))
    )


def game_header(new: DataFrame) -> DataFrame:
    """Header fields of game documents (game_pk optional, data, fetched_at), all from one pass over the text."""
    head = F.from_json("data", f"{schemas.GAME_NAMES}, {BROKEN} STRING", {"columnNameOfCorruptRecord": BROKEN})
    whole = F.when(F.col(f"h.{BROKEN}").isNotNull(), F.try_parse_json("data").isNotNull()).otherwise(F.lit(True))
    sound = ~F.col("data").rlike(r"^\s*\[") & whole  # lists and texts that break off have no header
    pk = F.col("h.gamePk").try_cast("int")
    if "game_pk" in new.columns:
        pk = F.coalesce(F.col("game_pk").cast("int"), pk)
    return new.withColumn("h", head).withColumn("h", F.when(sound, F.col("h"))).select(
        pk.alias("game_pk"), F.col("h.gameData.datetime.originalDate").alias("game_date"),
        F.col("h.gameData.status.detailedState").alias("status"),
        F.col("h.gameData.teams.away.abbreviation").alias("away_team"),
        F.col("h.gameData.teams.home.abbreviation").alias("home_team"), "data", "fetched_at",
    )


def numbered(docs: DataFrame) -> DataFrame:
    """docs with `__id`, one per row, and `__digest` of the text, written once, so that the
    choice between documents can be made without their texts."""
    rows = docs.withColumn("__digest", F.xxhash64("data")).withColumn("__id", F.monotonically_increasing_id())
    return stage(rows, "incoming")


def _newest(rows: DataFrame, keys: Sequence[str], *others: str) -> DataFrame:
    """Keys, id and digest of the newest document per key; equal times fall back to the digest."""
    brief = rows.select(*keys, *others, "fetched_at", "__digest", "__id")
    return first_per_key(brief, keys, [F.col("fetched_at").desc_nulls_last(), F.col("__digest"), F.col("__id")])


def with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of numbered() with the given ids. The shorter list, of those wanted or of the
    others, is sent to the texts; only where both are very long do texts move."""
    wanted, held = ids.count(), rows.count()
    if wanted * 2 <= held:
        return rows.join(sized(ids.select("__id"), wanted), "__id", "left_semi")
    others = stage(rows.select("__id").join(ids.select("__id"), "__id", "left_anti"), "left-out")
    return rows.join(sized(others, held - wanted), "__id", "left_anti")


def sized(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """df with a broadcast hint if it has no more than `most` rows (of a key or two)."""
    return F.broadcast(df) if rows <= most else df


def judge_games(incoming: DataFrame, known: DataFrame, skip_final: bool = True) -> DataFrame:
    """Per game of numbered() documents: the newest one's id and digest, the action and whether the
    status changed. known holds game_pk and status of the stored games, and may hold digest."""
    newest = _newest(incoming.filter(F.col("game_pk").isNotNull()), ["game_pk"], "status")
    digest = F.col("digest") if "digest" in known.columns else F.lit(None).cast("bigint")
    before = known.select("game_pk", F.col("status").alias("__was"), digest.alias("__had"), F.lit(True).alias("__stored"))
    done = F.lit(skip_final) & (F.col("__was") == "Final")
    judged = newest.join(before, "game_pk", "left").withColumn(
        "action",
        F.when(F.col("__stored").isNull(), "inserted")
        .when(F.coalesce(done, F.lit(False)), "skipped").otherwise("updated"),
    )
    changed = (F.col("action") != "skipped") & (F.col("__stored").isNull() | ~F.col("__was").eqNullSafe(F.col("status")))
    return judged.select(
        "game_pk", "action", changed.alias("status_changed"), "__id",
        F.coalesce(F.col("__had") == F.col("__digest"), F.lit(False)).alias("same_text"),
    )


def land_games(new: DataFrame, existing: DataFrame, skip_final: bool = True) -> tuple[DataFrame, DataFrame]:
    """Upsert by game. A stored Final game is left as it is when skip_final.

    The report tells inserted, updated or skipped, and whether the game's
    status is another than the stored one. Texts stay where they were read.
    """
    incoming = numbered(game_header(new))
    judged = stage(judge_games(incoming, existing, skip_final), "judged")
    columns = [c for c in incoming.columns if not c.startswith("__")]
    used = judged.filter(F.col("action") != "skipped")
    taken = with_ids(incoming, used).select(*columns)
    kept = existing.join(sized(used.select("game_pk"), used.count()), "game_pk", "left_anti").select(*columns)
    return kept.unionByName(taken), judged.select("game_pk", "action", "status_changed")


def land_documents(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Upsert by a composite key, newest document last. Texts stay where they were read."""
    incoming = numbered(new)
    newest = stage(_newest(incoming, keys), "newest")
    named = sized(newest.select(*keys), newest.count())
    stored = existing.select(*keys).join(named, list(keys), "left_semi").distinct()
    report = newest.select(*keys).join(stored.withColumn("__stored", F.lit(True)), list(keys), "left").select(
        *keys, F.when(F.col("__stored"), "updated").otherwise("inserted").alias("action")
    )
    kept = existing.join(named, list(keys), "left_anti")
    return kept.select(*new.columns).unionByName(with_ids(incoming, newest).select(*new.columns)), report


def land_races(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    return land_documents(new, existing, RACE_KEYS)


def wrap_records(data) -> F.Column:
    """A bare list is stored as an object holding it."""
    return F.when(json_root_is_array(data), F.concat(F.lit('{"records":'), data, F.lit("}"))).otherwise(F.col(data))


def land_rounds(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    return land_documents(new.withColumn("data", wrap_records("data")), existing, ROUND_KEYS)


def new_documents(new: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents whose key has not been stored yet."""
    return new.join(stored.select(*keys), list(keys), "left_anti")


def _scheduled(docs: DataFrame) -> DataFrame:
    d = F.from_json("data", schemas.SCHEDULE)
    return docs.select(F.explode(d["dates"]).alias("day")).select(
        F.col("day.date").alias("game_date"), F.explode("day.games").alias("g")
    )


def schedule_games(docs: DataFrame, states: Sequence[str] | None = ("Final",)) -> DataFrame:
    """Games of schedule documents in the given states; a game listed on two
    dates is kept once, under the later date."""
    rows = _scheduled(docs).select(
        F.col("g.gamePk").alias("game_pk"), "game_date", F.col("g.status.detailedState").alias("status"),
        F.col("g.teams.away.team.abbreviation").alias("away"), F.col("g.teams.home.team.abbreviation").alias("home"),
        F.col("g.linescore.currentInning").alias("inning"), F.col("g.linescore.inningState").alias("inning_state"),
    )
    if states is not None:
        rows = rows.filter(F.col("status").isin(*states))
    return first_per_key(rows, "game_pk", [F.col("game_date").desc(), F.col("status")])


def schedule_board(docs: DataFrame) -> DataFrame:
    """Every scheduled game with its status class and probable starters; running
    games first, then games to come."""
    state = F.col("g.status.detailedState")
    live, final, preview = (
        F.coalesce(state.isin(*s), F.lit(False))
        for s in (codes.LIVE_STATES, codes.FINAL_STATES, codes.PREVIEW_STATES)
    )
    starter = lambda side: F.when(
        F.col(f"g.teams.{side}.probablePitcher").isNotNull(),
        F.struct(F.col(f"g.teams.{side}.probablePitcher.id").alias("id"),
                 F.col(f"g.teams.{side}.probablePitcher.fullName").alias("name")),
    )
    text = lambda path: F.coalesce(F.col(path), F.lit(""))
    return _scheduled(docs).select(
        F.col("g.gamePk").alias("game_pk"), "game_date", state.alias("status"),
        live.alias("is_live"), final.alias("is_final"), preview.alias("is_preview"),
        F.col("g.teams.away.team.name").alias("away_team"), text("g.teams.away.team.abbreviation").alias("away_abbrev"),
        F.col("g.teams.home.team.name").alias("home_team"), text("g.teams.home.team.abbreviation").alias("home_abbrev"),
        F.coalesce("g.linescore.teams.away.runs", F.lit(0)).alias("away_score"),
        F.coalesce("g.linescore.teams.home.runs", F.lit(0)).alias("home_score"),
        F.col("g.linescore.currentInning").alias("inning"), F.col("g.linescore.inningState").alias("inning_state"),
        starter("away").alias("away_probable"), starter("home").alias("home_probable"),
        F.when(live, 0).when(preview, 1).otherwise(2).alias("board_rank"),
    ).orderBy("board_rank", F.col("game_date").desc(), "game_pk")


def season_races(docs: DataFrame, series: int | None = None) -> DataFrame:
    """Races of season schedules keyed by series_<n>; a race without id is left out."""
    listed = docs.select(F.explode(F.from_json("data", schemas.RACE_SCHEDULE)).alias("key", "list"))
    number = F.regexp_extract("key", r"^series_(\d+)$", 1).try_cast("int")
    rows = listed.select(number.alias("series_id"), F.explode("list").alias("r")).filter(F.col("series_id").isNotNull())
    if series is not None:
        rows = rows.filter(F.col("series_id") == series)
    rid = safe_int("r.race_id")
    return rows.filter(F.coalesce(rid, F.lit(0)) != 0).select(
        "series_id", rid.alias("race_id"),
        F.coalesce("r.race_name", F.concat(F.lit("Race "), rid.cast("string"))).alias("race_name"),
        F.left(F.col("r.race_date"), F.lit(10)).alias("race_date"), "r.track_name",
        safe_int("r.scheduled_laps").alias("scheduled_laps"),
    )


def recent_rounds(schedule: DataFrame, today: str, days: int = 7, stored: DataFrame | None = None) -> DataFrame:
    """Rounds run in the last `days` days whose results are not stored yet."""
    age = F.datediff(F.lit(today).cast("date"), F.col("date").try_cast("date"))
    rows = schedule.filter(age.between(0, days))
    if stored is None:
        return rows
    have = stored.filter(F.col("event_type") == "results").select("season", "round")
    return rows.join(have, ["season", "round"], "left_anti")


def current_race(schedule: DataFrame, snapshots: DataFrame, today: str) -> DataFrame:
    """Newest race up to today that has live data, else the newest one; when all
    races lie ahead, the same over the whole schedule."""
    past = F.col("race_date") <= today
    with_live = with_keys(schedule, snapshots, "race_id").select("race_id").distinct()
    rows = schedule.join(with_live.withColumn("__live", F.lit(True)), "race_id", "left")
    order = [
        F.when(past, 0).otherwise(1), F.when(F.col("__live"), 0).otherwise(1),
        F.col("race_date").desc(), F.col("race_id").desc(),
    ]
    return rows.orderBy(*order).limit(1).drop("__live")


def eastern_date(ts, days_back: int = 0) -> F.Column:
    """ISO date at US Eastern time of a UTC timestamp, optionally days earlier."""
    local = F.to_date(F.from_utc_timestamp(ts, "America/New_York"))
    return F.date_sub(local, days_back).cast("string")

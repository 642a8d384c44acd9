"""Game documents to tables.

`raw` holds game_pk, game_date and the document text in `data`, or is what
parse() made of it. Every table is one select over the parsed document and names
only the part of it that it needs: from text that part alone is parsed, from
parsed documents its columns alone are read. Columns of the document named in `carried`
(game_date) come along with every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from diamondlap.functions.scalars import no_nan, safe_float, safe_int, text_or_null
from diamondlap.sources import schemas
from diamondlap.sources.parsed import ParsedDocuments, merged, write_parsed

Documents = DataFrame | ParsedDocuments

BROKEN = "_broken"
KINDS = ("batting", "pitching", "fielding")


def whole() -> T.StructType:
    """All that any table reads of a document."""
    return merged(
        schemas.GAME_HEADER, schemas.GAME_INNINGS, schemas.GAME_AT_BATS, schemas.GAME_EVENTS, schemas.GAME_RUNNERS,
        schemas.GAME_CREDITS, schemas.GAME_SIDES, schemas.GAME_SUMMARY, *(schemas.game_box(k) for k in KINDS),
    )


def parse(raw: DataFrame) -> ParsedDocuments:
    """Parse each document once, with all that any table reads of it.

    `readable` tells a JSON object from anything else. A field of another type than
    expected is NULL and keeps nothing back; only documents the parser complains of are
    looked at a second time, to tell these from broken ones.
    """
    schema = T.StructType([*whole().fields, T.StructField(BROKEN, T.StringType())])
    rows = raw.select("game_pk", "game_date", "data", F.from_json("data", schema, {"columnNameOfCorruptRecord": BROKEN}).alias("d"))
    sound = F.when(F.col(f"d.{BROKEN}").isNotNull(), F.try_parse_json("data").isNotNull()).otherwise(F.lit(True))
    readable = F.coalesce(F.ltrim("data").startswith("{") & sound, F.lit(False))
    found = rows.select("game_pk", "game_date", readable.alias("readable"), F.struct("d.gameData", "d.liveData").alias("d"))
    return write_parsed(found.withColumn("d", F.when(F.col("readable"), F.col("d"))), ["d"], "games-parsed")


def parsed(raw: Documents, schema: str) -> DataFrame:
    if isinstance(raw, ParsedDocuments):
        return raw.rows("d", schema).filter("readable").select("game_pk", "game_date", "d")
    # Named twice, a text that is itself written by an expression is written before, not row by row inside the parser.
    text = F.when(F.col("data").isNotNull(), F.from_json("data", schema))
    return raw.select("game_pk", "game_date", text.alias("d"))


def rejects(raw: Documents) -> DataFrame:
    """Documents that are not readable JSON objects."""
    if isinstance(raw, ParsedDocuments):
        return raw.rows().filter("not readable").select("game_pk", F.lit("unreadable document").alias("reason"))
    bad = F.try_parse_json("data").isNull() | ~F.ltrim("data").startswith("{")
    return raw.filter(F.col("data").isNull() | bad).select("game_pk", F.lit("unreadable document").alias("reason"))


def fields(root: str, mapping: dict[str, str]) -> list[Column]:
    """Column per output name, read from a path below root."""
    return [F.col(f"{root}.{path}").alias(name) for name, path in mapping.items()]


def games(raw: Documents, *carried: str) -> DataFrame:
    return parsed(raw, schemas.GAME_HEADER).select(
        "game_pk", *dict.fromkeys(["game_date", *carried]),
        *fields("d.gameData", {
            "game_type": "game.type", "status": "status.detailedState",
            "double_header": "game.doubleHeader", "game_number": "game.gameNumber",
            "day_night": "datetime.dayNight",
            "away_team_id": "teams.away.id", "away_team_name": "teams.away.name",
            "away_team_abbrev": "teams.away.abbreviation",
            "home_team_id": "teams.home.id", "home_team_name": "teams.home.name",
            "home_team_abbrev": "teams.home.abbreviation",
            "venue_id": "venue.id", "venue_name": "venue.name",
            "weather_condition": "weather.condition", "weather_wind": "weather.wind",
            "no_hitter": "flags.noHitter", "perfect_game": "flags.perfectGame",
        }),
        safe_int("d.gameData.game.season").alias("season"),
        safe_int("d.gameData.weather.temp").alias("weather_temp"),
        *fields("d.liveData", {
            "scheduled_innings": "linescore.scheduledInnings",
            "away_score": "linescore.teams.away.runs", "home_score": "linescore.teams.home.runs",
            "away_hits": "linescore.teams.away.hits", "home_hits": "linescore.teams.home.hits",
            "away_errors": "linescore.teams.away.errors", "home_errors": "linescore.teams.home.errors",
            "winning_pitcher_id": "decisions.winner.id", "losing_pitcher_id": "decisions.loser.id",
            "save_pitcher_id": "decisions.save.id",
        }),
    )


def plays(raw: Documents, schema: str, *carried: str) -> DataFrame:
    return parsed(raw, schema).select("game_pk", *carried, F.explode("d.liveData.plays.allPlays").alias("play"))


def at_bats(raw: Documents, *carried: str) -> DataFrame:
    return plays(raw, schemas.GAME_AT_BATS, *carried).select("game_pk", *carried, *fields("play", {
        "at_bat_index": "about.atBatIndex", "inning": "about.inning", "half_inning": "about.halfInning",
        "batter_id": "matchup.batter.id", "batter_name": "matchup.batter.fullName",
        "pitcher_id": "matchup.pitcher.id", "pitcher_name": "matchup.pitcher.fullName",
        "bat_side": "matchup.batSide.code", "pitch_hand": "matchup.pitchHand.code",
        "event": "result.event", "event_type": "result.eventType", "description": "result.description",
        "rbi": "result.rbi", "is_scoring_play": "about.isScoringPlay", "has_out": "about.hasOut",
        "captivating_index": "about.captivatingIndex", "balls": "count.balls", "strikes": "count.strikes",
        "outs": "count.outs", "away_score": "result.awayScore", "home_score": "result.homeScore",
    }))


def pitches(raw: Documents, *carried: str) -> DataFrame:
    """Pitch events; pitch_index is the place among all events of the at-bat.

    The columns are too many for one generated method to be compiled by the JVM. Spin is read over a list, which
    keeps Spark from generating one method for all of them."""
    events = plays(raw, schemas.GAME_EVENTS, *carried).select(
        "game_pk", *carried, F.col("play.about.atBatIndex").alias("at_bat_index"),
        F.col("play.matchup.pitcher.id").alias("pitcher_id"), F.col("play.matchup.batter.id").alias("batter_id"),
        F.posexplode("play.playEvents").alias("pitch_index", "e"),
    ).filter(F.col("e.isPitch"))
    spin = F.array("e.pitchData.breaks.spinRate", "e.pitchData.breaks.spinDirection")
    rows = events.select(
        "game_pk", *carried, "at_bat_index", "pitch_index", "pitcher_id", "batter_id",
        *fields("e", {
            "pitch_number": "pitchNumber", "pitch_type_code": "details.type.code",
            "pitch_type_desc": "details.type.description", "call_code": "details.code",
            "call_description": "details.description", "is_strike": "details.isStrike",
            "is_ball": "details.isBall", "is_in_play": "details.isInPlay",
            "zone": "pitchData.zone", "balls_after": "count.balls", "strikes_after": "count.strikes",
            "trajectory": "hitData.trajectory", "hit_hardness": "hitData.hardness",
            "play_id": "playId", "pfx_id": "pfxId",
        }),
        *[no_nan(f"e.{path}").alias(name) for name, path in {
            "start_speed": "pitchData.startSpeed", "end_speed": "pitchData.endSpeed",
            "strike_zone_top": "pitchData.strikeZoneTop", "strike_zone_bottom": "pitchData.strikeZoneBottom",
            "px": "pitchData.coordinates.pX", "pz": "pitchData.coordinates.pZ",
            "pfx_x": "pitchData.coordinates.pfxX", "pfx_z": "pitchData.coordinates.pfxZ",
            "x0": "pitchData.coordinates.x0", "y0": "pitchData.coordinates.y0", "z0": "pitchData.coordinates.z0",
            "vx0": "pitchData.coordinates.vX0", "vy0": "pitchData.coordinates.vY0", "vz0": "pitchData.coordinates.vZ0",
            "ax": "pitchData.coordinates.aX", "ay": "pitchData.coordinates.aY", "az": "pitchData.coordinates.aZ",
            "break_angle": "pitchData.breaks.breakAngle", "break_length": "pitchData.breaks.breakLength",
            "break_y": "pitchData.breaks.breakY", "launch_speed": "hitData.launchSpeed",
            "launch_angle": "hitData.launchAngle", "hit_distance": "hitData.totalDistance",
            "hit_coord_x": "hitData.coordinates.coordX", "hit_coord_y": "hitData.coordinates.coordY",
        }.items()],
        F.transform(spin, lambda x: safe_float(x).cast("int")).alias("__spin"),
    )
    return rows.select(
        *[c for c in rows.columns if c != "__spin"],
        F.get("__spin", F.lit(0)).alias("spin_rate"), F.get("__spin", F.lit(1)).alias("spin_direction"),
    )


def _runner_rows(raw: Documents, schema: str, *carried: str) -> DataFrame:
    return plays(raw, schema, *carried).select(
        "game_pk", *carried, F.col("play.about.atBatIndex").alias("at_bat_index"), F.explode("play.runners").alias("r")
    )


def runners(raw: Documents, *carried: str) -> DataFrame:
    return _runner_rows(raw, schemas.GAME_RUNNERS, *carried).select("game_pk", *carried, "at_bat_index", *fields("r", {
        "play_index": "details.playIndex", "runner_id": "details.runner.id",
        "runner_name": "details.runner.fullName", "start_base": "movement.start", "end_base": "movement.end",
        "out_base": "movement.outBase", "is_out": "movement.isOut", "out_number": "movement.outNumber",
        "event": "details.event", "event_type": "details.eventType",
        "is_scoring_event": "details.isScoringEvent", "rbi": "details.rbi", "earned": "details.earned",
        "team_unearned": "details.teamUnearned", "responsible_pitcher_id": "details.responsiblePitcher.id",
    }))


def fielding_credits(raw: Documents, *carried: str) -> DataFrame:
    return _runner_rows(raw, schemas.GAME_CREDITS, *carried).select("game_pk", *carried, "at_bat_index", F.explode("r.credits").alias("c")).select(
        "game_pk", *carried, "at_bat_index",
        *fields("c", {
            "player_id": "player.id", "position_code": "position.code", "position_name": "position.name",
            "credit": "credit",
        }),
    )


def linescore(raw: Documents, *carried: str) -> DataFrame:
    """Half innings; an absent or empty half gives no row."""
    halves = F.explode(F.array(
        F.struct(F.lit("top").alias("half_inning"), F.col("i.away").alias("h")),
        F.struct(F.lit("bottom").alias("half_inning"), F.col("i.home").alias("h")),
    ))
    rows = parsed(raw, schemas.GAME_INNINGS).select("game_pk", *carried, F.explode("d.liveData.linescore.innings").alias("i")).select(
        "game_pk", *carried, F.col("i.num").alias("inning"), halves.alias("s")
    )
    return rows.select(
        "game_pk", *carried, "inning", "s.half_inning",
        *fields("s.h", {"runs": "runs", "hits": "hits", "errors": "errors", "left_on_base": "leftOnBase"}),
    ).dropna(how="all", subset=["runs", "hits", "errors", "left_on_base"])


def _players(raw: Documents, kind: str, *carried: str) -> DataFrame:
    sides = F.explode(F.array("d.liveData.boxscore.teams.away", "d.liveData.boxscore.teams.home"))
    return (
        parsed(raw, schemas.game_box(kind)).select("game_pk", *carried, sides.alias("side"))
        .select("game_pk", *carried, F.col("side.team.id").alias("team_id"), F.explode("side.players").alias("key", "p"))
        .select(
            "game_pk", *carried, F.col("p.person.id").alias("player_id"), "team_id", F.col("p.battingOrder").alias("slot"),
            "p.stats",
        )
        .filter(F.coalesce(F.col("player_id"), F.lit(0)) != 0)
    )


def _stat_rows(raw: Documents, kind: str, whole: dict[str, str], real: dict[str, str], carried: Sequence[str], *extra: Column) -> DataFrame:
    """One row per player with any stats of the kind. Real numbers are looked up over a list, which keeps Spark
    from generating one method for all look-ups, too long for the JVM to compile."""
    stat = lambda key: F.try_element_at("s", key)
    rows = _players(raw, kind, *carried).withColumn("s", F.col(f"stats.{kind}")).filter(F.size(F.coalesce("s", F.create_map())) > 0)
    rows = rows.select(
        "game_pk", *carried, "player_id", "team_id", *extra,
        *[safe_int(stat(F.lit(k))).alias(n) for n, k in whole.items()],
        F.transform(F.array(*[F.lit(k) for k in real.values()]), lambda k: safe_float(stat(k))).alias("__real"),
    )
    return rows.select(
        *[c for c in rows.columns if c != "__real"], *[F.get("__real", F.lit(i)).alias(n) for i, n in enumerate(real)]
    )


def box_batting(raw: Documents, *carried: str) -> DataFrame:
    slot = (F.substring("slot", 1, 1).try_cast("int") * 100).alias("batting_order")
    return _stat_rows(raw, "batting", {
        "at_bats": "atBats", "runs": "runs", "hits": "hits", "doubles": "doubles", "triples": "triples",
        "home_runs": "homeRuns", "rbi": "rbi", "walks": "baseOnBalls", "intentional_walks": "intentionalWalks",
        "strikeouts": "strikeOuts", "hit_by_pitch": "hitByPitch", "stolen_bases": "stolenBases",
        "caught_stealing": "caughtStealing", "left_on_base": "leftOnBase", "total_bases": "totalBases",
        "ground_into_double_play": "groundIntoDoublePlay", "sac_bunts": "sacBunts", "sac_flies": "sacFlies",
    }, {"avg": "avg", "obp": "obp", "slg": "slg", "ops": "ops"}, carried, slot)


def box_pitching(raw: Documents, *carried: str) -> DataFrame:
    return _stat_rows(raw, "pitching", {
        "hits": "hits", "runs": "runs", "earned_runs": "earnedRuns", "walks": "baseOnBalls",
        "intentional_walks": "intentionalWalks", "strikeouts": "strikeOuts", "home_runs": "homeRuns",
        "hit_batsmen": "hitBatsmen", "wild_pitches": "wildPitches", "pitches_thrown": "pitchesThrown",
        "strikes": "strikes", "balls": "balls", "batters_faced": "battersFaced", "outs": "outs",
        "inherited_runners": "inheritedRunners", "inherited_runners_scored": "inheritedRunnersScored",
        "wins": "wins", "losses": "losses", "saves": "saves", "holds": "holds", "blown_saves": "blownSaves",
        "games_started": "gamesStarted", "complete_games": "completeGames", "shutouts": "shutouts",
    }, {"innings_pitched": "inningsPitched", "era": "era", "whip": "whip"}, carried)


def box_fielding(raw: Documents, *carried: str) -> DataFrame:
    return _stat_rows(raw, "fielding", {
        "assists": "assists", "put_outs": "putOuts", "errors": "errors", "chances": "chances",
        "caught_stealing": "caughtStealing", "passed_balls": "passedBall", "stolen_bases": "stolenBases",
        "pickoffs": "pickoffs",
    }, {"fielding_pct": "fielding"}, carried)


def batting_sides(raw: Documents) -> DataFrame:
    """Posted orders, pitchers and players per game side, for lineups."""
    teams = "d.liveData.boxscore.teams"
    player = lambda k, v: F.struct(v["person"]["fullName"].alias("name"), v["batSide"]["code"].alias("bats"))
    sides = F.explode(F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(f"{teams}.{s}").alias("own"), F.col(f"{teams}.{o}").alias("other"))
        for s, o in (("away", "home"), ("home", "away"))
    ]))
    none = F.array().cast("array<int>")
    pitchers = lambda c: F.coalesce(F.col(c), none)
    return parsed(raw, schemas.GAME_SIDES).select("game_pk", sides.alias("x")).select(
        "game_pk", "x.side", F.col("x.own.battingOrder").alias("batting_order"),
        F.concat(pitchers("x.own.pitchers"), pitchers("x.other.pitchers")).alias("pitchers"),
        # The first listed pitcher of the other side is the starter.
        F.get(F.col("x.other.pitchers"), F.lit(0)).alias("starter_id"),
        F.transform_values("x.own.players", player).alias("players"),
    )


def explore_game(raw: Documents) -> DataFrame:
    """What a stored document holds."""
    all_plays = F.col("d.liveData.plays.allPlays")
    thrown = F.flatten(F.transform(
        F.coalesce(all_plays, F.array()),
        lambda p: F.filter(F.coalesce(p["playEvents"], F.array()), lambda e: F.coalesce(e["isPitch"], F.lit(False))),
    ))
    kinds = F.transform(thrown, lambda e: e["details"]["type"]["code"])
    return parsed(raw, schemas.GAME_SUMMARY).select(
        "game_pk", "game_date", F.col("d.gameData.status.detailedState").alias("status"),
        F.concat_ws(" @ ", "d.gameData.teams.away.abbreviation", "d.gameData.teams.home.abbreviation").alias("matchup"),
        F.col("d.gameData.venue.name").alias("venue"), F.col("d.gameData.weather").alias("weather"),
        F.coalesce(F.size(all_plays), F.lit(0)).cast("bigint").alias("total_at_bats"),
        F.size(thrown).cast("bigint").alias("total_pitches"),
        F.array_sort(F.array_distinct(F.filter(kinds, lambda k: text_or_null(k).isNotNull()))).alias("pitch_types_seen"),
        F.col("d.liveData.linescore.currentInning").alias("current_inning"),
        F.col("d.liveData.decisions").alias("decisions"),
    )


TABLES = {
    "games": games, "at_bats": at_bats, "pitches": pitches, "runners": runners, "linescore": linescore,
    "boxscore_batting": box_batting, "boxscore_pitching": box_pitching, "boxscore_fielding": box_fielding,
    "fielding_credits": fielding_credits,
}


def flatten_mlb(raw: Documents, game_pk: int | None = None) -> dict[str, DataFrame]:
    """All nine tables for one game or for all, and the unreadable documents.

    Documents are parsed once for all of them. One that cannot be read yields no
    rows and one reject; it never stops the others.
    """
    if isinstance(raw, DataFrame):
        raw = parse(raw if game_pk is None else raw.filter(F.col("game_pk") == game_pk))
        game_pk = None
    tables = {**{name: build(raw) for name, build in TABLES.items()}, "rejects": rejects(raw)}
    if game_pk is not None:
        tables = {name: rows.filter(F.col("game_pk") == game_pk) for name, rows in tables.items()}
    return tables

"""Stock-car reads: track profiles, history blends and live projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from diamondlap.functions import codes
from diamondlap.functions.groups import (
    field_stats, first_per_key, index_to_max, join_back, latest, lookup_fallback,
)
from diamondlap.functions.scalars import all_of, half_up, match_text, truthy_or

DEFAULT_FINISH = codes.LEAGUE["finish"]


def _races(races: DataFrame, track: str | None, race: str | None) -> DataFrame:
    return races.filter(all_of([
        match_text("track_name", track) if track is not None else None,
        match_text("race_name", race) if race is not None else None,
    ]))


def _track_rows(results, races, stats, track, race, series, how="inner") -> DataFrame:
    wanted = _races(races, track, race).select("race_id", "track_name")
    rows = results.filter(all_of([
        F.col("finish_position") > 0,
        F.col("series_id") == series if series is not None else None,
    ]))
    return rows.join(wanted, "race_id").join(
        stats.select("race_id", "driver_id", "quality_passes", "green_flag_passes", "green_flag_passed",
                     "quality_pass_differential", "driver_rating"),
        ["race_id", "driver_id"], how,
    )


def _scope(track: str | None) -> list[str]:
    """One named track pools every match; without a name each track stands alone."""
    return ["track_name"] if track is None else []


def track_profile(
    results: DataFrame, races: DataFrame, stats: DataFrame, track: str | None = None,
    race: str | None = None, series: int | None = 1,
) -> DataFrame:
    """Mean results and passing of every driver at a track."""
    mean = lambda c, name: half_up(F.avg(c), 1).alias(name)
    return _track_rows(results, races, stats, track, race, series).groupBy(
        *_scope(track), "driver_name", "manufacturer"
    ).agg(
        mean("finish_position", "avg_finish"),
        mean("start_position", "avg_start"),
        mean(F.col("finish_position") - F.col("start_position"), "avg_pos_gained"),
        mean("quality_passes", "avg_quality_passes"),
        mean("green_flag_passes", "avg_gf_passes"),
        mean("green_flag_passed", "avg_gf_passed"),
        mean("quality_pass_differential", "avg_pass_diff"),
        mean("driver_rating", "avg_rating"),
        F.count(F.lit(1)).cast("bigint").alias("races"),
    )


def manufacturer_index(
    results: DataFrame, races: DataFrame, stats: DataFrame, track: str | None = None,
    race: str | None = None, series: int | None = 1,
) -> DataFrame:
    """Makes against the whole field at 100; a low finish is good, so that index
    is turned over. The field means come from the per-make sums."""
    scope = _scope(track)
    passing = F.col("green_flag_passes").cast("double") / F.nullif(F.col("green_flag_passed"), F.lit(0))
    rows = _track_rows(results, races, stats, track, race, series).withColumn("pass_ratio", passing)
    measures = {"driver_rating": "rating", "finish_position": "finish", "quality_passes": "qp", "pass_ratio": "pass"}
    sums = rows.groupBy(*scope, "manufacturer").agg(
        F.countDistinct("driver_name").cast("bigint").alias("drivers"),
        F.count(F.lit(1)).cast("bigint").alias("entries"),
        *[F.sum(c).cast("double").alias(f"s_{a}") for c, a in measures.items()],
        *[F.count(c).alias(f"n_{a}") for c, a in measures.items()],
    )
    field = sums.groupBy(*scope).agg(*[
        (F.sum(f"s_{a}") / F.nullif(F.sum(f"n_{a}"), F.lit(0))).alias(f"f_{a}") for a in measures.values()
    ])
    own = lambda a: F.col(f"s_{a}") / F.nullif(F.col(f"n_{a}"), F.lit(0))
    out = join_back(sums, field, scope).filter(F.col("manufacturer").isNotNull())
    out = out.select(
        *scope, "manufacturer", "drivers", "entries",
        half_up(own("rating"), 2).alias("avg_rating"), half_up(own("finish"), 1).alias("avg_finish"),
        half_up(own("qp"), 1).alias("avg_qp"), half_up(own("pass"), 3).alias("pass_ratio"),
        *[f"f_{a}" for a in measures.values()],
    )
    plus = lambda a, b: half_up(F.col(a) / F.nullif(F.col(b), F.lit(0.0)) * 100, 1)
    return out.select(
        *scope, "manufacturer", "drivers", "entries",
        "avg_rating", plus("avg_rating", "f_rating").alias("rating_plus"),
        "avg_finish", plus("f_finish", "avg_finish").alias("finish_plus"),
        "avg_qp", plus("avg_qp", "f_qp").alias("qp_plus"),
        "pass_ratio", plus("pass_ratio", "f_pass").alias("pass_ratio_plus"),
    )


SEGMENTS = ("early", "mid", "late")


def lap_segment(lap: Column, edges: Sequence[int] = (30, 100)) -> Column:
    return F.when(lap <= edges[0], "early").when(lap <= edges[1], "mid").otherwise("late")


def lap_segments(
    laps: DataFrame, races: DataFrame, track: str | None = None, race: str | None = None,
    series: int | None = 1, edges: Sequence[int] = (30, 100), min_laps: int = 50,
) -> DataFrame:
    """Mean green-flag speed per driver early, mid and late in the race; a
    segment needs more than min_laps laps."""
    wanted = _races(races, track, race).select("race_id", "track_name")
    rows = laps.filter(all_of([
        F.col("lap_speed") > 100, F.col("lap_number") > 0,
        F.col("series_id") == series if series is not None else None,
    ])).join(wanted, "race_id").withColumn("segment", lap_segment(F.col("lap_number"), edges))
    by = [*_scope(track), "driver_name"]
    wide = rows.groupBy(*by).pivot("segment", list(SEGMENTS)).agg(
        half_up(F.avg("lap_speed"), 3).alias("speed"), F.count(F.lit(1)).alias("laps")
    )
    enough = [F.when(F.col(f"{s}_laps") > min_laps, F.col(f"{s}_speed")).alias(f"lap_{s}") for s in SEGMENTS]
    return wide.select(*by, *enough).dropna(how="all", subset=[f"lap_{s}" for s in SEGMENTS])


def driver_profile(results, races, stats, laps, track=None, race=None, series=1, edges=(30, 100), min_laps=50) -> DataFrame:
    """Track profile with the lap segments attached."""
    by = [*_scope(track), "driver_name"]
    return track_profile(results, races, stats, track, race, series).join(
        lap_segments(laps, races, track, race, series, edges, min_laps), by, "left"
    )


def profile_bars(profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dashboard arithmetic: rating against the best, passing efficiency from 0
    to 100, speed lost from early to late and the bands they fall in."""
    out = index_to_max(profile, "avg_rating", by, "rating_pct")
    efficiency = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("avg_pass_diff") + 20) / 50 * 100))
    drop = half_up(F.col("lap_early") - F.col("lap_late"), 2)
    return out.withColumns({
        "rating_pct": half_up("rating_pct", 4),
        "pass_efficiency": F.when(F.col("avg_pass_diff").isNotNull(), half_up(efficiency, 4)),
        "pass_band": F.when(F.col("avg_pass_diff") > 5, "good").when(F.col("avg_pass_diff") > -5, "even")
        .when(F.col("avg_pass_diff").isNotNull(), "poor"),
        "drop_off": F.when(F.col("lap_mid").isNotNull(), drop),
    }).withColumn(
        "drop_band",
        F.when(F.col("drop_off") < 1, "low").when(F.col("drop_off") > 2, "high")
        .when(F.col("drop_off").isNotNull(), "medium"),
    )


def history_blend(
    entries: DataFrame, results: DataFrame, races: DataFrame, same_from: int = 2023, recent_from: int = 2024,
) -> DataFrame:
    """Expected finish and running position of every entry (race_id,
    driver_name) from the driver's other races: at the track, on the type of
    track, and anywhere.

    Each history is summed once per driver over all races and the entry's own
    race is taken off again, so all races are served by three key joins instead
    of a pass per race.
    """
    past = results.filter(F.col("finish_position") > 0).select(
        "race_id", "driver_name", "finish_position", "avg_position"
    ).join(races.select("race_id", "season", "track_name", "track_type"), "race_id")

    def sums(keys, since, tag):
        return past.filter(F.col("season") >= since).dropna(subset=keys).groupBy(*keys).agg(
            F.sum("finish_position").cast("double").alias(f"fs_{tag}"),
            F.count(F.lit(1)).alias(f"n_{tag}"),
            F.sum("avg_position").alias(f"rs_{tag}"),
            F.count("avg_position").alias(f"rn_{tag}"),
        )

    meta = races.select("race_id", "track_name", "track_type", "season")
    own = past.groupBy("race_id", "driver_name").agg(
        F.sum("finish_position").cast("double").alias("fs_own"), F.count(F.lit(1)).alias("n_own"),
        F.sum("avg_position").alias("rs_own"), F.count("avg_position").alias("rn_own"),
    )
    rows = (
        entries.select("race_id", "driver_name").distinct()
        .join(meta, "race_id", "left")
        .join(own, ["race_id", "driver_name"], "left")
        .join(sums(["track_name", "driver_name"], same_from, "st"), ["track_name", "driver_name"], "left")
        .join(sums(["track_type", "driver_name"], recent_from, "ty"), ["track_type", "driver_name"], "left")
        .join(sums(["driver_name"], recent_from, "all"), "driver_name", "left")
    )
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    cols = {}
    for tag, since, key in (("st", same_from, "track_name"), ("ty", recent_from, "track_type"), ("all", recent_from, None)):
        counted = (F.col("season") >= since) if key is None else (F.col("season") >= since) & F.col(key).isNotNull()
        less = lambda c: zero(f"{c}_{tag}") - F.when(counted, zero(f"{c}_own")).otherwise(0.0)
        cols[f"{tag}_races"] = less("n")
        cols[f"{tag}_finish"] = less("fs") / F.nullif(less("n"), F.lit(0.0))
        cols[f"{tag}_run"] = less("rs") / F.nullif(less("rn"), F.lit(0.0))
    rows = rows.select("race_id", "driver_name", *[c.alias(n) for n, c in cols.items()])

    finish, run = _blended()
    known = (F.col("st_races") + F.col("ty_races") + F.col("all_races")) > 0
    return rows.filter(known).select(
        "race_id", "driver_name",
        finish.alias("hist_avg_finish"),
        run.alias("hist_avg_running"),
        *[F.col(f"{tag}_races").cast("bigint").alias(name) for tag, name in HISTORY_COUNTS.items()],
    )


def race_history(results: DataFrame, races: DataFrame, race_id: int, same_from: int = 2023, recent_from: int = 2024) -> DataFrame:
    """The same blend for one race and every driver with any history: three
    aggregates over the other races, joined in full on the driver."""
    meta = races.filter(F.col("race_id") == race_id).select(
        F.col("track_name").alias("__track"), F.col("track_type").alias("__type")
    ).limit(1)
    past = join_back(
        results.filter((F.col("finish_position") > 0) & (F.col("race_id") != race_id))
        .select("race_id", "driver_name", "finish_position", "avg_position")
        .join(races.select("race_id", "season", "track_name", "track_type"), "race_id"),
        meta, (),
    )

    def mean(rows, tag):
        return rows.groupBy("driver_name").agg(
            F.avg("finish_position").alias(f"{tag}_finish"), F.avg("avg_position").alias(f"{tag}_run"),
            F.count(F.lit(1)).alias(f"{tag}_n"),
        )

    recent = past.filter(F.col("season") >= recent_from)
    same = past.filter((F.col("season") >= same_from) & (F.col("track_name") == F.col("__track")))
    kind = recent.filter(F.col("track_type") == F.col("__type"))
    rows = (
        mean(recent, "all").join(mean(kind, "ty"), "driver_name", "full_outer")
        .join(mean(same, "st"), "driver_name", "full_outer")
    )
    finish, run = _blended()
    rows = rows.withColumns({f"{tag}_races": F.coalesce(f"{tag}_n", F.lit(0)) for tag in ("st", "ty", "all")})
    return rows.select(
        F.lit(race_id).alias("race_id"), "driver_name", finish.alias("hist_avg_finish"), run.alias("hist_avg_running"),
        *[F.col(f"{tag}_races").cast("bigint").alias(name) for tag, name in HISTORY_COUNTS.items()],
    )


HISTORY_COUNTS = {"st": "same_track_races", "ty": "same_type_races", "all": "all_track_races"}


def _blended() -> tuple[Column, Column]:
    """Expected finish and running position from the three histories."""
    default = F.lit(DEFAULT_FINISH)
    st, ty, al = F.col("st_finish"), F.col("ty_finish"), F.col("all_finish")
    finish = _blend(st, F.coalesce(ty, al, default), ty, F.coalesce(al, default))
    run = _blend(
        F.coalesce("st_run", st),
        F.coalesce(F.col("ty_run"), ty, al, default),
        F.coalesce(F.col("ty_run"), ty),
        F.coalesce(F.col("all_run"), al, default),
    )
    return truthy_or(finish, DEFAULT_FINISH), truthy_or(run, DEFAULT_FINISH)


def _blend(same: Column, kind_or_all: Column, kind: Column, anywhere: Column) -> Column:
    return (
        F.when(F.col("st_races") >= 2, same * 0.50 + kind_or_all * 0.30 + anywhere * 0.20)
        .when(F.col("ty_races") >= 3, kind * 0.65 + anywhere * 0.35)
        .otherwise(anywhere)
    )


def speed_variance(snapshots: DataFrame) -> DataFrame:
    """Spread of a driver's lap speeds over the polls of a race, after lap 5."""
    return snapshots.filter((F.col("last_lap_speed") > 0) & (F.col("lap") > 5)).groupBy("race_id", "driver_name").agg(
        half_up(F.stddev_samp("last_lap_speed"), 3).alias("speed_stddev"),
        half_up(F.avg("last_lap_speed"), 3).alias("speed_avg"),
        F.count(F.lit(1)).cast("bigint").alias("lap_samples"),
    )


def _field(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = rows.withColumn("__speed", F.nullif(F.col("best_lap_speed").cast("double"), F.lit(0.0)))
    return field_stats(rows, by, "__speed")


def _position_score(rows_p: Column, current: Column, weight: Column, finish: Column, running: Column) -> Column:
    """Weighted position plus up to five places for being off the best speed."""
    left = 1 - rows_p
    gap = (F.col("__speed") - F.col("field_best")) / F.col("field_best")
    return (
        current * weight + finish * (left * 0.4) + running * (left * 0.3)
        + F.coalesce(gap * 5 * left, F.lit(0.0))
    )


def live_projection(
    snapshots: DataFrame, history: DataFrame, variance: DataFrame, races: DataFrame,
    default_laps: int = codes.LEAGUE["race_laps"],
) -> DataFrame:
    """Projected finishing order of every race from its newest snapshot.

    Position counts more as laps go by, history less; fresh tyres gain places
    and old ones lose them. `history` and `variance` are per race and driver.
    """
    meta = races.select(
        "race_id", "track_name", "track_type",
        F.coalesce(F.nullif("actual_laps", F.lit(0)), F.nullif("scheduled_laps", F.lit(0))).alias("__laps"),
    )
    rows = _field(latest(snapshots, "race_id", "snapshot_at"), ["race_id"])
    rows = (
        rows.join(meta, "race_id", "left")
        .join(history, ["race_id", "driver_name"], "left")
        .join(variance, ["race_id", "driver_name"], "left")
    )
    total = F.coalesce(F.col("__laps"), F.nullif(F.col("total_laps"), F.lit(0)), F.lit(default_laps))
    lap = F.coalesce(F.col("lap"), F.lit(0))
    rows = rows.withColumns({
        "race_laps": total,
        "p": F.when(lap < 5, 0.0).otherwise(F.least(F.lit(1.0), lap / total)),
        "current_position": F.coalesce(F.nullif("position", F.lit(0)).cast("bigint"), F.col("field_size")),
    })
    p, now, age = F.col("p"), F.col("current_position").cast("double"), F.col("tire_age")
    weight = F.when(p >= 0.8, 0.85 + (p - 0.8) / 0.2 * 0.13).otherwise(0.3 + p * 0.55)
    tyres = (
        F.when(age <= 20, (1 - age / 20) * -1.5 * (1 - p))
        .when(age >= 50, F.least(F.lit(1.0), (age - 50) / 40) * 2.0 * (1 - p))
        .otherwise(0.0)
    )
    score = _position_score(
        p, now, weight, F.coalesce(F.col("hist_avg_finish"), now),
        F.coalesce(F.col("hist_avg_running"), F.col("hist_avg_finish"), now),
    ) + tyres
    score = F.greatest(F.lit(1.0), F.least(F.col("field_size").cast("double"), score))
    rows = rows.withColumn("projected_score", half_up(score, 1))
    field = Window.partitionBy("race_id").orderBy("projected_score", "current_position", "driver_name")  # a few dozen cars
    ranked = rows.withColumn("projected_finish", F.row_number().over(field))
    return ranked.select(
        "race_id", "track_name", "track_type", "snapshot_at", "lap", F.col("race_laps").alias("total_laps"),
        half_up(p * 100, 1).alias("race_pct"),
        "driver_name", "car_number", "manufacturer", "current_position", "projected_score", "projected_finish",
        "laps_completed", "laps_led", "last_lap_speed", "best_lap_speed", "pit_stops",
        F.nullif("delta_leader", F.lit(0.0)).alias("delta_leader"),
        "hist_avg_finish", F.col("hist_avg_finish").isNotNull().alias("has_history"),
        F.coalesce("same_track_races", F.lit(0)).cast("bigint").alias("same_track_races"),
        F.coalesce("same_type_races", F.lit(0)).cast("bigint").alias("same_type_races"),
        "tire_age", "last_pit_lap", "speed_stddev", F.coalesce("lap_samples", F.lit(0)).cast("bigint").alias("lap_samples"),
    )


def track_history(
    results: DataFrame, races: DataFrame, stats: DataFrame, track: str | None = None, race: str | None = None,
) -> DataFrame:
    """Baselines per driver, kept also for drivers without loop statistics."""
    rows = _track_rows(results, races, stats, track, race, None, "left")
    return rows.groupBy(*_scope(track), "driver_name", "driver_id").agg(
        half_up(F.avg("finish_position"), 2).alias("hist_avg_finish"),
        half_up(F.avg("avg_position"), 2).alias("hist_avg_running"),
        half_up(F.avg("driver_rating"), 2).alias("hist_rating"),
    )


def poll_projection(snapshot: DataFrame, history: DataFrame) -> DataFrame:
    """Projection printed at each poll: no tyres, late-race or early-lap rule.
    `snapshot` is one poll of one or more races; history by id, else by name."""
    poll = ["race_id", "snapshot_at"]
    values = ["hist_avg_finish", "hist_avg_running", "hist_rating"]
    order = [F.col("hist_avg_finish").asc_nulls_last(), F.col("driver_name"), F.col("driver_id")]
    by_id = first_per_key(history.filter(F.col("driver_id").isNotNull()), "driver_id", order)
    by_name = first_per_key(history.filter(F.col("driver_name").isNotNull()), "driver_name", order)
    rows = lookup_fallback(_field(snapshot, poll), by_id, by_name, "driver_id", "driver_name", values)
    field = F.col("field_size").cast("double")
    total = F.nullif(F.col("total_laps"), F.lit(0))
    rows = rows.withColumns({
        "p": F.coalesce(F.coalesce(F.col("lap"), F.lit(0)) / F.when(total > 0, total), F.lit(0.0)),
        "current_position": F.coalesce(F.nullif("position", F.lit(0)).cast("bigint"), F.col("field_size")),
        "hist_avg_finish": F.nullif("hist_avg_finish", F.lit(0.0)),
    })
    p, now = F.col("p"), F.col("current_position").cast("double")
    finish = F.coalesce(F.col("hist_avg_finish"), field / 2)
    running = F.coalesce(F.nullif("hist_avg_running", F.lit(0.0)), finish)
    score = _position_score(p, now, 0.3 + p * 0.55, finish, running)
    return rows.select(
        *poll, "driver_id", "driver_name", "car_number", "manufacturer", "current_position", "laps_completed",
        "laps_led", "best_lap_speed", "last_lap_speed", "pit_stops",
        half_up(F.greatest(F.lit(1.0), F.least(field, score)), 1).alias("projected_finish"),
        "hist_avg_finish", F.nullif("hist_rating", F.lit(0.0)).alias("hist_rating"),
        half_up(p * 100, 1).alias("race_pct"), "lap", "total_laps",
    )


def confidence(projection: DataFrame) -> DataFrame:
    """How far to trust a projection, 0 to 95."""
    steady = F.when(
        F.col("speed_stddev").isNotNull() & (F.col("lap_samples") > 10),
        F.greatest(F.lit(0.0), F.least(F.lit(35.0), (6 - F.col("speed_stddev")) * 7)),
    ).otherwise(0.0)
    points = (
        F.col("race_pct") / 100 * 40
        + F.when(F.col("hist_avg_finish").isNotNull(), 15.0).otherwise(0.0)
        + steady
        + F.when(F.col("delta_leader") < 5, 10.0).otherwise(0.0)
    )
    return projection.withColumn("confidence", half_up(F.least(F.lit(95.0), points), 4))

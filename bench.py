"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from diamondlap.plans.catalog import QUERIES

HEADLINE = (
    "a01_pitch_type_tendencies", "a02_zone_tendencies", "m01_pitch_value", "a04_season_scores",
    "a06_leaderboard", "a08_season_compare", "a09_game_log", "a14_live_pitcher_scores", "a16_pitch_mix",
    "m03_lineup_strikeouts", "m04_batter_vs_pitcher", "m05_snapshot_projections", "a18_grading_overall",
    "m07_marcel", "a20_track_profile", "a21_manufacturer_index", "a22_lap_segments", "a23_history_blend",
    "m08_live_projection", "t03_pitches", "t13_laps", "q10_verdict", "m11_ridge_models",
    "w10_rolling_scores_30_days",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a06_leaderboard"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

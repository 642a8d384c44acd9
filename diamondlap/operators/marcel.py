"""Three-season weighted projection regressed to the league."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from diamondlap.functions.groups import join_back
from diamondlap.functions.scalars import half_up, truthy_or

# --- fixed values: projected rates -> (output name, scale, digits) -----------
RATES = {
    "k_pct": ("proj_k_pct", 100, 1),
    "bb_pct": ("proj_bb_pct", 100, 1),
    "fip": ("proj_fip", 1, 2),
    "era": ("proj_era", 1, 2),
    "siera": ("proj_siera", 1, 2),
}


def weighted_rates(season_pitching: DataFrame, season: int | None = None, min_ip: float = 10, weights: Sequence[int] = (5, 4, 3)) -> DataFrame:
    """Rates weighted by season recency and innings, per player and projected
    season. Each season row counts towards the next len(weights) seasons, so all
    seasons are projected in one aggregation."""
    rows = season_pitching.filter(F.col("ip") >= min_ip).withColumn("player", F.lower("player_name"))
    ahead = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("lag"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)]))
    rows = rows.withColumn("a", ahead).withColumn("projected_season", (F.col("season") + F.col("a.lag")).cast("int"))
    if season is not None:
        rows = rows.filter(F.col("projected_season") == season)
    w, ip = F.col("a.w"), F.col("ip")
    return rows.groupBy("player", "projected_season").agg(
        *[(F.sum(F.col(c) * w * ip) / F.nullif(F.sum(w * ip), F.lit(0.0))).alias(f"w_{c}") for c in RATES],
        (F.sum(ip * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("w_ip"),
        F.sum(w * ip).alias("total_weight"),
    )


def league_rates(season_pitching: DataFrame, min_ip: float = 50) -> DataFrame:
    return season_pitching.filter(F.col("ip") >= min_ip).groupBy(
        (F.col("season") + 1).cast("int").alias("projected_season")
    ).agg(*[F.avg(c).alias(f"lg_{c}") for c in RATES])


def marcel(
    season_pitching: DataFrame, season: int | None = None, min_ip: float = 10, league_min_ip: float = 50,
    weights: Sequence[int] = (5, 4, 3), regress: float = 200,
) -> DataFrame:
    """Projection of every pitcher for one season or for all of them. Players
    without a strikeout rate to weigh are left out."""
    rows = join_back(
        weighted_rates(season_pitching, season, min_ip, weights),
        F.broadcast(league_rates(season_pitching, league_min_ip)),  # one row per season
        "projected_season",
    ).filter(truthy_or("w_k_pct", None).isNotNull())
    r = F.when(F.col("total_weight") > 0, 1 - regress / (F.col("w_ip") + regress)).otherwise(0.0)
    return rows.select(
        "player", "projected_season",
        *[
            half_up((r * F.col(f"w_{c}") + (1 - r) * F.col(f"lg_{c}")) * scale, d).alias(out)
            for c, (out, scale, d) in RATES.items()
        ],
        half_up(r, 3).alias("reliability"),
    )


def with_score_context(projected: DataFrame, sc: DataFrame, names: DataFrame) -> DataFrame:
    """Add id, prior-season mean score and pitch count through the player name."""
    context = sc.filter(F.col("game_type") == "R").groupBy(
        "pitcher_id", (F.col("season") + 1).cast("int").alias("projected_season")
    ).agg(
        half_up(F.avg("value_plus"), 1).alias("prior_value_plus"),
        F.sum("pitches_thrown").cast("bigint").alias("prior_pitches"),
    )
    ids = names.select("pitcher_id", F.lower("pitcher_name").alias("player"))
    return projected.join(ids, "player", "left").join(context, ["pitcher_id", "projected_season"], "left")


def pitcher_season_by_name(season_pitching: DataFrame, names: DataFrame, season: int | None = None, id_map: DataFrame | None = None) -> DataFrame:
    """Season rows with the pitch feed's id: through the id map when the row has
    one, else by lower-cased name."""
    rows = season_pitching if season is None else season_pitching.filter(F.col("season") == season)
    by_name = names.select(F.col("pitcher_id").alias("__by_name"), F.lower("pitcher_name").alias("__name"))
    out = rows.join(by_name, F.lower(F.col("player_name")) == F.col("__name"), "left")
    found = F.col("__by_name")
    if id_map is not None:
        ids = id_map.filter(F.col("fangraphs_id").isNotNull()).groupBy("fangraphs_id").agg(F.min("mlbam_id").alias("__by_id"))
        out = out.join(ids, F.col("fg_id").try_cast("int") == F.col("fangraphs_id"), "left")
        found = F.coalesce("__by_id", "__by_name")
    return out.select(found.alias("pitcher_id"), *rows.columns).filter(F.col("pitcher_id").isNotNull())

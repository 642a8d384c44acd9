"""How a pitch metric relates to season outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from diamondlap.functions.scalars import half_up, safe_corr


def validation_corr(
    metric: DataFrame, outcomes: DataFrame, metrics: Sequence[str], against: Sequence[str],
    lag: int = 0, min_pitches: int | None = None, min_ip: float | None = None,
) -> DataFrame:
    """Correlation of every metric with every outcome, same season (lag 0) or
    the metric of one season with the outcome `lag` seasons later.

    Both sides hold pitcher_id and season; `metric` may hold pitches and
    `outcomes` ip for the volume limits.
    """
    m = metric if min_pitches is None else metric.filter(F.col("pitches") >= min_pitches)
    o = outcomes if min_ip is None else outcomes.filter(F.col("ip") >= min_ip)
    m = m.select("pitcher_id", (F.col("season") + lag).cast("int").alias("season"), *[F.col(c).alias(f"m_{c}") for c in metrics])
    o = o.select("pitcher_id", "season", *[F.col(c).alias(f"o_{c}") for c in against])
    pairs = [(a, b) for a in metrics for b in against]
    one = m.join(o, ["pitcher_id", "season"]).agg(*[
        F.struct(
            F.lit(a).alias("metric"), F.lit(b).alias("outcome"),
            half_up(safe_corr(f"m_{a}", f"o_{b}"), 3).alias("pearson"),
            F.count(F.when(F.col(f"m_{a}").isNotNull() & F.col(f"o_{b}").isNotNull(), 1)).cast("bigint").alias("n"),
        ).alias(f"c{i}") for i, (a, b) in enumerate(pairs)
    ])
    return one.select(F.explode(F.array(*[f"c{i}" for i in range(len(pairs))])).alias("c")).select("c.*")


def season_metric(sc: DataFrame) -> DataFrame:
    """Pitcher season score, weighted by pitches thrown, for validation."""
    return sc.filter(F.col("game_type") == "R").groupBy("pitcher_id", "season").agg(
        F.sum("pitches_thrown").cast("bigint").alias("pitches"),
        (F.sum(F.col("value_plus") * F.col("pitches_thrown")) / F.nullif(F.sum("pitches_thrown"), F.lit(0))).alias("value_plus"),
    )

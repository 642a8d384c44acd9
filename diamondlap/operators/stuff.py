"""Pitch-quality model: one ridge regression per pitch type on six features.

The regression needs only sums (counts, feature and target sums and their
products), which Spark adds up per type and fold in one aggregation. The solving
of each 6 x 6 system and the R2 of any rows follow from those sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from diamondlap.functions import codes
from diamondlap.functions.groups import join_back
from diamondlap.functions.scalars import all_of, half_up, one_if, rate, ratio
from diamondlap.operators.tendencies import pitch_context

FEATURES = ("velo_z", "hmov_z", "vmov_z", "spin_z", "break_z", "release_consistency_z")
TARGET = "csw_rate"
ALPHA = 5.0
FOLDS = 5


def stuff_features(
    pitches: DataFrame, at_bats: DataFrame, games: DataFrame, seasons: Sequence[int] | None = None,
    min_pitches: int = 100,
) -> DataFrame:
    """Pitcher x type x calendar year averages of measured pitches."""
    measured = ("start_speed", "pfx_x", "pfx_z", "spin_rate", "x0", "z0")
    year = F.year(F.to_date("game_date"))
    rows = pitch_context(
        pitches, at_bats, games,
        ["pitcher_id", "pitch_type_code", year.alias("season"), "call_code", "bat_side", "pitch_hand", *measured],
        games_where=None if seasons is None else year.isin(*seasons),
        at_bats_where=F.col("bat_side").isNotNull(),
        pitches_where=F.col("pitch_type_code").isin(*codes.PITCH_TYPES) & all_of([F.col(c).isNotNull() for c in measured]),
    )
    call = F.col("call_code")
    same = F.col("bat_side") == F.col("pitch_hand")
    csw = call.isin(*codes.CSW)
    # Called and swinging strikes per pitch thrown within each platoon split.
    split = lambda side: F.avg(F.when(side, one_if(csw)))
    return (
        rows.groupBy("pitcher_id", "pitch_type_code", "season")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("pitches"),
            F.avg("start_speed").alias("avg_velo"), F.stddev_samp("start_speed").alias("std_velo"),
            F.avg("pfx_x").alias("avg_hmov"), F.avg("pfx_z").alias("avg_vmov"), F.avg("spin_rate").alias("avg_spin"),
            F.avg("x0").alias("avg_x0"), F.avg("z0").alias("avg_z0"),
            F.stddev_samp("x0").alias("std_x0"), F.stddev_samp("z0").alias("std_z0"),
            F.avg(F.sqrt(F.col("pfx_x") * F.col("pfx_x") + F.col("pfx_z") * F.col("pfx_z"))).alias("avg_break_total"),
            rate(csw).alias("csw_rate"),
            ratio(call.isin(*codes.WHIFF), call.isin(*codes.SWING)).alias("whiff_rate"),
            rate(same).alias("same_hand_pct"),
            split(same).alias("csw_same_hand"), split(~same).alias("csw_opp_hand"),
        )
        .filter(F.col("pitches") >= min_pitches)
    )


def csw_by_type(features: DataFrame) -> DataFrame:
    return features.groupBy("pitch_type_code").agg(F.avg("csw_rate").alias("csw_rate"))


def zscore(df: DataFrame, by: Sequence[str], cols: dict[str, str], zero_std_is_one: Sequence[str] = ()) -> DataFrame:
    """Add z-scores within groups (sample deviation) under the mapped names.
    Group statistics are aggregated and joined back."""
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols]
    )
    out = join_back(df, stats, by)
    z = {}
    for c, name in cols.items():
        sd = F.col(f"__s_{c}")
        sd = F.when(sd == 0, 1.0).otherwise(sd) if c in zero_std_is_one else F.nullif(sd, F.lit(0.0))
        z[name] = (F.col(c) - F.col(f"__m_{c}")) / sd
    return out.select(*df.columns, *[e.alias(n) for n, e in z.items()])


def engineer(features: DataFrame) -> DataFrame:
    """Features relative to the pitch type, over whatever rows are given."""
    steady = 1 / (F.coalesce("std_x0", F.lit(0.1)) + F.coalesce("std_z0", F.lit(0.1)) + 0.01)
    return zscore(
        features.withColumn("release_consistency", steady), ["pitch_type_code"],
        {
            "avg_velo": "velo_z", "avg_hmov": "hmov_z", "avg_vmov": "vmov_z", "avg_spin": "spin_z",
            "avg_break_total": "break_z", "release_consistency": "release_consistency_z",
        },
        zero_std_is_one=("release_consistency",),
    )


def _usable(features: DataFrame) -> DataFrame:
    return features.dropna(subset=[*FEATURES, TARGET])


PRODUCTS = list(combinations_with_replacement([*FEATURES, TARGET], 2))
SUMS = ["n", *[f"s_{c}" for c in (*FEATURES, TARGET)], *[f"p_{a}__{b}" for a, b in PRODUCTS]]


def gram(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, sums and products of features and target per group."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(c).alias(f"s_{c}") for c in (*FEATURES, TARGET)],
        *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}__{b}") for a, b in PRODUCTS],
    )


def _moments(row) -> tuple:
    """n, means, product matrix of the features, products with the target, and
    the target's own sum and sum of squares."""
    k = len(FEATURES)
    xx = np.zeros((k, k))
    for i, a in enumerate(FEATURES):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = row[f"p_{a}__{FEATURES[j]}"]
    x = np.array([row[f"s_{c}"] for c in FEATURES])
    xy = np.array([row[f"p_{c}__{TARGET}"] for c in FEATURES])
    return row["n"], x, xx, xy, row[f"s_{TARGET}"], row[f"p_{TARGET}__{TARGET}"]


def solve_ridge(row, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights on the unscaled features, for features scaled to
    unit population deviation before an unpenalised-intercept ridge."""
    n, x, xx, xy, y, _ = _moments(row)
    mean, ybar = x / n, y / n
    cov = xx / n - np.outer(mean, mean)
    scale = np.sqrt(np.clip(np.diag(cov), 0, None))
    scale[scale == 0] = 1.0
    left = n * cov / np.outer(scale, scale) + alpha * np.eye(len(mean))
    right = n * (xy / n - mean * ybar) / scale
    w = np.linalg.solve(left, right) / scale
    return float(ybar - mean @ w), w


def r2_from(row, intercept: float, w: np.ndarray) -> float:
    """R2 of given weights on the rows whose sums are given."""
    n, x, xx, xy, y, yy = _moments(row)
    rss = yy - 2 * (intercept * y + w @ xy) + n * intercept**2 + 2 * intercept * (w @ x) + w @ xx @ w
    tss = yy - y * y / n
    return float(1 - rss / tss) if tss > 0 else float("nan")


MODEL_SCHEMA = "pitch_type_code STRING, n BIGINT, league_csw DOUBLE, intercept DOUBLE, " + ", ".join(
    f"w_{c} DOUBLE" for c in FEATURES
) + ", train_r2 DOUBLE"


def fit_ridge(features: DataFrame, alpha: float = ALPHA, min_rows: int = 30) -> DataFrame:
    """One model row per pitch type with enough rows. The frame that reaches
    Python holds one row of sums per type."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                b, w = solve_ridge(row, alpha)
                out.append([row["pitch_type_code"], int(row["n"]), row[f"s_{TARGET}"] / row["n"], b, *w, r2_from(row, b, w)])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MODEL_SCHEMA.split(", ")])

    sums = gram(_usable(features), ["pitch_type_code"]).filter(F.col("n") >= min_rows)
    return sums.mapInPandas(solve, MODEL_SCHEMA)


def score_ridge(features: DataFrame, model: DataFrame) -> DataFrame:
    """Predicted rate and 100-scaled score of every row with all features."""
    predicted = F.col("intercept")
    for c in FEATURES:
        predicted = predicted + F.col(f"w_{c}") * F.col(c)
    # One model row per pitch type.
    rows = features.dropna(subset=list(FEATURES)).join(F.broadcast(model), "pitch_type_code")
    return rows.select(
        "pitcher_id", F.col("pitch_type_code").alias("pitch_type"), "season", "pitches",
        half_up(predicted / F.nullif(F.col("league_csw"), F.lit(0.0)) * 100, 1).alias("stuff_plus"),
        predicted.alias("predicted_csw"), "csw_rate", "avg_velo", "avg_spin", "avg_hmov", "avg_vmov", "whiff_rate",
    )


def top_scores(scores: DataFrame, k: int = 20) -> DataFrame:
    return scores.orderBy(
        F.col("stuff_plus").desc_nulls_first(), F.col("pitches").desc(), "pitcher_id", "pitch_type", "season"
    ).limit(k)


def with_folds(features: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Contiguous folds per type in (season, pitcher) order, sizes differing by
    at most one, the larger ones first. A type has one row per pitcher and
    season, so a plain window holds it."""
    order = Window.partitionBy("pitch_type_code").orderBy("season", "pitcher_id")
    return _usable(features).withColumn("fold", F.ntile(folds).over(order) - 1)


R2_SCHEMA = "pitch_type_code STRING, part STRING, n BIGINT, r2 DOUBLE"


def _r2_pairs(pairs: DataFrame, alpha: float) -> DataFrame:
    """Rows holding train sums (t_*) and evaluated sums (e_*) to R2 rows."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                train = {c: row[f"t_{c}"] for c in SUMS}
                test = {c: row[f"e_{c}"] for c in SUMS}
                b, w = solve_ridge(train, alpha)
                out.append([row["pitch_type_code"], row["part"], int(test["n"]), r2_from(test, b, w)])
            yield pd.DataFrame(out, columns=["pitch_type_code", "part", "n", "r2"])

    return pairs.mapInPandas(score, R2_SCHEMA)


def ridge_r2(features: DataFrame, scheme: str, alpha: float = ALPHA, min_rows: int = 30, min_common: int = 20) -> DataFrame:
    """R2 per type: 'train', 'folds' (one row per held-out fold) or 'seasons'
    (trained on a season, tested on the next one's same pitchers)."""
    if scheme == "train":
        sums = gram(_usable(features), ["pitch_type_code"]).filter(F.col("n") >= min_rows)
        pairs = sums.select(
            "pitch_type_code", F.lit("train").alias("part"), *[F.col(c).alias(f"t_{c}") for c in SUMS],
            *[F.col(c).alias(f"e_{c}") for c in SUMS],
        )
    elif scheme == "folds":
        held = gram(with_folds(features), ["pitch_type_code", "fold"])
        # Five rows per type: the train sums are the type's totals less the fold's.
        every = Window.partitionBy("pitch_type_code")
        pairs = held.select(
            "pitch_type_code", F.concat(F.lit("fold "), F.col("fold").cast("string")).alias("part"),
            *[(F.sum(c).over(every) - F.col(c)).alias(f"t_{c}") for c in SUMS],
            *[F.col(c).alias(f"e_{c}") for c in SUMS],
        ).filter(F.col("t_n") + F.col("e_n") >= min_rows)
    elif scheme == "seasons":
        rows = _usable(features)
        enough = rows.groupBy("pitch_type_code").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_rows)
        rows = rows.join(enough.select("pitch_type_code"), "pitch_type_code", "left_semi")
        keep = ["pitch_type_code", "pitcher_id", *FEATURES, TARGET]
        # The next season is the next one the type has data for.
        seasons = rows.select("pitch_type_code", "season").distinct()
        following = seasons.withColumn(
            "next_season", F.lead("season").over(Window.partitionBy("pitch_type_code").orderBy("season"))
        ).dropna()
        before = rows.join(F.broadcast(following), ["pitch_type_code", "season"]).select(
            "pitch_type_code", "pitcher_id", "season", "next_season", F.struct(*FEATURES, TARGET).alias("a")
        )
        after = rows.select("pitch_type_code", "pitcher_id", F.col("season").alias("next_season"), F.struct(*FEATURES, TARGET).alias("b"))
        both = before.join(after, ["pitch_type_code", "pitcher_id", "next_season"])
        by = ["pitch_type_code", "season", "next_season"]
        side = lambda s: gram(both.select(*by, f"{s}.*"), by)
        train = side("a").select(*by, *[F.col(c).alias(f"t_{c}") for c in SUMS])
        test = side("b").select(*by, *[F.col(c).alias(f"e_{c}") for c in SUMS])
        pairs = train.join(test, by).filter(F.col("t_n") >= min_common).withColumn(
            "part", F.concat_ws(" to ", F.col("season").cast("string"), F.col("next_season").cast("string"))
        )
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    return _r2_pairs(pairs, alpha)


def evaluate(features: DataFrame, model: DataFrame, alpha: float = ALPHA, min_rows: int = 30, min_common: int = 20) -> DataFrame:
    """Model rows with their mean cross-validated and cross-season R2."""
    cv = ridge_r2(features, "folds", alpha, min_rows).groupBy("pitch_type_code").agg(
        F.avg("r2").alias("cv_r2"), F.stddev_pop("r2").alias("cv_r2_std")
    )
    seasons = ridge_r2(features, "seasons", alpha, min_rows, min_common).groupBy("pitch_type_code").agg(
        F.avg("r2").alias("cross_season_r2")
    )
    return model.join(cv, "pitch_type_code", "left").join(seasons, "pitch_type_code", "left")

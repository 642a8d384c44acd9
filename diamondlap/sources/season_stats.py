"""Season statistics and the player id register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from diamondlap.functions.groups import first_per_key, missing_keys
from diamondlap.functions.scalars import safe_float, safe_int, text_or_null, truthy_or

# --- fixed values: table column -> source headings, first usable one wins ----
BATTING_INT = {"games": ["G"], "pa": ["PA"], "ab": ["AB"], "hr": ["HR"]}
BATTING_FLOAT = {
    "avg": ["AVG"], "obp": ["OBP"], "slg": ["SLG"], "ops": ["OPS"], "woba": ["wOBA"], "wrc_plus": ["wRC+"],
    "ops_plus": ["OPS+"], "off": ["Off"], "war": ["WAR"], "iso": ["ISO"], "barrel_pct": ["Barrel%", "Barrels%"],
    "hard_hit_pct": ["HardHit%"], "avg_exit_velo": ["EV"], "xba": ["xBA"], "xslg": ["xSLG"], "xwobacon": ["xwOBA"],
    "whiff_pct": ["SwStr%"], "o_swing_pct": ["O-Swing%"], "z_swing_pct": ["Z-Swing%"], "swing_pct": ["Swing%"],
    "o_contact_pct": ["O-Contact%"], "z_contact_pct": ["Z-Contact%"], "contact_pct": ["Contact%"],
    "zone_pct": ["Zone%"], "swstr_pct": ["SwStr%"], "sprint_speed": ["Sprint Speed", "Spd"],
}
PITCHING_INT = {"games": ["G"], "games_started": ["GS"], "wins": ["W"], "losses": ["L"], "saves": ["SV"]}
PITCHING_FLOAT = {
    "ip": ["IP"], "era": ["ERA"], "whip": ["WHIP"], "era_plus": ["ERA+"], "era_minus": ["ERA-"], "fip": ["FIP"],
    "fip_minus": ["FIP-"], "xfip": ["xFIP"], "xfip_minus": ["xFIP-"], "siera": ["SIERA"], "war": ["WAR"],
    "k_pct": ["K%"], "bb_pct": ["BB%"], "k_minus_bb": ["K-BB%"], "hr_per_9": ["HR/9", "HR9"],
    "avg_fastball_velo": ["FBv", "vFB"], "o_swing_pct": ["O-Swing%"], "z_swing_pct": ["Z-Swing%"],
    "swing_pct": ["Swing%"], "o_contact_pct": ["O-Contact%"], "z_contact_pct": ["Z-Contact%"],
    "contact_pct": ["Contact%"], "zone_pct": ["Zone%"], "whiff_pct": ["Whiff%"], "swstr_pct": ["SwStr%"],
    "barrel_pct": ["Barrel%", "Barrels%"], "hard_hit_pct": ["HardHit%"], "avg_exit_velo": ["AvgEV", "EV"],
    "stuff_plus": ["Stuff+"],
}


def _source(df: DataFrame, heading: str) -> Column:
    return F.col(f"`{heading}`") if heading in df.columns else F.lit(None).cast("string")


def _first(df: DataFrame, headings: list[str], cast) -> Column:
    """First heading with a usable, non-zero value, else the last one's value."""
    values = [cast(_source(df, h)) for h in headings]
    return F.coalesce(*[F.nullif(v, F.lit(0)) for v in values[:-1]], values[-1])


def _load(df: DataFrame, season: int, whole: dict, real: dict) -> DataFrame:
    fg = text_or_null(_source(df, "IDfg").cast("string"))
    return df.select(
        F.lit(season).cast("int").alias("season"), _source(df, "Name").alias("player_name"),
        _source(df, "Team").alias("team"),
        _first(df, ["IDfg", "mlbamID"], safe_int).alias("mlbam_id"),
        F.when(fg != "0", fg).alias("fg_id"),
        *[_first(df, h, safe_int).alias(n) for n, h in whole.items()],
        *[_first(df, h, safe_float).alias(n) for n, h in real.items()],
    )


def load_season_batting(df: DataFrame, season: int) -> DataFrame:
    """Raw season table (text or typed columns) to the stored columns."""
    return _load(df, season, BATTING_INT, BATTING_FLOAT)


def load_season_pitching(df: DataFrame, season: int) -> DataFrame:
    return _load(df, season, PITCHING_INT, PITCHING_FLOAT)


def build_id_map(register: DataFrame) -> DataFrame:
    """Register rows with a positive feed id, one per id. Without an order in
    the source the row with the lowest other ids is taken."""
    whole = lambda c: safe_float(c).try_cast("int")
    rows = register.select(
        whole("key_mlbam").alias("mlbam_id"), whole("key_fangraphs").alias("fangraphs_id"),
        text_or_null(F.col("key_bbref").cast("string")).alias("bbref_id"), F.col("name_first").alias("first_name"),
        F.col("name_last").alias("last_name"), whole("birth_year").alias("birth_year"),
    ).filter(F.col("mlbam_id") > 0)
    order = [F.col(c).asc_nulls_last() for c in ("fangraphs_id", "bbref_id", "last_name", "first_name", "birth_year")]
    rows = first_per_key(rows, "mlbam_id", order)
    zero = F.lit(0)
    return rows.withColumns({
        "fangraphs_id": F.nullif("fangraphs_id", zero), "birth_year": F.nullif("birth_year", zero),
    })


def missing_from_map(at_bats: DataFrame, id_map: DataFrame) -> DataFrame:
    """Batters of the feed without a register row, name split at the first space."""
    ids = missing_keys(at_bats.select(F.col("batter_id").alias("mlbam_id")), id_map, "mlbam_id")
    names = at_bats.groupBy(F.col("batter_id").alias("mlbam_id")).agg(F.max("batter_name").alias("batter_name"))
    part = F.split(F.trim("batter_name"), " ", 2)
    return ids.join(names, "mlbam_id").select(
        F.col("mlbam_id").alias("batter_id"), "batter_name", F.get(part, F.lit(0)).alias("first_name"),
        F.get(part, F.lit(1)).alias("last_name"),
    )


def qualified(df: DataFrame, column: str, least: float) -> DataFrame:
    """Season rows with at least the given playing time."""
    return df.filter(truthy_or(column, 0.0) >= least)

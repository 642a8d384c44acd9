"""The given tables seen as domain tables.

Each view is a list of SQL expressions over one table, written in the SQL that
Spark and ANSI engines share, so that a check query can put the same views in
front of its own SQL. Operators never see anything but the domain columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from diamondlap.functions.groups import laid

PITCHER = "(l_orderkey * 2 + l_linenumber % 2) % 80"
BATTER = "(l_orderkey * 7 + l_linenumber) % 240"
PITCHER_NAME = (
    f"concat(CASE {PITCHER} % 4 WHEN 0 THEN 'José P' WHEN 1 THEN 'Jose P' "
    f"WHEN 2 THEN 'Ángel P' ELSE 'Max P' END, CAST({PITCHER} AS STRING))"
)
PITCH_TYPE = (
    "CASE WHEN l_partkey % 31 = 0 THEN 'EP' ELSE CASE l_partkey % 9 WHEN 0 THEN 'FF' WHEN 1 THEN 'SI' "
    "WHEN 2 THEN 'SL' WHEN 3 THEN 'CH' WHEN 4 THEN 'FC' WHEN 5 THEN 'ST' WHEN 6 THEN 'CU' "
    "WHEN 7 THEN 'FS' ELSE 'KC' END END"
)
CALL = (
    "CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE CASE CAST(l_quantity AS INT) % 16 WHEN 0 THEN 'S' "
    "WHEN 1 THEN 'W' WHEN 2 THEN 'T' WHEN 3 THEN 'C' WHEN 4 THEN 'C' WHEN 5 THEN 'F' WHEN 6 THEN 'D' "
    "WHEN 7 THEN 'L' WHEN 8 THEN 'B' WHEN 9 THEN 'H' WHEN 10 THEN '*B' WHEN 15 THEN 'M' ELSE 'X' END END"
)
EVENT = (
    "CASE min(l_partkey) % 8 WHEN 0 THEN 'single' WHEN 1 THEN 'double' WHEN 2 THEN 'home_run' "
    "WHEN 3 THEN 'field_out' WHEN 4 THEN 'sac_fly' WHEN 5 THEN 'strikeout' WHEN 6 THEN 'triple' "
    "ELSE 'grounded_into_double_play' END"
)
LISTED = f"CASE l_returnflag WHEN 'N' THEN -1 - {BATTER} ELSE {BATTER} END"  # others stand for players no at-bat has
DRIVER = "user_id % 40"
RATED = f"CASE event_type WHEN 'signup' THEN -1 - {DRIVER} ELSE {DRIVER} END"
RACE = "CAST(dayofyear(ts) AS INT)"
SERIES = "CASE WHEN dayofyear(ts) % 5 = 0 THEN 2 ELSE 1 END"
DRIVER_NAME = f"concat('Driver ', CAST({DRIVER} AS STRING))"
MAKE = f"CASE {DRIVER} % 4 WHEN 0 THEN 'Ford' WHEN 1 THEN 'Toyota' WHEN 2 THEN 'Chevrolet' ELSE NULL END"
RACE_SEASON = "CAST(2022 + dayofyear(ts) % 4 AS INT)"


@dataclass(frozen=True)
class View:
    source: str
    columns: tuple[str, ...]
    group_by: tuple[str, ...] = ()
    lies_by: tuple[str, ...] = ()  # of group_by, what a large table is laid by; its groups have a few rows each

    def sql(self) -> str:
        text = f"SELECT {', '.join(self.columns)} FROM {self.source}"
        if self.group_by:
            text += f" GROUP BY {', '.join(self.group_by)}"
        return text


VIEWS: dict[str, View] = {
    "games": View("orders", (
        "o_orderkey AS game_pk",
        "concat(CAST(year(o_orderdate) + 24 AS STRING), substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 5)) AS game_date",
        "CAST(year(o_orderdate) + 24 AS INT) AS season",
        "CASE o_orderstatus WHEN 'P' THEN 'S' ELSE 'R' END AS game_type",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'In Progress' ELSE 'Final' END AS status",
        "concat('T', CAST(o_custkey % 30 AS STRING)) AS away_team_abbrev",
        "concat('T', CAST((o_custkey + 7) % 30 AS STRING)) AS home_team_abbrev",
    )),
    "at_bats": View("lineitem", (
        "l_orderkey AS game_pk",
        "CAST(l_linenumber AS INT) AS at_bat_index",
        "CAST(l_linenumber AS INT) AS inning",
        "CASE WHEN l_linenumber % 2 = 1 THEN 'top' ELSE 'bottom' END AS half_inning",
        f"CAST({PITCHER} AS BIGINT) AS pitcher_id",
        f"{PITCHER_NAME} AS pitcher_name",
        f"CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST({BATTER} AS BIGINT) END AS batter_id",
        f"concat('Batter B', CAST({BATTER} AS STRING)) AS batter_name",
        f"CASE WHEN {BATTER} % 2 = 0 THEN 'L' ELSE 'R' END AS bat_side",
        f"CASE WHEN {PITCHER} % 3 = 0 THEN 'L' ELSE 'R' END AS pitch_hand",
        f"{EVENT} AS event_type",
    ), ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_linenumber")),
    "pitches": View("lineitem", (
        "l_orderkey AS game_pk",
        "CAST(l_linenumber AS INT) AS at_bat_index",
        f"CAST({PITCHER} AS BIGINT) AS pitcher_id",
        f"CAST({BATTER} AS BIGINT) AS batter_id",
        f"{PITCH_TYPE} AS pitch_type_code",
        f"{CALL} AS call_code",
        f"coalesce({CALL} = 'X', FALSE) AS is_in_play",
        "CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE CAST(l_partkey % 14 + 1 AS INT) END AS zone",
        "CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE 70 + l_quantity / 2 END AS start_speed",
        "CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CAST(1500 + l_partkey % 1000 AS INT) END AS spin_rate",
        "l_discount * 100 - 5 AS pfx_x",
        "l_tax * 100 AS pfx_z",
        "CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_discount * 20 - 1 END AS px",
        "l_discount * 10 AS x0",
        "5 + l_tax * 10 AS z0",
        "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(60 + l_suppkey % 50 AS DOUBLE) END AS launch_speed",
        "CAST(l_partkey % 60 - 10 AS DOUBLE) AS launch_angle",
    )),
    "linescore": View("lineitem", (
        "l_orderkey AS game_pk",
        "CAST(l_linenumber AS INT) AS inning",
        "CASE WHEN min(l_suppkey) % 2 = 0 THEN 'top' ELSE 'bottom' END AS half_inning",
        "CAST(min(l_partkey) % 4 AS INT) AS runs",
    ), ("l_orderkey", "l_linenumber"), ("l_orderkey",)),
    # Games of other rows have no partner, which leaves gaps without leaving out rows.
    "runners": View("lineitem", (
        "CASE l_returnflag WHEN 'R' THEN l_orderkey ELSE -1 - l_orderkey END AS game_pk",
        "CAST(l_linenumber AS INT) AS at_bat_index", "l_partkey AS runner_id",
    )),
    # Stored score rows; season and date depend on the game alone.
    "scores": View("lineitem", (
        "l_orderkey AS game_pk",
        "concat(CAST(2019 + l_orderkey % 7 AS STRING), '-', lpad(CAST(l_orderkey % 12 + 1 AS STRING), 2, '0'), "
        "'-', lpad(CAST(l_orderkey % 28 + 1 AS STRING), 2, '0')) AS game_date",
        "CAST(2019 + l_orderkey % 7 AS INT) AS season",
        "CASE WHEN l_orderkey % 5 = 0 THEN 'S' ELSE 'R' END AS game_type",
        f"CAST({PITCHER} AS BIGINT) AS pitcher_id",
        f"min({PITCHER_NAME}) AS pitcher_name",
        f"{PITCH_TYPE} AS pitch_type_code",
        "CAST(count(*) AS BIGINT) AS pitches_thrown",
        "avg(l_discount) - 0.03 AS avg_value",
        "CAST(40 + min(l_partkey) % 1200 AS DOUBLE) / 10 AS value_plus",
        "70 + avg(l_quantity) / 2 AS avg_velo",
        "CAST(1500 + min(l_partkey) % 1000 AS DOUBLE) AS avg_spin",
        "avg(l_discount) * 100 - 5 AS avg_hmov",
        "avg(l_tax) * 100 AS avg_ivb",
        "CAST(min(l_suppkey) % 50 AS DOUBLE) / 100 AS whiff_rate",
        "CAST(min(l_suppkey) % 40 AS DOUBLE) / 100 AS cs_rate",
        "CAST(min(l_suppkey) % 60 AS DOUBLE) / 100 AS csw_rate",
        "CAST(min(l_partkey) % 40 AS DOUBLE) / 100 AS hard_hit_rate",
    ), ("l_orderkey", "l_linenumber % 2", PITCH_TYPE), ("l_orderkey",)),
    "box_batting": View("lineitem", (
        "l_orderkey AS game_pk",
        f"CAST({BATTER} AS BIGINT) AS player_id",
        "CAST(sum(CASE WHEN l_quantity > 42 THEN 0 ELSE 1 END) AS INT) AS at_bats",
        "CAST(sum(CASE WHEN l_quantity <= 42 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT) AS strikeouts",
        "CAST(sum(CASE WHEN l_quantity <= 42 AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS INT) AS hits",
        "CAST(sum(CASE WHEN l_quantity <= 42 AND l_returnflag = 'A' THEN l_partkey % 4 + 1 ELSE 0 END) AS INT) AS total_bases",
        "CAST(sum(CASE WHEN l_quantity <= 42 AND l_returnflag = 'A' AND l_partkey % 4 = 3 THEN 1 ELSE 0 END) AS INT) AS home_runs",
        "CASE WHEN min(l_partkey) % 3 = 0 THEN NULL ELSE CAST(min(l_partkey) % 2 AS INT) END AS hit_by_pitch",
        "CASE WHEN min(l_partkey) % 5 = 0 THEN NULL ELSE CAST(min(l_suppkey) % 2 AS INT) END AS sac_flies",
    ), ("l_orderkey", BATTER), ("l_orderkey",)),
    "season_pitching": View("lineitem", (
        "CAST(year(l_shipdate) + 24 AS INT) AS season",
        f"upper({PITCHER_NAME}) AS player_name",
        f"CAST({PITCHER} AS BIGINT) AS mlbam_id",
        "CAST(sum(CAST(l_quantity AS BIGINT)) % 220 AS DOUBLE) AS ip",
        "0.1 + avg(l_discount) * 3 AS k_pct",
        "0.02 + avg(l_tax) AS bb_pct",
        "2 + avg(l_extendedprice) / 20000 AS fip",
        "2.5 + avg(l_quantity) / 20 AS era",
        "3 + avg(l_tax) * 20 AS siera",
        "CAST(min(l_partkey) % 70 AS DOUBLE) / 10 AS war",
    ), ("year(l_shipdate)", PITCHER)),
    "season_batting": View("lineitem", (
        "CAST(year(l_shipdate) + 24 AS INT) AS season",
        f"concat('Batter B', CAST({LISTED} AS STRING)) AS player_name",
        f"CAST({LISTED} AS BIGINT) AS mlbam_id",
        "CAST(count(*) AS INT) AS pa",
    ), ("year(l_shipdate)", LISTED)),
    "laps": View("events", (
        f"{RACE} AS race_id", f"{SERIES} AS series_id",
        f"CAST({DRIVER} AS INT) AS driver_id", f"{DRIVER_NAME} AS driver_name",
        "CAST(floor((hour(ts) * 60 + minute(ts)) / 8) AS INT) AS lap_number",
        "60 + value AS lap_speed",
    )),
    "races": View("events", (
        f"{RACE} AS race_id", f"{SERIES} AS series_id", f"{RACE_SEASON} AS season",
        "CASE WHEN dayofyear(ts) % 2 = 0 THEN 'Spring Sprint 400' ELSE 'Autumn Classic 500' END AS race_name",
        "CASE dayofyear(ts) % 3 WHEN 0 THEN 'Coastal Raceway' WHEN 1 THEN 'Hill Speedway' ELSE 'River Oval' END AS track_name",
        "CASE dayofyear(ts) % 3 WHEN 0 THEN 'superspeedway' ELSE 'intermediate' END AS track_type",
        "CASE WHEN dayofyear(ts) % 7 = 0 THEN 0 ELSE 400 END AS scheduled_laps",
        "CAST(CASE WHEN dayofyear(ts) % 4 = 0 THEN NULL ELSE 360 END AS INT) AS actual_laps",
    ), ("dayofyear(ts)",)),
    "results": View("events", (
        f"{RACE} AS race_id", f"{SERIES} AS series_id", f"{RACE_SEASON} AS season",
        f"CAST({DRIVER} AS INT) AS driver_id", f"{DRIVER_NAME} AS driver_name", f"{MAKE} AS manufacturer",
        "CAST(min(event_id) % 40 + 1 AS INT) AS start_position",
        "CAST(max(event_id) % 41 AS INT) AS finish_position",
        "CASE WHEN min(event_id) % 6 = 0 THEN NULL ELSE CAST(max(event_id) % 80 AS DOUBLE) / 2 + 1 END AS avg_position",
    ), ("dayofyear(ts)", DRIVER)),
    "driver_stats": View("events", (
        f"{RACE} AS race_id", f"CAST({RATED} AS INT) AS driver_id",
        "CAST(count(*) AS INT) AS quality_passes",
        "CAST(sum(CASE event_type WHEN 'click' THEN 1 ELSE 0 END) AS INT) AS green_flag_passes",
        "CAST(sum(CASE event_type WHEN 'view' THEN 1 ELSE 0 END) AS INT) AS green_flag_passed",
        "CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) AS INT) AS quality_pass_differential",
        "60 + CAST(max(event_id) % 600 AS DOUBLE) / 10 AS driver_rating",
    ), ("dayofyear(ts)", RATED)),
    # One snapshot per race day and hour.
    "live_snapshots": View("events", (
        f"{RACE} AS race_id",
        "concat(CAST(CAST(ts AS DATE) AS STRING), ' ', lpad(CAST(hour(ts) AS STRING), 2, '0')) AS snapshot_at",
        f"CAST({DRIVER} AS INT) AS driver_id", f"{DRIVER_NAME} AS driver_name",
        f"concat('', CAST({DRIVER} + 1 AS STRING)) AS car_number", f"{MAKE} AS manufacturer",
        "CAST(hour(ts) * (dayofyear(ts) % 17) AS INT) AS lap",
        "400 AS total_laps",
        "CASE WHEN max(event_id) % 11 = 0 THEN NULL ELSE CAST(max(event_id) % 40 + 1 AS INT) END AS position",
        "CAST(hour(ts) * (dayofyear(ts) % 17) AS INT) AS laps_completed",
        "CAST(count(*) AS INT) AS laps_led",
        "CAST(max(event_id) % 3 AS INT) AS pit_stops",
        "CASE WHEN max(event_id) % 9 = 0 THEN NULL ELSE 150 + max(value) END AS best_lap_speed",
        "120 + min(value) AS last_lap_speed",
        "CAST(max(event_id) % 13 AS DOUBLE) AS delta_leader",
        "CASE WHEN max(event_id) % 5 = 0 THEN NULL ELSE CAST(max(event_id) % 100 AS INT) END AS tire_age",
        "CASE WHEN max(event_id) % 5 = 0 THEN NULL ELSE CAST(max(event_id) % 90 + 1 AS INT) END AS last_pit_lap",
    ), ("dayofyear(ts)", "CAST(ts AS DATE)", "hour(ts)", DRIVER)),
}


ROWS_OF_A_TASK = 500_000


class Tables:
    """Lazy domain DataFrames over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._read: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    def tasks(self, name: str) -> int | None:
        """Tasks over which a large table's rows are dealt, more the more rows it has; None for a small one. Rows are counted from
        the files' footers."""
        if name not in self._rows:
            self._rows[name] = self.base(name).count()
        tasks = -(-self._rows[name] // ROWS_OF_A_TASK)
        return max(tasks, int(self.spark.conf.get("spark.sql.shuffle.partitions"))) if tasks > 2 else None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        view = VIEWS[name]
        df = self.base(view.source)
        if not view.group_by:
            return df.selectExpr(*view.columns)
        if view.lies_by:
            df = laid(df, self.tasks(view.source), *view.lies_by)
        return df.groupBy(*[F.expr(k) for k in view.group_by]).agg(*[F.expr(c) for c in view.columns]).select(
            *[F.col(c.rsplit(" AS ", 1)[1]) for c in view.columns]
        )


def with_views(names, body: str, extra: str = "") -> str:
    """SQL text with the named views in front of it."""
    ctes = [f"{n} AS ({VIEWS[n].sql()})" for n in names]
    if extra:
        ctes.append(extra)
    return f"WITH {', '.join(ctes)} {body}"

"""Live race polling: snapshots, projections and the end of the race."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from diamondlap.functions import codes
from diamondlap.operators import flatten_nascar as nascar, racing
from diamondlap.streaming import feeds as fd

RACE_POLL = "30 seconds"


STATE = "race_id INT, finished BOOLEAN"


def race_batch(batch: DataFrame, epoch: int, out: str, history: DataFrame) -> None:
    """Store a batch of feeds: snapshots, flags, poll-time projections, and for
    each race in it whether it has taken the checkered flag. Projections are made
    from the snapshots as written, so that these are parsed once."""
    batch = batch.persist()
    try:
        rows = nascar.snapshot(batch)
        fd.write_epoch(rows, f"{out}/live_snapshots", epoch)
        fd.write_epoch(nascar.flags(batch), f"{out}/flags", epoch)
        written = batch.sparkSession.read.schema(rows.schema).parquet(f"{out}/live_snapshots/epoch={epoch}")
        fd.write_epoch(racing.poll_projection(written, history), f"{out}/poll_projections", epoch)
        done = F.get_json_object("data", "$.flag_state").try_cast("int") == codes.CHECKERED
        state = batch.groupBy(F.col("race_id").cast("int").alias("race_id")).agg(F.coalesce(F.bool_or(done), F.lit(False)).alias("finished"))
        fd.write_epoch(state, f"{out}/race_state", epoch)
    finally:
        batch.unpersist()


def unfinished(spark, out: str) -> DataFrame:
    """Races seen so far that have not taken the checkered flag."""
    state = fd.read_epochs(spark, f"{out}/race_state", STATE)
    return state.groupBy("race_id").agg(F.bool_or("finished").alias("finished")).filter(~F.col("finished"))


class RaceStream:
    """A running race job. `feeds` streams race_id, season, series_id,
    snapshot_at and data; `history` is the drivers' track history."""

    def __init__(self, feeds: DataFrame, out: str, history: DataFrame, every: str | None = None):
        self.spark, self.out, self.polling = feeds.sparkSession, out, every is not None

        def body(batch: DataFrame, epoch: int) -> None:
            race_batch(batch, epoch, out, history)

        self.query: StreamingQuery = fd.start(feeds, out, body, every)

    def run(self, check_seconds: int = 5) -> None:
        """Wait until the input is used up, or, when polling, until every race
        seen is over and no feed is left unread."""
        if not self.polling:
            self.query.awaitTermination()
            return
        while not self.query.awaitTermination(check_seconds):
            last = self.query.lastProgress
            idle = last is not None and not last["numInputRows"] and not self.query.status["isDataAvailable"]
            started = idle and not fd.read_epochs(self.spark, f"{self.out}/race_state", STATE).isEmpty()
            if started and unfinished(self.spark, self.out).isEmpty():
                self.query.stop()


def race_feeds(spark, path: str, max_files: int = 100) -> DataFrame:
    """Live feed files under season=/series_id=/race_id= folders."""
    docs = fd.document_stream(spark, path, "season INT, series_id INT, race_id INT", max_files)
    return docs.withColumnRenamed("fetched_at", "snapshot_at")


def running_variance(snapshots: DataFrame, time: str = "snapshot_at", delay: str = "1 day", span: str = "7 days") -> DataFrame:
    """Speed spread per race, driver and race week over the polls so far, updated
    with every batch. The state is three sums per driver and race; it goes once
    the watermark (`delay` behind the newest poll) has passed the week."""
    return (
        snapshots.withWatermark(time, delay).filter((F.col("last_lap_speed") > 0) & (F.col("lap") > 5))
        .groupBy(F.window(time, span).alias("week"), "race_id", "driver_name")
        .agg(
            F.stddev_samp("last_lap_speed").alias("speed_stddev"), F.avg("last_lap_speed").alias("speed_avg"),
            F.count(F.lit(1)).alias("lap_samples"),
        )
        .drop("week")
    )

"""Status changes of games, told by state that is kept per game.

The state of a game is the status of its newest document. Once that is final a
timer is set, and when it runs out the game's state is dropped, so state holds
the games of the last days and no more. Games are kept in groups by a hash: every call for state goes from Python
to the JVM and back, so a batch makes a few calls for each group instead of for each game.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from diamondlap.sources import landing
from diamondlap.streaming import feeds as fd

NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "game_pk INT, action STRING, before STRING, status STRING, status_changed BOOLEAN"
FINAL = "Final"
GROUPS = 16_384
KEPT = "games ARRAY<INT>, statuses ARRAY<STRING>, ends ARRAY<BIGINT>"  # a game's end: when its state is dropped, or null


def _rank(doc: Row) -> tuple:
    return doc["fetched_at"] is not None, doc["fetched_at"] or 0, -doc["digest"]


class GameStatus(StatefulProcessor):
    """One row per game and batch: what its newest document does to the status."""

    def __init__(self, keep_seconds: float):
        self.keep_ms = int(keep_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("statuses", KEPT)

    def _kept(self) -> dict[int, tuple]:
        """Status and end of each game of the group."""
        kept = self.last.get()
        return {} if kept is None else {game: rest for game, *rest in zip(*kept)}

    def _keep(self, kept: dict[int, tuple]) -> None:
        if not kept:
            return self.last.clear()
        statuses, ends = zip(*kept.values())
        self.last.update((list(kept), list(statuses), list(ends)))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest: dict[int, Row] = {}
        for doc in rows:
            held = newest.get(doc["game_pk"])
            if held is None or _rank(doc) > _rank(held):
                newest[doc["game_pk"]] = doc
        kept, end, out, finished = self._kept(), timerValues.getCurrentProcessingTimeInMs() + self.keep_ms, [], False
        for game, doc in newest.items():
            known, status = game in kept, doc["status"]
            before = kept[game][0] if known else None
            action = "inserted" if not known else "skipped" if before == FINAL else "updated"
            if action != "skipped":
                kept[game] = (status, end if status == FINAL else None)
                finished = finished or status == FINAL
            changed = action != "skipped" and (not known or before != status)
            out.append(Row(game_pk=game, action=action, before=before, status=before if action == "skipped" else status, status_changed=changed))
        self._keep(kept)
        if finished:
            self.handle.registerTimer(end)
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        over = expiredTimerInfo.getExpiryTimeInMs()
        self._keep({game: (status, end) for game, (status, end) in self._kept().items() if end is None or end > over})
        return iter(())

    def close(self) -> None:
        pass


def status_rows(docs: DataFrame, keep_seconds: float) -> DataFrame:
    """CHANGES rows of a stream of game_pk (optional), data and fetched_at. Of a document the
    header's status goes on, and neither its text nor its digest is kept."""
    heads = landing.game_header(docs).filter(F.col("game_pk").isNotNull())
    brief = heads.select(F.pmod(F.xxhash64("game_pk"), F.lit(GROUPS)).cast("int").alias("group"), "game_pk", "status", F.col("fetched_at").cast("timestamp").cast("double").alias("fetched_at"), F.xxhash64("data").alias("digest"))
    return brief.groupBy("group").transformWithState(GameStatus(keep_seconds), CHANGES, "Update", "ProcessingTime")


def watch_status(docs: DataFrame, out: str, keep_seconds: float = 2 * 86_400, every: str | None = None) -> StreamingQuery:
    """Write what every batch does to the status of its games, an epoch each, under `out`/status.
    The finished games' state is dropped after keep_seconds."""
    spark = docs.sparkSession
    settings = {STORE: ROCKS}  # keyed state with timers needs this store; a query takes settings over when it starts
    if every is None:
        settings[NO_DATA] = "false"  # a pending timer asks for another batch, so a run over what is there would never end
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return fd.start(status_rows(docs, keep_seconds), out, lambda batch, epoch: fd.write_epoch(batch, f"{out}/status", epoch), every, mode="update")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def changes(spark, out: str) -> DataFrame:
    """Games whose status changed, with the epoch that saw it."""
    path = f"{out}/status"
    return spark.read.schema(f"{CHANGES}, epoch BIGINT").option("basePath", path).parquet(path).filter("status_changed")

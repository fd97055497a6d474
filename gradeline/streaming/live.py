"""Scoring and accounting while answers arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gradeline.functions.ratio import count_if, share
from gradeline.operators.cells import score_fields


def score_answer_stream(bank: DataFrame, answers: DataFrame) -> DataFrame:
    """Field verdicts of arriving answers against the static bank (append mode, no state)."""
    return score_fields(bank, answers)


def first_per_cell(answers: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """One row per (qid, parser): repeats within the watermark are dropped."""
    return answers.withWatermark("retrieved_at", delay).dropDuplicatesWithinWatermark(
        ["qid", "parser"]
    )


def live_accuracy(
    rows: DataFrame, *, length: str = "1 hour", slide: str | None = None, delay: str = "2 hours"
) -> DataFrame:
    """Accuracy and latency per system and time window.

    Spark adds up each task's rows before the shuffle, so a busy system costs one row per task and
    window.
    """
    span = F.window("retrieved_at", length, slide) if slide else F.window("retrieved_at", length)
    return (
        rows.withWatermark("retrieved_at", delay).groupBy(span.alias("span"), "parser")
        .agg(
            F.count("*").alias("n"), count_if(F.col("ok")).alias("n_ok"),
            share(count_if(F.col("ok")), F.count("*")).alias("accuracy"),
            F.avg("latency_sec").alias("mean_latency"),
        )
        .select(
            F.col("span.start").alias("start"), F.col("span.end").alias("end"), "parser", "n",
            "n_ok", "accuracy", "mean_latency",
        )
    )


def collection_sessions(rows: DataFrame, *, gap: str = "7 days", delay: str = "1 day") -> DataFrame:
    """Bursts of collection per system, parted by a silence of ``gap``.

    In append mode a session is written once the watermark has passed its end, and its state is
    dropped; rows that arrive later than ``delay`` are left out. In complete mode each batch writes
    all sessions, open ones too, and state keeps one row per session.
    """
    return (
        rows.withWatermark("retrieved_at", delay)
        .groupBy(F.session_window("retrieved_at", gap).alias("span"), "parser")
        .agg(F.count("*").alias("n"), F.max("retrieved_at").alias("last"))
        .select(F.col("span.start").alias("start"), "parser", "n", "last")
    )


def write_batches(stream: DataFrame, folder: str, mode: str, prepare=None) -> None:
    """Run a stream over what is available, one Parquet folder per micro-batch.

    A batch overwrites its own folder, so a batch that is run again after a failure leaves one
    copy.
    """

    def save(df: DataFrame, batch: int) -> None:
        out = df if prepare is None else prepare(df, batch)
        out.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    job = (
        stream.writeStream.outputMode(mode).foreachBatch(save)
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    job.awaitTermination()


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def latest(batches: DataFrame) -> DataFrame:
    """What the last batch of a complete-mode stream wrote."""
    last = batches.agg(F.max("batch")).scalar()
    return batches.where(F.col("batch") == last).drop("batch")


def newest(batches: DataFrame, keys: list[str]) -> DataFrame:
    """The last written version of each key of an update-mode stream."""
    rest = [c for c in batches.columns if c not in keys and c != "batch"]
    return batches.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "batch").alias("_r")
    ).select(*keys, "_r.*")


class _SpendOfRun(StatefulProcessor):
    """Totals of one run in keyed state, and a timer that closes the run after a silence. Times are
    milliseconds, so no worker's time zone matters."""

    TOTALS = "since long, last long, cost double, n_unknown long, n long, stopped boolean"

    def __init__(self, by: str, cap: float, quiet_ms: int):
        self.by, self.cap, self.quiet_ms = by, cap, quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", self.TOTALS)

    def _row(self, key, held, closed: bool) -> pd.DataFrame:
        names = ["since", "last", "cost", "n_unknown", "n", "stopped"]
        return pd.DataFrame([(*key, *held, closed)], columns=[self.by, *names, "closed"])

    def handleInputRows(self, key, rows, timerValues):
        held = tuple(self.totals.get()) if self.totals.exists() else None
        before = held[1] if held else None
        for part in rows:
            first, last = int(part["at"].min()), int(part["at"].max())
            since, seen, cost, unknown, n, stopped = held or (first, last, 0.0, 0, 0, False)
            cost += float(part["cost"].sum())
            unknown += int(part["n_unknown"].sum())
            stopped = bool(stopped or cost > self.cap or unknown > 0)
            held = (since, max(seen, last), cost, unknown, n + int(part["n"].sum()), stopped)
        self.totals.update(held)
        if before != held[1]:
            if before is not None:
                self.handle.deleteTimer(before + self.quiet_ms)
            self.handle.registerTimer(held[1] + self.quiet_ms)
        yield self._row(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = tuple(self.totals.get())
        self.totals.clear()
        yield self._row(key, held, True)

    def close(self) -> None:
        pass


def spend_watch(
    rows: DataFrame, cap: float, *, by: str = "parser", slot: str = "1 hour", delay: str = "1 day", quiet_hours: float = 168
) -> DataFrame:
    """Running spend of each run, as a stream of its totals (update mode, RocksDB state).

    ``rows`` have ``by`` (a string), ``retrieved_at`` and ``cost``. A run is ``stopped`` for good once its spend
    passes ``cap`` or a cost is unknown. Time counts in whole slots: rows that arrive late count like
    any other until the watermark, ``delay`` behind the latest slot, has reached their slot. A run
    without a new slot for ``quiet_hours`` is closed: its last row says so and its state is dropped.
    Rows that come later open it again, from zero, with another ``since`` (the first slot of what
    opened it). Rows without a time are left out; rows without a run form one of their own.

    Each task first adds up its rows by run and slot, so a busy run sends few rows to its key.
    """
    timed = rows.where(F.col("retrieved_at").isNotNull()).select(
        F.col(by).cast("string").alias(by), F.window("retrieved_at", slot)["start"].alias("slot"), F.col("cost").cast("double").alias("cost")
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unknown = pc.cast(pc.is_null(batch.column("cost")), pa.int64())
            part = pa.Table.from_batches([batch]).append_column("n_unknown", unknown).append_column("n", pa.array([1] * batch.num_rows, pa.int64()))
            out = part.group_by([by, "slot"]).aggregate([("cost", "sum"), ("n_unknown", "sum"), ("n", "sum")])
            columns = [out.column(c) for c in (by, "slot", "cost_sum", "n_unknown_sum", "n_sum")]
            yield from pa.table(columns, names=[by, "slot", "cost", "n_unknown", "n"]).to_batches()

    slots = timed.mapInArrow(add_up, f"`{by}` string, slot timestamp, cost double, n_unknown long, n long")
    slots = slots.withColumn("at", F.unix_millis("slot")).withWatermark("slot", delay)
    runs = slots.groupBy(by).transformWithStateInPandas(
        _SpendOfRun(by, cap, round(quiet_hours * 3_600_000)),
        f"`{by}` string, {_SpendOfRun.TOTALS}, closed boolean", "update", "eventTime",
    )
    return runs.withColumns({c: F.timestamp_millis(c) for c in ("since", "last")})


def spend_batches(stream: DataFrame, folder: str) -> None:
    """Run a ``spend_watch`` over what is available; its state needs the RocksDB store, for this run only."""
    spark, setting = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        write_batches(stream, folder, "update")
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)

"""Streams that arrive in parts: late rows, timers, and settings left as they were."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gradeline.session import work_folder
from gradeline.streaming import live

START = datetime(2024, 3, 1)
SCHEMA = "parser string, retrieved_at timestamp, cost double"


def hours(h):
    return START + timedelta(hours=h)


def test_spend_of_runs_in_three_files(spark):
    """Late rows count until the watermark (6 hours back) passes them; a silence of 10 hours closes a run."""
    files = [
        [("a", hours(0.2), 1.0), ("a", hours(3.7), 2.0), ("b", hours(1.5), 1.0), ("c", hours(2), None), (None, hours(2), 0.5), ("a", None, 9.0)],
        # The watermark is at -3: all rows count, and hour 30 ends the first spells.
        [("a", hours(1), 4.0), ("b", hours(30), 1.0), ("d", hours(20), 0.25)],
        # The watermark is at 24: hours 3 and 24 are late; run a opens again.
        [("a", hours(3), 7.0), ("b", hours(24.5), 7.0), ("b", hours(25), 2.0), ("a", hours(31), 1.5), ("b", hours(32), 0.5)],
    ]
    arrivals, out = work_folder(spark, "arrivals"), work_folder(spark, "spend")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(arrivals)
        stream = live.spend_watch(spark.readStream.schema(SCHEMA).parquet(arrivals), 5.0, delay="6 hours", quiet_hours=10)
        live.spend_batches(stream, out)
    assert spark.conf.get(setting, None) == before
    now = live.newest(live.read_batches(spark, out), ["parser", "since"])
    hour = {c: F.expr(f"timestampdiff(HOUR, timestamp'{START}', {c})") for c in ("since", "last")}
    got = {(r.parser, r.since): (r.last, r.cost, r.n_unknown, r.n, r.stopped, r.closed) for r in now.withColumns(hour).collect()}
    assert got == {
        ("a", 0): (3, 7.0, 0, 3, True, True), ("a", 31): (31, 1.5, 0, 1, False, False), ("b", 1): (32, 4.5, 0, 4, False, False),
        ("c", 2): (2, 0.0, 1, 1, True, True), (None, 2): (2, 0.5, 0, 1, False, True), ("d", 20): (20, 0.25, 0, 1, False, False),
    }

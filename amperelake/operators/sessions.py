"""Activity sessions by a sweep over +1/-1 deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amperelake.operators.prefix import blocked_running

GAP_MS = 900_000
PAUSE_MS = 300_000
BLOCK_MS = 3_600_000


def sweep_sessions(events: DataFrame, key: str = "vin", ts: str = "ts_event_ms", gap_ms: int = GAP_MS, pause_ms: int = PAUSE_MS, block_ms: int = BLOCK_MS) -> DataFrame:
    """Sessions of `events` (one row per message): longest stretches of a key without an interval over `gap_ms`.

    Each event adds 1 at its time and takes 1 away `gap_ms` later (additions first where both fall together, so an
    interval of exactly `gap_ms` does not split). Where the running sum leaves 0 a session starts, where it returns to 0
    it ends; counts and pauses over `pause_ms` are differences of running totals at those two rows. Sums run in blocks
    of `block_ms`, so a hot key is spread over tasks; only session bounds, at most one pair per gap, meet per key.

    Result: key, start_ms, end_ms, duration_ms, message_count, gaps. Rows whose key or time is null are in no session;
    repeated rows and ties count as messages of their own; an empty input gives no session; other columns are ignored.
    """
    e = events.select(F.col(key).alias("k"), F.col(ts).cast("long").alias("t")).where("k is not null and t is not null")
    deltas = e.select(
        "k",
        F.explode(F.array(F.struct(F.col("t").alias("at"), F.lit(0).alias("kind")), F.struct((F.col("t") + gap_ms).alias("at"), F.lit(1).alias("kind")))).alias("d"),
    ).select("k", "d.at", "d.kind", F.floor(F.col("d.at") / block_ms).cast("int").alias("block"))
    deltas = deltas.withColumns({
        "delta": F.when(F.col("kind") == 0, 1).otherwise(-1),
        "one": F.when(F.col("kind") == 0, 1).otherwise(0),
        "seen": F.when(F.col("kind") == 0, F.col("at")),
    })
    run = blocked_running(deltas, "k", "block", ["at", "kind"], {"open": "delta", "n": "one"}, {"prev": "seen"})
    run = run.withColumn("pause", F.when((F.col("kind") == 0) & (F.col("at") - F.col("prev") > pause_ms), 1).otherwise(0))
    # pauses are summed per block first, then per session between the bounds
    starts = (F.col("kind") == 0) & (F.col("open") == 1)
    ends = (F.col("kind") == 1) & (F.col("open") == 0)
    here = Window.partitionBy("k", "block")
    inner = here.orderBy("at", "kind")
    marked = run.withColumns({
        "p": F.sum("pause").over(inner.rowsBetween(Window.unboundedPreceding, 0)),
        "bound": F.when(starts, 0).when(ends, 1),
        "first": F.row_number().over(inner) == 1,
    }).withColumn("total", F.max("p").over(here))
    kept = marked.where("bound is not null or first").select("k", "block", "at", "kind", "n", "p", "bound", F.when(F.col("first"), F.col("total")).alias("total"))
    past = Window.partitionBy("k").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("p", F.col("p") + F.coalesce(F.sum("total").over(past), F.lit(0)))
    order = Window.partitionBy("k").orderBy("at", "kind", "n")
    bounds = kept.where("bound is not null")
    paired = bounds.withColumns({"end_at": F.lead("at").over(order), "end_n": F.lead("n").over(order), "end_p": F.lead("p").over(order)})
    return paired.where("bound = 0").select(
        F.col("k").alias(key),
        F.col("at").alias("start_ms"),
        (F.col("end_at") - gap_ms).alias("end_ms"),
        (F.col("end_at") - gap_ms - F.col("at")).alias("duration_ms"),
        (F.col("end_n") - F.col("n") + 1).alias("message_count"),
        (F.col("end_p") - F.col("p")).cast("int").alias("gaps"),
    )

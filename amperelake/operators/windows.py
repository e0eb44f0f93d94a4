"""Ordered operators over one vehicle's rows that stay apart by blocks, so that no vehicle has to fit into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperelake.operators.prefix import blocked_running

BLOCK_MS = 3_600_000


def with_block(df: DataFrame, ts: str = "ts_event_ms", block_ms: int = BLOCK_MS) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(ts) / block_ms))


def previous(df: DataFrame, cols: list[str], ts: str = "ts_event_ms", tie: str = "seq", key: str = "vin", block_ms: int = BLOCK_MS) -> DataFrame:
    """`prev_<c>` of each of `cols` at the row before (by ts, then tie) of the same key; null at the first."""
    r = with_block(df, ts, block_ms).withColumn("_here", F.struct(ts, tie, *(F.col(c).alias(f"prev_{c}") for c in cols)))
    r = blocked_running(r, key, "_block", [ts, tie], {}, {"_prev": "_here"})
    return r.withColumns({f"prev_{c}": F.col(f"_prev.prev_{c}") for c in cols}).drop("_block", "_here", "_prev")


def carried(df: DataFrame, value: Column, name: str, ts: str = "ts_event_ms", tie: str = "seq", key: str = "vin", block_ms: int = BLOCK_MS) -> DataFrame:
    """`name`: the last non-null `value` up to and including each row (forward fill)."""
    r = with_block(df, ts, block_ms).withColumn("_own", value)
    r = r.withColumn("_here", F.when(F.col("_own").isNotNull(), F.struct(ts, tie, "_own")))
    r = blocked_running(r, key, "_block", [ts, tie], {}, {"_last": "_here"})
    return r.withColumn(name, F.coalesce("_own", F.col("_last._own"))).drop("_block", "_own", "_here", "_last")


def running(df: DataFrame, sums: dict[str, Column], ts: str = "ts_event_ms", tie: str = "seq", key: str = "vin", block_ms: int = BLOCK_MS) -> DataFrame:
    """Inclusive running sums by name."""
    r = with_block(df, ts, block_ms).withColumns({f"_s_{n}": c for n, c in sums.items()})
    r = blocked_running(r, key, "_block", [ts, tie], {n: f"_s_{n}" for n in sums})
    return r.drop("_block", *(f"_s_{n}" for n in sums))


def trailing(df: DataFrame, reach_ms: int, aggregates, ts: str = "ts_event_ms", tie: str = "seq", key: str = "vin", block_ms: int = BLOCK_MS, after: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Aggregates over the trailing time frame [ts - reach_ms, ts]; `aggregates(frame)` gives {name: column over the frame}.

    Rows within `reach_ms` of a block's end are also put into the next block, where they only serve as context. A frame
    has all rows of its last instant; each `after` item {name: (column, order)} is the sum of the column over those of
    them that come after the row itself in `order`.
    """
    block = F.floor(F.col(ts) / block_ms)
    last = F.floor((F.col(ts) + reach_ms) / block_ms)
    r = df.withColumns({"_own": block, "_block": F.explode(F.sequence(block, last))})
    frame = Window.partitionBy(key, "_block").orderBy(ts).rangeBetween(-reach_ms, 0)
    r = r.withColumns(aggregates(frame))
    for name, (c, order) in (after or {}).items():
        later = Window.partitionBy(key, "_block", ts).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
        r = r.withColumn(name, F.coalesce(F.sum(c).over(later), F.lit(0)))
    return r.where("_own = _block").drop("_own", "_block")


def monotonic(df: DataFrame, ts: str = "ts_event_ms", arrival: str = "log_offset", key: str = "vin", block: int = 1_000_000) -> DataFrame:
    """Rows that are not older than any row that arrived before them (equal times stay)."""
    r = df.withColumn("_block", F.floor(F.col(arrival) / block))
    r = blocked_running(r, key, "_block", [arrival], {}, {"_newest": ts})
    return r.where(F.col("_newest").isNull() | (F.col(ts) >= F.col("_newest"))).drop("_block", "_newest")


def trapezoid(df: DataFrame, max_gap_ms: int = 300_000) -> DataFrame:
    """Charge and energy of each step from the row before (`step_ah`, `step_kwh`), and whether the step is a gap.

    Steps over `max_gap_ms` are not integrated and count as a gap; steps of no length do neither.
    """
    r = previous(df, ["ts_event_ms", "pack_voltage_v", "pack_current_a"])
    dt = F.col("ts_event_ms") - F.col("prev_ts_event_ms")
    ok = (dt > 0) & (dt <= max_gap_ms)
    i, v, pi, pv = (F.col(c).cast("double") for c in ("pack_current_a", "pack_voltage_v", "prev_pack_current_a", "prev_pack_voltage_v"))
    hours = dt / 3_600_000
    return r.withColumns({
        "step_ah": F.when(ok, (pi + i) / 2 * hours),
        "step_kwh": F.when(ok, (pv * pi + v * i) / 2 * hours / 1000),
        "gap": (F.coalesce(dt, F.lit(0)) > max_gap_ms).cast("int"),
    }).drop("prev_ts_event_ms", "prev_pack_voltage_v", "prev_pack_current_a")


def held(df: DataFrame, condition: Column, hold_ms: int | Column, clear_ms: int | Column, ts: str = "ts_event_ms", tie: str = "seq", key: str = "vin") -> DataFrame:
    """Alert transitions: FIRING once `condition` has held over samples for `hold_ms`, RESOLVED once it has been off for `clear_ms`.

    Result: key, at_ms, state, start_ms (first sample of the condition's run). A run of samples with one outcome is long
    enough if a sample of it lies at least so long after its first (hold 0: the first sample; otherwise a later one). Of
    the runs that are long enough, in order, those that differ from the one before are the transitions, beginning with the
    first that holds. So nothing is folded row by row: the start of each run is carried over blocks, and only runs meet per key.
    Rows where the condition is null are not evaluated.
    """
    r = df.withColumn("_on", condition.cast("int")).where(F.col("_on").isNotNull())
    r = previous(r, ["_on"], ts, tie, key)
    changed = F.col("prev__on").isNull() | (F.col("prev__on") != F.col("_on"))
    r = carried(r, F.when(changed, F.struct(F.col(ts).alias("at"), F.col(tie).alias("tie"))), "_first", ts, tie, key)
    need = F.when(F.col("_on") == 1, hold_ms).otherwise(clear_ms)
    first = (F.col(ts) == F.col("_first.at")) & (F.col(tie) == F.col("_first.tie"))
    long = (F.col(ts) - F.col("_first.at") >= need) & ((need == 0) | ~first)
    hit = r.where(long).groupBy(key, "_on", "_first").agg(F.min(ts).alias("at_ms"))
    w = Window.partitionBy(key).orderBy("_first")
    hit = hit.withColumn("_before", F.coalesce(F.lag("_on").over(w), F.lit(0))).where("_before <> _on")
    start = F.when(F.col("_on") == 1, F.col("_first.at"))
    hit = hit.withColumn("start_ms", F.coalesce(start, F.lag(start).over(w)))
    return hit.select(key, "at_ms", F.when(F.col("_on") == 1, "FIRING").otherwise("RESOLVED").alias("state"), "start_ms")

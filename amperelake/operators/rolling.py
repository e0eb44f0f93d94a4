"""Trailing totals per entity and day from cumulative prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amperelake.common import IST_OFFSET_MS

#: Values are summed as decimals with so many places, so that differences of prefix sums are exact.
EXACT = "decimal(38,9)"


def current_minutes(rollup: DataFrame, *cols: str) -> DataFrame:
    """The latest row (largest `emitted_ms`) of each (vin, minute_start_ms) that is not withdrawn (`sample_count` 0).

    Rows with a null key have no minute and are left out; a null `emitted_ms` is the oldest; of rows that differ but
    share `emitted_ms` the largest in column order counts.
    """
    row = F.struct(F.coalesce("emitted_ms", F.lit(-(2**63))).alias("_e"), "sample_count", *cols)
    return (
        rollup.where("vin is not null and minute_start_ms is not null")
        .groupBy("vin", "minute_start_ms")
        .agg(F.max(row).alias("_r"))
        .select("vin", "minute_start_ms", "_r.sample_count", *(f"_r.{c}" for c in cols))
        .where("sample_count is null or sample_count <> 0")
    )


def local_day(ms: str = "minute_start_ms", offset_ms: int = IST_OFFSET_MS):
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((F.col(ms) + offset_ms) / 86_400_000).cast("int"))


def trailing_totals(minutes: DataFrame, spans: tuple[int, ...] = (7, 30), values: tuple[str, ...] = ("energy_kwh", "distance_km")) -> DataFrame:
    """For every vin and local day from its first to its last day with a minute, totals and averages per trailing span.

    Minutes are summed per day first (map-side combine, exact decimals). The days' cumulative sums are carried forward
    over days without minutes, so the prefix table is dense, and a trailing total is the prefix at the span's last day
    less the prefix at the day before its first (0 before the first day). Windows hold days of one vin, never minutes.

    Result: vin, day_ist, span_days, minutes, and per value total_<v> and avg_<v> (the total over `span_days`).
    Null values count as 0; an empty input gives no row.
    """
    daily = minutes.select("vin", local_day().alias("day"), *(F.coalesce(F.col(v).try_cast(EXACT), F.lit(0).cast(EXACT)).alias(v) for v in values))
    daily = daily.groupBy("vin", "day").agg(F.count(F.lit(1)).alias("n"), *(F.sum(v).cast(EXACT).alias(v) for v in values))
    w = Window.partitionBy("vin").orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    prefix = daily.select("vin", "day", F.sum("n").over(upto).alias("n"), *(F.sum(v).over(upto).cast(EXACT).alias(v) for v in values), F.lead("day").over(w).alias("next"))
    until = F.coalesce(F.date_sub("next", 1), F.col("day"))
    dense = prefix.withColumn("day", F.explode(F.sequence("day", until))).drop("next")
    names = ("n", *values)
    back = dense.withColumns({f"{c}_{k}": F.col(c) - F.coalesce(F.lag(c, k).over(w), F.lit(0)) for c in names for k in spans})
    one = lambda k: F.struct(F.lit(k).alias("span_days"), F.col(f"n_{k}").alias("minutes"), *(F.col(f"{v}_{k}").alias(f"total_{v}") for v in values))
    out = back.select("vin", "day", F.explode(F.array(*map(one, spans))).alias("s"))
    return out.select(
        "vin",
        F.date_format("day", "yyyy-MM-dd").alias("day_ist"),
        "s.span_days",
        "s.minutes",
        *(F.col(f"s.total_{v}").cast("double").alias(f"total_{v}") for v in values),
        *((F.col(f"s.total_{v}").cast("double") / F.col("s.span_days")).alias(f"avg_{v}") for v in values),
    )

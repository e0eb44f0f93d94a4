"""Running sums over keys of any size, by blocks.

A window over a hot key would run in one task. Here every key is cut into blocks; each block is summed by itself and
the totals of the blocks before it are added, so a task holds one block and the carry has one row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blocked_running(df: DataFrame, key: str, block: str, order: list, sums: dict[str, str], latest: dict[str, str] | None = None, whole: dict[str, str] | None = None) -> DataFrame:
    """`df` with, for each `sums` item {name: column}, the inclusive running sum of the column over `key` in `order`,
    for each `latest` item the largest value of the column before the current row (null if there is none), and for each
    `whole` item {name: name in sums} the sum over all rows of the key.

    `block` must not decrease in the order given. Nulls in summed columns count as 0. Empty input gives empty output.
    """
    latest, whole = latest or {}, whole or {}
    here = Window.partitionBy(key, block).orderBy(*order)
    upto, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    local = df
    for name, c in sums.items():
        local = local.withColumn(name, F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto))
    for name, c in latest.items():
        local = local.withColumn(name, F.max(c).over(before))
    totals = df.groupBy(key, block).agg(
        *(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_c_{n}") for n, c in sums.items()),
        *(F.max(c).alias(f"_c_{n}") for n, c in latest.items()),
    )
    past = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        F.col(key).alias("__key"),
        F.col(block).alias("__block"),
        *(F.coalesce(F.sum(f"_c_{n}").over(past), F.lit(0)).alias(f"_c_{n}") for n in sums),
        *(F.max(f"_c_{n}").over(past).alias(f"_c_{n}") for n in latest),
        *(F.sum(f"_c_{n}").over(Window.partitionBy(key)).alias(w) for w, n in whole.items()),
    )
    joined = local.join(carry, (F.col(key) == F.col("__key")) & (F.col(block) == F.col("__block")))
    for n in sums:
        joined = joined.withColumn(n, F.col(n) + F.col(f"_c_{n}"))
    for n in latest:
        joined = joined.withColumn(n, F.coalesce(n, f"_c_{n}"))
    return joined.drop("__key", "__block", *(f"_c_{n}" for n in (*sums, *latest)))

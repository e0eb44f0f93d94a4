"""Latest rows per key, lookups and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amperelake.common import cut, maybe_broadcast


def latest(changes: DataFrame, key: str, order: list[str], deleted: Column | None = None) -> DataFrame:
    """The newest row of each key; keys whose newest row is `deleted` are gone. Rows without a key are left out.

    An aggregation with map-side combine, so a key with very many changes shrinks before the shuffle.
    """
    cols = changes.columns
    flag = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    rest = F.struct(*cols, flag.alias("_gone"))
    newest = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(rest, F.struct(*order)).alias("_r"))
    return newest.where(~F.col("_r._gone")).select(*(F.col(f"_r.{c}").alias(c) for c in cols))


def enrich(events: DataFrame, registry: DataFrame, key: str = "vin", cols: tuple[str, ...] = ("tenant_id", "fleet_id", "depot_id")) -> DataFrame:
    """`events` with registry columns; tenant "" and `registered` false where the vehicle is unknown.

    Columns of `events` that have one of these names are replaced; repeated events stay repeated; a null key is unknown.
    The registry is broadcast only if its counted rows allow; otherwise AQE splits a hot vehicle's rows in the join.
    """
    side = cut(registry.select(key, *cols))
    out = events.drop("registered", *cols).join(maybe_broadcast(side.withColumn("registered", F.lit(True))), key, "left")
    out = out.withColumn("registered", F.coalesce("registered", F.lit(False)))
    return out.withColumn("tenant_id", F.coalesce("tenant_id", F.lit(""))) if "tenant_id" in cols else out


def as_of(events: DataFrame, changes: DataFrame, key: str, event_time: str, change_time: str, cols: list[str], block: int = 86_400_000) -> DataFrame:
    """`events` with the columns of the last change at or before each event (as-of join); null before the first change.

    Both sides become one ordered sequence per key in which changes are carried forward over blocks of time.
    """
    from amperelake.operators.prefix import blocked_running

    e = events.withColumns({"_t": F.col(event_time), "_kind": F.lit(1), "_row": F.struct(*events.columns)})
    c = changes.select(key, F.col(change_time).alias("_t"), F.lit(0).alias("_kind"), F.struct(F.col(change_time).alias("_ct"), *cols).alias("_change"))
    both = e.select(key, "_t", "_kind", "_row").unionByName(c, allowMissingColumns=True).withColumn("_blk", F.floor(F.col("_t") / block))
    both = blocked_running(both, key, "_blk", ["_t", "_kind"], {}, {"_now": "_change"})
    return both.where("_kind = 1").select("_row.*", *(F.col(f"_now.{x}").alias(x) for x in cols))


def top_by_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first `k` rows of each group (`rank` from 1); give pre-aggregated rows."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def heavy_hitters(items: DataFrame, group: list[str], item: str, k: int = 10) -> DataFrame:
    """Exact counts of `item` per group, the `k` most frequent (ties by the smaller item)."""
    counts = items.where(F.col(item).isNotNull()).groupBy(*group, item).agg(F.count(F.lit(1)).alias("n"))
    return top_by_group(counts, group, [F.desc("n"), F.asc(item)], k)


def heavy_hitters_sketch(items: DataFrame, group: list[str], item: str, k: int = 10, tracked: int = 1000) -> DataFrame:
    """As `heavy_hitters`, from a mergeable sketch of at most `tracked` items per group; exact where a group has no more."""
    top = items.where(F.col(item).isNotNull()).groupBy(*group).agg(F.expr(f"approx_top_k({item}, {tracked}, {tracked})").alias("_top"))
    counts = top.select(*group, F.explode("_top").alias("_t")).select(*group, F.col("_t.item").alias(item), F.col("_t.count").alias("n"))
    return top_by_group(counts, group, [F.desc("n"), F.asc(item)], k)


SKETCH_DEPTH, SKETCH_WIDTH = 5, 2719


def _cells(item: str, depth: int, width: int) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(k).alias("row"), F.pmod(F.xxhash64(item, F.lit(k)), F.lit(width)).cast("int").alias("cell")) for k in range(depth)))).alias("c")


def count_table(items: DataFrame, group: list[str], item: str, depth: int = SKETCH_DEPTH, width: int = SKETCH_WIDTH) -> DataFrame:
    """A count-min sketch as a table: per group, hash row and cell the number of items. Two sketches merge by adding up
    cells; errors are at most e / width of all items with a chance of at least 1 - exp(-depth)."""
    return items.where(F.col(item).isNotNull()).select(*group, _cells(item, depth, width)).groupBy(*group, "c.row", "c.cell").agg(F.count(F.lit(1)).alias("n"))


def estimates(table: DataFrame, asked: DataFrame, group: list[str], item: str, depth: int = SKETCH_DEPTH, width: int = SKETCH_WIDTH) -> DataFrame:
    """The sketch's estimate of each distinct (group, item) of `asked`: the smallest of its cells, never under the true
    count; 0 for what the sketch has not seen. A null item has none and is left out."""
    a = asked.where(F.col(item).isNotNull()).select(*group, item).distinct().select(*group, item, _cells(item, depth, width)).select(*group, item, "c.row", "c.cell")
    j = a.join(table, [*group, "row", "cell"], "left")
    return j.groupBy(*group, item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def range_lookup(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, ordinal: str, cols: list[str], cell: int) -> DataFrame:
    """`points` with the columns of the first listed range [start, end) that holds them; null where none does.

    Every cell of width `cell` gets the list of the ranges that touch it, in listed order, so a point meets one row, by an
    equal join on cells, and takes the first range of its list that holds it. Points are neither numbered nor multiplied.
    """
    r = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(end) - 1) / cell))))
    r = cut(r.groupBy("_cell").agg(F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("_o"), F.col(start).alias("_s"), F.col(end).alias("_e"), *cols))).alias("_rs")))
    p = points.withColumn("_cell", F.floor(F.col(point) / cell)).join(maybe_broadcast(r), "_cell", "left")
    p = p.withColumn("_r", F.get(F.filter("_rs", lambda x: (F.col(point) >= x["_s"]) & (F.col(point) < x["_e"])), F.lit(0)))
    return p.select(*points.columns, *(F.col(f"_r.{c}").alias(c) for c in cols))

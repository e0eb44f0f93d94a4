"""Per-minute aggregates by event time, published and then corrected by late messages until a cut-off."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperelake.common import MINUTE_MS, cut
from amperelake.operators.fingertree import FingerTree
from amperelake.sources.versions import VersionedStore

ALLOWED_MS = 30_000
CUTOFF_MS = 7_200_000
BLOCK_MS = 6 * 3_600_000
#: Columns the aggregates read besides the two clocks.
INPUT = ("soc_pct", "speed_kmh", "odo_km", "pack_voltage_v", "pack_current_a", "charge_power_kw", "pack_temp_max_c", "cell_v_min_mv", "cell_v_max_mv", "isolation_kohm")
MEASURES = "soc_min_pct double, soc_max_pct double, soc_avg_pct double, speed_avg_kmh double, distance_km double, energy_kwh double, charge_kwh_grid double, temp_max_c double, imbalance_max_mv double, isolation_min_kohm double"
#: A minute's partial: how each part merges, and its type.
PARTS = {
    "on_time": ("sum", "long"), "correcting": ("sum", "long"), "last_corrected_ms": ("max", "long"), "soc_min": ("min", "double"), "soc_max": ("max", "double"), "soc_sum": ("sum", "double"), "soc_n": ("sum", "long"),
    "speed_sum": ("sum", "double"), "speed_n": ("sum", "long"), "odo_min": ("min", "double"), "odo_max": ("max", "double"), "power_sum": ("sum", "double"), "power_n": ("sum", "long"),
    "charge_sum": ("sum", "double"), "charge_n": ("sum", "long"), "temp_max": ("max", "double"), "imbalance_max": ("max", "double"), "isolation_min": ("min", "double"),
}
#: Minutes as they are kept: key, partial, lost messages.
KEPT = "vin string, block long, minute_start_ms long, lost long, " + ", ".join(f"{n} {t}" for n, (_, t) in PARTS.items())
NAMES = tuple(c.split()[0] for c in KEPT.split(", "))


def _add(a, b):
    return b if a is None else a if b is None else a + b


def _low(a, b):
    return b if a is None else a if b is None or a <= b else b


def _high(a, b):
    return b if a is None else a if b is None or a >= b else b


_HOW = [{"sum": _add, "min": _low, "max": _high}[how] for how, _ in PARTS.values()]


def merge(a: tuple, b: tuple) -> tuple:
    return tuple([f(x, y) for f, x, y in zip(_HOW, a, b)])


class LateMinutes:
    """The minutes of one key: open ones in the tree, those beyond the cut-off evicted as final ones.

    `add` takes partials in the order of the ingest clock. Before each, every minute that ended more than `cutoff_ms`
    before that clock is evicted in bulk; what comes for an evicted minute is lost, what comes for an open one is merged
    into it on the way through the tree. `keep` puts in a minute as an earlier batch left it.
    """

    def __init__(self, cutoff_ms: int = CUTOFF_MS):
        self.cutoff = cutoff_ms
        self.tree = FingerTree(merge)
        self.lost: dict[int, int] = {}
        self.final: dict[int, tuple] = {}
        self.next_evict = None

    def _put(self, minute: int, partial: tuple) -> None:
        self.tree.insert(minute, partial)
        if self.next_evict is None or minute < self.next_evict:
            self.next_evict = minute

    def keep(self, minute: int, lost: int, partial: tuple) -> None:
        if lost:
            self.lost[minute] = self.lost.get(minute, 0) + lost
        self._put(minute, partial)

    def add(self, minute: int, clock: int, n: int, partial: tuple) -> None:
        edge = clock - self.cutoff - MINUTE_MS  # minutes that start before it have ended beyond the cut-off
        if self.next_evict is not None and self.next_evict < edge:
            for m, p in self.tree.evict(edge):
                self.final[m] = merge(self.final[m], p) if m in self.final else p
            self.next_evict = self.tree.first()
        if minute < edge:
            self.lost[minute] = self.lost.get(minute, 0) + n
        else:
            self._put(minute, partial)

    def close(self) -> list[tuple]:
        """(minute, lost, partial or None) of all minutes."""
        for m, p in self.tree.items():
            self.final[m] = merge(self.final[m], p) if m in self.final else p
        return [(m, self.lost.get(m, 0), self.final.get(m)) for m in {**self.final, **self.lost}]


def partials(messages: DataFrame, allowed_ms: int = ALLOWED_MS, cutoff_ms: int = CUTOFF_MS, block_ms: int = BLOCK_MS) -> DataFrame:
    """Per minute and kind of lag (on time, correcting, lost) one partial of its messages, with `clock`, the ingest clock
    of the last of them, and `n`. All messages of one kind meet the tree alike, so they are combined before the shuffle.

    Lag is the ingest clock minus the end of the event minute; late is over `allowed_ms`, lost over `cutoff_ms`. Messages
    without vin or either clock belong to no minute and are left out.
    """
    d = {c: F.col(c).cast("double") for c in INPUT}
    power = d["pack_voltage_v"] * d["pack_current_a"]
    m = messages.where("vin is not null and ts_event_ms is not null and ts_ingest_ms is not null").withColumn("minute_start_ms", F.col("ts_event_ms") - F.pmod("ts_event_ms", F.lit(MINUTE_MS)))
    lag = F.col("ts_ingest_ms") - F.col("minute_start_ms") - MINUTE_MS
    m = m.withColumns({"kind": F.when(lag > cutoff_ms, 2).when(lag > allowed_ms, 1).otherwise(0), "block": F.floor(F.col("minute_start_ms") / block_ms)})
    one = F.count(F.lit(1))
    g = m.groupBy("vin", "block", "minute_start_ms", "kind").agg(
        F.max(F.col("ts_ingest_ms").cast("long")).alias("clock"), one.alias("n"), F.min(d["soc_pct"]).alias("soc_min"), F.max(d["soc_pct"]).alias("soc_max"), F.sum(d["soc_pct"]).alias("soc_sum"), F.count("soc_pct").alias("soc_n"),
        F.sum(d["speed_kmh"]).alias("speed_sum"), F.count("speed_kmh").alias("speed_n"), F.min(d["odo_km"]).alias("odo_min"), F.max(d["odo_km"]).alias("odo_max"), F.sum(power).alias("power_sum"), F.count(power).alias("power_n"),
        F.sum(d["charge_power_kw"]).alias("charge_sum"), F.count("charge_power_kw").alias("charge_n"), F.max(d["pack_temp_max_c"]).alias("temp_max"), F.max(d["cell_v_max_mv"] - d["cell_v_min_mv"]).alias("imbalance_max"),
        F.min(d["isolation_kohm"]).alias("isolation_min"),
    )
    late = F.col("kind") == 1
    g = g.withColumns({"on_time": F.when(late, 0).otherwise(F.col("n")), "correcting": F.when(late, F.col("n")).otherwise(0), "last_corrected_ms": F.when(late, F.col("clock"))})
    return g.select("vin", "block", "minute_start_ms", F.lit(None).cast("long").alias("lost"), *PARTS, "clock", "n")


def through_trees(arriving: DataFrame, kept: DataFrame | None = None, cutoff_ms: int = CUTOFF_MS) -> DataFrame:
    """The minutes (`KEPT`) after the partials of `arriving` went into those of `kept`, whose (vin, minute) they may share.

    Minutes do not depend on one another, so any set of a vehicle's minutes may be in one tree: a tree takes what its
    partition has of one vehicle and block of event time, first what was kept, then what arrives in the order of the
    ingest clock. It holds at most a block's minutes.
    """
    rows = arriving
    if kept is not None:  # one tree needs both sides of a minute
        rows = arriving.unionByName(kept.select(*NAMES), allowMissingColumns=True).repartition("vin", "block")
    rows = rows.select("vin", "block", "minute_start_ms", "lost", *PARTS, F.coalesce("clock", F.lit(-(2**63))).alias("clock"), "n").sortWithinPartitions("vin", "block", "clock", "minute_start_ms")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
        shape = pa.schema([(n, types[t]) for n, t in (c.split() for c in KEPT.split(", "))])
        unit, op, out = None, None, []
        none = (None,) * len(PARTS)

        def closed():
            return [(*unit, m, lost, *(p or none)) for m, lost, p in op.close()] if op else []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)

        for b in batches:
            cols = [b.column(c).to_pylist() for c in b.schema.names]
            for vin, block, minute, lost, *partial, clock, n in zip(*cols):
                if (vin, block) != unit:
                    out += closed()
                    unit, op = (vin, block), LateMinutes(cutoff_ms)
                if n is None:
                    op.keep(minute, lost, tuple(partial))
                else:
                    op.add(minute, clock, n, tuple(partial))
            if len(out) >= 20_000:
                yield batch()
                out.clear()
        out += closed()
        if out:
            yield batch()

    return rows.mapInArrow(run, KEPT)


def published(kept: DataFrame, allowed_ms: int = ALLOWED_MS) -> DataFrame:
    """Minute aggregates as they are published from kept minutes: counts of messages, when they were first published and
    last corrected, and the measures; a minute of lost messages only has null measures and `sample_count` 0."""
    n = F.coalesce(F.col("on_time") + F.col("correcting"), F.lit(0))
    mean = lambda s, c: F.try_divide(F.col(s), F.col(c))
    return kept.select(
        "vin", "minute_start_ms", F.coalesce("on_time", F.lit(0)).cast("int").alias("on_time"), F.coalesce("correcting", F.lit(0)).cast("int").alias("correcting"), F.col("lost").cast("int").alias("lost"),
        F.when(F.col("on_time") > 0, F.col("minute_start_ms") + MINUTE_MS + allowed_ms).alias("first_published_ms"), "last_corrected_ms", n.cast("int").alias("sample_count"),
        F.col("soc_min").alias("soc_min_pct"), F.col("soc_max").alias("soc_max_pct"), mean("soc_sum", "soc_n").alias("soc_avg_pct"), F.when(n > 0, F.coalesce(mean("speed_sum", "speed_n"), F.lit(0.0))).alias("speed_avg_kmh"),
        (F.col("odo_max") - F.col("odo_min")).alias("distance_km"), (mean("power_sum", "power_n") / 60_000).alias("energy_kwh"), (mean("charge_sum", "charge_n") / 60).alias("charge_kwh_grid"),
        F.col("temp_max").alias("temp_max_c"), F.col("imbalance_max").alias("imbalance_max_mv"), F.col("isolation_min").alias("isolation_min_kohm"),
    )


def late_minutes(messages: DataFrame, allowed_ms: int = ALLOWED_MS, cutoff_ms: int = CUTOFF_MS, block_ms: int = BLOCK_MS) -> DataFrame:
    """Minute aggregates of `messages` (one row per message), with how many messages were on time, corrected or lost.

    A lost message is counted and left out of the aggregates. Null readings count in `sample_count` only; ties of the
    ingest clock are taken by minute, which changes nothing; an empty input gives no row.
    """
    return published(through_trees(partials(messages, allowed_ms, cutoff_ms, block_ms), None, cutoff_ms), allowed_ms)


def outcomes(minutes: DataFrame) -> DataFrame:
    """vin, minute_start_ms, outcome: 'corrected' for minutes with a correcting message, 'lost' for those with a lost one."""
    kinds = F.array_compact(F.array(F.when(F.col("correcting") > 0, "corrected"), F.when(F.col("lost") > 0, "lost")))
    return minutes.select("vin", "minute_start_ms", F.explode(kinds).alias("outcome"))


class MinuteStore(VersionedStore):
    """Published minutes that later batches correct, as a table in a shared folder, one folder per block of event time.

    A batch reads and writes only the blocks its messages fall into. The minutes are the same however the messages are
    dealt over batches, and in whichever order the batches come. A batch id that was applied is not applied again.
    """

    def __init__(self, spark, path: str, allowed_ms: int = ALLOWED_MS, cutoff_ms: int = CUTOFF_MS, block_ms: int = BLOCK_MS):
        super().__init__(spark, path)
        self.allowed, self.cutoff, self.block = allowed_ms, cutoff_ms, block_ms

    def _kept(self, m: dict | None, blocks: list[int] | None = None) -> DataFrame:
        folders = [f for b, f in (m["groups"] if m else {}).items() if blocks is None or int(b) in blocks]
        if not folders:
            return self.spark.createDataFrame([], KEPT)
        return self.spark.read.schema(KEPT.replace("block long, ", "")).parquet(*(f"{self.path}/{f}" for f in folders)).withColumn("block", F.floor(F.col("minute_start_ms") / self.block))

    def minutes(self) -> DataFrame:
        """All minutes as they stand."""
        return published(self._kept(self.latest()[1]), self.allowed)

    def apply(self, messages: DataFrame, batch_id: int) -> DataFrame:
        """Take in a batch (one row per message); returns the minutes that it published or corrected, or lost messages of.

        The blocks of a batch, listed on the driver, are a few: those of the hours it spans and of its late messages.
        """
        n, m = self.latest()
        had = self.applied(batch_id)
        if had is None:
            arriving = cut(partials(messages, self.allowed, self.cutoff, self.block))
            blocks = [r.block for r in arriving.select("block").distinct().collect()]
            name = f"minutes/{uuid.uuid4().hex}"
            groups = dict(m["groups"]) if m else {}
            if blocks:
                merged = through_trees(arriving, self._kept(m, blocks), self.cutoff)
                touched = arriving.select("vin", "minute_start_ms").distinct().withColumn("changed", F.lit(True))
                merged = cut(merged.join(touched, ["vin", "minute_start_ms"], "left"))
                merged.drop("changed").repartition("block").write.partitionBy("block").parquet(f"{self.path}/{name}")
                merged.where("changed").drop("changed").write.parquet(f"{self.path}/results/{name}")
                groups |= {str(b): f"{name}/block={b}" for b in blocks}
            had = self.publish(n, batch_id, {"groups": groups, "results": f"results/{name}" if blocks else None})
        results = self.version(had)["results"]
        return published(self.spark.read.schema(KEPT).parquet(f"{self.path}/{results}") if results else self.spark.createDataFrame([], KEPT), self.allowed)

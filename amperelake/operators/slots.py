"""Schedules over fixed slots: loads, limits and sticky places."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amperelake.functions.measures import local_minute, within_shift
from amperelake.operators.prefix import blocked_running
from amperelake.operators.windows import previous, running


def in_slots(intervals: DataFrame, start: str, end: str, slot_ms: int) -> DataFrame:
    """One row per interval [start, end) and slot it touches, with `slot_start`; empty and reversed intervals have none."""
    ok = intervals.where(F.col(start) < F.col(end))
    first = F.col(start) - F.pmod(start, F.lit(slot_ms))
    return ok.withColumn("slot_start", F.explode(F.sequence(first, F.col(end) - 1, F.lit(slot_ms))))


def load_per_slot(slots: DataFrame, site: str, power: str, eps: float = 1e-9) -> DataFrame:
    """Total power and number of active members per site and slot."""
    return slots.groupBy(site, "slot_start").agg(F.sum(power).alias("load_kw"), F.sum((F.col(power) > eps).cast("long")).alias("active"))


def over_limits(load: DataFrame, limits: DataFrame, site: str) -> DataFrame:
    """Slots whose load or number of active members is over the site's `cap_kw` or `connectors`, with the kind of violation."""
    j = load.join(limits, site)
    kinds = F.array_compact(F.array(F.when(F.col("load_kw") > F.col("cap_kw") + 1e-6, "SITE_CAP"), F.when(F.col("active") > F.col("connectors"), "CONNECTORS")))
    return j.select(site, "slot_start", F.explode(kinds).alias("violation"))


#: Slack of comparisons of powers and charge levels.
TOL = 1e-6


def plan_violations(power: DataFrame, tasks: DataFrame, limits: DataFrame | None = None, hours: float = 0.25) -> DataFrame:
    """What a charging plan breaks: site, member (null for site limits), slot, violation.

    `power`: site, member, slot, kw (slots without a row have 0). `tasks`: site, member, soc0_pct, usable_kwh, eta, cap_pct,
    required_pct, plug_slot, depart_slot, levels_kw (array). LEVEL: a power that is no level, unless it just fills the pack;
    OUTSIDE_WINDOW: power while not plugged in; SOC_RANGE: charge level over its cap or under 0 after a slot; DEPARTURE: less
    than required at departure. `limits` (site, cap_kw, connectors), where given: SITE_CAP and CONNECTORS per slot.

    The running charge level is a window over one member's slots of a plan, some hundred rows.
    """
    t = tasks.withColumnRenamed("site", "_site").withColumnRenamed("member", "_member")
    p = power.groupBy("site", "member", "slot").agg(F.sum("kw").alias("kw")).join(t, (F.col("site") == F.col("_site")) & (F.col("member") == F.col("_member")))
    upto = Window.partitionBy("site", "member").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.col("eta") * F.col("kw") * hours / F.col("usable_kwh") * 100
    p = p.withColumn("soc", F.col("soc0_pct") + F.sum(gain).over(upto))
    fills = (F.abs(F.col("soc") - F.col("cap_pct")) <= TOL) & (F.col("kw") <= F.array_max("levels_kw") + TOL)
    level = F.exists("levels_kw", lambda x: F.abs(F.col("kw") - x) <= TOL)
    kinds = F.array_compact(F.array(
        F.when(~fills & ~level, "LEVEL"),
        F.when((F.col("kw") > TOL) & ~((F.col("slot") >= F.col("plug_slot")) & (F.col("slot") < F.col("depart_slot"))), "OUTSIDE_WINDOW"),
        F.when((F.col("soc") > F.col("cap_pct") + TOL) | (F.col("soc") < -TOL), "SOC_RANGE"),
    ))
    out = p.select("site", "member", "slot", F.explode(kinds).alias("violation"))
    before = F.max_by("soc", F.when(F.col("slot") < F.col("depart_slot"), F.col("slot")))
    ends = p.groupBy("site", "member").agg(before.alias("soc")).withColumnsRenamed({"site": "_s", "member": "_m"})
    left = t.join(ends, (F.col("_site") == F.col("_s")) & (F.col("_member") == F.col("_m")), "left").where(F.coalesce("soc", "soc0_pct") < F.col("required_pct") - TOL)
    out = out.unionByName(left.select(F.col("_site").alias("site"), F.col("_member").alias("member"), F.col("depart_slot").alias("slot"), F.lit("DEPARTURE").alias("violation")))
    if limits is not None:
        load = load_per_slot(power.withColumnRenamed("slot", "slot_start"), "site", "kw")
        over = over_limits(load, limits, "site")
        out = out.unionByName(over.select("site", F.lit(None).cast("string").alias("member"), F.col("slot_start").cast("int").alias("slot"), "violation"))
    return out


def stays(vehicles: DataFrame, start_ms: int, slot_min: int = 15, horizon_slots: int = 144, new_slots: int = 96) -> DataFrame:
    """vin, plug_slot, depart_slot, has_departure: when each vehicle stands at its depot by its duty, from `start_ms` on.

    `vehicles`: vin, depart_min_ist, return_min_ist, at_depot. A stay that lasts at the start, or begins within `new_slots`,
    counts; coming in is rounded up to a slot and leaving down, so a stay is never longer than it is; one that outlasts
    the horizon has no departure. Vehicles without duty times have no stay.
    """
    first = int((start_ms + 19_800_000) // 60_000 % 1440)
    end = horizon_slots * slot_min
    v = vehicles.where("depart_min_ist is not null and return_min_ist is not null").withColumns({"_d": F.pmod(F.col("depart_min_ist") - first, F.lit(1440)), "_r": F.pmod(F.col("return_min_ist") - first, F.lit(1440))})
    days = range(-1, end // 1440 + 2)
    # a stay goes from a return to the next departure; a vehicle that is out now has no stay before its next return
    one = lambda k: F.struct((F.col("_r") + 1440 * k).alias("a"), (F.col("_d") + 1440 * k + F.when(F.col("_d") > F.col("_r"), 0).otherwise(1440)).alias("z"))
    s = v.select("vin", "at_depot", F.explode(F.array(*map(one, days))).alias("s"), F.col("_d").alias("next"))
    now = v.where("at_depot").select("vin", F.lit(0).alias("a"), F.col("_d").alias("z"))
    s = s.where((F.col("s.a") >= 0) & (~F.col("at_depot") | (F.col("s.a") >= F.col("next")))).select("vin", "s.a", "s.z").unionByName(now)
    s = s.where(F.col("a") < end)
    out = s.select("vin", F.ceil(F.col("a") / slot_min).cast("int").alias("plug_slot"), F.when(F.col("z") < end, F.floor(F.col("z") / slot_min)).otherwise(horizon_slots).cast("int").alias("depart_slot"), (F.col("z") < end).alias("has_departure"))
    return out.where((F.col("plug_slot") < new_slots) & (F.col("depart_slot") > F.col("plug_slot")))


RUNS = "site string, member string, first int, last int, place int"


def runs_of(active: DataFrame) -> DataFrame:
    """Maximal runs of successive slots of each (site, member): site, member, first, last; repeated rows count once."""
    a = active.select("site", "member", "slot").dropna().distinct().withColumn("_key", F.concat_ws("|", F.length("site").cast("string"), "site", "member"))
    a = previous(a, ["slot"], ts="slot", tie="slot", key="_key", block_ms=10_000)
    a = running(a, {"_run": F.coalesce(F.col("slot") - F.col("prev_slot") > 1, F.lit(True)).cast("int")}, ts="slot", tie="slot", key="_key", block_ms=10_000)
    return a.groupBy("site", "member", "_run").agg(F.min("slot").alias("first"), F.max("slot").alias("last")).drop("_run")


def place_runs(runs: DataFrame, places: int, strict: bool = True) -> DataFrame:
    """`runs` with `place` (0 to places - 1): a run holds its place throughout; those that begin take the lowest places
    that are free, in order of members. Where none is free the job fails if `strict`, else the run has none (null).

    A site's runs are dealt into busy periods, between which no place is held, so each period is worked by itself, by a
    heap of the free places and one of the ends of held ones; a task streams its runs in order of their first slot.
    """
    r = blocked_running(runs.withColumn("_block", F.floor(F.col("first") / 10_000)), "site", "_block", ["first", "member"], {}, {"_held": "last"})
    r = r.withColumn("_new", F.coalesce(F.col("first") > F.col("_held"), F.lit(True)).cast("int"))
    r = blocked_running(r, "site", "_block", ["first", "member"], {"period": "_new"})
    r = r.select("site", "period", "member", "first", "last").repartition("site", "period").sortWithinPartitions("site", "period", "first", "member")

    def run(batches: Iterator) -> Iterator:
        import heapq

        import pyarrow as pa

        unit, free, held = None, [], []
        for b in batches:
            got = []
            for site, period, first, last in zip(*(b.column(c).to_pylist() for c in ("site", "period", "first", "last"))):
                if (site, period) != unit:
                    unit, free, held = (site, period), list(range(places)), []
                while held and held[0][0] < first:
                    heapq.heappush(free, heapq.heappop(held)[1])
                if not free and strict:
                    raise ValueError(f"site {site}: more than {places} members in slot {first}")
                got.append(heapq.heappop(free) if free else None)
                if got[-1] is not None:
                    heapq.heappush(held, (last, got[-1]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("site", "member", "first", "last")), pa.array(got, pa.int32())], names=["site", "member", "first", "last", "place"])

    return r.mapInArrow(run, RUNS)


def sticky_places(active: DataFrame, places: int, strict: bool = True) -> DataFrame:
    """site, slot, member, place of each active (site, slot, member), as `place_runs` gives them; rows with nulls are left
    out, repeated ones count once, an empty input gives no row."""
    placed = place_runs(runs_of(active.withColumn("slot", F.col("slot").cast("int"))), places, strict)
    return placed.select("site", F.explode(F.sequence("first", "last")).alias("slot"), "member", "place")


def on_shift(events: DataFrame, ts: str = "ts_event_ms", start: str = "depart_min_ist", end: str = "return_min_ist") -> DataFrame:
    """Adds `on_duty`: whether an event's local minute is within its vehicle's shift, over midnight too."""
    return events.withColumn("on_duty", within_shift(local_minute(F.col(ts)), F.col(start), F.col(end)))

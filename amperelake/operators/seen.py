"""Exactly one copy of messages that were delivered at least once, by sharded compressed seen-bitmaps.

A message (vin, seq) is a bit: the vehicle's exact dictionary id and the upper part of `seq` name a shard, the lower 16
bits a place in it. A shard's bitmap is kept in one of three forms, whichever is smallest: its places, its runs, or 8 KiB
of bits. A batch takes one arrival per bit that is not set and then sets those bits; `SeenStore` keeps bitmaps and
dictionary between batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amperelake.common import cut, maybe_broadcast
from amperelake.sources.versions import VersionedStore

#: Bits of a shard.
PLACES = 65_536
#: Hash shards of the dictionary, and groups of bitmap shards that are written together.
SHARDS, GROUPS = 256, 64
#: Ranges of the log that a whole table is taken in.
BATCHES = 3

STATE = "vin_id long, high long, bits binary"
DICTIONARY = "vin string, vin_id long"
DECIDED = "kind int, vin_id long, high long, log_offset long, bits binary"
KEPT, SURPLUS, BITMAP = 0, 1, 2


def packed(places: np.ndarray) -> bytes:
    """Sorted distinct places (under 65,536) in the smallest of three forms, named by the first byte."""
    cuts = np.flatnonzero(np.diff(places) != 1)
    first, last = places[np.append(0, cuts + 1)], places[np.append(cuts, len(places) - 1)]
    if 4 * len(first) < min(2 * len(places), PLACES // 8):
        return b"r" + np.stack([first, last]).astype("<u2").tobytes()
    if 2 * len(places) < PLACES // 8:
        return b"p" + places.astype("<u2").tobytes()
    bits = np.zeros(PLACES, bool)
    bits[places] = True
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The bits of a shard as 65,536 booleans."""
    kind, body = data[:1], data[1:]
    if kind == b"b":
        return np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little").astype(bool)
    at = np.frombuffer(body, "<u2").astype(np.int64)
    if kind == b"p":
        bits = np.zeros(PLACES, bool)
        bits[at] = True
        return bits
    first, last = at.reshape(2, -1)
    edge = np.zeros(PLACES + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    return np.cumsum(edge)[:PLACES].astype(bool)


def new_ids(vins: DataFrame, known: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """Exact ids of the distinct `vin` values that `known` does not have; null is a value like any other.

    Ids are dense within a hash shard (rank * shards + shard), so they are given in parallel and never collide.
    """
    new = vins.select("vin").distinct().withColumn("shard", F.pmod(F.xxhash64("vin"), F.lit(shards)))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy("vin"))
    if known is None:
        return new.select("vin", ((rank - 1) * shards + F.col("shard")).cast("long").alias("vin_id"))
    had = known.groupBy(F.pmod("vin_id", F.lit(shards)).alias("_s")).agg(F.max("vin_id").alias("_top"))
    fresh = new.join(known.select(F.col("vin").alias("_v")), F.col("vin").eqNullSafe(F.col("_v")), "left_anti")
    fresh = fresh.join(had, F.col("shard") == F.col("_s"), "left")
    base = F.coalesce(F.col("_top"), F.col("shard") - shards)
    return fresh.select("vin", (base + rank * shards).cast("long").alias("vin_id"))


def encode(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """`rows` (vin, seq, log_offset) as vin_id, high, low, log_offset; a row without offset counts as the last."""
    side = maybe_broadcast(ids).withColumnRenamed("vin", "_v")
    return rows.join(side, F.col("vin").eqNullSafe(F.col("_v"))).select(
        "vin_id", F.floor(F.col("seq") / PLACES).alias("high"), F.pmod("seq", F.lit(PLACES)).cast("int").alias("low"), F.coalesce("log_offset", F.lit(2**63 - 1)).alias("log_offset")
    )


def _combine(batches: Iterator) -> Iterator:
    """Adds `first`: false for rows whose bit has an earlier row in the same Arrow batch, which are surplus whatever comes
    (null where there is no bit). So what a message delivered very often sends through the shuffle is one row per Arrow batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        none = pc.is_null(b.column("high")).to_numpy(zero_copy_only=False)
        vin, high, low, log = (pc.fill_null(b.column(c), 0).to_numpy(zero_copy_only=False) for c in ("vin_id", "high", "low", "log_offset"))
        order = np.lexsort((log, low, high, vin, none))
        v, h, p, n = vin[order], high[order], low[order], none[order]
        first = np.empty(len(order), bool)
        first[order] = np.append(True, (v[1:] != v[:-1]) | (h[1:] != h[:-1]) | (p[1:] != p[:-1]) | (n[1:] != n[:-1]))[: len(order)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first, mask=none)], names=[*b.schema.names, "first"])


class _Shard:
    """The bits of the shard that is being worked on."""

    def __init__(self, vin_id: int, high: int):
        self.key, self.bits, self.grown = (vin_id, high), None, False

    def take(self, low: np.ndarray, known: list[bytes]) -> np.ndarray:
        """Which of the arrivals, in order, set a bit that is not set; their bits are set."""
        if self.bits is None:
            self.bits = unpacked(known[0]) if known else np.zeros(PLACES, bool)
        places, at = np.unique(low, return_index=True)
        fresh = ~self.bits[places]
        self.bits[places] = True
        self.grown |= bool(fresh.any())
        out = np.zeros(len(low), bool)
        out[at[fresh]] = True
        return out


def _decide(batches: Iterator) -> Iterator:
    """Rows sorted by shard, with the shard's bitmap before its arrivals, and these by offset: one row per arrival (kept
    or surplus) and one per shard whose bitmap grew. A shard may go over several Arrow batches; only its bits are held."""
    import pyarrow as pa

    shape = pa.schema([("kind", pa.int32()), ("vin_id", pa.int64()), ("high", pa.int64()), ("log_offset", pa.int64()), ("bits", pa.binary())])
    now: _Shard | None = None

    def grown(shards):
        rows = [(BITMAP, *s.key, None, packed(np.flatnonzero(s.bits))) for s in shards]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

    known: list[bytes] = []
    for b in batches:
        vin, high, kind, low, log = (b.column(c).to_numpy(zero_copy_only=False) for c in ("vin_id", "high", "kind", "low", "log_offset"))
        bits, done, verdict = b.column("bits"), [], np.full(len(vin), SURPLUS, np.int32)
        cuts = np.flatnonzero((np.diff(vin) != 0) | (np.diff(high) != 0)) + 1
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(vin))):
            key = (int(vin[lo]), int(high[lo]))
            if now is None or now.key != key:
                if now is not None and now.grown:
                    done.append(now)
                now, known = _Shard(*key), []
            rows = lo + int(np.searchsorted(kind[lo:hi], 1))  # bitmaps come first
            known += [bits[i].as_py() for i in range(lo, rows)]
            if rows < hi:
                verdict[rows:hi][now.take(low[rows:hi].astype(np.int64), known)] = KEPT
        at = kind == 1
        n = int(at.sum())
        yield pa.RecordBatch.from_arrays([pa.array(verdict[at]), pa.array(vin[at]), pa.array(high[at]), pa.array(log[at]), pa.nulls(n, pa.binary())], schema=shape)
        if done:
            yield grown(done)
    if now is not None and now.grown:
        yield grown([now])


class Arrivals:
    """The outcome of one batch: `surplus` and `kept` (log_offset), and the bitmaps that grew (`state`)."""

    def __init__(self, surplus: DataFrame, kept: DataFrame, state: DataFrame):
        self.surplus, self.kept, self.state = surplus, kept, state


def arrived(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows encoded, and combined where they are read, as a table that is cut off: it is read several times."""
    enc = encode(rows.select("vin", "seq", "log_offset"), ids)
    return cut(enc.mapInArrow(_combine, "vin_id long, high long, low int, log_offset long, first boolean"))


def decided(combined: DataFrame, seen: DataFrame | None = None) -> Arrivals:
    """The outcome of what `arrived`, against the bitmaps `seen`."""
    arrive = combined.where("first").select("vin_id", "high", F.lit(1).alias("kind"), "low", "log_offset", F.lit(None).cast("binary").alias("bits"))
    if seen is not None:
        arrive = arrive.unionByName(seen.select("vin_id", "high", F.lit(0).alias("kind"), F.lit(0).alias("low"), F.lit(0).cast("long").alias("log_offset"), "bits"))
    out = cut(arrive.repartition("vin_id", "high").sortWithinPartitions("vin_id", "high", "kind", "log_offset").mapInArrow(_decide, DECIDED))
    of = lambda k: out.where(F.col("kind") == k)
    surplus = of(SURPLUS).select("log_offset").unionByName(combined.where("not first").select("log_offset"))
    kept = of(KEPT).select("log_offset").unionByName(combined.where("first is null").select("log_offset"))
    return Arrivals(surplus, kept, of(BITMAP).select("vin_id", "high", "bits"))


def select_arrivals(rows: DataFrame, ids: DataFrame, seen: DataFrame | None = None) -> Arrivals:
    """Of the arrivals of each bit that is not set in `seen` the one with the smallest `log_offset` is kept; all others,
    and those of bits that are set, are surplus.

    Arrivals are combined where they are read, then meet the bitmap of their shard (at most 65,536 messages of a vehicle)
    in one pass in order of offset, which tests and sets bits. Neither a hot vehicle nor a hot message is gathered: the
    one has many shards, the other one row per Arrow batch. Rows with a null `seq` identify nothing and are kept. Columns
    other than vin, seq and log_offset are ignored. `log_offset` tells rows apart; of exact repeats with one offset one
    is kept. The three results come from tables that are cut off, so they agree whatever is computed again.
    """
    return decided(arrived(rows, ids), seen)


def kept_rows(batch: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `batch` whose `log_offset` was kept, one of each that cannot be told apart by vin, seq and offset."""
    place = F.coalesce("log_offset", F.lit(2**63 - 1))
    rows = batch.withColumn("_place", place).join(kept.select(F.col("log_offset").alias("_place")).distinct(), "_place", "left_semi")
    return rows.dropDuplicates(["_place", "vin", "seq"]).drop("_place")


class SeenStore(VersionedStore):
    """Dictionary and bitmaps kept between batches as tables in a shared folder.

    A version names the dictionary's files, the newest file of each group of shards, and the results of its batch. A batch
    writes its results, the new words of the dictionary and the groups whose shards grew, then publishes: its bits are
    united wholly or not at all, and of two writers one fails. A batch id that was applied gives back the results of then,
    at any later time and in any order of ids.
    """

    def _results(self, version: int) -> Arrivals:
        base = f"{self.path}/{self.version(version)['results']}"
        read = lambda t: self.spark.read.schema("log_offset long").parquet(f"{base}/{t}")
        return Arrivals(read("surplus"), read("kept"), self.spark.createDataFrame([], STATE))

    def tables(self, m: dict | None, groups: list[int] | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """Dictionary and bitmaps (of some groups, if given) of a version."""
        if m is None:
            return None, None
        files = [f for g, f in m["groups"].items() if groups is None or int(g) in groups]
        read = lambda s, ps: self.spark.read.schema(s).parquet(*(f"{self.path}/{p}" for p in ps)) if ps else None
        return read(DICTIONARY, m["dictionary"]), read(STATE, files)

    def apply(self, batch: DataFrame, batch_id: int) -> Arrivals:
        """The outcome of `batch`; for a batch id that was applied before, its outcome then. Raises `Behind` if another
        writer came first, in which case nothing of this batch is in the store."""
        n, m = self.latest()
        if (had := self.applied(batch_id)) is not None:
            return self._results(had)
        name = uuid.uuid4().hex
        batch = batch.select("vin", "seq", "log_offset")
        known, _ = self.tables(m)
        words = f"dictionary/{name}"
        new_ids(batch, known).write.parquet(f"{self.path}/{words}")
        ids = self.tables({"dictionary": [*(m["dictionary"] if m else []), words], "groups": {}})[0]
        group = F.pmod(F.xxhash64("vin_id", "high"), F.lit(GROUPS)).cast("int").alias("group")
        combined, seen = arrived(batch, ids), None
        if m is not None:
            touched = [r.group for r in combined.where("first").select(group).distinct().collect()]  # at most GROUPS
            _, seen = self.tables(m, touched)
        got = decided(combined, seen)
        got.kept.write.parquet(f"{self.path}/results/{name}/kept")
        got.surplus.write.parquet(f"{self.path}/results/{name}/surplus")
        grown = got.state.withColumn("group", group)
        changed = [r.group for r in grown.select("group").distinct().collect()]
        groups = dict(m["groups"]) if m else {}
        if changed:
            if seen is not None:  # shards of a changed group that did not grow go along as they are
                old = seen.withColumn("group", group).where(F.col("group").isin(changed))
                grown = grown.unionByName(old.join(grown.select("vin_id", "high"), ["vin_id", "high"], "left_anti"))
            grown.repartition("group").write.option("compression", "zstd").partitionBy("group").parquet(f"{self.path}/bits/{name}")
            groups |= {str(g): f"bits/{name}/group={g}" for g in changed}
        dictionary = [*(m["dictionary"] if m else []), words]
        if len(dictionary) > 32:  # few files however many batches
            self.tables({"dictionary": dictionary, "groups": {}})[0].write.parquet(f"{self.path}/dictionary/all-{name}")
            dictionary = [f"dictionary/all-{name}"]
        return self._results(self.publish(n, batch_id, {"results": f"results/{name}", "dictionary": dictionary, "groups": groups}))

    def _folders(self, m: dict) -> set[str]:
        return {*m["groups"].values(), *m["dictionary"]}


def replayed(log: DataFrame, path: str, batches: int = BATCHES) -> list[Arrivals]:
    """A whole table taken as it would have come: in `batches` ranges of `log_offset`, one after the other, through a
    `SeenStore` at `path`. So an arrival is always held against all earlier ones, in its own batch or before."""
    spark = log.sparkSession
    rows = log.select("vin", "seq", "log_offset")
    edges = rows.select(F.percentile_approx("log_offset", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    store, out = SeenStore(spark, path), []
    at = F.coalesce("log_offset", F.lit(2**63 - 1))
    for k, (lo, hi) in enumerate(zip([None, *edges], [*edges, None])):
        part = rows if lo is None else rows.where(at > lo)
        out.append(store.apply(part if hi is None else part.where(at <= hi), k))
    return out

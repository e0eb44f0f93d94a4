"""Documents laid whole into containers of fixed capacity, with certified bounds on the number of containers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Items a partition packs at once, and rounds of exchange between partitions whose bin count is not certified.
PER_PARTITION = 20_000
ROUNDS = 4


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """A number of bins no packing can do with less, from `counts[s]`, the number of items of size s (0 <= s <= capacity).

    The largest sum over two families of dual-feasible functions: thresholds a (items over capacity - a count whole, items
    under a nothing, others their share), and k-step roundings of the share.
    """
    sizes = np.arange(capacity + 1)
    n = np.cumsum(counts)
    weight = np.cumsum(counts * sizes)
    a = np.arange(0, capacity // 2 + 1)
    whole = n[-1] - n[capacity - a]
    middle = weight[capacity - a] - np.where(a > 0, weight[np.maximum(a - 1, 0)], 0)
    best = int(np.max(whole + -(-middle // capacity)))
    for k in range(1, 33):
        steps = (k + 1) * sizes
        scaled = np.where(steps % capacity == 0, sizes * k, steps // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((scaled * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number of each item and fill of each bin: largest items first, each into the fullest bin that holds it.

    The rooms of open bins are bits of one integer, so the tightest bin is found without a search over bins.
    """
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, used = 0, 0
    for i in order.tolist():
        s = int(sizes[i])
        fit = open_rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        bins[i] = b
        if room > s:
            left = room - s
            rooms[left].append(b)
            open_rooms |= 1 << left
    fill = np.bincount(bins, weights=sizes, minlength=used).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    return bins, fill


PACKED = "row long, doc string, piece int, n_tokens int, part int, bin long, fill int, gap int"


def _pack(capacity: int):
    def run(key, pdf):
        pdf = pdf.sort_values(["n_tokens", "row", "piece"], ascending=[False, True, True], kind="stable")
        sizes = pdf["n_tokens"].to_numpy(np.int64)
        bins, fill = best_fit_decreasing(sizes, capacity)
        gap = len(fill) - lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        return pdf.assign(part=np.int32(key[0]), bin=bins, fill=fill[bins].astype(np.int32), gap=np.int32(gap))[[c.split()[0] for c in PACKED.split(", ")]]

    return run


def pack(counts: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, rounds: int = ROUNDS, cut=None) -> DataFrame:
    """Containers for `counts` (doc_id, n_tokens): container_id, doc_id, piece, token_start, n_tokens, fill (tokens in the
    container), certified.

    A document over the capacity gives full containers of its own and one item with the rest; any other stays whole.
    Items are spread by hash over partitions of about `per_partition`, each packed best-fit decreasing; a partition whose
    bin count equals its dual-feasible bound is certified and final. The others keep their full bins and exchange the
    documents of the rest: these are spread anew and packed again, up to `rounds` times; the one poorly filled bin that
    each partition may have left goes with them. `certified` is whether a container was made by a partition that uses no
    more bins than its bound, or is full; containers of the last round's partitions with a gap are not.

    Every token is in exactly one row. Empty documents (n_tokens 0 or null) have one row with null container_id and
    certified. Every row of `counts` is a document of its own, with repeated and null doc_ids too: rows are numbered in a
    table that is cut off before the numbers are used, so they stay. An empty table gives no row. No task holds more than
    about `per_partition` items, and the driver sees counts only.
    """
    from amperelake.common import cut as checkpointed

    cut = cut or checkpointed
    id_type = dict(counts.dtypes)["doc_id"]
    docs = cut(counts.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc"), F.coalesce("n_tokens", F.lit(0)).cast("int").alias("n")))
    pieces = docs.where("n > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))))
    pieces = pieces.select("row", "doc", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("n_tokens"))
    cols = ("doc", "piece", "n_tokens", "fill", "certified")
    whole = pieces.where(f"n_tokens = {capacity}").withColumns({"fill": F.col("n_tokens"), "certified": F.lit(True)})
    out = whole.select(F.concat_ws("-", F.lit("w"), "row", "piece").alias("container_id"), *cols)
    nothing = docs.where("n <= 0").select("doc", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), F.lit(None).cast("int").alias("fill"), F.lit(None).cast("boolean").alias("certified"))
    out = out.unionByName(nothing.select(F.lit(None).cast("string").alias("container_id"), *cols))
    todo = pieces.where(f"n_tokens < {capacity}")
    todo_n = todo.count()
    for r in range(rounds + 1):
        if todo_n == 0:
            break
        parts = math.ceil(todo_n / per_partition)
        spread = todo.withColumn("part", F.pmod(F.xxhash64("row", "piece", F.lit(r)), F.lit(parts)).cast("int"))
        packed = cut(spread.groupBy("part").applyInPandas(_pack(capacity), PACKED))
        packed = packed.withColumn("certified", (F.col("gap") == 0) | (F.col("fill") == capacity))
        last = r == rounds or parts == 1  # one partition is the whole rest, there is nobody to exchange with
        again = F.lit(False) if last else ~F.col("certified") | (F.col("fill") < capacity // 2)
        out = out.unionByName(packed.where(~again).select(F.concat_ws("-", F.lit(f"r{r}"), "part", "bin").alias("container_id"), *cols))
        todo = packed.where(again).select("row", "doc", "piece", "n_tokens")
        todo_n = 0 if last else todo.count()
    start = (F.col("piece").cast("long") * capacity).alias("token_start")
    return out.select("container_id", F.col("doc").cast(id_type).alias("doc_id"), "piece", start, "n_tokens", "fill", "certified")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row over the whole packing: containers, how many of them are certified in their partition, tokens, unused
    share, and the certified bound on the containers of all items together.

    The bound needs only the histogram of item sizes, at most `capacity` rows, which the driver gets.
    """
    spark = packed.sparkSession
    items = packed.where("container_id is not null")
    hist = {r.n_tokens: r["count"] for r in items.groupBy("n_tokens").count().collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for s, c in hist.items():
        counts[s] = c
    tokens = int((counts * np.arange(capacity + 1)).sum())
    used, sure = items.select("container_id", "certified").distinct().agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("certified").cast("long")), F.lit(0))).first()
    row = (used, sure, tokens, 1 - tokens / (used * capacity) if used else 0.0, lower_bound(counts, capacity) if used else 0)
    return spark.createDataFrame([row], "containers long, certified long, tokens long, unused double, bound long")

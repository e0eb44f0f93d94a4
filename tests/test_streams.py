"""Streams over files against their batch twins."""

import random

from amperelake.operators.registry import latest
from amperelake.streaming import pipeline

T0 = 1_780_000_000_000 - 1_780_000_000_000 % 60_000


def test_streams(spark, telemetry, tmp_path):
    r = random.Random(1)
    rows = [{"vin": r.choice("AB"), "seq": i, "ts_event_ms": T0 + i * 20_000, "ts_ingest_ms": T0 + i * 20_000 + 500, "pack_temp_max_c": 55.0 if 20 < i < 40 else 30.0} for i in range(90)]
    rows += rows[:30]
    path = str(tmp_path / "telemetry.parquet")
    telemetry(rows, clash=False).repartition(3).write.parquet(path)
    src = lambda: pipeline.telemetry_stream(spark, path)
    once = pipeline.drain(pipeline.without_repeats(src()).select("vin", "seq"))
    assert once.count() == once.distinct().count() == 90


def test_batches_written_again_leave_no_copies(spark, tmp_path):
    a = spark.createDataFrame([("A", 1), ("B", 2)], "vin string, t long")
    b = spark.createDataFrame([("A", 3)], "vin string, t long")
    now = pipeline.upsert(pipeline.upsert(None, a, "vin", ["t"]), b, "vin", ["t"])
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, pipeline.upsert(now, b, "vin", ["t"]).collect())) == [("A", 3), ("B", 2)]
    assert latest(a, "vin", ["t"]).count() == 2

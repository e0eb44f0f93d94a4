"""Files, encoders against decoders, and the generator."""

from pyspark.sql import functions as F

from amperelake.common import messages
from amperelake.operators import sessions, validate
from amperelake.sources import decode, files, generate

T0 = 1_780_000_000_000


def fleet_and_rows(spark, steps=200):
    v = generate.fleet(spark, 12)
    return v, generate.telemetry(v, T0, steps)


def test_generated_rows_are_valid_and_the_same_on_any_partitioning(spark):
    v, t = fleet_and_rows(spark)
    assert t.count() > 12 * 200 and messages(t, "ts_event_ms").count() == 12 * 200
    assert validate.route(t, validate.chain({"0EA": "oem_a", "0EB": "oem_b", "0EC": "oem_c"})).where("reason is not null").count() == 0
    again = generate.telemetry(v.repartition(7), T0, 200)
    assert t.exceptAll(again).count() == 0
    assert sessions.sweep_sessions(messages(t, "ts_event_ms")).count() == 12


def test_what_is_encoded_is_decoded(spark):
    _, t = fleet_and_rows(spark, 20)
    t = t.withColumns({"lat": F.when(F.col("seq") != 3, F.col("lat")), "lon": F.when(F.col("seq") != 3, F.col("lon")), "speed_kmh": F.when(F.col("seq") != 3, F.col("speed_kmh")), "dtc": F.array(F.lit("P0A7E"), F.lit("U0111"))})
    out = decode.decode(files.encode(t))
    assert out.where("reason is not null").count() == 0
    same = ("vin", "seq", "evt", "charge_state", "dtc", "hv_interlock_ok", "cell_v_min_mv")
    assert t.select(*same).exceptAll(out.select(*same)).count() == 0
    j = out.select("vin", "seq", F.col("odo_km").alias("o"), F.col("pack_temp_max_c").alias("c"), F.col("speed_kmh").alias("s")).distinct().join(t.dropDuplicates(["vin", "seq"]), ["vin", "seq"])
    bad = j.where((F.abs(F.col("o") - F.col("odo_km")) > 1e-6) | (F.abs(F.col("c") - F.col("pack_temp_max_c")) > 1e-4) | (F.col("s").isNull() != F.col("speed_kmh").isNull()) | (F.abs(F.col("s") - F.col("speed_kmh")) > 1e-4))
    assert bad.count() == 0


def test_stored_messages_are_keyed_and_pruned(spark, tmp_path):
    _, t = fleet_and_rows(spark, 30)
    path = str(tmp_path / "raw")
    files.store_messages(t, path)
    files.store_messages(t, path)
    assert spark.read.parquet(path).count() == 12 * 30
    files.store_messages(t.withColumns({"ts_event_ms": F.col("ts_event_ms") + 86_400_000, "evt": F.lit(2)}), path)
    files.store_messages(t.where("seq = 5").withColumn("evt", F.lit(3)), path)
    back = spark.read.parquet(path)
    assert back.count() == 2 * 12 * 30 and back.where("evt = 3").count() == 12
    vin = t.first().vin
    one = files.stored_on(spark, path, vin, T0 // 86_400_000)
    assert one.count() == 30 and "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().toString()


def test_csv_and_catalogue(spark, tmp_path):
    path = str(tmp_path / "dtc")
    rows = [("P0A7E", "powertrain", "CRITICAL", "Over temperature", None, "R", "x")]
    files.write_csv(spark.createDataFrame(rows, files.CSV_SCHEMAS["dtc_catalogue"]), path)
    cat = files.read_csv(spark, path, "dtc_catalogue")
    got = files.with_severity(spark.createDataFrame([("p0a7e ",), ("U0000",), (None,)], "code string"), cat).collect()
    assert sorted((r.code or "", r.severity) for r in got) == [("", "warning"), ("U0000", "warning"), ("p0a7e ", "critical")]
    d = files.delta_json(spark.createDataFrame([("A", 1.5, None)], "vin string, soc double, lat double"), ("soc", "lat")).first().delta
    assert d == '{"vin":"A","soc":1.5}'

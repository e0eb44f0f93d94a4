"""Reference tables, stored messages and the wire formats as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amperelake.common import DAY_MS
from amperelake.functions.identity import dtc_word
from amperelake.functions.measures import KM_PER_MILE
from amperelake.sources.decode import CHARGES, EVENTS, PLACES_C

# Columns of the reference and master-data files.
CSV_SCHEMAS = {
    "dtc_catalogue": "code string, system string, severity string, description string, sim_fault string, runbook_id string, source_status string",
    "vehicle_models": "code string, model_name string, oem string, chemistry string, nominal_capacity_kwh double, nominal_voltage_v double, max_ac_kw double, max_dc_kw double, consumption_wh_per_km double, daily_km_min long, daily_km_max long, fleet_share double",
    "wmi": "wmi string, oem string, note string",
}


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A reference file with a header; the schema is given, so nothing is inferred and malformed numbers are null."""
    return spark.read.csv(path, header=True, schema=CSV_SCHEMAS[kind])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def with_severity(codes: DataFrame, catalogue: DataFrame, code: str = "code", default: str = "warning") -> DataFrame:
    """`codes` with what the catalogue says of them (at most a few thousand rows); unknown codes get the default severity."""
    from amperelake.common import maybe_broadcast

    side = maybe_broadcast(catalogue.select(F.upper(F.trim("code")).alias("_code"), F.lower("severity").alias("severity"), "description").dropDuplicates(["_code"]))
    out = codes.drop("severity", "description").join(side, F.upper(F.trim(F.col(code))) == F.col("_code"), "left").drop("_code")
    return out.withColumn("severity", F.coalesce("severity", F.lit(default)))


def store_messages(messages: DataFrame, path: str) -> None:
    """Add messages to a table partitioned by `day`, keyed by (vin, day, ts_event_ms, seq): the days that come in are
    rewritten with old and new rows, the new ones winning, so a batch stored again changes nothing.

    Only the partitions of those days are read and replaced (dynamic overwrite); the days of a batch are few and are
    listed on the driver.
    """
    spark = messages.sparkSession
    new = messages.where("vin is not null and ts_event_ms is not null").withColumns({"day": F.floor(F.col("ts_event_ms") / DAY_MS).cast("int"), "_new": F.lit(1)})
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        days = [r.day for r in new.select("day").distinct().collect()]
        old = spark.read.parquet(path).where(F.col("day").isin(days)).withColumn("_new", F.lit(0))
        new = new.unionByName(old, allowMissingColumns=True)
    cols = [c for c in new.columns if c != "_new"]
    keep = new.groupBy("vin", "day", "ts_event_ms", "seq").agg(F.max_by(F.struct(*cols), F.struct("_new", "seq")).alias("_r")).select("_r.*")
    from amperelake.common import cut

    cut(keep).repartition("day", "vin").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_on(spark: SparkSession, path: str, vin: str, day: int) -> DataFrame:
    """One vehicle's rows of a day; only that day's partition is read."""
    return spark.read.parquet(path).where((F.col("day") == day) & (F.col("vin") == vin))


def delta_json(state: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """`vin` and `delta`: JSON of the columns that are present (absent ones are omitted)."""
    return state.select("vin", F.to_json(F.struct("vin", *cols)).alias("delta"))


def _name(table: dict[str, int], c: str) -> Column:
    return F.create_map(*(F.lit(x) for k, v in table.items() for x in (v, k)))[F.col(c)]


def encode_a(messages: DataFrame) -> Column:
    """Payload of the nested metric format; absent groups are omitted."""
    pos = F.when(F.col("lat").isNotNull(), F.struct("lat", "lon", "speed_kmh"))
    pack = F.struct(F.col("pack_voltage_v").alias("voltage_v"), F.col("pack_current_a").alias("current_a"), F.col("pack_temp_min_c").alias("temp_min_c"), F.col("pack_temp_max_c").alias("temp_max_c"), F.col("cell_v_min_mv").alias("cell_min_mv"), F.col("cell_v_max_mv").alias("cell_max_mv"), "isolation_kohm", "hv_interlock_ok")
    ts = F.date_format(F.to_utc_timestamp(F.timestamp_millis("ts_event_ms"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.to_json(F.struct("vin", F.col("schema_version").alias("schema"), ts.alias("ts"), "seq", _name(EVENTS, "evt").alias("evt"), pos.alias("pos"), "odo_km", "soc_pct", pack.alias("pack"), "aux_12v_v", "ambient_c", F.struct(_name(CHARGES, "charge_state").alias("state"), F.col("charge_power_kw").alias("power_kw")).alias("charge"), "dtc"))


def encode_b(messages: DataFrame) -> Column:
    """Payload of the nested imperial format (whole seconds)."""
    f = lambda c: F.col(c).cast("double") * 9 / 5 + 32
    place = F.when(F.col("lat").isNotNull(), F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), (F.col("speed_kmh") / KM_PER_MILE).alias("speedMph")))
    pack = F.struct((F.col("soc_pct").cast("double") / 100).alias("soc"), F.col("pack_voltage_v").alias("voltage"), F.col("pack_current_a").alias("current"), f("pack_temp_min_c").alias("tempMinF"), f("pack_temp_max_c").alias("tempMaxF"), F.col("cell_v_min_mv").alias("cellMinMv"), F.col("cell_v_max_mv").alias("cellMaxMv"), F.col("isolation_kohm").alias("isolationKohm"))
    one = F.struct(F.col("vin").alias("vehicleId"), F.col("schema_version").alias("version"), F.floor(F.col("ts_event_ms") / 1000).alias("epoch"), F.col("seq").alias("sequence"), _name(EVENTS, "evt").alias("eventType"), place.alias("location"), (F.col("odo_km") / KM_PER_MILE).alias("odometerMiles"), pack.alias("battery"), F.col("hv_interlock_ok").alias("hvInterlock"), F.col("aux_12v_v").alias("auxVolts"), f("ambient_c").alias("ambientF"), F.struct(_name(CHARGES, "charge_state").alias("status"), F.col("charge_power_kw").alias("powerKw")).alias("charging"), F.col("dtc").alias("dtcs"))
    return F.to_json(F.array(one))


def encode_c(messages: DataFrame) -> Column:
    """Payload of the 23-field text format, fault codes as hex words."""
    words = F.array_join(F.transform("dtc", lambda c: F.lpad(F.conv(dtc_word(c).cast("string"), 10, 16), 4, "0")), "")
    special = {"hv_interlock_ok": F.col("hv_interlock_ok").cast("int"), "dtc": words}
    fields = [F.coalesce(special.get(c, F.col(c)).cast("string"), F.lit("")) for c in PLACES_C]
    return F.concat_ws(";", *fields)


ENCODERS = {"oem_a": encode_a, "oem_b": encode_b, "oem_c": encode_c}


def encode(messages: DataFrame) -> DataFrame:
    """Raw records (oem, topic_vin, received_ms, body) of canonical messages, each in the format of its OEM."""
    body = F.coalesce(*(F.when(F.col("oem") == o, f(messages)) for o, f in ENCODERS.items()))
    return messages.select("oem", F.col("vin").alias("topic_vin"), F.col("seq").alias("sent_seq"), F.col("ts_ingest_ms").alias("received_ms"), body.alias("body"))

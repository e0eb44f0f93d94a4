"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side table (dictionary, registry, profile) may be broadcast.
BROADCAST_BYTES = 32_000_000

IST_OFFSET_MS = 19_800_000
MINUTE_MS = 60_000
DAY_MS = 86_400_000


def session(app: str = "amperelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE); `conf` uses `_` for `.`."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("_", "."): v for k, v in conf.items()},
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. Where it is unset a temporary folder serves on a local
    master, as in tests; on a cluster that is an error, as a machine's own folder is lost with the machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), f"amperelake-{os.getpid()}")
        if base not in _OWN:
            _OWN.add(base)
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the gateway may be gone; the folder is left to who owns it
        pass


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which is removed when this program ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder; a folder of our own is set only where none is."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def maybe_broadcast(small: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`small` with a broadcast hint if its rows, counted, have at most `max_bytes` by the types of their columns (strings
    and other open-ended types by their mean length), else as it is for a shuffled join.

    Give a frame that is cheap to count, such as one returned by `cut`.
    """
    open_ended = [F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c, t in small.dtypes if t in ("string", "binary") or t[:5] in ("array", "map<", "struc")]
    fixed = 16 + 8 * len(small.columns)
    size = small.agg(F.count(F.lit(1)) * fixed + F.coalesce(F.sum(sum((2 * c for c in open_ended), F.lit(0))), F.lit(0))).first()[0]
    return F.broadcast(small) if size <= max_bytes else small


def messages(telemetry: DataFrame, *cols: str) -> DataFrame:
    """One row per message (`vin`, `seq`): the row with the smallest `log_offset`, with `cols` besides.

    A row without `seq` cannot repeat another and stays a message of its own. An aggregation with map-side
    combine on (vin, seq): a hot vehicle spreads over its sequence numbers, a hot message shrinks before the shuffle.
    """
    own = F.when(F.col("seq").isNull(), F.col("log_offset"))
    return (
        telemetry.select("vin", "seq", own.alias("_own"), F.struct("log_offset", *cols).alias("_r"))
        .groupBy("vin", "seq", "_own")
        .agg(F.min_by("_r", F.coalesce(F.col("_r.log_offset"), F.lit(2**63 - 1))).alias("_r"))
        .select("vin", "seq", "_r.*")
    )

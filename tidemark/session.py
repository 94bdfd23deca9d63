"""Session helpers: defaults for local runs, durable intermediates, bounded broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes as written, that may be broadcast.
BROADCAST_BYTES = 8 << 20


def local_session(cores: int | str = "*", app: str = "tidemark", conf: dict[str, str] | None = None) -> SparkSession:
    """A local session with the settings the engine assumes (UTC, AQE)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | (conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (tests, one machine) a temporary folder is made,
    used for the life of the process and removed at its end.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}/{name}"


def _files(spark: SparkSession, at: str):
    """(file system, path) of a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def make_folder(spark: SparkSession, at: str) -> None:
    """An empty folder: a mark that is there or not, never half written."""
    fs, p = _files(spark, at)
    fs.mkdirs(p)


def folder_names(spark: SparkSession, at: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _files(spark, at)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def durable(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    at = new_path(spark, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._tidemark_path = at
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``durable`` wrote for tables that nothing reads any more."""
    for df in tables:
        at = getattr(df, "_tidemark_path", None)
        if at is not None:
            fs, p = _files(df.sparkSession, at)
            fs.delete(p, True)


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if, written, it takes at most ``most`` bytes; else unmarked, so that Spark shuffles it. Written once if ``durable`` didn't yet."""
    kept = df if hasattr(df, "_tidemark_path") else durable(df, "bounded")
    fs, p = _files(kept.sparkSession, kept._tidemark_path)
    return F.broadcast(kept) if fs.getContentSummary(p).getLength() <= most else kept


_SHARED: dict[tuple, object] = {}


def shared(build):
    """``build(spark, folder)`` once per session and folder: what many queries draw on is made, and written, a single time."""

    def get(spark: SparkSession, folder: str):
        key = (build.__module__, build.__name__, spark.sparkContext.applicationId, folder)
        if key not in _SHARED:
            _SHARED[key] = build(spark, folder)
        return _SHARED[key]

    get.__doc__, get.__name__ = build.__doc__, build.__name__
    return get


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))

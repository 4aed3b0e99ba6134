"""The session and the folder that its driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def local_session(cores: int | str = "*", memory: str = "20g", partitions: int = 8) -> SparkSession:
    """A session for one machine. On a cluster, take the one that is there."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and the master is local, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        atexit.register(_remove, _own[app], os.getpid())
    return _own[app]


def _remove(uri: str, pid: int) -> None:
    if os.getpid() == pid:
        shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{scratch_root(spark)}/tessera-{uuid.uuid4().hex}-{name}")
    return _made[-1]


def sweep(spark: SparkSession) -> int:
    """Delete what this process has put in the shared folder; results that still read it must be written by then. Gives the number of paths."""
    n = len(_made)
    while _made:
        _delete(spark, _made.pop())
    return n


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors, gives the planner its size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by materialize() that no later step reads."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

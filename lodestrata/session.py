"""Session helpers: table access and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: list[str] = []
_STAGED: list[str] = []


def release_staged(spark: SparkSession) -> None:
    """Deletes the tables this process has staged; results read from them must be written by then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _remove_local() -> None:
    for path in _STAGED:
        if path.startswith(("/", "file:")):
            shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file:") else path, ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; a file or a folder of parquet parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, read from ``spark.checkpoint.dir``.

    Where that setting is missing, a session on one machine (as in tests) gets a
    temporary folder, removed when the process ends; a cluster is refused, as its
    executors wouldn't share one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_dir()


def _local_dir() -> str:
    if not _LOCAL_DIRS:
        _LOCAL_DIRS.append(tempfile.mkdtemp(prefix="lodestrata-"))
        atexit.register(shutil.rmtree, _LOCAL_DIRS[0], ignore_errors=True)
    return "file://" + _LOCAL_DIRS[0]


def staging(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which ``release_staged`` removes."""
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    Cuts the lineage: later readers depend on files all executors reach, not
    on shuffle output of an executor that may be lost.
    """
    path = staging(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A one-machine session with the settings tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestrata")
        .config("spark.sql.shuffle.partitions", str(os.environ.get("SHUFFLE_PARTITIONS", 8)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
    )
    if "spark__checkpoint__dir" not in conf:
        builder = builder.config("spark.checkpoint.dir", _local_dir())
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

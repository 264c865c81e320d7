"""Session, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_SF = "/root/testdata/sf0.001"


def get_spark(app: str = "lexispark", cpus: str | None = None, shuffle: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus or '*'}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir of the session.

    Only a local session may do without the setting; it then gets a folder of its own.
    """
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="lexispark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)  # our own folder of a local session
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it back.

    The copy survives the loss of executors, and its file sizes give Catalyst true statistics.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{os.getpid()}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize wrote for df, once nothing reads it any more; other tables are left alone."""
    path = getattr(df, "_written", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Spark's setting to delete the shuffle files of a step once it has ended, else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def releasing(f):
    """For functions of a DataFrame that run steps of their own: each step's shuffle files go when it ends, as its result is written."""

    @functools.wraps(f)
    def run(df: DataFrame, *args, **kw):
        conf = df.sparkSession.conf
        said = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            return f(df, *args, **kw)
        finally:
            conf.set(CLEANUP, said) if said is not None else conf.unset(CLEANUP)

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

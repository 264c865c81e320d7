"""Content-addressed snapshots: digests, guarded publishing, activation and verified loading."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(keys: DataFrame, name: str) -> DataFrame:
    """(tbl, rows, digest) of a one-column table: order-free, by xor over 60 bits of each row's SHA-256."""
    c = keys.columns[0]
    return keys.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("bigint")).alias("digest")).select(F.lit(name).alias("tbl"), "rows", "digest")


def table_digest(df: DataFrame) -> tuple[int, int]:
    r = digest(df.select(F.to_json(F.struct(*sorted(df.columns))).alias("k")), "t").first()
    return r["rows"], r["digest"] or 0


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Write tables to root/dataset=<id>; the id is the hash of the manifest of all digests. Refuses empty tables.

    The folder is written under a temporary name and renamed, so a reader never sees half of it; publishing the same
    content twice is harmless. Returns the id; activate() makes it the one that load() reads.
    """
    spark = next(iter(tables.values())).sparkSession
    manifest = {}
    for n, df in sorted(tables.items()):
        rows, d = table_digest(df)
        if not rows:
            raise ValueError(f"{n} is empty; the published data stays as it is")
        manifest[n] = {"rows": rows, "digest": d}
    body = json.dumps(manifest, sort_keys=True)
    ident = spark.range(1).select(F.sha2(F.lit(body), 256)).first()[0][:24]
    fs, final = _fs(spark, f"{root}/dataset={ident}")
    if not fs.exists(final):
        staged = f"{root}/_staging-{ident}"
        for n, df in tables.items():
            df.write.mode("overwrite").parquet(f"{staged}/{n}")
        spark.createDataFrame([(body,)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{staged}/manifest")
        fs.rename(_fs(spark, staged)[1], final)
    return ident


def published(spark: SparkSession, root: str) -> list[str]:
    """The ids of all published datasets, in order; the active one can be any of them."""
    fs, p = _fs(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n.split("=", 1)[1] for n in names if n.startswith("dataset="))


def activate(spark: SparkSession, root: str, ident: str) -> None:
    """Point the root at a published dataset, by rename of a small file; also the way back to an older one."""
    fs, final = _fs(spark, f"{root}/dataset={ident}")
    if not fs.exists(final):
        raise FileNotFoundError(ident)
    # a pointer of its own for each activation: readers take the newest, so there is no moment without one
    turn = max(_turns(spark, root), default=0) + 1
    spark.createDataFrame([(ident,)], "ident string").coalesce(1).write.mode("overwrite").text(f"{root}/_active.new")
    if not fs.rename(_fs(spark, f"{root}/_active.new")[1], _fs(spark, f"{root}/_active-{turn:09}")[1]):
        raise RuntimeError("the pointer could not be moved into its place")


def _turns(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.split("-", 1)[1]) for n in names if n.startswith("_active-"))


def load(spark: SparkSession, root: str, ident: str | None = None) -> dict[str, DataFrame]:
    """The tables of a dataset (default: the active one), after their digests were checked against the manifest."""
    if ident is None:
        turns = _turns(spark, root)
        if not turns:
            raise FileNotFoundError("no dataset is active")
        ident = spark.read.text(f"{root}/_active-{turns[-1]:09}").first()[0]
    base = f"{root}/dataset={ident}"
    manifest = json.loads(spark.read.text(f"{base}/manifest").first()[0])
    out = {}
    for n, want in manifest.items():
        df = spark.read.parquet(f"{base}/{n}")
        if table_digest(df) != (want["rows"], want["digest"]):
            raise ValueError(f"{n} does not match its manifest")
        out[n] = df
    return out

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir, with its scheme; a folder of its own only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexigrid-")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/lexigrid/{label}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _write(df: DataFrame, path: str) -> None:
    """Write df; its shuffle files go when it is written, as nothing reads them again."""
    name, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession.conf
    old = conf.get(name, None)
    conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(name, old) if old is not None else conf.unset(name)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, is computed once and survives lost executors."""
    path = scratch(df.sparkSession, label)
    _write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lexigrid_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that stored() or positions() made and nothing reads any more."""
    at = getattr(df, "_lexigrid_path", None)
    if at:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def positions(df: DataFrame, order: list[str], label: str, *, name: str = "pos") -> tuple[DataFrame, int]:
    """df stored sorted by the columns of order, with each row's place in it from 0, and the number of rows.

    Ranges are sorted each by itself; the driver sums up one number a file, so no task sees all rows."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    _write(df.repartitionByRange(*order).sortWithinPartitions(*order), path)
    at = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = sorted((int(re.match(r"part-(\d+)", r["_file"])[1]), r["_file"], r["n"]) for r in at.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect())
    bases, total = [], 0
    for _, file, n in counts:
        bases.append((file, total))
        total += n
    base = spark.createDataFrame(bases, "_file string, _base long")
    out = at.join(F.broadcast(base), "_file").withColumn(name, F.col("_base") + F.col("_at")).drop("_file", "_base", "_at")
    out._lexigrid_path = path
    return out, total


def ship(spark: SparkSession) -> None:
    """Give the executors this package, wherever the driver imported it from; once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_lexigrid_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="lexigrid-zip-"), "lexigrid.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("lexigrid", os.path.relpath(full, root)))
    sc.addPyFile(target)  # Spark serves it to the executors; none of them reads the driver's folder
    sc._lexigrid_shipped = True

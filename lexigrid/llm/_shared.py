"""What the training-data operators share: the shared folder, written tables, shipped code."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what `[^\x20\x09-\x0D]+` leaves between words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see: spark.checkpoint.dir. Only where that is unset (local tests) one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_lexigrid_shared", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="lexigrid-")
            spark.sparkContext._lexigrid_shared = base
    return qualified(spark, base.rstrip("/"))


def hadoop_path(spark: SparkSession, path: str):
    """The JVM's path object and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme. Without one Spark means the default file system, and workers must not take it for their own disk."""
    p, fs = hadoop_path(spark, path)
    return fs.makeQualified(p).toString()


def file_system(uri: str):
    """A pyarrow file system and the path in it, for a qualified path; `file:` is the local one."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The path that open() takes, None where the file isn't on a mounted file system."""
    return "/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri if "://" not in uri else None


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lexigrid/{label}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """These settings for a while, then those of before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors. Its shuffle files go when it is written, as nothing reads them again."""
    path = new_path(df.sparkSession, label)
    with settings(df.sparkSession, **{"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lexigrid_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that written() made and nothing reads any more."""
    path = getattr(df, "_lexigrid_path", None)
    if path:
        p, fs = hadoop_path(df.sparkSession, path)
        fs.delete(p, True)


def numbered(df: DataFrame, order: list, label: str, *, name: str = "pos") -> DataFrame:
    """df written sorted by `order`, with each row's position in it from 0. Range partitions are sorted by themselves; their files' sizes, one
    row a partition, are summed up on the driver, and a row's position is its file's sum and its place in the file, so no task sees all rows."""
    out = written(df.repartitionByRange(*order).sortWithinPartitions(*order), label)
    at = out.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = sorted((int(re.match(r"part-(\d+)", r["_file"])[1]), r["_file"], r["n"]) for r in at.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect())
    bases, total = [], 0
    for _, file, n in counts:
        bases.append((file, total))
        total += n
    base = df.sparkSession.createDataFrame(bases, "_file string, _base long")
    rows = at.join(F.broadcast(base), "_file").withColumn(name, F.col("_base") + F.col("_at")).drop("_file", "_base", "_at")
    rows._lexigrid_path, rows._lexigrid_rows = out._lexigrid_path, total
    return rows


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, where it is a scan of fewer (one row group is one task); beyond that, unchanged."""
    if df._jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df  # its shuffles would have to run first
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Give the executors this package, wherever the driver imported it from."""
    sc = spark.sparkContext
    if getattr(sc, "_lexigrid_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="lexigrid-zip-"), "lexigrid.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("lexigrid", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._lexigrid_shipped = True


def tidy(batches):
    """The batches of a partition; then what the worker has freed goes back to the machine, as workers live on and share an executor's memory with it."""
    import ctypes
    import gc

    import pyarrow as pa

    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not this C library
            pass


def crc_mod(col: str, n: int):
    """crc32 of an id written as decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the public tokenizers: LEXIGRID_TOKENIZERS names their folder, else the installed package."""
    folder = os.environ.get("LEXIGRID_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)

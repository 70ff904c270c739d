r"""Exact deduplication by stateful streaming, in DataFrame operations only.

A stream over the digests keeps one state entry for each digest, without expiry, in the
disk-backed (RocksDB) state store: the row that stays (largest doc_id; among rows that share it
the largest locator) as stable identifier and content locator (file and row), and the number of
rows. Afterwards every hit is checked in full: its text is held against the text at the locator.
Where a digest stands for different texts, its rows are grouped anew by the whole text.

A third of all rows may be one text: the aggregation combines before the shuffle, and the joins
that follow are plain sort-merge joins, whose large partitions adaptive execution splits.

Defined results
* null text counts as empty, so null and empty texts are copies of each other.
* doc_ids that repeat: rows are told apart by their locator; exactly one row of a group is kept.
  A null doc_id is below all others.
* one output row for each input row; an empty table gives an empty result.
* other columns are ignored by dedup_decisions and returned unchanged by exact_dedup.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import new_path, settings, table, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _located(docs: DataFrame) -> DataFrame:
    """docs, or a written copy if its rows have no place in a file."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return written(docs, "located")


def _stream_state(digests_path: str, spark: SparkSession, schema, files_per_batch: int) -> DataFrame:
    """digest, keep (doc_id, file, row) and group_size out of the state that the stream leaves."""
    at = new_path(spark, "dedup-state")
    store = "spark.sql.streaming.stateStore"
    # without pre-allocation: a partition's store is small, and each would hold some MB of empty files
    names = {f"{store}.providerClass": ROCKSDB, f"{store}.rocksdb.changelogCheckpointing.enabled": "true", f"{store}.rocksdb.allowFAllocate": "false", f"{store}.rocksdb.boundedMemoryUsage": "true", f"{store}.rocksdb.maxMemoryUsageMB": "200"}
    with settings(spark, **names):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(digests_path)
        state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
        held = spark.read.format("statestore").load(at)
        value = held.schema["value"].dataType.fieldNames()
        # the state holds the aggregates in the order in which they were asked for
        return held.select(F.col("key.digest").alias("digest"), F.col(f"value.`{value[0]}`").alias("keep"), F.col(f"value.`{value[1]}`").alias("group_size"))


def dedup_decisions(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", digest=sha256, files_per_batch: int = 10_000) -> DataFrame:
    """doc_id, file, row (where the row is), digest, keep_id, group_size and kept for each row of docs."""
    return _decisions(_located(docs), doc_id, text, digest, files_per_batch)


def _decisions(docs: DataFrame, doc_id: str, text: str, digest, files_per_batch: int) -> DataFrame:
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    digests = written(rows.select("doc_id", digest(F.col("text")).alias("digest"), "file", "row"), "digests")
    if digests.isEmpty():
        return digests.select("doc_id", "file", "row", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    groups = written(_stream_state(digests._lexigrid_path, spark, digests.schema, files_per_batch), "groups")
    found = digests.join(groups, "digest")
    here, there = F.struct("file", "row"), F.struct("keep.file", "keep.row")
    members = found.filter("group_size > 1").select("file", "row", "digest", F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"), (here == there).alias("stays"))
    texts = rows.select("file", "row", "text").join(members, ["file", "row"])
    ours = texts.filter("not stays").select("digest", "keep_file", "keep_row", "text")
    theirs = texts.filter("stays").select("keep_file", "keep_row", F.col("text").alias("keep_text"))
    differ = ours.join(theirs, ["keep_file", "keep_row"]).filter("text <> keep_text").select("digest").distinct()
    differ = written(differ, "collisions")
    if not differ.isEmpty():  # digests of several texts: those rows are grouped by the text itself
        again = rows.join(digests.join(differ, "digest", "left_semi").select("file", "row", "digest"), ["file", "row"])
        each = again.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        regrouped = again.join(each, ["digest", "text"]).select("digest", "doc_id", "file", "row", "keep", "group_size")
        found = found.join(differ, "digest", "left_anti").unionByName(regrouped)
    return found.select("doc_id", "file", "row", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", (here == there).alias("kept"))


def exact_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns."""
    docs = _located(docs)
    gone = _decisions(docs, doc_id, text, sha256, 10_000).filter("not kept").select(F.col("file").alias("_gone_file"), F.col("row").alias("_gone_row"))
    rows = docs.withColumns({"_own_file": F.col("_metadata.file_path"), "_own_row": F.col("_metadata.row_index")})
    rows = rows.join(gone, (F.col("_own_file") == F.col("_gone_file")) & (F.col("_own_row") == F.col("_gone_row")), "left_anti")
    return rows.drop("_own_file", "_own_row")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_decisions(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

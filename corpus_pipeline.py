"""Documents through the training-data operators, stage by stage.

run() gives the encoded documents of the mix. Each stage works on all that the one before it has
kept; all but the last return the columns of documents.

Defined results, in every stage: a null text counts as empty, an empty table gives an empty result, other columns pass
through unchanged whatever their names, and texts are read whole whatever their length. What repeated rows and null
ids give is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import forget, settings, table, written
from lexigrid.llm.byte_bpe import bpe_encode
from lexigrid.llm.exact_dedup import exact_dedup
from lexigrid.llm.minhash_dedup import near_dedup
from lexigrid.llm.quality_classifier import keep_good
from lexigrid.llm.source_mixing import mix_documents

#: Rows of a batch and entries of a worker's memo while encoding.
BATCH, MEMO = 512, 150_000
#: Stages change rows by a model's and a hash family's decisions, which SQL can't express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to all labels, doesn't reject. Each row is decided by its own text, so equal texts stay or go together; without labels of both kinds all go or all stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id; of several rows with that id one."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more in five-word shingles the one with the least doc_id. Documents without words are linked with nothing and stay."""
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, as often as it takes them, twice at most. Documents without words are never taken."""
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids_sha256 (of the ids as little-endian unsigned 32-bit integers), and whether decoding gives the text's bytes back.

    Written here, without texts, so that texts reach the workers BATCH rows at a time: executors whose heaps the stages before have filled hold them in the JVM and in Python."""
    out = bpe_encode(docs, decoded=True, limit=MEMO)
    out = out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    with settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH)}):
        return written(out, "encoded")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)  # nothing reads a stage's table once the next one is written; the input isn't ours and stays
    return STAGES[-1][1](spark, docs, sf_dir)

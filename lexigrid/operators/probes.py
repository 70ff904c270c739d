"""Checks that a corpus really doesn't hold what unanswerable questions ask for."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions import text as T

#: How a label is established, what it expects, and by what it is verified.
BASES = {
    "term_absent_from_corpus": ("abstain", "mechanical_corpus_absence"),
    "standard_absent_from_corpus": ("abstain", "mechanical_corpus_absence"),
    "clause_absent_from_standard": ("abstain", "mechanical_corpus_absence"),
    "cross_standard_comparison": ("escalate", "stipulated_definition"),
}


class ProbeVerificationError(ValueError):
    """A probe's stored evidence disagrees with the corpus."""


def term_occurrences(chunks: DataFrame, terms: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """term, n_chunks: chunks that hold the normalised term between word boundaries, punctuation as it is spelled. An empty term raises.

    The terms are a stated set that goes into the plan; one pass over the chunks, no shuffle of texts."""
    asked = [(r["term"], r["needle"]) for r in terms.select("term", T.normalise(F.col("term")).alias("needle")).distinct().collect()]
    if not all(n for _, n in asked):
        raise ValueError("empty term")
    spark, schema = chunks.sparkSession, "term string, needle string, pattern string"
    listed = spark.createDataFrame([(t, n, r"(?U)(?<!\w)" + re.sub(r"([^\w\s])", r"\\\1", n) + r"(?!\w)") for t, n in asked], schema)
    if not asked:
        return listed.select("term", F.lit(0).cast("long").alias("n_chunks"))
    needles = F.array(*[F.struct(F.lit(r["term"]).alias("term"), F.lit(r["needle"]).alias("needle"), F.lit(r["pattern"]).alias("pattern")) for r in listed.collect()])
    held = T.let(T.normalise(F.col(text)), lambda t: F.transform(F.filter(needles, lambda x: t.contains(x["needle"]) & F.regexp_like(t, x["pattern"])), lambda x: x["term"]))
    found = chunks.select(F.explode(held).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks"))
    return listed.select("term").join(found, "term", "left").select("term", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def corpus_standards(chunks: DataFrame, *, standard: str = "standard_id") -> DataFrame:
    """The distinct standards of the chunks."""
    return chunks.select(F.col(standard).alias("standard")).filter("standard is not null").distinct()


def corpus_clauses(chunks: DataFrame, *, standard: str = "standard_id", clause: str = "clause_id") -> DataFrame:
    """standard, clause: the distinct clauses of the chunks."""
    return chunks.select(F.col(standard).alias("standard"), F.col(clause).alias("clause")).filter("clause is not null").distinct()


def single_standard(chunks: DataFrame, *, standard: str = "standard_id") -> DataFrame:
    """The chunks; one without a standard raises when it is read."""
    blank = F.col(standard).isNull() | (F.trim(standard) == "")
    return chunks.withColumn(standard, F.when(blank, F.raise_error(F.lit("chunk without a single standard"))).otherwise(F.col(standard)))


def verify_probes(probes: DataFrame, chunks: DataFrame, *, id: str = "doc_id", text: str = "text", standard: str = "standard_id", clause: str = "clause_id") -> DataFrame:
    """probe_id, basis, failures (empty: the evidence holds).

    probes: probe_id, basis, term, occurrences and of_chunks (as stored, may be null), standards (array), clause."""
    n_chunks = chunks.count()
    terms = term_occurrences(chunks, probes.filter("basis = 'term_absent_from_corpus' and trim(term) <> ''").select("term").distinct(), id=id, text=text)
    there = chunks.select(F.col(standard).alias("standard")).distinct()
    clauses = chunks.select(F.col(standard).alias("standard"), F.col(clause).alias("clause")).distinct().withColumn("_clause", F.lit(True)) if clause in chunks.columns else None
    named = probes.select("probe_id", F.explode(F.array_distinct("standards")).alias("standard")).join(there.withColumn("_there", F.lit(True)), "standard", "left")
    named = named.groupBy("probe_id").agg(F.count(F.lit(1)).alias("n_named"), F.count("_there").alias("n_there"))
    twice = Window.partitionBy("probe_id")
    rows = probes.withColumn("n_same", F.count(F.lit(1)).over(twice)).join(terms, "term", "left").join(named, "probe_id", "left").withColumn("standard", F.try_element_at("standards", F.lit(1)))
    rows = rows.join(clauses, ["standard", "clause"], "left") if clauses is not None else rows.withColumn("_clause", F.lit(None).cast("boolean"))
    n, zero = F.coalesce("n_chunks", F.lit(0)), F.lit(0)
    on = lambda basis, test, words: F.when((F.col("basis") == basis) & F.coalesce(test, F.lit(False)), F.lit(words))
    term, std, cl, cross = BASES
    n_named, n_there = F.coalesce("n_named", zero), F.coalesce("n_there", zero)
    failures = F.array_compact(F.array(
        F.when(F.col("n_same") > 1, "duplicate probe_id"), F.when(~F.coalesce(F.col("basis").isin(*BASES), F.lit(False)), "unknown basis"),
        on(term, F.coalesce(F.trim("term"), F.lit("")) == "", "no term"), on(term, n != 0, "term occurs in the corpus"), on(term, F.col("occurrences") != n, "stored occurrences differ"), on(term, F.col("of_chunks") != n_chunks, "stored number of chunks differs"),
        on(std, n_named == 0, "no standard named"), on(std, n_there > 0, "standard is indexed"),
        on(cl, n_there == 0, "standard is not indexed"), on(cl, F.col("_clause"), "clause exists"),
        on(cross, n_named < 2, "fewer than two standards"), on(cross, n_there < n_named, "standard is not indexed"),
    ))
    return rows.select("probe_id", "basis", failures.alias("failures"))


def assert_verified(verified: DataFrame) -> None:
    """Raises with all failures; probes are a small authored set."""
    bad = verified.filter(F.size("failures") > 0).collect()
    if bad:
        raise ProbeVerificationError("; ".join(f"{r['probe_id']}: {', '.join(r['failures'])}" for r in bad))


def as_items(probes: DataFrame) -> DataFrame:
    """Probes in the shape of evaluation items: no gold clauses, expected_behavior and verification_basis by their basis."""
    pick = lambda i: F.coalesce(*[F.when(F.col("basis") == b, v[i]) for b, v in BASES.items()])
    scope = F.when(F.col("basis") == "cross_standard_comparison", "requires_multiple_standards").otherwise("unanswerable_from_corpus")
    return probes.select(F.col("probe_id").alias("item_id"), "question_text", F.coalesce("standards", F.array().cast("array<string>")).alias("standard_ids"), F.lit(None).cast("string").alias("gold_answer"), F.lit("generated").alias("status"), pick(1).alias("verification_basis"), scope.alias("answerability"), pick(0).alias("expected_behavior"), F.lit("unanswerable_probe").alias("klass"))


def build_probes(candidates: DataFrame, chunks: DataFrame, **columns) -> DataFrame:
    """Candidates (probe_id, basis, question_text, term, standards, clause) with their evidence drawn from the corpus; those that it refutes drop."""
    empty = candidates.withColumns({"occurrences": F.lit(None).cast("long"), "of_chunks": F.lit(None).cast("long")})
    held = verify_probes(empty, chunks, **columns).filter(F.size("failures") == 0).select("probe_id")
    is_term = F.col("basis") == "term_absent_from_corpus"
    return candidates.join(held, "probe_id", "left_semi").withColumns({"occurrences": F.when(is_term, F.lit(0).cast("long")), "of_chunks": F.when(is_term, F.lit(chunks.count()))})

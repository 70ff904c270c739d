"""Contexts and prompts as expressions, and the guard against gold answers in prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import text as T

class GoldAnswerLeak(ValueError):
    """A prompt holds its gold answer."""


SYSTEM = "Answer only from the numbered excerpts and cite them as [n]. If they do not answer the question, reply exactly: " + T.ABSTENTION


#: The five prompt variants; {body} is the name of the body whose clauses are quoted, {line} the abstention line.
_HEAD = "Retrieved clause excerpts (this is the only source you may use):\n\n{context}\n\nQuestion:\n{question}\n\n"
_ONLY = "You are answering a question using only the retrieved {body} clause excerpts provided in the user message. Do not use any other knowledge."
VARIANTS = (
    ("v1", "answer_context_only_v1", _ONLY + " If the provided excerpts are insufficient to answer, reply exactly: {line}", _HEAD + "Answer only from the excerpts above. If they are insufficient, reply exactly: {line}"),
    ("v2", "single_abstention_v2", _ONLY + " If the provided excerpts are insufficient to answer, reply exactly: {line}", _HEAD + "Answer the question using only the excerpts above."),
    ("v3", "synthesis_guidance_v3", "You are an {body} compliance assistant. Answer questions using only the retrieved clause excerpts provided in the user message. You may synthesise information across multiple excerpts to form a complete answer. Cite excerpts by their [n] reference numbers. If the excerpts contain no relevant information at all, reply exactly: {line}", _HEAD + "Use the excerpts above to answer. Even if only part of the answer is covered, provide what the excerpts support and cite the relevant excerpt numbers [n]. If the excerpts contain nothing relevant, reply exactly: {line}"),
    ("v4", "specific_trigger_v4", _ONLY, _HEAD + "Answer only from the excerpts above. Cite relevant excerpts by their [n] reference numbers.\n\nAbstain ONLY if NONE of the excerpts mention the topic of the question at all. In that case, reply exactly: {line}"),
    ("v5", "strong_guidance_v5", "You are an expert {body} compliance assistant. Your task is to answer questions using ONLY the retrieved clause excerpts provided in the user message. Do not use any outside knowledge.\n\nRULES:\n1. You MUST answer entirely in English. Do not use Arabic script.\n2. You may synthesise information across multiple excerpts to form a complete answer.\n3. Cite excerpts by their [n] reference numbers.\n4. Abstain ONLY if the excerpts contain absolutely no relevant information about the topic of the question. If so, reply exactly: {line}", _HEAD + "Answer the question in English using only the excerpts above. Cite relevant excerpts by their [n] reference numbers.\n\nIf the excerpts are completely irrelevant to the question, reply exactly: {line}"),
)


def variants(spark: SparkSession, body: str, *names: str) -> DataFrame:
    """variant, version, system, template of the named variants, or of all; an unknown name raises."""
    if unknown := set(names) - {v[0] for v in VARIANTS}:
        raise KeyError(f"unknown prompt variants: {', '.join(sorted(unknown))}")
    fill = lambda t: t.replace("{body}", body).replace("{line}", T.ABSTENTION)
    rows = [(n, v, fill(s), fill(t)) for n, v, s, t in VARIANTS if not names or n in names]
    return spark.createDataFrame(rows, "variant string, version string, system string, template string")


def context_text(ranked: DataFrame, *, id: str = "item_id", label: str = "label", text: str = "text") -> DataFrame:
    """id, context, n_records: `[rank] label`, a line break and the text of each record in the order of rank, between blank lines."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col(label), F.lit("\n"), F.col(text))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"])
    return ranked.groupBy(id).agg(F.array_join(ordered, "\n\n").alias("context"), F.count(F.lit(1)).alias("n_records"))


def render(items: DataFrame, variants: DataFrame, *, question: str = "question") -> DataFrame:
    """Each item under each variant (variant, system, template with {context} and {question})."""
    halves = F.split("template", r"\{context\}", 2)
    ask = lambda half: F.replace(half, F.lit("{question}"), F.coalesce(F.col(question), F.lit("")))
    body = F.concat(ask(halves[0]), F.when(F.size(halves) > 1, F.concat(F.col("context"), ask(F.try_element_at(halves, F.lit(2))))).otherwise(""))
    return items.crossJoin(F.broadcast(variants)).withColumn("user_prompt", body).withColumn("messages", F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content"))))


def leak_guard(prompts: DataFrame, *, prompt: str = "user_prompt", gold: str = "gold_answer") -> DataFrame:
    """The prompts; one that holds its non-blank gold answer raises when a row is read, whichever columns are read."""
    leaks = (F.trim(F.coalesce(gold, F.lit(""))) != "") & F.col(prompt).contains(F.col(gold))
    return prompts.filter(F.when(leaks, F.raise_error(F.lit("gold answer in prompt")).cast("boolean")).otherwise(F.lit(True)))


def assert_no_leak(prompts: DataFrame, *, prompt: str = "user_prompt", gold: str = "gold_answer", id: str = "item_id") -> None:
    """Raises GoldAnswerLeak with a few of the items whose prompt holds their non-blank gold answer."""
    leaks = (F.trim(F.coalesce(gold, F.lit(""))) != "") & F.col(prompt).contains(F.col(gold))
    bad = prompts.filter(leaks).select(id).limit(5).collect()
    if bad:
        raise GoldAnswerLeak(f"gold answer in the prompts of {[r[id] for r in bad]}")

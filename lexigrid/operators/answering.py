"""Signals of retrieval and response, and the run from ranked records to decisions: gate, prompt, generate, audit, route."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import overlap
from lexigrid.functions import text as T
from lexigrid.operators import audit, evaluation, prompts
from lexigrid.operators.routing import Gate, evaluate_gates
from lexigrid.sources.scratch import stored

#: Columns of a response's signals, as types, for items that never reach generation.
RESPONSE_SIGNALS = "generated boolean, response string, response_class string, n_words int, audit_passed boolean, cited_ranks array<int>, grounding_passed boolean, foreign array<string>, runs array<string>, echo_ratio double"
STAGES = ("retrieve", "gate_retrieval", "build_prompt", "generate", "signals", "route")


def retrieval_signals(items: DataFrame, ranked: DataFrame, rerank: DataFrame | None = None, coverage: DataFrame | None = None, *, id: str = "item_id") -> DataFrame:
    """One row an item, those without records too: n_records, standards (distinct, by rank), heading_ranks, heading_top_1, all_headings, idf_coverage, top_1, top_2, margin.

    ranked: id, rank, standard, text. rerank: id, top_1, top_2, margin. coverage: id, idf_coverage. What isn't given is null: not measured."""
    heading = T.heading_like(F.col("text"))
    by = ranked.groupBy(id).agg(
        F.count(F.lit(1)).alias("n_records"), F.array_sort(F.collect_list(F.when(F.col("standard") != "", F.struct("rank", "standard")))).alias("_s"),
        F.array_sort(F.collect_list(F.when(heading, F.col("rank")))).alias("heading_ranks"),
    )
    out = items.select(id).distinct().join(by, id, "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    out = out.withColumns({"standards": F.coalesce(F.array_distinct(F.transform("_s", lambda x: x["standard"])), F.array().cast("array<string>")), "heading_ranks": F.coalesce("heading_ranks", F.array().cast("array<int>"))}).drop("_s")
    out = out.withColumns({"heading_top_1": F.array_contains("heading_ranks", 1), "all_headings": (F.col("n_records") > 0) & (F.size("heading_ranks") == F.col("n_records"))})
    for more, names in ((coverage, ("idf_coverage",)), (rerank, ("top_1", "top_2", "margin"))):
        out = out.join(more.select(id, *names), id, "left") if more is not None else out.withColumns({c: F.lit(None).cast("double") for c in names})
    return out


def response_signals(responses: DataFrame, ranked: DataFrame, index: DataFrame | None = None, *, id: str = "item_id") -> DataFrame:
    """One row a response with the columns of RESPONSE_SIGNALS. ranked: id, rank, standard, clause, label, text."""
    c = F.col("response")
    labelled = ranked.select(id, "rank", F.concat(F.col("label"), F.lit("\n"), F.col("text")).alias("text"))
    cited = audit.audit_summary(responses, audit.audit_citations(responses, labelled, id=id), id=id).select(id, F.col("passed").alias("audit_passed"), "cited_ranks")
    grounded = audit.ground(audit.clause_references(responses, id=id), ranked.select(id, "standard", "clause", "text"), index, id=id)
    grounded = audit.grounding_summary(responses, grounded, id=id).select(id, F.col("passed").alias("grounding_passed"))
    own = responses.join(prompts.context_text(ranked, id=id).select(id, "context"), id, "left")
    # the whole response against the whole context: what overlap_ratio gives, and the number of words with it
    whole = overlap.compared()(F.array(F.lit(0)), F.array(F.lit(0)), F.array(F.lit(1)), F.array(F.coalesce(c, F.lit(""))), F.array(F.lit(None).cast("string")), F.array(F.struct(F.lit(1).alias("rank"), F.col("context").alias("text"))))
    own = own.withColumn("_whole", F.element_at(whole, 1))
    own = own.select(id, c.isNotNull().alias("generated"), "response", T.classify_response(c).alias("response_class"), F.col("_whole.n_words").alias("n_words"), T.unexpected_script(c).alias("foreign"), T.repeated_runs(c).alias("runs"), F.col("_whole.best_overlap").alias("echo_ratio"))
    return own.join(cited, id, "left").join(grounded, id, "left")


def run(items: DataFrame, ranked: DataFrame, generate: Callable[[DataFrame], DataFrame], gates: list[Gate], variant: DataFrame, *, index: DataFrame | None = None, rerank: DataFrame | None = None, coverage: DataFrame | None = None, id: str = "item_id") -> DataFrame:
    """One row an item: signals, decision, triggering_gate, short_circuited, served_answer, cited_chunk_ids, entered (stages gone through).

    items: id, question, gold_answer. ranked: id, rank, chunk_id, standard, clause, label, text. generate takes prompts (id,
    system_prompt, user_prompt) and gives id, response: a model, or stored answers. Items that a retrieval gate stops are never
    prompted; a gold answer in a prompt raises; the answer is served only if no gate is triggered."""
    seen = retrieval_signals(items, ranked, rerank, coverage, id=id)
    first = evaluate_gates(seen.withColumns(_nothing()), gates, stage="retrieval").select(*seen.columns, "decision", "triggering_gate")
    going = first.filter("decision = 'answer'").drop("decision", "triggering_gate")
    asked = items.join(going.select(id), id, "left_semi")
    prompted = prompts.render(asked.join(prompts.context_text(ranked, id=id), id, "left").withColumn("context", F.coalesce("context", F.lit(""))), variant)
    answers = generate(prompts.leak_guard(prompted).select(id, "variant", F.col("system").alias("system_prompt"), "user_prompt"))
    answers = stored(asked.select(id).join(answers.select(id, "response"), id, "left"), "answers")  # a model is asked once, whatever reads its answers
    signals = going.join(response_signals(answers, ranked, index, id=id), id)
    routed = evaluate_gates(signals, gates).drop("results", "mask").withColumn("short_circuited", F.lit(False))
    stopped = first.filter("decision <> 'answer'").withColumns(_nothing()).withColumn("short_circuited", F.lit(True))
    out = routed.unionByName(stopped)
    chunks = ranked.groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct(F.col("rank").cast("int"), "chunk_id"))).alias("_chunks"))
    out = out.join(chunks, id, "left")
    ids = F.filter(F.transform(F.coalesce("cited_ranks", F.array().cast("array<int>")), lambda r: F.try_element_at("_chunks", r)), lambda x: x.isNotNull())
    stages = F.when(F.col("short_circuited"), F.lit(",".join(STAGES[:2]))).otherwise(F.lit(",".join(STAGES)))
    return out.withColumns({"served_answer": F.when(F.col("decision") == "answer", F.col("response")), "cited_chunk_ids": ids, "entered": F.split(stages, ",")}).drop("_chunks")


def _nothing() -> dict:
    return {n: F.lit(None).cast(t) for n, t in (x.strip().split(" ", 1) for x in RESPONSE_SIGNALS.split(", "))}


def replay(answers: DataFrame, *, id: str = "item_id", response: str = "response") -> Callable[[DataFrame], DataFrame]:
    """A generator that gives stored answers."""
    return lambda asked: asked.join(answers.select(id, F.col(response).alias("response")), id, "left").select(id, "response")


def stored_context(top: DataFrame, chunks: DataFrame, *, id: str = "item_id", chunk: str = "chunk_id") -> DataFrame:
    """Stored ranks with their chunks; a chunk that isn't there raises when it is read."""
    out = top.join(chunks.withColumn("_there", F.lit(True)), chunk, "left")
    missing = F.raise_error(F.concat(F.lit("missing chunk "), F.coalesce(F.col(chunk).cast("string"), F.lit("null")))).cast("boolean")
    return out.filter(F.when(F.col("_there").isNull(), missing).otherwise(F.lit(True))).drop("_there")


def blind_spot(items: DataFrame, signals: DataFrame, gates: list[Gate], *, id: str = "item_id") -> DataFrame:
    """What the retrieval gates alone decide: id, klass, expected, decision, triggering_gate."""
    routed = evaluate_gates(signals.withColumns(_nothing()), gates, stage="retrieval")
    return items.select(id, "klass", "expected").join(routed.select(id, "decision", "triggering_gate"), id)


def blind_spot_summary(audited: DataFrame) -> DataFrame:
    """A row for each class of items: n and the counts of decisions."""
    d = F.col("decision")
    return audited.groupBy("klass").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(d == x).alias(f"n_{x}") for x in ("answer", "abstain", "escalate")])


def calibrate(coverages: DataFrame, thresholds: list[float], *, score: str = "idf_coverage", label: str = "label", spec: str = "spec") -> tuple[DataFrame, DataFrame]:
    """For coverages under several specs (a column): firing rates at the thresholds, and the AUC of each spec."""
    points = coverages.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    rates = coverages.crossJoin(F.broadcast(points)).groupBy(spec, "threshold", label).agg(F.count_if(F.col(score) < F.col("threshold")).alias("fired"), F.count(score).alias("evaluable"))
    rates = rates.withColumn("rate", F.try_divide(F.col("fired").cast("double"), F.col("evaluable")))
    return rates, evaluation.auc(coverages, score, label, by=spec)


def prompt_summary(responses: DataFrame, *, variant: str = "variant", text: str = "response") -> DataFrame:
    """A row a prompt variant: n, counts of response classes, answer_rate."""
    c = T.classify_response(F.col(text))
    return responses.groupBy(variant).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c == x).alias(f"n_{x}") for x in ("answered", "mixed", "abstained", "empty")], F.avg(c.isin("answered", "mixed").cast("double")).alias("answer_rate"))


def abstention_triggers(responses: DataFrame, *, variant: str = "variant", text: str = "response") -> DataFrame:
    """The responses with contains_abstention, response_length, has_citations and a guess at how a variant behaves."""
    c = F.coalesce(F.col(text), F.lit(""))
    #: What each variant is expected to do with an answered item.
    guess = {"v1": "likely_abstain", "v2": "possible_answer", "v3": "likely_answer", "v4": "possible_answer"}
    there = F.lower(c).contains(T.ABSTENTION.lower())
    behaviour = F.when(there, "abstain").otherwise(F.coalesce(*[F.when(F.col(variant) == v, g) for v, g in guess.items()]))
    return responses.withColumns({"contains_abstention": there, "response_length": F.length(c), "has_citations": F.trim(c).startswith("["), "estimated_behavior": behaviour})


def token_fit(docs: DataFrame, limit: int = 8192, *, by: str, text: str = "text", tokens=T.bm25_tokens) -> DataFrame:
    """by, n_tokens, fits: whether all texts together stay within a context of `limit` tokens."""
    return docs.groupBy(by).agg(F.sum(F.size(tokens(F.col(text)))).alias("n_tokens")).withColumn("fits", F.col("n_tokens") <= limit)


def tokeniser_diff(rows: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, only_split, only_whole: terms that only one of the two token rules for slash numerals gives; equal rows drop."""
    less = lambda a, b: F.array_sort(F.array_except(a, b))
    both = T.let(F.struct(T.anchor_tokens(F.col(text)).alias("a"), T.slash_first_tokens(F.col(text)).alias("b")), lambda t: F.struct(less(t["a"], t["b"]).alias("only_split"), less(t["b"], t["a"]).alias("only_whole")))
    out = rows.select(id, F.explode(F.filter(F.array(both), lambda d: (F.size(d["only_split"]) > 0) | (F.size(d["only_whole"]) > 0))).alias("d"))
    return out.select(id, "d.only_split", "d.only_whole")


def stage_seconds(stages: DataFrame, *, id: str = "item_id") -> DataFrame:
    """id, seconds: a map from stage to seconds, six places."""
    return stages.groupBy(id).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", F.round("seconds", 6).alias("seconds"))))).alias("seconds"))

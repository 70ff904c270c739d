"""Runs from records to decisions, probes, stores, labels and calibration."""

import unicodedata

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators import answering, audit, evaluation, extraction, probes, prompts, retrieval
from lexigrid.plans import registry
from lexigrid.sources import io

PROBE = "probe_id string, basis string, term string, occurrences long, of_chunks long, standards array<string>, clause string"


def test_full_normalisation_in_batches(spark):
    rows = spark.createDataFrame([(0, "ﬁne  “Straße”…"), (1, None), (2, "é")], "i int, t string")
    got = [r[0] for r in rows.select(T.normalise_udf()(F.col("t"))).collect()]
    assert got == ['fine "strasse"...', "", "é"]
    assert [r[0] for r in rows.select(T.nfc_udf()(F.col("t"))).collect()][1:] == [None, unicodedata.normalize("NFC", "é")]


def test_summaries(spark):
    rows = spark.createDataFrame([(0, "short"), (1, "a fine summary of leases, long enough"), (2, "a summary with aaaaaaa run in its words"), (3, "a summary with 在 in its many words"), (4, "a summary with ribaInah in its words"), (5, None)], "i int, t string")
    got = {r["i"]: (r["v"], len(r["x"])) for r in rows.select("i", T.summary_valid(F.col("t")).alias("v"), T.summary_issues(F.col("t")).alias("x")).collect()}
    assert got == {0: (False, 1), 1: (True, 0), 2: (False, 1), 3: (False, 1), 4: (True, 1), 5: (False, 1)}
    assert spark.createDataFrame([("**Bold**  and *it* 2*3*4",)], "t string").select(T.clean_summary(F.col("t"))).collect()[0][0] == "Bold and it 2*3*4"


def test_extraction_edges(spark):
    pages = spark.createDataFrame([("A", 1, None), ("A", 2, "x\n1. Scope\n2.\n9 lives"), ("B", 1, "")], "standard_id string, page int, text string")
    lines = extraction.normalise_lines(pages)
    assert {(r["standard_id"], r["page"]) for r in extraction.empty_pages(pages).collect()} == {("A", 1), ("B", 1)}
    assert [(r["clause_id"], r["text"]) for r in extraction.parse_clauses(lines).collect()] == [("1", "Scope 2. 9 lives")]
    assert extraction.page_texts(lines).collect()[0]["text"] == "1. Scope\n2.\n9 lives"
    assert extraction.unparsed_numeric(lines).count() == 0
    twice = spark.createDataFrame([("A", "1"), ("A", "1"), ("A", "2")], "standard_id string, clause_id string")
    assert [(r["clause_id"], r["occurrence_count"]) for r in extraction.duplicate_clauses(twice).collect()] == [("1", 2)]


def test_audit_rollup(spark):
    responses = spark.createDataFrame([(1, "a [2] x y [1] z [9] q"), (2, "an answer without marks"), (3, T.ABSTENTION), (4, None)], "item_id int, response string")
    context = spark.createDataFrame([(1, 1, "t"), (1, 2, "u")], "item_id int, rank int, text string")
    got = {r["item_id"]: r for r in audit.audit_summary(responses, audit.audit_citations(responses, context)).collect()}
    assert got[1]["cited_ranks"] == [2, 1, 9] and got[1]["out_of_range"] == [9] and not got[1]["passed"]
    assert got[2]["uncited_attempt"] and not got[2]["passed"]
    assert got[3]["passed"] and got[4]["passed"]


def test_verdict_does_not_depend_on_the_index(spark):
    rows = spark.createDataFrame([(1, "SS9 2/3"), (2, "SS9 9/9"), (3, "SS44 1/1")], "item_id int, response string")
    context = spark.createDataFrame([(i, "SS9", "2/3/1", "body") for i in (1, 2, 3)], "item_id int, standard string, clause string, text string")
    index = spark.createDataFrame([("SS9", "9/9")], "standard string, path string")
    refs = audit.clause_references(rows)
    passed = lambda g: [(r["item_id"], r["passed"]) for r in audit.grounding_summary(rows, g).orderBy("item_id").collect()]
    assert passed(audit.ground(refs, context)) == passed(audit.ground(refs, context, index)) == [(1, True), (2, False), (3, False)]


def test_probes(spark):
    chunks = spark.createDataFrame([(1, "e.g. this", "A", "1"), (2, "e-g x", "B", "2"), (3, None, "A", None)], "doc_id int, text string, standard_id string, clause_id string")
    terms = spark.createDataFrame([("E.g.",), ("eg",), ("e",)], "term string")
    assert {r["term"]: r["n_chunks"] for r in probes.term_occurrences(chunks, terms).collect()} == {"E.g.": 1, "eg": 0, "e": 2}
    with pytest.raises(ValueError):
        probes.term_occurrences(chunks, spark.createDataFrame([(" ",)], "term string"))
    rows = [("a", "clause_absent_from_standard", None, None, None, ["A"], "2"), ("b", "clause_absent_from_standard", None, None, None, ["A"], "1"), ("c", "clause_absent_from_standard", None, None, None, ["Z"], "1"), ("d", "cross_standard_comparison", None, None, None, ["A", "Z"], None), ("e", "term_absent_from_corpus", None, 0, 3, None, None), ("f", "odd", None, None, None, None, None), ("f", "standard_absent_from_corpus", None, None, None, ["Z"], None)]
    table = spark.createDataFrame(rows, PROBE)
    got = sorted((r["probe_id"], *r["failures"]) for r in probes.verify_probes(table, chunks).collect())
    assert got == [("a",), ("b", "clause exists"), ("c", "standard is not indexed"), ("d", "standard is not indexed"), ("e", "no term"), ("f", "duplicate probe_id"), ("f", "duplicate probe_id", "unknown basis")]
    with pytest.raises(probes.ProbeVerificationError):
        probes.assert_verified(probes.verify_probes(table, chunks))
    made = probes.build_probes(table.withColumn("question_text", F.lit("q")).drop("occurrences", "of_chunks").filter("probe_id < 'c'"), chunks)
    assert [r["probe_id"] for r in made.collect()] == ["a"]
    item = probes.as_items(made).collect()[0]
    assert (item["expected_behavior"], item["verification_basis"], item["answerability"]) == ("abstain", "mechanical_corpus_absence", "unanswerable_from_corpus")
    with pytest.raises(PySparkException):
        probes.single_standard(chunks.withColumn("standard_id", F.lit(""))).collect()


def test_stored_index_gives_the_same_ranks(spark, sf, tmp_path):
    docs, asked = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    io.write_index(docs, str(tmp_path))
    ranks = lambda df: sorted((r["item_id"], r["rank"], r["doc_id"]) for r in df.collect())
    assert ranks(retrieval.bm25_search(io.read_index(spark, str(tmp_path)), asked)) == ranks(retrieval.bm25_topk(docs, asked))


def test_vector_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, [3.0, 4.0], "a"), (2, [1.0, 0.0], "b")], "vec_id int, embedding array<double>, standard string")
    assert io.write_vectors(rows, f"{tmp_path}/v", metadata=("standard",)) == 2
    assert {r["vec_id"]: r["embedding"] for r in io.read_vectors(spark, f"{tmp_path}/v", 2).collect()}[1] == [0.6, 0.8]
    with pytest.raises(ValueError):
        io.read_vectors(spark, f"{tmp_path}/v", 3)
    with pytest.raises(ValueError):
        io.write_vectors(rows.unionAll(rows), f"{tmp_path}/w")
    with pytest.raises(PySparkException):
        io.write_vectors(rows.withColumn("embedding", F.array(F.lit(0.0))), f"{tmp_path}/x")


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"probe_id": "p", "basis": "b", "question_text": "ü"}\n\n')
    assert io.read_probes(spark, f"{tmp_path}/a.jsonl", "probe_id string, basis string, question_text string").collect()[0]["question_text"] == "ü"
    (tmp_path / "b.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        io.read_jsonl(spark, f"{tmp_path}/b.jsonl", "x string")
    (tmp_path / "m.json").write_text('{"sources": [{"id": "A",\n "sha256": "0"}, {"id": "B", "sha256": "1"}]}')
    assert io.read_manifest(spark, f"{tmp_path}/m.json").count() == 2


def test_labels_and_traces(spark):
    items = spark.createDataFrame([(1, "answer", "corpus_cross_reference"), (2, "escalate", "qualified_scholar_review")], "item_id int, expected_behavior string, verification_basis string")
    routed = spark.createDataFrame([(1, "answer"), (2, "abstain")], "item_id int, decision string")
    got = {r["item_id"]: (r["matches_expected"], r["scholar_validated"]) for r in evaluation.evaluation_labels(items, routed).collect()}
    assert got == {1: (True, False), 2: (False, True)}
    with pytest.raises(PySparkException):
        evaluation.evaluation_labels(items.withColumn("expected_behavior", F.lit("maybe")), routed).collect()
    traces = spark.createDataFrame([("answer", ("answer",)), ("abstain", ("answer",))], "decision string, evaluation struct<expected_behavior: string>")
    assert evaluation.metrics_from_traces(traces).collect()[0]["over_abstention"] == 1
    with pytest.raises(PySparkException):
        evaluation.metrics_from_traces(traces.withColumn("evaluation", F.lit(None).cast("struct<expected_behavior: string>"))).collect()
    none = evaluation.routing_rates(routed.withColumn("expected", F.lit("answer")).limit(0), spark.createDataFrame([], "item_id int, n_gold long, n_hits long, recall double, any_gold boolean, all_gold boolean")).collect()[0]
    assert none["coverage"] == 0 and none["macro_recall"] is None


def test_auc_against_all_pairs(spark):
    scores = [-3.0, -2.999, -1e-9, 0.0, 0.0, 1e-300, 0.5, 0.5, 0.5001, 7.0, float("inf")]
    rows = [("x" if i % 2 else "y", s, (i * 7 + j) % 3 % 2) for i in range(4) for j, s in enumerate(scores)] + [("y", None, 1), ("y", float("nan"), 0)]
    got = {r["k"]: r["auc"] for r in evaluation.auc(spark.createDataFrame(rows, "k string, s double, l int"), "s", "l", by="k").collect()}
    for k in ("x", "y"):
        pos, neg = ([s for q, s, y in rows if q == k and y == v and s is not None and s == s] for v in (1, 0))
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(got[k] - want) < 1e-12
    one = evaluation.auc(spark.createDataFrame([], "s double, l int"), "s", "l").collect()[0]
    assert (one["n_pos"], one["auc"]) == (0, None)


def test_calibration(spark):
    rows = spark.createDataFrame([("a", 0.2, 1), ("a", 0.9, 0), ("b", None, 1), ("b", 0.5, 0)], "spec string, idf_coverage double, label int")
    rates, auc = answering.calibrate(rows, [0.5])
    assert {(r["spec"], r["label"]): (r["fired"], r["evaluable"], r["rate"]) for r in rates.collect()} == {("a", 1): (1, 1, 1.0), ("a", 0): (0, 1, 0.0), ("b", 1): (0, 0, None), ("b", 0): (0, 1, 0.0)}
    assert {r["spec"]: r["auc"] for r in auc.collect()} == {"a": 0.0, "b": None}


ITEMS = [(1, "Who maintains the asset?", None), (2, "When is rent due?", None), (3, "Nothing found?", None), (4, "Only titles?", None), (5, "Who insures it?", None), (6, "What is ended?", None)]
RANKED = [
    (1, 1, "c1", "SS9", "2/3", "SS9 §2/3", "The lessor must keep the leased asset in good repair at all times during the term."), (1, 2, "c2", "SS9", "2/4", "SS9 §2/4", "The lessee pays the rent in advance for each month."),
    (2, 1, "c2", "SS9", "2/4", "SS9 §2/4", "The lessee pays the rent in advance for each month."), (4, 1, "c3", "SS9", "5", "SS9 §5", "Termination of the contract"),
    (5, 1, "c4", "SS9", "6/1", "SS9 §6/1", "The owner insures the asset against loss at its own cost."), (6, 1, "c5", "SS9", "7/1", "SS9 §7/1", "The contract ends when the asset is lost."),
]
ANSWERS = [(1, "Repairs fall to the owner: [1] the lessor must keep the leased asset in good repair, as SS9 2/3 says."), (2, T.ABSTENTION), (5, "The owner, as SS9 9/9 has it: [1] insures the asset against loss at its own cost"), (6, "The contract, then.")]


def test_run_by_hand(spark):
    ranked = spark.createDataFrame(RANKED, "item_id int, rank int, chunk_id string, standard string, clause string, label string, text string")
    items = spark.createDataFrame(ITEMS, "item_id int, question string, gold_answer string")
    answers = answering.replay(spark.createDataFrame(ANSWERS, "item_id int, response string"))
    index = spark.createDataFrame([("SS9", "2/3"), ("SS9", "7/7")], "standard string, path string")
    out = answering.run(items, ranked, answers, registry.routing.default_gates(), prompts.variants(spark, "ACME", "v1"), index=index)
    got = sorted((r["item_id"], r["decision"], r["triggering_gate"], r["served_answer"] is not None, r["cited_chunk_ids"], r["short_circuited"]) for r in out.collect())
    assert got == [
        (1, "answer", None, True, ["c1"], False), (2, "abstain", "model_did_not_abstain", False, [], False), (3, "abstain", "retrieval_non_empty", False, [], True),
        (4, "abstain", "retrieval_normative", False, [], True), (5, "escalate", "clause_grounding", False, ["c4"], False), (6, "escalate", "citation_integrity", False, [], False),
    ]


def test_run_stops_leaks_and_asks_only_survivors(spark):
    asked = []

    def generate(rows):
        asked.extend(r["item_id"] for r in rows.collect())
        return rows.select("item_id", F.lit("[1] The lessor must keep the asset in repair.").alias("response"))

    schema = "item_id int, rank int, chunk_id string, standard string, clause string, label string, text string"
    ranked = spark.createDataFrame(RANKED, schema)
    items = spark.createDataFrame(ITEMS, "item_id int, question string, gold_answer string")
    gates = registry.routing.default_gates()
    out = answering.run(items, ranked, generate, gates, prompts.variants(spark, "ACME", "v5")).collect()
    assert sorted(asked) == [1, 2, 5, 6] and len(out) == 6  # each once, however many audits read the answers
    leaking = items.withColumn("gold_answer", F.lit("good repair"))
    with pytest.raises(PySparkException):
        answering.run(leaking, ranked, answering.replay(spark.createDataFrame([(1, "x")], "item_id int, response string")), gates, prompts.variants(spark, "ACME", "v1")).collect()
    with pytest.raises(KeyError):
        prompts.variants(spark, "ACME", "v6")


def test_stored_context_and_small_reports(spark):
    top = spark.createDataFrame([(1, 1, "c1")], "item_id int, rank int, chunk_id string")
    chunks = spark.createDataFrame([("c1", "t")], "chunk_id string, text string")
    assert answering.stored_context(top, chunks).count() == 1
    with pytest.raises(PySparkException):
        answering.stored_context(top, chunks.limit(0)).count()
    rows = spark.createDataFrame([("v1", "[1] yes"), ("v3", "yes"), ("v4", T.ABSTENTION), ("v9", None)], "variant string, response string")
    assert [r["estimated_behavior"] for r in answering.abstention_triggers(rows).collect()] == ["likely_abstain", "likely_answer", "abstain", None]
    times = spark.createDataFrame([(1, "route", 0.1234567), (1, "generate", 2.0)], "item_id int, stage string, seconds double")
    assert answering.stage_seconds(times).collect()[0]["seconds"] == {"route": 0.123457, "generate": 2.0}


def test_exact_intervals(spark):
    rows = spark.createDataFrame([(0, 7), (19, 19), (60, 120), (0, 0)], "hits int, n int")
    got = {(r["hits"], r["n"]): r for r in evaluation.exact_intervals(rows).collect()}
    assert got[19, 19]["lo"] == pytest.approx(0.025 ** (1 / 19)) and got[60, 120]["informative"] and not got[0, 7]["informative"] and got[0, 0]["lo"] is None

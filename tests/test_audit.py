import duckdb
import pytest

from lexigrid.operators import audit
from lexigrid.plans import registry

CITED = [(1, "Intro. [1] the lessor must keep the leased asset in good repair [2] the lessor must keep the leased asset in good repair [3] short one [9] nothing like this was ever said in it [2] some other words that nobody has written there"), (2, "no markers here"), (3, None)]
CONTEXT = [(1, 1, "the lessor must keep the leased asset in good repair at all times"), (1, 2, "the lessee pays rent in advance for each month"), (1, 3, "termination of the contract"), (2, 1, "x")]
REFS = [(1, "As SS 9 2/3 says, and 4/1/2 too. See 7/7 of SS8 and 8/8. SS44 1/1"), (2, "Under item no. 6/4 of Shari'ah Standard No. (05), SS08 1/2/3/4/5/6"), (3, None), (4, "2/3 and 8/8")]
CLAUSES = [(1, "SS9", "2/3", "lease"), (1, "SS9", "4/1/2/5", "cites 12/45"), (2, "SS8", None, "quotes 6/4 whole"), (4, None, "2/3", None), (4, "SS9", "2/3/1", "x")]
INDEX = [("SS9", "2/3"), ("SS9", "4/1/2/5"), ("SS8", "8/8"), ("SS9", "7/7")]
GROUNDED = [
    (1, 8, "SS9", "2/3", "grounded_in_context", "exact"), (1, 22, "SS9", "4/1/2", "grounded_in_context", "ancestor"), (1, 37, "SS9", "7/7", "outside_context", "corpus_exact"), (1, 52, "SS8", "8/8", "outside_context", "corpus_exact"),
    (1, 62, "SS44", "1/1", "unknown_standard", "standard_not_in_corpus"), (2, 15, "SS5", "6/4", "grounded_in_context", "verbatim_in_context"), (2, 55, "SS8", "1/2/3/4", "unresolvable", "no_match"), (2, 63, "SS8", "5/6", "unresolvable", "no_match"),
    (4, 0, None, "2/3", "grounded_in_context", "ancestor"), (4, 8, None, "8/8", "outside_context", "corpus_exact"),
]


def test_attributions(spark):
    more = [(4, "[1] the lessor 漢 must 漢 keep 漢 the leased asset in good repair at all times [2] the 漢 lessor must 漢 keep the 漢 leased asset in good 漢 repair at all times [0] none")]
    ranks = [(4, 1, "nothing of the kind"), (4, 2, "the lessor must keep the leased asset in good repair at all times")]
    out = audit.audit_citations(spark.createDataFrame(CITED + more, "item_id int, response string"), spark.createDataFrame(CONTEXT + ranks, "item_id int, rank int, text string"))
    got = {(r["item_id"], r["segment_no"]): r for r in out.collect()}
    assert [(k, r["cited_rank"], r["attribution"], r["best_rank"]) for k, r in sorted(got.items())] == [
        ((1, 0), 1, "supported", 1), ((1, 1), 2, "misattributed", 1), ((1, 2), 3, "too_short", None), ((1, 3), 9, "unknown_rank", None), ((1, 4), 2, "unverified", None),
        ((4, 0), 1, "corrupted", 2), ((4, 1), 2, "corrupted", None), ((4, 2), 0, "unknown_rank", None),
    ]
    assert all(CITED[0][1][r["marker_start"] : r["marker_start"] + 3] == f"[{r['cited_rank']}]" for k, r in got.items() if k[0] == 1)


def test_references_resolve(spark):
    responses = spark.createDataFrame(REFS, "item_id int, response string")
    refs = audit.clause_references(responses)
    context, index = spark.createDataFrame(CLAUSES, "item_id int, standard string, clause string, text string"), spark.createDataFrame(INDEX, "standard string, path string")
    at = {(r["item_id"], r["ref_no"]): r["char_offset"] for r in refs.collect()}
    shown = lambda out: sorted(((r["item_id"], at[r["item_id"], r["ref_no"]], r["standard"], r["path"], r["status"], r["resolved_via"]) for r in out.collect()), key=lambda r: r[:2])
    assert shown(audit.ground(refs, context, index)) == GROUNDED
    audit.write_clause_index(index, "clauses_by_hand", buckets=4, standard="standard", clause="path")
    assert shown(audit.ground(refs, context, spark.table("clauses_by_hand"), stored=True)) == GROUNDED
    spark.sql("DROP TABLE clauses_by_hand")
    rollup = [(r["item_id"], r["n_references"], r["n_distinct"], r["passed"]) for r in audit.grounding_summary(responses, audit.ground(refs, context, index)).orderBy("item_id").collect()]
    assert rollup == [(1, 5, 5, False), (2, 3, 3, False), (3, 0, 0, True), (4, 2, 2, False)]


def test_matches_in_one_long_text(spark):
    text = "SS7 " + "".join(f"item {i}/{i % 9} " + "x" * (i % 130) for i in range(4000))
    out = audit.clause_references(spark.createDataFrame([(1, text)], "item_id int, response string")).collect()
    assert len(out) == 4000 and all(text[r["char_offset"] :].startswith(r["path"]) for r in out)
    assert [r["standard"] for r in sorted(out, key=lambda r: r["char_offset"])[:3]] == ["SS7"] * 3 and sum(r["qualified"] for r in out) < 12


@pytest.mark.parametrize("name, column, values", [("citation_attribution", "attribution", set(audit.ATTRIBUTIONS)), ("grounding_status", "resolved_via", {"exact", "ancestor", "verbatim_in_context", "standard_not_in_corpus", "corpus_exact", "no_match", "no_corpus_index"})])
def test_every_outcome_occurs_in_the_query(sf, name, column, values):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert {r[0] for r in con.execute(f"SELECT DISTINCT {column} FROM ({registry.oracle_sql()[name]})").fetchall()} == values

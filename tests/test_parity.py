"""Matching forms, anchoring surface, policies, sensitivity, keys, stores: by hand-made cases and brute force."""

import json
import math
import random
import sys
import unicodedata
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators import anchoring, evaluation, extraction, prompts, retrieval, routing
from lexigrid.sources import io


def one_column(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(4)


def test_forms_of_every_character(spark):
    """The expression against the full Unicode forms, for each character between letters."""
    every = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF and not 0x1100 <= i <= 0x11FF and unicodedata.category(chr(i)) not in ("Mn", "Mc", "Me", "Cn")]
    texts = ["".join(f"x{c}y " for c in every[i : i + 500]) for i in range(0, len(every), 500)]
    rows = one_column(spark, texts).select("i", T.normalise(F.col("t")).alias("a"), T.normalise_udf()("t").alias("b")).collect()
    for r in rows:
        if r["a"] != r["b"]:
            own = every[r["i"] * 500 : r["i"] * 500 + 500]
            wrong = [hex(ord(c)) for c in own if " ".join(unicodedata.normalize("NFKC", f"x{c}y").translate(str.maketrans(T.FOLDS | {"…": "..."})).casefold().split()) not in r["a"]]
            assert not wrong, wrong[:20]


def test_forms_of_texts(spark):
    rng = random.Random(5)
    bits = ["ﬁnance", "ＳＳ８", "É", "ệ", "ß", "ΑΣ", "ς", "½", "㎏", "å", "Straße", "’s", "…", "—", " ", "İ", "ǰ", " ", "plain", "\t", "ﷺ", "ⅳ", "K", "Å", "ữ", "\U0001D400"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 9))) for _ in range(400)] + [None, ""]
    rows = one_column(spark, texts).select(T.normalise(F.col("t")).alias("a"), T.normalise_udf()("t").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)
    told = one_column(spark, ["ﬁnancial", "ＳＳ８", "the institution’s"]).orderBy("i").select(T.words(F.col("t")).alias("w"), T.classify_response(F.lit("Ｉ cannot answer from the given context")).alias("c")).collect()
    assert [r["w"] for r in told] == [["financial"], ["ss8"], ["the", "institution", "s"]] and told[0]["c"] == "abstained"


def test_surface_takes_ids(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["lease asset"] + ["other words"] * 40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Does ss17alpha govern leases of zebra"), (2, "what is it")], "item_id long, text string")
    contexts = spark.createDataFrame([(1, "lease asset", "SS17alpha", None)], "item_id long, text string, standard_id string, clause_id string")
    vocab = anchoring.vocabulary(docs)
    with_ids = {r["item_id"]: r for r in anchoring.anchoring_signal(items, vocab, 41, contexts).collect()}
    without = {r["item_id"]: r for r in anchoring.anchoring_signal(items, vocab, 41, contexts, anchoring.AnchorSpec(context_metadata_keys=())).collect()}
    assert with_ids[2]["n_anchors"] == 0 and with_ids[2]["coverage"] is None and with_ids[2]["oov_ratio"] is None and with_ids[2]["anchors"] == []
    assert "zebra" in with_ids[1]["uncovered_anchors"] and "zebra" in with_ids[1]["oov_anchors"]
    assert without[1]["n_covered"] == 0 or without[1]["n_covered"] < with_ids[1]["n_covered"] + 1
    assert set(with_ids[1]["uncovered_anchors"]) <= set(without[1]["uncovered_anchors"])
    assert math.isclose(with_ids[1]["max_uncovered_idf"], math.log(41))
    kept = anchoring.redacted(anchoring.anchoring_signal(items, vocab, 41, contexts), F.col("item_id") == 1).orderBy("item_id").collect()
    assert kept[0]["anchors"] is None and kept[0]["n_uncovered"] == len(with_ids[1]["uncovered_anchors"]) and kept[1]["anchors"] == []


def test_policies(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"_note": "x", "max_echo_ratio": 0.5, "enable_script_gate": False, "enable_anchoring_gate": True, "min_anchor_coverage": 0.25}))
    policy = routing.Policy.from_json_file(str(path))
    on = {g.name: g.enabled for g in policy.gates()}
    assert not on["script_integrity"] and on["lexical_anchoring"] and not on["reranker_margin"] and len(on) == 13
    assert policy.with_config(max_echo_ratio=0.9).max_echo_ratio == 0.9 and policy.max_echo_ratio == 0.5
    with pytest.raises(ValueError, match="max_eco"):
        routing.Policy.from_dict({"max_eco": 1})
    rows = routing.describe_gates(spark, policy.gates()).orderBy("position").collect()
    assert [r["name"] for r in rows] == list(routing.BASIS) and rows[0]["evidentiary_basis"] == "prompt_contract_untested_at_n7"


def test_exact_intervals_by_fractions():
    for hits, n in ((0, 7), (1, 7), (7, 7), (19, 19), (9, 17), (3, 40)):
        lo, hi = evaluation.clopper_pearson(hits, n)
        tail = lambda k, p: float(sum(Fraction(math.comb(n, i)) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))
        assert hits == 0 or abs(1 - tail(hits - 1, lo) - 0.025) < 1e-9
        assert hits == n or abs(tail(hits, hi) - 0.025) < 1e-9
    lo, hi = evaluation.clopper_pearson(300_000_000, 1_000_000_000)
    assert abs(lo - 0.3) < 5e-5 and abs(hi - 0.3) < 5e-5 and lo < 0.3 < hi


def test_clause_keys_want_ids(spark):
    rows = spark.createDataFrame([("SS1", None, None, " ")], "s string, c string, o int, u string")
    with pytest.raises(Exception, match="clause_id"):
        rows.select(evaluation.clause_key(F.col("s"), F.col("c"), F.col("o"), F.col("u")).alias("k")).collect()


def test_blocks_follow_crowded_values(spark):
    """Nearly all values close to one: no block holds more than a few hundredths of them, and the area is that of brute force."""
    rng = random.Random(2)
    rows = [(1 - rng.random() * 1e-6 if rng.random() < 0.95 else rng.random(), int(rng.random() < 0.4)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "s double, y int")
    sizes = [r["count"] for r in evaluation.in_blocks(df, "s").groupBy("block").count().collect()]
    assert max(sizes) < 200
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(evaluation.auc(df, "s", "y").collect()[0]["auc"] - want) < 1e-12


def test_contains_join_against_every_pair(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["ab", "cd", "efg", "h", "ij", "kl"])
    texts = [rng.choice([" ", "\n"]).join(word() for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    needles = sorted({t[a : a + rng.randrange(1, 16)] for t in texts if t for a in [rng.randrange(len(t))]} | {"ab  cd", " "})
    a = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    b = spark.createDataFrame([(j, n) for j, n in enumerate(needles)], "j long, n string")
    got = {(r["i"], r["j"]) for r in retrieval.contains_join(a, b, text="t", needle="n").collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, n in enumerate(needles) if n in t}


def test_dense_blocks_give_what_one_block_gives(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.filter("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id")
    rows = lambda block: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in retrieval.dense_topk(v, q, block=block).collect())
    assert rows(5) == rows(1000) and len(rows(5)) == 5 * q.count()


def test_trace_sink_counts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "secret words of a clause"), (2, "b")], "id long, text string")
    sink = io.TraceSink(str(tmp_path / "private" / "full"), str(tmp_path / "public"), texts=("text",), root=str(tmp_path), private=("private",))
    assert sink.write(rows) == {"full": 2, "public": 2} and sink.write(rows.limit(1)) == {"full": 3, "public": 3}
    public = spark.read.json(str(tmp_path / "public"))
    assert public.count() == 1 and "text" not in public.columns
    io.assert_no_text(public, rows.filter("id = 1"))
    with pytest.raises(io.PublicationBoundaryError):
        io.assert_no_text(rows, rows.filter("id = 1"))
    with pytest.raises(io.PublicationBoundaryError):
        io.TraceSink(str(tmp_path / "elsewhere"), root=str(tmp_path), private=("private",))
    with pytest.raises(io.MissingLicensedData):
        io.private_file(str(tmp_path / "none"))
    assert "spark" in io.provenance(spark, run="r1").collect()[0]["provenance"]


def test_gold_answer_leaks(spark):
    rows = spark.createDataFrame([(1, "the answer is rent", "rent"), (2, "x", " ")], "item_id long, user_prompt string, gold_answer string")
    with pytest.raises(prompts.GoldAnswerLeak):
        prompts.assert_no_leak(rows)
    prompts.assert_no_leak(rows.filter("item_id = 2"))


def test_names_of_characters(spark):
    out = {r["codepoint"]: r["name"] for r in extraction.codepoint_names(extraction.codepoint_histogram(spark.createDataFrame([("é漢—",)], "text string"))).collect()}
    assert out == {"U+00E9": "LATIN SMALL LETTER E WITH ACUTE", "U+6F22": "CJK UNIFIED IDEOGRAPH-6F22", "U+E000": "<unnamed>", "U+2014": "EM DASH"}


def test_lattice_by_brute_force(spark):
    rng = random.Random(9)
    masks = [rng.choice([0, 1, 2, 3, 8, 64, 72, 1024]) for _ in range(50)]
    gates = routing.default_gates()
    on = [i for i, g in enumerate(gates) if g.enabled]
    decide = lambda m: next((gates[i].decision for i in on if m >> i & 1), "answer")
    routed = spark.createDataFrame([(i, m) for i, m in enumerate(masks)], "item_id long, mask int")
    vectors = {tuple(decide(m & s) for m in masks) for k in range(1 << len(on)) for s in [sum(1 << on[j] for j in range(len(on)) if k >> j & 1)]}
    lattice, left = routing.ablation_lattice(routed, gates), routing.gate_contributions(routed, gates)
    out = routing.lattice_summary(lattice, left, gates).collect()[0]
    assert out["n_distinct_routings"] == len(vectors) and out["n_subsets"] == 1 << len(on)
    whole = [decide(m) for m in masks]
    changed = {gates[i].name for i in on if [decide(m & ~(1 << i)) for m in masks] != whole}
    assert set(out["load_bearing_gates"]) == changed and len(out["unexercised_gates"]) == len(on) - len(changed)

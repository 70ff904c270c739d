"""Findings of the third round, each by a small case."""

import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from lexigrid.functions import overlap
from lexigrid.functions import text as T
from lexigrid.operators import answering, audit, extraction, prompts, retrieval
from lexigrid.plans import registry
from tests.test_engine import values


def test_a_mark_before_a_last_line_break_is_not_final(spark):
    """trimmed of spaces as the SQL of response_checks does."""
    assert values(spark, T.heading_like, "It ends.\n", " It ends. ", "It\nends.", "\n", "  ", None) == [True, False, False, True, True, True]


def _plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_frequent_terms_are_no_keys(spark, monkeypatch):
    """Postings meet the queries' terms by a broadcast, in blocks of queries too, and hits aren't shuffled."""
    docs = spark.createDataFrame([(i, " ".join(["the"] * (i % 3 + 1) + [f"w{i % 7}", f"v{i % 5}"])) for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the w3"), (2, "v1 v2 the"), (3, "none"), (4, None)], "item_id long, text string")
    rows = lambda out: sorted((r["item_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in out.collect())
    one = retrieval.bm25_topk(docs, items)
    assert "SortMergeJoin" not in _plan(one)
    whole = rows(one)
    assert len(whole) == 20 and [r[2] for r in whole if r[0] == 3] == [0, 1, 2, 3, 4]
    monkeypatch.setattr(retrieval, "BROADCAST", 4)
    assert rows(retrieval.bm25_topk(docs, items)) == whole
    n, posts = docs.count(), retrieval.postings(docs)
    assert rows(retrieval.bm25_search((posts, retrieval.doc_stats(docs), retrieval.term_idf(posts, n)), items)) == whole


def test_dense_groups_are_of_a_fixed_size(spark, sf):
    """chunks of vectors against blocks of queries; lengths that differ, zeros and NaN."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(-1, [0.0, 0.0]), (-2, [1.0, 2.0]), (-3, [2.0, 4.0]), (-4, [float("nan"), 1.0]), (-5, None)], "vec_id long, embedding array<float>")
    v = v.unionByName(odd)
    q = v.filter("vec_id % 7 = 0 or vec_id < 0").withColumnRenamed("vec_id", "query_id")
    rows = lambda **k: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in retrieval.dense_topk(v, q, **k).collect())
    got = rows()
    assert rows(block=3, chunk=17) == got
    assert [r[2] for r in got if r[0] == -2] == [-4, -3, -2] and [r[2] for r in got if r[0] == -4] == [-4, -3, -2] and not [r for r in got if r[0] in (-1, -5)]


def test_contains_join_without_broadcasts(spark, monkeypatch):
    """the keys' hashes are broadcast, and joined by a shuffle where there are too many."""
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "xa b c d ey"), (3, "ab"), (4, None)], "i long, t string")
    needles = spark.createDataFrame([(1, "a b c d e"), (2, "ab"), (3, ""), (4, "b c"), (5, "b c")], "j long, n string")
    rows = lambda: sorted((r["i"], r["j"]) for r in retrieval.contains_join(texts, needles, text="t", needle="n").collect())
    whole = [(1, 1), (1, 4), (1, 5), (2, 1), (2, 4), (2, 5), (3, 2)]
    assert rows() == whole
    monkeypatch.setattr(retrieval, "BROADCAST", 0)
    assert rows() == whole
    assert retrieval.contains_join(texts, needles.filter("n = ''"), text="t", needle="n").count() == 0


def test_lines_of_a_standard_are_no_key(spark):
    """No exchange deals whole lines by standard alone."""
    pages = spark.createDataFrame([("SS1", p, "1. Scope\ntext a\n1/1 body") for p in range(9)], "standard_id string, page long, text string")
    plan = _plan(extraction.page_texts(extraction.normalise_lines(pages)))
    dealt = re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]\nArguments: hashpartitioning\(standard_id#\d+, \d+\)", plan)
    assert not [x for x in dealt if re.search(r"\bline#", x)]


def test_shingles_of_contexts_are_not_shuffled(spark):
    """A response meets the ranks of its item in one row; no exchange deals shingles."""
    responses = spark.createDataFrame([(1, "[1] a b c d e f g h i [2] a b [1] Ä_ß b c d e f [3] none [2] \U0001d400 Ⅷ b c d e f"), (2, "[1] alone"), (3, "none"), (4, None)], "item_id int, response string")
    context = spark.createDataFrame([(1, 2, "x a b c d e f g h i"), (1, 1, "a b c d e f g h i ä SS b c d e f"), (1, 3, None), (5, 1, "a")], "item_id int, rank int, text string")
    out = audit.audit_citations(responses, context)
    plan = _plan(out)
    assert not re.search(r"Exchange\nInput \[\d+\]: \[[^\]]*_gram#", plan) and plan.count("\nArguments: hashpartitioning") <= 2
    got = [(r["item_id"], r["segment_no"], r["cited_rank"], r["marker_start"], r["n_words"], r["cited_overlap"], r["best_rank"], r["best_overlap"], r["attribution"]) for r in out.orderBy("item_id", "segment_no").collect()]
    assert got == [
        (1, 0, 1, 0, 9, 1.0, 1, 1.0, "supported"), (1, 1, 2, 22, 2, 1.0, 1, 1.0, "too_short"), (1, 2, 1, 30, 7, 1.0, 1, 1.0, "supported"), (1, 3, 3, 48, 1, 0.0, None, 0.0, "too_short"),
        (1, 4, 2, 57, 7, 0.0, None, 0.0, "unverified"), (2, 0, 1, 0, 1, 0.0, None, 0.0, "unknown_rank"),
    ]


def test_words_of_overlaps_are_words_of_texts(spark):
    """All characters, each alone and between letters, split and fold as in the expression."""
    chars = [chr(i) for i in range(0x3000) if unicodedata.category(chr(i)) != "Cn"]
    texts = [f"{c}a{c}B {c}" for c in chars if not unicodedata.combining(c) and not 0x1100 <= ord(c) < 0x1200] + ["STRASSE Straße ΟΔΟΣ οδος", "x_y-z’s 1½"]
    told = spark.createDataFrame(list(enumerate(texts)), "i int, t string").filter(~F.col("t").rlike(r"\p{Cn}")).select("i", T.words(F.col("t")).alias("w")).collect()  # without those newer than the Unicode of Java
    assert len(told) > 6000
    own = {r["i"]: [w if isinstance(w, str) else w.decode() for w in overlap.words(texts[r["i"]])] for r in told}
    assert not [(texts[r["i"]], r["w"], own[r["i"]]) for r in told if r["w"] != own[r["i"]]]


def test_echoes_of_whole_contexts(spark):
    """F16: the signals' echo and number of words are those of the expressions, which the run no longer evaluates on every answer and context."""
    texts = ["a b c d e f g h i j", "A_B", None, "", "Ä straße 漢 b c d e f g h", "one two three"]
    responses = spark.createDataFrame(list(enumerate(texts)), "item_id int, response string")
    ranked = spark.createDataFrame([(i, 1, "SS1", "1", "l", t) for i, t in enumerate(["a b c d e f g h x", "b a", "c", "d", "ä STRASSE 漢 b c d e f g h", None])], "item_id int, rank int, standard string, clause string, label string, text string")
    out = answering.response_signals(responses, ranked)
    assert "zip_with" not in _plan(out) and "array_intersect" not in _plan(out)
    got = out.join(prompts.context_text(ranked), "item_id", "left").select("n_words", "echo_ratio", F.size(T.words(F.col("response"))), T.overlap_ratio(F.col("response"), F.col("context")), "item_id").collect()
    assert len(got) == 6 and all(r[0] == r[2] and r[1] == r[3] for r in got) and {r[4]: r[1] for r in got}[0] == 1 / 3


def test_overlaps_are_those_of_sets():
    """random texts of few words, with contexts missing, empty or shorter than the shingles, against sets of shingles."""
    rng = np.random.default_rng(5)
    some = lambda most: rng.integers(0, 3, rng.integers(0, most)).astype("u8")
    rows = np.sort(rng.integers(0, 40, 160))
    texts = [some(24) for _ in rows]
    there = [(r, s) for r in range(45) for s in range(3) if rng.random() < 0.7]
    contexts = [some(60) for _ in there]
    n, both = overlap.shared(texts, rows, contexts, np.array([r for r, _ in there]), np.array([s for _, s in there]))
    grams = lambda t, w: {tuple(t[i : i + w].tolist()) for i in range(len(t) - w + 1)} if w else set()
    for i, (r, t) in enumerate(zip(rows, texts)):
        own = grams(t, w := min(len(t), T.WIDTH))
        assert n[i] == len(own)
        for s in range(3):
            assert both[i, s] == sum(len(own & grams(c, w)) for c, k in zip(contexts, there) if k == (r, s))
    none = np.array([], "i8")
    assert [x.tolist() for x in overlap.shared(texts[:2], rows[:2], [], none, none)] == [n[:2].tolist(), [[], []]]


def test_words_are_hashed_together():
    """equal words have equal hashes and others have not, whatever stands around them, short, long and very long ones, in texts of one script and of several."""
    own = [*"abcdefghij", "ab", "ba", "abcdefgh", "abcdefghi", "bbcdefghi", "abcdefghj", "x" * 511, "x" * 512, "x" * 513, "x" * 2000, "x" * 2001, "é", "éa", "漢字", "漢", "a1b2"]
    one = {w: overlap.word_hashes([w])[0].tolist() for w in own}
    assert all(len(h) == 1 for h in one.values()) and len({h[0] for h in one.values()}) == len(own)
    texts = [" ".join(own), "", "  ", " ".join(own[::-1]).upper() + ".", "!", "b-a_c"]
    assert [h.tolist() for h in overlap.word_hashes(texts)] == [[one[w][0] for w in t] for t in (own, [], [], own[::-1], [], ["b", "a", "c"])]
    assert overlap.word_hashes([]) == []


def test_whole_quotes_are_hashed_once(monkeypatch):
    """a response that quotes its context whole."""
    asked, real = [], overlap.word_hashes
    monkeypatch.setattr(overlap, "word_hashes", lambda t: asked.extend(t) or real(t))
    quote = "a b c d e f g h i"
    got = overlap._compared([([1, 2], [quote, "x"], [None, None], [{"rank": 1, "text": f" {quote} "}, {"rank": 2, "text": None}])])
    assert got == [(9, 1.0, 1.0, 1, 0.0), (1, 0.0, 0.0, None, 0.0)] and asked.count(quote) == 1 and len(asked) == 3


def test_marked_responses_are_not_classified(spark, sf, monkeypatch):
    """classes are of use where nothing is cited, and are computed there only; no text is joined to see which contexts have a response."""
    monkeypatch.setattr(T, "classify_response", lambda c: F.raise_error(F.concat(F.lit("classified "), c)).cast("string"))
    responses = spark.createDataFrame([(1, "[1] a b"), (2, "x [2] a")], "item_id int, response string")
    segments = audit.audit_citations(responses, spark.createDataFrame([(1, 1, "a b")], "item_id int, rank int, text string"))
    assert sorted((r["item_id"], r["n_segments"], r["passed"]) for r in audit.audit_summary(responses, segments).collect()) == [(1, 1, True), (2, 1, False)]
    monkeypatch.undo()
    odd = spark.createDataFrame([(1, "[1] a b"), (None, "[1] one two"), (3, "no mark"), (4, None), (5, "I cannot answer from the given context.")], "item_id int, response string")
    got = {r["item_id"]: (r["n_segments"], r["uncited_attempt"], r["passed"]) for r in audit.audit_summary(odd, segments.filter("item_id = 1")).collect()}
    assert got == {1: (1, False, True), None: (0, True, False), 3: (0, True, False), 4: (0, False, True), 5: (0, False, True)}
    assert "LeftSemi" not in _plan(registry.citation_audit(spark, sf))

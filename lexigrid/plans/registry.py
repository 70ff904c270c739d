"""Registered queries of the engine's own operators over the driver tables, with their SQL."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators import anchoring, answering, audit, dense_index, evaluation, extraction, probes, prompts, retrieval, routing
from lexigrid.sources import io
from lexigrid.sources.scratch import scratch, stored

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql_values(rows, columns: str) -> str:
    lit = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({columns})"


_TOKENS = r"regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+(?:[''’][\p{{L}}\p{{N}}_]+)?')"
_FOLDED = "replace(lower({c}), 'ß', 'ss')"
_NORM = "trim(regexp_replace(replace(lower(replace({c}, '…', '...')), 'ß', 'ss'), '\\s+', ' ', 'g'))"

_BM25 = f"""
toks AS (SELECT doc_id, unnest({_TOKENS.format(c='text')}) AS raw FROM documents),
post AS (SELECT doc_id, {_FOLDED.format(c='raw')} AS term, count(*) AS tf FROM toks GROUP BY ALL),
dl AS (SELECT doc_id, len({_TOKENS.format(c='text')})::BIGINT AS dl FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln(st.n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term, st.n),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT item_id, unnest({_TOKENS.format(c='text')}) AS raw FROM benchmark),
q AS (SELECT item_id, {_FOLDED.format(c='raw')} AS term, count(*) AS qtf FROM qt GROUP BY ALL),
sc AS (SELECT q.item_id, p.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / st.avgdl))) AS score
       FROM q JOIN post p USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = p.doc_id, st GROUP BY ALL),
al AS (SELECT b.item_id, d.doc_id, coalesce(sc.score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN sc ON sc.item_id = b.item_id AND sc.doc_id = d.doc_id),
top AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM al) WHERE rank <= 5)"""


def _top(spark, d):
    """The five best of each item, stored: they are ranked once, and documents meet these few rows without a shuffle of whole texts."""
    return stored(retrieval.bm25_topk(_t(spark, d, "documents"), _t(spark, d, "benchmark")), "top")


@_query(f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM top")
def bm25_topk(spark, d):
    return _top(spark, d).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@_query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, d):
    docs = _t(spark, d, "documents")
    return retrieval.idf_of(retrieval.term_df(docs), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@_query(f"WITH {_BM25} SELECT doc_id, dl FROM dl")
def bm25_docstats(spark, d):
    return retrieval.doc_stats(_t(spark, d, "documents"))


_COS = """pairs AS (SELECT q.vec_id AS query_id, v.vec_id, v.embedding AS a, q.embedding AS b FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0),
el AS (SELECT query_id, vec_id, unnest(a)::DOUBLE AS x, unnest(b)::DOUBLE AS y FROM pairs),
sim AS (SELECT query_id, vec_id, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS similarity FROM el GROUP BY ALL),
dtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM sim) WHERE rank <= 5)"""


def _dense(spark, d):
    v = _t(spark, d, "embeddings")
    return retrieval.dense_topk(v, v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"))


@_query(f"WITH {_COS} SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM dtop")
def dense_topk(spark, d):
    return _dense(spark, d).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@_query()
def dense_index_topk(spark, d):
    """The five nearest vectors of those with an id divisible by 100, by the stored approximate index; tested against dense_topk."""
    v, path = _t(spark, d, "embeddings"), scratch(spark, "dense-index")
    dense_index.write_dense_index(v, path)
    best = dense_index.dense_index_topk(spark, path, v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"))
    return best.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@_query(f"""WITH {_BM25}, {_COS},
l AS (SELECT item_id AS query_id, doc_id AS vec_id, score, rank AS lexical_rank FROM top WHERE item_id % 100 = 0),
b AS (SELECT query_id, vec_id, score, lexical_rank, similarity, rank AS dense_rank FROM l FULL OUTER JOIN dtop USING (query_id, vec_id))
SELECT query_id, vec_id, concat_ws('+', CASE WHEN lexical_rank IS NOT NULL THEN 'bm25' END, CASE WHEN dense_rank IS NOT NULL THEN 'dense' END) AS sources,
  row_number() OVER (PARTITION BY query_id ORDER BY lexical_rank NULLS LAST, dense_rank) AS position FROM b""")
def hybrid_merge(spark, d):
    lexical = _top(spark, d).filter("item_id % 100 = 0").withColumnsRenamed({"item_id": "query_id", "doc_id": "vec_id"})
    return retrieval.hybrid_merge(lexical, _dense(spark, d), query_id="query_id", id="vec_id").select("query_id", "vec_id", "sources", "position")


@_query(_SQL["hybrid_merge"].replace(" WHERE item_id % 100 = 0", ""))
def hybrid_merge_all(spark, d):
    """hybrid_merge with the lexical hits of all benchmark items; items without a vector query have lexical rows only."""
    lexical = _top(spark, d).withColumnsRenamed({"item_id": "query_id", "doc_id": "vec_id"})
    return retrieval.hybrid_merge(lexical, _dense(spark, d), query_id="query_id", id="vec_id").select("query_id", "vec_id", "sources", "position")


@_query(f"""WITH {_BM25}, r AS (SELECT item_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score / dl DESC, rank) AS r, score / dl AS s FROM top JOIN dl USING (doc_id))
SELECT item_id, round(max(CASE WHEN r = 1 THEN s END), 6) AS top_1, round(max(CASE WHEN r = 2 THEN s END), 6) AS top_2, round(max(CASE WHEN r = 1 THEN s END) - max(CASE WHEN r = 2 THEN s END), 6) AS margin FROM r GROUP BY item_id""")
def rerank_signal(spark, d):
    hits = _top(spark, d).withColumnRenamed("rank", "first_rank").join(retrieval.doc_stats(_t(spark, d, "documents")), "doc_id").withColumn("model", F.col("score") / F.col("dl"))
    out = retrieval.rerank_signal(retrieval.rerank(hits, "model", query_id="item_id", tie="first_rank"), "model", query_id="item_id")
    return out.select("item_id", *[F.round(c, 6).alias(c) for c in ("top_1", "top_2", "margin")])


_GOLD = """gold AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON position(array_to_string(list_slice(string_split(b.text, ' '), 1, 8), ' ') IN d.text) > 0),
ev AS (SELECT g.item_id, count(*) AS n_gold, count(t.rank) AS n_hits FROM gold g LEFT JOIN top t ON t.item_id = g.item_id AND t.doc_id = g.doc_id GROUP BY g.item_id)"""


def _gold(spark, d):
    """item_id, doc_id: documents that hold an item's first eight words as a substring."""
    start = F.array_join(F.slice(F.split("text", " "), 1, 8), " ")
    items = _t(spark, d, "benchmark").select("item_id", start.alias("start"))
    return retrieval.contains_join(_t(spark, d, "documents").select("doc_id", "text"), items, text="text", needle="start").select("item_id", "doc_id")


@_query(f"WITH {_BM25}, {_GOLD} SELECT item_id, n_gold, n_hits, round(n_hits / n_gold::DOUBLE, 6) AS recall, n_hits > 0 AS any_gold, n_hits = n_gold AS all_gold FROM ev")
def gold_recall(spark, d):
    return evaluation.gold_recall(_gold(spark, d), _top(spark, d), ["doc_id"]).withColumn("recall", F.round("recall", 6))


@_query(f"WITH {_BM25}, {_GOLD} SELECT count(*) AS n_items, sum(n_hits)::BIGINT AS hits, sum(n_gold)::BIGINT AS gold, round(avg(n_hits / n_gold::DOUBLE), 6) AS macro_recall, round(sum(n_hits)::DOUBLE / sum(n_gold), 6) AS micro_recall FROM ev")
def recall_macro_micro(spark, d):
    out = evaluation.recall_summary(evaluation.gold_recall(_gold(spark, d), _top(spark, d), ["doc_id"]))
    return out.withColumns({c: F.round(c, 6) for c in ("macro_recall", "micro_recall")})


_START = "array_to_string(list_slice(string_split(b.text, ' '), 1, 8), ' ')"


def _gold_whole(spark, d):
    """item_id, doc_id: documents that hold an item's whole text as a substring."""
    items = _t(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    return retrieval.contains_join(_t(spark, d, "documents").select("doc_id", "text"), items, text="text", needle="passage").select("item_id", "doc_id")


@_query(_SQL["gold_recall"].replace(_START, "b.text"))
def gold_recall_whole(spark, d):
    """gold_recall by whole passages."""
    return evaluation.gold_recall(_gold_whole(spark, d), _top(spark, d), ["doc_id"]).withColumn("recall", F.round("recall", 6))


@_query(_SQL["recall_macro_micro"].replace(_START, "b.text"))
def recall_macro_micro_whole(spark, d):
    """recall_macro_micro by whole passages."""
    out = evaluation.recall_summary(evaluation.gold_recall(_gold_whole(spark, d), _top(spark, d), ["doc_id"]))
    return out.withColumns({c: F.round(c, 6) for c in ("macro_recall", "micro_recall")})


_SUFFIX = "CASE WHEN {c} LIKE '%ies' AND length({c}) >= 7 THEN substr({c}, 1, length({c}) - 3) || 'y' WHEN {c} LIKE '%ing' AND length({c}) >= 7 THEN substr({c}, 1, length({c}) - 3) WHEN {c} LIKE '%ed' AND length({c}) >= 6 THEN substr({c}, 1, length({c}) - 2) WHEN {c} LIKE '%es' AND length({c}) >= 6 THEN substr({c}, 1, length({c}) - 2) WHEN {c} LIKE '%s' AND length({c}) >= 5 THEN substr({c}, 1, length({c}) - 1) ELSE {c} END"
_VOCAB = f"""atk AS (SELECT doc_id, unnest({_TOKENS.format(c=_NORM.format(c='text'))}) AS tok FROM documents),
vocab AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, {_SUFFIX.format(c='tok')} AS term FROM atk) GROUP BY term)"""


@_query(f"WITH {_VOCAB} SELECT term, df FROM vocab")
def anchor_vocab(spark, d):
    return anchoring.vocabulary(_t(spark, d, "documents"))


_STOP = ", ".join(f"'{w}'" for w in (*anchoring.STOPWORDS, *anchoring.FRAME_TERMS))


_COVER = f"""{_VOCAB},
bt AS (SELECT item_id, unnest({_TOKENS.format(c=_NORM.format(c='text'))}) AS tok FROM benchmark),
ca AS (SELECT DISTINCT item_id, {_SUFFIX.format(c='tok')} AS anchor FROM bt WHERE tok NOT IN ({_STOP}) AND NOT regexp_matches(tok, '[0-9]') AND length(tok) >= 4),
an AS (SELECT * FROM (SELECT item_id, anchor, df IS NULL AS oov, ln((SELECT n FROM st) / (1 + coalesce(df, 0))) AS idf FROM ca LEFT JOIN vocab ON vocab.term = {_SUFFIX.format(c='anchor')}) WHERE idf >= 2.0),
cx AS (SELECT DISTINCT top.item_id, {_SUFFIX.format(c='tok')} AS anchor FROM top JOIN atk USING (doc_id)),
ag AS (SELECT an.item_id, count(*) AS n_anchors, count(cx.anchor) AS n_covered, count(*) FILTER (oov) AS n_oov, sum(idf) AS total, sum(CASE WHEN cx.anchor IS NULL THEN 0 ELSE idf END) AS got
       FROM an LEFT JOIN cx ON cx.item_id = an.item_id AND cx.anchor = an.anchor GROUP BY an.item_id)"""


@_query(f"""WITH {_BM25}, {_COVER}
SELECT item_id, n_anchors, n_covered, n_oov, round(n_covered::DOUBLE / n_anchors, 6) AS coverage, round(got / total, 6) AS idf_coverage FROM ag""")
def anchor_coverage(spark, d):
    docs = _t(spark, d, "documents")
    found = anchoring.anchors(_t(spark, d, "benchmark"), anchoring.vocabulary(docs), docs.count())
    contexts = _top(spark, d).select("item_id", "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    out = anchoring.coverage(found, contexts).select("item_id", "n_anchors", "n_covered", "n_oov", "coverage", "idf_coverage")
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "idf_coverage")})


_PAIRS = """p AS (SELECT a.conv_id, a.turn, a.text AS response, u.text AS context FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant')"""


def _pairs(spark, d):
    c = _t(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("response")).join(before, ["conv_id", "turn"])


@_query(f"""WITH {_PAIRS}, w AS (SELECT conv_id, turn, regexp_extract_all({_NORM.format(c='response')}, '[\\p{{L}}\\p{{N}}]+') AS a, regexp_extract_all({_NORM.format(c='context')}, '[\\p{{L}}\\p{{N}}]+') AS b FROM p),
n AS (SELECT *, least(8, greatest(len(a), 1)) AS k FROM w),
sa AS (SELECT DISTINCT conv_id, turn, array_to_string(list_slice(a, i, i + k - 1), ' ') AS g FROM (SELECT *, unnest(generate_series(1, greatest(len(a) - k + 1, 1))) AS i FROM n WHERE len(a) > 0)),
sb AS (SELECT DISTINCT conv_id, turn, array_to_string(list_slice(b, i, i + k - 1), ' ') AS g FROM (SELECT *, unnest(generate_series(1, greatest(len(b) - k + 1, 1))) AS i FROM n WHERE len(b) > 0)),
h AS (SELECT sa.conv_id, sa.turn, count(*) AS total, count(sb.g) AS hit FROM sa LEFT JOIN sb ON sb.conv_id = sa.conv_id AND sb.turn = sa.turn AND sb.g = sa.g GROUP BY ALL)
SELECT n.conv_id, n.turn, round(coalesce(hit::DOUBLE / total, 0), 6) AS echo FROM n LEFT JOIN h ON h.conv_id = n.conv_id AND h.turn = n.turn""")
def echo_ratio(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.round(T.overlap_ratio(F.col("response"), F.col("context")), 6).alias("echo"))


# Responses made from all documents: by id the abstention line alone, dressed up, with a word, between texts, a short text, and a text with a foreign character.
_SAID_SQL = f"""SELECT doc_id AS item_id, lang, CASE doc_id % 7 WHEN 0 THEN '{T.ABSTENTION}' WHEN 1 THEN '**' || upper('{T.ABSTENTION}') || '.**' WHEN 2 THEN '{T.ABSTENTION}. Sorry' WHEN 3 THEN text || ' {T.ABSTENTION}. ' || text WHEN 4 THEN substr(text, 1, 40) WHEN 5 THEN text || ' 在' ELSE '12 ' || doc_id END AS response FROM documents"""


def _said(spark, d):
    i, t = F.col("doc_id"), F.col("text")
    forms = [F.lit(T.ABSTENTION), F.lit(f"**{T.ABSTENTION.upper()}.**"), F.lit(f"{T.ABSTENTION}. Sorry"), F.concat(t, F.lit(f" {T.ABSTENTION}. "), t), F.substring(t, 1, 40), F.concat(t, F.lit(" 在")), F.concat(F.lit("12 "), i.cast("string"))]
    out = F.when(i % 7 == 0, forms[0])
    for n, f in enumerate(forms[1:], 1):
        out = out.when(i % 7 == n, f)
    return _t(spark, d, "documents").select(i.alias("item_id"), "lang", out.alias("response"))


_CLASSES_SQL = r"""n AS (SELECT *, coalesce(response, '') AS raw, trim(regexp_replace(lower(coalesce(response, '')), '\s+', ' ', 'g')) AS t FROM r),
k AS (SELECT *, position('i cannot answer from the given context' IN t) > 0 AS there, len(regexp_extract_all(replace(t, 'i cannot answer from the given context', ' '), '\p{L}\p{L}+')) AS rest FROM n),
rc0 AS (SELECT *, CASE WHEN NOT there AND rest = 0 THEN 'empty' WHEN there AND rest < 2 THEN 'abstained' WHEN there THEN 'mixed' ELSE 'answered' END AS response_class FROM k)"""


@_query(f"WITH r AS ({_SAID_SQL}), {_CLASSES_SQL} " + r"""SELECT item_id, response_class, CASE WHEN trim(raw) = 'I cannot answer from the given context' THEN 'abstained' ELSE 'answered' END AS legacy_class,
  trim(raw) = '' OR (NOT regexp_matches(trim(raw), '[.;:?!]$') AND len(regexp_extract_all(t, '[\p{L}\p{N}]+')) <= 12) AS heading_like,
  len(list_distinct(regexp_extract_all(raw, '[一-鿿぀-ヿ가-힯Ѐ-ӿ؀-ۿ]')))::INT AS n_foreign FROM rc0""")
def response_checks(spark, d):
    """Classes of responses made from all documents."""
    c = F.col("response")
    return _said(spark, d).select("item_id", T.classify_response(c).alias("response_class"), T.classify_response_legacy(c).alias("legacy_class"), T.heading_like(c).alias("heading_like"), F.size(T.unexpected_script(c)).alias("n_foreign"))


@_query("""WITH r AS (SELECT conv_id, turn, text AS response FROM conversations),
n AS (SELECT conv_id, turn, coalesce(response, '') AS raw, trim(regexp_replace(lower(coalesce(response, '')), '\\s+', ' ', 'g')) AS t FROM r),
k AS (SELECT *, position('i cannot answer from the given context' IN t) > 0 AS there, len(regexp_extract_all(replace(t, 'i cannot answer from the given context', ' '), '\\p{L}\\p{L}+')) AS rest FROM n)
SELECT conv_id, turn, CASE WHEN NOT there AND rest = 0 THEN 'empty' WHEN there AND rest < 2 THEN 'abstained' WHEN there THEN 'mixed' ELSE 'answered' END AS response_class,
  CASE WHEN trim(raw) = 'I cannot answer from the given context' THEN 'abstained' ELSE 'answered' END AS legacy_class,
  trim(raw) = '' OR (NOT regexp_matches(trim(raw), '[.;:?!]$') AND len(regexp_extract_all(t, '[\\p{L}\\p{N}]+')) <= 12) AS heading_like,
  len(list_distinct(regexp_extract_all(raw, '[一-鿿぀-ヿ가-힯Ѐ-ӿ؀-ۿ]')))::INT AS n_foreign FROM k""")
def response_checks_all(spark, d):
    """response_checks over all turns of all conversations."""
    c = F.col("text")
    return _t(spark, d, "conversations").select("conv_id", "turn", T.classify_response(c).alias("response_class"), T.classify_response_legacy(c).alias("legacy_class"), T.heading_like(c).alias("heading_like"), F.size(T.unexpected_script(c)).alias("n_foreign"))


@_query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '!!!!+|\\.\\.\\.\\.+|----+|====+|____+|\\*\\*\\*\\*+|####+|    +')))::INT AS n_runs FROM documents WHERE regexp_matches(text, '!!!!|\\.\\.\\.\\.|----|====|____|\\*\\*\\*\\*|####|    ')")
def repeat_runs(spark, d):
    c = F.filter(T.repeated_runs(F.col("text")), lambda r: F.substring(r, 1, 1).isin("!", ".", "-", "=", "_", "*", "#", " "))
    return _t(spark, d, "documents").select("doc_id", F.size(c).alias("n_runs")).filter("n_runs > 0")


@_query("""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS i FROM documents),
g AS (SELECT doc_id, ch, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS run FROM c),
r AS (SELECT doc_id, ch, count(*) AS n FROM g WHERE ch <> chr(10) GROUP BY doc_id, ch, run HAVING count(*) >= 4)
SELECT doc_id, count(DISTINCT (ch, n))::INT AS n_runs FROM r GROUP BY doc_id""")
def repeat_runs_all(spark, d):
    """repeat_runs with runs of every character; its SQL finds them as islands, without references back."""
    return _t(spark, d, "documents").select("doc_id", F.size(T.repeated_runs(F.col("text"))).alias("n_runs")).filter("n_runs > 0")


@_query("SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS ch FROM documents) GROUP BY ch")
def unicode_histogram(spark, d):
    return extraction.unicode_histogram(_t(spark, d, "documents"))


@_query("SELECT doc_id, substr(sha256(text), 1, 16) AS text_digest, n_chars FROM documents")
def public_trace(spark, d):
    return io.public_view(_t(spark, d, "documents").select("doc_id", "text", "n_chars"), "text")


_TERMS = [("the",), ("of the",), ("license",), ("e.g.",), ("Zzzxq",)]


@_query("WITH v0 AS (SELECT * FROM " + _sql_values(_TERMS, "term") + f"""), d AS (SELECT doc_id, {_NORM.format(c='text')} AS w FROM documents)
SELECT term, count(d.doc_id) AS n_chunks FROM v0 LEFT JOIN d ON regexp_matches(d.w, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(lower(term)) || '($|[^\\p{{L}}\\p{{N}}_])') GROUP BY term""")
def term_occurrences(spark, d):
    return probes.term_occurrences(_t(spark, d, "documents"), _values(spark, _TERMS, "term string"))


_TERM, _STD, _CL, _CROSS_STD = probes.BASES
_PROBES = [("p1", _TERM, "Zzzxq", 0, None, None, None), ("p2", _TERM, "the", None, None, None, None), ("p3", _STD, None, None, None, ["src0"], None), ("p4", _STD, None, None, None, ["src99"], None), ("p5", _CL, None, None, None, ["src0"], "nowhere"), ("p6", _CROSS_STD, None, None, None, ["src0", "src1"], None), ("p7", _CROSS_STD, None, None, None, ["src0", "src0"], None), ("p8", _TERM, "Zzzxq", 3, None, None, None)]
_FAILED = {"p2": "term occurs in the corpus", "p3": "standard is indexed", "p7": "fewer than two standards", "p8": "stored occurrences differ"}


@_query("SELECT probe_id, basis, failures FROM " + _sql_values([(p[0], p[1], _FAILED.get(p[0], "")) for p in _PROBES], "probe_id, basis, failures"))
def probe_verify(spark, d):
    schema = "probe_id string, basis string, term string, occurrences long, of_chunks long, standards array<string>, clause string"
    out = probes.verify_probes(_values(spark, _PROBES, schema), _t(spark, d, "documents"), standard="source", clause="lang")
    return out.select("probe_id", "basis", F.array_join("failures", "; ").alias("failures"))


@_query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, t, unnest(generate_series(0, len(t) - 1, 224)) AS token_start FROM w WHERE len(t) > 0)
SELECT doc_id, token_start::INT AS token_start, least(token_start + 256, len(t))::INT AS token_end, t[token_start + 1] AS first_token FROM s""")
def fixed_windows(spark, d):
    tokens = _t(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("tokens"))
    return extraction.fixed_windows(tokens).select("doc_id", "token_start", "token_end", F.col("tokens")[0].alias("first_token"))


_CROSS = """WITH r AS (SELECT l.doc_id, CASE WHEN quality = 1 THEN 'answer' ELSE 'abstain' END AS expected, CASE WHEN n_chars < 300 THEN 'escalate' WHEN regexp_matches(text, '!!|%%%') THEN 'abstain' ELSE 'answer' END AS decision FROM labels l JOIN documents USING (doc_id))"""


def _routed_labels(spark, d):
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars", "text"), "doc_id")
    decision = F.when(F.col("n_chars") < 300, "escalate").when(F.col("text").rlike("!!|%%%"), "abstain").otherwise("answer")
    return rows.select("doc_id", F.when(F.col("quality") == 1, "answer").otherwise("abstain").alias("expected"), decision.alias("decision"), "quality", "n_chars")


@_query(_CROSS + "SELECT count(*) AS n, count(*) FILTER (decision = 'answer') AS n_answer, count(*) FILTER (decision = 'abstain') AS n_abstain, count(*) FILTER (decision = 'escalate') AS n_escalate, round(avg((decision = expected)::INT), 6) AS agreement, count(*) FILTER (expected = 'answer' AND decision <> 'answer') AS over_abstention FROM r")
def routing_metrics(spark, d):
    return evaluation.routing_metrics(_routed_labels(spark, d)).withColumn("agreement", F.round("agreement", 6))


@_query(_CROSS + """SELECT count(*) FILTER (expected = 'answer' AND decision = 'answer') AS answer_answer, count(*) FILTER (expected = 'abstain' AND decision = 'answer') AS abstain_answer, count(*) FILTER (expected = 'abstain' AND decision = 'abstain') AS abstain_abstain,
round(count(*) FILTER (expected = 'abstain' AND decision = 'abstain')::DOUBLE / count(*) FILTER (decision = 'abstain'), 6) AS abstention_precision, round(count(*) FILTER (expected = 'abstain' AND decision = 'answer')::DOUBLE / count(*) FILTER (expected = 'abstain'), 6) AS unsafe_answer_rate, NULL::DOUBLE AS escalation_recall FROM r""")
def selective_risk(spark, d):
    out = evaluation.selective_risk(_routed_labels(spark, d))
    return out.select("answer_answer", "abstain_answer", "abstain_abstain", F.round("abstention_precision", 6).alias("abstention_precision"), F.round("unsafe_answer_rate", 6).alias("unsafe_answer_rate"), "escalation_recall")


@_query("""WITH r AS (SELECT n_chars AS s, quality FROM labels JOIN documents USING (doc_id)) SELECT (SELECT count(*) FROM r WHERE quality = 1) AS n_pos, (SELECT count(*) FROM r WHERE quality = 0) AS n_neg,
round((SELECT avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END)::DOUBLE FROM r p, r n WHERE p.quality = 1 AND n.quality = 0), 6) AS auc""")
def auc_rank(spark, d):
    return evaluation.auc(_routed_labels(spark, d), "n_chars", "quality").withColumn("auc", F.round("auc", 6))


@_query("""SELECT threshold, quality, count(*) FILTER (n_chars < threshold) AS fired, count(n_chars) AS evaluable FROM labels JOIN documents USING (doc_id), (VALUES (100.0::DOUBLE), (500.0::DOUBLE), (2000.0::DOUBLE)) t(threshold) GROUP BY ALL""")
def threshold_sweep(spark, d):
    return evaluation.threshold_rates(_routed_labels(spark, d), "n_chars", "quality", [100, 500, 2000])


@_query("""WITH c AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (lang = 'en')::DOUBLE AS k FROM documents GROUP BY source HAVING count(*) >= 30), z AS (SELECT *, 1.959963984540054 AS z, k / n AS p FROM c)
SELECT source, round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS lo, round((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) AS hi FROM z""")
def wilson(spark, d):
    by = _t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("lang") == "en").cast("double").alias("k")).filter("n >= 30")
    lo, hi = evaluation.wilson_columns(F.col("k"), F.col("n"))
    return by.select("source", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@_query()
def clopper_pearson(spark, d):
    """Exact intervals of the share of long turns, by role; their bounds are tested against the binomial distribution."""
    by = _t(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") > 100).alias("hits"))
    return evaluation.exact_intervals(by)


@_query()
def exact_intervals(spark, d):
    by = _t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("hits"))
    return evaluation.exact_intervals(by)


@_query(_CROSS + "SELECT count(*) FILTER (decision = 'answer')::DOUBLE / count(*) AS coverage, count(*) FILTER (decision = 'abstain')::DOUBLE / count(*) AS abstention_rate, count(*) FILTER (decision = 'escalate')::DOUBLE / count(*) AS escalation_rate FROM r")
def routing_rates(spark, d):
    return evaluation.routing_rates(_routed_labels(spark, d)).select("coverage", "abstention_rate", "escalation_rate")


def _signals(spark, d):
    c = F.col("response")
    rows = _pairs(spark, d).select(F.concat_ws(":", "conv_id", "turn").alias("item_id"), "response", "context")
    return rows.select("item_id", F.lit(1).alias("n_records"), T.heading_like(F.col("context")).alias("all_headings"), c.isNotNull().alias("generated"), T.classify_response(c).alias("response_class"), F.lit(None).cast("boolean").alias("audit_passed"), F.lit(None).cast("boolean").alias("grounding_passed"), T.unexpected_script(c).alias("foreign"), T.repeated_runs(c).alias("runs"), T.overlap_ratio(c, F.col("context")).alias("echo_ratio"))


def _measured(spark, d):
    """Signals of all assistant turns, a first turn too, by the citation audit and grounding operators: the turn before is the one record that was retrieved."""
    c = _t(spark, d, "conversations")
    item = lambda turn: F.concat_ws(":", "conv_id", turn).alias("item_id")
    responses = c.filter("role = 'assistant'").select(item("turn"), F.col("text").alias("response"))
    null = F.lit(None).cast("string")
    ranked = c.select(item(F.col("turn") + 1), F.lit(1).alias("rank"), null.alias("standard"), null.alias("clause"), F.col("role").alias("label"), "text").join(responses.select("item_id"), "item_id", "left_semi")
    return answering.retrieval_signals(responses, ranked).join(answering.response_signals(responses, ranked), "item_id")


_FOUR = "|".join(c * 4 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789äöüßñéèêçóíáú !,;:-_#")  # RE2 has no references back
_ROUTE = f"""WITH {_PAIRS}, s AS (SELECT conv_id, turn, trim(context) = '' OR (NOT regexp_matches(trim(context), '[.;:?!]$') AND len(regexp_extract_all({_NORM.format(c='context')}, '[\\p{{L}}\\p{{N}}]+')) <= 12) AS head, len(regexp_extract_all(response, '\\p{{L}}\\p{{L}}+')) = 0 AS nothing, regexp_matches(response, '{_FOUR}') AS runs FROM p)"""


@_query(_ROUTE + "SELECT conv_id || ':' || turn AS item_id, CASE WHEN head OR nothing THEN 'abstain' WHEN runs THEN 'escalate' ELSE 'answer' END AS decision, CASE WHEN head THEN 'retrieval_normative' WHEN nothing THEN 'response_present' WHEN runs THEN 'no_degenerate_decoding' END AS triggering_gate FROM s")
def route_full(spark, d):
    return routing.evaluate_gates(_signals(spark, d), routing.default_gates()).select("item_id", "decision", "triggering_gate")


@_query(_ROUTE + "SELECT conv_id || ':' || turn AS item_id, CASE WHEN head THEN 'abstain' ELSE 'answer' END AS decision FROM s")
def route_pre(spark, d):
    return routing.evaluate_gates(_signals(spark, d), routing.default_gates(), stage="retrieval").select("item_id", "decision")


@_query(_ROUTE + "SELECT CASE WHEN head THEN 'retrieval_normative' WHEN nothing THEN 'response_present' WHEN runs THEN 'no_degenerate_decoding' ELSE 'none' END AS triggering_gate, count(*) AS n FROM s GROUP BY ALL")
def gate_histogram(spark, d):
    return evaluation.gate_histogram(routing.evaluate_gates(_signals(spark, d), routing.default_gates()))


@_query()
def route_measured(spark, d):
    """route_full with the signals that route_full leaves unmeasured."""
    return routing.evaluate_gates(_measured(spark, d), routing.default_gates()).select("item_id", "decision", "triggering_gate")


@_query()
def gate_histogram_measured(spark, d):
    return evaluation.gate_histogram(routing.evaluate_gates(_measured(spark, d), routing.default_gates()))


@_query()
def ablation_lattice(spark, d):
    gates = routing.default_gates()
    return routing.ablation_lattice(routing.evaluate_gates(_measured(spark, d), gates), gates)


@_query()
def gate_leave_one_out(spark, d):
    gates = routing.default_gates()
    return routing.gate_contributions(routing.evaluate_gates(_measured(spark, d), gates), gates)


def _decide_echo(v, t):
    return F.when(v.isNull(), "abstain").when(v < t, "answer").otherwise("escalate")


def _swept_all(spark, d):
    return routing.sweep(_pairs(spark, d).select(T.overlap_ratio(F.col("response"), F.col("context")).alias("echo")), "echo", _decide_echo, 0.85)


_SWEPT = f"""e AS (SELECT echo FROM (%s)),
pt AS (SELECT DISTINCT unnest([echo, echo + 1e-9::DOUBLE]) AS threshold FROM e UNION SELECT unnest([0::DOUBLE, 1, 0.85])),
bt AS (SELECT threshold, lag(threshold) OVER (ORDER BY threshold) AS before FROM pt),
sw AS (SELECT threshold, count(*) FILTER (echo < threshold) AS n_answer, count(*) FILTER (before IS NOT NULL AND (echo < threshold) <> (echo < before)) AS flips FROM bt LEFT JOIN e ON true GROUP BY threshold)"""
_ECHOES = _SQL["echo_ratio"].replace("round(coalesce(hit::DOUBLE / total, 0), 6) AS echo", "coalesce(hit::DOUBLE / total, 0) AS echo")


# Echo ratios of openings of documents with other words behind them, so that ratios of all sizes occur.
_OPENED = " and some more words that nobody has written there"
_GRAMS_A = "CASE WHEN len(wa) > 0 THEN list_distinct(list_transform(range(1, greatest(len(wa) - nn + 1, 1) + 1), lambda i: array_to_string(wa[i:i + nn - 1], ' '))) ELSE [] END"
_OPENED_SQL = f"""SELECT coalesce(len(list_intersect(ga, gc)) / nullif(len(ga), 0), 0) AS echo FROM (SELECT {_GRAMS_A} AS ga, {_GRAMS_A.replace('wa', 'wc')} AS gc FROM
(SELECT *, least(8, greatest(len(wa), 1)) AS nn FROM (SELECT regexp_extract_all({_NORM.format(c="(substr(text, 1, (60 + doc_id % 200)::INT) || '" + _OPENED + "')")}, '[\\p{{L}}\\p{{N}}]+') AS wa, regexp_extract_all({_NORM.format(c='text')}, '[\\p{{L}}\\p{{N}}]+') AS wc FROM documents)))"""


def _opened(spark, d):
    t = F.col("text")
    return routing.sweep(_t(spark, d, "documents").select(T.overlap_ratio(F.concat(F.substr(t, F.lit(1), (60 + F.col("doc_id") % 200).cast("int")), F.lit(_OPENED)), t).alias("echo")), "echo", _decide_echo, 0.85)


@_query(f"WITH {_SWEPT % _OPENED_SQL} SELECT threshold, n_answer, flips FROM sw")
def threshold_flips(spark, d):
    """Routing at every point where a decision turns, over echo ratios of openings of all documents."""
    return _opened(spark, d).select("threshold", "n_answer", "flips")


@_query(f"""WITH {_SWEPT % _OPENED_SQL}, lo AS (SELECT coalesce(max(threshold) FILTER (flips > 0), (SELECT min(threshold) FROM sw)) AS lo FROM sw WHERE threshold <= 0.85)
SELECT lo, (SELECT max(threshold) FROM sw WHERE threshold < coalesce((SELECT min(threshold) FROM sw WHERE threshold > 0.85 AND flips > 0), 'inf'::DOUBLE)) AS hi FROM lo""")
def stable_interval(spark, d):
    """The interval around the shipped threshold within which no decision turns, over the same ratios."""
    return routing.stable_interval(_opened(spark, d), 0.85)


@_query(f"WITH {_SWEPT % _ECHOES} SELECT threshold, n_answer, flips FROM sw")
def threshold_flips_all(spark, d):
    """threshold_flips over the echo ratios of all conversations."""
    return _swept_all(spark, d).select("threshold", "n_answer", "flips")


@_query(f"""WITH {_SWEPT % _ECHOES}, lo AS (SELECT coalesce(max(threshold) FILTER (flips > 0), (SELECT min(threshold) FROM sw)) AS lo FROM sw WHERE threshold <= 0.85)
SELECT lo, (SELECT max(threshold) FROM sw WHERE threshold < coalesce((SELECT min(threshold) FROM sw WHERE threshold > 0.85 AND flips > 0), 'inf'::DOUBLE)) AS hi FROM lo""")
def stable_interval_all(spark, d):
    return routing.stable_interval(_swept_all(spark, d), 0.85)


# Responses made from all documents, whole texts in them: a document's context is its own text and that of the document before it. Marks by id lead to every attribution.
def _cited(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    i, one, two = F.col("item_id"), F.substring("text", 1, 120), F.substring("text", 121, 120)
    some = lambda n, k, *parts: F.when(i % n == k, F.concat(*parts)).otherwise("")
    response = F.concat(
        F.lit("Intro. [1] "), one, some(3, 0, F.lit(" [2] "), two), some(5, 1, F.lit(" [1] short one")), some(4, 0, F.lit(" [9] "), one), F.lit(" [2] "), F.replace(two, F.lit(" "), F.lit(" qq ")),
        some(7, 2, F.lit(" [1] "), F.replace(one, F.lit(" "), F.lit(" 漢 "))), some(7, 3, F.lit(" [2] "), F.replace(one, F.lit(" "), F.lit(" 漢 "))), F.lit(" [1] "), F.col("text"),
    )
    context = docs.select("item_id", F.lit(1).alias("rank"), "text").unionByName(docs.select((i + 1).alias("item_id"), F.lit(2).alias("rank"), "text"))  # ranks of an id without a document meet no response
    return docs.select("item_id", response.alias("response")), context


_SQL_WORDS = "regexp_extract_all(" + _NORM.format(c="{c}") + ", '[\\p{{L}}\\p{{N}}]+')"
_SQL_GRAMS = "CASE WHEN len(w) > 0 THEN list_distinct(list_transform(range(1, greatest(len(w) - {n} + 1, 1) + 1), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) ELSE [] END"
_CITED_SQL = f"""rp AS (SELECT doc_id AS item_id, 'Intro. [1] ' || substr(text, 1, 120) || CASE WHEN doc_id % 3 = 0 THEN ' [2] ' || substr(text, 121, 120) ELSE '' END || CASE WHEN doc_id % 5 = 1 THEN ' [1] short one' ELSE '' END
  || CASE WHEN doc_id % 4 = 0 THEN ' [9] ' || substr(text, 1, 120) ELSE '' END || ' [2] ' || replace(substr(text, 121, 120), ' ', ' qq ') || CASE WHEN doc_id % 7 = 2 THEN ' [1] ' || replace(substr(text, 1, 120), ' ', ' 漢 ') ELSE '' END
  || CASE WHEN doc_id % 7 = 3 THEN ' [2] ' || replace(substr(text, 1, 120), ' ', ' 漢 ') ELSE '' END || ' [1] ' || text AS c FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
cx AS (SELECT doc_id AS item_id, 1 AS rank, text FROM documents UNION ALL SELECT doc_id + 1, 2, text FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents)),
mk AS (SELECT item_id, regexp_extract_all(c, '\\[(\\d{{1,2}})\\]', 1) AS r, regexp_extract_all(c, '\\[(\\d{{1,2}})\\]') AS m, string_split_regex(c, '\\[\\d{{1,2}}\\]') AS p FROM rp),
sg AS (SELECT item_id, k - 1 AS segment_no, r[k]::INT AS cited_rank, list_sum(list_transform(p[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: len(x))), 0) AS marker_start, trim(p[k + 1]) AS segment FROM (SELECT *, unnest(range(1, len(r) + 1)) AS k FROM mk)),
vr AS (SELECT *, false AS clean, segment AS t FROM sg UNION ALL SELECT *, true, regexp_replace(segment, '[一-鿿぀-ヿ가-힯Ѐ-ӿ؀-ۿ]', ' ', 'g') FROM sg WHERE regexp_matches(segment, '[一-鿿぀-ヿ가-힯Ѐ-ӿ؀-ۿ]')),
vw AS (SELECT *, {_SQL_WORDS.format(c='t')} AS w FROM vr),
vg AS (SELECT *, least(8, greatest(len(w), 1)) AS n, {_SQL_GRAMS.format(n='least(8, greatest(len(w), 1))')} AS g FROM vw),
cw AS (SELECT *, {_SQL_WORDS.format(c='text')} AS w FROM cx),
cg AS (SELECT item_id, rank, n, unnest({_SQL_GRAMS.format(n='n')}) AS gram FROM cw JOIN (SELECT DISTINCT item_id, n FROM vg) USING (item_id)),
ol AS (SELECT vu.item_id, segment_no, clean, rank, count(*) / any_value(size) AS o FROM (SELECT item_id, segment_no, clean, n, len(g) AS size, unnest(g) AS gram FROM vg) vu JOIN cg ON cg.item_id = vu.item_id AND cg.n = vu.n AND cg.gram = vu.gram GROUP BY ALL),
ag2 AS (SELECT item_id, segment_no, max(o) FILTER (NOT clean AND rank = cited_rank) AS cited_overlap, max(o) FILTER (NOT clean) AS best_overlap, arg_max(rank, (o, -rank)) FILTER (NOT clean) AS best_rank, max(o) FILTER (clean) AS clean_overlap FROM ol JOIN sg USING (item_id, segment_no) GROUP BY ALL),
au AS (SELECT sg.*, len({_SQL_WORDS.format(c='segment')}) AS n_words, coalesce(cited_overlap, 0) AS cited_overlap, coalesce(best_overlap, 0) AS best_overlap, best_rank, coalesce(clean_overlap, 0) AS clean_overlap, cited_rank BETWEEN 1 AND nr AS known
  FROM sg LEFT JOIN ag2 USING (item_id, segment_no) JOIN (SELECT item_id, count(*) AS nr FROM cx GROUP BY item_id) USING (item_id)),
att AS (SELECT *, CASE WHEN NOT known THEN 'unknown_rank' WHEN n_words < 6 THEN 'too_short' WHEN cited_overlap >= 0.5 THEN 'supported' WHEN best_overlap >= 0.5 AND best_rank <> cited_rank THEN 'misattributed' WHEN clean_overlap >= 0.5 THEN 'corrupted' ELSE 'unverified' END AS attribution FROM au)"""


@_query(f"WITH {_CITED_SQL} SELECT item_id, segment_no, cited_rank, marker_start::BIGINT AS marker_start, n_words, round(cited_overlap, 4) AS cited_overlap, best_rank, round(best_overlap, 4) AS best_overlap, attribution FROM att")
def citation_attribution(spark, d):
    """Attribution of every segment of responses made from all documents."""
    out = audit.audit_citations(*_cited(spark, d))
    return out.select("item_id", "segment_no", "cited_rank", "marker_start", "n_words", F.round("cited_overlap", 4).alias("cited_overlap"), "best_rank", F.round("best_overlap", 4).alias("best_overlap"), "attribution")


_FAILS = "attribution IN ('unknown_rank', 'misattributed', 'corrupted')"


@_query(f"""WITH {_CITED_SQL}, fs AS (SELECT item_id, cited_rank, min(segment_no) AS f, min(segment_no) FILTER (attribution = 'unknown_rank') AS u FROM att GROUP BY ALL)
SELECT item_id, string_agg(cited_rank, ',' ORDER BY f) AS cited_ranks, coalesce(string_agg(cited_rank, ',' ORDER BY u) FILTER (u IS NOT NULL), '') AS out_of_range, a.n_segments, a.n_failing, a.n_supported, a.n_misattributed, a.n_corrupted, a.n_unverified, a.passed FROM fs JOIN
(SELECT item_id, count(*) AS n_segments, count(*) FILTER ({_FAILS}) AS n_failing, count(*) FILTER (attribution = 'supported') AS n_supported, count(*) FILTER (attribution = 'misattributed') AS n_misattributed, count(*) FILTER (attribution = 'corrupted') AS n_corrupted, count(*) FILTER (attribution = 'unverified') AS n_unverified, NOT bool_or({_FAILS}) AS passed FROM att GROUP BY item_id) a USING (item_id) GROUP BY ALL""")
def citation_audit(spark, d):
    """The audits' rollups, a row a response."""
    responses, context = _cited(spark, d)
    out = audit.audit_summary(responses, audit.audit_citations(responses, context))
    return out.select("item_id", F.array_join("cited_ranks", ",").alias("cited_ranks"), F.array_join("out_of_range", ",").alias("out_of_range"), *[F.col(c).cast("long").alias(c) for c in ("n_segments", "n_failing", "n_supported", "n_misattributed", "n_corrupted", "n_unverified")], "passed")


# Responses made from all documents with references in front of and behind the whole texts; contexts and the corpus index go by ids, so that every way of resolving occurs.
_REFER = ("As SS {a} 2/{b} says, and 4/{c} too. See item no. 7/{d} of Shari'ah Standard No. (0{e}) and 8/8. ", " Then SS44 1/1, and para. 3/1/2/4/5 of 7/{b}")


def _referred(spark, d):
    i = F.col("doc_id")
    nth = {"a": 1 + i % 9, "b": 1 + i % 5, "c": 1 + i % 3, "d": 1 + i % 6, "e": i % 9}

    def spelt(t):
        out = F.lit(t)
        for k, v in nth.items():
            out = F.replace(out, F.lit("{" + k + "}"), v.cast("string"))
        return out

    docs = _t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    responses = docs.select(i.alias("item_id"), F.concat(spelt(_REFER[0]), "text", spelt(_REFER[1])).alias("response"))
    first = docs.select(i.alias("item_id"), spelt("SS{a}").alias("standard"), F.when(i % 2 == 0, spelt("2/{b}")).otherwise(spelt("2/{b}/1")).alias("clause"), "text")
    second = docs.filter(i % 3 == 0).select(i.alias("item_id"), F.lit(None).cast("string").alias("standard"), F.lit(None).cast("string").alias("clause"), spelt("quotes 4/{c} whole").alias("text"))
    index = docs.select(F.concat(F.lit("SS"), (1 + i % 7).cast("string")).alias("standard"), spelt("7/{d}/2").alias("path"))
    return responses, first.unionByName(second), index


_REF_RE, _PROSE_RE = (p.replace("'", "''") for p in (audit.REFERENCE, audit.STANDARD_PROSE))
_sql_refer = lambda t: "'" + t.replace("'", "''").replace("{a}", "' || 1 + doc_id % 9 || '").replace("{b}", "' || 1 + doc_id % 5 || '").replace("{c}", "' || 1 + doc_id % 3 || '").replace("{d}", "' || 1 + doc_id % 6 || '").replace("{e}", "' || doc_id % 9 || '") + "'"
_sql_refer = lambda t, f=_sql_refer: f(t).replace("|| 1 + doc_id", "|| (1 + doc_id").replace("|| doc_id", "|| (doc_id").replace(" % 9 ||", " % 9) ||").replace(" % 5 ||", " % 5) ||").replace(" % 3 ||", " % 3) ||").replace(" % 6 ||", " % 6) ||")
_REF_SQL = f"""dt AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
rs0 AS (SELECT doc_id AS item_id, {_sql_refer(_REFER[0])} || text || {_sql_refer(_REFER[1])} AS c FROM dt),
cx0 AS (SELECT doc_id AS item_id, {_sql_refer("SS{a}")} AS standard, CASE WHEN doc_id % 2 = 0 THEN {_sql_refer("2/{b}")} ELSE {_sql_refer("2/{b}/1")} END AS clause, text FROM dt UNION ALL SELECT doc_id, NULL, NULL, {_sql_refer("quotes 4/{c} whole")} FROM dt WHERE doc_id % 3 = 0),
ix AS (SELECT DISTINCT 'SS' || (1 + doc_id % 7) AS standard, unnest(['7', {_sql_refer("7/{d}")}, {_sql_refer("7/{d}/2")}]) AS path FROM dt),
mt AS (SELECT item_id, c, regexp_extract_all(c, '{_REF_RE}') AS m, regexp_extract_all(c, '{_REF_RE}', 1) AS own, regexp_extract_all(c, '{_REF_RE}', 2) AS path, string_split_regex(c, '{_REF_RE}') AS p FROM rs0),
rf AS (SELECT item_id, c, k - 1 AS ref_no, m[k] AS m, coalesce(own[k], '') AS own, path[k] AS path, (list_sum(list_transform(p[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: len(x))), 0))::BIGINT AS st FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM mt)),
bd AS (SELECT *, regexp_extract(substr(c, st + len(m) + 1, 48), '{_PROSE_RE}', 1) AS prose, regexp_extract(substr(c, greatest(st - 60, 0) + 1, least(st, 60)), '(?is)^.*\\bSS\\s?(\\d{{1,2}})\\b', 1) AS near FROM rf),
rb AS (SELECT item_id, ref_no, st + len(m) - len(path) AS char_offset, CASE WHEN own <> '' THEN 'SS' || regexp_replace(own, '\\D', '', 'g')::INT WHEN prose <> '' THEN 'SS' || prose::INT WHEN near <> '' THEN 'SS' || near::INT END AS standard, path FROM bd),
cl0 AS (SELECT item_id, standard AS cs, clause, text FROM cx0),
fg AS (SELECT item_id, ref_no, any_value(char_offset) AS char_offset, any_value(standard) AS standard, any_value(path) AS path,
  coalesce(bool_or(cs <> '' AND coalesce(rb.standard = cs, true) AND clause = path), false) AS exact, coalesce(bool_or(cs <> '' AND coalesce(rb.standard = cs, true) AND (clause = path OR starts_with(clause, path || '/'))), false) AS ancestor, coalesce(bool_or(contains(text, path)), false) AS verbatim
  FROM rb JOIN cl0 USING (item_id) GROUP BY item_id, ref_no),
gd AS (SELECT *, CASE WHEN exact THEN 'exact' WHEN ancestor THEN 'ancestor' WHEN verbatim THEN 'verbatim_in_context' END AS shown FROM fg),
gr0 AS (SELECT *, CASE WHEN shown IS NOT NULL THEN shown WHEN standard IS NOT NULL AND standard NOT IN (SELECT standard FROM ix) THEN 'standard_not_in_corpus' WHEN EXISTS (SELECT 1 FROM ix WHERE ix.path = gd.path AND coalesce(ix.standard = gd.standard, true)) THEN 'corpus_exact' ELSE 'no_match' END AS via FROM gd),
gs0 AS (SELECT item_id, char_offset, standard, path, true AS indexed, CASE WHEN shown IS NOT NULL THEN 'grounded_in_context' WHEN via = 'standard_not_in_corpus' THEN 'unknown_standard' WHEN via = 'corpus_exact' THEN 'outside_context' ELSE 'unresolvable' END AS status, via AS resolved_via FROM gr0
  UNION ALL SELECT item_id, char_offset, standard, path, false, CASE WHEN shown IS NOT NULL THEN 'grounded_in_context' ELSE 'outside_context' END, coalesce(shown, 'no_corpus_index') FROM gr0)"""


@_query(f"WITH {_REF_SQL} SELECT item_id, char_offset, standard, path, indexed, status, resolved_via FROM gs0")
def grounding_status(spark, d):
    """How every reference in responses made from all documents resolves, with the corpus index and without."""
    responses, context, index = _referred(spark, d)
    refs = stored(audit.clause_references(responses), "references")
    out = audit.ground(refs, context, index).withColumn("indexed", F.lit(True)).unionByName(audit.ground(refs, context).withColumn("indexed", F.lit(False)))
    return out.join(refs.select("item_id", "ref_no", F.col("char_offset").cast("long").alias("char_offset")), ["item_id", "ref_no"]).select("item_id", "char_offset", "standard", "path", "indexed", "status", "resolved_via")


@_query(f"""WITH {_REF_SQL} SELECT item_id, count(*) AS n_references, count(DISTINCT (coalesce(standard, ''), path)) AS n_distinct, count(*) FILTER (status = 'grounded_in_context') AS n_grounded_in_context, count(*) FILTER (status = 'outside_context') AS n_outside_context,
count(*) FILTER (status = 'unknown_standard') AS n_unknown_standard, count(*) FILTER (status = 'unresolvable') AS n_unresolvable, bool_and(status = 'grounded_in_context') AS passed FROM gs0 WHERE indexed GROUP BY item_id""")
def grounding_audit(spark, d):
    """The groundings' rollups, a row a response; the corpus index is a stored table in buckets."""
    responses, context, index = _referred(spark, d)
    name = f"clause_index_{uuid.uuid4().hex}"
    audit.write_clause_index(index, name, buckets=8, standard="standard", clause="path")
    grounded = audit.ground(audit.clause_references(responses), context, spark.table(name), stored=True)
    return audit.grounding_summary(responses, grounded)


# Pages made from all documents: a document is a page, its sentences are the lines, and marks by line number lead through every branch of the line grammar. Seven tenths of the pages are one standard's.
_FORMS = [  # before and after the sentence, by (line + doc_id) % 16; {a}, {b} count clauses
    ("{a}. ", ""), ("{a}/{b} ", ""), ("", ""), ("a) ", ""), ("(iv) ", " x-"), ("", " see clause"), ("{a}/{b} ", ""), ("", " [note"),
    ("{a}/{b}/2 ", ""), ("", " end] as said"), ("{a}/{b} , and ", ""), ("", " pro-"), ("b) ", ""), ("{a}/{b} ", ""), ("Shari'ah Standard No. (9) ", ""), ("7 ", ""),
]
_SENTENCE = r"[^A-Za-z0-9 ,;:()]+"


def _sql_form(side: int) -> str:
    spelt = lambda x: "'" + x.replace("'", "''").replace("{a}", "' || a || '").replace("{b}", "' || b || '") + "'"
    return "CASE (k + doc_id) % 16 " + " ".join(f"WHEN {i} THEN {spelt(f[side])}" for i, f in enumerate(_FORMS)) + " END"


_LINES_SQL = f"""sn AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS k, unnest(s) AS t FROM (SELECT doc_id, string_split(text, '. ') AS s FROM documents)),
nb AS (SELECT doc_id, k, regexp_replace(t, '{_SENTENCE}', ' ', 'g') AS t, (1 + doc_id % 9)::VARCHAR AS a, (1 + k % 7)::VARCHAR AS b, CASE WHEN doc_id % 10 < 7 THEN 1 ELSE doc_id % 10 END AS s FROM sn),
rl AS (SELECT 'SS' || s AS standard_id, doc_id AS page, k AS line_no, trim(regexp_replace(CASE
  WHEN doc_id < 10 AND k = 0 THEN 'Contents' WHEN doc_id < 10 THEN a || '. ' || t || ' .... 3' WHEN doc_id < 20 AND k = 0 THEN 'Statement of the Standard' WHEN doc_id < 20 AND k = 1 THEN a || '. And' WHEN doc_id % 40 = 29 AND k = 2 THEN '12'
  WHEN doc_id % 40 = 35 AND k = 1 THEN '1. Scope' WHEN s = 9 AND doc_id % 500 = 499 AND k = 3 THEN '3. Date of Issuance of the Standard' ELSE {_sql_form(0)} || t || {_sql_form(1)} END, '\\s+', ' ', 'g')) AS line FROM nb),
li AS (SELECT * FROM rl WHERE line <> '')"""


def _pages(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.split("text", r"\. ").alias("s"))
    i, k = F.col("doc_id"), F.col("k")
    rows = docs.select("doc_id", F.posexplode("s").alias("k", "t")).withColumn("t", F.regexp_replace("t", _SENTENCE, " "))
    a, b, s = (1 + i % 9).cast("string"), (1 + k % 7).cast("string"), F.when(i % 10 < 7, 1).otherwise((i % 10).cast("int"))

    def form(side):
        spelt = lambda x: F.replace(F.replace(F.lit(x), F.lit("{a}"), a), F.lit("{b}"), b)
        out = F.lit("")
        for n, f in enumerate(_FORMS):
            out = F.when((k + i) % 16 == n, spelt(f[side])).otherwise(out) if f[side] else out
        return out

    line = (
        F.when((i < 10) & (k == 0), "Contents").when(i < 10, F.concat(a, F.lit(". "), "t", F.lit(" .... 3"))).when((i < 20) & (k == 0), "Statement of the Standard").when((i < 20) & (k == 1), F.concat(a, F.lit(". And")))
        .when((i % 40 == 29) & (k == 2), "12").when((i % 40 == 35) & (k == 1), "1. Scope").when((s == 9) & (i % 500 == 499) & (k == 3), "3. Date of Issuance of the Standard").otherwise(F.concat(form(0), "t", form(1)))
    )
    lines = rows.select(F.concat(F.lit("SS"), s.cast("string")).alias("standard_id"), i.alias("page"), k, line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("standard_id", "page").agg(text.alias("text"))


_CLAUSE_SQL = {n: p.replace("'", "''") for n, p in {"section": extraction.SECTION, "clause": extraction.CLAUSE, "bullet": extraction.BULLET, "cue": extraction.CUE, "more": extraction.CONTINUATION, "back": extraction.BACK_MATTER, "header": extraction.HEADER}.items()}
_PARSE_SQL = f"""{_LINES_SQL},
tp AS (SELECT standard_id, page, count(*) FILTER (regexp_matches(line, '{_CLAUSE_SQL['section']}') AND NOT regexp_matches(line, '{_CLAUSE_SQL['clause']}')) AS n_entries FROM li GROUP BY ALL
  HAVING bool_or(lower(line) = 'contents') AND (bool_or(starts_with(lower(line), 'subject page')) OR count(*) FILTER (regexp_matches(line, '\\.{{3,}}\\s*\\d+\\s*$')) >= 2 OR n_entries >= 4)),
fl AS (SELECT li.*, tp.page IS NOT NULL AS toc, tp.page IS NULL AND regexp_extract(line, '{_CLAUSE_SQL['section']}', 1) = '1' AND NOT regexp_matches(line, '{_CLAUSE_SQL['clause']}') AS begins FROM li LEFT JOIN tp USING (standard_id, page)),
st AS (SELECT *, bool_or(begins) OVER w AS started, bool_or(NOT toc AND regexp_matches(line, '(?i)^Statement of the Standard$')) OVER w AS stated FROM fl WINDOW w AS (PARTITION BY standard_id ORDER BY page, line_no)),
ov AS (SELECT *, bool_or(started AND regexp_matches(line, '{_CLAUSE_SQL['back']}')) OVER (PARTITION BY standard_id ORDER BY page, line_no) AS over FROM st),
nl AS (SELECT standard_id, page, line_no, line FROM ov WHERE started AND NOT over AND NOT (regexp_matches(line, '{_CLAUSE_SQL['header']}') OR regexp_matches(line, '^\\d{{1,4}}$') OR line IN ('Statement of the Standard', 'Contents'))),
sm AS (SELECT *, sum(len(line) - len(replace(line, '[', '')) - len(line) + len(replace(line, ']', ''))) OVER (PARTITION BY standard_id ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, lag(line) OVER (PARTITION BY standard_id ORDER BY page, line_no) AS prev FROM nl),
dp AS (SELECT *, coalesce(s, 0) - min(coalesce(s, 0)) OVER (PARTITION BY standard_id ORDER BY page, line_no) AS depth, CASE WHEN regexp_matches(line, '{_CLAUSE_SQL['clause']}') THEN '{_CLAUSE_SQL['clause']}' WHEN regexp_matches(line, '{_CLAUSE_SQL['section']}') THEN '{_CLAUSE_SQL['section']}' END AS pat FROM sm),
cd AS (SELECT *, CASE WHEN pat = '{_CLAUSE_SQL['clause']}' THEN regexp_extract(line, '{_CLAUSE_SQL['clause']}', 1) WHEN pat IS NOT NULL THEN regexp_extract(line, '{_CLAUSE_SQL['section']}', 1) END AS candidate,
  CASE WHEN pat = '{_CLAUSE_SQL['clause']}' THEN regexp_extract(line, '{_CLAUSE_SQL['clause']}', 2) WHEN pat IS NOT NULL THEN regexp_extract(line, '{_CLAUSE_SQL['section']}', 2) END AS rest FROM dp),
rs AS (SELECT *, CASE WHEN candidate IS NULL THEN NULL WHEN depth > 0 THEN 'inside_unclosed_square_bracket' WHEN regexp_matches(coalesce(prev, ''), '{_CLAUSE_SQL['cue']}') THEN 'preceding_line_ends_with_citation_cue' WHEN regexp_matches(rest, '{_CLAUSE_SQL['more']}') THEN 'continuation_marker_after_identifier' END AS reason FROM cd),
cl AS (SELECT *, CASE WHEN reason IS NULL THEN candidate END AS own, last_value(CASE WHEN reason IS NULL THEN candidate END IGNORE NULLS) OVER (PARTITION BY standard_id ORDER BY page, line_no) AS clause_id FROM rs),
op AS (SELECT *, own IS NULL AND clause_id IS NOT NULL AND regexp_matches(line, '{_CLAUSE_SQL['bullet']}') AS bul FROM cl),
rn AS (SELECT *, sum((own IS NOT NULL OR bul)::INT) OVER (PARTITION BY standard_id ORDER BY page, line_no) AS record_no, CASE WHEN own IS NOT NULL THEN rest WHEN bul THEN regexp_extract(line, '{_CLAUSE_SQL['bullet']}', 2) ELSE line END AS part, CASE WHEN bul THEN regexp_extract(line, '{_CLAUSE_SQL['bullet']}', 1) END AS sub FROM op WHERE clause_id IS NOT NULL),
rc AS (SELECT standard_id, record_no, max(clause_id) AS clause_id, max(sub) AS sub_clause_id, min(page) AS source_page, trim(replace(regexp_replace(string_agg(part, chr(1) ORDER BY page, line_no), '-\\x01(\\p{{Ll}})', '\\1', 'g'), chr(1), ' ')) AS text FROM rn GROUP BY ALL),
re AS (SELECT standard_id, string_split(clause_id, '/')[1] AS section_id, clause_id, sub_clause_id, row_number() OVER (PARTITION BY standard_id, clause_id ORDER BY record_no) - 1 AS occurrence_index, source_page, text FROM rc WHERE text <> '')"""


def _lines(spark, d):
    return extraction.normalise_lines(_pages(spark, d))


@_query(f"WITH {_PARSE_SQL} SELECT standard_id, section_id, clause_id, sub_clause_id, occurrence_index, source_page, md5(text) AS text_md5 FROM re")
def clause_parse(spark, d):
    """Clause records of pages made from all documents."""
    return extraction.parse_clauses(_lines(spark, d)).select("standard_id", "section_id", "clause_id", "sub_clause_id", "occurrence_index", "source_page", F.md5("text").alias("text_md5"))


@_query(f"WITH {_PARSE_SQL} SELECT standard_id, page, line_no, candidate, reason FROM rs WHERE reason IS NOT NULL")
def wrapped_references(spark, d):
    return extraction.wrapped_references(_lines(spark, d))


@_query(f"WITH {_PARSE_SQL} SELECT standard_id, page, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM nl GROUP BY ALL")
def page_texts(spark, d):
    """Normative lines by page."""
    return extraction.page_texts(_lines(spark, d)).select("standard_id", "page", F.md5("text").alias("text_md5"))


@_query(f"""WITH {_PARSE_SQL}, gs AS (SELECT standard_id, arg_min(page, (page, line_no)) FILTER (started) AS start_page, arg_min(stated, (page, line_no)) FILTER (started) AS stated, min(page) FILTER (over) AS back_matter_page, count(DISTINCT page) FILTER (toc AND NOT started) AS n_toc_pages FROM ov GROUP BY standard_id),
gr AS (SELECT standard_id, count(*) AS n_records, count(sub_clause_id) AS n_sub_clauses, string_agg(DISTINCT section_id, ',' ORDER BY section_id) AS sections, bool_or(regexp_matches(text, '\\.{{3,}}\\s*\\d+\\s*$')) AS leaders, bool_or(regexp_matches(text, '{_CLAUSE_SQL['back']}')) AS back FROM re GROUP BY standard_id)
SELECT standard_id, start_page, CASE WHEN start_page IS NULL THEN NULL WHEN stated THEN 'statement_of_standard_then_section_1' ELSE 'section_1_fallback' END AS reason, back_matter_page, n_toc_pages, coalesce(n_records, 0) AS n_records, coalesce(n_sub_clauses, 0) AS n_sub_clauses, sections,
concat_ws(',', CASE WHEN start_page IS NULL THEN 'normative_body_start_not_detected' END, CASE WHEN leaders THEN 'toc_like_record_emitted' END, CASE WHEN back THEN 'back_matter_record_emitted' END) AS failures FROM gs LEFT JOIN gr USING (standard_id)""")
def extraction_report(spark, d):
    lines = stored(_lines(spark, d), "lines")
    out = extraction.extraction_report(lines, stored(extraction.parse_clauses(lines), "records"))
    return out.withColumns({"sections": F.array_join("sections", ","), "failures": F.array_join("failures", ",")})


@_query(f"""WITH {_PARSE_SQL}, su AS (SELECT 'SS' || nation.n_nationkey AS standard_id, n_name AS summary FROM nation WHERE n_nationkey < 9)
SELECT standard_id, 'clause:' || standard_id || ':' || clause_id || CASE WHEN coalesce(sub_clause_id, '') <> '' THEN ':' || sub_clause_id ELSE '' END || ':occurrence:' || occurrence_index AS chunk_id,
md5(coalesce(summary || chr(10), '') || trim(standard_id || ' section ' || section_id || ' clause ' || clause_id || ' ' || coalesce(sub_clause_id, '') || ' ' || text)) AS bm25_md5 FROM re LEFT JOIN su USING (standard_id)""")
def sac_enrich(spark, d):
    """Clause chunks with a summary in front, by standard; one standard has none."""
    names = _t(spark, d, "nation").filter("n_nationkey < 9").select(F.concat(F.lit("SS"), F.col("n_nationkey").cast("string")).alias("standard_id"), F.col("n_name").alias("summary"))
    return extraction.sac_enrich(extraction.clause_chunks(extraction.parse_clauses(_lines(spark, d))), names).select("standard_id", "chunk_id", F.md5("bm25_text").alias("bm25_md5"))


@_query(r"""SELECT doc_id, len(regexp_extract_all(text, '[^\s\x0B\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+'))::INT AS n_words, length(text) - length(replace(text, chr(65533), '')) AS n_replacement, regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS has_control FROM documents""")
def record_diagnostics(spark, d):
    docs = _t(spark, d, "documents")
    return extraction.record_diagnostics(docs.withColumnRenamed("doc_id", "section_id")).select(F.col("section_id").alias("doc_id"), "n_words", "n_replacement", "has_control")


@_query("SELECT 'U+' || printf('%04X', unicode(ch)) AS codepoint, CASE WHEN ch IN ('–', '‘', '’', '“', '”', '…') THEN 'typographic' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS ch FROM documents) WHERE unicode(ch) <> 65533 GROUP BY ALL")
def codepoint_histogram(spark, d):
    return extraction.codepoint_histogram(_t(spark, d, "documents"))


@_query(f"SELECT source, sum(len({_TOKENS.format(c='text')}))::BIGINT AS n_tokens, sum(len({_TOKENS.format(c='text')})) <= 8192 AS fits FROM documents GROUP BY source")
def token_fit(spark, d):
    return answering.token_fit(_t(spark, d, "documents"), by="source")


@_query(f"WITH r AS ({_SAID_SQL}), {_CLASSES_SQL} SELECT lang AS variant, count(*) AS n, count(*) FILTER (response_class = 'answered') AS n_answered, count(*) FILTER (response_class = 'abstained') AS n_abstained, avg((response_class IN ('answered', 'mixed'))::INT) AS answer_rate FROM rc0 GROUP BY lang")
def prompt_summary(spark, d):
    """Classes of the responses made from all documents, a language as a variant."""
    return answering.prompt_summary(_said(spark, d).withColumnRenamed("lang", "variant")).select("variant", "n", "n_answered", "n_abstained", "answer_rate")


@_query("SELECT role AS variant, count(*) AS n, count(*) FILTER (response_class = 'answered') AS n_answered, count(*) FILTER (response_class = 'abstained') AS n_abstained, avg((response_class IN ('answered', 'mixed'))::INT) AS answer_rate FROM (" + _SQL["response_checks_all"] + ") JOIN conversations USING (conv_id, turn) GROUP BY role")
def prompt_summary_all(spark, d):
    """prompt_summary over all turns of all conversations, a role as a variant."""
    return answering.prompt_summary(_t(spark, d, "conversations"), variant="role", text="text").select(F.col("role").alias("variant"), "n", "n_answered", "n_abstained", "answer_rate")


_ANCHORS, _SLASHED = _TOKENS.format(c="w"), "regexp_extract_all(w, '\\p{Nd}+(?:/\\p{Nd}+)+|[\\p{L}\\p{N}_]+(?:[''’][\\p{L}\\p{N}_]+)?')"


@_query(f"""WITH n AS (SELECT doc_id, {_NORM.format(c='text')} AS w FROM (SELECT doc_id, text || ' see ' || doc_id % 7 || '/' || doc_id % 5 || '.' AS text FROM documents)),
t AS (SELECT doc_id, list_distinct({_ANCHORS}) AS a, list_distinct({_SLASHED}) AS b FROM n),
x AS (SELECT doc_id, list_sort(list_filter(a, lambda v: NOT list_contains(b, v))) AS only_split, list_sort(list_filter(b, lambda v: NOT list_contains(a, v))) AS only_whole FROM t)
SELECT * FROM x WHERE len(only_split) > 0 OR len(only_whole) > 0""")
def tokeniser_diff(spark, d):
    """What the two token rules make of all documents with a reference behind each."""
    i = F.col("doc_id")
    return answering.tokeniser_diff(_t(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" see "), (i % 7).cast("string"), F.lit("/"), (i % 5).cast("string"), F.lit(".")).alias("text")))


@_query(f"""WITH n AS (SELECT doc_id, {_NORM.format(c='text')} AS w FROM documents),
t AS (SELECT doc_id, list_distinct({_ANCHORS}) AS a, list_distinct({_SLASHED}) AS b FROM n),
x AS (SELECT doc_id, list_sort(list_filter(a, lambda v: NOT list_contains(b, v))) AS only_split, list_sort(list_filter(b, lambda v: NOT list_contains(a, v))) AS only_whole FROM t)
SELECT * FROM x WHERE len(only_split) > 0 OR len(only_whole) > 0""")
def tokeniser_diff_all(spark, d):
    """tokeniser_diff over all documents."""
    return answering.tokeniser_diff(_t(spark, d, "documents"))


@_query(f"""WITH {_BM25}, l AS (SELECT item_id, rank, '[' || rank || '] ' || source || chr(10) || text AS b FROM top JOIN documents USING (doc_id)),
c AS (SELECT item_id, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS context FROM l GROUP BY item_id),
v AS (SELECT * FROM {_sql_values([(n, s.replace("{body}", "ACME").replace("{line}", T.ABSTENTION), t.split("{context}")[0], t.split("{context}")[1].split("{question}")[0], t.split("{question}")[1].replace("{line}", T.ABSTENTION)) for n, _, s, t in prompts.VARIANTS], "variant, system, a, b, c")})
SELECT c.item_id, variant, md5(system) AS system_md5, md5(a || context || v.b || q.text || v.c) AS prompt_md5 FROM c JOIN benchmark q USING (item_id) CROSS JOIN v""")
def prompt_variants(spark, d):
    ranked = _top(spark, d).join(_t(spark, d, "documents").select("doc_id", F.col("source").alias("label"), "text"), "doc_id")
    items = prompts.context_text(ranked).join(_t(spark, d, "benchmark").select("item_id", F.col("text").alias("question")), "item_id")
    return prompts.render(items, prompts.variants(spark, "ACME")).select("item_id", "variant", F.md5("system").alias("system_md5"), F.md5("user_prompt").alias("prompt_md5"))


_HEAD = "(trim(text) = '' OR (NOT regexp_matches(trim(text), '[.;:?!]$') AND len(regexp_extract_all(" + _NORM.format(c="text") + ", '[\\p{L}\\p{N}]+')) <= 12))"


def _retrieved(spark, d):
    return _top(spark, d).join(_t(spark, d, "documents").select("doc_id", F.col("source").alias("standard"), "text"), "doc_id")


@_query(f"""WITH {_BM25}, r AS (SELECT item_id, rank, source, {_HEAD} AS head FROM top JOIN documents USING (doc_id))
SELECT item_id, count(*) AS n_records, count(DISTINCT source)::INT AS n_standards, count(*) FILTER (head)::INT AS n_headings, bool_or(head AND rank = 1) AS heading_top_1, bool_and(head) AS all_headings FROM r GROUP BY item_id""")
def retrieval_signals(spark, d):
    out = answering.retrieval_signals(_t(spark, d, "benchmark"), _retrieved(spark, d))
    return out.select("item_id", "n_records", F.size("standards").alias("n_standards"), F.size("heading_ranks").alias("n_headings"), "heading_top_1", "all_headings")


@_query(f"""WITH {_BM25}, {_COVER},
h AS (SELECT item_id, bool_and({_HEAD}) AS all_headings FROM top JOIN documents USING (doc_id) GROUP BY item_id),
r AS (SELECT CASE WHEN b.item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS klass, CASE WHEN all_headings OR coalesce(got / total < 0.25, false) THEN 'abstain' ELSE 'answer' END AS decision FROM benchmark b JOIN h USING (item_id) LEFT JOIN ag USING (item_id))
SELECT klass, count(*) AS n, count(*) FILTER (decision = 'answer') AS n_answer, count(*) FILTER (decision = 'abstain') AS n_abstain, 0::BIGINT AS n_escalate FROM r GROUP BY klass""")
def blind_spot(spark, d):
    items, docs, ranked = _t(spark, d, "benchmark"), _t(spark, d, "documents"), _retrieved(spark, d)
    cover = anchoring.coverage(anchoring.anchors(items, anchoring.vocabulary(docs), docs.count()), ranked)
    labelled = items.select("item_id", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("klass"), F.lit("answer").alias("expected"))
    return answering.blind_spot_summary(answering.blind_spot(labelled, answering.retrieval_signals(items, ranked, coverage=cover), routing.default_gates(anchoring=0.25)))


# Items made from all documents, with a stored answer each: by id an answer fails one gate after the other, and one in twenty is the whole record.
_NORMATIVE = "The parties agree on all the terms before the contract begins."
_STORED = {3: T.ABSTENTION, 4: T.ABSTENTION + " then more words", 6: "[1] As SS44 1/1 says", 7: "[1] short 漢", 8: "[1] odd words !!!! here", 9: "[1] the answer says so in other words than the record"}
_RUN_SQL = f"""it0 AS (SELECT doc_id AS item_id, doc_id % 10 AS m, doc_id % 20 = 9 AS whole, coalesce(text, '') AS text FROM documents),
an AS (SELECT *, CASE WHEN whole THEN '[1]: ' || text WHEN m = 5 THEN '[9] ' || substr(text, 1, 60) {' '.join(f"WHEN m = {m} THEN '{t}'" for m, t in _STORED.items())} END AS c,
  '[1] SS' || (1 + item_id % 9) || ' §2/1' || chr(10) || text || chr(10) || chr(10) || '[2] SS1 §1' || chr(10) || '{_NORMATIVE}' AS cx FROM it0),
wd AS (SELECT item_id, {_SQL_WORDS.format(c='c')} AS w, {_SQL_WORDS.format(c='cx')} AS w2 FROM an WHERE whole),
ec AS (SELECT item_id, len(list_intersect(g, g2)) / len(g) AS echo FROM (SELECT item_id, {_SQL_GRAMS.format(n='least(8, len(w))')} AS g, {_SQL_GRAMS.format(n='least(8, n1)').replace('(w)', '(w2)').replace('w[', 'w2[')} AS g2 FROM (SELECT *, len(w) AS n1 FROM wd)) WHERE len(g) > 0),
ru AS (SELECT doc_id FROM ({_SQL['repeat_runs_all']})),
tg AS (SELECT item_id, c, CASE WHEN m = 0 THEN 'retrieval_non_empty' WHEN m = 1 THEN 'retrieval_normative' WHEN c IS NULL THEN 'response_present' WHEN m = 3 THEN 'model_did_not_abstain' WHEN m = 4 THEN 'no_self_contradiction' WHEN NOT regexp_matches(c, '\\p{{L}}{{2}}') THEN 'response_present'
  WHEN m = 5 THEN 'citation_integrity' WHEN m = 6 AND NOT contains(text, '1/1') THEN 'clause_grounding' WHEN m = 7 OR whole AND regexp_matches(c, '{T.FOREIGN}') THEN 'script_integrity' WHEN m = 8 OR whole AND item_id IN (FROM ru) THEN 'no_degenerate_decoding' WHEN whole AND echo >= 0.85 THEN 'substantive_answer' END AS gate, m
  FROM an LEFT JOIN ec USING (item_id))"""


@_query(f"""WITH {_RUN_SQL} SELECT item_id, CASE WHEN gate IS NULL THEN 'answer' WHEN gate IN ('retrieval_non_empty', 'retrieval_normative', 'response_present', 'model_did_not_abstain') THEN 'abstain' ELSE 'escalate' END AS decision, gate AS triggering_gate,
CASE WHEN gate IS NULL THEN md5(c) END AS served_md5, CASE WHEN m > 5 THEN 'c' || item_id ELSE '' END AS cited, m < 2 AS short_circuited, CASE WHEN m < 2 THEN 2 ELSE 6 END AS n_stages FROM tg""")
def answer_run(spark, d):
    """The whole run over items made from all documents: gates, prompts, stored answers, audits of whole texts, routing."""
    i = F.col("item_id")
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    records = docs.filter(i % 10 > 0).select(
        "item_id", F.lit(1).alias("rank"), F.concat(F.lit("c"), i.cast("string")).alias("chunk_id"), F.concat(F.lit("SS"), (1 + i % 9).cast("string")).alias("standard"), F.lit("2/1").alias("clause"),
        F.concat(F.lit("SS"), (1 + i % 9).cast("string"), F.lit(" §2/1")).alias("label"), F.when(i % 10 == 1, "Scope of the standard").otherwise(F.col("text")).alias("text"),
    )
    second = docs.filter(i % 10 > 1).select("item_id", F.lit(2).alias("rank"), F.lit("n").alias("chunk_id"), F.lit("SS1").alias("standard"), F.lit("1").alias("clause"), F.lit("SS1 §1").alias("label"), F.lit(_NORMATIVE).alias("text"))
    answer = F.when(i % 20 == 9, F.concat(F.lit("[1]: "), "text")).when(i % 10 == 5, F.concat(F.lit("[9] "), F.substring("text", 1, 60)))
    for m, t in _STORED.items():
        answer = answer.when(i % 10 == m, t)
    index = docs.select((F.concat(F.lit("SS"), (1 + i % 9).cast("string"))).alias("standard"), F.lit("2/1").alias("path")).distinct()
    items = docs.select("item_id", F.concat(F.lit("What does record "), i.cast("string"), F.lit(" say?")).alias("question"), F.lit(None).cast("string").alias("gold_answer"))
    out = answering.run(items, records.unionByName(second), answering.replay(docs.select("item_id", answer.alias("response"))), routing.default_gates(), prompts.variants(spark, "ACME", "v1"), index=index)
    return out.select("item_id", "decision", "triggering_gate", F.md5("served_answer").alias("served_md5"), F.array_join("cited_chunk_ids", ",").alias("cited"), "short_circuited", F.size("entered").alias("n_stages"))


@_query(f"""WITH {_BM25}, l AS (SELECT item_id, rank, '[' || rank || '] ' || source || chr(10) || text AS b FROM top JOIN documents USING (doc_id)),
c AS (SELECT item_id, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_records FROM l GROUP BY item_id)
SELECT c.item_id, n_records, md5('Excerpts:' || chr(10) || context || chr(10) || 'Question: ' || b.text) AS prompt_md5 FROM c JOIN benchmark b USING (item_id)""")
def prompt_render(spark, d):
    ranked = _top(spark, d).join(_t(spark, d, "documents").select("doc_id", F.col("source").alias("label"), "text"), "doc_id")
    items = prompts.context_text(ranked).join(_t(spark, d, "benchmark").select("item_id", F.col("text").alias("question")), "item_id").withColumn("gold_answer", F.lit(" "))
    variants = _values(spark, [("v1", prompts.SYSTEM, "Excerpts:\n{context}\nQuestion: {question}")], "variant string, system string, template string")
    return prompts.leak_guard(prompts.render(items, variants)).select("item_id", "n_records", F.md5("user_prompt").alias("prompt_md5"))


# Signals by arithmetic on ids, under which each of the 13 gates fails for some document, and the policy that turns all of them on.
_ALL_GATES = routing.Policy(enable_anchoring_gate=True, min_anchor_coverage=0.25, enable_reranker_top_1_gate=True, min_reranker_top_1=0.2, enable_reranker_margin_gate=True, min_reranker_margin=0.05)
_DECISIONS = ["abstain"] * 5 + ["escalate"] * 8
_GATE_NAMES = list(routing.BASIS)


def _gate_signals(spark, d):
    i = F.col("doc_id")
    mod = lambda n: F.pmod(i, F.lit(n))
    klass = F.when(mod(19) == 0, "empty").when(mod(19) == 1, "abstained").when(mod(19) == 2, "mixed").otherwise("answered")
    return _t(spark, d, "documents").select(
        i.alias("item_id"), mod(7).alias("n_records"), ((mod(11) == 0) & (mod(7) > 0)).alias("all_headings"), F.when(mod(5) != 0, mod(13) / 13.0).alias("idf_coverage"), (mod(17) != 0).alias("generated"), klass.alias("response_class"),
        F.when(mod(3) != 0, mod(23) != 1).alias("audit_passed"), (mod(29) != 2).alias("grounding_passed"), T.unexpected_script(F.concat("lang", F.when(mod(31) == 3, "漢").otherwise(""))).alias("foreign"),
        T.repeated_runs(F.concat(F.lit("x"), F.when(mod(37) == 4, "!!!!").otherwise(""))).alias("runs"), (mod(41) / 40.0).alias("echo_ratio"), (mod(43) / 43.0).alias("top_1"), F.when(mod(2) == 0, mod(47) / 47.0).alias("margin"),
        F.when(mod(6) < 4, "answer").otherwise("abstain").alias("expected"),
    )


def _sql_decide(mask: str, values=_DECISIONS, other: str = "'answer'") -> str:
    return "CASE " + " ".join(f"WHEN (({mask}) & {1 << i}) <> 0 THEN '{v}'" for i, v in enumerate(values)) + f" ELSE {other} END"


_GATES = """g0 AS (SELECT doc_id AS item_id, doc_id % 7 AS n, doc_id % 11 = 0 AS heads, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 13) / 13.0::DOUBLE END AS idfc, doc_id % 17 <> 0 AS gen, doc_id % 19 AS k, doc_id % 3 <> 0 AND doc_id % 23 = 1 AS badcite, doc_id % 29 = 2 AS badground,
  doc_id % 31 = 3 AS script, doc_id % 37 = 4 AS runs, (doc_id % 41) / 40.0::DOUBLE AS echo, (doc_id % 43) / 43.0::DOUBLE AS top, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 47) / 47.0::DOUBLE END AS margin, CASE WHEN doc_id % 6 < 4 THEN 'answer' ELSE 'abstain' END AS expected FROM documents),
g AS (SELECT *, k >= 2 AS attempt FROM g0),
m AS (SELECT *, (n = 0)::INT * 1 + (n > 0 AND heads)::INT * 2 + coalesce(idfc < 0.25, false)::INT * 4 + (NOT gen OR k = 0)::INT * 8 + (k = 1)::INT * 16 + (k = 2)::INT * 32 + (attempt AND badcite)::INT * 64 + (attempt AND badground)::INT * 128
  + script::INT * 256 + runs::INT * 512 + (attempt AND echo >= 0.85)::INT * 1024 + (top < 0.2)::INT * 2048 + coalesce(margin < 0.05, false)::INT * 4096 AS mask FROM g)"""


@_query(f"WITH {_GATES} SELECT item_id, mask, {_sql_decide('mask')} AS decision, {_sql_decide('mask', _GATE_NAMES, 'NULL')} AS triggering_gate, CASE WHEN mask = 0 THEN 'all 13 enabled gates passed' ELSE {_sql_decide('mask', _GATE_NAMES, 'NULL')} || ' failed' END AS cause FROM m")
def gates_route(spark, d):
    out = routing.evaluate_gates(_gate_signals(spark, d), _ALL_GATES.gates())
    return out.select("item_id", "mask", "decision", "triggering_gate", F.split(routing.rationale(_ALL_GATES.gates()), ";")[0].alias("cause"))


@_query(f"WITH {_GATES} SELECT item_id, {_sql_decide('mask & 6151')} AS decision FROM m")
def gates_route_pre(spark, d):
    return routing.evaluate_gates(_gate_signals(spark, d), _ALL_GATES.gates(), stage="retrieval").select("item_id", "decision")


@_query(f"WITH {_GATES} SELECT coalesce({_sql_decide('mask', _GATE_NAMES, 'NULL')}, 'none') AS triggering_gate, count(*) AS n FROM m GROUP BY ALL")
def gates_histogram(spark, d):
    return evaluation.gate_histogram(routing.evaluate_gates(_gate_signals(spark, d), _ALL_GATES.gates()))


_LESS = {"policy_version": "less", "_comment": "two gates off", "max_echo_ratio": 0.5, "enable_citation_gate": False, "enable_heading_only_gate": False}


@_query(f"WITH {_GATES} SELECT item_id, {_sql_decide('(mask & 952) + (n = 0)::INT + (attempt AND echo >= 0.5)::INT * 1024')} AS decision FROM m")
def policy_route(spark, d):
    """Routing by a policy's settings, as its file would have them."""
    return routing.evaluate_gates(_gate_signals(spark, d), routing.Policy.from_dict(_LESS).gates()).select("item_id", "decision")


_LATTICE = f"""{_GATES}, mm AS (SELECT mask, count(*) AS n, {_sql_decide('mask')} AS whole FROM m GROUP BY mask),
ss AS (SELECT unnest(generate_series(0, 8191)) AS subset),
ev AS (SELECT subset, mask, n, whole, {_sql_decide('mask & subset')} AS now FROM ss, mm),
la AS (SELECT subset::INT AS subset, bit_count(subset)::INT AS size, sum(CASE WHEN now = 'answer' THEN n ELSE 0 END)::BIGINT AS n_answer, sum(CASE WHEN now = 'abstain' THEN n ELSE 0 END)::BIGINT AS n_abstain,
  sum(CASE WHEN now = 'escalate' THEN n ELSE 0 END)::BIGINT AS n_escalate, bool_and(now = whole) AS same_as_full, string_agg(now, ',' ORDER BY mask) AS routing FROM ev GROUP BY subset)"""


@_query(f"WITH {_LATTICE} SELECT subset, size, n_answer, n_abstain, n_escalate, same_as_full FROM la")
def gates_lattice(spark, d):
    gates = _ALL_GATES.gates()
    return routing.ablation_lattice(routing.evaluate_gates(_gate_signals(spark, d), gates), gates).drop("routing")


_LEFT_OUT = "SELECT gate, sum(CASE WHEN mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS n_triggering, sum(CASE WHEN " + _sql_decide("mask & (8191 - bit)") + " <> whole THEN n ELSE 0 END)::BIGINT AS n_changed FROM mm, (SELECT * FROM " + _sql_values([(g, 1 << i) for i, g in enumerate(_GATE_NAMES)], "gate, bit") + ") GROUP BY gate"


@_query(f"WITH {_LATTICE} SELECT gate, n_triggering, n_changed, n_changed > 0 AS load_bearing FROM ({_LEFT_OUT})")
def gates_left_out(spark, d):
    gates = _ALL_GATES.gates()
    return routing.gate_contributions(routing.evaluate_gates(_gate_signals(spark, d), gates), gates).select("gate", "n_triggering", "n_changed", "load_bearing")


_SUBSET_NAMES = "concat_ws('+', " + ", ".join(f"CASE WHEN subset & {1 << i} <> 0 THEN '{g}' END" for i, g in enumerate(_GATE_NAMES)) + ")"


@_query(f"""WITH {_LATTICE}, lo AS ({_LEFT_OUT}), mi AS (SELECT min(size) AS size FROM la WHERE same_as_full)
SELECT (SELECT count(*) FROM la) AS n_subsets, (SELECT count(DISTINCT routing) FROM la) AS n_distinct_routings, (SELECT size FROM mi) AS minimal_sufficient_size,
(SELECT string_agg(x, ';' ORDER BY x) FROM (SELECT {_SUBSET_NAMES} AS x FROM la WHERE same_as_full AND size = (SELECT size FROM mi))) AS minimal_sufficient_subsets,
coalesce((SELECT string_agg(gate, ',' ORDER BY gate) FROM lo WHERE n_changed > 0), '') AS load_bearing_gates, coalesce((SELECT string_agg(gate, ',' ORDER BY gate) FROM lo WHERE n_changed = 0), '') AS unexercised_gates""")
def gates_lattice_summary(spark, d):
    gates = _ALL_GATES.gates()
    routed = routing.evaluate_gates(_gate_signals(spark, d), gates)
    out = routing.lattice_summary(routing.ablation_lattice(routed, gates), routing.gate_contributions(routed, gates), gates)
    return out.withColumns({"minimal_sufficient_subsets": F.array_join("minimal_sufficient_subsets", ";")} | {c: F.array_join(c, ",") for c in ("load_bearing_gates", "unexercised_gates")})


def _sql_points(value: str, bit: int, fails: str, shipped: float) -> str:
    off, on = _sql_decide(f"mask & {8191 - bit}"), _sql_decide(f"mask | {bit}")
    return f"""{_GATES}, it AS (SELECT item_id, {value} AS v, {off} AS passed, {on} AS failed FROM m),
pt AS (SELECT DISTINCT unnest([v, v + 1e-9::DOUBLE]) AS t FROM it WHERE v IS NOT NULL UNION SELECT unnest([0::DOUBLE, 1::DOUBLE, {shipped}::DOUBLE])),
lt AS (SELECT t, lag(t) OVER (ORDER BY t) AS before FROM pt),
dc AS (SELECT t, CASE WHEN v IS NOT NULL AND {fails.format(t='t')} THEN failed ELSE passed END AS now, CASE WHEN before IS NULL THEN NULL WHEN v IS NOT NULL AND {fails.format(t='before')} THEN failed ELSE passed END AS old FROM lt, it),
sw AS (SELECT t AS threshold, count(*) FILTER (now = 'answer') AS n_answer, count(*) FILTER (now = 'abstain') AS n_abstain, count(*) FILTER (now = 'escalate') AS n_escalate, count(*) FILTER (old IS NOT NULL AND now <> old) AS flips FROM dc GROUP BY t),
st AS (SELECT coalesce((SELECT max(threshold) FROM sw WHERE flips > 0 AND threshold <= {shipped}), (SELECT min(threshold) FROM sw)) AS lo, (SELECT max(threshold) FROM sw WHERE threshold < coalesce((SELECT min(threshold) FROM sw WHERE flips > 0 AND threshold > {shipped}), 'inf'::DOUBLE)) AS hi)"""


_ECHO_POINTS = _sql_points("CASE WHEN attempt THEN echo END", 1024, "v >= {t}", 0.85)
_ANCHOR_POINTS = _sql_points("idfc", 4, "v < {t}", 0.25)
_POINTS = "SELECT round(threshold, 10) AS threshold, n_answer, n_abstain, n_escalate, flips FROM sw"
_SENSITIVE = "SELECT '{name}' AS field_name, {shipped}::DOUBLE AS shipped_value, (SELECT count(*) FROM it) AS n_items, (SELECT count(v) FROM it) AS n_items_evaluable, (SELECT count(*) FILTER (flips > 0) + 1 FROM sw) AS n_distinct_routings, round(lo, 9) AS lo, round(hi, 9) AS hi, round(hi - lo, 9) AS width, (SELECT count(*) FILTER (flips > 0) > 0 FROM sw) AS decision_relevant FROM st"


def _points(spark, d, name):
    return routing.threshold_points(_gate_signals(spark, d), name, _ALL_GATES).withColumn("threshold", F.round("threshold", 10))


def _sensitivity(spark, d, name):
    out = routing.threshold_sensitivity(_gate_signals(spark, d), name, _ALL_GATES)
    return out.withColumns({c: F.round(c, 9) for c in ("lo", "hi", "width")})


@_query(f"WITH {_ECHO_POINTS} {_POINTS}")
def threshold_points_echo(spark, d):
    return _points(spark, d, "max_echo_ratio")


@_query(f"WITH {_ANCHOR_POINTS} {_POINTS}")
def threshold_points_anchor(spark, d):
    return _points(spark, d, "min_anchor_coverage")


@_query(f"WITH {_ECHO_POINTS} {_SENSITIVE.format(name='max_echo_ratio', shipped=0.85)}")
def threshold_sensitivity_echo(spark, d):
    return _sensitivity(spark, d, "max_echo_ratio")


@_query(f"WITH {_ANCHOR_POINTS} {_SENSITIVE.format(name='min_anchor_coverage', shipped=0.25)}")
def threshold_sensitivity_anchor(spark, d):
    return _sensitivity(spark, d, "min_anchor_coverage")


@_query(f"WITH {_ANCHOR_POINTS} SELECT item_id, round(v, 10) AS threshold_below, round(v + 1e-9, 10) AS threshold_at_or_above, passed AS decision_below, failed AS decision_at_or_above FROM it WHERE v IS NOT NULL AND passed <> failed")
def threshold_item_flips(spark, d):
    out = routing.threshold_flips(_gate_signals(spark, d), "min_anchor_coverage", _ALL_GATES)
    return out.withColumns({c: F.round(c, 10) for c in ("threshold_below", "threshold_at_or_above")})


_FULL_WIDTH = str.maketrans({c: chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"})


@_query(f"SELECT doc_id, md5({_NORM.format(c='text')}) AS wide_md5, md5({_NORM.format(c='text')}) AS split_md5 FROM documents")
def match_forms(spark, d):
    """Texts in full-width forms with ligatures, and with letters and marks apart, normalise as the texts themselves do."""
    plain = "".join(map(chr, _FULL_WIDTH))
    wide = F.translate(F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("ffl"), F.lit("ﬄ")), plain, plain.translate(_FULL_WIDTH))
    apart = F.col("text")
    for c in "äöüÄÖÜéèêñÉÈÊÑçÇáíóúÁÍÓÚ":
        apart = F.replace(apart, F.lit(c), F.lit(unicodedata.normalize("NFD", c)))
    return _t(spark, d, "documents").select("doc_id", F.md5(T.normalise(wide)).alias("wide_md5"), F.md5(T.normalise(apart)).alias("split_md5"))


_META = f"""{_COVER},
mt AS (SELECT top.item_id, unnest(list_concat({_TOKENS.format(c="lower(source)")}, {_TOKENS.format(c="lower(lang)")})) AS tok FROM top JOIN documents USING (doc_id)),
cm AS (SELECT * FROM cx UNION SELECT DISTINCT item_id, {_SUFFIX.format(c='tok')} AS anchor FROM mt),
am AS (SELECT an.item_id, count(*) AS n_anchors, count(cm.anchor) AS n_covered, count(*) FILTER (oov) AS n_oov, max(idf) FILTER (cm.anchor IS NULL) AS worst, string_agg(an.anchor, ',' ORDER BY an.anchor) FILTER (cm.anchor IS NULL) AS missing, string_agg(an.anchor, ',' ORDER BY an.anchor) FILTER (oov) AS oovs
       FROM an LEFT JOIN cm ON cm.item_id = an.item_id AND cm.anchor = an.anchor GROUP BY an.item_id)"""


@_query(f"""WITH {_BM25}, {_META}
SELECT b.item_id, coalesce(n_anchors, 0) AS n_anchors, coalesce(n_covered, 0) AS n_covered, coalesce(n_oov, 0) AS n_oov, round(n_oov::DOUBLE / n_anchors, 6) AS oov_ratio, round(worst, 6) AS max_uncovered_idf, coalesce(missing, '') AS uncovered, coalesce(oovs, '') AS oov, len({_TOKENS.format(c=_NORM.format(c='b.text'))})::INT AS n_query_tokens
FROM benchmark b LEFT JOIN am USING (item_id)""")
def anchor_signal(spark, d):
    """Anchors against texts and the two provenance columns that stand above each excerpt."""
    docs, items = _t(spark, d, "documents"), _t(spark, d, "benchmark")
    contexts = _top(spark, d).select("item_id", "doc_id").join(docs.select("doc_id", "text", "source", "lang"), "doc_id")
    out = anchoring.anchoring_signal(items, anchoring.vocabulary(docs), docs.count(), contexts, anchoring.AnchorSpec(context_metadata_keys=("source", "lang", "not_there")))
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select("item_id", "n_anchors", "n_covered", "n_oov", F.round("oov_ratio", 6).alias("oov_ratio"), F.round("max_uncovered_idf", 6).alias("max_uncovered_idf"), listed("uncovered_anchors").alias("uncovered"), listed("oov_anchors").alias("oov"), "n_query_tokens")


@_query("""SELECT doc_id, source AS standard_id, lang AS clause_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (doc_id % 4)::INT END AS occurrence_index, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'a)' ELSE source END AS sub_clause_id FROM documents""")
def clause_keys(spark, d):
    i = F.col("doc_id")
    sub = F.when(i % 4 == 0, None).when(i % 4 == 1, " \t").when(i % 4 == 2, " a)  ").otherwise(F.col("source"))
    key = evaluation.clause_key(F.col("source"), F.col("lang"), F.when(i % 3 != 0, i % 4), sub)
    return _t(spark, d, "documents").select("doc_id", key.alias("k")).select("doc_id", "k.*")


_CONFIGS = f"""{_BM25}, r20 AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM al),
rr AS (SELECT r20.item_id, r20.doc_id, row_number() OVER (PARTITION BY r20.item_id ORDER BY score / nullif(dl, 0) DESC NULLS LAST, r) AS rank FROM r20 JOIN dl ON dl.doc_id = r20.doc_id WHERE r <= 20),
cf AS (SELECT 'bm25' AS config, item_id, doc_id, rank FROM top UNION ALL SELECT 'bm25_rerank', item_id, doc_id, rank FROM rr WHERE rank <= 5)"""


def _configs(spark, d):
    """Both configurations read one stored ranking, as deep as the deeper of them asks."""
    docs, items = _t(spark, d, "documents"), _t(spark, d, "benchmark")
    bm25 = retrieval.StoredRetriever(stored(retrieval.Bm25Retriever(docs).retrieve(items, 20), "ranked"))
    model = lambda hits: retrieval.doc_stats(hits.join(docs.select("doc_id", "text"), "doc_id"), keep=hits.columns).withColumn("model", F.try_divide("score", "dl"))
    return retrieval.retrieve_all({"bm25": bm25, "bm25_rerank": retrieval.RerankedRetriever(bm25, model, 20)}, items, 5)


@_query(f"""WITH {_CONFIGS}, {_GOLD.split(chr(10) + 'ev AS')[0].rstrip(',')},
ec AS (SELECT k.config, g.item_id, count(*) AS n_gold, count(t.rank) AS n_hits FROM gold g CROSS JOIN (SELECT DISTINCT config FROM cf) k LEFT JOIN cf t ON t.config = k.config AND t.item_id = g.item_id AND t.doc_id = g.doc_id GROUP BY ALL)
SELECT config, count(*) AS n_items, sum(n_hits)::BIGINT AS hits, sum(n_gold)::BIGINT AS gold, round(avg(n_hits / n_gold::DOUBLE), 6) AS macro_recall, round(sum(n_hits)::DOUBLE / sum(n_gold), 6) AS micro_recall FROM ec GROUP BY config""")
def config_ablation(spark, d):
    """Recall of two retrieval configurations of one interface, a row each."""
    out = evaluation.ablation_table(_gold(spark, d), _configs(spark, d), ["doc_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("macro_recall", "micro_recall")})


@_query(f"WITH {_BM25} SELECT item_id, count(*) AS size, string_agg(doc_id, ',' ORDER BY rank) AS chunk_ids FROM top GROUP BY item_id")
def retrieval_result(spark, d):
    out = retrieval.retrieval_result(_top(spark, d), policy={"index": "documents", "k": 5})
    return out.select("item_id", "size", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunk_ids"))


@_query(f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM top")
def stored_index_topk(spark, d):
    """bm25_topk over an index that is written and read back."""
    path = scratch(spark, "index")
    io.write_index(_t(spark, d, "documents"), path)
    out = retrieval.Bm25Retriever(index=io.read_index(spark, path)).retrieve(_t(spark, d, "benchmark"), 5)
    return out.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@_query("""WITH el AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM el GROUP BY vec_id)
SELECT vec_id, round(x / norm, 6) AS first_component, CASE WHEN label % 2 = 0 THEN 1 ELSE 2 END AS n_metadata, label::VARCHAR AS label, (SELECT count(*) FROM embeddings) AS stored FROM el JOIN n USING (vec_id) WHERE i = 1""")
def vector_store(spark, d):
    path = scratch(spark, "vectors")
    rows = _t(spark, d, "embeddings").withColumn("odd", F.when(F.col("label") % 2 != 0, "odd"))
    stored = io.write_vectors(rows, path, metadata=("label", "odd"))
    out = io.read_vectors(spark, path, stored)
    return out.select("vec_id", F.round(F.col("embedding")[0], 6).alias("first_component"), F.size("metadata").alias("n_metadata"), F.col("metadata")["label"].alias("label"), F.lit(stored).cast("long").alias("stored"))


@_query("SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark, d):
    docs, path = _t(spark, d, "documents"), scratch(spark, "jsonl")
    io.assert_unique(docs, "doc_id")
    io.write_jsonl(docs, path)
    return io.read_jsonl(spark, path, docs.schema, ("doc_id", "text")).select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@_query("""SELECT item_id::VARCHAR AS item_id, md5(text) AS question_md5, 'answer' AS expected_behavior, 'answerable_hard_set' AS klass, '' AS basis FROM benchmark
UNION ALL SELECT 'p' || doc_id, md5(lang), 'abstain', 'unanswerable_probe', 'term_absent_from_corpus' FROM documents""")
def mixed_items(spark, d):
    none = F.lit(None).cast("string")
    hard = _t(spark, d, "benchmark").select("item_id", F.col("text").alias("question_text"), F.lit("answer").alias("expected_behavior"), none.alias("answerability"), none.alias("verification_basis"))
    asked = _t(spark, d, "documents").select(F.concat(F.lit("p"), "doc_id").alias("probe_id"), F.col("lang").alias("question_text"), F.lit("abstain").alias("expected_behavior"), F.lit("term_absent_from_corpus").alias("basis"), none.alias("verification_basis"))
    return evaluation.mixed_items(hard, asked).select("item_id", F.md5("question_text").alias("question_md5"), "expected_behavior", "klass", "basis")


@_query("""SELECT doc_id AS item_id, CASE WHEN doc_id % 2 = 0 THEN 'answer' ELSE 'abstain' END AS expected, CASE WHEN doc_id % 3 = 0 THEN 'escalate' WHEN doc_id % 5 = 0 THEN 'abstain' ELSE 'answer' END AS decision, CASE WHEN doc_id % 7 = 0 THEN source END AS gate FROM documents""")
def scored_results(spark, d):
    i = F.col("doc_id")
    stage = lambda name, detail: F.struct(F.lit(name).alias("stage"), detail.alias("detail"))
    told = F.concat(F.lit("decision=x gate="), F.when(i % 7 == 0, F.col("source")).otherwise("None"), F.lit(" seconds=1"))
    rows = _t(spark, d, "documents").select(
        i.alias("item_id"), F.when(i % 3 == 0, "escalate").when(i % 3 == 1, "").alias("decision"), F.when(i % 5 == 0, "abstained").when(i % 5 == 1, "done").alias("status"),
        F.array(stage("signals", F.lit("gate=wrong")), stage("route", told), stage("route", F.lit("no gate"))).alias("stages"), F.when(i % 2 == 0, "answer").otherwise("abstain").alias("expected_behavior"),
    )
    return evaluation.scored_results(rows, rows)


_NAMES = [(f"U+{i:04X}", unicodedata.name(chr(i))) for i in (*range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x2050), 0x20AC, 0x2122, 0xFFFD) if unicodedata.name(chr(i), "")]


@_query("SELECT codepoint, name, n FROM (" + _SQL["codepoint_histogram"] + ") JOIN (SELECT * FROM " + _sql_values(_NAMES, "codepoint, name") + ") USING (codepoint)")
def codepoint_names(spark, d):
    """Names of the characters that the test tables hold; SQL has those of Latin letters and general punctuation."""
    return extraction.codepoint_names(extraction.codepoint_histogram(_t(spark, d, "documents"))).select("codepoint", "name", "n")


@_query("SELECT n_nationkey::BIGINT AS page, n_name || chr(10) || n_name AS text FROM nation")
def page_glyphs(spark, d):
    """Names set twice in bold print, in two lines, read back from their glyphs."""
    chars = F.regexp_extract_all("n_name", F.lit("(?s)."), F.lit(0))
    line = lambda top, first: F.transform(chars, lambda c, i: F.struct(c.alias("char"), (i * 6.0).alias("x0"), (i * 6.0 + 5).alias("x1"), F.lit(top).alias("top"), (i + first).alias("seq")))
    bold = lambda xs, shift: F.transform(xs, lambda g: F.struct(g["char"].alias("char"), (g["x0"] + 0.4).alias("x0"), (g["x1"] + 0.4).alias("x1"), (g["top"] + 0.3).alias("top"), (g["seq"] + shift).alias("seq")))
    every = F.concat(line(100.0, 0), bold(line(100.0, 0), 10_000), line(112.0, 500), bold(line(112.0, 500), 20_000))
    glyphs = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("page"), F.inline(every)).withColumns({"font": F.lit("f"), "size": F.lit(10.0)})
    return extraction.page_text(extraction.dedupe_glyphs(glyphs))


@_query("SELECT count(*) AS n, count(*) FILTER (decision = 'answer') AS n_answer, round(avg((decision = expected)::INT), 6) AS agreement, count(*) FILTER (expected = 'answer' AND decision <> 'answer') AS over_abstention FROM (" + _CROSS + "SELECT * FROM r)")
def trace_metrics(spark, d):
    traces = _routed_labels(spark, d).select("decision", F.struct(F.col("expected").alias("expected_behavior")).alias("evaluation"))
    return evaluation.metrics_from_traces(traces).select("n", "n_answer", F.round("agreement", 6).alias("agreement"), "over_abstention")


@_query("SELECT doc_id AS item_id, decision, expected AS expected_behavior, decision = expected AS matches_expected, doc_id % 2 = 0 AS scholar_validated FROM (" + _CROSS + "SELECT * FROM r)")
def evaluation_labels(spark, d):
    rows = _routed_labels(spark, d).withColumnRenamed("doc_id", "item_id")
    items = rows.select("item_id", F.col("expected").alias("expected_behavior"), F.when(F.col("item_id") % 2 == 0, "qualified_scholar_review").alias("verification_basis"))
    return evaluation.evaluation_labels(items, rows).select("item_id", "decision", "expected_behavior", "matches_expected", "scholar_validated")


@_query("""WITH c AS (SELECT doc_id, quality, s.spec, CASE WHEN doc_id % s.m = 0 THEN NULL ELSE (n_chars % (s.m * 10)) / (s.m * 10)::DOUBLE END AS cov FROM labels JOIN documents USING (doc_id), (VALUES ('a', 3), ('b', 7)) s(spec, m))
SELECT spec, threshold, quality AS label, count(*) FILTER (cov < threshold) AS fired, count(cov) AS evaluable, round(count(*) FILTER (cov < threshold)::DOUBLE / nullif(count(cov), 0), 6) AS rate FROM c, (VALUES (0.1::DOUBLE), (0.5::DOUBLE)) t(threshold) GROUP BY ALL""")
def calibration_rates(spark, d):
    specs = _values(spark, [("a", 3), ("b", 7)], "spec string, m int")
    rows = _routed_labels(spark, d).crossJoin(F.broadcast(specs))
    rows = rows.select("spec", F.col("quality").alias("label"), F.when(F.col("doc_id") % F.col("m") != 0, (F.col("n_chars") % (F.col("m") * 10)) / (F.col("m") * 10).cast("double")).alias("idf_coverage"))
    return answering.calibrate(rows, [0.1, 0.5])[0].withColumn("rate", F.round("rate", 6))


@_query("""SELECT conv_id, turn, position('i cannot answer from the given context' IN lower(text)) > 0 AS contains_abstention, length(text)::INT AS response_length, starts_with(trim(text), '[') AS has_citations FROM conversations""")
def abstention_triggers(spark, d):
    rows = _t(spark, d, "conversations").withColumn("variant", F.lit("v1"))
    return answering.abstention_triggers(rows, text="text").select("conv_id", "turn", "contains_abstention", "response_length", "has_citations")


@_query(f"""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM documents), s AS (SELECT doc_id, n, unnest(generate_series(0, n - 1, 224)) AS a FROM w WHERE n > 0), p AS (SELECT doc_id, n, unnest(generate_series(0, n - 1, 100)) AS b FROM w WHERE n > 0)
SELECT s.doc_id, a::INT AS token_start, string_agg(b // 100 + 1, ',' ORDER BY b) AS pages FROM s JOIN p USING (doc_id) WHERE a < least(b + 100, s.n) AND b < least(a + 256, s.n) GROUP BY ALL""")
def page_spans(spark, d):
    """Windows with the pages that they meet, a page being 100 words."""
    tokens = _t(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("tokens"))
    n = F.size("tokens")
    pages = tokens.filter(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(100))).alias("page_start"))
    pages = pages.select("doc_id", (F.floor(F.col("page_start") / 100) + 1).cast("int").alias("page"), "page_start", F.least(F.col("page_start") + 100, F.col("n")).alias("page_end"))
    out = extraction.page_spans(extraction.fixed_windows(tokens), pages)
    return out.select("doc_id", "token_start", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@_query("SELECT source, lang, count(*) AS n_chunks FROM documents GROUP BY ALL")
def corpus_clauses(spark, d):
    docs = _t(spark, d, "documents")
    own = probes.corpus_clauses(docs, standard="source", clause="lang").join(probes.corpus_standards(docs, standard="source"), "standard")
    return own.join(probes.single_standard(docs, standard="source"), [F.col("standard") == F.col("source"), F.col("clause") == F.col("lang")]).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_chunks"))


@_query(r"""WITH t AS (SELECT doc_id, source, lang, text, '**' || lang || '** ' || source AS s FROM documents)
SELECT doc_id, source || ' §' || lang || ' occ=0 page=? id=' || doc_id AS label, lang || ' ' || source AS cleaned, length(s) >= 20 AS valid, CASE WHEN length(trim(s)) < 20 THEN 'too_short:' || length(trim(s)) || '_chars' ELSE '' END AS issues, substr(sha256(text), 1, 16) AS digest, position(lower(source) IN lower(source || lang)) > 0 AS held FROM t""")
def text_scalars(spark, d):
    c, none = F.concat(F.lit("**"), "lang", F.lit("** "), "source"), F.lit(None).cast("string")
    label = T.clause_label(F.col("source"), F.col("lang"), none, none.cast("int"), none, F.col("doc_id").cast("string"))
    return _t(spark, d, "documents").select("doc_id", label.alias("label"), T.clean_summary(c).alias("cleaned"), T.summary_valid(c).alias("valid"), F.array_join(T.summary_issues(c), ",").alias("issues"), T.text_digest(F.col("text")).alias("digest"), T.contains_normalised(F.concat("source", "lang"), F.col("source")).alias("held"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

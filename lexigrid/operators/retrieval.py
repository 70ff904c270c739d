"""Retrieval: an inverted index as tables, BM25, exact dense search, hybrid merge, reranking signals."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexigrid.functions import text as T
from lexigrid.sources.scratch import ship, stored

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows that are broadcast at most; more are cut into blocks or joined by a shuffle.
BROADCAST = 1_000_000


def postings(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """term, id, tf: one row for each term of a document."""
    return docs.select(F.col(id), F.explode(T.bm25_tokens(F.col(text))).alias("term")).groupBy("term", id).agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id (or the columns of keep) and dl, the number of tokens."""
    return docs.select(*(keep or [id]), F.size(T.bm25_tokens(F.col(text))).cast("long").alias("dl"))


def term_df(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """term, df: a document's terms are made distinct in its row, so that only partial counts are shuffled."""
    return docs.select(F.explode(F.array_distinct(T.bm25_tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf_of(df: DataFrame, n_docs: int) -> DataFrame:
    """term, df, idf; a negative idf becomes EPSILON of the mean over all terms."""
    raw = df.withColumn("raw", F.log(n_docs - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))


def term_idf(posts: DataFrame, n_docs: int) -> DataFrame:
    """idf_of the postings' terms."""
    return idf_of(posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n_docs)


def _asked(queries: DataFrame, query_id: str, query: str) -> DataFrame:
    return queries.select(F.col(query_id), F.explode(T.bm25_tokens(F.col(query))).alias("term")).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 5, *, id: str = "doc_id", text: str = "text", query_id: str = "item_id", query: str = "text") -> DataFrame:
    """query_id, id, score, rank: the k best of all documents for each query; ties by id; documents without a shared term score 0 and fill up.

    One pass counts terms and lengths. Another deals texts by id, so that a document is cut, meets the queries' terms and is scored in one
    task: neither postings nor hits are shuffled, a frequent term is no key, and a task leaves its k best of each query. Only the 2k first
    documents can be needed to fill up."""
    # a document gives its distinct terms and, under the empty term that no text has, its length
    counted = T.let(T.bm25_tokens(F.col(text)), lambda t: F.array_append(F.transform(F.array_distinct(t), lambda x: F.struct(x.alias("term"), F.lit(0).alias("dl"))), F.struct(F.lit("").alias("term"), F.size(t).alias("dl"))))
    terms = docs.select(F.explode(counted).alias("c")).groupBy("c.term").agg(F.count(F.lit(1)).alias("df"), F.sum("c.dl").alias("dl"))
    terms = stored(terms, "terms")
    told = terms.filter("term = ''").select("df", "dl").first()
    n, length = told or (0, 0)
    idf = idf_of(terms.filter("term <> ''").select("term", "df"), n)
    first = _first(docs, k, id)
    dealt = docs.select(F.col(id), F.col(text)).repartition(_parts(docs, n), id).select(F.col(id), T.bm25_tokens(F.col(text)).alias("_t"))
    own = dealt.select(F.col(id), F.size("_t").alias("dl"), F.explode(F.concat("_t", F.when(first, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))).alias("term"))

    def posts(asked):
        return own.join(asked, "term", "left_semi").groupBy(id, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))

    return _rank(posts, _asked(queries, query_id, query).join(idf, "term"), length / n if n else None, queries, k, id, query_id)


def bm25_search(index: tuple[DataFrame, DataFrame, DataFrame], queries: DataFrame, k: int = 5, *, id: str = "doc_id", query_id: str = "item_id", query: str = "text") -> DataFrame:
    """bm25_topk over a stored index (postings, stats, idf): documents are not read again. The postings of the queries' terms are dealt by id."""
    posts, stats, idf = index
    told = stats.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    first, parts = _first(stats, k, id), _parts(stats, told["n"])
    fill = stats.filter(first).select(F.lit("").alias("term"), id, F.lit(1).cast("long").alias("tf"))
    sizes = stats.select(id, "dl").repartition(parts, id)

    def own(asked):
        met = posts.select("term", id, F.col("tf").cast("long").alias("tf")).join(asked, "term", "left_semi").unionByName(fill)
        return met.repartition(parts, id).join(sizes, id)

    return _rank(own, _asked(queries, query_id, query).join(idf, "term"), told["avgdl"], queries, k, id, query_id)


def _parts(docs: DataFrame, n: int, rows: int = 2048) -> int:
    """Into how many parts n documents are dealt: few enough in one for a score with each query."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // rows))


def _first(docs: DataFrame, k: int, id: str) -> Column:
    """Whether a row is one of the 2k first documents."""
    ids = [r[0] for r in docs.select(id).orderBy(id).limit(2 * k).collect()]
    there = F.coalesce(F.col(id).isin([x for x in ids if x is not None]), F.lit(False))
    return there | F.col(id).isNull() if None in ids else there


def _rank(posts, asked, avgdl, queries, k, id, query_id):
    """posts(terms): id, term, tf, dl of those terms, dealt by id, with the empty term in the documents that fill up. The queries' terms are broadcast, in blocks of queries where there are many."""
    weights = asked.select(query_id, "term", (F.col("qtf") * F.col("idf")).alias("_w"))
    weights = stored(weights.unionByName(queries.select(F.col(query_id), F.lit("").alias("term"), F.lit(0.0).alias("_w")).distinct()), "asked")
    blocks = max(1, -(-weights.count() // BROADCAST))
    gain = F.col("_w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0)))
    order = Window.partitionBy(query_id).orderBy(F.round("score", 9).desc(), id)
    out = None
    for b in range(blocks):
        own = weights.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) if blocks > 1 else weights
        hits = posts(F.broadcast(own.select("term").distinct())).join(F.broadcast(own), "term")
        scored = hits.groupBy(query_id, id).agg(F.sum(gain).alias("score"))
        best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out


def unit(v):
    """The vector in double precision and of length one; null for a vector without length."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return T.let(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, *, id: str = "vec_id", embedding: str = "embedding", query_id: str = "query_id", block: int = 1024, chunk: int = 4096) -> DataFrame:
    """query_id, id, similarity, rank: exact search of all vectors.

    Each pair of a chunk of vectors and a block of queries is one group, multiplied as matrices in double precision, so a task holds that
    much however large the tables are; it leaves its k best of each query, by the similarity at nine places and then by id."""
    spark = vectors.sparkSession
    chunks, blocks = max(1, -(-vectors.count() // chunk)), max(1, -(-queries.count() // block))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.col(query_id).alias("_q"), unit(F.col(embedding)).alias("_u"), part(query_id, blocks).alias("_b")).filter("_u is not null").withColumn("_c", every(chunks))
    own = vectors.select(F.col(id).alias("_id"), unit(F.col(embedding)).alias("_u"), part(id, chunks).alias("_c")).filter("_u is not null").withColumn("_b", every(blocks))
    types = {"_q": queries.schema[query_id].dataType, "_id": vectors.schema[id].dataType}
    schema = StructType([StructField("_q", types["_q"]), StructField("_id", types["_id"]), StructField("similarity", DoubleType()), StructField("_r", DoubleType())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out, step = [], 256
        left = left.take(pc.sort_indices(left["_id"], null_placement="at_start"))
        sizes = [pc.list_value_length(t["_u"]).to_numpy() for t in (left, right)]
        for n in np.intersect1d(*sizes):
            a, b = (t.filter(pa.array(s == n)) for t, s in zip((left, right), sizes))
            u, v = (pc.list_flatten(t["_u"]).to_numpy().reshape(-1, n) for t in (a, b))
            for at in range(0, len(v), step):
                some = u @ v[at : at + step].T
                key = np.where(np.isnan(some), np.inf, np.round(some, 9) + 0.0)  # NaN is first, as in a sort of Spark's
                m = min(k, len(u))
                least = -np.partition(-key, m - 1, axis=0)[m - 1]
                rows, columns = [], []
                for j in range(key.shape[1]):
                    there = np.flatnonzero(key[:, j] >= least[j])
                    there = there[np.argsort(-key[there, j], kind="stable")][:m]
                    rows.append(there)
                    columns.append(np.full(len(there), j))
                r, c = np.concatenate(rows), np.concatenate(columns)
                out.append(pa.table({"_q": b["_q"].take(pa.array(at + c)), "_id": a["_id"].take(pa.array(r)), "similarity": some[r, c], "_r": key[r, c]}))
        if out:
            return pa.concat_tables(out)
        return pa.table({"_q": right["_q"].slice(0, 0), "_id": left["_id"].slice(0, 0), "similarity": pa.array([], pa.float64()), "_r": pa.array([], pa.float64())})

    ship(spark)
    found = own.groupBy("_c", "_b").cogroup(asked.groupBy("_c", "_b")).applyInArrow(best, schema)
    order = Window.partitionBy("_q").orderBy(F.col("_r").desc(), "_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select(F.col("_q").alias(query_id), F.col("_id").alias(id), "similarity", "rank")


def contains_join(texts: DataFrame, needles: DataFrame, *, text: str, needle: str, width: int = 3) -> DataFrame:
    """The pairs of a text and a needle that it holds as a substring, with the columns of both.

    A needle's words but the first and the last stand as whole words wherever it occurs. Up to `width` of them, from the second on, are
    its key, which a text has among its runs of words. Needles of one or two words have no whole word: their key is their first three
    characters, which a text has among its runs of characters. Keys of up to BROADCAST needles are broadcast, so that a text's runs are
    dropped where they are made; more are joined by a shuffle of hashes. Whole texts meet those pairs only whose keys have met, and the
    needle is looked for in them, so equal hashes don't matter. An empty needle is in no text."""
    words = lambda c: F.filter(F.split(F.col(c), r"(?U)\s+"), lambda w: w != "")
    asked = needles.select(F.col(needle).alias("_needle")).filter("_needle <> ''").groupBy("_needle").agg(F.count(F.lit(1)).alias("_m")).withColumn("_n", F.least(F.size(words("_needle")) - 2, F.lit(width)))
    sizes = {r["n"]: r for r in asked.groupBy(F.greatest("_n", F.lit(0)).alias("n")).agg(F.sum("_m").alias("rows"), F.sum(F.col("_m") * F.length("_needle")).alias("chars")).collect()}
    rows, chars = (sum(r[c] for r in sizes.values()) for c in ("rows", "chars"))
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST else df
    key = F.when(F.col("_n") > 0, F.array_join(F.slice(words("_needle"), 2, F.greatest("_n", F.lit(1))), " ")).otherwise(F.left("_needle", F.lit(3)))
    keys = asked.select("_n", F.xxhash64(key).alias("_k"), F.xxhash64("_needle").alias("_j"))
    own = texts.select(F.col(text).alias("_text")).filter("_text is not null").withColumn("_h", F.xxhash64("_text"))
    hashed = lambda runs: F.array_distinct(F.transform(runs, lambda r: F.xxhash64(r)))
    runs = F.flatten(F.array(*[_runs(F.col("_w"), i) for i in range(1, width + 1) if i in sizes]))
    parts = F.flatten(F.array(*[F.regexp_extract_all("_text", F.lit(f"(?s)(?=(.{{{i}}}))"), F.lit(1)) for i in (1, 2, 3)]))
    met = []
    if any(n > 0 for n in sizes):
        met.append((own.withColumn("_w", words("_text")).select("_h", F.explode(hashed(runs)).alias("_k")), keys.filter("_n > 0")))
    if 0 in sizes:
        met.append((own.select("_h", F.explode(hashed(parts)).alias("_k")), keys.filter("_n <= 0")))
    pairs = None
    for of, k in met:
        found = of.join(small(k.drop("_n"), rows), "_k").select("_h", "_j")
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        return texts.crossJoin(needles).limit(0)
    pairs = stored(pairs.distinct(), "pairs")
    passages = needles.withColumn("_j", F.xxhash64(needle))
    out = texts.withColumn("_h", F.xxhash64(text)).join(small(pairs, pairs.count()), "_h").join(small(passages, max(rows, chars // 32)), "_j")
    return out.filter(F.col(text).contains(F.col(needle))).drop("_h", "_j")


def _runs(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space."""
    at = lambda i: F.array_join(F.slice(words, i, n), " ")
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), at)).otherwise(F.array().cast("array<string>"))


class Retriever(Protocol):
    """Anything that gives the k best records for each row of queries: query_id, id, score, rank."""

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame: ...


class Bm25Retriever:
    """BM25 over documents, or over a stored index."""

    def __init__(self, docs: DataFrame | None = None, index: tuple | None = None, **columns):
        self.docs, self.index, self.columns = docs, index, columns

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        if self.index is not None:
            return bm25_search(self.index, queries, k, **self.columns)
        return bm25_topk(self.docs, queries, k, **self.columns)


class RerankedRetriever:
    """The k best of a first retriever's `depth` by `model`, which adds a column `model` to its hits."""

    def __init__(self, first: Retriever, model, depth: int, *, query_id: str = "item_id"):
        self.first, self.model, self.depth, self.query_id = first, model, depth, query_id

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        hits = self.model(self.first.retrieve(queries, self.depth).withColumnRenamed("rank", "first_rank"))
        return rerank(hits, "model", k, query_id=self.query_id, tie="first_rank")


class StoredRetriever:
    """Ranked records of an earlier run; queries that it lacks get none."""

    def __init__(self, ranked: DataFrame, *, query_id: str = "item_id"):
        self.ranked, self.query_id = ranked, query_id

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        return self.ranked.filter(F.col("rank") <= k).join(queries.select(self.query_id).distinct(), self.query_id, "left_semi")


def retrieve_all(retrievers: dict[str, Retriever], queries: DataFrame, k: int, *, query_id: str = "item_id", id: str = "doc_id") -> DataFrame:
    """config, query_id, id, rank: what each named configuration gives."""
    out = None
    for name, r in retrievers.items():
        own = r.retrieve(queries, k).select(F.lit(name).alias("config"), query_id, id, "rank")
        out = own if out is None else out.unionByName(own)
    return out


def retrieval_result(ranked: DataFrame, *, query_id: str = "item_id", id: str = "doc_id", policy: dict | None = None) -> DataFrame:
    """query_id, size, chunk_ids in the order of rank, retrieval_policy (the settings, as a map)."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(id).alias("id")))), lambda x: x["id"])
    told = F.create_map(*[F.lit(str(x)) for kv in (policy or {}).items() for x in kv]).cast("map<string,string>")
    return ranked.groupBy(query_id).agg(F.count(F.lit(1)).alias("size"), ids.alias("chunk_ids")).withColumn("retrieval_policy", told)


def hybrid_merge(lexical: DataFrame, dense: DataFrame, *, query_id: str, id: str) -> DataFrame:
    """Union of two ranked lists by id, lexical order first, with the sources of each row."""
    a = lexical.select(query_id, id, F.col("score"), F.col("rank").alias("lexical_rank"))
    b = dense.select(query_id, id, "similarity", F.col("rank").alias("dense_rank"))
    both = a.join(b, [query_id, id], "full_outer")
    sources = F.array_compact(F.array(F.when(F.col("lexical_rank").isNotNull(), F.lit("bm25")), F.when(F.col("dense_rank").isNotNull(), F.lit("dense"))))
    order = Window.partitionBy(query_id).orderBy(F.col("lexical_rank").asc_nulls_last(), "dense_rank")
    return both.withColumn("sources", F.array_join(sources, "+")).withColumn("position", F.row_number().over(order))


def rerank(hits: DataFrame, score: str, k: int = 5, *, query_id: str, tie: str) -> DataFrame:
    """The k best by an outside model's score, ties by the order before."""
    order = Window.partitionBy(query_id).orderBy(F.col(score).desc(), tie)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rerank_signal(ranked: DataFrame, score: str, *, query_id: str) -> DataFrame:
    top = lambda r: F.max(F.when(F.col("rank") == r, F.col(score)))
    return ranked.groupBy(query_id).agg(top(1).alias("top_1"), top(2).alias("top_2")).withColumn("margin", F.col("top_1") - F.col("top_2"))

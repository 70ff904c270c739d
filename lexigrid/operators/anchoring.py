"""Lexical anchoring: which informative words of a question a context covers."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import text as T

#: Function words and question words.
STOPWORDS = tuple(
    """a about above after against all also am an and any are as at be because been before being below between both but by can cannot could did do does doing
    down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most must my no nor
    not of off on once only or other others ought our out over own same shall she should so some such than that the their them then there these they this those
    through to too under until up very was we were what when where which while who whom why will with within would you your""".split()
)
#: Words of the question's frame; a corpus's own boilerplate words are passed as well.
FRAME_TERMS = ("summarise", "summarize", "quote", "compare", "contrast", "describe", "explain", "outline", "state", "reconcile", "discuss", "identify", "please", "kindly")


@dataclass(frozen=True)
class AnchorSpec:
    """What counts as an anchor, and which columns of a record its reader sees above the text."""

    min_idf: float = 2.0
    min_term_length: int = 4
    fold_suffixes: bool = True
    keep_slash_numerals: bool = True  # tokens never hold a slash, so this changes nothing
    drop_frame_terms: bool = True
    context_metadata_keys: tuple[str, ...] = ("standard_id", "clause_id", "sub_clause_id", "chunk_id")
    spec_version: str = "anchor_spec_v1"

    def as_dict(self) -> dict:
        return asdict(self) | {"context_metadata_keys": list(self.context_metadata_keys)}

    def with_values(self, **values) -> "AnchorSpec":
        return replace(self, **values)


def _folded(c, fold: bool = True):
    tokens = T.anchor_tokens(c)
    return F.transform(tokens, T.fold_suffix) if fold else tokens


def vocabulary(chunks: DataFrame, *, id: str = "doc_id", text: str = "text", fold: bool = True) -> DataFrame:
    """term, df over distinct folded terms of each chunk."""
    terms = F.array_distinct(_folded(F.col(text), fold))
    return chunks.select(id, F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def anchors(questions: DataFrame, vocab: DataFrame, n_docs: int, *, id: str = "item_id", text: str = "text", min_idf: float = 2.0, min_length: int = 4, frame=FRAME_TERMS, double_fold: bool = True, fold: bool = True) -> DataFrame:
    """id, anchor, idf, oov, first: folded candidates whose idf reaches min_idf. double_fold looks a term up after folding it again."""
    token = F.col("token")
    candidate = ~token.isin(*STOPWORDS, *frame) & ~token.contains("/") & ~token.rlike("[0-9]") & (F.length(token) >= min_length)
    found = questions.select(F.col(id), F.posexplode(T.anchor_tokens(F.col(text))).alias("pos", "token")).filter(candidate)
    found = found.withColumn("anchor", T.fold_suffix(token) if fold else token).groupBy(id, "anchor").agg(F.min("pos").alias("first"))
    key = T.fold_suffix(F.col("anchor")) if double_fold and fold else F.col("anchor")
    found = found.withColumn("term", key).join(vocab, "term", "left")
    idf = F.log(F.lit(float(n_docs)) / (1 + F.coalesce("df", F.lit(0))))
    return found.select(id, "anchor", "first", F.col("df").isNull().alias("oov"), idf.alias("idf")).filter(F.col("idf") >= min_idf)


def surface(contexts: DataFrame, *, id: str = "item_id", text: str = "text", metadata: tuple = (), fold: bool = True) -> DataFrame:
    """id, anchor: distinct folded terms of the texts and of the metadata columns of an item's records; null fields have none."""
    terms = F.flatten(F.array(*[_folded(F.col(c).cast("string"), fold) for c in (text, *metadata)]))
    return contexts.select(F.col(id), F.explode(F.array_distinct(terms)).alias("anchor")).distinct()


def coverage(found: DataFrame, contexts: DataFrame, *, id: str = "item_id", text: str = "text", metadata: tuple = (), fold: bool = True) -> DataFrame:
    """id, n_anchors, n_covered, n_oov, coverage, idf_coverage, oov_ratio, max_uncovered_idf and the lists anchors, oov_anchors, uncovered_anchors in the order of the question; ratios are null where there are no anchors or no idf."""
    terms = surface(contexts, id=id, text=text, metadata=metadata, fold=fold).withColumn("there", F.lit(1))
    joined = found.join(terms, [id, "anchor"], "left")
    missing, place = F.col("there").isNull(), F.struct("first", "anchor")
    listed = lambda which: F.transform(F.array_sort(F.collect_list(place if which is None else F.when(which, place))), lambda x: x["anchor"])
    out = joined.groupBy(id).agg(
        F.count(F.lit(1)).alias("n_anchors"), F.count("there").alias("n_covered"), F.count_if(F.col("oov")).alias("n_oov"), F.sum("idf").alias("_all"), F.sum(F.when(missing, 0.0).otherwise(F.col("idf"))).alias("_covered"),
        F.max(F.when(missing, F.col("idf"))).alias("max_uncovered_idf"), listed(None).alias("anchors"), listed(F.col("oov")).alias("oov_anchors"), listed(missing).alias("uncovered_anchors"),
    )
    share = lambda c: F.try_divide(c, "n_anchors").alias
    return out.select(id, "n_anchors", "n_covered", "n_oov", share("n_covered")("coverage"), F.when(F.col("_all") > 0, F.col("_covered") / F.col("_all")).alias("idf_coverage"), share("n_oov")("oov_ratio"), "max_uncovered_idf", "anchors", "oov_anchors", "uncovered_anchors")


def anchoring_signal(questions: DataFrame, vocab: DataFrame, n_docs: int, contexts: DataFrame, spec: AnchorSpec = AnchorSpec(), *, frame=FRAME_TERMS, id: str = "item_id", question: str = "text", text: str = "text") -> DataFrame:
    """coverage for every question, with n_query_tokens; a question without anchors has none of them and null ratios. Metadata columns of the spec that contexts lacks add nothing."""
    found = anchors(questions, vocab, n_docs, id=id, text=question, min_idf=spec.min_idf, min_length=spec.min_term_length, frame=frame if spec.drop_frame_terms else (), fold=spec.fold_suffixes)
    told = coverage(found, contexts, id=id, text=text, metadata=tuple(c for c in spec.context_metadata_keys if c in contexts.columns), fold=spec.fold_suffixes)
    out = questions.select(id, F.size(T.anchor_tokens(F.col(question))).alias("n_query_tokens")).join(told, id, "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_anchors", "n_covered", "n_oov")} | {c: F.coalesce(c, none) for c in ("anchors", "oov_anchors", "uncovered_anchors")})


def redacted(signals: DataFrame, private) -> DataFrame:
    """signals with the three lists of terms replaced by counts where `private` (a boolean Column) holds: lists become null there and n_uncovered tells how many there were."""
    lists = ("anchors", "oov_anchors", "uncovered_anchors")
    held = signals.withColumns({"n_uncovered": F.size("uncovered_anchors"), "terms_withheld": private})
    return held.withColumns({c: F.when(~private, F.col(c)) for c in lists})

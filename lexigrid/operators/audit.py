"""Citation audit and clause grounding of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions import overlap
from lexigrid.functions import text as T
from lexigrid.sources.scratch import ship

MARKER = r"\[(\d{1,2})\]"
#: A standard's token and a cue word, both optional, before a path; and a standard named in prose.
REFERENCE = r"(?i)(?:(SS\s?\d{1,2})\s*)?(?:(?:§|\bitems?\b|\bclauses?\b|\bparagraphs?\b|\bparas?\b\.?|\bsections?\b)\s*(?:no\.?\s*)?)?(\d+(?:/\d+){1,3})\b"
STANDARD_PROSE = r"(?i)Shari.?ah\s+Standard\s+No\.?\s*\(?(\d{1,2})\)?"
LOOKBACK, LOOKAHEAD = 60, 48
FAILING = ("unknown_rank", "misattributed", "corrupted")
ATTRIBUTIONS = ("unknown_rank", "too_short", "supported", "misattributed", "corrupted", "unverified")
STATUSES = ("grounded_in_context", "outside_context", "unknown_standard", "unresolvable")
MIN_WORDS, SUPPORT = 6, 0.5


def matches(rows: DataFrame, pattern: str, groups: dict[str, int], *, id: str, text: str, reach: int = 0) -> DataFrame:
    """id, _row, no, start, before, whole, each named group, and after (the text to the next match) of all matches in a text.

    The text is split once; starts are running sums over its pieces, so time follows the text's length. reach: with behind and ahead, so
    many characters on both sides of the match, put together from the ends of at most reach pieces, as a match has a character at least."""
    c = F.coalesce(F.col(text), F.lit(""))
    pieces = F.arrays_zip(F.split(c, pattern, -1).alias("before"), *[F.regexp_extract_all(c, F.lit(pattern), F.lit(g)).alias(n) for n, g in {"whole": 0, **groups}.items()])
    numbered = rows.select(F.col(id), pieces.alias("_pieces"), F.monotonically_increasing_id().alias("_row"))
    out = numbered.select(id, "_row", F.posexplode("_pieces").alias("no", "p"))
    w = Window.partitionBy("_row").orderBy("no")
    size = F.length("p.before") + F.coalesce(F.length("p.whole"), F.lit(0))
    out = out.withColumns({"start": F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("p.before"), "after": F.lead("p.before").over(w)})
    more = []
    if reach:
        piece = F.concat("p.before", F.coalesce("p.whole", F.lit("")))
        joined = lambda c, a, b: F.array_join(F.collect_list(c).over(w.rowsBetween(a, b)), "")
        out = out.withColumns({"_tail": F.right(piece, F.lit(reach)), "_head": F.left(piece, F.lit(reach))})
        out = out.withColumns({"behind": F.right(F.concat(joined("_tail", -reach // 3, -1), "p.before"), F.lit(reach)), "ahead": F.left(joined("_head", 1, reach // 3), F.lit(reach))})
        more = ["behind", "ahead"]
    return out.filter("p.whole is not null").select(id, "_row", "no", "start", F.col("p.before").alias("before"), F.col("p.whole").alias("whole"), *[F.col("p")[n].alias(n) for n in groups], "after", *more)


def citation_segments(responses: DataFrame, *, id: str = "item_id", text: str = "response") -> DataFrame:
    """id, segment_no, cited_rank, marker_start, segment: a marker owns the text up to the next marker; what stands before the first is nobody's."""
    rows = matches(responses, MARKER, {"rank": 1}, id=id, text=text)
    return rows.select(id, F.col("no").alias("segment_no"), F.col("rank").cast("int").alias("cited_rank"), F.col("start").alias("marker_start"), F.trim("after").alias("segment"))


def audit_citations(responses: DataFrame, context: DataFrame, *, id: str = "item_id", text: str = "response") -> DataFrame:
    """One row a segment with its attribution, the first that applies of: unknown_rank, too_short, supported, misattributed, corrupted, unverified.

    context: id, rank (from 1, without gaps), text (label and text of each rank). cited_overlap: with the cited rank; best_overlap and best_rank: with
    the first of the ranks that it overlaps most, null where it overlaps none. A response meets the ranks of its item in one row, as a prompt does, so each text is
    shuffled once and its shingles never; those without characters of other scripts are compared too for the segments that hold any. Two different shingles of an
    item with the same 64-bit hash are not told apart."""
    ship(responses.sparkSession)
    c = F.coalesce(F.col(text), F.lit(""))
    ranks = context.groupBy(id).agg(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("text"))).alias("_context"), F.max("rank").alias("_ranks"))
    rows = responses.select(F.col(id), c.alias("_text")).join(ranks, id, "left")
    cut = F.struct(F.split("_text", MARKER, -1).alias("before"), F.regexp_extract_all("_text", F.lit(MARKER), F.lit(1)).alias("rank"))
    rows = rows.select(id, "_context", "_ranks", F.explode(F.array(cut)).alias("_cut"))  # exploded, here and below, so that it is computed once and not wherever it is used
    n = F.size("_cut.rank")
    # a text has a segment fewer than pieces: what stands before the first mark is nobody's
    owned = F.when(n > 0, F.transform(F.slice("_cut.before", F.lit(2), F.greatest(n, F.lit(1))), lambda s: F.trim(s))).otherwise(F.array().cast("array<string>"))
    parts = F.struct(
        F.transform(F.slice("_cut.before", F.lit(1), n), lambda s: F.length(s)).alias("_before"), F.transform("_cut.rank", lambda r: F.length(r) + 2).alias("_marks"),
        F.transform("_cut.rank", lambda r: r.cast("int")).alias("_cited"), owned.alias("_segments"),
    )
    rows = rows.select(id, "_context", "_ranks", F.explode(F.array(parts)).alias("_p")).select(id, "_context", "_ranks", "_p.*")
    rows = rows.withColumn("_cleaned", F.transform("_segments", lambda s: F.when(s.rlike(T.FOREIGN), T.strip_unexpected_script(s))))
    rows = rows.withColumn("_found", overlap.compared()("_before", "_marks", "_cited", "_segments", "_cleaned", "_context"))
    out = rows.select(id, "_ranks", F.posexplode(F.arrays_zip(F.col("_cited").alias("cited"), F.col("_segments").alias("segment"), F.col("_found").alias("found"))).alias("segment_no", "s"))
    found = lambda *names: [F.col(f"s.found.{x}").alias(x) for x in names]
    out = out.select(id, "segment_no", F.col("s.cited").alias("cited_rank"), F.col("s.found.start").alias("marker_start"), F.col("s.segment").alias("segment"), *found("n_words"), T.unexpected_script(F.col("s.segment")).alias("unexpected_script"), *found("cited_overlap", "best_overlap", "best_rank", "clean_overlap"), "_ranks")
    known = F.coalesce((F.col("cited_rank") >= 1) & (F.col("cited_rank") <= F.col("_ranks")), F.lit(False))
    attribution = (
        F.when(~known, "unknown_rank").when(F.col("n_words") < MIN_WORDS, "too_short").when(F.col("cited_overlap") >= SUPPORT, "supported")
        .when((F.col("best_overlap") >= SUPPORT) & (F.col("best_rank") != F.col("cited_rank")), "misattributed").when(F.col("clean_overlap") >= SUPPORT, "corrupted").otherwise("unverified")
    )
    return out.withColumn("attribution", attribution).drop("_ranks")


def audit_summary(responses: DataFrame, segments: DataFrame, *, id: str = "item_id", text: str = "response") -> DataFrame:
    """One row a response: cited_ranks (distinct, first cited first), out_of_range, n_segments, n_failing, a count of each attribution, uncited_attempt, passed.

    segments: those of audit_citations for the same responses. A response with a mark has a segment there, so only those without marks, or without an id, are classified."""
    a = F.col("attribution")
    ordered = lambda keep: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("segment_no", "cited_rank")))), lambda x: x["cited_rank"]))
    by = segments.groupBy(id).agg(ordered(F.lit(True)).alias("cited_ranks"), ordered(a == "unknown_rank").alias("out_of_range"), F.count(F.lit(1)).alias("n_segments"), F.count_if(a.isin(*FAILING)).alias("n_failing"), *[F.count_if(a == x).alias(f"n_{x}") for x in ATTRIBUTIONS])
    marked = F.col(id).isNotNull() & F.coalesce(F.col(text).rlike(MARKER), F.lit(False))
    attempt = F.when(marked, F.lit(False)).otherwise(T.classify_response(F.col(text)).isin("answered", "mixed"))
    out = responses.select(id, attempt.alias("attempt")).join(by, id, "left")
    none = F.array().cast("array<int>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("cited_ranks", "out_of_range")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_segments", "n_failing", *[f"n_{x}" for x in ATTRIBUTIONS])})
    out = out.withColumn("uncited_attempt", F.col("attempt") & (F.col("n_segments") == 0)).drop("attempt")
    return out.withColumn("passed", (F.col("n_failing") == 0) & ~F.col("uncited_attempt"))


def clause_references(responses: DataFrame, *, id: str = "item_id", text: str = "response") -> DataFrame:
    """id, ref_no, char_offset, standard, qualified, path: slash paths of two to four levels.

    A path belongs to the standard right before it, else to one named in prose within LOOKAHEAD characters after it, else to the last
    one within LOOKBACK characters before it, else to none."""
    rows = matches(responses, REFERENCE, {"own": 1, "path": 2}, id=id, text=text, reach=max(LOOKBACK, LOOKAHEAD))
    rows = rows.withColumns({"behind": F.right("behind", F.lit(LOOKBACK)), "ahead": F.left("ahead", F.lit(LOOKAHEAD))})
    named = [F.col("own"), F.regexp_extract("ahead", STANDARD_PROSE, 1), F.regexp_extract("behind", r"(?is)^.*\bSS\s?(\d{1,2})\b", 1)]
    standard = F.coalesce(*[F.when(n != "", T.normalise_standard(n)) for n in named])
    return rows.select(id, F.col("no").alias("ref_no"), (F.col("start") + F.length("whole") - F.length("path")).cast("int").alias("char_offset"), standard.alias("standard"), standard.isNotNull().alias("qualified"), "path")


def clause_index(records: DataFrame, *, standard: str = "standard_id", clause: str = "clause_id") -> DataFrame:
    """standard, path of all clauses and their ancestors."""
    return records.select(F.col(standard).alias("standard"), F.explode(T.ancestors(F.col(clause))).alias("path")).filter("standard <> ''").distinct()


def _lookup(index: DataFrame, *, standard: str = "standard", clause: str = "path") -> DataFrame:
    """A clause index with every path a second time under the empty standard, where references without one look."""
    full = clause_index(index, standard=standard, clause=clause)
    return full.unionByName(full.select(F.lit("").alias("standard"), "path").distinct())


def write_clause_index(records: DataFrame, name: str, *, buckets: int = 64, standard: str = "standard_id", clause: str = "clause_id") -> None:
    """Store the index of records as a table in buckets of standard and path, so that audits look references up without shuffling it."""
    _lookup(records, standard=standard, clause=clause).write.bucketBy(buckets, "standard", "path").sortBy("standard", "path").format("parquet").saveAsTable(name)


def ground(references: DataFrame, context: DataFrame, index: DataFrame | None = None, *, stored: bool = False, id: str = "item_id") -> DataFrame:
    """status and resolved_via of each reference: grounded_in_context (exact, ancestor or verbatim_in_context), else by the corpus index (standard, path) outside_context, unknown_standard or unresolvable.

    context: id, standard, clause, text. Texts count for verbatim whatever their standard; paths without a standard don't count. Paths meet by an
    equi-join with the context's clauses and their ancestors; only references that no clause shows are looked for in the texts. stored: index is a
    table that write_clause_index made."""
    shown = context.filter("standard <> ''").select(id, F.col("standard").alias("cs"), "clause", F.explode(T.ancestors(F.col("clause"))).alias("path"))
    shown = shown.groupBy(id, "path", "cs").agg(F.max(F.col("clause") == F.col("path")).alias("exact"))
    anyone = shown.groupBy(id, "path").agg(F.max("exact").alias("exact")).select(id, "path", F.lit("").alias("cs"), "exact")
    keys = [id, "ref_no", "standard", "path"]
    asked = references.select(*keys).withColumn("cs", F.coalesce("standard", F.lit("")))
    flags = asked.join(shown.select(id, "path", "cs", "exact").unionByName(anyone), [id, "path", "cs"], "left")
    open_ = flags.filter("exact is null").select(id, "path").distinct()
    texts = context.filter("text is not null").select(id, "text")
    verbatim = open_.join(texts, id).filter(F.col("text").contains(F.col("path"))).select(id, "path").distinct().withColumn("verbatim", F.lit(True))
    flags = flags.join(verbatim, [id, "path"], "left")
    via = F.when(F.col("exact"), "exact").when(F.col("exact").isNotNull(), "ancestor").when(F.col("verbatim"), "verbatim_in_context")
    if index is None:
        return flags.select(*keys, F.when(via.isNotNull(), "grounded_in_context").otherwise("outside_context").alias("status"), F.coalesce(via, F.lit("no_corpus_index")).alias("resolved_via"))
    full = (index if stored else _lookup(index)).select(F.col("standard").alias("cs"), "path", F.lit(True).alias("listed"))
    known = full.filter("cs <> ''").select("cs").distinct().withColumn("known", F.lit(True))
    out = flags.join(known, "cs", "left").join(full, ["cs", "path"], "left")
    unknown, listed = (F.col("cs") != "") & F.col("known").isNull(), F.coalesce("listed", F.lit(False))
    status = F.when(via.isNotNull(), "grounded_in_context").when(unknown, "unknown_standard").when(listed, "outside_context").otherwise("unresolvable")
    return out.select(*keys, status.alias("status"), F.coalesce(via, F.when(unknown, "standard_not_in_corpus").when(listed, "corpus_exact").otherwise("no_match")).alias("resolved_via"))


def grounding_summary(responses: DataFrame, grounded: DataFrame, *, id: str = "item_id") -> DataFrame:
    """One row a response: n_references, n_distinct (by standard and path), a count of each status, passed (nothing outside the context)."""
    s = F.col("status")
    by = grounded.groupBy(id).agg(F.count(F.lit(1)).alias("n_references"), F.size(F.collect_set(F.struct("standard", "path"))).cast("long").alias("n_distinct"), *[F.count_if(s == x).alias(f"n_{x}") for x in STATUSES])
    out = responses.select(id).join(by, id, "left").na.fill(0, ["n_references", "n_distinct", *[f"n_{x}" for x in STATUSES]])
    return out.withColumn("passed", F.col("n_references") == F.col("n_grounded_in_context"))

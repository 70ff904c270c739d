"""From lines to clause records, chunks and windows: a line grammar as running values over (standard, page, line), in blocks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators.ordered import BLOCK, before, running, running_low
from lexigrid.sources.scratch import forget, positions, stored

#: The line grammar.
SECTION = r"^(\d+)\.\s+(.+)$"
CLAUSE = r"^(\d+(?:/\d+)+)\s*(.*)$"
BULLET = r"^([a-z]\)|\((?:[a-z]|[ivxlcdm]+)\))\s+(.+)$"
PAGE_NUMBER = r"^\d{1,4}$"
CUE = r"(?i)\b(?:see|items?|clauses?|paras?\.?|paragraphs?|sections?)\s*$"
CONTINUATION = r"^(?:[,.;:\]\)]|(?:and|or|above|below|should)\b)"
HEADER = r"(?i)^Shari[’']ah Standard No\.\s*\(\d+\)"
STATEMENT = r"(?i)^Statement of the Standard$"
DOT_LEADER = r"\.{3,}\s*\d+\s*$"
TYPOGRAPHIC = "–‘’“”…"
BACK_MATTER = r"(?i)^(?:\d+\.\s+)?Date of Issuance of (?:the )?Standard\b"


def normalise_lines(pages: DataFrame, *, nfc: bool = False) -> DataFrame:
    """standard_id, page, line_no, line out of standard_id, page, text: soft hyphens go, white space collapses, blank lines drop. nfc composes characters first, in Arrow batches."""
    text = T.nfc_udf()(F.col("text")) if nfc else F.col("text")
    rows = pages.select("standard_id", "page", F.posexplode(F.split(text, "\r\n|[\n\r\x0b\x0c]")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.trim(F.regexp_replace(F.replace("line", F.lit("\u00ad"), F.lit("")), r"(?U)\s+", " ")))
    return rows.filter(F.col("line") != "")


def empty_pages(pages: DataFrame) -> DataFrame:
    """standard_id, page of pages without a line."""
    return pages.select("standard_id", "page").distinct().join(normalise_lines(pages).select("standard_id", "page").distinct(), ["standard_id", "page"], "left_anti")


def _numbered(line):
    return line.rlike(SECTION) & ~line.rlike(CLAUSE)


def _contents() -> dict:
    """Aggregates of a page's lines by which it is told whether it is built like a table of contents."""
    line = F.col("line")
    return {"headed": F.bool_or(F.lower(line) == "contents"), "subject": F.bool_or(F.lower(line).startswith("subject page")), "leaders": F.count_if(line.rlike(DOT_LEADER)), "n_entries": F.count_if(_numbered(line))}


_IS_CONTENTS = "headed and (subject or leaders >= 2 or n_entries >= 4)"


def contents_pages(lines: DataFrame) -> DataFrame:
    """standard_id, page, n_entries of pages built like a table of contents: its heading, and a subject line, two dot leaders or four numbered entries."""
    by = lines.groupBy("standard_id", "page").agg(*[c.alias(n) for n, c in _contents().items()])
    return by.filter(_IS_CONTENTS).select("standard_id", "page", "n_entries")


def scan_lines(lines: DataFrame) -> DataFrame:
    """Every line with where it stands: in_toc (a contents page before the start), started (section 1 seen), over (back matter reached), ignored, stated (the statement heading was seen before).

    Where a standard starts, states and ends are least places. They are found from one narrow row a page and come back to the lines by
    standard and page, so no task reads the lines of a whole standard."""
    line, no = F.col("line"), F.col("line_no")
    begins = (F.regexp_extract(line, SECTION, 1) == "1") & ~line.rlike(CLAUSE)
    by = lines.groupBy("standard_id", "page").agg(
        *[c.alias(n) for n, c in _contents().items()], F.min(F.when(begins, no)).alias("_b"), F.min(F.when(line.rlike(STATEMENT), no)).alias("_s"), F.collect_list(F.when(line.rlike(BACK_MATTER), no)).alias("_e"),
    )
    pages = stored(by.withColumn("_toc", F.expr(_IS_CONTENTS)).select("standard_id", "page", "_toc", "_b", "_s", "_e"), "pages")
    place = lambda c: F.when(c.isNotNull(), F.struct("page", c.alias("line_no")))
    own = lambda c: F.min(F.when(~F.col("_toc"), place(F.col(c))))
    pages = pages.join(pages.groupBy("standard_id").agg(own("_b").alias("_start"), own("_s").alias("_stated")), "standard_id")
    ends = F.array_min(F.filter("_e", lambda e: F.struct("page", e.alias("line_no")) >= F.col("_start")))
    last = pages.withColumn("_e", ends).groupBy("standard_id").agg(F.min(place(F.col("_e"))).alias("_end"))
    pages = pages.join(last, "standard_id").select("standard_id", "page", "_toc", "_start", "_stated", "_end")
    at = F.struct("page", "line_no")
    there = lambda c: F.coalesce(at >= F.col(c), F.lit(False))
    rows = lines.join(pages, ["standard_id", "page"]).withColumns({"started": there("_start"), "stated": there("_stated"), "over": there("_end")})
    ignored = line.rlike(HEADER) | line.rlike(PAGE_NUMBER) | line.isin("Statement of the Standard", "Contents")
    return rows.withColumns({"in_toc": F.col("_toc") & ~F.col("started"), "ignored": ignored}).drop("_toc", "_start", "_stated", "_end")


def normative_lines(lines: DataFrame) -> DataFrame:
    """standard_id, page, line_no, line from section 1 to the back matter, without running headers and page numbers."""
    return scan_lines(lines).filter("started and not over and not ignored").select("standard_id", "page", "line_no", "line")


def normative_start(lines: DataFrame) -> DataFrame:
    """standard_id, start_page, reason, back_matter_page; nulls where there is none."""
    rows = scan_lines(lines)
    at = F.min(F.when(F.col("started"), F.struct("page", "line_no", "stated")))
    out = rows.groupBy("standard_id").agg(at.alias("at"), F.min(F.when(F.col("over"), F.col("page"))).alias("back_matter_page"))
    reason = F.when(F.col("at.stated"), "statement_of_standard_then_section_1").when(F.col("at").isNotNull(), "section_1_fallback")
    return out.select("standard_id", F.col("at.page").alias("start_page"), reason.alias("reason"), "back_matter_page")


def page_texts(lines: DataFrame) -> DataFrame:
    """standard_id, page, text: the normative lines of each page, joined again."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return normative_lines(lines).groupBy("standard_id", "page").agg(F.array_join(ordered, "\n").alias("text"))


def opened_lines(lines: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The normative lines, stored, with what the grammar says of each: candidate (a number that could open a record), reason (why it goes on a citation instead), clause_id, sub, part (the line, or what follows its number), opens, record_no.

    Bracket depth, the line before and the ids run across pages and over blocks of `block` lines, so one standard may lie in many tasks. pos: the line's place."""
    lines = stored(lines, "lines")
    placed, n = positions(normative_lines(lines), ["standard_id", "page", "line_no"], "placed")
    forget(lines)
    rows = placed.withColumn("block", F.floor(F.col("pos") / block))
    run = {"order": "pos", "block": "block", "blocks": -(-n // block)}
    line = F.col("line")
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    rows = running_low(rows, ["standard_id"], (count("[") - count("]")).cast("long"), "depth", **run)
    rows = before(rows, ["standard_id"], line, "prev", **run)
    own = F.when(line.rlike(CLAUSE), F.regexp_extract(line, CLAUSE, 1)).when(line.rlike(SECTION), F.regexp_extract(line, SECTION, 1))
    body = F.when(line.rlike(CLAUSE), F.regexp_extract(line, CLAUSE, 2)).when(line.rlike(SECTION), F.regexp_extract(line, SECTION, 2))
    reason = (
        F.when(own.isNull(), None).when(F.col("depth") > 0, "inside_unclosed_square_bracket")
        .when(F.coalesce("prev", F.lit("")).rlike(CUE), "preceding_line_ends_with_citation_cue").when(body.rlike(CONTINUATION), "continuation_marker_after_identifier")
    )
    rows = rows.withColumns({"candidate": own, "reason": reason}).withColumn("own", F.when(F.col("reason").isNull(), F.col("candidate"))).drop("depth", "prev")
    rows = candidates = stored(rows, "candidates")
    forget(placed)
    heads = rows.groupBy("standard_id", "block").agg(F.min(F.when(F.col("own").isNotNull(), F.col("pos"))).alias("_own"))  # one row a block
    first = heads.groupBy("standard_id").agg(F.min("_own").alias("_first"))
    rows = rows.join(heads.select("standard_id", "block").join(first, "standard_id"), ["standard_id", "block"])
    bullet = F.coalesce(F.col("own").isNull() & (F.col("pos") > F.col("_first")) & line.rlike(BULLET), F.lit(False))
    rows = rows.withColumns({"sub": F.when(bullet, F.regexp_extract(line, BULLET, 1)), "body": F.when(F.col("own").isNotNull(), body).when(bullet, F.regexp_extract(line, BULLET, 2))})
    rows = rows.withColumns({"opens": F.col("body").isNotNull(), "part": F.coalesce("body", "line")}).drop("_first", "body")
    out = running(rows, ["standard_id"], {"clause_id": ("last", F.col("own")), "record_no": ("sum", F.col("opens").cast("long"))}, **run).drop("block")
    out._lexigrid_path = candidates._lexigrid_path
    return out


def wrapped_references(lines: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """standard_id, page, line_no, candidate, reason of numbered lines that go on a citation."""
    return opened_lines(lines, block=block).filter("reason is not null").select("standard_id", "page", "line_no", "candidate", "reason")


def unparsed_numeric(lines: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """standard_id, page, line_no of lines that begin with a digit while no record is open."""
    return opened_lines(lines, block=block).filter(F.col("clause_id").isNull() & F.col("line").rlike(r"^\d")).select("standard_id", "page", "line_no")


def parse_clauses(lines: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """standard_id, record_no, section_id, clause_id, sub_clause_id, occurrence_index, source_page, text.

    A numbered line opens a record unless an open bracket, a reference cue at the end of the line before, or a continuation marker
    says that it goes on; bullets take the ids of the record they stand in. Text starts at section 1 and ends at the back matter;
    records without text drop."""
    opened = opened_lines(lines, block=block)
    rows = opened.filter("clause_id is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\x01")
    text = F.replace(F.regexp_replace(joined, r"-\x01(?=\p{Ll})", ""), F.lit("\x01"), F.lit(" "))
    out = rows.groupBy("standard_id", "record_no").agg(F.max("clause_id").alias("clause_id"), F.max("sub").alias("sub_clause_id"), F.min("page").alias("source_page"), F.trim(text).alias("text"), F.min("pos").alias("pos"))
    out = stored(out.filter("text <> ''").withColumn("block", F.floor(F.col("pos") / block)), "records")
    forget(opened)
    blocks = out.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    out = running(out, ["standard_id", "clause_id"], {"nth": ("sum", F.lit(1).cast("long"))}, order="pos", block="block", blocks=blocks)
    return out.select("standard_id", "record_no", F.split("clause_id", "/")[0].alias("section_id"), "clause_id", "sub_clause_id", (F.col("nth") - 1).cast("int").alias("occurrence_index"), "source_page", "text")


def duplicate_clauses(records: DataFrame) -> DataFrame:
    """standard_id, clause_id, occurrence_count of ids that occur more than once."""
    return records.groupBy("standard_id", "clause_id").agg(F.count(F.lit(1)).alias("occurrence_count")).filter("occurrence_count > 1")


def record_diagnostics(records: DataFrame, *, short: int = 5, long: int = 700) -> DataFrame:
    """The records' ids with n_words, short, long, replacement characters and control characters."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0)))
    bad = F.length("text") - F.length(F.replace("text", F.lit("\ufffd"), F.lit("")))
    keys = [c for c in ("standard_id", "section_id", "clause_id", "occurrence_index", "sub_clause_id", "source_page") if c in records.columns]
    return records.select(*keys, n.alias("n_words"), (n < short).alias("short"), (n > long).alias("long"), bad.alias("n_replacement"), F.col("text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]").alias("has_control"))


def codepoint_histogram(records: DataFrame, *, text: str = "text") -> DataFrame:
    """codepoint (U+hex), kind (typographic or other), n of characters beyond ASCII, replacement characters apart."""
    ch = F.col("ch")
    own = unicode_histogram(records, text=text).filter(ch != "\ufffd")
    point = F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 16)
    return own.select(F.concat(F.lit("U+"), F.lpad(point, F.greatest(F.lit(4), F.length(point)), F.lit("0"))).alias("codepoint"), F.when(F.lit(TYPOGRAPHIC).contains(ch), "typographic").otherwise("other").alias("kind"), "n")


def codepoint_names(histogram: DataFrame) -> DataFrame:
    """codepoint_histogram with the characters' names, <unnamed> where there is none; one row a distinct character, in Arrow batches."""
    @F.pandas_udf("string")
    def name(points: pd.Series) -> pd.Series:
        return points.map(lambda p: unicodedata.name(chr(int(p[2:], 16)), "<unnamed>"))

    return histogram.withColumn("name", name("codepoint"))


def record_references(records: DataFrame) -> DataFrame:
    """The five columns that a record is known by."""
    return records.select("standard_id", "clause_id", "occurrence_index", "sub_clause_id", "source_page")


def dedupe_glyphs(glyphs: DataFrame, *, tolerance: float = 1.0) -> DataFrame:
    """glyphs (page, char, font, size, x0, top, seq) without those that repeat one before them at the same place, as some documents print bold type.

    Glyphs of one page, character, font and size are one copy if top, and then x0, go on within the tolerance from one to the next; of each
    copy the first by seq stays."""
    same = ("page", "char", "font", "size")

    def runs(rows: DataFrame, by: tuple, value: str, name: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(value, "seq")
        starts = F.coalesce((F.col(value) - F.lag(value).over(w) > tolerance).cast("int"), F.lit(1))
        return rows.withColumn("_new", starts).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    rows = runs(runs(glyphs, same, "top", "_line"), (*same, "_line"), "x0", "_place")
    first = F.row_number().over(Window.partitionBy(*same, "_line", "_place").orderBy("seq"))
    return rows.withColumn("_first", first).filter("_first = 1").drop("_line", "_place", "_first")


def page_text(glyphs: DataFrame, *, x_tolerance: float = 2.0, y_tolerance: float = 3.0) -> DataFrame:
    """page, text out of glyphs (page, char, x0, x1, top, seq): lines where tops go on within y_tolerance, a space where glyphs stand further apart than x_tolerance."""
    down = Window.partitionBy("page").orderBy("top", "seq")
    rows = glyphs.withColumn("_new", F.coalesce((F.col("top") - F.lag("top").over(down) > y_tolerance).cast("int"), F.lit(0)))
    rows = rows.withColumn("_line", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy("page", "_line").orderBy("x0", "seq")
    gap = F.col("x0") - F.lag("x1").over(along) > x_tolerance
    rows = rows.withColumn("part", F.concat(F.when(gap & (F.col("char") != " ") & (F.lag("char").over(along) != " "), F.lit(" ")).otherwise(""), "char"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "seq", "part"))), lambda x: x["part"]), "")
    lines = rows.groupBy("page", "_line").agg(line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("page").agg(joined.alias("text"))


def extraction_report(lines: DataFrame, records: DataFrame) -> DataFrame:
    """One row a standard: n_records, n_sub_clauses, sections, start and back-matter page, n_toc_pages, and failures (empty: the report passes)."""
    pages = scan_lines(lines).filter("in_toc").select("standard_id", "page").distinct()
    toc = pages.groupBy("standard_id").agg(F.count(F.lit(1)).alias("n_toc_pages"))
    sections = F.transform(F.sort_array(F.transform(F.collect_set("section_id"), lambda x: x.cast("int"))), lambda x: x.cast("string"))
    seen = records.join(pages.select("standard_id", F.col("page").alias("source_page"), F.lit(True).alias("_listed")), ["standard_id", "source_page"], "left")
    listed = F.coalesce("_listed", F.lit(False)) | F.col("text").rlike(DOT_LEADER)
    by = seen.groupBy("standard_id").agg(F.count(F.lit(1)).alias("n_records"), F.count("sub_clause_id").alias("n_sub_clauses"), sections.alias("sections"), F.bool_or(listed).alias("_toc"), F.bool_or(F.col("text").rlike(BACK_MATTER)).alias("_back"))
    out = normative_start(lines).join(toc, "standard_id", "left").join(by, "standard_id", "left")
    failures = F.array_compact(F.array(F.when(F.col("start_page").isNull(), "normative_body_start_not_detected"), F.when(F.col("_toc"), "toc_like_record_emitted"), F.when(F.col("_back"), "back_matter_record_emitted")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("standard_id", "start_page", "reason", "back_matter_page", zero("n_toc_pages"), zero("n_records"), zero("n_sub_clauses"), "sections", failures.alias("failures"))


def clause_chunks(records: DataFrame) -> DataFrame:
    """One chunk a record: chunk_id and bm25_text with the ids in front."""
    sub = F.coalesce(F.col("sub_clause_id"), F.lit(""))
    chunk = F.concat(F.lit("clause:"), "standard_id", F.lit(":"), "clause_id", F.when(sub != "", F.concat(F.lit(":"), sub)).otherwise(""), F.lit(":occurrence:"), F.col("occurrence_index").cast("string"))
    bm25 = F.trim(F.concat("standard_id", F.lit(" section "), "section_id", F.lit(" clause "), "clause_id", F.lit(" "), sub, F.lit(" "), "text"))
    return records.withColumns({"chunk_id": chunk, "bm25_text": bm25})


def sac_enrich(chunks: DataFrame, summaries: DataFrame, *, key: str = "standard_id") -> DataFrame:
    """bm25_text with the standard's summary in front; chunks of a standard without one stay as they are."""
    out = chunks.join(summaries.select(key, F.col("summary").alias("standard_summary")), key, "left")
    return out.withColumn("bm25_text", F.concat(F.coalesce(F.concat("standard_summary", F.lit("\n")), F.lit("")), "bm25_text"))


def fixed_windows(tokens: DataFrame, *, id: str = "doc_id", tokens_col: str = "tokens", size: int = 256, overlap: int = 32) -> DataFrame:
    """id, token_start, token_end, tokens: windows of `size` tokens that overlap; the last, shorter one stays."""
    n, step = F.size(tokens_col), size - overlap
    rows = tokens.filter(n > 0).select(id, F.col(tokens_col), F.explode(F.sequence(F.lit(0), n - 1, F.lit(step))).alias("token_start"))
    return rows.select(id, "token_start", F.least(F.col("token_start") + size, F.size(tokens_col)).alias("token_end"), F.slice(tokens_col, F.col("token_start") + 1, size).alias("tokens"))


def page_spans(windows: DataFrame, pages: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """Each window with the pages (id, page, page_start, page_end) that it meets: a range condition within an id."""
    met = windows.join(pages, id).filter((F.col("token_start") < F.col("page_end")) & (F.col("page_start") < F.col("token_end")))
    return met.groupBy(id, "token_start", "token_end").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def unicode_histogram(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """ch, n: characters beyond ASCII; characters are counted in each row's task before the shuffle."""
    return docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[^\x00-\x7F]"), F.lit(0))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))

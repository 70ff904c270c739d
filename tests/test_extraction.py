import random
import re

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import extraction as X
from lexigrid.operators import ordered

SECTION, CLAUSE, BULLET = (re.compile(p) for p in (X.SECTION, X.CLAUSE, X.BULLET))
PAGES = [
    ("SS9", 1, "Shari'ah Standard No. (9)\nContents\n1. Scope ..... 3\n2. Rent ..... 5"), ("SS9", 2, "Statement of the Standard\n1. Scope\n1/1 This standard covers leases of pro-\nperty [see item\n2/2 below] in full.\na) first point\n12\n(b) second point"),
    ("SS9", 3, "2. Rent\n2/1 Rent is due; see clause\n1/1 above.\n2/1 Repeated id.\n3. Date of Issuance of the Standard\n9/9 never seen"), ("SS9", 4, " \n"), ("SS8", 1, "1. and goes on\n7 things\n2. Fees"), ("SS7", 1, "Nothing here"),
]


def parsed(pages):
    """The grammar line by line: records, wrapped references, numeric lines outside records."""
    records, wrapped, numeric = [], [], []
    by = {}
    for s, p, text in sorted(pages):
        by.setdefault(s, []).append((p, [x for x in (" ".join(y.replace("­", "").split()) for y in (text or "").splitlines()) if x]))
    for s, own in by.items():
        started, depth, prev, clause, opened = False, 0, "", None, []
        over = False
        for p, lines in own:
            numbered = [x for x in lines if SECTION.match(x) and not CLAUSE.match(x)]
            toc = any(x.lower() == "contents" for x in lines) and (any(x.lower().startswith("subject page") for x in lines) or sum(bool(re.search(X.DOT_LEADER, x)) for x in lines) >= 2 or len(numbered) >= 4)
            if toc and not started:
                continue
            for x in lines:
                m = SECTION.match(x)
                if not started and m and m[1] == "1" and not CLAUSE.match(x):
                    started = True
                if not started or over:
                    continue
                if re.match(X.BACK_MATTER, x):
                    over = True
                    continue
                if re.match(X.HEADER, x) or re.match(X.PAGE_NUMBER, x) or x in ("Statement of the Standard", "Contents"):
                    continue
                m = CLAUSE.match(x) or SECTION.match(x)
                why = m and ("inside_unclosed_square_bracket" if depth else "preceding_line_ends_with_citation_cue" if re.search(X.CUE, prev) else "continuation_marker_after_identifier" if re.match(X.CONTINUATION, m[2]) else None)
                if why:
                    wrapped.append((s, p, m[1], why))
                    m = None
                b = None if m or (why and BULLET.match(x) is None) else BULLET.match(x)
                if m:
                    clause = m[1]
                    opened.append([clause, None, p, [m[2]]])
                elif b and clause:
                    opened.append([clause, b[1], p, [b[2]]])
                elif opened:
                    opened[-1][3].append(x)
                elif x[0].isdigit():
                    numeric.append((s, p))
                depth, prev = max(0, depth + x.count("[") - x.count("]")), x
        seen = {}
        for c, b, p, parts in opened:
            text = re.sub("-\x01(?=[a-zà-ÿ])", "", "\x01".join(parts)).replace("\x01", " ").strip()
            if text:
                records.append((s, c, b, seen.setdefault(c, 0), p, text))
                seen[c] += 1
    return sorted(records, key=repr), sorted(wrapped), sorted(numeric)


def frame(spark, pages):
    return X.normalise_lines(spark.createDataFrame(pages, "standard_id string, page int, text string"))


def agree(spark, pages, block):
    lines = frame(spark, pages)
    records, wrapped, numeric = parsed(pages)
    got = X.parse_clauses(lines, block=block).select("standard_id", "clause_id", "sub_clause_id", "occurrence_index", "source_page", "text").collect()
    assert sorted((tuple(r) for r in got), key=repr) == records
    opened = X.opened_lines(lines, block=block).collect()
    assert sorted((r["standard_id"], r["page"], r["candidate"], r["reason"]) for r in opened if r["reason"]) == wrapped
    assert sorted((r["standard_id"], r["page"]) for r in opened if r["clause_id"] is None and r["line"][0].isdigit()) == numeric
    return records, wrapped


def test_pages_by_hand(spark):
    records, wrapped = agree(spark, PAGES, 2)
    assert ("SS9", "1/1", None, 0, 2, "This standard covers leases of property [see item 2/2 below] in full.") in records
    assert [w[3] for w in wrapped] == ["continuation_marker_after_identifier", "inside_unclosed_square_bracket", "preceding_line_ends_with_citation_cue"]
    report = {r["standard_id"]: r for r in X.extraction_report(frame(spark, PAGES), X.parse_clauses(frame(spark, PAGES))).collect()}
    assert (report["SS9"]["start_page"], report["SS9"]["back_matter_page"], report["SS9"]["n_toc_pages"], report["SS9"]["failures"]) == (2, 3, 1, [])
    assert report["SS7"]["failures"] == ["normative_body_start_not_detected"]


@pytest.mark.parametrize("seed, block", [(1, 1), (2, 5)])
def test_random_lines_in_blocks(spark, seed, block):
    draw = random.Random(seed)
    forms = ["1. Scope", "2. Rent and", "1/1 first", "3/2/1 deep", "2/1", "a) point", "(iv) point", "words [open", "close] words", "see clause", "1/1 , and more", "half-", "lower case", "12", "7 things", "Contents", "Statement of the Standard", "3. ..... 9", "]]", "[[", "and 2. x", "Date of Issuance of Standard", "Shari'ah Standard No. (9)"]
    weights = [1 if "[" in x else 0.05 if x.startswith("Date") else 4 for x in forms]
    page = lambda: "\n".join(draw.choices(forms, weights, k=draw.randint(0, 12)))
    pages = [(s, p, page()) for s in ("A", "B", "C") for p in range(1, 31 if s == "A" else 5)] + [("D", 1, None)]
    records, wrapped = agree(spark, pages, block)
    assert records and len({w[3] for w in wrapped}) > 1


def test_no_lines(spark):
    lines = frame(spark, PAGES).limit(0)
    assert X.parse_clauses(lines).count() == 0
    lines = frame(spark, [("A", 1, "no section"), ("B", 1, "9 lives")])
    assert X.wrapped_references(lines).count() == 0 and X.unparsed_numeric(lines).count() == 0
    assert X.parse_clauses(lines).count() == 0


@pytest.mark.parametrize("fan", [3, 100])
def test_running_values_over_blocks_of_blocks(spark, fan):
    draw = random.Random(fan)
    rows = [(g, i, i // 3, draw.choice([None, *range(-3, 4)])) for g in ("x", "y") for i in range(100)]
    df = spark.createDataFrame(rows, "g string, pos int, block int, v int")
    run = {"order": "pos", "block": "block", "blocks": 34, "fan": fan}
    out = ordered.running(df, ["g"], {"s": ("sum", F.coalesce("v", F.lit(0))), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "la": ("last", F.col("v"))}, **run)
    out = ordered.before(ordered.running_low(out, ["g"], F.coalesce("v", F.lit(0)), "depth", **run), ["g"], F.col("pos"), "prev", **run)
    got = {(r["g"], r["pos"]): r for r in out.collect()}
    for g in ("x", "y"):
        seen, depth = [], 0
        for _, i, _, v in (r for r in rows if r[0] == g):
            r = got[g, i]
            assert r["depth"] == depth and r["prev"] == (i - 1 if i else None)
            depth = max(0, depth + (v or 0))
            seen += [v] if v is not None else []
            assert (r["s"], r["lo"], r["hi"], r["la"]) == (sum(seen), min(seen, default=None), max(seen, default=None), seen[-1] if seen else None)

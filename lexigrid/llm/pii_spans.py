r"""Personal data: candidate spans, boosted trees, calibrated thresholds; DataFrame operations only.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of a pattern for each
kind that pass a check; they always stay. High-recall generators propose further, overlapping spans:
numbers inside longer runs that fail a check as a whole, phone numbers without a country code,
spelt-out or split email addresses, and kinds beyond the base ones (IPv6 addresses, bank accounts,
secrets such as keys and passwords). Each candidate has format and context features, all small
integers. Boosted trees are fitted to labelled spans: texts whose personal data is marked, where a
label is what the span is, not a function of its features. Equal formats occur there with both
labels (a token and a commit's hash, a card and an order number), so context decides between them.
`labelled` takes a table of one's own; without one, `examples` writes EXAMPLES short texts from
rules, which is all the fit reads, at any size of the corpus. A fifth of the texts is left out of
the fit; on them each kind's threshold is the least score at which `precision` of the accepted
candidates are right. No check gates what the thresholds accept. Scoring is an expression. Texts are
read once and map-only: a document's candidates are computed in its row, without any shuffle, and
written as a table that scoring reads.

Patterns are written so that Java's engine works in linear time and without recursion on texts of
any length: possessive runs that start only where a run starts, bounded repeats, and
length-preserving replacements before them in place of repeated groups.

Defined results
* null text: empty, no spans. Every row gives a row, repeated doc_ids too.
* a kind without a right span among the labelled ones: nothing of it is added to the base spans.
* of accepted spans of one kind that overlap, the one with the best score stays (of equal ones the
  first, then the shortest); none overlaps a base span of its kind, and those of further kinds overlap no base span at all.
* very long texts: a row holds its text, its matches and nothing else that grows.
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import random
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import table, written

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method alone finds.
MORE = ("ip6", "account", "secret")
ALL = KINDS + MORE
LOCAL, LABEL = r"A-Za-z0-9._%+-", r"A-Za-z0-9-"
#: Matches of these on the prepared text are the base matches. \x01 stands for a dot that no label follows.
BASE = {
    "email": rf"(?:(?<![\x01{LOCAL}])|\G)[\x01{LOCAL}]++@[{LABEL}]++\.[.{LABEL}]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][\x20\-0-9]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to occur.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_AT, _DOT = r"(?:[\x20]?[\[({][\x20]?at[\x20]?[\])}][\x20]?|[\x20]at[\x20]|[\x20]?@[\x20]?)", r"(?:[\x20]?[\[({][\x20]?dot[\x20]?[\])}][\x20]?|[\x20]dot[\x20]|\.|[\x20]\.[\x20])"
#: (kind, pattern, what a text must hold for it) of the generators that come after the base patterns.
GENERATORS = (
    ("card", r"(?<![0-9])[0-9]{12,19}(?![0-9])", "[0-9]{12}"),
    ("card", r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])", "[0-9]{4}[\\x20-][0-9]{4}"),
    ("card", r"(?<=[0-9][\x20-])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\x20-]?[0-9])", "[0-9]{4}[\\x20-][0-9]{4}"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?[\x20.-]?[0-9]{2,4}[\x20.-]?[0-9]{3,4}(?![0-9])", r"\+[0-9]"),
    ("phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])", "[0-9]{3}[\\x20.-][0-9]{4}"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])", r"[0-9]\.[0-9]"),
    ("email", rf"(?i)(?<![{LOCAL}])[{LOCAL}]{{1,64}}+{_AT}[{LABEL}]{{1,63}}+(?:{_DOT}[{LABEL}]{{1,63}}+){{1,3}}", r"(?i)[\[({\x20]at[\])}\x20]|@"),
    ("ip6", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", ":[0-9A-Fa-f]{0,4}:"),
    ("account", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", "[A-Z]{2}[0-9]{2}"),
    ("secret", r"(?<![A-Za-z0-9_/+-])(?=[0-9_/+=-]{0,127}[A-Za-z])(?=[A-Za-z_/+=-]{0,127}[0-9])[A-Za-z0-9_/+-]{12,128}={0,2}(?![A-Za-z0-9_/+=-])", "[A-Za-z0-9]{12}|[_/+-]"),
)
#: Words that stand before a span, by what they tell of it.
CONTEXT = {
    "says_phone": "tel|phone|call|fax|mobile|cell|ring|whatsapp",
    "says_card": "card|visa|mastercard|amex|credit|debit|payment",
    "says_net": "server|host|address|ip|gateway|dns|ping|route|subnet",
    "says_mail": "mail|contact|write|reach|reply|inbox",
    "says_bank": "iban|account|bank|transfer|beneficiary|konto|compte|cuenta",
    "says_secret": "token|secret|passw|pwd|api.?key|access.?key|private.?key|bearer|credential|auth|key",
    "says_other": "order|invoice|version|isbn|commit|sha|md5|hash|checksum|build|part|serial|ticket|section|chapter|ratio|time|revision|file|path|model|page|no\\.|uuid|digest",
}
SHAPES = ("kind", "generator", "check", "length", "digits", "letters", "upper", "plus", "seps", "colons", "hex", "known", "inside", "before", "after", "lead", "written")
FEATURES = (*SHAPES, *CONTEXT)
TREES, DEPTH, RATE = 60, 4, 0.3
EXAMPLES = 4000
CHUNK = 256
PIECE = 256


def _prepared(text: Column, kind: str) -> Column:
    """The text, of the same length, as the kind's base pattern wants it."""
    if kind == "email":
        return F.regexp_replace(F.translate(text, "\x01", "\x02"), rf"\.(?![{LABEL}])", "\x01")
    if kind == "card":  # separators that don't stand alone between digits part numbers
        return F.regexp_replace(text, r"[\x20-](?![0-9])|(?<![0-9])[\x20-]", "\x00")
    return text


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, wherever body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: All matches of a pattern in a text, as SQL, which parses faster than nested lambdas are put together. Offsets are sums of the lengths of gaps and matches before, taken by chunks, so the work is about in proportion to the matches.
_FIND = """
element_at(transform(array(arrays_zip(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0))), z ->
element_at(transform(array(transform(z, x -> cast(length(x.`0`) + length(coalesce(x.`1`, '')) AS bigint))), sizes ->
element_at(transform(array(transform(sequence(0, cast(floor((size(sizes) - 1) / {chunk}) AS int)), c -> aggregate(slice(sizes, c * {chunk} + 1, {chunk}), 0L, (a, x) -> a + x))), own ->
element_at(transform(array(transform(sequence(0, size(own) - 1), c -> aggregate(slice(own, 1, c), 0L, (a, x) -> a + x))), before ->
transform(slice(z, 1, size(z) - 1), (x, i) ->
element_at(transform(array(element_at(before, cast(floor(i / {chunk}) AS int) + 1) + aggregate(slice(sizes, cast(floor(i / {chunk}) AS int) * {chunk} + 1, i % {chunk}), 0L, (a, y) -> a + y) + length(x.`0`)), at ->
named_struct('s', at, 'e', at + length(x.`1`), 't', x.`1`)), 1))), 1)), 1)), 1)), 1)"""


def _matches(text: str, pattern: str) -> Column:
    """array<struct<s, e, t>> of all matches in a column: offsets in code points."""
    return F.expr(_FIND.format(text=text, pattern="r'" + pattern + "'", chunk=CHUNK))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes; doubles every second digit from the right."""
    n = F.length(digits)

    def add(total, i):
        d = F.substr(digits, n - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _parts_fit(t: Column) -> Column:
    """All dotted numbers are at most 255, whatever zeros lead them."""

    def fits(p):
        own = F.regexp_replace(p, "^0+", "")
        return (F.length(own) <= 3) & (F.coalesce(F.when(F.length(own) <= 3, own).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(t, r"\."), fits)


def valid(kind: Column, t: Column) -> Column:
    """A kind's check of a span's text; kind is a place in ALL."""
    digits = _digits(t)
    n = F.length(digits)
    card = F.when((n >= 12) & (n <= 19), luhn(digits)).otherwise(False)
    return F.when(kind == KINDS.index("ip"), _parts_fit(t)).when(kind == KINDS.index("card"), card).when(kind == KINDS.index("phone"), (n >= 9) & (n <= 15)).otherwise(True)


def _may_hold(text: Column, kind: str) -> Column:
    return text.contains(NEEDS[kind]) & text.rlike("[0-9]") if kind != "email" else text.contains("@")


def _class(c: Column) -> Column:
    """0 nothing, 1 space, 2 letter or digit, 3 a quote, 4 = or :, 5 another character."""
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}\p{N}]"), 2).when(c.rlike("[\"'`]"), 3).when(c.rlike("[=:]"), 4).otherwise(5)


def _how_many(t: Column, others: str, most: int) -> Column:
    return F.least(F.length(F.regexp_replace(t, others, "")), F.lit(most))


def _stretch(pieces: Column, at: Column, n: int) -> Column:
    """n code points from offset `at` of a text that is cut into pieces of PIECE: two pieces are looked at, wherever that is in the text."""
    no = F.floor(at / PIECE).cast("int")
    two = F.concat(F.coalesce(F.try_element_at(pieces, no + 1), F.lit("")), F.coalesce(F.try_element_at(pieces, no + 2), F.lit("")))
    return F.substr(two, at - no * PIECE + 1, F.lit(n))


def _candidate(pieces: Column, x: Column) -> Column:
    """A match (k, g, s, e, t) as struct: place, validity and features."""
    t, s, e = x["t"], x["s"].cast("int"), x["e"].cast("int")
    ok = valid(x["k"], t)
    before = F.right(F.left(_stretch(pieces, F.greatest(s - 32, F.lit(0)), 32), F.least(s, F.lit(32))), F.lit(32))
    values = {
        "kind": x["k"], "generator": x["g"], "check": ok.cast("int"), "length": F.floor(F.least(F.length(t), F.lit(64)) / 2),
        "digits": _how_many(t, "[^0-9]", 40), "letters": _how_many(t, "[^A-Za-z]", 40), "upper": _how_many(t, "[^A-Z]", 8), "plus": t.startswith("+").cast("int"),
        "seps": _how_many(t, "[^\\x20.()-]", 5), "colons": _how_many(t, "[^:]", 8), "hex": t.rlike("^[0-9a-fA-F]+$").cast("int"),
        "known": t.rlike("^(?:AKIA|ASIA|gh[pousr]_|sk[-_]|pk[-_]|xox[abp]-|AIza|eyJ|glpat-)").cast("int"),
        "inside": before.rlike(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4})*[\x20]?$").cast("int"),
        "before": F.when(s > 0, _class(F.right(before, F.lit(1)))).otherwise(0), "after": _class(_stretch(pieces, e, 1)),
        "lead": F.coalesce(F.substr(_digits(t), F.lit(1), F.lit(1)).try_cast("int"), F.lit(0)),
        "written": F.when(t.rlike(r"(?i)[\[({][\x20]?at[\x20]?[\])}]"), 3).when(t.rlike(r"(?i)[\x20]dot[\x20]"), 2).when(t.contains(" @") | t.contains("@ "), 1).otherwise(0),
    }
    values |= {name: before.rlike(rf"(?i)(?<![A-Za-z])(?:{words})[^\n]{{0,14}}$").cast("int") for name, words in CONTEXT.items()}
    return F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), ok.alias("ok"), *[values[f].cast("int").alias(f) for f in FEATURES])


def candidates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", also: tuple = ()) -> DataFrame:
    """doc_id, base (array of k, s, e) and found (array of all candidates with features) for each row, and the columns named in also."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *also)
    t, none = F.col("text"), F.array().cast("array<struct<s:bigint,e:bigint,t:string>>")
    # the matches become columns of their own, so that each pattern runs once over a text
    own = {f"g{i}": F.coalesce(F.when(t.rlike(needs), _matches("text", p)), none) for i, (_, p, needs) in enumerate(GENERATORS)}
    rows = rows.withColumns({f"p{k}": F.when(_may_hold(t, kind), _prepared(t, kind)) for k, kind in enumerate(KINDS)})
    rows = rows.withColumns({f"b{k}": F.coalesce(_matches(f"p{k}", BASE[kind]), none) for k, kind in enumerate(KINDS)} | own)
    sources = [(k, 0, f"b{k}") for k in range(len(KINDS))] + [(ALL.index(kind), i + 1, f"g{i}") for i, (kind, _, _) in enumerate(GENERATORS)]
    # numbers that are too short for a card are too many to look at one by one
    enough = lambda x: F.length(_digits(x["t"])) >= 12
    named = lambda k, g: lambda x: F.struct(F.lit(k).alias("k"), F.lit(g).alias("g"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"))
    every = F.concat(*[F.transform(F.filter(c, enough) if k == KINDS.index("card") else F.col(c), named(k, g)) for k, g, c in sources])
    # a text is walked once, into pieces; a substring of the text for each match would walk it from its start each time
    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    found = F.when(F.size(every) > 0, _let(pieces, lambda p: F.transform(every, partial(_candidate, p))))
    rows = rows.withColumn("found", found)
    rows = rows.select("doc_id", F.coalesce("found", F.array().cast(rows.schema["found"].dataType)).alias("found"), *also)
    base = F.transform(F.filter("found", lambda c: (c["generator"] == 0) & c["ok"]), lambda c: F.struct(c["k"], c["s"], c["e"]))
    return rows.select("doc_id", F.array_sort(F.transform(base, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))).alias("base"), "found", *also)


def examples(n: int = EXAMPLES, seed: int = 19) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n short texts with their personal data as (kind, start, end): right spans with and without telling words before them, and others of the same shapes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ba", "ren", "ti", "lo", "chi", "sa", "un", "der", "mo", "est")) for _ in range(rng.randint(1, 4)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(k))
    pick = lambda *xs: rng.choice(xs)

    def card(right=True):
        d = pick("4", "51", "37", "6011") + digits(11)
        d += digits(15 - len(d))
        total = sum(2 * x - 9 if i % 2 == 0 and x > 4 else 2 * x if i % 2 == 0 else x for i, x in enumerate(map(int, reversed(d))))
        d += str((-total + (0 if right else rng.randint(1, 9))) % 10)
        return pick(d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)))

    def plus():
        return pick(f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+44 20 {digits(4)} {digits(4)}", f"+49-30-{digits(4)}-{digits(4)}", f"+33{digits(9)}")

    def home():
        return pick(f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}")

    def mail():
        name, host, end = f"{word()}{pick('', '.', '_')}{word()}{pick('', digits(2))}", pick("mail", "post", word()) + pick("", digits(1)), pick("com", "org", "net", "example.com")
        dots = lambda by: by.join((host, *end.split(".")))
        return pick(f"{name} (at) {dots(' (dot) ')}", f"{name} [at] {dots('.')}", f"{name}[at]{dots('[dot]')}", f"{name} at {dots(' dot ')}", f"{name} @ {dots('.')}", f"{name}@ {dots('.')}")

    def six():
        parts = [hexes(rng.randint(1, 4)) for _ in range(8)]
        return pick(":".join(parts), f"2001:db8::{hexes(4)}:{hexes(3)}", f"fe80::{hexes(4)}:{hexes(4)}:{hexes(4)}", f"2001:{':'.join(parts[:5])}::1")

    def account():
        d = f"{pick('DE', 'FR', 'ES', 'GB')}{digits(2)}{digits(18)}"
        return pick(d, " ".join(d[i : i + 4] for i in range(0, 22, 4)))

    secret = lambda: pick(hexes(32), hexes(40), hexes(64), mixed(24), mixed(32), f"AKIA{mixed(16).upper()}", f"ghp_{mixed(36)}", f"sk-{mixed(40)}")
    told = lambda *xs: pick(*xs) + pick(" ", ": ", " is ", " = ")
    named = lambda: pick("token", "secret", "password", "api_key", "access key", "auth token", "private_key", "API-KEY", "bearer")
    other = lambda: told("order", "invoice", "ticket", "serial", "part", "order no.", "ISBN", "build")

    def right():
        which = rng.randrange(8)
        if which == 0:
            return pick("", told("card", "Visa", "credit card", "payment")), "card", card(), ""
        if which == 1:
            return told("credit card", "visa card", "card"), "card", card(right=False), ""
        if which == 2:
            return pick("", told("tel", "phone", "call", "mobile")), "phone", plus(), ""
        if which == 3:
            return told("tel", "phone", "call", "mobile", "fax"), "phone", home(), ""
        if which == 4:
            return pick("", told("mail", "contact", "write to", "reply to")), "email", mail(), ""
        if which == 5:
            return pick("", told("host", "server", "IP", "address")), "ip6", six(), ""
        if which == 6:
            return pick("", told("IBAN", "account", "bank account", "transfer to")), "account", account(), ""
        q = pick("", '"', "'")
        return f"{named()}{pick(' = ', '=', ': ', ' ')}{q}", "secret", secret(), q

    def wrong():
        which = rng.randrange(9)
        if which == 0:
            return pick("", other()), None, card(right=False), ""
        if which == 1:
            return other(), None, card(), ""
        if which == 2:
            return pick("", other()), None, home(), ""
        if which == 3:
            return pick("meet us", "look", "shown", "arrived") + " ", None, f"at {word()}{pick('.', '. ')}{word()}", ""
        if which == 4:
            return pick("", told("time", "ratio", "at")), None, pick(f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(1)}:{digits(1)}:{digits(1)}", ":".join(hexes(2) for _ in range(6))), ""
        if which == 5:
            return pick("", other()), None, pick(f"{mixed(2).upper()}{digits(2)} {digits(4)} {digits(4)}", f"{mixed(2).upper()}{digits(14)}"), ""
        if which == 6:
            return told("commit", "sha", "checksum", "md5", "revision", "digest", "file", "uuid"), None, pick(hexes(40), hexes(32), hexes(64), f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(12)}"), ""
        if which == 7:
            return pick("", "see "), None, pick(hexes(40), hexes(32), mixed(24), f"{word()}-{word()}-{digits(4)}-{word()}", f"{word()}/{word()}{digits(2)}/{word()}", f"{word()}{word()}{word()}{digits(2)}"), ""
        return pick("", other()), None, digits(rng.randint(12, 19)), ""

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(0, 6)))
            text += pick(" ", ". ", "\n", " | ") if text else ""
            before, kind, value, after = right() if rng.random() < 0.5 else wrong()
            if kind:
                spans.append((kind, len(text) + len(before), len(text) + len(before) + len(value)))
            text += before + value + after + pick(" ", ". ", ", ", "\n", " | ")
        out.append((text + " ".join(word() for _ in range(rng.randint(0, 3))), spans))
    return out


def example_table(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """doc_id, text, spans (array of kind, start, end) of examples()."""
    rows = [{"doc_id": i, "text": t, "spans": [{"kind": k, "start": s, "end": e} for k, s, e in spans]} for i, (t, spans) in enumerate(examples(n))]
    schema = "array<struct<doc_id:bigint,text:string,spans:array<struct<kind:string,start:bigint,end:bigint>>>>"
    parts = [F.from_json(F.lit(json.dumps(rows[i : i + 500])), schema) for i in range(0, len(rows), 500)]
    return spark.range(1).select(F.inline(F.concat(*parts))).repartition(spark.sparkContext.defaultParallelism, "doc_id")


class Trees:
    """Boosted trees over integer features; a tree is a leaf value or (feature, bound, tree if <= bound, tree if above). thresholds: of each kind, infinite where it has none."""

    def __init__(self, start: float, trees: list):
        self.start, self.trees, self.thresholds = start, trees, [math.inf] * len(ALL)

    def score(self, x: dict) -> float:
        def at(tree):
            while isinstance(tree, tuple):
                tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
            return tree

        return self.start + sum(map(at, self.trees))

    def column(self, c: Column) -> Column:
        """The same as an expression over a candidate."""

        def at(tree):
            return F.when(c[tree[0]] <= tree[1], at(tree[2])).otherwise(at(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

        out = F.lit(float(self.start))
        for tree in self.trees:
            out = out + at(tree)
        return out

    def accepts(self, kind: Column, score: Column) -> Column:
        return score >= F.element_at(F.array(*map(F.lit, self.thresholds)), kind + 1)


def boost(cells: list[tuple[dict, float, float]], *, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Newton boosting of the logistic loss over (features, positives, negatives)."""
    import numpy as np

    x = np.array([[c[0][f] for f in FEATURES] for c in cells], "i8")
    pos, all_ = np.array([c[1] for c in cells], "f8"), np.array([c[1] + c[2] for c in cells], "f8")
    share = (pos.sum() + 0.5) / (all_.sum() + 1)
    raw = np.full(len(x), math.log(share / (1 - share)))
    bounds = [(f, int(v)) for f in range(len(FEATURES)) for v in np.unique(x[:, f])[:-1]]
    below = np.stack([x[:, f] <= v for f, v in bounds], 1).astype("f8") if bounds else np.zeros((len(x), 0))

    def grow(rows, grad, hess, left):
        g, h = grad[rows].sum(), hess[rows].sum()
        if left and bounds:
            gl, hl = grad[rows] @ below[rows], hess[rows] @ below[rows]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            best = int(gain.argmax())
            low = below[rows, best] > 0
            if gain[best] > 1e-6 and low.any() and not low.all():
                f, v = bounds[best]
                return (FEATURES[f], v, grow(rows[low], grad, hess, left - 1), grow(rows[~low], grad, hess, left - 1))
        value = rate * g / (h + 1)
        raw[rows] += value
        return float(value)

    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        out.append(grow(np.arange(len(x)), pos - all_ * p, all_ * p * (1 - p), depth))
    return Trees(math.log(share / (1 - share)), out)


def fit(labelled: DataFrame, *, precision: float = 0.99, doc_id: str = "doc_id", text: str = "text", spans: str = "spans") -> Trees | None:
    """The model out of labelled texts (spans: array of kind, start, end); None without examples of both sorts. A fifth of the rows by a hash of doc_id calibrates."""
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(spans).alias("spans"))
    each = candidates(rows, also=("spans",)).select(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(5)).alias("fold"), F.coalesce("spans", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("spans"), F.explode("found").alias("c"))
    names = F.array(*map(F.lit, ALL))
    right = F.exists("spans", lambda b: (b["kind"] == F.element_at(names, F.col("c.k") + 1)) & (b["start"] == F.col("c.s")) & (b["end"] == F.col("c.e")))
    each = each.select((F.col("fold") == 0).alias("last"), right.alias("y"), *[F.col(f"c.{f}").alias(f) for f in FEATURES])
    counts = each.groupBy("last", *FEATURES).agg(F.sum(F.col("y").cast("int")).alias("pos"), F.sum((~F.col("y")).cast("int")).alias("neg"))
    rows = counts.collect()  # as many as there are combinations of features among the labelled candidates
    cells = {last: [({f: r[f] for f in FEATURES}, r["pos"], r["neg"]) for r in sorted(rows, key=lambda r: [r[f] for f in FEATURES]) if r["last"] == last] for last in (False, True)}
    if not sum(c[1] for c in cells[False]) or not sum(c[2] for c in cells[False]):
        return None
    model = boost(cells[False])
    for k in range(len(ALL)):
        judged = sorted(((model.score(x), p, n) for x, p, n in cells[True] or cells[False] if x["kind"] == k), key=lambda r: -r[0])
        threshold, pos, all_ = math.inf, 0, 0
        for i, (s, p, n) in enumerate(judged):
            pos, all_ = pos + p, all_ + p + n
            if pos >= precision * all_ and pos and (i + 1 == len(judged) or judged[i + 1][0] < s):
                threshold = s
        model.thresholds[k] = max(threshold, 0.0)  # never less likely than not
    return model


def _shipped(spark: SparkSession, precision: float) -> Trees | None:
    """The model out of example_table(), the same in every run, so fitted once an application."""
    held = spark.sparkContext.__dict__.setdefault("_lexigrid_spans", {})
    if precision not in held:
        held[precision] = fit(example_table(spark), precision=precision)
    return held[precision]


def find_spans(docs: DataFrame, *, labelled: DataFrame | None = None, precision: float = 0.99, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans for each row of docs: arrays of (s, k, e) in the order of s, k, e; k is a place in ALL. spans holds the base spans and the accepted candidates. labelled: doc_id, text, spans; else example_table()."""
    model = _shipped(docs.sparkSession, precision) if labelled is None else fit(labelled, precision=precision)
    found = written(candidates(docs, doc_id=doc_id, text=text), "candidates")  # the texts are read once, here
    if model is None:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    scored = F.transform("found", lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), model.column(c).alias("v")))
    out = found.select("doc_id", "base", F.filter(scored, lambda c: model.accepts(c["k"], c["v"])).alias("accepted"))
    more = _best(_apart(F.col("base"), F.col("accepted")))
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.when(F.size("accepted") > 0, more).otherwise(F.slice("base", 1, 0)))).alias("spans"))


def _pushed(st: Column, x: Column, when: Column) -> list[Column]:
    """A fold's `cur` and `done` with x behind them, if so: full stretches of CHUNK go to `done`, as appending to one long array copies all of it each time."""
    full = when & (F.size(st["cur"]) >= CHUNK)
    done = F.when(full, F.concat(st["done"], F.array(st["cur"]))).otherwise(st["done"])
    return [F.when(full, F.array(x)).when(when, F.concat(st["cur"], F.array(x))).otherwise(st["cur"]).alias("cur"), done.alias("done")]


_ALL_OF = lambda st: F.flatten(F.concat(st["done"], F.array(st["cur"])))


def _apart(base: Column, accepted: Column) -> Column:
    """The accepted spans (k, s, e, v) that overlap no base span of their kind, or of any kind where they are of a kind without a base.

    Base spans come in the order of their starts, a candidate before the base spans that start at its end or later: it overlaps
    one of those before it if the furthest of their ends lies beyond its start."""
    waits = "struct<k:int,s:bigint,e:bigint,v:double>"
    event = lambda at, t, k, s, e, v: F.struct(at.alias("at"), F.lit(t).alias("t"), F.struct(k.cast("int").alias("k"), s.alias("s"), e.alias("e"), v.cast("double").alias("v")).alias("c"))
    events = F.array_sort(F.concat(F.transform(base, lambda b: event(b["s"], 1, b["k"], b["s"], b["e"], F.lit(0.0))), F.transform(accepted, lambda c: event(c["e"], 0, c["k"], c["s"], c["e"], c["v"]))))
    n = len(KINDS)
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), n + 1).alias("ends"), F.array().cast(f"array<{waits}>").alias("cur"), F.array().cast(f"array<array<{waits}>>").alias("done"))

    def step(st, x):
        c, is_base = x["c"], x["t"] == 1
        ends = F.transform(st["ends"], lambda y, i: F.when(is_base & ((i == c["k"]) | (i == n)), F.greatest(y, c["e"])).otherwise(y))
        free = F.element_at(st["ends"], F.least(c["k"], F.lit(n)) + 1) <= c["s"]
        return F.struct(ends.alias("ends"), *_pushed(st, c, ~is_base & free))

    return F.aggregate(events, start, step, _ALL_OF)


def _best(spans: Column) -> Column:
    """Along the text, the best by v of overlapping spans of a kind waits until one comes that it doesn't overlap: array of (s, k, e)."""
    waits, out = "struct<k:int,s:bigint,e:bigint,v:double>", "struct<s:bigint,k:int,e:bigint>"
    start = F.struct(F.lit(None).cast(waits).alias("w"), F.array().cast(f"array<{out}>").alias("cur"), F.array().cast(f"array<array<{out}>>").alias("done"))
    span = lambda w: F.struct(w["s"].alias("s"), w["k"].alias("k"), w["e"].alias("e"))

    def take(st, c):
        w = st["w"]
        apart = F.coalesce((c["k"] != w["k"]) | (c["s"] >= w["e"]), F.lit(True))
        best = F.when(apart | (c["v"] > w["v"]), c).otherwise(w).cast(waits)
        return F.struct(best.alias("w"), *_pushed(st, span(w), apart & w.isNotNull()))

    return F.aggregate(F.array_sort(spans), start, take, lambda st: F.concat(_ALL_OF(st), F.when(st["w"].isNotNull(), F.array(span(st["w"]))).otherwise(F.array().cast(f"array<{out}>"))))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, ALL))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _is_kind(k: int):
    return lambda b: b["k"] == k


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    more = [F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added")]
    return out.select("doc_id", *counts, F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), *more)

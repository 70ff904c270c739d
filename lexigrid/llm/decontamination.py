r"""Benchmark decontamination: a set join of item windows with documents, filtered by each window's rarest shingle.

A window is `width` consecutive words of an item, or all of a shorter one. Documents are read twice. The first pass counts the windows'
shingles (runs of three words) over all documents, which orders them by rarity. As a window that a document contains has all of
its shingles there, a prefix of one suffices: the second pass looks up the rarest shingle of each window only, and what
it finds must pass the positional bound (the window begins at the shingle's place less its offset and ends within the text) and
the length bound (as many bytes) before its words are compared.

The windows are a stated query set: pairs of window and item are dealt by hash into blocks of about `block` pairs, so what is broadcast has a
bound whatever the benchmark's size. One block needs no shuffle of documents at all. Beyond it, documents are
written once with row numbers, each block takes the two passes, and the hits of a row are joined by its number.

Defined results
* null or empty texts, and texts without words, have no words and no hits; a null item_id counts as the empty text.
* repeated documents are rows of their own, whatever their ids; repeated items count once. An id of several texts is one item.
* without documents there are no rows; without benchmark windows nothing is hit.
* very long texts are worked on in pieces that overlap by a window less one word.
* other columns pass through in a struct, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigrid.llm._shared import ship, table, tidy, written

WIDTH, SHINGLE = 10, 3
BLOCK = 200_000
SPANS = "array<struct<start:int,stop:int>>"


def _item_windows(batches, width: int):
    import pyarrow as pa

    from lexigrid.llm._words import chunks, packed

    for batch in batches:
        items = batch.column(0)
        for c in chunks(batch.column(1), width - 1):
            text, begins = packed(c)
            windows, at = [], []
            for j, row in enumerate(c.rows):
                a, b = int(c.first[j]), int(c.first[j + 1])
                n = b - a
                if not n or not c.own[j]:
                    continue
                if n < width and c.base[j]:
                    continue  # the end of a long item, already in the windows before
                for k in range(a, max(b - width, a) + 1):
                    if k < a + c.own[j]:
                        windows.append(text[begins[k] : begins[min(k + width, b)] - 1].tobytes().decode("utf-8", "replace"))
                        at.append(int(row))
        yield pa.RecordBatch.from_arrays([items.take(pa.array(at, pa.int64())).cast(pa.string()), pa.array(windows, pa.string())], names=["item", "window"])


def item_windows(benchmark: DataFrame, *, width: int = WIDTH, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, window: the distinct windows of each item, words joined by a space."""
    ship(benchmark.sparkSession)
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _item_windows(b, width), "item string, window string").distinct()


class Index:
    """The windows of a block with their shingles, as arrays that look up a chunk's words.

    shingles: {length: sorted hashes}. rarest() keeps, after counting, one shingle a window."""

    def __init__(self, pairs: list[tuple[str, str]]):
        import numpy as np

        by: dict[str, list[str]] = {}
        for item, window in pairs:
            by.setdefault(window, []).append(item)
        self.windows = [w.encode() for w in by]
        self.items = list(by.values())
        self.sizes = np.array([w.count(b" ") + 1 for w in self.windows], "i4")
        self.bytes = np.array([len(w) for w in self.windows], "i4")
        self.of: dict[int, tuple] = {}
        hashes: dict[int, list] = {}
        for k, h in enumerate(self._hashes()):
            hashes.setdefault(min(SHINGLE, int(self.sizes[k])), []).append((k, h))
        for n, rows in hashes.items():
            windows = np.concatenate([np.full(len(h), k) for k, h in rows])
            offsets = np.concatenate([np.arange(len(h)) for _, h in rows])
            self.of[n] = (windows, offsets, np.concatenate([h for _, h in rows]))
        self.shingles = {n: np.unique(h) for n, (_, _, h) in self.of.items()}
        self.filters = {n: self._filter(h) for n, h in self.shingles.items()}

    def _hashes(self):
        import pyarrow as pa

        from lexigrid.llm._words import chunks, run_hashes, word_hashes

        for c in chunks(pa.array(self.windows, pa.binary()).cast(pa.string())):
            words = word_hashes(c)
            for a, b in zip(c.first, c.first[1:]):
                yield run_hashes(words[a:b], min(SHINGLE, int(b - a)))

    @staticmethod
    def _filter(hashes):
        import numpy as np

        bits = max(16, int(len(hashes) * 16).bit_length())
        seen = np.zeros(1 << bits, bool)
        seen[(hashes >> np.uint64(64 - bits)).astype("i8")] = True
        return bits, seen

    def found(self, words, n: int):
        """Places of a chunk's words whose run of n is a shingle here, and the shingles' numbers."""
        import numpy as np

        from lexigrid.llm._words import run_hashes

        hashes = run_hashes(words, n)
        bits, seen = self.filters[n]
        at = np.flatnonzero(seen[(hashes >> np.uint64(64 - bits)).astype("i8")])
        own, all_ = hashes[at], self.shingles[n]
        no = np.minimum(np.searchsorted(all_, own), len(all_) - 1)
        same = all_[no] == own
        return at[same], no[same]

    def rarest(self, counts: dict[int, dict[int, int]]) -> Index:
        """The same with the shingles that occur least in the documents, one for each window; the first of equals by hash."""
        import numpy as np

        for n, (windows, offsets, hashes) in self.of.items():
            numbers = np.searchsorted(self.shingles[n], hashes)
            many = np.zeros(len(self.shingles[n]), "i8")
            own = counts.get(n, {})
            many[list(own)] = list(own.values())
            order = np.lexsort((offsets, hashes, many[numbers], windows))
            _, first = np.unique(windows[order], return_index=True)
            keep = order[first]
            keep = keep[many[numbers[keep]] > 0]  # a window whose rarest shingle is nowhere is nowhere
            keep = keep[np.argsort(hashes[keep], kind="stable")]
            self.of[n] = (windows[keep], offsets[keep], hashes[keep])
            self.shingles[n], starts = np.unique(hashes[keep], return_index=True)
            self.filters[n] = self._filter(self.shingles[n])
            self.of[n] += (np.r_[starts, len(keep)],)
        return self


def _counted(batches, index):
    """n, shingle, times: each of the block's shingles by its number, once a partition."""
    import numpy as np
    import pyarrow as pa

    from lexigrid.llm._words import chunks, word_hashes

    index = index.value
    counts = {n: np.zeros(len(h), "i8") for n, h in index.shingles.items()}
    for batch in batches:
        for c in chunks(batch.column(0), SHINGLE - 1):
            words = word_hashes(c)
            place, piece = c.inside()
            for n in counts:
                at, no = index.found(words, n)
                ok = (at + n <= c.first[piece[at] + 1]) & (place[at] < c.own[piece[at]])
                counts[n] += np.bincount(no[ok], minlength=len(counts[n]))
    for n, c in counts.items():
        at = np.flatnonzero(c)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, "i4")), pa.array(at.astype("i4")), pa.array(c[at])], names=["n", "shingle", "times"])


def _occurrences(c, index):
    """piece, start, stop and window of the windows that occur in a chunk; words count from the piece's first."""
    import numpy as np

    from lexigrid.llm._words import packed, word_hashes

    words = word_hashes(c)
    place, piece = c.inside()
    text = begins = None
    for n, (windows, offsets, _, starts) in index.of.items():
        if not len(windows):
            continue
        at, no = index.found(words, n)
        if not len(at):
            continue
        many = starts[no + 1] - starts[no]
        entry = np.repeat(starts[no], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(at, many)
        window, begin = windows[entry], at - offsets[entry]
        stop, own = begin + index.sizes[window], piece[at]
        ok = (begin >= c.first[own]) & (stop <= c.first[own + 1])  # the positional bound
        window, begin, stop, own = window[ok], begin[ok], stop[ok], own[ok]
        ok = place[begin] < c.own[own]
        window, begin, stop, own = window[ok], begin[ok], stop[ok], own[ok]
        if not len(begin):
            continue
        if text is None:
            text, begins = packed(c)
            text = text.tobytes()
        ok = begins[stop] - 1 - begins[begin] == index.bytes[window]  # the length bound
        for w, a, b, p in zip(window[ok].tolist(), begin[ok].tolist(), stop[ok].tolist(), own[ok].tolist()):
            if text[begins[a] : begins[b] - 1] == index.windows[w]:
                yield p, a - int(c.first[p]), b - int(c.first[p]), w


def _merged(spans: list) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "stop": b} for a, b in out]


def _scanned(batches, index, width: int):
    """row (a struct), text to row, n_words, spans, items."""
    import pyarrow as pa

    from lexigrid.llm._words import chunks

    index = index.value
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        n_words = [0] * batch.num_rows
        spans: dict[int, list] = {}
        items: dict[int, set] = {}
        for c in chunks(batch.column(1), width - 1):
            for row, n in zip(c.rows.tolist(), c.own.tolist()):
                n_words[row] += n
            for p, a, b, w in _occurrences(c, index):
                row, base = int(c.rows[p]), int(c.base[p])
                spans.setdefault(row, []).append((base + a, base + b))
                items.setdefault(row, set()).update(index.items[w])
        none: list = []
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array([_merged(spans[i]) if i in spans else none for i in range(batch.num_rows)], kind), pa.array([sorted(items[i]) if i in items else none for i in range(batch.num_rows)], pa.list_(pa.string()))],
            names=["row", "n_words", "spans", "items"],
        )


def _scan(docs: DataFrame, pairs: list, width: int) -> DataFrame:
    """docs (row, text) with n_words, spans and items in place of text, for one block of pairs."""
    spark = docs.sparkSession
    index = Index(pairs)
    shared = spark.sparkContext.broadcast(index)
    counts: dict[int, dict[int, int]] = {}
    if pairs:
        told = docs.select("text").mapInArrow(lambda b: _counted(tidy(b), shared), "n int, shingle int, times long").groupBy("n", "shingle").agg(F.sum("times").alias("times"))
        for r in told.collect():  # as many as the block has shingles at most
            counts.setdefault(r["n"], {})[r["shingle"]] = r["times"]
    rare = spark.sparkContext.broadcast(index.rarest(counts))
    schema = StructType([docs.schema["row"], *StructType.fromDDL(f"n_words long, spans {SPANS}, items array<string>")])
    return docs.mapInArrow(lambda b: _scanned(tidy(b), rare, width), schema)


def _joined_spans(spans):
    """Spans of several blocks as one sorted list without overlaps."""
    last = lambda s: F.element_at(s, -1)
    span = lambda a, b: F.struct(a.alias("start"), b.alias("stop"))
    step = lambda s, x: F.when((F.size(s) > 0) & (F.coalesce(F.try_element_at(s, F.lit(-1))["stop"], F.lit(-1)) >= x["start"]), F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(span(last(s)["start"], F.greatest(last(s)["stop"], x["stop"]))))).otherwise(F.concat(s, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), step)


def contamination(docs: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None, width: int = WIDTH, block: int = BLOCK, text: str = "text") -> DataFrame:
    """row (a struct of the columns to keep, all if None), n_words, spans (the hit words' numbers, without overlaps) and items (distinct, sorted)."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row"), docs[text].cast("string").alias("text"))
    windows = written(item_windows(benchmark, width=width), "windows")
    n = windows.count()
    if n <= block:
        return _scan(rows, [tuple(r) for r in windows.collect()], width)
    blocks = -(-n // block)
    numbered = written(rows.withColumn("no", F.monotonically_increasing_id()), "contamination-rows")
    told, words = None, None
    for i in range(blocks):
        pairs = [tuple(r) for r in windows.filter(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == i).collect()]
        out = _scan(numbered.select(F.struct("no").alias("row"), "text"), pairs, width)
        out = written(out.select(F.col("row.no").alias("no"), "n_words", "spans", "items").filter(F.lit(i == 0) | (F.size("spans") > 0)), "contamination-block")
        words = words if i else out.select("no", "n_words")
        hits = out.filter(F.size("spans") > 0).select("no", "spans", "items")
        told = hits if told is None else told.unionByName(hits)
    told = told.groupBy("no").agg(_joined_spans(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = {"spans": F.coalesce("spans", F.array().cast(SPANS)), "items": F.coalesce("items", F.array().cast("array<string>"))}
    return numbered.select("no", "row").join(words, "no").join(told, "no", "left").withColumns(none).select("row", "n_words", "spans", "items")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of the benchmark, with their columns."""
    return contamination(docs, benchmark, **options).filter(F.size("spans") == 0).select("row.*")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["stop"] - x["start"]))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


OP12_SQL = r"""
WITH b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), g AS (
  SELECT DISTINCT item, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS m
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS no, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), p AS (
  SELECT no, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT no, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM g) WHERE len(w) >= m)
), o AS (
  SELECT p.no, p.i, g.m, g.item FROM p JOIN g ON p.m = g.m AND p.win = g.win
), h AS (
  SELECT no, count(DISTINCT k) AS n_hit FROM (SELECT no, unnest(range(i, i + m)) AS k FROM o) GROUP BY no
), t AS (
  SELECT no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT no, item FROM o) GROUP BY no
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (no) LEFT JOIN t USING (no)
"""

r"""Near-duplicate documents by MinHash.

One-permutation hashing: one 64-bit hash for each word shingle; its high bits choose one of
`bands * rows` bins, and each bin keeps its least hash. Empty bins borrow from a bin that a hash
of (bin, attempt) chooses, again until it is not empty (optimal densification). `rows` bins in
turn make the key of a band; documents that share a key are candidates.

Candidates are star-shaped: in each bucket all members against the smallest id, so a bucket of
any size gives as many pairs as members. Links are confirmed on the full shingle sets
(`percent` of the union at least in the intersection). After the stars' components are known, a
pair can matter only if its ends share a bucket and are in different components. Such buckets are
looked at again, by the members' sketches (a byte of each bin), in blocks of bounded size: first, in
a quarter of the bands, each member's `best` most similar partners outside its component. Then, when
the components that these join are known, all pairs in all bands that are left: members with a
partner whose sketch may reach the threshold get their full sets, and each block confirms its
pairs where they meet and writes out only links that join components, fewer than it has members.
Only pairs whose sketches agree in no less than the threshold by four standard deviations are worth
confirming, so no star hides a link, and no group's pairs are written out.

With the defaults (48 bands of 10) a pair at 0.85 shares some band with a chance of 0.99997, and
its sketches pass with 0.99997; more similar pairs, more.

Documents with equal sets (128-bit digest of the whole set and its size) are one representative
throughout, so groups of copies cost one row each. Sets smaller than `least` shingles can only
reach the threshold if they are equal, so they need no signature.

Defined results
* null text, or text without words: empty set, linked with nothing.
* fewer than `width` words: the whole sequence is the one shingle.
* a doc_id that repeats: rows with one id are one document, which has the shingles of all its
  rows' texts only if these are equal; otherwise each text is looked at on its own and all its
  rows get the least component. A null doc_id sorts before all others; such rows are linked with
  nothing and have a null component.
* an empty table gives an empty result. Other columns are ignored by near_duplicates and
  returned unchanged by near_dedup.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import forget, ship, table, tidy, written
from lexigrid.llm.components import components

SIGNED = "doc_id long, n_shingles long, set_id binary, bands array<long>, sketch binary"
SETS = "doc_id long, shingles binary"
CELLS = "band int, key long, b1 int, b2 int, side boolean, rep long, n long, root long, sketch binary"
#: Shingles in a block of a bucket: eight bytes each.
BLOCK_SHINGLES = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words whose hashes a worker keeps; a full memo starts anew.
MEMO = 400_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= MEMO:
            self.clear()
        h = xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_words = _Words()


def shingle_hashes(text: bytes, width: int):
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    import numpy as np

    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, "u8")
    h = np.array(list(map(_words.__getitem__, words)), "u8")
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), "u8")
    for k in range(min(width, len(h))):
        out ^= h[k : k + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


@lru_cache(maxsize=4)
def _attempts(bins: int, n: int):
    """For each bin the bins that it asks when it is empty, in order."""
    import numpy as np

    x = (np.arange(bins, dtype="u8")[:, None] << np.uint64(32)) + np.arange(1, n + 1, dtype="u8")[None, :]
    for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = x * np.uint64(c)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype("i8")


def signature(hashes, bins: int):
    """The least hash of each bin, densified. hashes: sorted, at least one."""
    import numpy as np

    where = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype("i8")
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    out, full = np.zeros(bins, "u8"), np.zeros(bins, bool)
    out[where[first]], full[where[first]] = hashes[first], True
    source = np.flatnonzero(full)
    if len(source) == bins:
        return out
    empty, asked = np.flatnonzero(~full), 0
    while len(empty):
        most = 64 if asked < 64 else 4096
        tries = _attempts(bins, most)[empty, asked:]
        hit = full[tries]
        k = hit.argmax(1)
        ok = hit[np.arange(len(empty)), k]
        out[empty[ok]] = out[tries[ok, k[ok]]]
        empty, asked = empty[~ok], most
        if asked == 4096 and len(empty):  # not to be expected; any fixed rule does
            out[empty] = out[source[empty % len(source)]]
            break
    return out


def band_keys(sig, bands: int, rows: int):
    import numpy as np

    out = np.arange(1, bands + 1, dtype="u8") * np.uint64(0x94D049BB133111EB)
    for column in sig.reshape(bands, rows).T:
        out ^= column
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.astype("i8")


def _texts(batches):
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield doc_id, text.as_py() or b""


def _sign_partition(batches, width: int, bands: int, rows: int, least: int):
    import numpy as np
    import pyarrow as pa
    from xxhash import xxh3_128_digest

    def out(held):
        ids, n, digests, keys, sketches = zip(*held)
        offsets = np.cumsum([0, *map(len, keys)], dtype="i4")
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys))), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "set_id", "bands", "sketch"])

    held, none = [], np.empty(0, "i8")
    _words.clear()  # what a task before has left
    for doc_id, text in _texts(batches):
        hashes = shingle_hashes(text, width)
        keys, sketch = none, b""
        if len(hashes) >= least:
            sig = signature(hashes, bands * rows)
            keys, sketch = band_keys(sig, bands, rows), sig.astype("u1").tobytes()
        held.append((doc_id, len(hashes), xxh3_128_digest(hashes.tobytes()), keys, sketch))
        if len(held) >= 4096:
            yield out(held)
            held = []
    if held:
        yield out(held)
    _words.clear()  # the worker lives on beside the stages that follow


def _set_partition(batches, width: int):
    import pyarrow as pa

    ids, sets, size = [], [], 0
    for doc_id, text in _texts(batches):
        ids.append(doc_id), sets.append(shingle_hashes(text, width).tobytes())
        size += len(sets[-1])
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])
            ids, sets, size = [], [], 0
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])
    _words.clear()


def _confirm_partition(batches, percent: int):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = int((b[at] == a).sum()) if len(b) else 0
            ok.append(100 * both >= percent * (len(a) + len(b) - both))
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = 48, rows: int = 10, best: int = 8, block: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs: components of links with percent * union <= 100 * intersection."""
    spark = docs.sparkSession
    ship(spark)
    least = math.ceil(percent / (100 - percent)) if percent < 100 else 1 << 62  # below, only equal sets reach it
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    signed = written(plain.mapInArrow(lambda b: tidy(_sign_partition(b, width, bands, rows, least)), SIGNED), "signed")
    same = written(signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_id", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "same")
    entries = same.filter("size(bands) > 0").select("rep", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    buckets = entries.groupBy("band", "key").agg(F.min(F.struct("rep", "n")).alias("c"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).filter("m > 1")
    buckets = written(buckets.select("band", "key", "m", "total", F.col("c.rep").alias("centre"), F.col("c.n").alias("cn")), "buckets")
    crowded = written(entries.join(buckets, ["band", "key"]), "crowded")  # entries of buckets with one member end here
    forget(buckets)
    fits = F.least("n", "cn") * 100 >= F.greatest("n", "cn") * percent
    stars = crowded.filter((F.col("centre") < F.col("rep")) & fits)
    tried = written(stars.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    members = crowded.select(F.col("rep").alias("doc_id")).distinct()
    wanted = plain.join(members, "doc_id", "left_semi")  # the one time that texts are shuffled
    sets = written(wanted.mapInArrow(lambda b: tidy(_set_partition(b, width)), SETS), "sets")
    links = _confirm(sets, tried, percent)
    roots = components(links)
    cells, placed = _open_cells(signed, crowded.filter(F.col("band") < max(1, bands // 4)), roots, block)
    likely = cells.groupBy("band", "key", "b1", "b2").applyInArrow(lambda k, t: _likeliest(k, t, percent, best), "a long, b long")
    likely = written(likely.distinct().join(tried, ["a", "b"], "left_anti"), "likely")
    forget(placed)
    if not likely.isEmpty():
        links = links.unionByName(_confirm(sets, likely, percent))
        roots = components(links)
    cells, placed = _open_cells(signed, crowded, roots, block)
    ends = written(cells.groupBy("band", "key", "b1", "b2").applyInArrow(lambda k, t: _open_ends(k, t, percent, bands), CELLS), "ends")
    forget(placed)
    if not ends.isEmpty():
        full = ends.join(sets, ends["rep"] == sets["doc_id"]).drop("doc_id")
        more = full.groupBy("band", "key", "b1", "b2").applyInArrow(lambda k, t: _joining(k, t, percent, bands), "a long, b long")
        links = links.unionByName(written(more, "links"))
        roots = components(links)
    alike = same.select("set_id", "n_shingles", "rep").join(roots, F.col("rep") == F.col("v"), "left").select("set_id", "n_shingles", F.least("rep", F.coalesce("root", "rep")).alias("root"))
    found = signed.select("doc_id", "n_shingles", "set_id").join(alike, ["set_id", "n_shingles"], "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    if not signed.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty():
        found = _one_component(written(found, "repeated"))
    for df in (crowded, tried, likely, ends, sets):
        forget(df)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _open_cells(signed: DataFrame, crowded: DataFrame, roots: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Members of the buckets that hold several components, by blocks of a bucket and pairs of these: rows as in CELLS; and the written table that they are read from. A block has about `block` members and BLOCK_SHINGLES shingles at most."""
    placed = crowded.join(roots, F.col("rep") == F.col("v"), "left")
    placed = written(placed.select("band", "key", "m", "total", "rep", "n", F.coalesce("root", "rep").alias("root")), "placed")
    mixed = placed.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band", "key")
    sketches = signed.select(F.col("doc_id").alias("rep"), "sketch").filter("rep is not null and length(sketch) > 0").groupBy("rep").agg(F.min("sketch").alias("sketch"))
    blocks = F.ceil(F.greatest(F.col("m") / block, F.col("total") / BLOCK_SHINGLES)).cast("int")
    opened = placed.join(mixed, ["band", "key"]).withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("rep", "band"), F.col("blocks")).cast("int")
    cells = opened.join(sketches, "rep").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cells.select("band", "key", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), (F.col("own") > F.col("other")).alias("side"), "rep", "n", "root", "sketch"), placed


def _alike(key, tab, percent: int):
    """(x, equal, good) for some members x at a time: how many sketch bytes they have in common with each member, and which of these are partners in another component that may reach the threshold. Each pair across components is seen from one end at least."""
    import numpy as np

    rep, n, root, sketch = _columns(tab)
    side = tab.column("side").to_numpy(zero_copy_only=False) if key[2] != key[3] else None
    bins = sketch.shape[1]
    p = percent / 100
    own = bins * (1 - np.exp(-n / bins))  # bins that a set of this size fills itself
    values, sizes = np.unique(root, return_counts=True)
    minor = np.flatnonzero(root != values[sizes.argmax()])  # each pair across components has one of these
    step = max(1, (1 << 25) // (len(rep) * bins))
    for at in range(0, len(minor), step):
        x = minor[at : at + step]
        equal = np.count_nonzero(sketch[x][:, None, :] == sketch[None, :, :], axis=2)
        least = p - 4 * np.sqrt(p * (1 - p) / np.minimum(own[x][:, None], own[None, :]))  # equal bytes of unequal bins only add
        good = (equal >= least * bins) & (root[x][:, None] != root[None, :])
        good &= np.minimum(n[x][:, None], n[None, :]) * 100 >= np.maximum(n[x][:, None], n[None, :]) * percent
        if side is not None:
            good &= side[x][:, None] != side[None, :]
        yield x, equal, good


def _columns(tab):
    import numpy as np

    rep, n, root = (tab.column(c).to_numpy() for c in ("rep", "n", "root"))
    return rep, n, root, np.frombuffer(b"".join(tab.column("sketch").to_pylist()), "u1").reshape(len(rep), -1)


def _likeliest(key, tab, percent: int, most: int):
    """Pairs of each member with its `most` likeliest partners."""
    import numpy as np
    import pyarrow as pa

    rep, found = tab.column("rep").to_numpy(), [np.empty((2, 0), "i8")]
    for x, equal, good in _alike(key, tab, percent):
        if good.shape[1] > most:
            rank = np.where(good, -equal, 1)
            good &= rank <= np.partition(rank, most - 1, axis=1)[:, most - 1 : most]
        i, j = np.nonzero(good)
        i = x[i]
        found.append(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})


def _early(sketch, x, good, band: int, bands: int):
    """good without the pairs that share two bands before this one, by their bytes: there they are looked at. One alone may be a chance of bytes."""
    import numpy as np

    i, j = np.nonzero(good)
    if band > 1 and len(i):
        rows = sketch.shape[1] // bands
        a, b = sketch[x[i], : band * rows], sketch[j, : band * rows]
        shared = (a.reshape(len(i), band, rows) == b.reshape(len(i), band, rows)).all(2).sum(1)
        good[i[shared > 1], j[shared > 1]] = False
    return good


def _open_ends(key, tab, percent: int, bands: int):
    """Those members of a cell that have a pair to be confirmed in it."""
    import numpy as np

    _, _, _, sketch = _columns(tab)
    ends = np.zeros(tab.num_rows, bool)
    for x, _, good in _alike(key, tab, percent):
        good = _early(sketch, x, good, key[0].as_py(), bands)
        ends[x] |= good.any(1)
        ends |= good.any(0)
    return tab.select([f.split()[0] for f in CELLS.split(", ")]).take(np.flatnonzero(ends))


def _joining(key, tab, percent: int, bands: int):
    """Confirmed links of a cell that join components; a pair within a component that such links have made by then isn't looked at."""
    import numpy as np
    import pyarrow as pa

    rep, _, root, sketch = _columns(tab)
    sets = [np.frombuffer(s.as_buffer(), "u8") for s in tab.column("shingles")]
    _, root = np.unique(root, return_inverse=True)
    found_a, found_b = [], []
    for x, _, good in _alike(key, tab, percent):
        good = _early(sketch, x, good, key[0].as_py(), bands)
        for i, ok in zip(x, good):
            j = np.flatnonzero(ok & (root != root[i]))
            if not len(j):
                continue
            own, sizes = sets[i], np.array([len(sets[k]) for k in j])
            theirs = np.concatenate([sets[k] for k in j])
            at = np.searchsorted(own, theirs)
            at[at == len(own)] = 0
            both = np.add.reduceat((own[at] == theirs).astype("i8"), np.r_[0, np.cumsum(sizes)[:-1]])
            for k in j[100 * both >= percent * (len(own) + sizes - both)]:
                if root[k] != root[i]:
                    root[root == root[k]] = root[i]
                    found_a.append(min(rep[i], rep[k])), found_b.append(max(rep[i], rep[k]))
    return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})


def _confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose full sets are as similar as asked for."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return written(both.mapInArrow(lambda b: tidy(_confirm_partition(b, percent)), "a long, b long"), "links")


def _one_component(found: DataFrame) -> DataFrame:
    """Rows that share a doc_id get one component, and so does what hangs on any of them."""
    links = found.filter("doc_id is not null and component_id is not null").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    roots = components(links)
    return found.join(roots, F.col("doc_id") == F.col("v"), "left").select("doc_id", "n_shingles", F.coalesce("root", "component_id").alias("component_id"))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: one document of each group of near-duplicates, and all without words."""
    name = options.get("doc_id", "doc_id")
    gone = near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone.distinct(), F.col(name) == F.col("_gone"), "left_anti")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)

"""Shingle overlap of an item's texts with its contexts, in Arrow batches: words and shingles are 64-bit hashes, many items are compared at once."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import functions as F

from lexigrid.functions.text import WIDTH

_WORDS = re.compile(r"[^\W_]+")
#: Bytes of ASCII texts: letters in lower case, digits, and spaces for all others.
_ASCII = bytes(ord(chr(i).lower()) if chr(i).isalnum() and i < 128 else 32 for i in range(256))
#: Bytes of a word beyond which it is hashed by itself.
LONG = 512
#: Characters of texts that are compared at once, a longer item's alone.
AT_ONCE = 1_000_000
FOUND = "array<struct<start:bigint,n_words:int,cited_overlap:double,best_overlap:double,best_rank:int,clean_overlap:double>>"


def words(text: str) -> list[str] | list[bytes]:
    """What text.words gives; of ASCII texts as bytes, which have the same hashes. Typographic folds go from marks and spaces to marks and spaces, which aren't in words."""
    if text.isascii():
        return text.encode().translate(_ASCII).split()
    return _WORDS.findall(unicodedata.normalize("NFKC", text).casefold())


def _folded(text: str) -> bytes:
    """words(text), in UTF-8, with spaces between."""
    return text.encode().translate(_ASCII) if text.isascii() else " ".join(words(text)).encode("utf-8", "surrogatepass")


def _mixed(h, x):
    """x brought into the hashes h, each step one to one."""
    import numpy as np

    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str]) -> list:
    """The hashes of each text's words, by length and eight bytes at a time for all words at once; different words of one length up to eight bytes have different hashes."""
    import numpy as np

    parts = list(map(_folded, texts))
    data = b" " + b" ".join(parts) + b" " * 9
    inside = np.frombuffer(data, "u1") != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    kept = np.array([(1 << 8 * k) - 1 for k in range(9)], "u8")
    out = sizes.astype("u8")
    live, done = np.flatnonzero(sizes <= LONG), 0
    while len(live):
        left = sizes[live] - done
        out[live] = _mixed(out[live], eight[starts[live] + done] & kept[np.minimum(left, 8)])
        live, done = live[left > 8], done + 8
    for i in np.flatnonzero(sizes > LONG).tolist():
        from xxhash import xxh3_64_intdigest

        out[i] = xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    cuts = np.searchsorted(starts, np.cumsum([1, *(len(p) + 1 for p in parts)])).tolist()
    return [out[a:b] for a, b in zip(cuts, cuts[1:])]


def _shingles(texts: list, places, width: int):
    """(place, key) of all shingles of `width` words of texts that have so many; texts: word hashes, places: what each counts for."""
    import numpy as np

    sizes = np.array([len(t) for t in texts], "i8")
    flat = np.concatenate([*texts, np.zeros(width - 1, "u8")])
    n = len(flat) - width + 1
    key = np.full(n, width, "u8")
    for k in range(width):
        key ^= flat[k : k + n]
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words from here to the text's end
    whole = left >= width
    return np.repeat(places, sizes)[whole], key[whole]


def _sorted(at, key):
    """Each place's keys in order, where they lie; places come in order. (bounds of the places, as a list)"""
    import numpy as np

    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]).tolist() if len(at) else [0]
    for a, b in zip(cuts, cuts[1:]):
        key[a:b].sort()
    return cuts


def shared(texts: list, rows, contexts: list, context_rows, slots):
    """(number of distinct shingles of each text, how many of them each context of its row has, by slot). A text's shingles have WIDTH words, or all words of a shorter one.

    Rows come in order, and a row has a context a slot at most. Keys are sorted a text at a time and a row's keys are looked for in one context at a time, so that all that is compared lies close together."""
    import numpy as np

    widths = np.minimum([len(t) for t in texts], WIDTH)
    n, both = np.zeros(len(texts), "i8"), np.zeros((len(texts), int(slots.max(initial=-1)) + 1), "i8")
    for width in np.unique(widths[widths > 0]).tolist():
        of = np.flatnonzero(widths == width)
        at, key = _shingles([texts[i] for i in of], of, width)
        _sorted(at, key)
        first = np.r_[True, (at[1:] != at[:-1]) | (key[1:] != key[:-1])]
        at, key = at[first], key[first]
        n += np.bincount(at, minlength=len(n))
        there = np.flatnonzero(np.isin(context_rows, rows[of]))
        if not len(there):
            continue
        place, theirs = _shingles([contexts[i] for i in there], there, width)
        cuts = _sorted(place, theirs)
        held = place[cuts[:-1]]  # contexts that have shingles of this width
        ends = [np.searchsorted(rows[at], context_rows[held], side).tolist() for side in ("left", "right")]
        hit = np.zeros((both.shape[1], len(key)), bool)
        for s, a, b, lo, hi in zip(slots[held].tolist(), cuts, cuts[1:], *ends):
            own, asked = theirs[a:b], key[lo:hi]
            hit[s, lo:hi] = own.take(own.searchsorted(asked), mode="clip") == asked
        for s in range(len(hit)):
            both[:, s] += np.bincount(at[hit[s]], minlength=len(n))
    return n, both


def _compared(held: list) -> list[tuple]:
    """For each segment of the held items the fields of FOUND behind the start, in order."""
    import numpy as np

    texts, rows, cited, clean_of, there, seen = [], [], [], [], [], {}
    known = lambda text: seen.setdefault((text or "").strip(" "), len(seen))  # noqa: E731  a response that quotes a context whole has its words hashed once
    for r, (ranks, segments, cleaned, contexts) in enumerate(held):
        first = len(texts)
        for rank, s in zip(ranks, segments):
            texts.append(known(s)), rows.append(r), cited.append(-1 if rank is None else rank), clean_of.append(-1)
        for i, s in enumerate(cleaned):
            if s is not None:
                texts.append(known(s)), rows.append(r), cited.append(-1), clean_of.append(first + i)
        there += [(r, j, c["rank"], known(c["text"])) for j, c in enumerate(c for c in contexts or [] if c["rank"] is not None)]
    if not texts:
        return []
    hashes = word_hashes(list(seen))
    texts = [hashes[i] for i in texts]
    rows, cited, clean_of = np.array(rows), np.array(cited), np.array(clean_of)
    slots = np.array([x[1] for x in there], "i8")
    n, both = shared(texts, rows, [hashes[x[3]] for x in there], np.array([x[0] for x in there], "i8"), slots)
    none = np.iinfo("i8").max
    ranks = np.full((len(held), both.shape[1]), none)
    for r, j, rank, _ in there:
        ranks[r, j] = rank
    ranks, overlap = ranks[rows], both / np.maximum(n, 1)[:, None]
    best = overlap.max(1, initial=0.0)
    best_rank = np.where((overlap == best[:, None]) & (overlap > 0), ranks, none).min(1, initial=none)
    own = np.where(ranks == cited[:, None], overlap, 0.0).max(1, initial=0.0)
    clean = np.zeros(len(texts))
    clean[clean_of[clean_of >= 0]] = best[clean_of >= 0]
    segments = np.flatnonzero(clean_of < 0)
    sizes = [len(texts[i]) for i in segments]
    return list(zip(sizes, own[segments].tolist(), best[segments].tolist(), [None if b == none else b for b in best_rank[segments].tolist()], clean[segments].tolist()))


@lru_cache(maxsize=1)
def compared():
    """An Arrow function of the sizes of what stands before the marks, those of the marks, the cited ranks, the segments, the cleaned segments (null: nothing to clean) and the contexts (rank, text) of a response: FOUND."""

    @F.arrow_udf(FOUND)
    def run(before, marks, ranks, segments, cleaned, contexts):
        import numpy as np
        import pyarrow as pa

        sizes, out = [], []
        text = lambda x: x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else None
        held, size = [], 0
        for r in range(len(segments)):
            own = [text(x) for x in segments[r].values]
            there = contexts[r]
            there = [{"rank": c["rank"].as_py(), "text": text(c["text"])} for c in there.values] if there.is_valid and len(own) else []
            held.append((ranks[r].as_py(), own, [text(x) for x in cleaned[r].values], there))
            sizes.append(len(own))
            size += sum(map(len, own)) + sum(len(c["text"] or "") for c in there)
            if size > AT_ONCE:
                out += _compared(held)
                held, size = [], 0
        out += _compared(held)
        step, mark = (x.flatten().to_numpy(zero_copy_only=False).astype("i8") for x in (before, marks))
        offsets = np.cumsum([0, *sizes])
        run_ = np.cumsum(step + mark) - mark  # up to the mark, over all rows
        base = np.concatenate([[0], np.cumsum(step + mark)])[offsets[:-1]]
        start = run_ - np.repeat(base, sizes)
        names = ["n_words", "cited_overlap", "best_overlap", "best_rank", "clean_overlap"]
        types = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64()]
        columns = list(zip(*out)) or [()] * 5
        fields = pa.StructArray.from_arrays([pa.array(start, pa.int64()), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["start", *names])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields)

    return run

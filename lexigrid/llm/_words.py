r"""Words of whole texts as arrays: lower-cased A-Z, runs of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, which are runs of UTF-8 bytes too, as all bytes of characters beyond ASCII belong.

Texts are worked on in chunks of about CHUNK bytes. A longer text is cut between words; each piece also holds the words that
runs starting in it reach into, so memory follows the chunk and the longest word, not the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CHUNK = 1 << 20
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True


@dataclass
class Chunk:
    """Pieces of texts, one after the other, and their words.

    rows: of the column, by piece. first: each piece's first word, and the number of all. own: the words by piece that runs may start at, the
    others belong to the next piece. base: the text's words before the piece. data: the bytes. starts, stops: of words in data."""

    rows: np.ndarray
    first: np.ndarray
    own: np.ndarray
    base: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray

    def inside(self) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place in its piece, and its piece."""
        piece = np.repeat(np.arange(len(self.rows)), np.diff(self.first))
        return np.arange(len(self.starts)) - self.first[piece], piece


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of words; none reaches over an offset."""
    inside = IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = False, inside[1:]
    stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, stops


def _chunk(rows, data, offsets, own=None, base=0) -> Chunk:
    starts, stops = _split(data, offsets)
    first = np.searchsorted(starts, offsets)
    first[-1] = len(starts)
    return Chunk(np.asarray(rows), first, np.diff(first) if own is None else np.array([own]), np.full(len(rows), base), data, starts, stops)


def _pieces(row: int, data: np.ndarray, context: int, size: int):
    at = base = 0
    while at < len(data):
        cut = min(at + size, len(data))
        while cut < len(data) and IN_WORD[data[cut]] and IN_WORD[data[cut - 1]]:  # a word stays whole
            gap = np.flatnonzero(~IN_WORD[data[cut : cut + size]])
            cut = min(len(data), cut + (int(gap[0]) if len(gap) else size))
        reach, end = 64 * context, cut
        while context and end < len(data):
            end = min(len(data), cut + reach)
            starts, _ = _split(data[cut:end], np.array([0, end - cut]))
            if len(starts) > context:  # the last may be cut short, those before are whole
                end = cut + int(starts[context])
                break
            reach *= 2
        own = len(_split(data[at:cut], np.array([0, cut - at]))[0])
        yield _chunk([row], data[at:end], np.array([0, end - at]), own, base)
        base += own
        at = cut


def chunks(texts, context: int = 0, size: int | None = None):
    """Chunks of an Arrow column of texts, null ones without words. context: words that a run may reach beyond the one it starts at."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = size or CHUNK
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], "<i8", count=len(texts) + 1, offset=8 * texts.offset)
    held = texts.buffers()[2]
    data = np.frombuffer(held, "u1") if held is not None else np.empty(0, "u1")
    lo = 0
    while lo < len(texts):
        if offsets[lo + 1] - offsets[lo] > 2 * size:
            yield from _pieces(lo, LOWER[data[offsets[lo] : offsets[lo + 1]]], context, size)
            lo += 1
            continue
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + 2 * size, "right")) - 1)
        own = offsets[lo : hi + 1] - offsets[lo]
        yield _chunk(np.arange(lo, hi), LOWER[data[offsets[lo] : offsets[hi]]], own)
        lo = hi


def packed(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins in that: a run's text is a slice."""
    lengths = chunk.stops - chunk.starts
    out = np.full(int(lengths.sum()) + len(lengths), 32, "u1")
    begins = np.zeros(len(lengths) + 1, "i8")
    np.cumsum(lengths + 1, out=begins[1:])
    mask = np.ones(len(out), bool)
    mask[begins[1:] - 1] = False
    inside = IN_WORD[chunk.data]
    out[mask] = chunk.data[inside]
    return out, begins


_P, _A, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(chunk: Chunk) -> np.ndarray:
    """64-bit hash of each word's bytes, the same in any text."""
    if not len(chunk.starts):
        return np.empty(0, "u8")
    lengths = chunk.stops - chunk.starts
    begins = np.zeros(len(lengths), "i8")
    np.cumsum(lengths[:-1], out=begins[1:])
    own = chunk.data[IN_WORD[chunk.data]].astype("u8")
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _P))
    own *= powers[np.arange(len(own)) - np.repeat(begins, lengths)]
    out = np.add.reduceat(own, begins)
    out ^= out >> np.uint64(31)
    out *= _M
    out ^= out >> np.uint64(29)
    return out


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 have none."""
    out = words[: len(words) - n + 1].copy() if len(words) >= n else np.empty(0, "u8")
    for k in range(1, n):
        out *= _A
        out += words[k : len(words) - n + 1 + k]
    return out ^ (out >> np.uint64(32))


def crc_tables(longest: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The byte table of crc32, and tables that carry a crc over n zero bytes: [n, byte of the crc, its value]."""
    t = np.arange(256, dtype="u4")
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1).astype("u4")
    over = np.empty((longest + 1, 4, 256), "u4")
    over[0] = np.arange(256, dtype="u4")[None, :] << (8 * np.arange(4, dtype="u4"))[:, None]
    for n in range(longest):
        over[n + 1] = t[over[n] & 0xFF] ^ (over[n] >> 8)
    return t, over


_T, _OVER = crc_tables()
_SPACE = np.uint32(0xE96CCF45)  # crc32 of one space


def _carried(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    flat, at = _OVER.reshape(-1), n.astype("i8") * 1024
    out = flat[at + (crc & 0xFF)]
    for k in (1, 2, 3):
        out ^= flat[at + 256 * k + ((crc >> np.uint32(8 * k)) & 0xFF)]
    return out


def run_crcs(chunk: Chunk, longest: int = 3) -> list[np.ndarray]:
    """crc32 of the text of each run of 1 .. longest words, joined by a space, by the word that ends it; runs that begin before the chunk have none that counts.

    A run's crc is the shorter run's, carried over the next word's bytes, and that word's own crc: crc32 is linear."""
    import zlib

    lengths = chunk.stops - chunk.starts
    order = np.argsort(-np.minimum(lengths, 64), kind="stable")
    sorted_lengths, at = lengths[order], chunk.starts[order]
    short = int(np.searchsorted(-sorted_lengths, -63))  # those before are longer than 63 bytes
    crc = np.full(len(order), 0xFFFFFFFF, "u4")
    left = np.searchsorted(-sorted_lengths[short:], -np.arange(64), "left") + short  # words with more than j bytes
    for j in range(int(sorted_lengths[short]) if short < len(order) else 0):
        own = crc[short : left[j]]
        crc[short : left[j]] = _T[(own ^ chunk.data[at[short : left[j]] + j]) & 0xFF] ^ (own >> np.uint32(8))
    words = np.empty(len(order), "u4")
    words[order] = ~crc
    long = order[:short]
    texts = {int(i): chunk.data[chunk.starts[i] : chunk.stops[i]].tobytes() for i in long}
    for i, t in texts.items():
        words[i] = zlib.crc32(t)
    small = np.minimum(lengths, 63)
    spaced = _carried(np.full(len(words), _SPACE), small) ^ words  # of the word with a space before it
    out = [words]
    for _ in range(1, longest):
        run = np.zeros(len(words), "u4")
        run[1:] = _carried(out[-1][:-1], small[1:] + 1) ^ spaced[1:]
        for i, t in texts.items():
            if i:
                run[i] = zlib.crc32(b" " + t, int(out[-1][i - 1]))
        out.append(run)
    return out

r"""Byte-level BPE encoding and decoding by rank files.

Two-tier lookup of each match of the split pattern: a minimal perfect hash resolves pieces that
are tokens themselves; the others are merged by a heap of (rank, position) over linked bytes.
The hash is built once on the driver by hash-and-displace over the vocabulary (a bounded file)
and broadcast. Workers keep bounded memos before both tiers; these change speed, never results.

Defined results
* null text: empty, so no ids and empty decoded bytes. Texts are whole, whatever their length.
* every row gives one row, repeated ids too; other columns are dropped.
* an empty table gives an empty result.
* bytes that aren't UTF-8 are replaced by U+FFFD, as the text type asks for.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._pieces import PIECES, PieceMemo, splitter
from lexigrid.llm._shared import ship, table, tidy, tokenizer_path

ENCODED = "doc_id long, n_tokens long, ids binary, decoded binary"
#: Entries of a worker's memo of pairs, half of those of its memo of pieces at most.
PAIRS = 200_000
_MIX = 0x9E3779B97F4A7C15
_LOW = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class PerfectHash:
    """A minimal perfect hash from the tokens to 0..n-1: one displacement for each bucket of about four tokens; a bucket of one token holds its slot itself."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np
        import xxhash

        tokens = list(ranks)
        n = self.n = len(tokens)
        self.buckets = max(1, n // 4)
        hashes = [xxhash.xxh3_64_intdigest(t) for t in tokens]
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault((h >> 32) % self.buckets, []).append(i)
        self.shift, free, slot_of = [0] * self.buckets, np.ones(n, bool), [0] * n
        tries = np.arange(1, 513, dtype="u8") * np.uint64(_MIX)
        for b, own in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:
                break
            low, start = np.array([hashes[i] for i in own], "u8"), 0
            while True:
                shifts = tries + np.uint64(start * 512 * _MIX & _LOW)
                x = low[None, :] ^ shifts[:, None]
                x ^= x >> np.uint64(29)
                x *= np.uint64(0xBF58476D1CE4E5B9)
                slots = ((x >> np.uint64(32)) % np.uint64(n)).astype("i8")
                good = free[slots].all(1)
                ordered = np.sort(slots, 1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
                if good.any():
                    k = int(good.argmax())
                    self.shift[b] = start * 512 + k + 1
                    free[slots[k]] = False
                    for i, s in zip(own, slots[k].tolist()):
                        slot_of[i] = s
                    break
                start += 1
        left = iter(np.flatnonzero(free).tolist())
        for b, own in groups.items():
            if len(own) == 1:
                slot_of[own[0]] = s = next(left)
                self.shift[b] = -s - 1
        self.keys, self.ids = [b""] * n, [0] * n
        for i, t in enumerate(tokens):
            self.keys[slot_of[i]], self.ids[slot_of[i]] = t, ranks[t]

    def get(self, piece: bytes) -> int:
        """The rank, or -1."""
        h = _digest(piece)
        d = self.shift[(h >> 32) % self.buckets]
        if d < 0:
            s = -d - 1
        else:
            x = h ^ (d * _MIX & _LOW)
            x ^= x >> 29
            s = ((x * 0xBF58476D1CE4E5B9 & _LOW) >> 32) % self.n
        return self.ids[s] if self.keys[s] == piece else -1


def _digest(piece: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    globals()["_digest"] = xxh3_64_intdigest  # from now on without this step
    return xxh3_64_intdigest(piece)


class _Pairs(dict):
    def __init__(self, get, limit: int):
        super().__init__()
        self.look, self.limit = get, limit

    def __missing__(self, key: bytes) -> int:
        if len(self) >= min(PAIRS, self.limit):
            self.clear()
        self[key] = r = self.look(key)
        return r


class Codec:
    def __init__(self, table: PerfectHash, pattern: str, limit: int = PIECES):
        self.table, self.split = table, splitter(pattern)
        self.of = _Pairs(table.get, limit // 2)
        self.pieces = PieceMemo(lambda piece: self.piece(piece.encode("utf-8", "replace")), limit)
        self.tokens = dict(zip(table.ids, table.keys))

    def piece(self, data: bytes) -> bytes:
        whole = self.table.get(data)
        if whole >= 0:
            return whole.to_bytes(4, "little")
        return b"".join([self.table.get(t).to_bytes(4, "little") for t in self.merge(data)])

    def merge(self, data: bytes) -> list[bytes]:
        """Lowest rank first, leftmost among equals, until no neighbours make a token."""
        n, of = len(data), self.of
        part = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := of[data[i : i + 2]]) >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            left = part[i]
            if left is None or (j := after[i]) >= n:
                continue
            both = left + part[j]
            if of[both] != top >> 32:
                continue  # the pair that was meant is gone
            part[i], part[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := of[both + part[k]]) >= 0:
                    heappush(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := of[part[h] + both]) >= 0:
                heappush(heap, r << 32 | h)
        return [p for p in part if p is not None]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_held: list = [None, None, None]


def _codec(shared, pattern: str, limit: int) -> Codec:
    """One for each worker process, table, pattern and limit."""
    if _held[0] is not shared.value or _held[1] != (pattern, limit):
        _held[:] = [shared.value, (pattern, limit), Codec(shared.value, pattern, limit)]
    return _held[2]


def _encode_partition(batches, shared, pattern: str, decoded: bool, limit: int = PIECES):
    import pyarrow as pa

    codec = _codec(shared, pattern, limit)

    def out(ids, n, data, back):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary()), pa.array(back, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    for batch in batches:
        names, n, data, back, size = [], [], [], [], 0
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = raw.as_py() or b""
            ids = codec.encode(text.decode("utf-8", "replace"))
            names.append(doc_id), n.append(len(ids) // 4), data.append(ids), back.append(codec.decode(ids) if decoded else None)
            size += len(ids) + len(text)
            if size > 8 << 20:
                yield out(names, n, data, back)
                names, n, data, back, size = [], [], [], [], 0
        yield out(names, n, data, back)


def bpe_encode(docs: DataFrame, *, ranks: str | None = None, pattern: str | None = None, decoded: bool = False, limit: int = PIECES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """ENCODED for each row: ids as little-endian unsigned 32-bit integers; decoded: the bytes they stand for, null unless asked for. limit: entries of a worker's memo of pieces."""
    import public_tokenizers

    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(PerfectHash(read_ranks(ranks or tokenizer_path("byte_bpe_multi_50k.tiktoken"))))
    pattern = pattern or public_tokenizers.PATTERN
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(lambda b: tidy(_encode_partition(b, shared, pattern, decoded, limit)), ENCODED)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode(table(spark, sf_dir, "documents"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

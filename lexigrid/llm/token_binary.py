r"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned and sorted by id. Each task encodes its documents and streams
three files into the shared folder: `.bin` (ids, little-endian, the smallest unsigned type that
holds the vocabulary), `.idx` (n + 1 little-endian 64-bit offsets, in ids) and `.ids` (64-bit
document ids). The manifest has one row for each file; prefix sums over it give each file's base,
so document k of a file starts at base + offset. Readers memory-map the files.

A task that runs twice writes under another name and only the attempt that Spark accepted is in
the manifest, so retries and lost executors leave no double output.

Defined results
* null or empty text: only the end id. Null doc_id: sorted first, counted in the manifest, read as null.
* repeated doc_ids: each row is a document of its own, ordered by text.
* an empty table: a manifest without documents, and no rows when read.
* other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._pieces import PIECES, PieceMemo, latin_splitter
from lexigrid.llm._shared import file_system, local_path, new_path, qualified, ship, table, tokenizer_path

NULL_ID = -(2**63)
#: Texts that go to one file, about, where more files come of it than there are shuffle partitions.
FILE_BYTES = 1 << 28
MANIFEST = "part int, name string, n_docs long, n_tokens long, n_null long"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 characters for themselves, the others in order from U+0100."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in same)
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """The tokenizers library. Texts of Latin letters are split as the byte-level pattern splits them and each piece is encoded by the library's model, behind a bounded memo, which gives the ids of the whole text (tests hold every such character against the library). Other texts are encoded whole."""

    def __init__(self, path: str, dtype: str, limit: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        #: written in a text, these are single ids for the library, so a text that holds one goes to it whole
        self.special = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        model, letters, kind = self.tok.model, _byte_letters(), "H" if dtype == "<u2" else "I"

        def make(piece: str) -> bytes:
            return array(kind, [t.id for t in model.tokenize(piece.encode("utf-8", "replace").decode("latin-1").translate(letters))]).tobytes()

        self.beyond, self.split = latin_splitter()
        self.kind = kind
        self.memo = PieceMemo(make, limit)

    def encode(self, text: str) -> bytes:
        if self.beyond(text) is None and not any(t in text for t in self.special):
            return b"".join(map(self.memo.__getitem__, self.split(text)))
        return array(self.kind, self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str, dtype: str) -> PieceEncoder:
    return PieceEncoder(path, dtype)


def _groups(rows, most: int = 4_000_000):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _write_partition(batches, folder: str, path: str, dtype: str, end_id: int):
    import uuid

    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    name, n_docs, n_tokens, n_null = f"part-{part:06d}-{uuid.uuid4().hex}", 0, 0, 0
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    end, width, encoder = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize, _encoder(path, dtype)
    rows = ((i, t or "") for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    with fs.open_output_stream(f"{base}/{name}.bin") as ids, fs.open_output_stream(f"{base}/{name}.idx") as idx, fs.open_output_stream(f"{base}/{name}.ids") as docs:
        idx.write(np.array([0], "<u8").tobytes())
        for group in _groups(rows):
            encoded = [encoder.encode(t) + end for _, t in group]
            ids.write(b"".join(encoded))
            stops = n_tokens + np.cumsum([len(e) // width for e in encoded], dtype="u8")
            idx.write(stops.astype("<u8").tobytes())
            docs.write(np.array([NULL_ID if i is None else i for i, _ in group], "<i8").tobytes())
            n_null += sum(i is None for i, _ in group)
            n_tokens, n_docs = int(stops[-1]), n_docs + len(group)
    yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": n_docs, "n_tokens": n_tokens, "n_null": n_null}], schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_null", pa.int64())]))


@dataclass(frozen=True)
class TokenDataset:
    """files: (name, base, n_docs, n_tokens, n_null) in order; base is the ids before the file, and its first n_null documents have no doc_id."""

    path: str
    dtype: str
    files: tuple


def write_token_dataset(docs: DataFrame, path: str | None = None, *, tokenizer: str | None = None, end_id: int = 0, partitions: int | None = None, doc_id: str = "doc_id", text: str = "text") -> TokenDataset:
    """Encode docs in ascending order of doc_id into files under path (a new shared folder if None), and write manifest.json there."""
    spark = docs.sparkSession
    ship(spark)
    folder, vocabulary = qualified(spark, path) if path else new_path(spark, "tokens"), tokenizer or tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    dtype = "<u2" if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else "<u4"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = rows.mapInArrow(lambda b: _write_partition(b, folder, vocabulary, dtype, end_id), MANIFEST).collect()  # one row a partition
    files, base = [], 0
    for r in sorted(manifest, key=lambda r: r["part"]):
        files.append((r["name"], base, r["n_docs"], r["n_tokens"], r["n_null"]))
        base += r["n_tokens"]
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/manifest.json") as out:
        out.write(json.dumps({"dtype": dtype, "files": files}).encode())
    return TokenDataset(folder, dtype, tuple(files))


def open_token_dataset(path: str) -> TokenDataset:
    fs, at = file_system(path)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        told = json.loads(f.read())
    return TokenDataset(path, told["dtype"], tuple(map(tuple, told["files"])))


class _Ranges:
    """Slices of a flat file: of a memory map where the file is on a mounted file system, else ranged reads of what is asked for."""

    def __init__(self, path: str, dtype: str):
        import numpy as np

        self.dtype, local = np.dtype(dtype), local_path(path)
        self.map = None
        if local is not None:
            self.map = np.memmap(local, dtype, "r") if os.path.getsize(local) else np.empty(0, dtype)
            self.n = len(self.map)
        else:
            fs, at = file_system(path)
            self.file = fs.open_input_file(at)
            self.n = self.file.size() // self.dtype.itemsize

    def __getitem__(self, at: slice):
        import numpy as np

        if self.map is not None:
            return np.asarray(self.map[at])
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((at.stop - at.start) * size, at.start * size), self.dtype)


def _read_partition(batches, folder: str, dtype: str, with_ids: bool):
    import numpy as np
    import pyarrow as pa

    step = 8192
    for batch in batches:
        for f in batch.to_pylist():
            ids, offsets, docs = (_Ranges(f"{folder}/{f['name']}{x}", t) for x, t in ((".bin", dtype), (".idx", "<u8"), (".ids", "<i8")))
            first = 0
            while first < docs.n:  # documents by their number, then by their ids: nothing of a file is held whole
                last = min(first + step, docs.n)
                starts, own_ids = offsets[first : last + 1], docs[first:last]
                lo = 0
                while lo < last - first:
                    hi = int(np.searchsorted(starts, starts[lo] + (1 << 20), "right"))
                    hi = max(lo + 1, min(hi, last - first))
                    at = starts[lo : hi + 1].astype("i8")
                    held = ids[int(at[0]) : int(at[-1])].astype("<u4")
                    arrays = [held[a:b] for a, b in zip(at[:-1] - at[0], at[1:] - at[0])]
                    sums = [zlib.crc32(x.tobytes()) for x in arrays]
                    out = [pa.array([None if first + lo + k < f["n_null"] else int(d) for k, d in enumerate(own_ids[lo:hi])], pa.int64()), pa.array(at[:-1] + f["base"]), pa.array(np.diff(at)), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(out + [pa.array([x.astype("<i4") for x in arrays], pa.list_(pa.int32()))] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                    lo = hi
                first = last


def read_token_dataset(spark: SparkSession, data: TokenDataset, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked for, ids; one task a file."""
    ship(spark)
    files = [(n, b, none) for n, b, docs, _, none in data.files if docs]
    rows = spark.createDataFrame(spark.sparkContext.parallelize(files, max(1, len(files))), "name string, base long, n_null long")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    folder, dtype = data.path, data.dtype
    return rows.mapInArrow(lambda b: _read_partition(b, folder, dtype, with_ids), schema)


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_dataset(spark, write_token_dataset(table(spark, sf_dir, "documents")))

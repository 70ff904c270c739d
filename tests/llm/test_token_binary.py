import os
import zlib

import numpy as np

from lexigrid.llm import token_binary as B
from lexigrid.llm._shared import tokenizer_path

from .helpers import clashing, documents, edge_rows


def brute(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_edges(spark):
    rows = edge_rows() + [(-(2**63), "least id"), (20, "a <|endoftext|>b"), (21, "<|endoftext|><|endoftext|> x <|endoftex|>")]
    data = B.write_token_dataset(clashing(documents(spark, rows)), partitions=4)
    got = B.read_token_dataset(spark, B.open_token_dataset(data.path), with_ids=True).collect()
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == [(s, i, n, c) for i, s, n, c in brute(rows)]
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    folder = data.path.removeprefix("file:")
    assert data.dtype == "<u2" and all(os.path.getsize(f"{folder}/{n}.bin") == 2 * t and os.path.getsize(f"{folder}/{n}.idx") == 8 * (d + 1) for n, _, d, t, _ in data.files)


def test_files_off_mounted_file_systems_are_read_by_ranges(spark, monkeypatch):
    import pyarrow as pa

    data = B.write_token_dataset(documents(spark, edge_rows()), partitions=2)
    files = pa.RecordBatch.from_pylist([{"name": n, "base": b, "n_null": none} for n, b, d, _, none in data.files if d])
    read = lambda: [r for batch in B._read_partition([files], data.path, data.dtype, True) for r in batch.to_pylist()]
    mapped = read()
    monkeypatch.setattr(B, "local_path", lambda uri: None)
    assert read() == mapped and len(mapped) == len(edge_rows())


def test_more_files_for_more_text(spark, monkeypatch):
    monkeypatch.setattr(B, "FILE_BYTES", 1000)
    assert len(B.write_token_dataset(documents(spark, [(i, "some words " * 20) for i in range(60)])).files) > 8


def test_empty(spark):
    data = B.write_token_dataset(documents(spark, [(1, "x")]).limit(0), partitions=2)
    assert B.read_token_dataset(spark, data).count() == 0


def test_small_memo():
    path = tokenizer_path("byte_bpe_50k.json")
    texts = [t or "" for _, t in edge_rows()] * 2
    few, many = B.PieceEncoder(path, "<u2", limit=5), B.PieceEncoder(path, "<u2")
    assert [few.encode(t) for t in texts] == [many.encode(t) for t in texts]


def test_pieces_against_whole_texts():
    import sys

    path = tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    enc = B.PieceEncoder(path, "<u4")
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(points[i : i + 997]) for i in range(0, len(points), 997)] + [f"a{c}{c} b{c}1{c} {c}'s{c}\n" for c in points[:0x3100]]
    for t, e in zip(texts, tok.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == e.ids, repr(t[:50])


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, B.op2_token_binary(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == brute(rows)

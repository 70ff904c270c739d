import hashlib
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrid.llm import byte_bpe as E
from lexigrid.llm._shared import tokenizer_path

from .helpers import clashing, documents, edge_rows


@pytest.fixture(scope="module")
def both():
    ranks = E.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return E.Codec(E.PerfectHash(ranks), public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_perfect_hash(both):
    codec, _, ranks = both
    assert all(codec.table.get(t) == r for t, r in ranks.items())
    assert sorted(codec.table.keys) == sorted(ranks)  # minimal: each slot holds one token
    assert codec.table.get(b"not a token, surely") == -1 and codec.table.get(b"") == -1


def check(both, text):
    ids = both[0].encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == both[1].encode_ordinary(text)
    assert both[0].decode(ids) == text.encode()


def test_every_character(both):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    for i in range(0, len(points), 4096):
        check(both, "".join(points[i : i + 4096]))
    for c in [chr(x) for x in range(0x300)] + list(" ᠎ ​    　﻿"):
        check(both, f"a{c}{c} b{c}1{c}\n{c}'s")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(both, text):
    check(both, text)


def test_long_pieces(both):
    for t in ("a" * 20_000, "ab" * 9_000, " " * 30_000, "漢字" * 5_000, "0" * 9_999 + "!" * 9_999):
        check(both, t)


def test_memo_turns_over(both, monkeypatch):
    monkeypatch.setattr(E, "PAIRS", 3)
    codec = E.Codec(both[0].table, public_tokenizers.PATTERN, limit=3)
    for _, t in edge_rows():
        assert np.frombuffer(codec.encode(t or ""), "<u4").tolist() == both[1].encode_ordinary(t or "")


def brute(enc, rows):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return sorted(((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for i, t in rows for ids in [enc.encode_ordinary(t or "")]), key=repr)


def test_table(spark, both):
    df = clashing(documents(spark, edge_rows()))
    out = E.bpe_encode(df, decoded=True)
    sha = lambda b: hashlib.sha256(bytes(b)).hexdigest()
    assert sorted(((r["doc_id"], r["n_tokens"], sha(r["ids"]), sha(r["decoded"])) for r in out.collect()), key=repr) == brute(both[1], edge_rows())
    assert E.bpe_encode(df.limit(0)).count() == 0


def test_query(spark, sf, both):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, E.op6_byte_bpe(spark, sf).collect()), key=repr) == brute(both[1], rows)

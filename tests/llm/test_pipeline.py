import hashlib
from collections import Counter

import corpus_pipeline as P
from lexigrid.llm import byte_bpe

from .helpers import clashing, documents, edge_rows


def test_stages_in_order_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "exact", "near", "mix", "encode"]
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        after.write.mode("overwrite").parquet(path)
        before = spark.read.parquet(path)
        texts = [r["text"] for r in before.collect()]
        assert texts
        if name in ("exact", "near"):
            assert len(set(texts)) == len(texts)


def test_encoding_decodes_to_the_texts(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = P.run(spark, sf).collect()
    assert out and all(r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest() for r in out)
    assert max(Counter(r["doc_id"] for r in out).values()) <= 2


def test_edges(spark, sf):
    rows = edge_rows()
    df = clashing(documents(spark, rows))
    there = Counter((r["doc_id"], r["text"]) for r in df.collect())
    kept = {}
    for name, stage in P.STAGES:
        assert stage(spark, df.limit(0), sf).count() == 0, name
        out = stage(spark, df, sf)
        if name == "encode":
            assert sorted((r["doc_id"] or 0, r["decoded_sha256"]) for r in out.collect()) == sorted((i or 0, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
            continue
        assert out.columns == df.columns, name
        held = out.collect()
        assert all(r["kept"] == r["score"] == "clash" for r in held), name
        kept[name] = Counter((r["doc_id"], r["text"]) for r in held)
        assert set(kept[name]) <= set(there), name
    assert all(kept["quality"][k] in (0, there[k]) for k in there)  # rows of equal texts stay or go together
    texts = Counter(t or "" for _, t in kept["exact"].elements())
    assert set(texts) == {t or "" for _, t in rows} and set(texts.values()) == {1}
    assert max(i or 0 for i, t in kept["exact"] if t == rows[0][1]) == 2  # of 1 and 2 the larger
    near = kept["near"]
    assert near[(1, rows[0][1])] == 1 and near[(2, rows[1][1])] == 0 and near[(6, rows[5][1])] == 1 and near[(7, rows[6][1])] == 0
    assert all(near[(i, t)] == 1 for i, t in rows if i in (3, 4, 5))  # without words: linked with nothing
    assert all(n <= 2 * there[k] and (k[1] or "").split() for k, n in kept["mix"].items())


def test_ranks_are_read():
    from lexigrid.llm._shared import tokenizer_path

    assert len(byte_bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))) > 50_000


def test_encoding_holds_few_texts_and_memos(spark, monkeypatch):
    """Texts reach the encoder in batches of BATCH rows, its memos are bounded by MEMO, and the sets and signatures of the near stage leave no memo behind."""
    import pyarrow as pa

    from lexigrid.llm import minhash_dedup

    docs = documents(spark, [(i, f"some words and w{i}") for i in range(40)]).coalesce(1)

    def sizes(batches, shared, pattern, decoded, limit):
        for b in batches:
            n = [b.num_rows] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([str(limit).encode()] * b.num_rows), b.column(1)], names=["doc_id", "n_tokens", "ids", "decoded"])

    monkeypatch.setattr(byte_bpe, "_encode_partition", sizes)
    monkeypatch.setattr(P, "BATCH", 7)
    out = P.encode(spark, docs, "").collect()
    assert len(out) == 40 and max(r["n_tokens"] for r in out) == 7
    assert {r["ids_sha256"] for r in out} == {hashlib.sha256(str(P.MEMO).encode()).hexdigest()}
    codec = byte_bpe.Codec(byte_bpe.PerfectHash({bytes([i]): i for i in range(256)} | {b"ab": 256}), r"\S+", 4)
    codec.encode("ab ba cab abc bca acb bac cb bc aab")
    assert len(codec.of) <= 2 and len(codec.pieces) <= 4 and len(codec.pieces.older) <= 4
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"a b c d e f g"])], names=["doc_id", "text"])
    for made in (minhash_dedup._sign_partition([batch], 5, 4, 10, 4), minhash_dedup._set_partition([batch], 5)):
        assert list(made) and not minhash_dedup._words

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrid.llm import chat_format as C

piece = st.sampled_from(["<", "|", "turn", "<|turn|>", "<|end|>", "<|text|>", "\\", "[INST]", "[", "INST]", "</s>", "é", "\n", "漢", "a b", "<|endoftext|>"])
text = st.lists(piece, max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|end|>"]), text), max_size=5))
def test_round_trip_and_mask(turns):
    out, spans = C.render(turns)
    assert C.parse(out) == turns
    assert [C.unescape(out[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_ranges_against_brute_force():
    offsets = [(0, 3), (3, 5), (5, 5), (5, 9), (9, 10)]
    for s in range(10):
        for e in range(s, 11):
            lo, hi = C.token_ranges(offsets, [(s, e)])[0]
            want = [i for i, (a, b) in enumerate(offsets) if a < e and b > s and b > a]
            got = [i for i in range(lo, hi) if offsets[i][1] > offsets[i][0]]
            assert got == want or s == e


def expected(rows):
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(ts), sha("".join(f"{r}\n{x}\n" for r, x in ts)), sum(len(x) for r, x in ts if r == "assistant"), sha("".join(x for r, x in ts if r == "assistant"))) for c, ts in convs.items()}


@pytest.mark.parametrize("block", [4_000_000, 40])
def test_table(spark, block):
    rows = [(1, 0, "user", "hi </s> there"), (1, 1, "assistant", "ünï\\ [INST] ok"), (1, 2, "assistant", "twice"), (2, 0, "assistant", None), (2, None, None, "x"), (None, 0, "assistant", "lone 漢字"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "assistant", "long text " * 3000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, n_turns int")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.digests(C.format_conversations(df, block_chars=block)).collect()}
    assert got == expected(rows)
    assert C.digests(C.format_conversations(df.limit(0))).count() == 0


def test_blocks_do_not_change_ids(spark):
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f" text {i} with words.\n") for i in range(20)], "conv_id long, turn long, role string, text string")
    whole = C.format_conversations(df).collect()[0]["ids"]
    parts = sorted(C.format_conversations(df, block_chars=100).collect(), key=lambda r: r["block"])
    assert len(parts) > 1 and [i for p in parts for i in p["ids"]] == whole


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.op1_chat_format(spark, sf).collect()}
    assert got == expected(rows)

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from lexigrid.llm import hmm_scoring as H

from .helpers import clashing, documents, edge_rows


def base(rows):
    toks = lambda t: [bytes(w) for w in (t or "").encode().translate(H._LOWER).split()] + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)), 6)) for i, t in rows), key=repr)


def held(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("vocabulary,listed,piece", [(20_000, 200_000, 512), (5, 5, 3), (5, 40, 3)])
def test_base_scores(spark, vocabulary, listed, piece):
    rows = edge_rows() + [(i, f"a b c{i % 5} d{i}") for i in range(200, 260)]
    out = H.hmm_scores(clashing(documents(spark, rows)), vocabulary=vocabulary, listed=listed, piece=piece, first=1, iterations=1, states=3, distinct=50)
    assert held(out) == base(rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out.collect())
    assert H.hmm_scores(documents(spark, rows).limit(0), first=1, iterations=1).count() == 0


def random_model(size=5, k=3, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return H.Hmm(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((size, k)), 0))


def paths(m, seq):
    for states in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[states[0]] * m.emit[seq[0], states[0]]
        for t in range(1, len(seq)):
            p *= m.trans[states[t - 1], states[t]] * m.emit[seq[t], states[t]]
        yield states, p


def test_forward_and_counts_against_all_paths():
    m, seqs = random_model(), [[0, 1, 2, 4], [3, 3, 1], [2], [4, 0, 0, 1, 2]]
    order = sorted(range(4), key=lambda i: -len(seqs[i]))
    batch, lengths = np.zeros((4, 5), int), np.array([len(seqs[i]) for i in order])
    for row, i in enumerate(order):
        batch[row, : len(seqs[i])] = seqs[i]
    got = m.forward(lambda t, live: m.emit[batch[:live, t]], lengths)
    sums, want = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))], [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
    m.expected(batch, lengths, np.ones(4, bool), sums)
    for row, i in enumerate(order):
        total = sum(p for _, p in paths(m, seqs[i]))
        assert abs(got[row] - math.log(total)) < 1e-9
        for states, p in paths(m, seqs[i]):
            want[0][states[0]] += p / total
            for t, s in enumerate(states):
                want[2][seqs[i][t], s] += p / total
                if t:
                    want[1][states[t - 1], s] += p / total
    for a, b in zip(sums, want):
        assert np.allclose(a, b, atol=1e-5)


def test_long_sequence_does_not_underflow():
    m = random_model()
    seq = np.random.default_rng(1).integers(0, 5, (1, 100_000))
    assert np.isfinite(m.forward(lambda t, live: m.emit[seq[:live, t]], np.array([100_000]))).all()


def test_parts_of_long_texts_give_the_sums_of_whole_ones():
    m, rng = random_model(size=9, k=4, seed=5), np.random.default_rng(2)
    data = [rng.integers(0, 9, n).astype("<u2") for n in (1, 2, 7, 24, 25, 26, 60, 61, 400)]
    told = []
    for piece in (3, 7, 10**9):
        sums = [np.zeros(4), np.zeros((4, 4)), np.zeros((9, 4))]
        told.append((sum(r[0] for r in H._passes(m, data, piece, sums)), *sums))
    for other in told[1:]:
        assert all(np.allclose(a, b, rtol=1e-4, atol=1e-4) for a, b in zip(told[0], other))
    order = sorted(data, key=len, reverse=True)
    batch = np.zeros((len(data), 400), int)
    for i, s in enumerate(order):
        batch[i, : len(s)] = s
    exact = m.forward(lambda t, live: m.emit[batch[:live, t]], np.array([len(s) for s in order])).sum()
    assert abs(told[0][0] - exact) < 1e-3 * abs(exact)


def test_staying_is_baum_welch_with_the_identity():
    m, rng = random_model(size=9, k=4, seed=5), np.random.default_rng(2)
    m.trans = np.eye(4)
    data = [rng.integers(0, 9, n).astype("<u2") for n in (1, 2, 7, 12)]
    a, b = ([np.zeros(4), np.zeros((4, 4)), np.zeros((9, 4))] for _ in range(2))
    told = m.staying(data, a)
    assert abs(told - sum(r[0] for r in H._passes(m, data, 10**9, b))) < 1e-4
    assert all(np.allclose(x, y, atol=1e-4) for x, y in zip(a, b))


def test_training_raises_likelihood(spark):
    """Words in a fixed alternation: order matters, so the model must beat the unigram score on held-out texts."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        w = []
        for _ in range(20):
            w += [f"noun{rng.integers(20)}", f"verb{rng.integers(20)}", f"mark{rng.integers(3)}"]
        rows.append((i, " ".join(w)))
    df = documents(spark, rows)
    out = [r for r in H.hmm_scores(df, iterations=12, settled=0, states=6).collect() if r["held_out"]]
    few = [r for r in H.hmm_scores(df, first=1, iterations=1, states=6).collect() if r["held_out"]]
    total = lambda rows, c: sum(r[c] for r in rows)
    assert total(out, "score") > total(few, "score") and total(out, "score") > total(out, "base_score")


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_held_out_texts_score_above_the_base(spark, size):
    """By the query's own settings: over a tenth of a digit a token."""
    r = H.op10_hmm_scoring(spark, f"/root/testdata/{size}").filter("held_out").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "base_score", "score")]).collect()[0]
    assert r["score"] > r["base_score"] + 0.3 * r["n_tokens"]


def test_listed_words_change_no_score(spark):
    """Emissions out of the list and out of the table are the same."""
    rows = [(i, f"a b c{i % 5} d{i} e{i % 30} f{i // 2}") for i in range(80)]
    a, b = ({r["doc_id"]: r["score"] for r in H.hmm_scores(documents(spark, rows), vocabulary=4, listed=n, classes=3, states=2, first=2, iterations=1).collect()} for n in (10, 1000))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-4


def test_expected_numbers_are_of_every_word(spark, monkeypatch):
    """The table of emissions holds each training word outside the vocabulary, with its count as the sum over states."""
    rows = [(i, f"a b c{i % 5} d{i} e{i % 30} f{i // 2}") for i in range(80)]
    kept, states = {}, H.word_states
    monkeypatch.setattr(H, "word_states", lambda *a, **k: (out := states(*a, **k), kept.update(t=out.collect()))[0])
    H.hmm_scores(documents(spark, rows), vocabulary=2, listed=3, classes=3, states=3, first=2, iterations=1)
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split())
    top = sorted(count, key=lambda w: (-count[w], w))[:2]
    got = {r["word"].decode(): r for r in kept["t"]}
    assert {w: r["c"] for w, r in got.items()} == {w: c for w, c in count.items() if w not in top}
    assert all(abs(sum(r["g"]) - r["c"]) < 1e-3 * r["c"] and min(r["g"]) >= 0 for r in got.values())


def test_distribution_over_words_is_proper():
    """In each state the probabilities of all known words, an unknown one of each class and the end sum to one."""
    rng = np.random.default_rng(8)
    words = [f"w{j}".encode() for j in range(40)]
    counts = {w: 50 - j for j, w in enumerate(words)}
    classes = [(sum(counts[w] for w in words[5:] if zlib.crc32(w) % 3 == c), sum(zlib.crc32(w) % 3 == c for w in words[5:])) for c in range(3)]
    symbols = H.Symbols(words[:12], [counts[w] for w in words[:12]], 5, classes, 9)
    m = random_model(size=symbols.size, k=3)
    g = {w: rng.dirichlet(np.ones(3)) * counts[w] for w in words[5:]}
    by_class = np.array([sum((g[w] for w in words[5:] if zlib.crc32(w) % 3 == c), np.zeros(3)) for c in range(3)])
    e = H.Emissions(symbols, m, by_class, g)
    others = e.rare(np.array([symbols.class_of(w) for w in words[12:]]), np.array([g[w] for w in words[12:]]))
    unknown = e.rare(np.arange(3), np.zeros((3, 3)))
    assert np.allclose(e.matrix.sum(0) + others.sum(0) + unknown.sum(0), 1)


def test_scores_are_the_sum_over_all_paths(spark, monkeypatch):
    """Short texts: the score against emissions and transitions multiplied out along every path."""
    rows = [(i, f"a b c{i % 5} d{i}") for i in range(60)]
    kept, made, states = {}, H.Emissions.__init__, H.word_states
    monkeypatch.setattr(H.Emissions, "__init__", lambda self, *a: (kept.update(e=self), made(self, *a))[1])
    monkeypatch.setattr(H, "word_states", lambda *a, **k: (out := states(*a, **k), kept.update(t=out.collect()))[0])
    out = H.hmm_scores(documents(spark, rows), vocabulary=3, listed=6, classes=2, states=2, first=2, iterations=1).collect()
    e, table = kept["e"], {bytes(r["word"]): r["g"] for r in kept["t"]}
    text = dict(rows)

    def emission(w):
        if w in e.symbols.index:
            return e.matrix[e.symbols.index[w]]
        return e.rare(np.array([e.symbols.class_of(w)]), np.array([table.get(w, [0.0, 0.0])], "f8"))[0]

    for r in out:
        each = [emission(w) for w in H.words(text[r["doc_id"]].encode())] + [e.matrix[-1]]
        p = 0.0
        for path in itertools.product(range(2), repeat=len(each)):
            q = e.model.start[path[0]] * each[0][path[0]]
            for t in range(1, len(each)):
                q *= e.model.trans[path[t - 1], path[t]] * each[t][path[t]]
            p += q
        assert abs(math.log10(p) - r["score"]) < 1e-6


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert held(H.op10_hmm_scoring(spark, sf)) == base(rows)

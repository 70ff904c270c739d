import hashlib
from collections import Counter

from lexigrid.llm import source_mixing as M

from .helpers import clashing, documents, edge_rows


def brute(rows, weights=(5, 2, 1)):
    """(doc_id, size, target, taken) by queueing one item after another."""
    size = lambda t: len((t or "").encode().split())
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in sources}
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    aim, open_, budget = {}, set(sources), 1.5 * sum(total.values())
    while open_:
        level = (budget - sum(aim.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] <= level * weight[s]}
        if not full:
            aim |= {s: level * weight[s] for s in open_}
            break
        aim |= {s: 2.0 * total[s] for s in full}
        open_ -= full
    key = lambda r: (int(hashlib.md5(f"{'' if r[0] is None else r[0]}:mix".encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0, size(r[1]))
    items = []
    for s in sources:
        upto = 0
        for again in range(2):
            for r in sorted((r for r in rows if r[2] == s), key=key):
                upto += size(r[1])
                if size(r[1]):
                    items.append((upto / aim[s], r))
    taken, run, items = {id(r): 0 for r in rows}, 0, sorted(items, key=lambda x: x[0])
    for at in sorted({v for v, _ in items}):
        now = [r for v, r in items if v == at]
        run += sum(size(r[1]) for r in now)
        if run > budget:
            break
        for r in now:
            taken[id(r)] += size(r[1])
    return sorted(((r[0], size(r[1]), round(aim[r[2]], 6), taken[id(r)]) for r in rows), key=repr), aim


def held(df):
    return sorted(((r["doc_id"], r["size"], round(r["target"], 6), r["taken"]) for r in df.collect()), key=repr)


def fixture():
    rows = [(100 + i, "w " * (i % 9 + 1), "abcdefg"[min(i % 11, 6)]) for i in range(300)]
    return rows + [(*r, None) for r in edge_rows() if r[0] not in (6, 7)]


def test_against_queueing(spark):
    rows = fixture()
    df = clashing(documents(spark, rows))
    want, aims = brute(rows)
    assert held(M.mix_decisions(df)) == want
    assert held(M.mix_decisions(df, slices=3)) == want
    kept = M.mix_documents(df)
    assert kept.columns == df.columns
    times = {i: t // n for i, n, _, t in want if n and i is not None and i != 11}
    got = Counter(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None and r["doc_id"] != 11)
    assert got == {i: t for i, t in times.items() if t}


def test_targets_are_met(spark):
    rows = fixture()
    out = M.mix_decisions(documents(spark, rows)).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 12 for r in out)


def test_empty(spark):
    df = documents(spark, fixture())
    assert M.mix_decisions(df.limit(0)).count() == 0
    assert held(M.mix_decisions(documents(spark, [(1, "", "a"), (2, None, None)]))) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]

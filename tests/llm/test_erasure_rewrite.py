import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import erasure_rewrite as X
from lexigrid.llm._shared import hadoop_path, new_path

AMOUNT = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def crc(x):
    return zlib.crc32(("" if x is None else str(x)).encode())


def by_columns(row):
    return tuple((v is not None, v) if v is not None else (False,) for v in row)


def expected(shop, files=X.FILES, modulus=X.VICTIM_MODULUS):
    """table, file_no: the surviving rows of the files that are left, and how many rows went."""
    sales_owner = defaultdict(list)
    for r in shop["sales"][1]:
        sales_owner[r["sale_id"]].append(r["client_id"])
    owner = {k: min((c for c in v if c is not None), default=None) for k, v in sales_owner.items() if k is not None}
    clicked = Counter(r["client_id"] for r in shop["clicks"][1])
    of = defaultdict(set)
    for r in shop["clients"][1]:
        if r["master_id"] is not None:
            of[r["master_id"]].add(r["client_id"])
    victims = {m for m in of if crc(m) % modulus == 0}
    if of:
        victims.add(min(of, key=lambda m: (-sum(clicked[c] for c in of[m] if c is not None), m)))
    clients = {c for m in victims for c in of[m] if c is not None}
    gone_sales = {r["sale_id"] for r in shop["sales"][1] if r["client_id"] in clients and r["sale_id"] is not None}
    hit = {"clients": lambda r: r["master_id"] in victims, "clicks": lambda r: r["client_id"] in clients, "sales": lambda r: r["client_id"] in clients, "sale_lines": lambda r: r["sale_id"] in gone_sales}
    out = {}
    for t, (names, rows) in shop.items():
        key = (lambda r: crc(owner.get(r["sale_id"]))) if t == "sale_lines" else (lambda r: crc(r["client_id"]))
        rows = sorted(rows, key=lambda r: (key(r), by_columns(r[n] for n in names)))
        size = 1 + len(rows) // files
        for no in range(math.ceil(len(rows) / size)):
            own = rows[no * size : (no + 1) * size]
            left = [r for r in own if not hit[t](r)]
            if left:
                out[t, no] = (names, left, len(own) - len(left))
    return out


def shop_rows(shop):
    return {t: (df.columns, [r.asDict() for r in df.collect()]) for t, df in shop.items()}


def agree(out, want, folder=None):
    rows = out.collect()
    assert Counter((r["table_name"], r["file_no"]) for r in rows) == Counter(want.keys())
    for r in rows:
        names, left, gone = want[r["table_name"], r["file_no"]]
        cents = sum(math.floor(100 * x + 0.5) for x in (q[AMOUNT[r["table_name"]]] for q in left) if x is not None)
        ids = ",".join("" if q[names[0]] is None else str(q[names[0]]) for q in left)
        assert (r["n_rows"], r["n_erased"], r["cents"], r["rewritten"], r["columns"]) == (len(left), gone, cents, gone > 0, ",".join(names))
        assert r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
        file = pq.ParquetFile(r["path"])
        assert [tuple(q.values()) for q in file.read().to_pylist()] == [tuple(q[n] for n in names) for q in left]
        for i, n in enumerate(names):  # the footer speaks of survivors only
            stats = [file.metadata.row_group(g).column(i).statistics for g in range(file.metadata.num_row_groups)]
            have = [q[n] for q in left if q[n] is not None]
            if have and all(s and s.has_min_max for s in stats) and isinstance(have[0], int):
                assert (min(s.min for s in stats), max(s.max for s in stats)) == (min(have), max(have))
    if folder:
        there = {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if not f.startswith((".", "_"))}
        assert there == {r["path"] for r in rows}


def whole(spark, shop, files=X.FILES, modulus=X.VICTIM_MODULUS):
    laid, owners = X.lay_out_shop(spark, shop, new_path(spark, "erasure"), files=files)
    kept = {f.path: os.stat(f.path.removeprefix("file:")).st_mtime_ns for f in laid.files}
    left, erased = X.erase(spark, laid, X.shop_victims(shop, owners, X.victim_masters(shop["clients"], shop["clicks"], modulus)))
    assert all(os.stat(f.path.removeprefix("file:")).st_mtime_ns == kept[f.path] for f in left.files if f.path not in erased)
    return X.describe(spark, left, erased), laid.folder.removeprefix("file:")


def test_query(spark, sf):
    shop = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in AMOUNT}
    agree(X.op11_erasure_rewrite(spark, sf), expected(shop_rows(shop)))


def small(spark, n=400):
    clients = [(i if i % 17 else None, i // 3 if i % 5 else None, "x", float(i)) for i in range(60)] + [(7, 2, "again", None), (7, 11, "again", float("nan"))]
    clicks = [(i, (7 if i % 3 else i % 60) if i % 11 else None, "k" * (i % 4), None if i % 9 == 0 else i * 0.125) for i in range(n)]
    sales = [(i % 150 if i % 13 else None, i % 60 if i % 7 else None, i * 1.5) for i in range(200)]
    lines = [(5 if i % 3 == 0 else i % 170 if i % 19 else None, i % 4, i / 8) for i in range(n)]
    shop = {
        "clients": spark.createDataFrame(clients, "client_id long, master_id long, hash string, balance double"), "clicks": spark.createDataFrame(clicks, "click_id long, client_id long, file_no string, value double"),
        "sales": spark.createDataFrame(sales, "sale_id long, client_id long, total double"), "sale_lines": spark.createDataFrame(lines, "sale_id long, row int, amount double"),
    }
    shop["clients"] = shop["clients"].filter("not isnan(balance) or balance is null")
    return {t: df.unionByName(df.limit(20)) for t, df in shop.items()}


@pytest.mark.parametrize("files", [1, 7, 350])
def test_hot_keys_nulls_repeats_and_clashing_names(spark, files):
    shop = {t: df.cache() for t, df in small(spark).items()}
    out, folder = whole(spark, shop, files=files, modulus=5)
    agree(out, expected(shop_rows(shop), files, 5), folder)


def test_empty_tables(spark):
    shop = small(spark)
    none = {t: df.limit(0) for t, df in shop.items()}
    assert whole(spark, none)[0].count() == 0
    shop |= {"clients": none["clients"], "sale_lines": none["sale_lines"]}
    shop = {t: df.cache() for t, df in shop.items()}
    out, folder = whole(spark, shop, files=7)
    agree(out, expected(shop_rows(shop), 7), folder)
    assert not out.filter("n_erased > 0").count()


def test_long_texts_and_spilling(spark):
    clicks = spark.range(3000).select(F.col("id").alias("click_id"), (F.col("id") % 7).alias("client_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), F.when(F.col("id") % 500 == 0, 20_000).otherwise(20)).alias("props"), F.lit(1.0).alias("value"))
    shop = {t: df for t, df in small(spark).items()} | {"clicks": clicks}
    shop = {t: df.cache() for t, df in shop.items()}
    out, folder = whole(spark, shop, files=2, modulus=5)
    agree(out, expected(shop_rows(shop), 2, 5), folder)


def test_recovery_of_a_driver_that_died_between_swaps(spark, monkeypatch):
    shop = {t: df.cache() for t, df in small(spark).items()}
    laid, owners = X.lay_out_shop(spark, shop, new_path(spark, "erasure"), files=7)
    victims = X.shop_victims(shop, owners, X.victim_masters(shop["clients"], shop["clicks"], 5))
    swap = X._swap

    def dies(spark, swaps):
        swap(spark, swaps[: len(swaps) // 2])
        raise KeyboardInterrupt

    monkeypatch.setattr(X, "_swap", dies)
    with pytest.raises(KeyboardInterrupt):
        X.erase(spark, laid, victims)
    monkeypatch.setattr(X, "_swap", swap)
    assert X.recover(spark, laid.folder) and not X.recover(spark, laid.folder)
    want = expected(shop_rows(shop), 7, 5)
    left = [f for f in laid.files if (f.table, f.file_no) in want]
    agree(X.describe(spark, X.Laid(laid.folder, tuple(left), laid.columns), {f.path: want[f.table, f.file_no][2] for f in left}), want, laid.folder.removeprefix("file:"))


def test_files_off_mounted_file_systems_are_streamed(spark, monkeypatch):
    monkeypatch.setattr(X, "local_path", lambda uri: None)  # as for a store: copied in and out by pyarrow
    rewriter = X._Rewriter(new_path(spark, "staging"), "256MB")
    p, fs = hadoop_path(spark, rewriter.staging)
    fs.mkdirs(p)
    path = new_path(spark, "one")
    spark.range(100).coalesce(1).write.parquet(path)
    (file,) = (f"{path}/{f}" for f in os.listdir(path.removeprefix("file:")) if f.startswith("part"))
    import pyarrow as pa

    rewriter.add(pa.array([3, 4, 1000]))
    n, out = rewriter.rewrite(X.LaidFile("t", 0, file, 100, (0,), (0,)), "id")
    rewriter.close()
    assert n == 2 and [r[0] for r in spark.read.parquet(out).collect()] == [i for i in range(100) if i not in (3, 4)]

r"""Cascading erasure: rows of victims leave sorted Parquet files, and only the files that hold some are rewritten.

lay_out() writes a table as files of consecutive rows in the order of a hash of the owner's id and then of all columns, and keeps each file's
first and last place in that order. erase() routes each victim's key to the files whose range can hold it (a search over the files'
bounds, as many as the table has files), shuffles keys to their file's task and lets an embedded DuckDB do that file: it reads the
original, drops the rows whose key is in the file's shard by an anti-join, sorts by the original row number and copies the survivors out.
A file without a victim row isn't touched; one without a survivor is removed.

Recovery: a task writes under a name of its own attempt and only accepted attempts are reported, so a lost executor costs its files only.
The driver then writes a journal of the swaps, and swaps. recover() ends what a driver that died has left.

Memory: DuckDB works within `memory` and spills to the task's own temporary folder, which goes with the task; keys of a shard
stream into it. A file outside mounted file systems is streamed to that folder first, and the survivors back.

Defined results
* null keys are never victims, and a null owner counts as the empty text in the order.
* a repeated row is a row; repeated victims count once. An owner with two masters loses the rows of the victim master in `clients`,
  and all other rows; of a sale with two owners the smallest decides where its lines stand, and any victim erases them.
* an empty table has no files. Columns keep names, order and values whatever they are called; amounts that are null or not finite count 0 cents.
* texts are copied whatever their length.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
import uuid
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm._shared import file_system, forget, hadoop_path, local_path, new_path, numbered, ship, table, written

FILES = 350
VICTIM_MODULUS = 400


@dataclass(frozen=True)
class LaidFile:
    """One file and the places (hash, first column) of its first and last row in the order; a null first column is (0,), others (1, value)."""

    table: str
    file_no: int
    path: str
    n_rows: int
    lo: tuple
    hi: tuple


@dataclass(frozen=True)
class Laid:
    folder: str
    files: tuple
    #: table name: (key column of the anti-join, column of the amounts)
    columns: dict


def owner_hash(col):
    """crc32 of an id's decimal digits; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def _place(hash_: int, first) -> tuple:
    return (hash_, (0,) if first is None else (1, first))


def _tasks(spark: SparkSession, files: int, rows: int) -> int:
    """Tasks for so many files: neighbours share one while they are short, at a million rows and beyond a file has its own."""
    return max(1, min(files, max(4 * spark.sparkContext.defaultParallelism, rows // 1_000_000)))


def lay_out(rows: DataFrame, folder: str, name: str, *, files: int = FILES) -> list[LaidFile]:
    """Write rows (struct `row` of a table's columns, `hash`) under folder/name, sorted by hash and then all columns, nulls first, in files of 1 + floor(n / files) consecutive rows.

    Returns at most `files` entries, so they may stay on the driver. Rows cross the network twice: to be sorted, and to their file's task."""
    spark = rows.sparkSession
    placed = numbered(rows.select("hash", "row"), ["hash", "row"], f"sorted-{name}", name="pos")
    size = 1 + placed._lexigrid_rows // files
    names = rows.schema["row"].dataType.names
    number = "file_no"
    while number.lower() in {c.lower() for c in names}:
        number += "_"
    first = F.col("row").getField(names[0])
    numbers = placed.select("hash", "row", "pos", F.floor(F.col("pos") / size).cast("long").alias("no"))
    bounds = numbers.groupBy("no").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("hash", first.alias("first"))).alias("lo"), F.max(F.struct("hash", first.alias("first"))).alias("hi")).collect()
    if not bounds:
        forget(placed)
        return []
    at, tasks = f"{folder}/{name}", _tasks(spark, len(bounds), placed._lexigrid_rows)
    dealt = numbers.repartitionById(tasks, F.floor(F.col("no") * tasks / len(bounds)).cast("int")).sortWithinPartitions("no", "pos")
    dealt.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("no").alias(number)).write.partitionBy(number).parquet(f"{at}/_parts")
    forget(placed)
    p, fs = hadoop_path(spark, f"{at}/_parts/{number}=*/*.parquet")
    paths = {}
    for part in (x.getPath() for x in fs.globStatus(p)):  # readers take folders named so for a column, so the files leave them
        no = int(re.search(rf"/{number}=(\d+)/", part.toString())[1])
        paths[no] = f"{at}/file-{no:05d}.parquet"
        if not fs.rename(part, hadoop_path(spark, paths[no])[0]):
            raise OSError(f"{part.toString()} can't be moved to {paths[no]}")
    fs.delete(hadoop_path(spark, f"{at}/_parts")[0], True)
    return [LaidFile(name, r["no"], paths[r["no"]], r["n"], _place(*r["lo"]), _place(*r["hi"])) for r in sorted(bounds, key=lambda r: r["no"])]


def _routed(batches, bounds: dict):
    """name, hash, first, key to file and key: all files whose range can hold the place; first is null where only the hash is known."""
    import pyarrow as pa

    for batch in batches:
        idx, keys = [], []
        for name, hash_, known, first, key in zip(*(c.to_pylist() for c in batch.columns)):
            los, his, at = bounds.get(name, ((), (), 0))
            if known:
                place = _place(hash_, first)
                lo, hi = bisect_left(his, place), bisect_right(los, place)
            else:
                lo, hi = bisect_left(his, (hash_,)), bisect_left(los, (hash_ + 1,))
            idx.extend(range(at + lo, at + hi))
            keys.extend([key] * (hi - lo))
        yield pa.RecordBatch.from_arrays([pa.array(idx, pa.int64()), pa.array(keys, pa.int64())], names=["file", "key"])


class _Rewriter:
    """The embedded database of one task."""

    def __init__(self, staging: str, memory: str):
        import duckdb

        self.own = tempfile.mkdtemp(prefix="erasure-")
        self.staging = staging
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": f"{self.own}/spill"})
        self.con.execute("SET preserve_insertion_order = true")
        self.con.execute("CREATE TABLE shard(key BIGINT)")

    def add(self, keys) -> None:
        import pyarrow as pa

        self.con.register("arrived", pa.table({"key": keys}))
        self.con.execute("INSERT INTO shard SELECT key FROM arrived")
        self.con.unregister("arrived")

    def rewrite(self, file: LaidFile, key: str) -> tuple[int, str | None]:
        """Rows erased, and the survivors' file, None where nothing or everything goes."""
        source, copy = local_path(file.path), None
        if source is None:
            source = copy = f"{self.own}/original.parquet"
            fs, at = file_system(file.path)
            with fs.open_input_stream(at) as a, open(copy, "wb") as b:
                shutil.copyfileobj(a, b, 1 << 23)
        text = lambda s: "'" + s.replace("'", "''") + "'"
        name = '"' + key.replace('"', '""') + '"'
        number = "file_row_number"
        read = f"read_parquet({text(source)}, file_row_number = true, hive_partitioning = false)"
        out, n = None, self.con.execute(f"SELECT count(*) FROM (SELECT {name} AS k FROM read_parquet({text(source)}, hive_partitioning = false)) AS o SEMI JOIN shard ON o.k = shard.key").fetchall()[0][0]
        if 0 < n < file.n_rows:
            out = f"{self.staging}/{file.table}-{file.file_no}-{uuid.uuid4().hex}.parquet"
            target = local_path(out) or f"{self.own}/survivors.parquet"
            self.con.execute(f"COPY (SELECT o.* EXCLUDE ({number}) FROM {read} AS o ANTI JOIN shard ON o.{name} = shard.key ORDER BY o.{number}) TO {text(target)} (FORMAT parquet, COMPRESSION snappy)")
            if local_path(out) is None:
                fs, at = file_system(out)
                with open(target, "rb") as a, fs.open_output_stream(at) as b:
                    shutil.copyfileobj(a, b, 1 << 23)
                os.remove(target)
        self.con.execute("DELETE FROM shard")
        if copy:
            os.remove(copy)
        return n, out

    def close(self) -> None:
        self.con.close()
        shutil.rmtree(self.own, ignore_errors=True)


def _rewritten(batches, files: tuple, columns: dict, staging: str, memory: str):
    """Keys sorted by file; one row a file that held victims."""
    import numpy as np
    import pyarrow as pa

    worker, at = None, None
    done = lambda n, out: pa.RecordBatch.from_pylist([{"file": at, "n_erased": n, "staged": out}], schema=pa.schema([("file", pa.int64()), ("n_erased", pa.int64()), ("staged", pa.string())]))
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            worker = worker or _Rewriter(staging, memory)
            no = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, no[1:] != no[:-1]])
            for a, b in zip(starts, np.r_[starts[1:], len(no)]):
                if at is not None and at != no[a]:
                    yield done(*worker.rewrite(files[at], columns[files[at].table][0]))
                at = int(no[a])
                worker.add(batch.column(1).slice(a, b - a))
        if at is not None:
            yield done(*worker.rewrite(files[at], columns[files[at].table][0]))
    finally:
        if worker:
            worker.close()


def _swap(spark: SparkSession, swaps: list) -> None:
    """[original, staged or None] each: repeatable, as a staged file that is gone has been moved."""
    for old, staged in swaps:
        a, fs = hadoop_path(spark, old)
        if staged is None:
            fs.delete(a, False)
            continue
        b, _ = hadoop_path(spark, staged)
        if fs.exists(b):
            fs.delete(a, False)
            if not fs.rename(b, a):
                raise OSError(f"{staged} can't be moved to {old}")


def recover(spark: SparkSession, folder: str) -> bool:
    """End the swaps that a driver began in this folder; whether there were any. Staged files without a journal are of an erasure that hadn't begun to swap, and go."""
    journal, fs = hadoop_path(spark, f"{folder}/_erasure/journal.json")
    there = fs.exists(journal)
    if there:
        pfs, at = file_system(f"{folder}/_erasure/journal.json")
        with pfs.open_input_stream(at) as f:
            _swap(spark, json.loads(f.read()))
    fs.delete(journal.getParent(), True)
    return there


def erase(spark: SparkSession, laid: Laid, victims: DataFrame, *, memory: str = "384MB") -> tuple[Laid, dict]:
    """Erase victims (table, hash, known, first, key) from the files. Returns what is left, and path: rows erased of each rewritten file.

    key: value of the table's key column; hash: of the owner; first: the rows' first column, where known is true."""
    ship(spark)
    order = sorted(laid.files, key=lambda f: (f.table, f.file_no))
    bounds = {}
    for i, f in enumerate(order):
        los, his, _ = bounds.setdefault(f.table, ([], [], i))
        los.append(f.lo)
        his.append(f.hi)
    staging = f"{laid.folder}/_erasure"
    fs, at = file_system(staging)
    fs.create_dir(at, recursive=True)
    tasks = _tasks(spark, len(order), sum(f.n_rows for f in order))
    keys = victims.select("table", "hash", "known", F.col("first").cast("long"), F.col("key").cast("long")).filter("key is not null")
    routed = keys.mapInArrow(lambda b: _routed(b, bounds), "file long, key long")
    routed = routed.repartitionById(tasks, (F.col("file") % tasks).cast("int")).sortWithinPartitions("file", "key")
    files, columns = tuple(order), laid.columns
    told = routed.mapInArrow(lambda b: _rewritten(b, files, columns, staging, memory), "file long, n_erased long, staged string").filter("n_erased > 0").collect()  # one row a file
    swaps = [[files[r["file"]].path, r["staged"]] for r in told]
    with fs.open_output_stream(f"{at}/journal.tmp") as out:
        out.write(json.dumps(swaps).encode())
    fs.move(f"{at}/journal.tmp", f"{at}/journal.json")
    recover(spark, laid.folder)
    erased = {files[r["file"]].path: r["n_erased"] for r in told}
    left = [LaidFile(f.table, f.file_no, f.path, f.n_rows - erased.get(f.path, 0), f.lo, f.hi) for f in files]
    return Laid(laid.folder, tuple(f for f in left if f.n_rows), columns), erased


def _described(batches, columns: dict):
    import hashlib

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    schema = pa.schema([("table_name", pa.string()), ("file_no", pa.int64()), ("n_rows", pa.int64()), ("n_erased", pa.int64()), ("cents", pa.int64()), ("rewritten", pa.bool_()), ("ids_sha256", pa.string()), ("columns", pa.string()), ("path", pa.string())])
    for batch in batches:
        for f in batch.to_pylist():
            fs, at = file_system(f["path"])
            with fs.open_input_file(at) as source:
                file = pq.ParquetFile(source)
                names = file.schema_arrow.names
                amount = columns[f["table_name"]][1]
                digest, n, cents = hashlib.sha256(), 0, 0
                for b in file.iter_batches(batch_size=65_536, columns=list(dict.fromkeys([names[0], amount]))):
                    ids = pc.fill_null(b.column(names[0]).cast(pa.string()), "").to_pylist()
                    digest.update(((("," if n else "") + ",".join(ids)) if ids else "").encode())
                    n += len(ids)
                    x = b.column(amount).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
                    cents += sum(map(int, np.floor(100 * np.where(np.isfinite(x), x, 0.0) + 0.5)))
            yield pa.RecordBatch.from_pylist([f | {"n_rows": n, "cents": cents, "rewritten": f["n_erased"] > 0, "ids_sha256": digest.hexdigest(), "columns": ",".join(names), "path": local_path(f["path"]) or f["path"]}], schema=schema)


def describe(spark: SparkSession, laid: Laid, erased: dict) -> DataFrame:
    """One row a file, read back from it: table_name, file_no, n_rows, n_erased, cents, rewritten, ids_sha256, columns, path."""
    ship(spark)
    columns = laid.columns
    rows = [(f.table, f.file_no, erased.get(f.path, 0), f.path) for f in laid.files]
    tasks = _tasks(spark, len(rows), sum(f.n_rows for f in laid.files))
    listed = spark.createDataFrame(spark.sparkContext.parallelize(rows, tasks), "table_name string, file_no long, n_erased long, path string")
    return listed.mapInArrow(lambda b: _described(b, columns), "table_name string, file_no long, n_rows long, n_erased long, cents long, rewritten boolean, ids_sha256 string, columns string, path string")


def _owners(sales: DataFrame) -> DataFrame:
    """sale, owner: the client of each sale, the smallest of several."""
    return sales.filter("sale_id is not null").groupBy(F.col("sale_id").alias("sale")).agg(F.min("client_id").alias("owner"))


def victim_masters(clients: DataFrame, clicks: DataFrame, modulus: int = VICTIM_MODULUS) -> DataFrame:
    """master_id: those whose crc32 divides by modulus, and the one whose clients together have most rows in clicks, of several the smallest."""
    pairs = clients.filter("master_id is not null").select("master_id", "client_id").distinct()
    clicked = clicks.filter("client_id is not null").groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    masters = pairs.select("master_id").distinct()
    most = pairs.join(clicked, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).orderBy(F.desc("n"), "master_id").limit(1)
    return masters.filter(owner_hash(F.col("master_id")) % modulus == 0).union(most.select("master_id")).distinct()


def lay_out_shop(spark: SparkSession, shop: dict[str, DataFrame], folder: str, *, files: int = FILES) -> tuple[Laid, DataFrame]:
    """The four tables in files, and the written owners of sales."""
    owners = written(_owners(shop["sales"]), "owners")
    keyed = {t: shop[t].select(F.struct(*[shop[t][c] for c in shop[t].columns]).alias("row"), owner_hash(shop[t]["client_id"]).alias("hash")) for t in ("clients", "clicks", "sales")}
    lines = shop["sale_lines"].select(F.struct(*[shop["sale_lines"][c] for c in shop["sale_lines"].columns]).alias("row"), shop["sale_lines"]["sale_id"].alias("sale"))
    keyed["sale_lines"] = lines.join(owners, "sale", "left").select("row", owner_hash(F.col("owner")).alias("hash"))
    out = [f for t, rows in keyed.items() for f in lay_out(rows, folder, t, files=files)]
    return Laid(folder, tuple(out), {"clients": ("master_id", "balance"), "clicks": ("client_id", "value"), "sales": ("client_id", "total"), "sale_lines": ("sale_id", "amount")}), owners


def shop_victims(shop: dict[str, DataFrame], owners: DataFrame, masters: DataFrame) -> DataFrame:
    """The victims' cascade, from masters to clients, their clicks and sales, and these sales' lines: table, hash, known, first, key."""
    own = written(shop["clients"].select("client_id", "master_id").join(masters, "master_id").distinct(), "victims")
    ids = own.filter("client_id is not null").select("client_id").distinct()
    hashed = owner_hash(F.col("client_id"))
    none = F.lit(None).cast("long")
    sold = shop["sales"].join(ids, "client_id", "left_semi").select(F.col("sale_id").alias("sale")).distinct().join(owners, "sale")
    parts = [own.select(F.lit("clients").alias("table"), hashed.alias("hash"), F.lit(True).alias("known"), F.col("client_id").alias("first"), F.col("master_id").alias("key"))]
    parts += [ids.select(F.lit(t).alias("table"), hashed.alias("hash"), F.lit(False).alias("known"), none.alias("first"), F.col("client_id").alias("key")) for t in ("clicks", "sales")]
    parts.append(sold.select(F.lit("sale_lines").alias("table"), owner_hash(F.col("owner")).alias("hash"), F.lit(True).alias("known"), F.col("sale").alias("first"), F.col("sale").alias("key")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op11_erasure_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    shop = {t: table(spark, sf_dir, t) for t in ("clients", "clicks", "sales", "sale_lines")}
    laid, owners = lay_out_shop(spark, shop, new_path(spark, "erasure"))
    left, erased = erase(spark, laid, shop_victims(shop, owners, victim_masters(shop["clients"], shop["clicks"])))
    return describe(spark, left, erased)

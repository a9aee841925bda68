"""What several operators share: reading tables, cutting lineage, batches of Arrow rows, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Materialise df and drop its lineage, in the shared folder that spark.checkpoint.dir names.

    Spark removes checkpoints that nothing refers to where spark.cleaner.referenceTracking.cleanCheckpoints is true.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for what is materialised. A temporary one is made for a local session only; a cluster whose
    setting is missing is an error, as its executors could not read each other's disks."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", context.master):  # local-cluster is a cluster
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sparkwright"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again; for what is wide or read by columns."""
    path = f"{checkpoint_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `written` made and nothing will read again."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/tables/"
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition(":")[2].lstrip("/") in path:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Keys with over one HOT-th of all rows are fewer than HOT.
HOT = 1000


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """rows with the columns of lookup, a materialised table of one row for each key; its column `n` says how many rows have
    the key, and goes. Hot keys, fewer than HOT, are joined by a broadcast, so that none is one task."""
    total = lookup.agg(F.sum("n")).first()[0] or 0  # one number
    marked = lookup.withColumn("_hot", F.col("n") > total / HOT).drop("n")
    hot = F.broadcast(marked.where("_hot").drop("_hot"))
    cold = marked.where("not _hot").drop("_hot")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty; no str objects are made."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def int_column(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Start offsets of the runs of equal keys in sorted columns, with the length at the end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(new), n)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, most: int = 1 << 18) -> Iterator[pa.Table]:
    """Tables that hold whole runs of a sorted key; only the run in hand and about `most` rows are held."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        whole = pa.Table.from_batches(held)
        keys = int_column(whole[key].combine_chunks())
        end = int(np.searchsorted(keys, keys[-1]))
        if end:
            yield whole.slice(0, end)
            held = whole.slice(end).combine_chunks().to_batches()
            rows -= end
        else:
            most = 2 * rows  # one long run: look again when it has doubled
    if held:
        yield pa.Table.from_batches(held)


def runs_or_pieces(batches: Iterator[pa.RecordBatch], key: str, most: int, longest: int) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole runs of a sorted key as (rows, False), and runs of over `longest` rows in pieces as (rows, True)."""
    held: list[pa.RecordBatch] = []
    rows, inside = 0, None  # inside: the key of a long run whose first pieces are gone
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        whole = pa.Table.from_batches(held)
        keys = int_column(whole[key].combine_chunks())
        if inside is not None:
            end = int(np.searchsorted(keys, inside, side="right"))
            if end:
                yield whole.slice(0, end), True
            whole, keys = whole.slice(end), keys[end:]
            inside = inside if not len(keys) else None
        if len(keys):
            end = int(np.searchsorted(keys, keys[-1]))
            if end:
                yield whole.slice(0, end), False
            whole = whole.slice(end)
            if whole.num_rows > longest:
                inside = keys[-1]
                yield whole, True
                whole = whole.slice(0, 0)
        held, rows = whole.combine_chunks().to_batches(), whole.num_rows
    if held and rows:
        whole = pa.Table.from_batches(held)
        keys = int_column(whole[key].combine_chunks())
        end = int(np.searchsorted(keys, inside, side="right")) if inside is not None else 0
        if end:
            yield whole.slice(0, end), True
        if end < len(keys):
            yield whole.slice(end), False


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every node of an undirected edge list; two nodes have one root iff a path joins them.

    Each round maps every node to the first neighbour (or itself) and contracts the edges. Even rounds go by id, which ends
    stars at once; odd rounds go by a random priority, which shrinks the expected number of nodes by a constant factor, so
    the rounds grow with the logarithm of the nodes, chains included. Edges and assignments stay distributed: joins are sort-merge joins, so that no round passes through the
    driver as a broadcast, and each round ends in a checkpoint. Null ends are ignored.
    """
    first = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    first = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    live = cut(first)
    assigned = None
    turn = 0
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = F.lit(0).cast("long") if turn % 2 == 0 else None
        rank = lambda c: F.struct((F.xxhash64(F.col(c), F.lit(turn)) if order is None else order).alias("r"), F.col(c).alias("id"))  # noqa: B023, E731
        step = cut(both.groupBy("u").agg(F.least(F.min(rank("v")), F.min(rank("u")))["id"].alias("p")))
        if assigned is None:
            assigned = step.select(F.col("u").alias("id"), F.col("p").alias("root"))
        else:
            assigned = cut(
                assigned.join(step.hint("merge"), assigned["root"] == step["u"], "left").select("id", F.coalesce("p", "root").alias("root"))
            )
        pu, pv = step.select("u", F.col("p").alias("pu")), step.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        live = live.join(pu.hint("merge"), "u").join(pv.hint("merge"), "v").where("pu <> pv")
        live = cut(live.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        turn += 1
    if assigned is None:
        return first.select(F.col("u").alias("id"), F.col("v").alias("root")).limit(0)
    return assigned

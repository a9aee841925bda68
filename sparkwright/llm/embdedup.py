"""Embedding near-duplicates by cross-polytope hashing.

A vector is padded to a power of two and rotated by three rounds of random signs and a fast Hadamard transform; its hash is
the axis (with sign) nearest to the rotated vector. AXES such hashes make the bucket of one table, and TABLES tables are
kept. Multiprobe: a vector also stands in the buckets where its least certain axis gives way to the second best (PROBES
buckets in each table). What is dealt to buckets first is an id, not the vector: only vectors that have a bucket mate go on. All
pairs that share a bucket are then compared by their cosine in double precision; nothing else decides who is compared.

Copies collapse first: only distinct vectors are hashed, each with its number of rows. A pair that meets in several buckets
is counted in the first of them only, which both sides' hashes tell, so links are counted exactly without a table of pairs:
each bucket leaves, for a vector that has links there, their number and the smallest vector of its local group. A vector is
hashed once, and its hashes go along with it. Buckets of
more than `tile` vectors are cut into tiles by a hash, and pairs of tiles are keys of their own, so no task holds such a
bucket. Components of the local links are found by distributed contraction.

Defined cases: rows whose vector is null, empty, zero, or holds null or non-finite components link with nothing, and so do
those with a null id; vectors of different lengths never link; each row is a vector, so rows that repeat link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.ann import usable
from sparkwright.llm.common import components, cut, int_column, join_lookup, runs, runs_or_pieces, whole_runs

TABLES, AXES, PROBES, ROUNDS, TILE, SEED = 14, 3, 2, 3, 4096, 5


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row."""
    n, d = rows.shape
    step = 1
    while step < d:
        pairs = rows.reshape(n, d // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return rows


def codes(vectors: np.ndarray, tables: int = TABLES, axes: int = AXES, probes: int = PROBES) -> np.ndarray:
    """[row, table, probe]: the axes of each bucket as one number, the first probe being the vector's own bucket."""
    n, dim = vectors.shape
    wide = max(2, 1 << (dim - 1).bit_length())
    padded = np.zeros((n, wide), np.float32)
    padded[:, :dim] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rng = np.random.default_rng(SEED)
    out = np.empty((n, tables, probes), np.int64 if (2 * wide) ** axes >= 1 << 31 else np.int32)
    for t in range(tables):
        best, second, gap = (np.empty((n, axes), np.int64), np.empty((n, axes), np.int64), np.empty((n, axes)))
        for a in range(axes):
            turned = padded
            for _ in range(ROUNDS):
                turned = hadamard(turned * rng.choice(np.float32([-1, 1]), wide)) / np.float32(wide**0.5)
            size = np.abs(turned)
            first = np.argpartition(size, wide - 2, axis=1)[:, -2:]
            value = np.take_along_axis(size, first, axis=1)
            swap = value[:, 0] > value[:, 1]
            first[swap] = first[swap][:, ::-1]
            signed = first * 2 + (np.take_along_axis(turned, first, axis=1) < 0)
            second[:, a], best[:, a] = signed[:, 0], signed[:, 1]
            gap[:, a] = np.abs(value[:, 1] - value[:, 0])
        order = np.argsort(gap, axis=1)
        for p in range(probes):
            code = best.copy()
            if p:
                at = order[:, p - 1 : p]
                np.put_along_axis(code, at, np.take_along_axis(second, at, axis=1), axis=1)
            key = np.zeros(n, np.int64)
            for a in range(axes):
                key = key * (2 * wide) + code[:, a]
            out[:, t, p] = key
    return out


def bucket_keys(found: np.ndarray, dim: int, axes: int) -> np.ndarray:
    """Keys of codes [row, table, probe]: table, length of the vectors and code."""
    wide = max(2, 1 << (dim - 1).bit_length())
    table = np.arange(found.shape[1])[None, :, None] * 4096 + dim % 4096
    return table * (2 * wide) ** axes + found


def buckets(vectors: np.ndarray, tables: int = TABLES, axes: int = AXES, probes: int = PROBES) -> np.ndarray:
    """[row, table, probe]: bucket keys, the first probe being the vector's own bucket."""
    return bucket_keys(codes(vectors, tables, axes, probes), vectors.shape[1], axes)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [None if v is None else v.tobytes() for v in usable(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["vec_id", "v"])


def matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _hashed(tables: int, axes: int, probes: int):
    """(rep, n, v, codes): each vector with the codes of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes = np.array([len(x) for x in part.column(2).to_pylist()])
                for size in np.unique(sizes):
                    own = part.filter(pa.array(sizes == size))
                    vectors = matrix(own.column(2))
                    found = [c.tobytes() for c in codes(vectors, tables, axes, probes)]
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, pa.binary())], names=["rep", "n", "v", "codes"])

    return run


def code_matrix(column, dim: int, tables: int, axes: int, probes: int) -> np.ndarray:
    wide = max(2, 1 << (dim - 1).bit_length())
    kind = np.int64 if (2 * wide) ** axes >= 1 << 31 else np.int32
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), tables, probes)


def _keyed(tables: int, axes: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = int_column(batch.column(1)) // 8
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                keys = bucket_keys(code_matrix(own.column(2), int(dim), tables, axes, probes), int(dim), axes).reshape(own.num_rows, -1)
                rows = pa.array(np.repeat(np.arange(own.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), own.column(0).take(rows)], names=["key", "rep"])

    return run


def _with_mates(most: int):
    """(key, rep) of the rows that are not alone in their key. A key of over `most` rows goes through in pieces, so no more than about
    `most` of its rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, longer in runs_or_pieces(batches, "key", max(1 << 17, 2 * most), most):
            sizes = np.diff(runs(int_column(rows["key"].combine_chunks())))
            keep = pa.array(np.repeat((sizes > 1) | longer, sizes))
            for batch in rows.select(["key", "rep"]).filter(keep).combine_chunks().to_batches():
                yield batch

    return run


def first_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest key of the first table in which rows of two [row, table, probe] arrays of keys share a bucket."""
    out = np.full(len(left), -1, np.int64)
    for t in range(left.shape[1]):
        same = left[:, t, :, None] == right[:, t, None, :]
        key = np.where(same.any(axis=2), left[:, t], np.iinfo(np.int64).max).min(axis=1)
        hit = (out < 0) & same.any(axis=(1, 2))
        out[hit] = key[hit]
    return out


def _compared(least: float, tables: int, axes: int, probes: int):
    """Each vector's links in its bucket (or pair of tiles) that are counted there, and its local group's first vector."""

    def pairs_of(own: np.ndarray, tile: np.ndarray, sizes: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of rows of one key that are to be compared, i < j, in pieces."""
        small = np.repeat(sizes <= 32, sizes)
        rows = np.flatnonzero(small)
        key = np.repeat(np.arange(len(sizes)), sizes)[rows]
        for offset in range(1, 32):
            if offset >= len(rows):
                break
            same = key[offset:] == key[:-offset]
            yield rows[:-offset][same], rows[offset:][same]
        for k in np.flatnonzero(sizes > 32):
            a, b = edges[k], edges[k + 1]
            for low in range(a, b, 256):
                top = min(low + 256, b)
                rough = own[low:top] @ own[low:b].T
                i, j = np.nonzero(rough >= least - 1e-9)
                keep = i < j
                yield i[keep] + low, j[keep] + low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "key", 1 << 14):
            lengths = np.array([len(x) for x in rows["v"].to_pylist()])
            for size in np.unique(lengths):
                part = rows.filter(pa.array(lengths == size)) if len(np.unique(lengths)) > 1 else rows
                key, base, tile, cross, rep, n = (int_column(part[c].combine_chunks()) for c in ("key", "bucket", "tile", "cross", "rep", "n"))
                vectors = matrix(part["v"])
                norms = np.linalg.norm(vectors, axis=1)
                unit = vectors / norms[:, None]
                edges = runs(key)
                sizes = np.diff(edges)
                count, label = np.zeros(len(key), np.int64), np.arange(len(key))
                found_any = np.zeros(len(key), bool)
                hashes = bucket_keys(code_matrix(part["codes"], int(size) // 8, tables, axes, probes), int(size) // 8, axes)
                for i, j in pairs_of(unit, tile, sizes, edges):
                    for at in range(0, len(i), 1 << 18):
                        a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                        other = ~cross[a].astype(bool) | (tile[a] != tile[b])  # pairs within a tile belong to its own key
                        a, b = a[other], b[other]
                        hit = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norms[a] * norms[b]) >= least
                        a, b = a[hit], b[hit]
                        if not len(a):
                            continue
                        both = np.unique(np.concatenate([a, b]))
                        for p in range(0, len(a), 1 << 15):
                            s = slice(p, p + (1 << 15))
                            mine = first_shared(hashes[a[s]], hashes[b[s]]) == base[a[s]]
                            np.add.at(count, a[s][mine], n[b[s][mine]])
                            np.add.at(count, b[s][mine], n[a[s][mine]])
                        found_any[both] = True
                        while True:  # local groups: both ends take the smaller label until nothing changes
                            low = np.minimum(label[a], label[b])
                            if (low == label[a]).all() and (low == label[b]).all():
                                break
                            np.minimum.at(label, label[a], low)
                            np.minimum.at(label, label[b], low)
                            np.minimum.at(label, a, low)
                            np.minimum.at(label, b, low)
                            while (label[label] != label).any():
                                label = label[label]
                some = np.flatnonzero(found_any)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(count[some]), pa.array(rep[label[some]])], names=["rep", "links", "leader"])

    return run


def embedding_groups(
    rows: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", tables: int = TABLES,
    axes: int = AXES, probes: int = PROBES, tile: int = TILE,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row, by links of cosine `least` or more."""
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    vectors = cut(own.mapInArrow(_usable, "vec_id long, v binary"))
    good = vectors.where("vec_id is not null and v is not null")
    classes = cut(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    hashed = classes.select("rep", "n", "v").mapInArrow(_hashed(tables, axes, probes), "rep long, n long, v binary, codes binary")
    hashed = cut(hashed)
    slim = hashed.select("rep", F.length("v").cast("long").alias("bytes"), "codes")
    keyed = slim.mapInArrow(_keyed(tables, axes, probes), "key long, rep long")
    mates = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_with_mates(tile), "key long, rep long"))
    held = mates.groupBy("key").count().withColumn("tiles", F.expr(f"cast(ceil(count / {tile}) as long)")).select("key", "tiles")
    rows2 = mates.join(held, "key").join(hashed, "rep").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    pairs = rows2.withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)")))
    pairs = pairs.select(
        F.when(F.col("tiles") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))).alias("key"),
        F.col("key").alias("bucket"), "tile", (F.col("tile") != F.col("other")).alias("cross_row"), "other", "tiles", "rep", "n", "v", "codes",
    ).withColumn("cross", F.when(F.col("cross_row"), 1).otherwise(0))
    pairs = pairs.select("key", "bucket", "tile", "cross", "rep", "n", "v", "codes")
    local = cut(pairs.repartition("key").sortWithinPartitions("key").mapInArrow(_compared(least, tables, axes, probes), "rep long, links long, leader long"))
    links = local.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(local.select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    named = classes.join(links, "rep", "left").join(roots, classes["rep"] == roots["id"], "left")
    named = cut(named.select("v", F.col("n").alias("rows"), "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root")))
    smallest = cut(named.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("n")))
    named = join_lookup(named, smallest, "root").select("v", F.col("rows").alias("n"), (F.col("links") + F.col("rows") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    out = join_lookup(good, cut(named), "v").select("vec_id", "n_links", "component_id")
    alone = vectors.where("vec_id is null or v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

"""Nearest neighbours by a block matrix join with int8 product tiles.

Candidates are dealt to slabs and queries to groups by a hash of their ids; each (slab, group) pair is one key of the join,
so every query meets every candidate once, in blocks, and no pair of rows is ever a row of a table. Under one key, vectors
are scaled to int8; tiles of int8 products (exact in float32 arithmetic) give every inner product with a bound on its
quantisation error. Pairs whose upper bound is below the k-th largest lower bound, or below the k-th exact score that the
query has so far, are out; those that survive are computed again in double precision from the original vectors and go into a
heap of k for each query. The heaps of all slabs are merged by query. Nothing is approximate in the result.

Scale. Slabs grow with the input up to SLAB_MOST rows, which bounds a task's memory; queries stream by in tiles, so a group of
queries is GROUP slabs large and candidates are copied that much less often. A query leaves k rows for each slab.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; candidates of
another length than the query take no part in its result; a null id takes no part; ties go to the smaller id; a query's own
id is no candidate, and rows that repeat an id are one candidate if their vectors are equal.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import cut, int_column, runs, whole_runs

SLAB_LEAST, SLAB_MOST, SLABS, GROUP, TILE = 4096, 131_072, 64, 16, 128


def usable(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector as float64; None where it is null, empty, zero, or holds null or non-finite components."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become nan
    offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    good = np.append(0, np.cumsum(np.isfinite(flat)))
    some = np.append(0, np.cumsum(flat != 0))
    out: list[np.ndarray | None] = []
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out.append(flat[a:b] if valid[i] and b > a and good[b] - good[a] == b - a and some[b] > some[a] else None)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = usable(batch.column(1))
        keep = pa.array([v is not None for v in vectors])
        good = [v for v in vectors if v is not None]
        arrays = [batch.column(0).filter(keep), pa.array([len(v) for v in good], pa.int32()), pa.array([(v + 0.0).tobytes() for v in good], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "dim", "v"])


def packed(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, dim, v) of the usable vectors, v as double precision bytes."""
    own = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    return own.where(F.col("id").isNotNull()).mapInArrow(_packed, "id long, dim int, v binary")


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (held as float32 for the product), scales, sums of absolute values of the codes and of the vectors."""
    scale = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    return codes, scale, np.abs(codes.astype(np.float64)).sum(axis=1) * scale, np.abs(vectors).sum(axis=1)


class Slab:
    """The candidates of one key."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        if (ids[1:] < ids[:-1]).any():
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], vectors[order]
        self.ids, self.vectors = ids, vectors
        self.codes, self.scale, _, self.size = quantised(vectors)

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int, wide: int = 16_384) -> Iterator[tuple[int, list[tuple[float, int]]]]:
        """(query id, up to k (score, -id)) of each query, best first."""
        codes, scale, coded, _ = quantised(vectors)
        heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        floor = np.full(len(ids), -np.inf)
        for at in range(0, len(self.ids), wide):
            part = slice(at, at + wide)
            near = codes.astype(np.float32) @ self.codes[part].T.astype(np.float32)  # exact: sums of int8 products
            near = near * scale[:, None] * self.scale[None, part]
            slack = scale[:, None] / 2 * self.size[None, part] + self.scale[None, part] / 2 * coded[:, None]
            slack += 1e-9 * (slack + np.abs(near))
            near[ids[:, None] == self.ids[None, part]] = -np.inf
            low, high = near - slack, near + slack
            edges = runs(self.ids[part])[:-1]
            if len(edges) < low.shape[1]:  # an id counts once for the bound, as equal scores of one id are one result
                low = np.maximum.reduceat(low, edges, axis=1)
            if low.shape[1] > k:
                least = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            else:
                least = floor
            q, c = np.nonzero((high >= least[:, None]) & np.isfinite(near))
            for some in range(0, len(q), 1 << 18):
                qs, cs = q[some : some + (1 << 18)], c[some : some + (1 << 18)] + at
                exact = np.einsum("ij,ij->i", vectors[qs], self.vectors[cs])
                for i, score, other in zip(qs.tolist(), exact.tolist(), self.ids[cs].tolist(), strict=True):
                    heap, item = heaps[i], (score, -other)
                    if len(heap) < k:
                        if item not in heap:
                            heapq.heappush(heap, item)
                    elif item > heap[0] and item not in heap:
                        heapq.heapreplace(heap, item)
            floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        for i, heap in zip(ids.tolist(), heaps, strict=True):
            yield i, sorted(heap, reverse=True)


def _best(rows: list[tuple[int, float, int]]) -> pa.RecordBatch:
    q, s, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names=["q", "c", "score"])


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key, slab = None, None
        for batch in batches:
            keys, kinds, dims, ids = (int_column(batch.column(i)) for i in range(4))
            vectors = batch.column(4)
            edges = runs(keys, dims, kinds)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                dim = int(dims[a])
                here = np.frombuffer(b"".join(vectors.slice(a, b - a).to_pylist()), np.float64).reshape(-1, dim)
                if key != (keys[a], dim):
                    key, slab, held = (keys[a], dim), None, []
                if kinds[a] == 0:
                    held.append((ids[a:b], here))
                    continue
                if slab is None and held:
                    slab = Slab(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                if slab is not None:
                    rows = []
                    for at in range(0, b - a, TILE):
                        found = slab.search(ids[a:b][at : at + TILE], here[at : at + TILE], k)
                        rows += [(q, s, -c) for q, best in found for s, c in best]
                    yield _best(rows)

    return run


def _merged(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "q", 1 << 16):
            q, c, s = (int_column(rows[n].combine_chunks()) for n in ("q", "c", "score"))
            edges = runs(q)
            out: tuple[list, ...] = ([], [], [], [])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                best = heapq.nlargest(k, set(zip(s[a:b].tolist(), (-c[a:b]).tolist(), strict=True)))
                for rank, (score, other) in enumerate(best, 1):
                    for column, value in zip(out, (int(q[a]), rank, -other, score), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["query_id", "rank", "vec_id", "score"])

    return run


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
    slab_least: int = SLAB_LEAST, slab_most: int = SLAB_MOST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product with each query."""
    # repeated rows are one candidate and one query
    candidates, asked = (cut(packed(x, vec_id, embedding).distinct()) for x in (rows, queries))
    n, m = candidates.count(), asked.count()
    slab = min(slab_most, max(slab_least, math.ceil(n / SLABS)))
    slabs, groups = max(1, math.ceil(n / slab)), max(1, math.ceil(m / (GROUP * slab)))
    deal = lambda parts, seed: F.expr(f"cast(pmod(xxhash64(id, {seed}), {parts}) as long)")
    side = candidates.select(F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("g"), deal(slabs, 1).alias("s"), F.lit(0).alias("kind"), "dim", "id", "v")
    asks = asked.select(deal(groups, 2).alias("g"), F.explode(F.expr(f"sequence(0L, {slabs - 1}L)")).alias("s"), F.lit(1).alias("kind"), "dim", "id", "v")
    both = side.unionByName(asks).select((F.col("s") * groups + F.col("g")).alias("key"), "kind", "dim", "id", "v")
    parts = both.repartition(max(slabs * groups, 1), "key").sortWithinPartitions("key", "dim", "kind", "id")
    found = parts.mapInArrow(_searched(k), "q long, c long, score double")
    return found.repartition("q").sortWithinPartitions("q").mapInArrow(_merged(k), "query_id long, rank int, vec_id long, score double")

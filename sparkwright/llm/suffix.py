"""Removal of long repeated byte strings by a depth-limited radix sort of suffixes.

Every byte position starts a suffix, and only its first `length` bytes matter: groups of suffixes equal to that depth are
exactly the repeated windows. The passes run from the most significant digit to the last:

1. First digit, over all of the corpus. Of the `length - ANCHOR + 1` strings of ANCHOR bytes in a window the one with the
   smallest hash is its anchor, so equal windows have equal anchors at equal offsets (winnowing). A window is filed under
   its anchor; only anchors, about one in 50 bytes, are shuffled and sorted. Windows whose anchor occurs once are done.
   An anchor that recurs in one text with the same surroundings, as in periodic text, is a repeat already: its chain of
   places is two rows with its length, not a row for each place.
2. Second digit, on the hash of all bytes that the anchor's windows can see. Where it is equal to a neighbour's, all
   windows of the anchor are repeated and need no further pass; one of each such group goes on, for the others to meet.
3. Last digits, on the bytes themselves, for what is left. Under one anchor a window is fixed by how many of the bytes left
   of the anchor and how many right of it it holds. Both sides are radix-sorted, common prefixes of neighbours give each
   side's classes at every depth, and windows with equal classes on both sides are equal. Anchors with more than `hot`
   different surroundings take this pass as shuffled keys of single windows instead, so no task holds such a group.

Passes 1 and 2 hold one row of a sorted stream beside the batch in hand, whatever a group's size. Anchors that are frequent in a
sixty-fourth of the texts are dealt by document as well, so that none is one task: what an equal neighbour would have told in
the first two passes the last one finds out, so only the way differs, not the result. Texts are shuffled once, by document, and
that exchange serves both the cutting of surroundings and the removal.

Defined cases: null text counts as empty; texts shorter than `length` lose nothing; rows that repeat with the same id and
text are repeats of each other; null ids are allowed. Bytes are removed wherever they stand, so what is left may not be
valid UTF-8; it is returned as binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import cut, int_column, runs, text_bytes, whole_runs

ANCHOR = 104
BLOCK = 1 << 19
HOT = 20_000
#: Frequent anchors: one in FREQUENT of a sample of one in SAMPLE texts, so fewer than FREQUENT; each is dealt to SALTS tasks.
FREQUENT, SAMPLE, SALTS = 1000, 64, 64
NEVER = np.uint32(0xFFFFFFFF)


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random byte values, powers of an odd base and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    values = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def powers(b: int) -> np.ndarray:
        out = np.full(size, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return values, powers(base), powers(pow(base, -1, 1 << 64))


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each `width` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = best(values[:-step], values[step:])
        done += step
    return values


def anchors(block: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, most: int) -> np.ndarray:
    """Positions of the anchors of all windows of a block of texts that stand at starts and ends."""
    if len(block) < length:
        return np.empty(0, np.int64)
    values, powers, inverse = _powers(most)
    width = length - ANCHOR + 1
    total = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(values[block] * powers[: len(block)], out=total[1:])
    hashes = (total[ANCHOR:] - total[:-ANCHOR]) * inverse[: len(block) - ANCHOR + 1]
    hashes = ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    order = hashes.astype(np.uint32)
    inside = np.zeros(len(block) + 1, np.int8)  # where a whole window starts
    whole = ends - starts >= length
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole] - length + 1, -1)
    inside = np.cumsum(inside, dtype=np.int8)[: len(order) - width + 1] > 0
    least = np.where(inside, sliding(order, width, np.minimum), 0)
    padded = np.zeros(len(order) + width - 1, np.uint32)
    padded[width - 1 : width - 1 + len(least)] = least
    chosen = sliding(padded, width, np.maximum)
    covered = np.zeros(len(block) + 1, np.int8)  # where a string of ANCHOR bytes lies in one text
    np.add.at(covered, starts[whole], 1)
    np.add.at(covered, ends[whole] - ANCHOR + 1, -1)
    return np.flatnonzero((chosen == order) & (np.cumsum(covered, dtype=np.int8)[: len(order)] > 0))


def anchors_of(texts: list[bytes], length: int) -> Iterator[tuple[int, list[int]]]:
    """(index, positions) of each text that is long enough; short ones are hashed together, long ones in parts."""
    most = BLOCK + (1 << 17)

    def flush(group: list[int]):
        block = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        ends = np.cumsum([len(texts[i]) for i in group])
        starts = np.append(0, ends[:-1])
        found = anchors(block, starts, ends, length, most)
        bounds = np.searchsorted(found, np.append(starts, len(block)))
        for k, i in enumerate(group):
            if bounds[k] < bounds[k + 1]:
                yield i, (found[bounds[k] : bounds[k + 1]] - starts[k]).tolist()

    group, size = [], 0
    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > BLOCK >> 2:
            found: set[int] = set()
            for at in range(0, len(text) - length + 1, BLOCK):
                part = np.frombuffer(text, np.uint8)[at : at + BLOCK + length - 1]
                ends = np.array([len(part)])
                found.update((anchors(part, np.array([0]), ends, length, most) + at).tolist())
            yield i, sorted(found)
            continue
        group.append(i)
        size += len(text)
        if size >= BLOCK >> 1:
            yield from flush(group)
            group, size = [], 0
    if group:
        yield from flush(group)


def chains(places: list[int], gap: int) -> list[tuple[int, int]]:
    """(first, last) of the chains of ascending places that are at most `gap` apart."""
    out = [(places[0], places[0])]
    for p in places[1:]:
        out[-1:] = [(out[-1][0], p)] if p - out[-1][1] <= gap else [out[-1], (p, p)]
    return out


def _anchored(length: int):
    reach = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            doc, tag = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = text_bytes(batch.column(2))
            rows: list[tuple[int, int, int, int, int]] = []

            def out():
                columns = [np.array([r[c] for r in rows], np.uint64).view(np.int64) for c in range(2)]  # noqa: B023
                columns += [np.array([r[c] for r in rows], np.int64) for c in (2, 3, 4)]  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "c", "doc", "at", "run"])

            for i, places in anchors_of(texts, length):
                text, own, high = memoryview(texts[i]), doc[i], tag[i] << 32
                found: dict[tuple[int, int], list[int]] = {}
                for p in places:
                    low, top = max(0, p - reach), min(len(text), p + length)
                    key = digest(text[p : p + ANCHOR]), digest(text[low:top], (p - low) << 16 | (top - p))
                    found.setdefault(key, []).append(p)
                for (k, c), at in found.items():
                    for first, last in chains(at, length + reach):
                        rows += [(k, c, own, high | first, last - first)] * (1 if first == last else 2)
                if len(rows) > 1 << 17:
                    yield out()
                    rows = []
            if rows:
                yield out()

    return run


def neighbours(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Batches of a stream sorted by its first two columns, with, for each row, bits of whether its first column (1: row
    before, 2: row after) and its first two (4, 8) equal the neighbour's. One row is held back until the next is seen."""
    held: dict[str, np.ndarray] | None = None
    before = 0

    def bits(a: dict[str, np.ndarray]) -> np.ndarray:
        k, c = a[names[0]], a[names[1]]
        same = (k[1:] == k[:-1]).astype(np.int8)
        return same + 4 * (same * (c[1:] == c[:-1]))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: int_column(batch.column(i)) for i, n in enumerate(names)}
        if held is not None:
            columns = {n: np.concatenate([held[n], columns[n]]) for n in names}
        link = bits(columns)
        seen = np.append(before, link[:-1]) if len(link) else np.empty(0, np.int64)
        if len(link):
            yield {n: v[:-1] for n, v in columns.items()}, seen.astype(np.int64) | (link.astype(np.int64) << 1)
            before = int(link[-1])
        held = {n: v[-1:] for n, v in columns.items()}
    if held is not None:
        yield held, np.array([before], np.int64)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by (k, c), those that recur. full: all windows are repeated; more: goes on to the last pass.
    Frequent ones recur for certain, though perhaps not here."""
    for rows, bits in neighbours(batches, ["k", "c", "doc", "at", "run", "frequent"]):
        frequent = rows["frequent"] > 0
        recurs, full, first = ((bits & 3) > 0) | frequent, (bits & 12) > 0, (bits & 4) == 0
        # a run of equal surroundings that is all of its anchor has nothing to meet
        edges = runs(rows["k"], rows["c"])[:-1]
        ends = np.append(edges[1:], len(bits)) - 1
        alone = ((bits[edges] & 1) == 0) & ((bits[ends] & 2) == 0)
        more = recurs & first & (~np.repeat(alone, ends - edges + 1) | frequent)
        some = recurs & (full | more)
        if some.any():
            arrays = [pa.array(rows[c][some]) for c in ("k", "doc", "at", "run")] + [pa.array(full[some]), pa.array(more[some])]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "doc", "at", "run", "full", "more"])


def _surroundings(length: int):
    reach = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, tag, text, keys, places in zip(*(batch.column(i).to_pylist() for i in (0, 1)), text_bytes(batch.column(2)), *(batch.column(i).to_pylist() for i in (3, 4)), strict=True):
                for k, p in zip(keys, places, strict=True):
                    low, top = max(0, p - reach), min(len(text), p + length)
                    around = text[low:top].rjust(top - p + reach, b"\0").ljust(length + reach, b"\0")
                    rows.append((k, doc, tag << 32 | p, p - low, top - p - ANCHOR, around))
                if len(rows) >= 1 << 15:
                    yield _around(rows)
                    rows = []
            if rows:
                yield _around(rows)

    return run


AROUND = "k long, doc long, at long, nl int, nr int, around binary"


def _around(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "doc", "at", "nl", "nr", "around"])


def classes(group: np.ndarray, side: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and bytes, and how many leading bytes each shares with the row before it in that order
    (-1 at the start of a group; never more than both have)."""
    wide = side.shape[1]
    padded = np.zeros((len(side), -(-wide // 8) * 8), np.uint8)
    padded[:, :wide] = side
    digits = padded.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    tied = np.ones(len(order), bool)
    level = group[order].copy()
    for d in range(digits.shape[1]):  # most significant digit first; only rows that still tie are sorted on
        some = np.flatnonzero(tied)
        if not len(some):
            break
        here = order[some]
        again = np.lexsort((digits[here, d], level[some]))
        order[some] = here[again]
        value, old = digits[order[some], d], level[some]
        new = np.ones(len(some), bool)
        new[1:] = (value[1:] != value[:-1]) | (old[1:] != old[:-1])
        level[some] = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
        alone = new & np.append(new[1:], True)
        tied[some[alone]] = False
    shared = np.full(len(order), -1)
    same = group[order[1:]] == group[order[:-1]]
    a, b = order[1:][same], order[:-1][same]
    equal = side[a] == side[b]
    first = np.where(equal.all(axis=1), wide, equal.argmin(axis=1))
    shared[1:][same] = np.minimum(first, np.minimum(sizes[a], sizes[b]))
    return order, shared


def window_repeats(keys: np.ndarray, around: np.ndarray, nl: np.ndarray, nr: np.ndarray, reach: int) -> np.ndarray:
    """[row, a]: whether the window that begins a bytes before the row's anchor equals one of another row of its key."""
    m = len(keys)
    core = around[:, reach : reach + ANCHOR]
    edges = runs(keys)
    group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    if not (core == core[edges[:-1]][group]).all():  # different anchors with one hash
        parts = np.concatenate([group[:, None].astype(">u4").view(np.uint8).reshape(m, 4), core], axis=1)
        group = np.unique(np.ascontiguousarray(parts).view(f"V{parts.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    found = np.zeros((m, reach + 1), bool)
    sides = []
    for side, sizes in ((around[:, :reach][:, ::-1], nl), (around[:, reach + ANCHOR :], nr)):
        order, shared = classes(group, side, sizes)
        best = np.empty(m, np.int64)
        best[order] = np.maximum(shared, np.append(shared[1:], -1))
        sides.append((order, shared, best))
    (lo, ls, lb), (ro, rs, rb) = sides
    left, right = np.empty(m, np.int64), np.empty(m, np.int64)
    for a in range(reach + 1):
        some = np.flatnonzero((lb >= a) & (rb >= reach - a) & (nl >= a) & (nr >= reach - a))
        if len(some) < 2:
            continue
        left[lo] = np.cumsum(ls < a)
        right[ro] = np.cumsum(rs < reach - a)
        key = left[some] << 32 | right[some]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        hit = np.append(same, False) | np.append(False, same)
        found[some[by[hit]], a] = True
    return found


def spans(found: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """(doc, tag, start, end) of each maximal run of repeated windows of a row."""
    padded = np.zeros((len(found), found.shape[1] + 2), np.int8)
    padded[:, 1:-1] = found
    step = np.diff(padded, axis=1)
    (row, low), (_, high) = np.nonzero(step == 1), np.nonzero(step == -1)
    place = at & 0xFFFFFFFF
    arrays = [doc[row], at[row] >> 32, place[row] - (high - 1), place[row] - low + length]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], names=["doc", "tag", "s", "e"])


SPANS = "doc long, tag long, s long, e long"


def _last_pass(length: int):
    reach = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "k", 1 << 15):
            rows = rows.combine_chunks()
            k, doc, at, nl, nr = (int_column(rows[c].combine_chunks()) for c in ("k", "doc", "at", "nl", "nr"))
            around = np.frombuffer(b"".join(rows["around"].to_pylist()), np.uint8).reshape(len(k), length + reach)
            yield spans(window_repeats(k, around, nl.astype(np.int64), nr.astype(np.int64), reach), doc, at, length)

    return run


def _single_windows(length: int):
    """The windows of hot anchors as rows of 128-bit keys."""
    reach = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = []
                for r in batch.slice(at, 1024).to_pylist():
                    around = memoryview(r["around"])
                    for a in range(max(0, reach - r["nr"]), min(reach, r["nl"]) + 1):
                        both = xxhash.xxh3_128_intdigest(around[reach - a : reach - a + length], a)
                        rows.append((both >> 64, both & 0xFFFFFFFFFFFFFFFF, r["doc"], r["at"] >> 32, (r["at"] & 0xFFFFFFFF) - a))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                arrays = [np.array(c, np.uint64).view(np.int64) for c in columns[:2]] + [np.array(c, np.int64) for c in columns[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["k", "c", "doc", "tag", "s"])

    return run


def _single_repeats(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bits in neighbours(batches, ["k", "c", "doc", "tag", "s"]):
            hit = (bits & 12) > 0
            arrays = [rows[c][hit] for c in ("doc", "tag", "s")] + [rows["s"][hit] + length]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["doc", "tag", "s", "e"])

    return run


def merged(s: list[int], e: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover, cut to a text's size."""
    start, end = np.maximum(np.array(s, np.int64), 0), np.minimum(np.array(e, np.int64), size)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, counts, removed = [], [], []
        texts = text_bytes(batch.column(1))
        for text, s, e in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if not s:
                kept.append(text)
                counts.append(0)
                removed.append(0)
                continue
            start, end = merged(s, e, len(text))
            bounds = zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True)
            kept.append(b"".join(text[a:b] for a, b in bounds))
            counts.append(len(start))
            removed.append(int((end - start).sum()))
        sizes = pa.array([len(t) for t in texts], pa.int64())
        arrays = [batch.column(0), sizes, pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def frequent_anchors(sample: DataFrame) -> DataFrame:
    """(k, frequent = 1) of the anchors that hold more than one in FREQUENT rows of a sample, and 16 at least, to be broadcast."""
    counts = cut(sample.groupBy("k").count())
    total = counts.agg(F.sum("count")).first()[0] or 0  # one number
    return F.broadcast(counts.where(F.col("count") > max(16, total / FREQUENT)).select("k", F.lit(1).alias("frequent")))


def remove_repeats(docs: DataFrame, length: int = 200, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row: every byte is removed that lies in a string of `length`
    bytes which also starts at another place of the same or another text."""
    if length <= 2 * ANCHOR - 2 and length >= ANCHOR + 1:
        pass
    else:
        raise ValueError(f"length must be from {ANCHOR + 1} to {2 * ANCHOR - 2}")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    # a row is known by its id and 31 bits of its text's hash; a null id gives way to a hash
    own = own.select("doc_id", F.coalesce("doc_id", F.xxhash64(F.lit("null"), "text")).alias("doc"), F.expr("xxhash64(text) & 2147483647").alias("tag"), "text")
    long_enough = own.where(F.octet_length("text") >= length).select("doc", "tag", "text")
    anchors = lambda rows: rows.mapInArrow(_anchored(length), "k long, c long, doc long, at long, run long")
    found = anchors(long_enough).join(frequent_anchors(anchors(long_enough.where(f"pmod(xxhash64(1, doc, tag), {SAMPLE}) = 0"))), "k", "left")
    # both rows of a chain stand in one document
    salt = F.when(F.col("frequent") == 1, F.pmod(F.xxhash64("doc", F.shiftright("at", 32)), F.lit(SALTS).cast("long"))).otherwise(0).alias("salt")
    dealt = found.select("k", "c", "doc", "at", "run", F.coalesce("frequent", F.lit(0)).cast("long").alias("frequent"), salt)
    again = dealt.repartition("k", "salt").sortWithinPartitions("k", "c").drop("salt").mapInArrow(_repeated, "k long, doc long, at long, run long, full boolean, more boolean")
    again = cut(again)
    tag, place = F.expr("shiftright(at, 32)").alias("tag"), F.expr("at & 4294967295")
    whole = again.where("full").select("doc", tag, (place - (length - ANCHOR)).alias("s"), (place + F.col("run") + length).alias("e"))
    lists = again.where("more").groupBy("doc", tag).agg(F.collect_list(F.struct("k", place.alias("p"))).alias("l"))
    lists = lists.select("doc", "tag", F.col("l.k").alias("k"), F.col("l.p").alias("p"))
    # doc_id is read here too, so that this exchange of texts is the one of the last join
    around = own.join(lists, ["doc", "tag"]).select("doc", "tag", "text", "k", "p", "doc_id").mapInArrow(_surroundings(length), AROUND)
    sizes = again.where("more").groupBy("k").count().where(F.col("count") > hot).select("k")
    # at most one row for each `hot` anchors that recur, but not bounded by itself: the planner chooses the join
    cold = around.join(sizes, "k", "left_anti").repartition("k").sortWithinPartitions("k").mapInArrow(_last_pass(length), SPANS)
    single = around.join(sizes, "k", "left_semi").mapInArrow(_single_windows(length), "k long, c long, doc long, tag long, s long")
    single = single.repartition("k").sortWithinPartitions("k", "c").mapInArrow(_single_repeats(length), SPANS)
    cover = whole.unionByName(cold).unionByName(single).groupBy("doc", "tag").agg(F.collect_list(F.struct("s", "e")).alias("l"))
    cover = cover.select("doc", "tag", F.col("l.s").alias("s"), F.col("l.e").alias("e"))
    both = own.join(cover, ["doc", "tag"], "left").select("doc_id", "text", "s", "e")
    return both.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

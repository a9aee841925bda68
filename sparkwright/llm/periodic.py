"""Periodic runs of words: maximal stretches that repeat a block of words often, as loops of a generator or of a template do.

A run of period q has Lyndon roots: under one of the two orders of the alphabet (words ascending or descending) the longest Lyndon
word that begins at some place of the run has length q and follows itself. Both Lyndon arrays come straight from the first phase of
a suffix sorter in the manner of Baier: suffixes are grouped by their longest Lyndon prefix, the highest group first, and each
group in turn is appended to the words of the nearest lower suffix on its left. The length of a group's word is the Lyndon array,
and suffixes of one group have equal words, so roots that follow each other are seen without a comparison. The first root of a chain is
extended to both sides by its longest common extension with itself one period on; what results is the run.

Each document is a row of its own: a map, no shuffle. Before the sorter, documents are cut at words too rare to be in a run: a run
of exponent e holds each of its words at least floor(e) times, so a word that occurs less often in its stretch divides it, until
nothing divides any more. No run is lost or shortened by that, as an extension of a run would be a part of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm.common import text_bytes

RUNS = T.ArrayType(T.StructType([T.StructField(f, T.LongType()) for f in ("start", "length", "period")]))
_ARROW_RUNS = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))


def lyndon_groups(word: list[int], letters: int) -> tuple[list[int], list[int]]:
    """For each position of a word over 0..letters-1 the number of its group and, by group, the length of the group's Lyndon word.

    Groups are a doubly linked list in lexicographic order. `left` leads to the nearest position on the left that is in a lower
    group still to be done; paths are compressed. Every position is moved at most as often as a group is appended to it.
    """
    n = len(word)
    members: list[list[int]] = [[] for _ in range(letters)]
    for i, letter in enumerate(word):
        members[letter].append(i)
    length = [1] * letters
    below, above = list(range(-1, letters - 1)), [*range(1, letters), -1]
    group, left, done = list(word), list(range(-1, n - 1)), bytearray(n)
    at = letters - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            j = left[i]
            if j >= 0 and done[j]:
                while j >= 0 and done[j]:
                    j = left[j]
                step = i
                while left[step] != j:
                    left[step], step = j, left[step]
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for j, count in times.items():
            split.setdefault((-count, group[j]), []).append(j)
        size = length[at]
        for minus, old in sorted(split) if len(split) > 1 else split:  # most appended words first: the highest of the new groups
            moved, new, up = split[minus, old], len(length), above[old]
            length.append(length[old] - minus * size)
            members.append(moved)
            for j in moved:
                group[j] = new
            above[old] = new
            above.append(up)
            below.append(old)
            if up >= 0:
                below[up] = new
        at = below[at]
    return group, length


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix, by blocks that double."""
    n, at, block = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : at + block][: n - at] != b[at : at + block][: n - at])
        if len(differ):
            return at + int(differ[0])
        at, block = at + block, block * 2
    return n


def runs_of(word: np.ndarray, exponent: float, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an integer sequence with length >= max(shortest, exponent * period), exponent >= 2."""
    n, found = len(word), set()
    if n < max(shortest, exponent):
        return []
    letters, ranks = np.unique(word, return_inverse=True)
    back = word[::-1]
    for order in (ranks, len(letters) - 1 - ranks):
        group, length = lyndon_groups(order.tolist(), len(letters))
        group = np.array(group)
        period = np.array(length)[group]
        next_root = np.arange(n) + period
        follows = next_root < n
        follows[follows] = group[next_root[follows]] == group[follows]
        first = np.ones(n, bool)
        first[next_root[follows]] = False
        chain = first
        reach = np.arange(n)
        for _ in range(int(exponent) - 2):  # a run of exponent e holds floor(e) - 1 whole roots that follow each other
            chain = chain & follows[reach]
            reach = np.where(chain, np.minimum(reach + period, n - 1), reach)
        for i in np.flatnonzero(chain).tolist():
            q = int(period[i])
            right = _common(word[i:], word[i + q :])
            before = _common(back[n - i :], back[n - i - q :])
            if right + before + q >= max(shortest, exponent * q):
                found.add((i - before, right + before + q, q))
    return sorted((a, b, q) for a, b, q in found)


def stretches(ids: np.ndarray, part: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (ascending) and their stretch, after words that occur fewer than `least` times in their stretch have divided it.

    ids number the words of all parts so that no two parts share one; part says which part, of consecutive places, a place is in.
    """
    places = np.arange(len(ids))
    while len(places):
        keep = np.bincount(ids)[ids] >= least
        if keep.all():
            break
        gap = np.cumsum(~keep)
        places, key, part = places[keep], ids[keep], part[keep] + gap[keep]
        part = np.unique(part, return_inverse=True)[1]
        ids = np.unique(part.astype(np.int64) * (int(key.max(initial=0)) + 1) + key, return_inverse=True)[1]
    return places, part


def _numbered(words: list[bytes], start: int) -> list[int]:
    ids: dict[bytes, int] = {}
    return [ids.setdefault(w, start + len(ids)) for w in words]


def document_runs(texts: list[list[bytes]], exponent: float, shortest: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each of several texts of words; starts are word numbers."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = np.cumsum([0, *map(len, texts)])
    flat: list[int] = []
    for words in texts:
        flat += _numbered(words, len(flat))
    ids = np.array(flat, np.int64)
    places, part = stretches(ids, np.repeat(np.arange(len(texts)) * (len(flat) + 1), np.diff(starts)), int(exponent))
    if not len(places):
        return out
    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(places))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= max(shortest, exponent):
            doc = int(np.searchsorted(starts, places[a], side="right")) - 1
            shift = int(places[a] - starts[doc])
            out[doc] += [(s + shift, n, q) for s, n, q in runs_of(ids[places[a] : places[b - 1] + 1], exponent, shortest)]
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _finder(at: int, exponent: float, shortest: int, size: int = 4_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(at))
            start, held = 0, 0
            for row, text in enumerate(texts):
                held += len(text)
                if held >= size or row == len(texts) - 1:  # long texts leave in small batches
                    words = [t.split() for t in texts[start : row + 1]]  # bytes.split divides at \x20 and \x09-\x0D
                    runs = document_runs(words, exponent, shortest)
                    kept = [collapsed(w, r).decode() for w, r in zip(words, runs)]
                    listed = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], _ARROW_RUNS)
                    part = batch.slice(start, row + 1 - start)
                    arrays = [*part.columns, listed, pa.array(kept, pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])
                    start, held = row + 1, 0

    return found


def periodic_runs(
    docs: DataFrame, exponent: float = 4, shortest: int = 6, text: str = "text", runs: str = "runs", kept: str = "collapsed"
) -> DataFrame:
    """docs with two more columns: the runs of each whole text, by start and period, and the text without their repetitions.

    A run is a stretch of consecutive words with smallest period q that no neighbouring word extends, of at least `shortest` words
    and `exponent` (2 or more) times q. Words are divided by ASCII white space. Null, empty and blank texts have no words, no
    runs and an empty collapsed text; repeated rows give repeated results; a column of docs with one of the new names is
    replaced; null ids and other columns pass through.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    rest = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in (runs, kept)])
    new = [T.StructField(runs, RUNS), T.StructField(kept, T.StringType())]
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*rest.schema.fields, *new])])
    out = rest.toDF(*[f"c{i}" for i in range(len(rest.columns))]).mapInArrow(_finder(rest.columns.index(text), exponent, shortest), inner)
    return out.toDF(*rest.columns, runs, kept)


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which one id in ten gets a text of its words whose end, from some word on, repeats one period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    parts = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n, words = F.size("words"), F.col("words")
    parts = parts.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    parts = parts.withColumn("p", F.expr("cast(1 + (size(words) - a) div (3 + g % 8) as int)"))
    period = lambda length: F.slice(words, F.col("a") + 1, length)
    whole, rest = F.expr("cast((size(words) - a) div p as int)"), (n - F.col("a")) % F.col("p")
    looped = F.array_join(F.concat(F.slice(words, F.lit(1), F.col("a")), F.flatten(F.array_repeat(period(F.col("p")), whole)), period(rest)), " ")
    return parts.select("doc_id", F.when(F.col("p").isNotNull(), looped).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame, runs: str = "runs", kept: str = "collapsed") -> DataFrame:
    """doc_id with the number of runs, the longest one (ties: smallest start, then period; none: nulls) and digests of the columns
    that `periodic_runs` made."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", *[r[f].cast("string") for f in ("start", "length", "period")]), F.lit("\n"))
    out = found.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.sha2(F.array_join(F.transform(runs, line), ""), 256).alias("runs_sha256"),
        F.sha2(F.coalesce(kept, F.lit("")), 256).alias("collapsed_sha256"),
    )
    return out.withColumn("exponent_milli", F.expr("1000 * length div period"))

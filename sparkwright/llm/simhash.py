"""SimHash near-duplicates by Golay-code fuzzy hashing.

Method. A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded with zeros to the 23 bits of
the perfect binary Golay code. Decoding a segment gives the indices of the codewords within distance 4: one index when the
nearest codeword is within 2, six when it is at 3. Two segments that differ in at most two bits share an index (all cases
are checked in the tests). If two fingerprints differ in at most 4 bits, the pigeonhole principle leaves two cases:

* some segment i has no error; then of the other two, one segment j has at most 2: the key is (i, j, bits of i, index of j);
* every segment has an error; then none has more than 2: the key is (index of segment 1, index of segment 2).

Equal keys bring fingerprints together and the true distance is verified, so no link is lost and none is false.

Scale. Copies collapse first: only distinct fingerprints are keyed. Rows with one key are read as a sorted stream. Within a
key, links are found by a search that removes a fingerprint from the unseen ones once it is reached, so a dense group costs
about its size, and what leaves a key is a spanning forest, never all pairs. Links and components stay distributed.

Defined cases: null text counts as empty; texts without words have fingerprint 0 and are linked like any other; a null
doc_id never represents a group (a group of such rows only has component null); rows and repeats are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import components, cut, fresh, int_column, join_lookup, runs, text_bytes, whole_runs

SEED = 42
#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the (23, 12) Golay code.
GENERATOR = 0b101011100011
SEGMENTS = ((42, 22), (21, 21), (0, 21))
SMALL = 12
#: Keys of two indices with more fingerprints are divided by the third segment; only the way depends on it.
DIVIDED = 256


def fingerprint(text: bytes, words: int, step: int = 1 << 16) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    return fingerprint_of(shingle_hashes(text, words), step)


def fingerprint_of(hashes: np.ndarray, step: int = 1 << 16) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), step):  # very long texts in steps
        counts += np.unpackbits(hashes[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in text_bytes(batch.column(1))], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return run


@lru_cache(1)
def golay() -> np.ndarray:
    """errors[s]: the error patterns of weight 4 or less that lead from a word of syndrome s to a codeword, the nearest
    first, padded with -1."""
    from itertools import combinations

    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            pattern = sum(1 << b for b in bits)
            errors[int(syndrome(np.array([pattern]))[0])].append(pattern)
    out = np.full((1 << 11, max(map(len, errors))), -1, np.int64)
    for s, patterns in enumerate(errors):
        out[s, : len(patterns)] = patterns
    return out


def syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def indices(words: np.ndarray) -> np.ndarray:
    """For 23-bit words, the 12-bit indices of the codewords within distance 4, padded with -1."""
    patterns = golay()[syndrome(words)]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> 11)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (position, key) of an array of signed fingerprints."""
    bits = fps.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [indices(p) for p in parts]
    rows, keys = [], []

    def put(tag: int, first: np.ndarray, second: np.ndarray) -> None:
        full = (first >= 0) & (second >= 0)
        rows.append(np.nonzero(full)[0])
        keys.append((tag << 40 | first << 12 | second)[full])

    for i in range(3):
        for j in range(3):
            if i != j:
                put(3 * i + j, np.broadcast_to(parts[i][:, None], near[j].shape), near[j])
    wide = near[0].shape[1]
    put(9, np.repeat(near[0], wide, axis=1), np.tile(near[1], wide))
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = int_column(batch.column(0))
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            rows, keys = keys_of(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])


def links_within(fps: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among the fingerprints of one key."""
    left, right = [], []
    unseen = fps.view(np.uint64)
    while len(unseen):
        queue, unseen = [unseen[0]], unseen[1:]
        while queue and len(unseen):
            at = queue.pop()
            hit = np.bitwise_count(unseen ^ at) <= most
            if hit.any():
                reached, unseen = unseen[hit], unseen[~hit]
                queue.extend(reached)
                left.append(np.full(len(reached), at))
                right.append(reached)
    return left, right


def linked_pairs(keys: np.ndarray, bits: np.ndarray, most: int, third: bool = True) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links among the fingerprints of each key (sorted): all pairs of a small key, a spanning forest of a larger one.

    Keys of two indices have 24 bits only. As they stand for pairs with at most two errors in every segment, a large one is
    divided by the indices of the last segment, which such a pair shares as well; so the work of a key does not grow with the
    square of its fingerprints. Pairs without an error in some segment meet in the other keys.
    """
    left, right = [], []
    edges = runs(keys)
    sizes = np.diff(edges)
    small = np.repeat(sizes <= SMALL, sizes)
    few, these = bits[small], keys[small]
    for offset in range(1, min(SMALL, len(these))):
        hit = (these[:-offset] == these[offset:]) & (np.bitwise_count(few[:-offset] ^ few[offset:]) <= most)
        left.append(few[:-offset][hit])
        right.append(few[offset:][hit])
    for k in np.flatnonzero(sizes > SMALL):
        own = bits[edges[k] : edges[k + 1]]
        if third and keys[edges[k]] >> 40 == 9 and len(own) > DIVIDED:
            at, n = SEGMENTS[2]
            near = indices(((own >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64))
            row, column = np.nonzero(near >= 0)
            index = near[row, column]
            order = np.argsort(index, kind="stable")
            a, b = linked_pairs(index[order], own[row[order]], most, False)
        else:
            a, b = links_within(own.view(np.int64), most)
        left += a
        right += b
    return left, right


def _linked(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "key"):
            keys, fps = (int_column(rows[c].combine_chunks()) for c in ("key", "fp"))
            left, right = linked_pairs(keys, fps.view(np.uint64), most)
            if left:
                pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]).view(np.int64), axis=1)
                if pairs.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run


def golay_links(docs: DataFrame, words: int, most: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, fp) of each row, (fp, first, n) of each fingerprint, and links (a, b) of fingerprints."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = cut(source.mapInArrow(_fingerprints(words), "doc_id long, fp long"))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    return prints, classes, print_links(classes.select("fp"), most)


def print_links(prints: DataFrame, most: int) -> DataFrame:
    """Links (a, b) of distinct fingerprints (fp) that differ in at most `most` bits."""
    if not 0 <= most <= 4:
        raise ValueError("the keys find up to 4 differing bits")
    keyed = prints.mapInArrow(_keyed, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(most), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, words: int = 5, most: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of each row: the fingerprint of its `words`-word shingles as a signed long, and the
    smallest doc_id that links of at most `most` (4 or fewer) differing bits reach."""
    prints, classes, links = golay_links(docs, words, most, doc_id, text)
    roots = components(links)
    member = cut(classes.join(roots, classes["fp"] == roots["id"], "left").select("fp", "first", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root")))
    smallest = cut(member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    named = cut(join_lookup(member, smallest, "root").select("fp", "component_id", F.col("rows").alias("n")))
    return join_lookup(prints, named, "fp").select("doc_id", "fp", "component_id")


WIDE, ORDERS, SIMILAR = 4, 10, 48
#: Bits of 256 up to which texts are compared; texts of similarity 0.8 differ in 39 on average, in 48 with 4 and 5 shingles.
PREFILTER = 80
#: Similarity is at least SHARE[0] / SHARE[1]; groups of more than two blocks of BLOCK texts are compared block by block.
SHARE, BLOCK = (4, 5), 1024


def mixed(hashes: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes from 64-bit hashes, by salt."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15) * (salt.astype(np.uint64) + np.uint64(1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle, in order; of the whole sequence if it has fewer words."""
    parts = text.lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D split
    if not parts:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(parts))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts, shift = ends - sizes + 1, min(words, len(parts)) - 1
    pairs = zip(starts[: len(parts) - shift].tolist(), ends[shift:].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in pairs), np.uint64, len(parts) - shift)


def sketch(text: bytes, words: int, step: int = 1 << 16) -> tuple[list[int], list[int]]:
    """WIDE fingerprints of 64 bits from different hashes, and ORDERS keys: the two shingles that come first in each of
    several random orders of the text's different shingles."""
    return sketch_of(np.unique(shingle_hashes(text, words)), step)


def sketch_of(hashes: np.ndarray, step: int = 1 << 16) -> tuple[list[int], list[int]]:
    if not len(hashes):
        return [0] * WIDE, [0] * ORDERS
    salts = np.arange(WIDE + ORDERS)[:, None]
    counts = np.zeros((WIDE, 64), np.int64)
    first = np.empty((ORDERS, 0), np.uint64)
    for at in range(0, len(hashes), step):
        all_orders = mixed(hashes[None, at : at + step], salts)
        bits = np.unpackbits(all_orders[:WIDE].view(np.uint8).reshape(WIDE, -1, 8), axis=2, bitorder="little")
        counts += bits.sum(axis=1, dtype=np.uint32)
        first = np.concatenate([first, all_orders[WIDE:]], axis=1)
        first = np.partition(first, 1, axis=1)[:, :2] if first.shape[1] > 2 else first
    first.sort(axis=1)
    prints = np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").view("<i8")[:, 0]
    keys = first[:, 0] if first.shape[1] == 1 else first[:, 0] ^ mixed(first[:, 1], salts[WIDE:, 0])
    return prints.tolist(), keys.view(np.int64).tolist()


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sets, wide, keys = [], [], [], []
            for text in text_bytes(batch.column(2)):
                hashes = shingle_hashes(text, words)
                prints.append(fingerprint_of(hashes))
                hashes = np.unique(hashes)
                sets.append(_signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)))
                w, k = sketch_of(hashes)
                wide.append(w)
                keys.append(k)
            kind = pa.list_(pa.int64())
            arrays = [batch.column(0), batch.column(1), pa.array(prints, pa.int64()), pa.array(sets, pa.int64()), pa.array(wide, kind), pa.array(keys, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "t", "fp", "c", "w", "keys"])

    return run


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["c", "h"])

    return run


def local_groups(prints: np.ndarray, most: int) -> list[list[int]]:
    """Positions of each group of two rows or more (several words each) that links of at most `most` bits join."""
    out, unseen = [], np.arange(len(prints))
    while len(unseen):
        queue, group, unseen = [int(unseen[0])], [int(unseen[0])], unseen[1:]
        while queue and len(unseen):
            at = queue.pop()
            hit = np.bitwise_count(prints[unseen] ^ prints[at]).sum(axis=1) <= most
            reached, unseen = unseen[hit].tolist(), unseen[~hit]
            queue += reached
            group += reached
        if len(group) > 1:
            out.append(group)
    return out


def _candidates(most: int, block: int):
    """Groups (g, c) of shingle sets that a key and at most `most` bits bring together; g is a hash of the members, so a
    group found by several keys is one. Each pair of a group's members is in some g of at most two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "key", 1 << 16):
            columns = [int_column(rows[c].combine_chunks()) for c in rows.column_names]
            keys, ids, prints = columns[0], columns[1], np.stack(columns[2:], axis=1).view(np.uint64)
            edges = runs(keys)
            for k in np.flatnonzero(np.diff(edges) > 1):
                a, b = edges[k], edges[k + 1]
                for group in local_groups(prints[a:b], most):
                    members = np.sort(ids[a:b][group])
                    blocks = np.array_split(members, -(-len(members) // block))
                    for i, one in enumerate(blocks):
                        for other in blocks[i + 1 :] if len(blocks) > 1 else [one[:0]]:
                            both = np.concatenate([one, other])
                            g = _signed(xxhash.xxh64_intdigest(both.tobytes(), SEED))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), g)), pa.array(both)], names=["g", "c"])

    return run


def similar_sets(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Positions (left, right) of a spanning forest of the links among sets whose Jaccard similarity is SHARE or more."""
    left, right = [], []
    sizes = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.append(0, np.cumsum(sizes))
    marked = np.zeros(len(flat) + 1, bool)
    unseen = np.arange(len(sets))
    while len(unseen):
        queue, unseen = [int(unseen[0])], unseen[1:]
        while queue and len(unseen):
            at = queue.pop()
            own = flat[starts[at] : starts[at + 1]]
            marked[own] = True
            if 4 * len(unseen) < len(sets):
                common = np.array([np.count_nonzero(marked[flat[starts[i] : starts[i + 1]]]) for i in unseen])
            else:
                common = np.diff(np.append(0, np.cumsum(marked[flat]))[starts])[unseen]
            marked[own] = False
            hit = SHARE[1] * common >= SHARE[0] * (sizes[unseen] + sizes[at] - common)
            reached, unseen = unseen[hit].tolist(), unseen[~hit]
            queue += reached
            left += [at] * len(reached)
            right += reached
    return left, right


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_runs(batches, "g", 1 << 12):
        groups, ids = (int_column(rows[c].combine_chunks()) for c in ("g", "c"))
        edges = runs(groups)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            left, right = similar_sets([np.frombuffer(x, np.uint64) for x in rows["h"].slice(a, b - a).to_pylist()])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][left]), pa.array(ids[a:b][right])], names=["a", "b"])


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, t, text) of the rows with a doc_id; t is a hash of the text, so that rows that share an id are told apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text")).where("doc_id is not null")


def similar_links(docs: DataFrame, classes: DataFrame, words: int = 5, most: int = PREFILTER, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of the shingle sets of `classes` (c, first, w, keys) whose Jaccard similarity is 0.8 or more; they
    join what all such links join.

    Four bits of 64 reach pairs above 0.95 only. Here sets of similarity s share one of the ORDERS keys with probability
    1 - (1 - s * s) ** ORDERS, 0.9999 at 0.8. WIDE * 64 bits only choose which of them are compared; the similarity itself is
    that of the whole sets of shingle hashes, which are made again for those texts alone.
    """
    own = [F.col("w")[i].alias(f"w{i}") for i in range(WIDE)]
    spread = classes.select(F.posexplode("keys").alias("r_", "key"), "c", *own)
    spread = spread.select(F.xxhash64("r_", "key").alias("key"), "c", *[f"w{i}" for i in range(WIDE)])
    found = spread.repartition("key").sortWithinPartitions("key", "c").mapInArrow(_candidates(most, block), "g long, c long")
    groups = cut(found.distinct())
    asked = classes.join(groups.select("c").distinct(), "c").select("c", F.col("first.doc_id").alias("doc_id"), F.col("first.t").alias("t"))
    sets = _rows(docs).join(asked, ["doc_id", "t"]).select("c", "text").mapInArrow(_shingles(words), "c long, h binary")
    compared = groups.join(sets.dropDuplicates(["c"]), "c").select("g", "c", "h")
    return compared.repartition("g").sortWithinPartitions("g", "c").mapInArrow(_verified, "a long, b long").distinct()


def near_groups(docs: DataFrame, words: int = 5, most: int = 4, similar: int = PREFILTER) -> DataFrame:
    """(doc_id, t, component_id, kept) of each distinct doc_id and text (t is its hash): groups by both the Golay keys' links
    and similar_links. component_id is the group's smallest doc_id, and one row of the group is kept."""
    schema = "doc_id long, t long, fp long, c long, w array<long>, keys array<long>"
    made = cut(_rows(docs).mapInArrow(_sketches(words), schema))
    classes = cut(made.groupBy("c").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.first("w").alias("w"), F.first("keys").alias("keys"), F.count("*").alias("n")))
    kinds = cut(made.select("fp", "c").distinct())
    heads = cut(kinds.groupBy("fp").agg(F.min("c").alias("head"), F.count("*").alias("n")))
    prints = heads.select("fp", "head")
    same = join_lookup(kinds, heads, "fp").where("c <> head").select(F.col("c").alias("a"), F.col("head").alias("b"))
    ends = [prints.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head")) for c in "ab"]
    linked = print_links(prints.select("fp"), most).join(ends[0], "a").join(ends[1], "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    roots = components(same.unionByName(linked).unionByName(similar_links(docs, classes, words, similar)))
    member = cut(classes.join(roots, classes["c"] == roots["id"], "left").select("c", "first", F.col("n").alias("rows"), F.coalesce("root", "c").alias("root")))
    firsts = cut(member.groupBy("root").agg(F.min("first").alias("kept"), F.count("*").alias("n")))
    named = cut(join_lookup(member, firsts, "root").select("c", "kept", F.col("rows").alias("n")))
    rows = join_lookup(made.select("doc_id", "t", "c").distinct(), named, "c")
    return rows.select("doc_id", "t", F.col("kept.doc_id").alias("component_id"), (F.struct("doc_id", "t") == F.col("kept")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, most: int = 4) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest doc_id stays, whole and once; rows that share a
    doc_id are told apart by their texts; rows whose doc_id is null stay."""
    text, kept_id, kept_text = fresh(docs, "_t", "_kept", "_kept_t")
    kept = near_groups(docs, words, most).where("kept").select(F.col("doc_id").alias(kept_id), F.col("t").alias(kept_text))
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(text, F.xxhash64(F.col("text").cast("string")))
    named = named.join(kept, (F.col("doc_id").cast("long") == F.col(kept_id)) & (F.col(text) == F.col(kept_text)), "left_semi")
    return named.dropDuplicates(["doc_id", text]).drop(text).unionByName(docs.where(F.col("doc_id").isNull()))

"""Phrase collocations by prefix-free parsing: words that stand together more often than their parts would.

Each piece of text is parsed into chunks that overlap by `ORDER - 1` words: a chunk ends after a window of that many words whose
hash is a multiple of `modulus`, and the next one begins with the same window. Boundaries depend on these words only, so repeated
text is parsed alike and the dictionary of distinct chunks, with the number of times the parse has each, is what is counted:
n-grams inside of distinct chunks, weighted. An n-gram belongs to the chunk in which it starts before the closing window, so what
lies in an overlap counts once; the last chunk of a piece has no closing window and all starts count.

A phrase can reach the threshold only if all that it holds does, so phrases are sifted before they are built as text: words are
counted while texts are parsed; pairs and triples of frequent words by a hash, as numbers that are dealt out by their first bits, packed
into one row for each group of them. What reaches the threshold stands in a filter of `FILTER` bits, broadcast at a fixed size whatever
the corpus. The last pass counts, as text, the phrases that the filters pass, and drops by its exact count what they pass by chance or by
a collision; only the work depends on them, not the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.common import int_column, runs, text_bytes, written

ORDER = 4
#: Bits of a filter of frequent words or phrases: 16 MB.
FILTER = 1 << 27

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Marks of pieces become line ends, tabs become spaces; both are ASCII, so UTF-8 stays whole.
_SPLIT = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else _LOWER[b] for b in range(256))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _chunks(modulus: int, size: int = 4_000_000, most: int = 200_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (lang, text) into (lang, word, chunk, weight): chunks, and words with `word` set; equal ones of a part of the batch summed."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[str, list[bytes]] = {}
        words: dict[str, Counter[bytes]] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text"))):
                keys, seen = chunks.setdefault(lang, []), []
                for piece in text.translate(_SPLIT).split(b"\n"):
                    found = piece.split()
                    seen += found
                    if len(found) > 2 * ORDER:
                        keys.extend(_parse(found, modulus))
                    elif found:  # too short for a window that would save anything
                        keys.append(b" ".join(found))
                words.setdefault(lang, Counter()).update(seen)
                held += len(text)
                if held >= size:
                    yield from _flush({k: Counter(v) for k, v in chunks.items()}, False)
                    chunks, held = {}, 0
                if len(words[lang]) >= most:  # words are few beside chunks: they are held longer
                    yield from _flush(words, True)
                    words = {}
        yield from _flush({k: Counter(v) for k, v in chunks.items()}, False)
        yield from _flush(words, True)

    return parsed


def _parse(words: list[bytes], modulus: int) -> Iterator[bytes]:
    """The chunks of a piece; one with a closing window ends in a space."""
    overlap, start = ORDER - 1, 0
    for end in range(ORDER, len(words) - overlap):
        if not _window(words, end) % modulus:
            yield b" ".join(words[start : end + overlap]) + b" "
            start = end
    yield b" ".join(words[start:])


def _window(words: list[bytes], at: int) -> int:
    return xxhash.xxh32_intdigest(b" ".join(words[at : at + ORDER - 1]))


def _flush(found: dict[str, Counter[bytes]], word: bool) -> Iterator[pa.RecordBatch]:
    for lang, counts in found.items():
        n = len(counts)
        arrays = [_repeated(lang, n), pa.array(np.full(n, word)), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "word", "chunk", "weight"])


def _repeated(value: str | None, n: int) -> pa.Array:
    return pa.array([value], pa.string()).take(pa.array(np.zeros(n, np.int32)))


class Part:
    """Chunks of one language: their words, also as numbers and hashes, which places count, how much room a phrase has from each place on."""

    def __init__(self, lang: str | None, chunks: pa.Array, weights: np.ndarray):
        self.words = b" ".join(text_bytes(chunks)).split()
        numbers = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        self.ids, self.distinct = np.fromiter(map(numbers.__getitem__, self.words), np.int64, len(self.words)), len(numbers)
        closed = pc.ends_with(chunks, " ").to_numpy(zero_copy_only=False)
        lengths = int_column(pc.count_substring(chunks, " ")).astype(np.int64) + ~closed  # spaces stand between words and behind a closed chunk
        ends, owner, at = np.cumsum(lengths), np.repeat(np.arange(len(chunks)), lengths), np.arange(len(self.ids))
        self.counts = at < (ends - np.where(closed, ORDER - 1, 0))[owner]
        self.room, self.weight = ends[owner] - at, weights[owner]
        with np.errstate(over="ignore"):
            self.hash = _word_hashes(lang, numbers)[self.ids]
            self.pair = _mixed(self.hash[:-1] * np.uint64(3) + self.hash[1:])
            self.triple = _mixed(self.pair[:-1] * np.uint64(5) + self.hash[2:])

    def every(self, ok: np.ndarray, n: int) -> np.ndarray:
        """Whether `ok`, told by place, holds for the n places from each place on; places beyond the end don't."""
        padded = np.zeros(len(self.ids) + ORDER, bool)
        padded[: len(ok)] = ok
        return np.logical_and.reduce([padded[k : k + len(self.ids)] for k in range(n)])


def _word_hashes(lang: str | None, words: Collection[bytes]) -> np.ndarray:
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        return _mixed(own + np.uint64(xxhash.xxh64_intdigest((lang or "").encode())))


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str | None, Part]]:
    held: dict[str | None, list[pa.RecordBatch]] = {}
    total = 0
    for batch in batches:
        ends = np.cumsum(int_column(pc.binary_length(batch.column("chunk"))).astype(np.int64))
        cuts = np.unique([0, *(np.searchsorted(ends, np.arange(size, ends[-1], size)) + 1), len(ends)]) if len(ends) else []
        for start, end in zip(cuts[:-1], cuts[1:]):
            piece = batch.slice(start, end - start)
            langs = piece.column("lang").dictionary_encode("encode")
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                held.setdefault(lang, []).append(piece.filter(pc.equal(langs.indices, k)))
            total += ends[end - 1] - (ends[start - 1] if start else 0)
            if total >= size:
                yield from _whole(held)
                held, total = {}, 0
    yield from _whole(held)


def _whole(held: dict[str | None, list[pa.RecordBatch]]) -> Iterator[tuple[str | None, Part]]:
    for lang, rows in held.items():
        table = pa.Table.from_batches(rows).combine_chunks()
        yield lang, Part(lang, table["chunk"].combine_chunks(), table["weight"].to_numpy())


def _passes(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _slots(h, len(bitmap) * 64)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _hash_counter(words, groups: int, least: int, size: int = 3_000_000, most: int = 1_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct chunks into (part, keys, counts): pairs and triples of frequent words by the first `groups` bits of their hashes, each
    with packed arrays of the next 32 bits and of weighted counts up to `least`, which is all that matters of larger ones."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, part in _parts(batches, size):
            frequent = _passes(words.value, part.hash)
            two, three = (part.counts & (part.room >= n) & part.every(frequent, n) for n in (2, 3))
            h = np.concatenate([part.pair[two[:-1]], part.triple[three[:-2]]])
            held.append((_key(h, groups), np.minimum(np.concatenate([part.weight[two], part.weight[three]]), least)))
            if sum(len(k) for k, _ in held) >= most:
                yield _packed(held, groups, least)
                held = []
        yield _packed(held, groups, least)

    return counted


def _key(h: np.ndarray, groups: int) -> np.ndarray:
    return h >> np.uint64(32 - groups)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    start = runs(keys)[:-1]
    return keys[start], np.add.reduceat(counts[order], start, dtype=np.int64) if len(keys) else counts


def _packed(held: list[tuple[np.ndarray, np.ndarray]], groups: int, least: int) -> pa.RecordBatch:
    keys, counts = _summed([(np.zeros(0, np.uint64), np.zeros(0, np.int64)), *held])
    ends = np.searchsorted(keys, np.arange((1 << groups) + 1, dtype=np.uint64) << np.uint64(32))
    full = np.flatnonzero(np.diff(ends))
    edges = np.append(ends[full], len(keys))
    columns = [pa.array(full.astype(np.int32))]
    for values in (keys.astype(np.uint32), np.minimum(counts, least).astype(np.min_scalar_type(least))):
        offsets = (edges * values.itemsize).astype(np.int32)
        columns.append(pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(offsets), pa.py_buffer(values)]))
    return pa.RecordBatch.from_arrays(columns, names=["part", "keys", "counts"])


def _frequent_keys(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of `_hash_counter`, those of a part in a row, into the keys (h) that count up to `least`; one part is held."""
    kind = np.min_scalar_type(least)

    def kept(part: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = _summed(held)
        found = keys[counts >= least].astype(np.int64) | part << 32
        return pa.RecordBatch.from_arrays([pa.array(found)], names=["h"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None
        for batch in batches:
            for part, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "counts")), strict=True):
                if held and part != last:
                    yield kept(last, held)
                    held = []
                held.append((np.frombuffer(keys, np.uint32), np.frombuffer(counts, kind)))
                last = part
        if held:
            yield kept(last, held)

    return summed


def _phrase_counter(words, longer, groups: int, size: int = 3_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct chunks into (lang, size, phrase, f): weighted counts of the phrases that the filters pass."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, part in _parts(batches, size):
            names, base = part.words, part.distinct + 1
            pairs, triples = (_passes(longer.value, _key(h, groups)) for h in (part.pair, part.triple))
            passed = {1: part.every(_passes(words.value, part.hash), 1), 2: part.every(pairs, 1), 3: part.every(triples, 1), 4: part.every(triples, 2)}
            for n, frequent in passed.items():
                at = np.flatnonzero(part.counts & (part.room >= n) & frequent)
                if not len(at):
                    continue
                key = part.ids[at]
                for k in range(1, n):  # numbers of the distinct prefixes stay small, so a key is two of them
                    if k > 1:
                        key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                    key = key * base + part.ids[at + k]
                _, where, back = np.unique(key, return_index=True, return_inverse=True)
                f = np.zeros(len(where), np.int64)
                np.add.at(f, back, part.weight[at])
                spots = at[where].tolist()
                phrases = [b" ".join(names[p : p + n]) for p in spots]
                arrays = [_repeated(lang, len(f)), pa.array(np.full(len(f), n, np.int32)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(f)]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "size", "phrase", "f"])

    return counted


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", modulus: int = 16) -> DataFrame:
    """(lang, word, chunk, weight): the distinct chunks of the parse of all texts and how often each stands there, and, with `word` set,
    the distinct words. Chunks with a closing window end in a space."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    parsed = rows.mapInArrow(_chunks(modulus), "lang string, word boolean, chunk string, weight long")
    return parsed.groupBy("lang", "word", "chunk").agg(F.sum("weight").alias("weight"))


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(h) & np.uint64(bits - 1)


def _filter(hashes: DataFrame, bits: int):
    """Broadcast bitmap of the slots of hashes (column h): at most bits / 64 rows of one number each reach the driver."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _slots(batch.column("h").to_numpy().view(np.uint64), bits)
            bit = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["at", "bit"])

    found = hashes.mapInArrow(slots, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[found["at"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bitmap)


def phrase_counts(chunks: DataFrame, least: int, bits: int = FILTER) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of up to ORDER words with f >= least, and (lang, n), the words of each language, from what
    `dictionary` gives."""
    words, chunks = chunks.where("word").drop("word"), chunks.where("not word").drop("word")
    totals = words.groupBy("lang").agg(F.sum("weight").alias("n"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                own = batch.filter(pa.array(langs == lang))
                yield pa.RecordBatch.from_arrays([pa.array(_word_hashes(lang, text_bytes(own.column("chunk"))).view(np.int64))], names=["h"])

    one = _filter(words.where(F.col("weight") >= least).mapInArrow(hashed, "h long"), bits)
    # Groups are as many as the partitions that the user has set for the size of the data, so one of them stays small.
    groups = min(30, max(10, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length()))
    packed = chunks.mapInArrow(_hash_counter(one, groups, least), "part int, keys binary, counts binary")
    longer = _filter(packed.repartition("part").sortWithinPartitions("part").mapInArrow(_frequent_keys(least), "h long"), bits)
    phrases = chunks.mapInArrow(_phrase_counter(one, longer, groups), "lang string, size int, phrase string, f long")
    return written(phrases.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)), totals


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, text: str = "text", lang: str = "lang", modulus: int = 16, bits: int = FILTER) -> DataFrame:
    """The `top` phrases of 2 to 4 words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z and divided into pieces at `.,;:!?` and line ends, pieces into words at spaces and tabs. a, l and r are
    the occurrences of the phrase and of its two parts at the cut with the smallest score floor(2000000 a / (l + r)) (ties: the
    earlier cut), n the words of the language. Phrases with a < least are no candidates; a candidate whose words lie inside
    of a longer one with at least `covered` percent of its occurrences is left out. Order: score and a descending, phrase by its bytes.

    Null and empty texts have no words; a null language is `und`, one with that name joins it; every repeated row counts;
    other columns are not looked at; an empty table gives no rows.
    """
    return rank_phrases(*phrase_counts(written(dictionary(docs, text, lang, modulus)), least, bits), top, covered)


def rank_phrases(counts: DataFrame, totals: DataFrame, top: int, covered: int) -> DataFrame:
    """What `collocations` returns, from what `phrase_counts` returns."""
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(F.col("words"), start, n), " ")
    candidates = counts.where("size > 1").withColumn("words", words)

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "size", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    known = counts.select("lang", "phrase", "f")
    cuts = cuts.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    exact = "cast(a as decimal(20)) * 2000000 div (cast(l as decimal(20)) + cast(r as decimal(20)))"
    scored = cuts.withColumn("score", F.expr(exact)).groupBy("lang", "size", "phrase", "a")
    scored = scored.agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "size", "phrase", "a", "best.score", "best.l", "best.r")

    inner = candidates.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    inner = inner.select("lang", part(F.col("i"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left")
    left = left.where(F.expr(f"longer is null or 100 * cast(longer as decimal(20)) < {covered} * cast(a as decimal(20))"))

    # A rank of at most `top` is a limit that Spark applies within each task before it brings a language together.
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ORACLE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), weighed AS (
  SELECT lang, w, count(*) AS weight FROM worded WHERE len(w) > 0 GROUP BY lang, w
), totals AS (
  SELECT lang, sum(weight * len(w))::BIGINT AS n FROM weighed GROUP BY lang
), grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, weight
  FROM (SELECT lang, w, weight, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM weighed, (VALUES (1), (2), (3), (4)) AS sizes(size) WHERE len(w) >= size)
), counts AS (
  SELECT lang, size, phrase, sum(weight)::BIGINT AS f FROM grams GROUP BY lang, size, phrase HAVING sum(weight) >= 30
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1
), cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.a, min({'score': (2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f))::BIGINT, 'k': c.k, 'l': x.f, 'r': y.f}) AS best
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail
  GROUP BY c.lang, c.phrase, c.a
), longer AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS f
  FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS i FROM candidates, (VALUES (2), (3)) AS lens(m) WHERE m < size)
  GROUP BY ALL
), ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.best.score DESC, s.a DESC, s.phrase) AS rank,
         s.phrase, s.a, s.best.l AS l, s.best.r AS r, s.best.score AS score
  FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
  WHERE g.f IS NULL OR 100::HUGEINT * g.f < 80::HUGEINT * s.a
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

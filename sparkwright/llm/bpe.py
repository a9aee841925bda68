"""Byte-level BPE encoding and decoding of whole texts.

Method: a contiguous rank array. A word's parts and the merge ranks of its adjacent parts stand in two short lists; the
smallest rank is found by a scan, the boundary there is deleted, and the ranks on its two sides are refreshed. Words of
more than LONG parts, for which repeated scans would cost the square of the length, use a heap over a linked list with
the same order (rank, then position). Words already seen come from a bounded cache, as text repeats its words.

The vocabulary file is read once on the driver from a path the caller gives; the tables (tens of thousands of entries,
whatever the corpus) reach the executors in a broadcast.

Defined cases: a null or empty text has no tokens and decodes to the empty text; text that spells a special token
becomes that token, as the tokenizers library does by default; rows keep their order, repeats and other columns.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the published split pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 64
CACHE_WORDS = 200_000
NONE = 1 << 60


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by the published rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """Tables of a tokenizer file: pairs (left id * 65536 + right id) to (rank, id), bytes by id, ids by byte, specials."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split, model = spec["pre_tokenizer"], spec["model"]
    if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or model.get("ignore_merges"):
        raise ValueError("only plain byte-level BPE files are supported")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("special tokens with stripping are not supported")
    names = byte_names()
    vocab = model["vocab"]
    if max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) >= 1 << 16:
        raise ValueError("ids must fit 16 bits")
    pairs = {}
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs[vocab[left] << 16 | vocab[right]] = rank << 16 | vocab[left + right]
    bytes_of = {i: bytes(names[c] for c in token) for token, i in vocab.items()}
    bytes_of |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return {
        "pairs": pairs,
        "bytes": [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)],
        "byte_ids": [vocab[c] for c, _ in sorted(names.items(), key=lambda x: x[1])],
        "specials": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


class Codec:
    """Encodes and decodes one text at a time from the tables of read_vocabulary."""

    def __init__(self, tables: dict, cache_words: int = CACHE_WORDS):
        self.pairs, self.bytes_of, self.byte_ids, self.specials = (tables[k] for k in ("pairs", "bytes", "byte_ids", "specials"))
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.fresh: dict[str, tuple[int, ...]] = {}
        self.stale: dict[str, tuple[int, ...]] = {}
        self.cache_words = cache_words

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word, kept in a cache of two generations that holds cache_words words at most."""
        ids = self.stale.get(word)
        if ids is None:
            parts = [self.byte_ids[b] for b in word.encode("utf-8")]
            ids = tuple(self.merge_short(parts) if len(parts) <= LONG else self.merge_long(parts))
            if len(parts) > LONG:
                return ids
        self.fresh[word] = ids
        if len(self.fresh) * 2 >= self.cache_words:
            self.stale, self.fresh = self.fresh, {}
        return ids

    def merge_short(self, parts: list[int]) -> list[int]:
        pairs = self.pairs
        ranks = [pairs.get(a << 16 | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            parts[at] = least & 0xFFFF
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = pairs.get(parts[at - 1] << 16 | parts[at], NONE)
            if at < len(ranks):
                ranks[at] = pairs.get(parts[at] << 16 | parts[at + 1], NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        pairs, n = self.pairs, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := pairs.get(parts[i] << 16 | parts[i + 1]))is not None]
        heapq.heapify(heap)
        while heap:
            rank, at, left, right = heapq.heappop(heap)
            nxt = after[at]
            if parts[at] != left or nxt < 0 or parts[nxt] != right:
                continue
            parts[at], parts[nxt] = rank & 0xFFFF, -1
            after[at] = far = after[nxt]
            if far >= 0:
                before[far] = at
                if (r := pairs.get(parts[at] << 16 | parts[far])) is not None:
                    heapq.heappush(heap, (r, at, parts[at], parts[far]))
            if (near := before[at]) >= 0 and (r := pairs.get(parts[near] << 16 | parts[at])) is not None:
                heapq.heappush(heap, (r, near, parts[near], parts[at]))
        return [p for p in parts if p >= 0]

    def plain(self, text: str, out: list[int]) -> None:
        for word in self.words(text):
            ids = self.fresh.get(word)
            out.extend(self.word(word) if ids is None else ids)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        start = 0
        if self.cut is not None:
            for found in self.cut.finditer(text):
                self.plain(text[start : found.start()], out)
                out.append(self.specials[found[0]])
                start = found.end()
        self.plain(text[start:] if start else text, out)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[object, Codec] = {}


def _codec(shared) -> Codec:
    """One codec for each worker process and vocabulary, so its cache lasts from task to task."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def _encoder(shared, at: int, chars: int = 4_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)

        def flush(batch, start, stop, ids, texts):
            part = batch.slice(start, stop - start)
            arrays = [*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])

        for batch in batches:
            start, size, ids, texts = 0, 0, [], []
            for row, text in enumerate(batch.column(at)):
                got = codec.encode(text := text.as_py())
                ids.append(got)
                texts.append(codec.decode(got))
                size += len(text or "")
                if size >= chars:  # long texts leave in small batches
                    yield flush(batch, start, row + 1, ids, texts)
                    start, size, ids, texts = row + 1, 0, [], []
            if ids:
                yield flush(batch, start, batch.num_rows, ids, texts)

    return encoded


def bpe_round_trip(
    docs: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "input_ids", decoded: str = "decoded_text"
) -> DataFrame:
    """docs with two more columns: the ids of each whole text, and the text that these ids decode to.

    A column of docs with one of the new names is replaced. The work is a map over rows: no shuffle, no group.
    """
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in (ids, decoded)])
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    new = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*kept.schema.fields, *new])])
    out = kept.toDF(*[f"c{i}" for i in range(len(kept.columns))]).mapInArrow(_encoder(shared, kept.columns.index(text)), inner)
    return out.toDF(*kept.columns, ids, decoded)

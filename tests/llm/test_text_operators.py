"""Operators on documents against brute force, and on odd rows."""

import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkwright.llm import linededup, mixing, quality, queries, simhash, suffix, toxicity
from sparkwright.llm.bpe import Codec, bpe_round_trip, read_vocabulary
from sparkwright.llm import common
from sparkwright.llm.common import components

LABELS = "doc_id long, quality int, toxic int"


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 200), (None, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r["id"]: r["root"] for r in got}
    assert len({roots[i] for i in range(61)}) == 1 and len({roots[i] for i in (100, 101, 102)}) == 1
    assert roots[0] != roots[100] and 200 not in roots


def test_bpe(spark, odd_docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.vocabulary_path())
    docs = odd_docs.union(spark.createDataFrame([(20, "a<|endoftext|>b  '　x\x1c \x85y", "en", "s", 1, "q")], odd_docs.schema))
    rows = bpe_round_trip(docs, queries.vocabulary_path()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["input_ids"] == ids and r["decoded_text"] == own.decode(ids, skip_special_tokens=False)
        assert set(odd_docs.columns) <= set(r.asDict())


def test_bpe_merges_agree():
    codec = Codec(read_vocabulary(queries.vocabulary_path()))
    for word in ("aaaaaaaaaaaaaa", "thethethe" * 9, "é漢字" * 12, "x"):
        parts = [codec.byte_ids[b] for b in word.encode()]
        assert codec.merge_short(list(parts)) == codec.merge_long(list(parts))


def test_golay_keys_meet_within_two_bits():
    tables = [set(row[row >= 0].tolist()) for row in simhash.golay()]
    for weight in range(3):
        for bits in combinations(range(23), weight):
            f = sum(1 << b for b in bits)
            s = int(simhash.syndrome(np.array([f]))[0])
            assert all(tables[x] & {e ^ f for e in tables[x ^ s]} for x in range(2048))


def test_simhash_keys_meet_within_four_bits():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b ^= 1 << int(bit)
        keys = [set(simhash.keys_of(np.array([x], np.uint64).view(np.int64))[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def brute_fingerprint(text, words):
    parts = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] if len(parts) >= words else [b" ".join(parts)] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, odd_docs):
    rows = simhash.simhash_groups(odd_docs, 4, 4).collect()
    assert len(rows) == odd_docs.count()
    texts = [(r["doc_id"], brute_fingerprint(r["text"], 4)) for r in odd_docs.collect()]
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in rows) == Counter(texts)
    for r in rows:
        seen, todo = set(), [r["fp"] % (1 << 64)]
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += [f for _, f in texts if (f ^ at).bit_count() <= 4]
        ids = [d for d, f in texts if f in seen and d is not None]
        assert r["component_id"] == (min(ids) if ids else None)


def test_dense_group_links_without_all_pairs():
    base = 0x0123456789ABCDEF
    near = np.array([base ^ (1 << i) for i in range(60)] + [base], np.uint64).view(np.int64)
    a, b = simhash.links_within(near, 4)
    assert len(np.concatenate(a)) == 60


def test_keep_one(spark, odd_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(None) == 2 and 9 in ids and sum(i in (5, 6, 8) for i in ids) == 1


def jaccard(a, b, words=5):
    a, b = (set(simhash.shingle_hashes(t.encode(), words).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def near_pairs(words):
    """Pairs of texts with a similarity from 0.5 to 0.95, short ones among them."""
    import random

    rng = random.Random(11)
    pairs = []
    for i in range(240):
        own = [rng.choice(words) for _ in range(rng.choice((9, 40, 150)))]
        other = list(own)
        for at in rng.sample(range(len(own)), 1 + len(own) // rng.choice((25, 35, 45, 60, 90))):
            other[at] = f"new{i}x{at}"
        if i % 4 == 0:
            other = own[: int(len(own) * rng.uniform(0.75, 0.97))]
        pairs.append((" ".join(own), " ".join(other)))
    return pairs


@pytest.mark.parametrize("block", [simhash.BLOCK, 4])
def test_near_groups_are_by_exact_similarity(spark, words, block, monkeypatch):
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (5, simhash.PREFILTER, block))
    pairs = near_pairs(words)
    base = [f"w{i}" for i in range(120)]
    dense = [" ".join(base[:i] + [f"d{i}"] + base[i + 1 :]) for i in range(5, 115, 10)]
    texts = {i: t for i, t in enumerate([t for p in pairs for t in p] + dense)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = {i: simhash.fingerprint(t.encode(), 5) % (1 << 64) for i, t in texts.items()}
    label = {i: i for i in texts}
    links = [(a, b) for a, b in combinations(texts, 2) if (prints[a] ^ prints[b]).bit_count() <= 4 or jaccard(texts[a], texts[b]) >= 0.8]
    for _ in range(12):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert got == label
    below = [i for i, p in enumerate(pairs) if 0.7 <= jaccard(*p) < 0.8]
    assert len(below) > 20 and sum(got[2 * i] != got[2 * i + 1] for i in below) > 0.9 * len(below)


def test_keep_one_tells_rows_of_one_id_apart(spark, words):
    a, b = " ".join(words[:60]), " ".join(words[100:170])
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (2, b + " end"), (3, " ".join(words[200:260]))], "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect())
    assert got == Counter({(1, a): 1, (1, b): 1, (3, " ".join(words[200:260])): 1})


def brute_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        yield bytes(b for b, m in zip(t, mask, strict=True) if not m), sum(mask)


@pytest.mark.parametrize("hot", [suffix.HOT, 2])
def test_suffix(spark, odd_docs, words, hot):
    import random

    rng = random.Random(8)
    passage = " ".join(rng.choice(words) for _ in range(80))
    more = [(100 + i, f"{rng.random()} {passage[i:]} {rng.random()}" if i % 3 else "ab" * 300, "en", "s", 1, "q") for i in range(12)]
    docs = odd_docs.union(spark.createDataFrame(more, odd_docs.schema))
    rows = docs.select("doc_id", "text").collect()
    texts = [(r["text"] or "").encode() for r in rows]
    want = Counter((r["doc_id"], len(t), n, hashlib.sha256(k).hexdigest()) for r, t, (k, n) in zip(rows, texts, brute_removed(texts, 200), strict=True))
    got = suffix.remove_repeats(docs, 200, hot=hot).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in got) == want


def test_line_dedup(spark, odd_docs):
    out = linededup.dedup_lines(odd_docs, mean_lines=1_000_003)  # the text is one chunk
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    block = "\n".join(f"shared line {i} of the block" for i in range(12))
    docs = spark.createDataFrame([(1, f"own a\n{block}\nend a"), (2, f"own b\nmore b\n{block}\nend b"), (3, None), (4, ""), (None, block)], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert left[1] == f"own a\n{block}\nend a" and left[3] is None and left[4] == ""
    assert len(left[2]) < len(block) and "own b" in left[2] and "end b" in left[2]
    assert len(left[None]) < len(block)


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    block = "\n".join(f"shared line {i} of the block" for i in range(12))
    other = "\n".join(f"unique line {i} of a row of its own" for i in range(14))
    more = "\n".join(f"one more line {i} of another row" for i in range(14))
    rows = [(1, f"own\n{block}"), (5, f"b\n{block}"), (5, f"b\n{other}"), (None, f"c\n{block}"), (None, f"c\n{more}")]
    left = [(r["doc_id"], r["text"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {(1, f"own\n{block}"), (5, f"b\n{other}"), (None, f"c\n{more}")} <= set(left) and len(left) == 5
    assert sorted(d is None for d, t in left if "shared" in t and len(t) < len(block)) == [False, True]


def test_line_dedup_of_exact_repeats(spark):
    block = "\n".join(f"shared line {i} of the block" for i in range(12))
    for key in (3, None):
        df = spark.createDataFrame([(key, block)] * 3, "doc_id long, text string")
        left = sorted((r["text"] for r in linededup.dedup_lines(df).collect()), key=len)
        assert left[2] == block and left[0] == left[1] and len(left[0]) < len(block) / 2


def test_mixing(spark, odd_docs):
    out = mixing.mix(odd_docs, share=2.0, max_epochs=2)
    rows = out.collect()
    assert set(odd_docs.columns) <= set(out.columns) and all(r["text"] for r in rows)
    assert max(Counter(r["doc_id"] for r in rows if r["doc_id"] is not None).values()) == 2
    assert mixing.mix_documents(odd_docs).columns == odd_docs.columns


def test_mixing_redistributes(spark):
    rows = [(i, "w w w w w w w w w w", "en", "src0") for i in range(2)] + [(100 + i, "w w w w w w w w w w", "en", "src4") for i in range(40)] + [(200 + i, "w w w w w w w w w w", "en", "src1") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = Counter(r["source"] for r in mixing.mix(docs, {"d0": 0.5, "d1": 0.5}, {"en": 1.0}, share=0.5, max_epochs=1).collect())
    # 410 tokens, 205 for each domain; src0 gives its 20, its sibling src4 the rest of the domain
    assert got == {"src0": 2, "src4": 18, "src1": 20}


def test_labels_missing(spark, odd_docs):
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality.with_score(odd_docs, quality.fit(odd_docs, none)).collect()} == {1.0}
    assert {r["score"] for r in toxicity.with_severity(odd_docs, toxicity.fit(odd_docs, none)).collect()} == {0.0}


def test_quality_and_toxicity(spark, words):
    import random

    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        text = " ".join(rng.choice(words) for _ in range(60))
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            text = " ".join(w + "###" for w in text.split())
        if toxic:
            text += " scum idiot"
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    truth = {i: (q, t) for i, q, t in labels}
    scored = quality.with_score(docs, quality.fit(docs, marks)).collect()
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]][0] for r in scored]) > 0.95
    severe = toxicity.with_severity(docs, toxicity.fit(docs, marks)).collect()
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]][1] for r in severe]) > 0.95
    assert all(r["severity"] >= r["score"] - 1e-12 for r in severe)


def test_quality_gradients():
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in quality.first_model(rng).items()}
    chunks = rng.integers(1, 255, (3, quality.CHUNK)).astype(np.uint8)
    sizes, labels = np.array([1, 2]), np.array([1.0, 0.0])
    grads = quality.gradients(model, chunks, sizes, labels)

    def loss():
        outs = np.ascontiguousarray(quality.windows(model, chunks)).reshape(-1, quality.WIDTH * quality.DIM) @ model["filters"]
        pooled = np.maximum(outs.reshape(3, -1, quality.FILTERS).max(axis=1) + model["bias"], 0)
        mean, peak = np.stack([pooled[0], pooled[1:].mean(axis=0)]), np.stack([pooled[0], pooled[1:].max(axis=0)])
        p = quality.combine(model, mean, peak)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name in ("filters", "bias", "mean", "peak", "embedding"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        keep, step = model[name][at], 1e-5
        model[name][at] = keep + step
        up = loss()
        model[name][at] = keep - step
        down = loss()
        model[name][at] = keep
        assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-3


def test_empty_tables(spark, odd_docs):
    none = odd_docs.limit(0)
    labels = spark.createDataFrame([], LABELS)
    assert bpe_round_trip(none, queries.vocabulary_path()).count() == 0
    assert simhash.simhash_groups(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert suffix.remove_repeats(none).count() == 0
    assert linededup.dedup_lines(none).count() == 0
    assert mixing.mix_documents(none).count() == 0
    assert quality.keep_good(none, labels).count() == 0
    assert toxicity.with_severity(none, toxicity.fit(none, labels)).count() == 0


def test_scores_by_name(spark, odd_docs):
    scored = quality.with_score(odd_docs, {"share": 0.25})  # odd_docs has a column of that name
    assert scored.columns.count("score") == 1 and scored.select(F.sum("score")).first()[0] == 0.25 * odd_docs.count()


def test_similar_texts_are_one_group(spark, words):
    import random

    rng = random.Random(12)
    base = [rng.choice(words) for _ in range(200)]
    rows = [(1, " ".join(base))]
    for i in range(2, 8):  # four words of 200 replaced: about 0.8 of the shingles are left
        other = list(base)
        for at in rng.sample(range(200), 4):
            other[at] = f"new{rng.random()}"
        rows.append((i, " ".join(other)))
    rows += [(20 + i, " ".join(rng.choice(words) for _ in range(200))) for i in range(5)]
    rows += [(30, " ".join(base[:60] + [rng.choice(words) for _ in range(140)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert {groups[i] for i in range(1, 8)} == {1}
    assert all(groups[i] == i for i in (20, 21, 22, 23, 24, 30))


def test_line_dedup_is_linear_in_lines(spark):
    import time

    text = "\n".join(f"line {i} of a long list" for i in range(64_000))
    began = time.time()
    rows = linededup.remove_repeated_chunks(spark.createDataFrame([(1, text), (2, text), (3, text + "\nmore")], "doc_id long, text string")).collect()
    assert time.time() - began < 60
    got = {r["doc_id"]: (r["_lines"], r["_removed_lines"]) for r in rows}
    assert got[1] == (64_000, 0) and got[2][0] == 64_000 and got[2][1] > 50_000 and got[3][1] > 50_000


def test_hot_chunks(spark):
    rows = [(i, "a\nb\nc\nd\ne\nf") for i in range(300)] + [(1000 + i, f"x{i}\ny{i}\nz{i}") for i in range(300)] + [(2000 + i, f"x{i}\ny{i}\nz{i}") for i in range(300)]
    rows += [(None, "a\nb\nc\nd\ne\nf")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1, 2, 1000):  # no key is hot, some are, all are
        linededup.HOT, kept = hot, linededup.HOT
        try:
            got = Counter((r["doc_id"], r["text"]) for r in linededup.dedup_lines(docs, 1_000_003).collect())
        finally:
            linededup.HOT = kept
        want = Counter([(0, rows[0][1]), *((i, "") for i in range(1, 300)), *((1000 + i, f"x{i}\ny{i}\nz{i}") for i in range(300)), *((2000 + i, "") for i in range(300)), (None, ""), (None, "")])
        assert got == want


def sharing_two_indices(rng, n):
    """Fingerprints whose first two segments have one error each, so that all share a key of two indices; the third is random."""
    flip = lambda base, width: base ^ (1 << rng.integers(0, width, n))
    return (flip(0x2ABCDE, 22).astype(np.uint64) << np.uint64(42)) | (flip(0x155AA5, 21).astype(np.uint64) << np.uint64(21)) | rng.integers(0, 1 << 21, n).astype(np.uint64)


def groups_of(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("limit", [16, 256, 10**9])
def test_divided_keys_lose_no_link(monkeypatch, limit):
    monkeypatch.setattr(simhash, "DIVIDED", limit)
    rng = np.random.default_rng(4)
    fps = sharing_two_indices(rng, 900)
    close = fps[:300].copy()
    for _ in range(2):  # up to two more errors in the third segment, and one moved error in the others
        close ^= np.uint64(1) << rng.integers(0, 21, 300).astype(np.uint64)
    fps = np.unique(np.concatenate([fps, close, close[:50] ^ np.uint64(1 << 25)]))
    rows, keys = simhash.keys_of(fps.view(np.int64))
    order = np.argsort(keys, kind="stable")
    left, right = simhash.linked_pairs(keys[order], fps[rows[order]], 4)
    at = {int(f): i for i, f in enumerate(fps)}
    got = {(at[int(a)], at[int(b)]) for x, y in zip(left, right) for a, b in zip(x, y)}
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4, 1))
    assert all(np.bitwise_count(fps[a] ^ fps[b]) <= 4 for a, b in got)
    want, have = groups_of(near, len(fps)), groups_of(got, len(fps))
    assert len({(a, b) for a, b in zip(want, have)}) == len(set(want)) == len(set(have)) and len(near) > 300


def test_work_of_a_large_key_is_not_quadratic(monkeypatch):
    seen = []
    plain = simhash.links_within
    monkeypatch.setattr(simhash, "links_within", lambda fps, most: seen.append(len(fps)) or plain(fps, most))
    for n in (5_000, 20_000):
        seen.clear()
        fps = np.unique(sharing_two_indices(np.random.default_rng(1), n))
        simhash.linked_pairs(np.full(len(fps), 9 << 40), fps, 4)
        assert sum(x * x for x in seen) < 0.02 * n * n


def helper_names():
    """Every quoted name with a leading underscore in the subpackage: names of helper columns."""
    import pathlib
    import re

    folder = pathlib.Path(linededup.__file__).parent
    return sorted({n for f in folder.glob("*.py") for n in re.findall(r'"(_[a-z_]+)"', f.read_text())})


def test_clashing_names(spark, odd_docs, monkeypatch):
    docs = odd_docs
    helpers = helper_names()
    assert {"_t", "_kept", "_quality", "_lines"} <= set(helpers)
    for name in (*helpers, "n_tokens", "ids_sha256", "decoded_sha256", "key", "tag", "h", "row", "s", "t", "c", "fp", "w", "keys", "first"):
        docs = docs.withColumn(name, F.lit("own"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "fit", lambda *_: {"share": 0.9})
    for out in (linededup.dedup_lines(docs), mixing.mix_documents(docs), simhash.keep_one(docs), quality.keep_good(docs, labels)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r[n] for r in rows for n in helpers} <= {"own"} and (rows or out is None)
    assert quality.keep_good(docs, labels).count() == odd_docs.count()
    assert linededup.remove_repeated_chunks(docs).columns.count("_lines") == 1
    assert mixing.mix(docs).columns.count("_epoch") == 1
    assert queries.token_digests(docs).columns.count("n_tokens") == 1 and queries.token_digests(docs).count() == odd_docs.count()


def plain_quality(model, text):
    """The network without tables: each filter at every other place of each chunk."""
    pools = []
    for at in range(0, max(1, len(text) - quality.OVERLAP), quality.CHUNK - quality.OVERLAP):
        chunk = text[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        outs = []
        for i in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            seen = np.concatenate([model["embedding"][b] for b in chunk[i : i + quality.WIDTH]]).astype(float)
            outs.append(seen @ model["filters"] + model["bias"])
        pools.append(np.maximum(np.max(outs, axis=0), 0))
    logit = np.mean(pools, axis=0) @ model["mean"] + np.max(pools, axis=0) @ model["peak"] + model["base"][0]
    return 1 / (1 + np.exp(-logit))


def test_quality_scores_by_brute_force(words):
    rng = np.random.default_rng(2)
    model = quality.first_model(rng)
    model["bias"] = rng.normal(size=quality.FILTERS).astype(np.float32)
    adds = quality.tables(model)
    for text in (b"", b"one", "é漢 ".encode() * 70, " ".join(words).encode(), " ".join(words * 3).encode()):
        assert abs(quality.score(model, adds, text) - plain_quality(model, text)) < 1e-4
    long = " ".join(words * 200).encode()  # many pieces of few chunks agree with one piece
    assert abs(quality.score(model, adds, long, at_once=7) - quality.score(model, adds, long)) < 1e-6


def test_gradients_in_pieces():
    rng = np.random.default_rng(3)
    model = quality.first_model(rng)
    chunks, sizes, labels = rng.integers(0, 255, (9, quality.CHUNK)).astype(np.uint8), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    whole, pieces = (quality.gradients(model, chunks, sizes, labels, n) for n in (256, 2))
    assert all(np.allclose(whole[k], pieces[k], atol=1e-6) for k in whole)


def toxic_rows(words, grades):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        grade = rng.choice(range(grades))
        text = [rng.choice(words) for _ in range(30)] + [rng.choice(["vile", "vilest", "foul"]) for _ in range(grade * 2 + (rng.random() < 0.3 and grade > 0))]
        rows.append((" ".join(rng.sample(text, len(text))), grade))
    return rows


def test_toxicity_by_brute_force(spark, words):
    rows = toxic_rows(words, 2)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(1000, None), (1001, ""), (1002, " ".join(words * 80) + " vile" * 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, g) for i, (_, g) in enumerate(rows)], LABELS)
    model = toxicity.fit(docs, labels)
    assert model["thresholds"] == sorted(model["thresholds"]) and len(model["thresholds"]) == toxicity.GRADES - 1
    for r in toxicity.with_severity(docs, model).collect():
        level = 0.0
        for f, i in model["index"].items():
            n = sum(f in toxicity.features_of(w) for w in (r["text"] or "").lower().split())
            level += model["weights"][i] * np.log1p(n)
        above = [1 / (1 + np.exp(-(level - t))) for t in model["thresholds"]]
        assert abs(r["score"] - above[0]) < 1e-9 and abs(r["severity"] - sum(above)) < 1e-9
    # of the toxic rows that the model learned from, each grade above 0 holds the same expected share
    held = {r["doc_id"] for r in docs.where(quality.held_out(F.col("doc_id"))).collect()}
    levels = np.array([sum(model["weights"][i] * v for i, v in toxicity.vector(toxicity.counted(t), model["index"]).items()) for k, (t, g) in enumerate(rows) if g and k not in held])
    means = [toxicity.sigmoid(levels - t).mean() for t in model["thresholds"]]
    assert abs(means[1] / means[0] - 2 / 3) < 1e-6 and abs(means[2] / means[0] - 1 / 3) < 1e-6


def test_toxicity_of_graded_labels(words):
    rows = [(toxicity.counted(t), g) for t, g in toxic_rows(words, 4)]
    scorer = toxicity.Scorer(toxicity.train(rows))
    severity = [[scorer(" ".join(w for w, n in c.items() for _ in range(n)))[1] for c, g in rows if g == grade] for grade in range(4)]
    means = [np.mean(s) for s in severity]
    assert means == sorted(means) and all(abs(m - g) < 0.5 for g, m in enumerate(means))


def test_fitted_models_score_odd_rows(spark, odd_docs, words):
    rows = toxic_rows(words, 2)
    docs = spark.createDataFrame([(100 + i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, g, g) for i, (_, g) in enumerate(rows)], LABELS)
    tox, good = toxicity.fit(docs, labels), quality.fit(docs, labels)
    assert "share" not in tox and "share" not in good
    a = [(r["doc_id"], r["score"]) for r in toxicity.with_severity(odd_docs, tox).collect()]
    b = [(r["doc_id"], r["score"]) for r in quality.with_score(odd_docs, good).collect()]
    assert len(a) == len(b) == odd_docs.count() and all(0 <= s <= 1 for _, s in a + b)
    for found in (a, b):
        assert len({s for i, s in found if i in (5, 6)}) == 1  # null and empty texts score alike


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i % 3, f"t{i}") for i in range(60)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)] * 2 + [(2, None, None), (None, 1, 1)], LABELS)
    one, two = (sorted(map(tuple, quality.sampled(docs, labels, "quality", 1, 5).collect())) for _ in range(2))
    assert len(one) == 5 and one == two


def test_suffix_spans(spark, words):
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdef") for _ in range(rng.choice([200, 230, 500]))) for _ in range(4)]
    texts = [" ".join(f"{rng.random()}{rng.choice(passages)}{rng.random()}" for _ in range(rng.randint(1, 3))) for _ in range(12)] + ["x" * 450, None, ""]
    where = Counter(b[i : i + 200] for t in texts if t for b in [t.encode()] for i in range(len(b) - 199))
    want = {}
    for doc, text in enumerate(texts):
        raw = (text or "").encode()
        covered = {i + k for i in range(len(raw) - 199) if where[raw[i : i + 200]] > 1 for k in range(200)}
        want[doc] = (len(raw), len(covered), sum(i in covered and i - 1 not in covered for i in range(len(raw))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix.remove_repeats(docs, 200).collect()} == want
    assert want[12] == (450, 450, 1)


def test_simhash_query_on_the_whole_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t, 4) for i, t in texts.items()}
    rows = queries.op4_simhash(spark, sf).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    label = {i: i for i in prints}
    links = [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["doc_id"]: r["component_id"] for r in rows} == label


@pytest.mark.parametrize("hot", [1000, 3])
def test_hot_keys_of_lookups(spark, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT", hot)
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(90)] + [(200, None)], "id long, key long")
    lookup = rows.groupBy("key").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    got = sorted((r["id"], r["key"], r["top"]) for r in common.join_lookup(rows, common.cut(lookup), "key").collect())
    assert got == [(i, 0 if i % 3 else i, 89 if i % 3 or i == 0 else i) for i in range(90)]


def test_folders(spark, monkeypatch):
    df = common.written(spark.range(5))
    assert df.count() == 5
    common.discard(df)
    with pytest.raises(Exception):
        df.sparkSession.read.parquet(df.inputFiles()[0]).count()

    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    monkeypatch.setattr(common.SparkSession, "sparkContext", Context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpoint_folder(spark)


def test_runs_or_pieces():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    for _ in range(60):
        keys = np.sort(rng.choice([1, 2, 3, 4, 5], rng.integers(1, 60), p=[0.1, 0.6, 0.1, 0.1, 0.1]))
        table = pa.table({"key": keys, "i": np.arange(len(keys))})
        seen, parts = [], {}
        for rows, longer in common.runs_or_pieces(iter(table.to_batches(max_chunksize=int(rng.integers(1, 9)))), "key", 10, 6):
            seen += rows["i"].to_pylist()
            for k in set(rows["key"].to_pylist()):
                parts.setdefault(k, []).append((longer, rows["key"].to_pylist().count(k)))
        assert seen == list(range(len(keys)))
        for k, found in parts.items():
            assert len({longer for longer, _ in found}) == 1 and (found[0][0] or len(found) == 1)
            assert not found[0][0] or sum(n for _, n in found) > 6


def test_suffix_of_frequent_anchors(spark, words, monkeypatch):
    """Anchors taken for frequent are dealt by document; the result is the same."""
    rng = random.Random(10)
    passage, other = (" ".join(rng.choice(words) for _ in range(120)) for _ in range(2))
    texts = [f"{rng.random()} {passage} {rng.random()}" for _ in range(40)] + ["ab" * 400, "ab" * 300] + [f"{rng.random()} {other} x"] * 2 + [" ".join(rng.choice(words) for _ in range(90)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    digest = lambda: {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix.remove_repeats(docs, 200).collect()}
    want = digest()
    plain = {i: (n, k) for (i, _), (k, n) in zip(enumerate(texts), brute_removed([t.encode() for t in texts], 200), strict=True)}
    assert {i: (n, k) for i, (n, _, k) in want.items()} == plain
    every = lambda sample: F.broadcast(sample.select("k").distinct().withColumn("frequent", F.lit(1)))
    monkeypatch.setattr(suffix, "SAMPLE", 1)
    monkeypatch.setattr(suffix, "frequent_anchors", every)
    for salts in (3, 64):
        monkeypatch.setattr(suffix, "SALTS", salts)
        assert digest() == want

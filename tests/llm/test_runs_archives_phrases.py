"""Periodic runs, WARC bundles and collocations against brute force, round trips and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwright.llm import collocations as coll
from sparkwright.llm import periodic, warc
from sparkwright.llm.queries import op11_periodic

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, exponent, shortest):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            s = w[i : i + length]
            if j > i and length >= max(shortest, exponent * q) and not any(s[r:] == s[: length - r] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 7)), max_size=9), st.sampled_from([(2, 2), (3, 3), (4, 6), (2.5, 4)]))
def test_runs_equal_brute_force(blocks, least):
    words = [b"%d" % x for block, times in blocks for x in block * times]
    got = periodic.document_runs([words, [], words[:10]], *least)
    assert got == [brute_runs(words, *least), [], brute_runs(words[:10], *least)]


def test_lyndon_groups_are_lyndon_words():
    rng = random.Random(2)
    for _ in range(300):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 30))]
        ranks = sorted(set(w))
        word = [ranks.index(x) for x in w]
        group, length = periodic.lyndon_groups(word, len(ranks))
        for i in range(len(w)):
            longest = max(n for n in range(1, len(w) - i + 1) if all(w[i : i + n] < w[i + k : i + n] for k in range(1, n)))
            assert length[group[i]] == longest
        for i in range(len(w)):
            for j in range(len(w)):
                same = w[i : i + length[group[i]]] == w[j : j + length[group[j]]]
                assert (group[i] == group[j]) == same


def contract_row(doc_id, text):
    words = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words, 4, 6)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_op11_equals_brute_force_on_odd_documents(spark, tmp_path, words):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " \t\n", "a", "b " * 7, "a b a b a b a b", "x y x y x y x y x y x y", prose(3000), "p q r " * 40 + prose(5) + " u v" * 9, "é 漢 " * 12]
    rows = [(i, texts[i % len(texts)] if i % 3 else prose(rng.randint(0, 60)), "en", [i]) for i in range(60)] + [(None, "k " * 20, "en", []), (None, None, None, None), (4, "b " * 7, "en", [])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, runs array<int>").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(op11_periodic(spark, str(tmp_path)), COLUMNS) == sorted((contract_row(i, t) for i, t, *_ in rows), key=repr)


def test_periodic_runs_keep_columns_and_take_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a a a a a a a", "old", 5)], "doc_id long, text string, runs string, `a.b` int")
    out = periodic.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "a.b", "runs", "collapsed"]
    row = out.first()
    assert [tuple(r) for r in row["runs"]] == [(0, 7, 1)] and row["collapsed"] == "a" and row["a.b"] == 5
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, exponent=1)


BIG = "<p>" + "x" * 1200 + "é</p>"
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (7, "http://b/x y\r\n", BIG), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (8, "u", "漢" * 5000), (None, "u", BIG), (7, "again", BIG), (None, None, "lone" * 400), (9, "u", "Z" * 999), (10, "u", "Z" * 999), (11, "u", "Y" * 1000), (12, "u", "Y" * 1000)]


def expected_pages(rows):
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", i), i, key=lambda x: -1 if x is None else x)
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        to = best[h or ""] if len(b) >= 1000 else None
        to = None if to == i else to
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


ARCHIVE = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("most", [100_000, 0])
def test_archives_round_trip(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc.with_revisits, "__defaults__", (most,))
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write_archive(pages, f"{tmp_path}/bundles", frame_bytes=2000, bundle_bytes=300)
    back = warc.read_archive(index)
    assert rows_of(back, ARCHIVE) == expected_pages(PAGES)
    texts = {(r["page_id"], r["payload"]) for r in back.where("record_type = 'response'").collect()}
    assert texts == {(i, h or "") for i, _, h in PAGES if (i, h) not in {(1, BIG), (2, BIG), (None, BIG), (11, "Y" * 1000)}}
    assert {r["url"] for r in back.where("page_id = 7").collect()} == {"http://b/x%20y%0D%0A", "again"}
    # single records through the index, and the whole bundle by any Zstandard reader
    wanted = spark.createDataFrame([(8,), (12,), (99,), (8,)], "page_id long")
    assert {r["page_id"]: len(r["payload"]) for r in warc.read_records(index, wanted).collect()} == {8: 5000, 12: 1000}
    import io

    import zstandard

    bundles = [r["bundle"] for r in index.select("bundle").distinct().collect()]
    assert len(bundles) > 3
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(b.removeprefix("file://"), "rb").read()), read_across_frames=True).read() for b in bundles)
    assert whole.count(b"WARC/1.1\r\n") == len(PAGES)


def test_archives_of_empty_tables_and_broken_bundles(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(warc.write_archive(none, f"{tmp_path}/none")).count() == 0
    (tmp_path / "x.warc.zst").write_bytes(b"no seek table here")
    with pytest.raises(ValueError):
        warc.BundleReader(f"{tmp_path}/x.warc.zst")


def brute_phrases(rows, least, top):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3, 4):
                for i in range(len(w) - size + 1):
                    key = lang, tuple(w[i : i + size])
                    f[key] = f.get(key, 0) + 1
    out = []
    for lang in n:
        found = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in found.items()):
                continue
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out, key=repr)


PHRASE = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("modulus,bits", [(1, 64), (3, 1 << 20), (1 << 20, 1 << 20)])
def test_collocations_equal_brute_force(spark, modulus, bits):
    rng = random.Random(6)
    vocabulary = ["the", "of", "New", "york", "a b", "é", "x1\x1cy", "漢字", "ST", "-"]
    texts = []
    for _ in range(120):
        pieces = [" ".join(rng.choices(vocabulary, [9, 7, 3, 3, 1, 1, 1, 1, 2, 1], k=rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
        texts.append((rng.choice([". ", "\n", "\t", "; new york of the ", "\x0b", "?"]).join(pieces), rng.choice(["en", "de", None, "und"])))
    texts += [(None, "en"), ("", "en"), (None, None), ("only here", "xx"), ("go on " * 700, "long"), texts[0], texts[0]]
    docs = spark.createDataFrame([(t, lang, 1, "w") for t, lang in texts], "text string, lang string, weight int, chunk string").repartition(3)
    got = rows_of(coll.collocations(docs, least=5, top=40, modulus=modulus, bits=bits), PHRASE)
    assert got == brute_phrases(texts, 5, 40) and len(got) > 60


def test_collocations_sql_and_empty_table(spark, tmp_path):
    con = duckdb.connect()
    documents = pd.DataFrame({"text": ["Of the sea, of the Sea; " * 20, None, "of the\x0bland " * 35], "lang": ["en", None, None]})  # noqa: F841
    con.register("documents", documents)
    want = sorted((tuple(r) for r in con.execute(coll.ORACLE_SQL).fetchall()), key=repr)
    docs = spark.createDataFrame([(t, x if isinstance(x, str) else None) for t, x in zip(["Of the sea, of the Sea; " * 20, None, "of the\x0bland " * 35], ["en", None, None])], "text string, lang string")
    assert rows_of(coll.collocations(docs), PHRASE) == want
    assert coll.collocations(docs.limit(0)).count() == 0


def test_hashes_leave_a_task_packed():
    """Many pairs and triples are a row for each group, and the reader finds those that count up to the threshold, in whatever rows they lie."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    chunks = sorted({" ".join(rng.choices(words, k=rng.randint(1, 9))) + rng.choice(["", " "]) for _ in range(3000)})
    weights = [rng.choice([1, 1, 1, 2, 300, 2**40]) for _ in chunks]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", None] * len(chunks))[: len(chunks)], pa.array(chunks), pa.array(weights, pa.int64())], names=["lang", "chunk", "weight"])
    every = SimpleNamespace(value=np.full(1, 2**64 - 1, np.uint64))
    for groups, least in ((2, 5), (10, 400), (10, 70_000)):
        want = Counter()
        for lang, part in coll._parts(iter([batch]), 10**9):
            for n, h in ((2, part.pair), (3, part.triple)):
                at = np.flatnonzero(part.counts & (part.room >= n))
                for key, w in zip((h[at] >> np.uint64(32 - groups)).tolist(), part.weight[at].tolist(), strict=True):
                    want[key] += w
        for most in (3000, 10**6):
            packed = pa.Table.from_batches(coll._hash_counter(every, groups, least, 5_000, most)(iter([batch]))).sort_by("part")
            assert packed.num_rows <= 1 << groups or most == 3000
            found = [h for b in coll._frequent_keys(least)(iter(packed.to_batches(max_chunksize=7))) for h in b.column("h").to_pylist()]
            assert sorted(found) == sorted(k for k, w in want.items() if w >= least) and found


def test_scores_pass_64_bits(spark):
    """Counts near 2^62 through the exact arithmetic: one chunk with a huge weight."""
    rows = [("en", False, "a b", 4 * 10**18), ("en", False, "a", 10**18), ("en", True, "a", 5 * 10**18), ("en", True, "b", 4 * 10**18)]
    chunks = spark.createDataFrame(rows, "lang string, word boolean, chunk string, weight long")
    got = coll.rank_phrases(*coll.phrase_counts(chunks, 30, 64), top=5, covered=80).first()
    # n itself, 9 * 10^18, still fits a long
    assert got["n"] == 9 * 10**18 and (got["a"], got["l"], got["r"], got["score"]) == (4 * 10**18, 5 * 10**18, 4 * 10**18, 2_000_000 * 4 // 9)

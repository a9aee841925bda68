"""The pipeline against a version in plain Python and SQL, stage by stage."""

import hashlib
from collections import Counter

import duckdb
import pandas as pd
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sparkwright.llm import linededup, mixing, quality, queries


def plain_lines(rows):
    """Line dedup in plain Python, over (doc_id, text)."""
    chunks = []
    for doc, text in sorted(rows):
        lines, hashes, start = text.split("\n"), [], 0
        for i, line in enumerate(lines):
            hashes.append(int(hashlib.md5(line.encode()).hexdigest()[:8], 16))
            rolled = sum(linededup.FACTOR**k * hashes[i - k] for k in range(linededup.ROLL) if i >= k)
            if rolled % linededup.MODULUS % linededup.MEAN_LINES == 0 or i == len(lines) - 1:
                chunks.append((doc, lines[start : i + 1]))
                start = i + 1
    seen, left = set(), {}
    for doc, lines in chunks:
        left.setdefault(doc, [])
        body = "\n".join(lines)
        if len(lines) > 1 and body in seen:
            continue
        if len(lines) > 1:
            seen.add(body)
        left[doc] += lines
    return {doc: "\n".join(lines) for doc, lines in left.items()}


def plain_shingles(text, n):
    """The n-word shingles of a text in order, A-Z lower-cased; the whole sequence if it has fewer words."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    return [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def plain_fingerprint(shingles):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def exact_groups(texts):
    """The smallest id of each near-duplicate group: links of fingerprints within 4 bits, and of sets of shingles whose Jaccard
    similarity is 0.8 or more, all pairs compared."""
    lists = {i: plain_shingles(t, 5) for i, t in texts.items()}
    prints, sets = {i: plain_fingerprint(x) for i, x in lists.items()}, {i: set(x) for i, x in lists.items()}
    label = {i: i for i in texts}

    def near(a, b):
        common = len(sets[a] & sets[b])
        return (prints[a] ^ prints[b]).bit_count() <= 4 or 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common)

    links = [(a, b) for a in texts for b in texts if a < b and near(a, b)]
    for _ in texts:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_pipeline(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    adds = [] if "share" in model else quality.tables(model)
    rows = docs.toPandas()
    score = [model["share"] if "share" in model else quality.score(model, adds, (t or "").encode()) for t in rows["text"]]
    rows = rows[[s >= 0.5 for s in score]].copy()
    left = plain_lines(list(zip(rows["doc_id"], rows["text"], strict=True)))
    rows["text"] = rows["doc_id"].map(left)
    group = exact_groups(left)
    documents = rows[[group[i] == i for i in rows["doc_id"]]]
    con = duckdb.connect()
    con.register("documents", documents)
    taken = con.sql(mixing.ORACLE_SQL).df()
    own = Tokenizer.from_file(queries.vocabulary_path())
    digest = {i: hashlib.sha256(",".join(map(str, own.encode(left[i], add_special_tokens=False).ids)).encode()).hexdigest() for i in set(taken["doc_id"])}
    want = Counter((i, digest[i]) for i in taken["doc_id"])
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert Counter(zip(got["doc_id"], got["ids_sha256"], strict=True)) == want
    assert isinstance(got, pd.DataFrame) and {"doc_id", "lang", "source", "n_tokens", "decoded_sha256"} <= set(got.columns)


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_stages_on_odd_and_empty_tables(spark, sf, odd_docs):
    for docs in (odd_docs, odd_docs.limit(0)):
        docs = docs.withColumn("fp", F.lit(1)).withColumn("root", F.lit("x"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            assert name == "bpe_tokens" or out.columns == docs.columns
            assert len(rows) <= 3 * odd_docs.count() and {r["root"] for r in rows} <= {"x"}

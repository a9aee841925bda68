"""Line dedup by content-defined chunks, with DataFrame functions only.

Every line gets a hash, a rolling hash runs over the hashes of ROLL lines, and a chunk ends after a line whose rolling hash
is 0 modulo `mean_lines` (and at the end of the text). Inserted or deleted lines therefore move no boundary but those beside
them. Of the chunks of two lines or more that occur at several places of the corpus, the first (smallest doc_id, then
smallest place) stays and the others are removed, once their bytes have been compared with the first's.

Scale. Chunk keys, not texts, are aggregated (with map-side combine) and joined. Keys with over one HOT-th of all repeated
chunks are fewer than HOT, so their first places are broadcast and their rows are not dealt by key; for the comparison of bytes
they are dealt by key and SALTS salts. Texts are shuffled by row identity, for the comparison and for the removal; only the
bytes of chunks that occur more than once are shuffled again. Work is linear in the lines of a text.

Defined cases: a null text stays null and an empty one empty; a row is known by its doc_id and a hash of its text, so rows
that share a doc_id (or have none) are documents of their own, in the order of that hash; of rows equal in both the first
keeps first occurrences and the others are later ones; a null doc_id comes after all others; lines that are removed take
their line end with them; a text of which all is removed becomes empty, and its row stays; columns of any other name are kept
as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.common import cut

ROLL, FACTOR, MODULUS, MEAN_LINES = 3, 31, 1_000_003, 4
HOT, SALTS = 1000, 64
COUNTS = ("_lines", "_removed_lines")


def _let(name: str, value: str, then: str) -> str:
    """SQL for the array `then`, in which `name` stands for the value; a lambda binds it, so it is made once."""
    return f"flatten(transform(array({value}), {name} -> {then}))"


LINES = "split(text, '\n', -1)"


def chunk_column(mean_lines: int = MEAN_LINES):
    """array<struct<start int, n int, key binary>> of the multi-line chunks of column `text`; start counts lines from 1."""
    hashed = "transform(ls, l -> cast(conv(substring(md5(cast(l as binary)), 1, 8), 16, 10) as bigint))"
    rolled = " + ".join(f"{FACTOR**k} * if(i > {k}, h[i - {k + 1}], 0L)" for k in range(ROLL))
    ends = f"filter(sequence(1, size(h)), i -> i = size(h) or ({rolled}) % {MODULUS} % {mean_lines} = 0)"
    spans = "transform(e, (x, k) -> struct(if(k = 0, 1, e[k - 1] + 1) as start, x - if(k = 0, 0, e[k - 1]) as n))"
    key = "unhex(md5(cast(array_join(slice(ls, s.start, s.n), '\n') as binary)))"
    keyed = f"transform(filter({spans}, s -> s.n > 1), s -> struct(s.start as start, s.n as n, {key} as key))"
    return F.expr(_let("ls", LINES, _let("h", hashed, _let("e", ends, keyed))))


def kept_lines():
    """The lines of `text` outside of the line ranges `gone`, as slices between them."""
    start = "if(k = 0, 1, g[k - 1].start + g[k - 1].n)"
    slices = f"flatten(transform(sequence(0, size(g)), k -> slice(ls, {start}, if(k = size(g), size(ls) + 1, g[k].start) - {start})))"
    return F.expr(_let("ls", LINES, _let("g", "array_sort(gone)", slices)))


def numbered(rows: DataFrame, row: list[str]) -> DataFrame:
    """rows with nth, from 1 for each of the rows that are equal in `row`."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*row).orderBy(*row)))


def _stripped(docs: DataFrame, mean_lines: int) -> DataFrame:
    """The columns of docs as c0, c1, ... with stripped texts, and n_lines and n_removed."""
    some = F.col("text").contains("\n")
    text = F.col("text").cast("string")
    doc = F.col("doc_id").cast("long")
    # a row is known by none (whether its id is null), doc and tag (a hash of its text)
    row = ["none", "doc", "tag"]
    known = [doc.isNull().alias("none"), F.coalesce(doc, F.lit(0).cast("long")).alias("doc"), F.xxhash64(text).alias("tag")]
    own = docs.select(*known, text.alias("text"))
    found = cut(own.where(some).select(*row, F.inline(chunk_column(mean_lines))))
    place = F.struct(*row, "start")
    firsts = cut(found.groupBy("key").agg(F.min(F.struct(place.alias("place"), "n")).alias("first"), F.count("*").alias("times")).where("times > 1"))
    total = firsts.agg(F.sum("times")).first()[0] or 0  # one number
    firsts = firsts.select("key", "first", (F.col("times") > total / HOT).alias("hot"))
    hot = F.broadcast(firsts.where("hot"))  # fewer than HOT rows
    joined = found.join(hot, "key").unionByName(found.join(hot.select("key"), "key", "left_anti").join(firsts.where("not hot"), "key"))
    later = joined.where(place != F.col("first.place")).select("key", *row, "start", "n", "hot", F.lit(False).alias("is_first"))
    heads = firsts.select("key", "first.place.*", F.col("first.n").alias("n"), "hot", F.lit(True).alias("is_first"))
    wanted = later.unionByName(heads).groupBy(*row).agg(F.collect_set(F.struct("key", "start", "n", "hot", "is_first")).alias("w"))
    # of equal rows one is read for the comparison
    texts = numbered(own.where(some), row).where("nth = 1").join(wanted, row)
    piece = "struct(c.key, c.start, c.n, c.hot, c.is_first, array_join(slice(ls, c.start, c.n), '\n') as bytes)"
    texts = texts.select(*row, F.inline(F.expr(_let("ls", LINES, f"transform(w, c -> {piece})"))))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    head = texts.where("is_first").select("key", F.explode(salts).alias("salt"), F.col("bytes").alias("head"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*row, "start"), F.lit(SALTS)).cast("int")).otherwise(0)
    same = texts.where("not is_first").withColumn("salt", salt).join(head, ["key", "salt"]).where("bytes = head").select(*row, "start", "n", "is_first")
    # a first occurrence goes from the second and later ones of equal rows
    gone = same.unionByName(heads.select(*same.columns)).groupBy(*row).agg(F.collect_set(F.struct("start", "n", "is_first")).alias("all_gone"))
    new = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    full = numbered(docs.select(*known, text.alias("text"), *new), row).join(gone, row, "left")
    full = full.withColumn("gone", F.expr("filter(all_gone, g -> nth > 1 or not g.is_first)"))
    full = full.withColumn("gone", F.when(F.size("gone") > 0, F.col("gone")))
    full = full.withColumn("left", F.when(F.col("gone").isNotNull(), kept_lines()))
    whole = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join("left", "\n"))
    total_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.expr(LINES))).cast("long")
    full = full.withColumn("whole", whole).withColumn("n_lines", total_lines)
    picked = []
    for i, c in enumerate(docs.columns):
        value = F.col(f"c{i}")
        if c == "text":
            value = F.col("whole")
        elif c == "n_chars":
            value = F.when(F.col("gone").isNull(), value).otherwise(F.length("whole").cast(docs.schema[c].dataType))
        picked.append(value.alias(f"c{i}"))
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("left")).cast("long")
    return full.select(*picked, "n_lines", removed.alias("n_removed"))


def remove_repeated_chunks(docs: DataFrame, mean_lines: int = MEAN_LINES) -> DataFrame:
    """docs with text stripped of repeated chunks, and two more columns, _lines and _removed_lines, as longs; columns of docs
    with these names are replaced."""
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in COUNTS]
    return _stripped(docs, mean_lines).select(*own, F.col("n_lines").alias(COUNTS[0]), F.col("n_removed").alias(COUNTS[1]))


def dedup_lines(docs: DataFrame, mean_lines: int = MEAN_LINES) -> DataFrame:
    """docs, each with the text that is left; n_chars follows it."""
    return _stripped(docs, mean_lines).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


ORACLE_SQL = f"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS total FROM split),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines),
rolled AS (SELECT *, (h + {FACTOR} * coalesce(lag(h, 1) OVER w, 0) + {FACTOR**2} * coalesce(lag(h, 2) OVER w, 0)) % {MODULUS} % {MEAN_LINES} = 0 AS ends
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM rolled),
chunks AS (SELECT doc_id, c, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS bytes FROM numbered GROUP BY doc_id, c HAVING count(*) > 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, start) AS r FROM chunks),
kept AS (SELECT l.doc_id, l.total, l.i, l.line FROM numbered l LEFT JOIN ranked k ON l.doc_id = k.doc_id AND l.c = k.c WHERE coalesce(k.r, 1) = 1),
joined AS (SELECT doc_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY i) AS whole FROM kept GROUP BY doc_id)
SELECT s.doc_id, coalesce(len(s.ls), 0)::BIGINT AS n_lines, (coalesce(len(s.ls), 0) - coalesce(j.n_kept, 0))::BIGINT AS n_removed_lines,
  sha256(CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(j.whole, '') END) AS kept_sha256
FROM split s LEFT JOIN joined j ON s.doc_id = j.doc_id
"""

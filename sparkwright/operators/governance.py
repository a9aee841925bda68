"""Publication: scrubbing of rows, allowlists of paths, identifier scans and audits; guards for uploads and chats."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scrub(rows: DataFrame, drop: list[str], open_sources: list[str], private_name: str = "private") -> DataFrame:
    """rows without the dropped columns; rows from other than open sources lose their id and source; labels between double
    underscores go."""
    is_open = F.col("source").isin(open_sources)
    out = rows.drop(*drop)
    changed = {"source": F.when(is_open, F.col("source")).otherwise(F.lit(private_name)), "id": F.when(is_open, F.col("id")), "labels": F.filter("labels", lambda x: ~x.rlike("^__.*__$"))}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in out.columns])


def unexpected_columns(rows: DataFrame, keep: list[str], drop: list[str]) -> list[str]:
    return sorted(set(rows.columns) - set(keep) - set(drop))


def source_class(source: Column, table: dict[str, str], strict: bool = False) -> Column:
    """open, mimic or private by name; unknown otherwise, an error in strict mode."""
    out = F.coalesce(*[F.when(F.lower(source) == k, F.lit(v)) for k, v in table.items()])
    return F.coalesce(out, F.raise_error(F.concat(F.lit("unknown source: "), source)).cast("string") if strict else F.lit("unknown"))


def path_allowed(path: Column, allowed: list[str], denied: list[str]) -> Column:
    """Allowed by the first part of the path; denied if any of `denied` is in it."""
    refused = F.lit(False)
    for part in denied:
        refused = refused | F.contains(F.lower(path), F.lit(part.lower()))
    return F.split(path, "/")[0].isin(allowed) & ~refused


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


#: What looks like a person's data in a header line.
IDENTIFIER = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b\d{3}-\d{2}-\d{4}\b|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"


def identifier_lines(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(key, line) of the lines that hold an identifier; lines count from 1."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return lines.where(F.col("line").rlike(IDENTIFIER)).select(key, (F.col("i") + 1).alias("line"))


def audit(violations: list[tuple[str, DataFrame]], cap: int = 20) -> DataFrame:
    """(rule, key) of the first `cap` problems and, if there are more, one row that says so: the report is the feature."""
    out = None
    for rule, rows in violations:
        one = rows.select(F.lit(rule).alias("rule"), F.col(rows.columns[0]).cast("string").alias("key"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("rule", "key").limit(cap + 1)


def generic_counts(rows: DataFrame, counts: str, private: list[str], name: str = "private") -> DataFrame:
    """rows whose map column `counts` has private keys folded into one, their numbers summed."""
    fold = lambda k: F.when(k.isin(private), F.lit(name)).otherwise(k)
    keys = F.array_distinct(F.transform(F.map_keys(counts), fold))
    total = lambda k: F.aggregate(F.filter(F.map_entries(counts), lambda e: fold(e["key"]) == k), F.lit(0).cast("long"), lambda s, e: s + e["value"])
    return rows.withColumn(counts, F.map_from_arrays(keys, F.transform(keys, total)))


def signal_valid(leads: Column, rate: Column, seconds: Column) -> Column:
    return F.coalesce((leads == 12) & rate.between(50, 2000) & seconds.between(2, 120), F.lit(False))


def chat_guard(rows: DataFrame, roles: list[str], most: int = 8000) -> DataFrame:
    """Messages of the allowed roles with trimmed, not empty text, cut to `most` characters (the limit is the feature)."""
    text = F.substring(F.trim("text"), 1, most)
    return rows.where(F.col("role").isin(roles)).withColumn("text", text).where(F.col("text") != "")


def split_think(text: Column) -> tuple[Column, Column]:
    """(answer, thoughts): what stands outside and inside of <think> elements; an open one runs to the end."""
    pattern = r"(?s)<think>(.*?)(?:</think>|\z)"
    inside = F.array_join(F.regexp_extract_all(text, F.lit(pattern), 1), "")
    return F.regexp_replace(text, pattern, ""), inside


def thin_samples(samples: Column, digits: int = 4) -> Column:
    return F.transform(samples, lambda x: F.round(x, digits))


TAGS = ("<think>", "</think>")
#: What divides a text at its tags and keeps them, and the largest part of a tag that a chunk can lack.
_AROUND, _REACH = "(?<=<think>)|(?<=</think>)|(?=<think>)|(?=</think>)", len(TAGS[1]) - 1


def split_think_chunks(chunks: DataFrame, key: str = "key", seq: str = "seq", text: str = "text") -> DataFrame:
    """(key, seq, answer, thought) of each chunk of a text that comes in pieces, where tags may be cut between chunks.

    Which characters are tags needs the seven characters that follow a chunk at most; what a chunk is in depends on the last tag before it
    alone, as an opening tag inside of a thought and a closing one outside of it are text. Both are windows over a key's chunks in
    order, so no text is put together; each chunk is then folded over its own pieces. An open thought runs to the end; a part
    of a tag at the end is text. Null and empty chunks give no row.
    """
    order = Window.partitionBy("k").orderBy("s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.select(F.col(key).alias("k"), F.col(seq).alias("s"), F.col(text).alias("t")).where("length(t) > 0")
    heads = F.collect_list(F.substring("t", 1, _REACH)).over(order.rowsBetween(1, _REACH))
    rows = rows.withColumn("head", F.substring(F.array_join(heads, ""), 1, _REACH))
    found = F.regexp_extract_all(F.concat("t", "head"), F.lit("</?think>"), 0)
    found = F.when(F.col("head") == TAGS[0], F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)  # it begins behind the chunk
    cut = F.coalesce(
        *[F.when(F.endswith("t", F.lit(tag[:n])) & F.startswith("head", F.lit(tag[n:])), F.lit(len(tag) - n)) for tag in TAGS for n in range(len(tag) - 1, 0, -1)], F.lit(0)
    )
    rows = rows.withColumn("found", found).withColumn("size", F.length("t")).withColumn("off", F.coalesce(F.sum("size").over(before), F.lit(0)))
    rows = rows.withColumn("last", F.try_element_at("found", F.lit(-1))).withColumn("state", F.coalesce(F.last("last", True).over(before), F.lit(TAGS[1])))
    # The tag that ends a chunk may reach into the next ones: where it ends, and what was before it.
    own = F.when(F.size("found") > 0, F.struct((F.col("off") + F.col("size") + cut).alias("end"), F.coalesce(F.try_element_at("found", F.lit(-2)), F.col("state")).alias("prior"), F.col("last").alias("tag")))
    rows = rows.withColumn("own", own).withColumn("carry", F.last("own", True).over(before))
    skip = F.least(F.col("size"), F.greatest(F.coalesce(F.col("carry.end") - F.col("off"), F.lit(0)), F.lit(0)).cast("int"))
    rows = rows.withColumn("skip", skip)
    held = F.when(F.col("carry.prior") == F.col("carry.tag"), F.expr("substring(t, 1, skip)")).otherwise("")  # no tag after all
    pieces = F.split(F.concat(F.expr("substring(t, skip + 1)"), "head"), _AROUND)
    start = F.struct(F.col("skip").alias("at"), F.col("state").alias("state"), F.when(F.col("state") == TAGS[1], held).otherwise("").alias("answer"), F.when(F.col("state") == TAGS[0], held).otherwise("").alias("thought"))

    def fold(acc: Column, piece: Column) -> Column:
        tag = piece.isin(*TAGS) & (piece != acc["state"]) & (acc["at"] < F.col("size"))
        shown = F.when(tag, "").otherwise(F.substring(piece, F.lit(1), F.greatest(F.col("size") - acc["at"], F.lit(0))))
        seen = piece.isin(*TAGS) & (acc["at"] < F.col("size"))
        return F.struct(
            (acc["at"] + F.length(piece)).alias("at"), F.when(seen, piece).otherwise(acc["state"]).alias("state"),
            F.concat(acc["answer"], F.when(acc["state"] == TAGS[1], shown).otherwise("")).alias("answer"), F.concat(acc["thought"], F.when(acc["state"] == TAGS[0], shown).otherwise("")).alias("thought"),
        )

    out = rows.withColumn("r", F.aggregate(pieces, start, fold))
    return out.select(F.col("k").alias(key), F.col("s").alias(seq), "r.answer", "r.thought")


#: Keys whose maps or lists name sources, at any depth.
SOURCE_MAPS, SOURCE_LISTS = ("pos_by_source", "neg_by_source"), ("train_sources", "excluded_train_sources", "sources")


def _generic(node, private: frozenset[str], name: str, hits: list[int]):
    if isinstance(node, list):
        return [_generic(v, private, name, hits) for v in node]
    if isinstance(node, str) and node in private:
        hits[2] += 1
        return name
    if not isinstance(node, dict):
        return node
    out = {}
    for key, value in node.items():
        if key in SOURCE_MAPS and isinstance(value, dict):
            own = [v for k, v in value.items() if k in private]
            hits[0] += len(own)
            value = {k: v for k, v in value.items() if k not in private}
            if own:
                value[name] = value.get(name, 0) + sum(v for v in own if isinstance(v, (int, float)))
        elif key in SOURCE_LISTS and isinstance(value, list):
            gone = [v for v in value if isinstance(v, str) and v in private]
            hits[1] += len(gone)
            kept: list = []
            for v in value:
                if v not in gone:
                    kept.append(v)
                elif name not in kept:
                    kept.append(name)
            value = kept
        else:
            value = _generic(value, private, name, hits)
        out[key] = value
    return out


def generic_json(rows: DataFrame, column: str, private: list[str], name: str = "private") -> DataFrame:
    """rows with `column`, JSON of any shape, without private sources, and how often maps, lists and single values named one (`map_hits`,
    `list_hits`, `value_hits`).

    In maps under a key of SOURCE_MAPS the private keys become one, their numbers summed; in lists under SOURCE_LISTS they become one
    entry; elsewhere a value that is a private name becomes `name`, at any depth. A document is a row: a map over Arrow batches.
    Null stays null; text that is no JSON is an error, as it can't be told what it names.
    """
    own, at = frozenset(private), rows.columns.index(column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", map_hits int, list_hits int, value_hits int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(at).to_pylist():
                hits = [0, 0, 0]
                texts.append(None if text is None else json.dumps(_generic(json.loads(text), own, name, hits), ensure_ascii=False, separators=(",", ":")))
                counts.append(hits)
            arrays = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([h[k] for h in counts], pa.int32()) for k in range(3))], names=[*batch.schema.names, "map_hits", "list_hits", "value_hits"])

    return rows.mapInArrow(run, schema)


def file_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, bytes) of the files below a folder, path relative to it, as a relation: Spark lists the folder, and as no content column is
    asked for, none is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rpartition("://")[2].removeprefix("file:").rstrip("/")
    return files.select(F.substring_index("path", base + "/", -1).alias("path"), F.col("length").alias("bytes"))


def resolve_files(records: DataFrame, index: DataFrame, files: DataFrame, marker: str, allowed: dict[str, list[str]], denied: list[str]) -> DataFrame:
    """(id, source, path, state, bytes) of each record (id, source) by an index (id, path) and a listing (path, bytes).

    States: `not in path index`; `outside`: no folder named `marker` (any case), below which paths are relative; `denylisted`: a part of
    `denied` in the path; `outside allowlist` of the source (by the first folder); `files absent`: no header or neither signal (.mat, else
    .dat); `ok`, with the bytes of header and signal. Of an id's paths in the index the largest counts; a record that repeats gives a row each.
    """
    paths = index.groupBy("id").agg(F.max("path").alias("raw"))
    both = records.select("id", "source").join(paths, "id", "left")
    parts = F.split(F.replace(F.col("raw"), F.lit("\\"), F.lit("/")), "/")
    place = F.array_position(F.transform(parts, F.lower), F.lit(marker.lower())).cast("int")
    rel = F.when(place > 0, F.array_join(F.slice(parts, place + 1, F.size(parts)), "/"))
    both = both.withColumn("path", rel).withColumn("stem", F.regexp_replace("path", r"\.[^./]*$", ""))
    kinds = files.withColumn("stem", F.regexp_replace("path", r"\.[^./]*$", "")).groupBy("stem").agg(
        *[F.max(F.when(F.endswith("path", F.lit(f".{kind}")), F.col("bytes"))).alias(kind) for kind in ("hea", "mat", "dat")]
    )
    both = both.join(kinds, "stem", "left").withColumn("signal", F.coalesce("mat", "dat"))
    refused = F.lit(False)
    for word in denied:
        refused = refused | F.contains(F.lower("path"), F.lit(word.lower()))
    first = F.element_at(F.split("path", "/"), 1)
    fits = F.coalesce(*[F.when(F.col("source") == s, first.isin(names)) for s, names in allowed.items()], F.lit(False))
    state = (
        F.when(F.col("raw").isNull() | (F.col("raw") == ""), "not in path index").when(F.col("path").isNull(), "outside").when(refused, "denylisted")
        .when(~fits, "outside allowlist").when(F.col("hea").isNull() | F.col("signal").isNull(), "files absent").otherwise("ok")
    )
    return both.withColumn("state", state).select("id", "source", "path", "state", F.when(F.col("state") == "ok", F.col("hea") + F.col("signal")).alias("bytes"))

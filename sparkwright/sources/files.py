"""Sources and sinks: JSON lines, manifests, header-and-matrix recordings, lead tables, reports and exports.

Readers are Spark's own wherever a format allows; binary recordings come through the binaryFile source, so paths that only
Spark can open work as well. Writers go to a staging path and swap, so a failed write leaves the old data.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkwright.functions.signals import LEADS

#: Limits of an upload.
SUFFIXES, MOST_FILES, MOST_BYTES = (".hea", ".mat", ".dat", ".csv"), 4, 64 * 1024 * 1024
ALIASES = {"avr": "aVR", "avl": "aVL", "avf": "aVF"} | {x.lower(): x for x in LEADS if x[0] in "IV"}


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_manifest(spark: SparkSession, path: str, key: str = "recording_id") -> DataFrame:
    """A CSV manifest by key: blank keys go, and of repeated keys the last line of the (sorted) files stays."""
    rows = spark.read.option("header", True).csv(path)
    place = F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    rest = [c for c in rows.columns if c != key]
    packed = rows.withColumn("_p", place).where(F.trim(key) != "").groupBy(key).agg(F.max_by(F.struct(*rest), "_p").alias("r"))
    return packed.select(key, "r.*")


def read_map_of_lists(spark: SparkSession, path: str) -> DataFrame:
    """(id, i, line) of a JSON document {id: [line, ...]}."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("id", "lines"))
    return entries.select("id", F.posexplode("lines").alias("i", "line"))


_DOCUMENTS: dict[str, tuple[int, DataFrame]] = {}
#: Documents that are kept in memory at once; the one not asked for longest goes first.
MOST_DOCUMENTS = 8


def cached_document(spark: SparkSession, path: str) -> DataFrame:
    """read_map_of_lists, kept in memory by Spark until the file's time of change is another."""
    changed = _status(spark, path).getModificationTime()
    held = _DOCUMENTS.pop(path, None)
    if held is None or held[0] != changed or held[1].sparkSession is not spark:
        _forget(spark, held)
        held = (changed, read_map_of_lists(spark, path).cache())
    _DOCUMENTS[path] = held
    while len(_DOCUMENTS) > MOST_DOCUMENTS:
        _forget(spark, _DOCUMENTS.pop(next(iter(_DOCUMENTS))))
    return held[1]


def _forget(spark: SparkSession, held: tuple[int, DataFrame] | None) -> None:
    if held is not None and held[1].sparkSession is spark:
        held[1].unpersist()


def _status(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, values) of matrix files wherever Spark can open them; a file (2 GB at most) is one task. For larger ones on
    mounted storage there is the npy data source, which reads by ranges of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                matrix = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                matrix = matrix.reshape(len(matrix), -1).astype(float)
                for at in range(0, len(matrix), 65_536):
                    part = matrix[at : at + 65_536]
                    yield pd.DataFrame({"path": name, "idx": np.arange(at, at + len(part)), "values": list(part)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, idx bigint, values array<double>")


def copy_tables(spark: SparkSession, names: list[str], source: str, target: str) -> None:
    """Copy Parquet tables of these names as they are."""
    for name in names:
        spark.read.parquet(f"{source}/{name}").write.mode("overwrite").parquet(f"{target}/{name}")


class _Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class _NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[InputPartition]:
        n = np.load(self.path, mmap_mode="r").shape[0]
        return [_Rows(a, min(n, a + self.rows)) for a in range(0, n, self.rows)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        matrix = np.load(self.path, mmap_mode="r")
        for i in range(partition.start, partition.stop):
            yield (i, [float(x) for x in np.atleast_1d(matrix[i])])


class NpySource(DataSource):
    """spark.read.format("npy").load(path): (idx, values) of a matrix file on shared storage, partitioned by ranges of rows."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "idx bigint, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options["path"], int(self.options.get("rowsPerPartition", 65_536)))


def discover_recordings(spark: SparkSession, path: str) -> DataFrame:
    """(stem, base, hea, mat) of records that have both a header and a matrix; base is the path without its suffix, as folders
    may hold records of one name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{hea,mat}").load(path).select("path")
    named = files.select("path", *_names(), F.regexp_extract("path", r"\.(hea|mat)$", 1).alias("kind"))
    return named.groupBy("stem", "base").pivot("kind", ["hea", "mat"]).agg(F.max("path")).where("hea is not null and mat is not null")


def _names() -> list:
    return [F.regexp_extract("path", r"([^/]+)\.(hea|mat)$", 1).alias("stem"), F.regexp_replace("path", r"\.(hea|mat)$", "").alias("base")]


def header_comments(headers: DataFrame, text: str = "text") -> DataFrame:
    """headers with age, sex and codes from comment lines such as #Age: 63."""
    field = lambda n: F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^#\s*{n}:?\s*(.*)$", 1)), F.lit(""))
    codes = F.filter(F.split(F.coalesce(field("Dx"), F.lit("")), r"\s*,\s*"), lambda x: x != "")
    return headers.withColumns({"age": F.expr("try_cast(age_text as double)") if "age_text" in headers.columns else F.expr(f"try_cast(nullif(trim(regexp_extract({text}, '(?im)^#\\\\s*Age:?\\\\s*(.*)$', 1)), '') as double)"), "sex": F.lower(field("Sex")), "codes": codes})


def repair_date(line):
    """A header line whose date has the parts in ISO order, or other marks, in the form day/month/year."""
    iso = F.regexp_replace(line, r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b", "$3/$2/$1")
    return F.regexp_replace(iso, r"\b(\d{1,2})[-.](\d{1,2})[-.](\d{4})\b", "$1/$2/$3")


def referenced_files(text):
    """Files that a header's signal lines name, without repeats."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: (x != "") & ~x.startswith("#"))
    return F.array_distinct(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.split(x, r"\s+")[0]))


def header_problems(text, names):
    """What is wrong with a header: array of no header line, fewer signal lines than it says, files that it names and `names`
    (an array) lacks, and paths in them."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    said = F.try_element_at(F.split(F.try_element_at(lines, F.lit(1)), r"\s+"), F.lit(2)).try_cast("int")
    files = referenced_files(text)
    missing = F.filter(files, lambda f: ~F.array_contains(names, f))
    return F.array_compact(F.array(
        F.when(said.isNull(), "no header line"), F.when(F.size(lines) - 1 < said, "signal lines are missing"),
        F.when(F.size(missing) > 0, F.concat(F.lit("files are missing: "), F.array_join(F.array_sort(missing), ", "))),
        F.when(F.exists(files, lambda f: f.contains("/") | f.contains("\\")), "a path in a file name"),
    ))


def lead_name(raw):
    """The standard name of a lead, from any case and the forms LEAD II and MDC_ECG_LEAD_II; others stay."""
    key = F.regexp_replace(F.upper(F.trim(raw)), r"^(LEAD |MDC_ECG_LEAD_)", "")
    known = F.create_map(*[F.lit(x) for k, v in ALIASES.items() for x in (k.upper(), v)])
    return F.coalesce(F.try_element_at(known, key), F.trim(raw))


def parse_recording(header: str, data: bytes) -> tuple[float, dict[str, np.ndarray]]:
    """Sampling rate and leads (in physical units, not finite values as 0) of a header and its 16-bit matrix."""
    lines = [x.split() for x in header.splitlines() if x.strip() and not x.startswith("#")]
    n, rate = int(lines[0][1]), float(re.split(r"[/(]", lines[0][2])[0]) if len(lines[0]) > 2 else 250.0
    offset = int(lines[1][1].partition("+")[2] or 0)
    raw = np.frombuffer(data, "<i2", offset=offset)
    raw = raw[: len(raw) // n * n].reshape(-1, n).astype(float)
    leads = {}
    for k, parts in enumerate(lines[1 : n + 1]):
        gain = re.match(r"([\d.eE+-]+)(?:\(([-\d]+)\))?", parts[2])
        scale, base = float(gain[1]) or 200.0, float(gain[2] or (parts[4] if len(parts) > 4 else 0))
        leads[ALIASES.get(parts[-1].lower(), parts[-1])] = np.nan_to_num((raw[:, k] - base) / scale, posinf=0.0, neginf=0.0)
    return rate, leads


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """(stem, base, fs, leads array<array<double>>) in standard lead order; a lead that is missing is empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{hea,mat}").load(path)
    parts = files.select(*_names(), F.col("path").endswith(".hea").alias("is_head"), "content")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        head, data = group[group["is_head"]], group[~group["is_head"]]
        if head.empty or data.empty:
            return pd.DataFrame(columns=["stem", "base", "fs", "leads"], dtype=object)
        rate, leads = parse_recording(bytes(head["content"].iloc[0]).decode("utf-8", "replace"), bytes(data["content"].iloc[0]))
        return pd.DataFrame([{"stem": group["stem"].iloc[0], "base": group["base"].iloc[0], "fs": rate, "leads": [leads.get(x, np.empty(0)).tolist() for x in LEADS]}])

    return parts.groupBy("base").applyInPandas(run, "stem string, base string, fs double, leads array<array<double>>")


def read_lead_table(spark: SparkSession, path: str) -> DataFrame:
    """Samples of twelve leads from a CSV with a header, in any order and case of names; blank rows are skipped."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    named = {ALIASES.get(c.strip().lower(), c.strip()): c for c in rows.columns}
    missing = [x for x in LEADS if x not in named]
    if missing:
        raise ValueError(f"missing leads: {', '.join(missing)}")
    return rows.dropna("all").select(*[F.col(f"`{named[x]}`").cast("double").alias(x) for x in LEADS])


def check_upload(files: list[tuple[str, int]]) -> list[str]:
    """What is wrong with the names and sizes of an upload."""
    names = [re.sub(r"[^A-Za-z0-9._-]", "_", n.replace("\\", "/").rsplit("/", 1)[-1]) for n, _ in files]
    wrong = [] if files else ["no files"]
    if len(files) > MOST_FILES:
        wrong.append(f"more than {MOST_FILES} files")
    wrong += [f"suffix of {n} is not allowed" for n in names if not n.lower().endswith(SUFFIXES)]
    wrong += [f"{n} comes twice" for n in sorted({n for n in names if names.count(n) > 1})]
    if sum(size for _, size in files) > MOST_BYTES:
        wrong.append("too many bytes")
    return wrong


def swap_json(df: DataFrame, path: str) -> None:
    """Write JSON lines beside path, keep what was there once as path.bak, and put the new data in its place."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    fs.delete(at(f"{path}.new"), True)
    df.write.json(f"{path}.new")
    if fs.exists(at(path)):
        if fs.exists(at(f"{path}.bak")):
            fs.delete(at(path), True)
        else:
            fs.rename(at(path), at(f"{path}.bak"))
    fs.rename(at(f"{path}.new"), at(path))


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(row: DataFrame, path: str) -> str:
    """A one-row result as a JSON document; returns the text."""
    text = json.dumps(row.first().asDict(True), ensure_ascii=False, default=str, indent=1, sort_keys=True)
    row.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def export_points(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Filtered points; lists are joined by semicolons and only values with a comma are quoted."""
    flat = df.select(*[F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    writer = flat.write.mode("overwrite").option("header", True)
    writer.csv(path) if kind == "csv" else writer.json(path)


def variants(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """Sorted names, without their suffix, of the tables under a path that fit the pattern; hidden files and marks such as _SUCCESS are none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(at, pattern)) if fs.exists(at) else []
    return sorted(re.sub(r"\.[^.]+$", "", n) for n in (s.getPath().getName() for s in found) if n[0] not in "._")


def variant_path(base: str, method: str, perplexity: int = 30, n_neighbors: int = 15) -> str:
    """Path of a projection by method and its parameter; an unknown method is an error."""
    names = {"pca": "pca", "tsne": f"tsne_p{perplexity}", "umap": f"umap_n{n_neighbors}"}
    if method not in names:
        raise ValueError(f"unknown method {method}")
    return f"{base}/{names[method]}"


def variant_of(method, perplexity, n_neighbors):
    """variant_path's name as a column; null for an unknown method."""
    return F.when(method == "pca", "pca").when(method == "tsne", F.concat(F.lit("tsne_p"), perplexity.cast("string"))).when(method == "umap", F.concat(F.lit("umap_n"), n_neighbors.cast("string")))


def upload_problems(files: DataFrame) -> DataFrame:
    """(upload, files, problems array<string>) of uploads from (upload, name, bytes), as `check_upload` finds them for one: names are made
    safe first, problems stand in its order."""
    safe = F.regexp_replace(F.substring_index(F.replace("name", F.lit("\\"), F.lit("/")), "/", -1), "[^A-Za-z0-9._-]", "_")
    allowed = F.lower("safe").rlike("(" + "|".join(re.escape(x) for x in SUFFIXES) + ")$")
    each = files.withColumn("safe", safe).withColumn("ok", allowed).groupBy("upload", "safe", "ok").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    names = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("safe"))))
    whole = each.groupBy("upload").agg(F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), names(~F.col("ok")).alias("wrong"), names(F.col("n") > 1).alias("twice"))
    told = F.concat(
        F.array_compact(F.array(F.when(F.col("files") > MOST_FILES, f"more than {MOST_FILES} files"))), F.transform("wrong", lambda n: F.concat(F.lit("suffix of "), n, F.lit(" is not allowed"))),
        F.transform("twice", lambda n: F.concat(n, F.lit(" comes twice"))), F.array_compact(F.array(F.when(F.col("bytes") > MOST_BYTES, "too many bytes"))),
    )
    return whole.select("upload", "files", told.alias("problems"))


def _put(folder: str, name: str, content: bytes) -> int:
    """Write a file below a folder that all tasks share: beside its place first, so that a task that runs twice leaves one whole file."""
    import uuid

    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    system.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
    place = f"{base}/{name}"
    beside = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside, compression=None) as out:
        out.write(content)
    system.move(beside, place)
    return len(content)


def write_matrices(rows: DataFrame, folder: str, values: str = "values") -> int:
    """One NPY file of each Arrow batch of an array column, by the tasks themselves; the number of rows written. Arrays have one length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        for k, batch in enumerate(batches):
            if len(batch):
                out = io.BytesIO()
                np.save(out, np.stack(batch[values].to_list()))
                _put(folder, f"m-{TaskContext.get().partitionId():05d}-{k:05d}.npy", out.getvalue())
            yield pd.DataFrame({"n": [len(batch)]})

    return int(rows.select(values).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0)


def write_recordings(rows: DataFrame, folder: str, gain: float = 1000.0) -> int:
    """A header and a 16-bit matrix for each row (stem, fs, names, leads array<array<double>> in mV), by the tasks; the number of records.
    Samples are rounded to 1/gain mV and kept within 16 bits; leads have one length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                x = np.clip(np.rint(np.stack(r.leads) * gain), -32768, 32767).astype("<i2")
                lines = [f"{r.stem.rsplit('/', 1)[-1]} {len(x)} {r.fs:g} {x.shape[1]}"]
                lines += [f"{r.stem.rsplit('/', 1)[-1]}.mat 16 {gain:g}(0)/mV 16 0 0 0 0 {name}" for name in r.names]
                _put(folder, f"{r.stem}.mat", np.ascontiguousarray(x.T).tobytes())
                _put(folder, f"{r.stem}.hea", ("\n".join(lines) + "\n").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return int(rows.select("stem", "fs", "names", "leads").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0)

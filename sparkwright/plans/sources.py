"""Round trips of driver tables through sinks and sources, and header functions on constructed headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwright.session import scratch_folder, table
from sparkwright.sources import files as S


def json_lines(spark, d):
    """Nations written as JSON lines with blank lines between, and read again."""
    path = scratch_folder(spark)
    n = table(spark, d, "nation")
    n.select(F.concat(F.to_json(F.struct("n_nationkey", "n_name")), F.lit("\n")).alias("value")).write.text(path)
    return S.read_json_lines(spark, path, "n_nationkey long, n_name string").where("n_name is not null")


def swapped_sink(spark, d):
    """Regions written twice over: the new rows stand at the path, the first ones in its backup."""
    path = scratch_folder(spark)
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    S.swap_json(r, path)
    S.swap_json(r.where("r_regionkey < 3"), path)
    schema = "r_regionkey long, r_name string"
    new, old = (S.read_json_lines(spark, p, schema).withColumn("at", F.lit(name)) for p, name in ((path, "new"), (f"{path}.bak", "old")))
    return new.unionByName(old)


def appended_sink(spark, d):
    path = scratch_folder(spark)
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    S.append_json(c.where("c_custkey % 2 = 0"), path)
    S.append_json(c.where("c_custkey % 2 = 1"), path)
    return S.read_json_lines(spark, path, "c_custkey long, c_mktsegment string").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


def manifest_csv(spark, d):
    """Suppliers as a manifest with blank keys, written and read by key."""
    path = scratch_folder(spark)
    key = F.when(F.col("s_suppkey") % 10 == 0, F.lit(" ")).otherwise(F.concat(F.lit("s"), F.col("s_suppkey")))
    S.write_manifest(table(spark, d, "supplier").select(key.alias("recording_id"), "s_nationkey"), path)
    return S.read_manifest(spark, path).select("recording_id", F.col("s_nationkey").cast("long").alias("s_nationkey"))


def map_of_lists(spark, d):
    """One JSON document of the nations of each region, read as lines; a second look comes from memory."""
    path = scratch_folder(spark)
    lists = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("k")).agg(F.array_sort(F.collect_list("n_name")).alias("v"))
    lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).coalesce(1).write.text(path)  # 25 names
    S.cached_document(spark, path)
    return S.cached_document(spark, path).select("id", F.col("i").cast("long").alias("i"), "line")


def report_sink(spark, d):
    """A one-row report, written as a JSON document and read again."""
    path = scratch_folder(spark)
    S.write_report(table(spark, d, "orders").agg(F.count("*").alias("orders"), F.max("o_custkey").alias("top")), path)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.get_json_object("value", "$.orders").cast("long").alias("orders"), F.get_json_object("value", "$.top").cast("long").alias("top"))


def exported_points(spark, d):
    path = scratch_folder(spark)
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    S.export_points(rows, path)
    return spark.read.option("header", True).schema("l_suppkey long, flags string").csv(path)


def copied_tables(spark, d):
    """Tables copied as they are, the names of what lies at the target, and their rows."""
    path = scratch_folder(spark)
    S.copy_tables(spark, ["region.parquet", "nation.parquet"], d, path)
    out = None
    for name in S.variants(spark, path, "*.parquet"):
        one = spark.read.parquet(f"{path}/{name}.parquet").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def lead_table(spark, d):
    """Twelve leads from a CSV whose columns stand in another order and case."""
    path = scratch_folder(spark)
    v = table(spark, d, "embeddings").select(*[F.round(F.col("embedding")[i].cast("double"), 5).alias(x.upper()) for i, x in reversed(list(enumerate(S.LEADS)))])
    v.write.option("header", True).csv(path)
    return S.read_lead_table(spark, path).agg(F.count("*").alias("n"), *[F.round(F.sum(x), 4).alias(x) for x in S.LEADS])


def _headers(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    key = F.col("p_partkey").cast("string")
    named = F.concat(F.lit("r"), key, F.when(F.col("p_partkey") % 7 == 0, F.lit("/x")).otherwise(F.lit("")), F.lit(".mat"))
    line = F.concat(named, F.lit(" 16+24 1000/mV 16 0 0 0 0 I"))
    two = F.when(F.col("p_partkey") % 5 == 0, line).otherwise(F.concat_ws("\n", line, F.concat(F.lit("other.dat 16 1000/mV 16 0 0 0 0 II"))))
    age = F.concat(F.lit("#Age: "), F.when(F.col("p_size") > 45, F.lit("NaN?")).otherwise(F.col("p_size").cast("string")))
    text = F.concat_ws("\n", F.concat(F.lit("r"), key, F.lit(" 2 500 5000 2019-3-14")), two, age, F.concat(F.lit("#Sex: "), F.when(F.col("p_partkey") % 2 == 0, "Male").otherwise("FEMALE")), F.concat(F.lit("#Dx: 426783006, "), key))
    return p.select("p_partkey", text.alias("text"), F.when(F.col("p_partkey") % 3 == 0, F.array(named)).otherwise(F.array(named, F.lit("other.dat"))).alias("names"))


def header_fields(spark, d):
    """Age, sex, codes, the repaired first line and the files of each header."""
    h = S.header_comments(_headers(spark, d))
    return h.select("p_partkey", "age", "sex", F.array_join("codes", ";").alias("codes"), S.repair_date(F.split("text", "\n")[0]).alias("first"), F.array_join(S.referenced_files(F.col("text")), ";").alias("files"))


def header_problems(spark, d):
    return _headers(spark, d).select("p_partkey", F.array_join(S.header_problems(F.col("text"), F.col("names")), "; ").alias("problems"))


def lead_names(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("avr", "LEAD II", "MDC_ECG_LEAD_III", " v6 ", "X1", "AVF")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").groupBy(S.lead_name(raw).alias("lead")).agg(F.count("*").alias("n"))


def matrix_round_trip(spark, d):
    """Vectors with their ids written as NPY files by the tasks, read again by ranges of rows."""
    path = scratch_folder(spark)
    v = table(spark, d, "embeddings").where("embedding is not null")
    S.write_matrices(v.select(F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>")).alias("values")), path)
    rows = S.read_matrices(spark, path)
    return rows.select(F.element_at("values", 1).cast("long").alias("vec_id"), F.round(F.element_at("values", 2), 6).alias("first"), F.round(F.element_at("values", -1), 6).alias("last"), (F.size("values") - 1).cast("long").alias("n"))


def _suppliers(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    lead = lambda k: F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: ((F.col("s_suppkey") * k + i * 13) % 2001 - 1000) / F.lit(1000.0))
    stem = F.concat(F.lit("n"), F.col("s_nationkey"), F.lit("/r"), F.col("s_suppkey"))
    return s.select(stem.alias("stem"), F.lit(500.0).alias("fs"), F.array(F.lit("aVR"), F.lit("I")).alias("names"), F.array(lead(7), lead(11)).alias("leads"))


def recording_round_trip(spark, d):
    """Recordings written as headers and matrices, found by both files, and read again in lead order."""
    path = scratch_folder(spark)
    S.write_recordings(_suppliers(spark, d), path)
    found = S.discover_recordings(spark, path).select("base")
    total = lambda k: F.round(F.aggregate(F.element_at("leads", k), F.lit(0.0), lambda a, x: a + x), 6)
    rows = S.read_recordings(spark, path).join(found, "base")
    return rows.select(F.expr("cast(substring(stem, 2) as long)").alias("s_suppkey"), "fs", total(1).alias("one"), total(4).alias("avr"), F.size(F.element_at("leads", 2)).cast("long").alias("two"))


def uploads(spark, d):
    """Each order as an upload of files named after its lines: what is wrong with it."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".hea", ".MAT", ".dat", ".exe")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    name = F.concat(F.lit("C:\\up load\\f"), F.col("l_suppkey") % 3, suffix)
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("upload"), name.alias("name"), (F.col("l_partkey") * 20000).cast("long").alias("bytes"))
    return S.upload_problems(files).select("upload", "files", F.array_join("problems", "; ").alias("problems"))


def variant_paths(spark, d):
    """Names of projections by method and parameter; unknown methods have none."""
    o = table(spark, d, "orders").select(F.element_at(F.array(*[F.lit(x) for x in ("pca", "tsne", "umap", "other")]), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("method"), (F.col("o_custkey") % 5 * 10).cast("int").alias("p"))
    return o.groupBy(F.coalesce(S.variant_of(F.col("method"), F.col("p"), F.col("p") + 5), F.lit("none")).alias("variant")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    matrix_round_trip, recording_round_trip, uploads, variant_paths,
    json_lines, swapped_sink, appended_sink, manifest_csv, map_of_lists, report_sink, exported_points, copied_tables, lead_table, header_fields,
    header_problems, lead_names,
)}

_NAMED = "'r' || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '/x' ELSE '' END || '.mat'"
ORACLES = {
    "matrix_round_trip": "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[len(embedding)]::DOUBLE, 6) AS last, len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL",
    "recording_round_trip": "SELECT s_suppkey, 500.0::DOUBLE AS fs, round(list_sum(list_transform(range(0, 40), lambda i: (s_suppkey * 11 + i * 13) % 2001 - 1000)) / 1000.0::DOUBLE, 6) AS one, round(list_sum(list_transform(range(0, 40), lambda i: (s_suppkey * 7 + i * 13) % 2001 - 1000)) / 1000.0::DOUBLE, 6) AS avr, 0::BIGINT AS two FROM supplier",
    "uploads": "WITH f AS (SELECT l_orderkey AS upload, 'f' || l_suppkey % 3 || ['.hea', '.MAT', '.dat', '.exe'][l_partkey % 4 + 1] AS name, l_partkey * 20000 AS b FROM lineitem), n AS (SELECT upload, name, count(*) AS k, sum(b) AS b FROM f GROUP BY ALL), u AS (SELECT upload, sum(k)::BIGINT AS files, sum(b) AS b, list_sort(list(name) FILTER (name LIKE '%.exe')) AS w, list_sort(list(name) FILTER (k > 1)) AS t FROM n GROUP BY upload) SELECT upload, files, concat_ws('; ', CASE WHEN files > 4 THEN 'more than 4 files' END, CASE WHEN len(w) > 0 THEN array_to_string(list_transform(w, lambda x: 'suffix of ' || x || ' is not allowed'), '; ') END, CASE WHEN len(t) > 0 THEN array_to_string(list_transform(t, lambda x: x || ' comes twice'), '; ') END, CASE WHEN b > 67108864 THEN 'too many bytes' END) AS problems FROM u",
    "variant_paths": "WITH o AS (SELECT o_orderkey % 4 AS m, o_custkey % 5 * 10 AS p FROM orders) SELECT CASE m WHEN 0 THEN 'pca' WHEN 1 THEN 'tsne_p' || p WHEN 2 THEN 'umap_n' || (p + 5) ELSE 'none' END AS variant, count(*) AS n FROM o GROUP BY 1",
    "json_lines": "SELECT n_nationkey, n_name FROM nation",
    "swapped_sink": "SELECT r_regionkey, r_name, 'new' AS at FROM region WHERE r_regionkey < 3 UNION ALL SELECT r_regionkey, r_name, 'old' FROM region",
    "appended_sink": "SELECT c_mktsegment, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1",
    "manifest_csv": "SELECT 's' || s_suppkey AS recording_id, s_nationkey FROM supplier WHERE s_suppkey % 10 <> 0",
    "map_of_lists": "SELECT n_regionkey::VARCHAR AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS i, n_name AS line FROM nation",
    "report_sink": "SELECT count(*) AS orders, max(o_custkey) AS top FROM orders",
    "exported_points": "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ';') AS flags FROM lineitem GROUP BY 1",
    "copied_tables": "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region",
    "lead_table": "SELECT count(*) AS n, " + ", ".join(f'round(sum(round(embedding[{i + 1}]::DOUBLE, 5)), 4) AS "{x}"' for i, x in enumerate(S.LEADS)) + " FROM embeddings",
    "header_fields": f"SELECT p_partkey, CASE WHEN p_size <= 45 THEN p_size::DOUBLE END AS age, CASE WHEN p_partkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex, '426783006;' || p_partkey AS codes, 'r' || p_partkey || ' 2 500 5000 14/3/2019' AS first, {_NAMED} || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ';other.dat' END AS files FROM part",
    "header_problems": "SELECT p_partkey, concat_ws('; ', CASE WHEN p_partkey % 5 = 0 THEN 'signal lines are missing' END, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 = 0 THEN 'files are missing: other.dat' END, CASE WHEN p_partkey % 7 = 0 THEN 'a path in a file name' END) AS problems FROM part",
    "lead_names": "SELECT ['aVR', 'II', 'III', 'V6', 'X1', 'aVF'][p_partkey % 6 + 1] AS lead, count(*) AS n FROM part GROUP BY 1",
}

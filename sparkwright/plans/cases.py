"""Cases on the driver tables: viewer filter, rules over called classes, variability, signatures, records and their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions.codes import TEXTS
from sparkwright.operators import cases as K
from sparkwright.operators import governance as G
from sparkwright.operators import models as M
from sparkwright.operators.sequences import by_key
from sparkwright.plans.records import R as RECORDS
from sparkwright.plans.records import records
from sparkwright.plans.sequences import E, V, rr, valued
from sparkwright.session import scratch_folder, table

CODES = dict(TEXTS)
CLASSES = ["sinus tachycardia", "atrial fibrillation", "atrial flutter", "STEMI", "axis left shift", "axis right shift", "tachycardia", "left bundle branch block"]


def points(spark, d: str) -> DataFrame:
    r = records(spark, d)
    tribes = F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("t"), F.col("id") % 4), F.col("primary")))
    return r.select("id", F.col("source").alias("cohort"), tribes.alias("tribes"), "labels", (F.col("id") % 7 == 0).alias("supplement"), "n_chars")


def viewer_pipeline(spark, d):
    out = K.viewer_points(
        points(spark, d), cohorts=["src0", "src1", "src2", "src3", "src4"], tribes=["t1", "t2", "en"], show_no_tribes=True, highlighted=["Good"], filled=["Toxic"],
        operators={("Toxic", "Good"): "or"}, predicate=F.col("n_chars") < 5000, show_supplements=False,
    )
    return out.select("id", "cohort", F.array_join("labels", ";").alias("labels"))


def viewer_exclusive(spark, d):
    """Two filled labels joined by AND are a point's whole set; points without tribes are left out."""
    out = K.viewer_points(points(spark, d), tribes=["t1", "t2"], show_no_tribes=False, filled=["Good", "Toxic"], operators={("Good", "Toxic"): "and", ("Toxic", "Good"): "and"}, cross_validated=True)
    return out.select("id", F.array_join("labels", ";").alias("labels"))


def tribe_filter(spark, d):
    out = points(spark, d).where(K.tribe_filter(F.col("tribes"), ["t3", "de"], False))
    return out.select("id", F.array_join("tribes", ";").alias("tribes"))


def filter_cycle(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("presses"))
    return n.select("l_orderkey", "presses", K.state_after(F.col("presses")).alias("state"))


def rate_fallback(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    lead = F.element_at(F.array(*[F.lit(x) for x in (*K.RATE_LEADS, "V6")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    wide = li.groupBy("l_orderkey").agg(*[F.max(F.when(lead == x, F.col("l_quantity") - 20)).alias(x) for x in K.RATE_LEADS], (F.count("*") - 1).alias("seconds"))
    return wide.select("l_orderkey", F.round(K.rate_estimate({x: F.col(x) for x in K.RATE_LEADS}, F.col("seconds")), 6).alias("rate"))


def case_rules(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("rec"), "o_custkey")
    names = F.array(*[F.lit(c) for c in CLASSES])
    scores = o.select("rec", F.posexplode(names).alias("i", "class"), "o_custkey")
    scores = scores.select("rec", "class", ((F.col("rec") * 7 + F.col("o_custkey") * (F.col("i") + 3)) % 100 / F.lit(100.0)).alias("p"), F.when(F.col("i") % 4 != 3, 0.6 + F.col("i") * 0.04).alias("threshold"))
    rates = o.where("rec % 5 <> 0").select("rec", (F.col("o_custkey") % 120 + 30).cast("double").alias("rate"))
    return K.case_rules(scores, rates).select("rec", "rule", F.round("priority", 6).alias("priority"), F.array_join("classes", ";").alias("classes"))


def affected_join(spark, d):
    """Affected orders with the flags of their last line and their customers' segments; every fifth order has no lines."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("cohort"), F.col("o_custkey").alias("study"), F.col("o_orderkey").alias("id"))
    li = table(spark, d, "lineitem").where("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("id"), F.array("l_returnflag", F.col("l_linenumber").cast("string")).alias("labels"), F.array("l_linestatus").alias("predictions"), F.col("l_linenumber").alias("i"))
    rep = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("study"), F.array("c_mktsegment").alias("lines"))
    j = lambda c: F.array_join(c, ";").alias(c)
    return K.affected_records(o, li, rep).select("cohort", "study", "id", j("labels"), j("predictions"), j("lines"))


def _waves(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_partkey")
    return li.select(
        F.col("l_orderkey").alias("rec"), F.col("l_returnflag").alias("wave"), "l_linenumber", (F.col("l_quantity") / 25 - 1).alias("amp"),
        F.when(F.col("l_tax") > 0.01, F.col("l_discount") * 1000).alias("duration"), (F.col("l_partkey") % 360 - 180).cast("double").alias("angle"), (F.col("l_quantity") * F.col("l_tax")).alias("area"),
    )


def wave_variability(spark, d):
    """Each wave against the mean wave of its flag."""
    w = _waves(spark, d)
    reference = w.groupBy("wave").agg(*[F.avg(c).alias(c) for c in ("amp", "duration", "angle", "area")])
    out = K.wave_variability(K.wave_differences(w, reference, "wave"), "wave")
    return out.select("wave", "n_beats", *[F.when(F.round(c, 6) == 0, 0.0).otherwise(F.round(c, 6)).alias(c) for c in ("amp_mean", "amp_sd", "duration_sd", "axis_sd", "area_sd", "flip_share")])


def energy_bimodality(spark, d):
    out = K.bimodality(valued(spark, d), "rr", F.col("event_type").isin("purchase", "error"), "key")
    return out.select("key", "n_ectopic", "n_normal", F.round("ashman", 6).alias("ashman"))


def rr_signature(spark, d):
    """Intervals folded to two or three modes by user, so that every pattern occurs."""
    folded = rr(spark, d).withColumn("rr", F.when(F.col("key") % 3 == 0, F.col("rr")).otherwise(600 + F.col("i") % (F.col("key") % 3 + 1) * 300 + F.col("rr") % 7))
    out = K.rr_signature(folded)
    return out.select("key", "n_peaks", *[F.round(c, 6).alias(c) for c in ("coverage", "tight", "dominance")], "pattern")


def histogram_modes(spark, d):
    own = rr(spark, d).withColumn("mean", F.avg("rr").over(by_key()))
    return K.histogram_modes(own).select("key", "c", F.round("center", 6).alias("center"))


def ectopic_patterns(spark, d):
    marked = valued(spark, d).withColumn("label", F.when((F.col("key") % 2 == 0) & (F.col("i") % 2 == 1) | (F.col("key") % 2 == 1) & (F.col("i") % 3 == 2), "E").otherwise("N"))
    marked = marked.withColumn("label", F.when(F.col("rr") % 5 < 0.5, "E").otherwise(F.col("label"))).withColumn("rr", F.when(F.col("i") % 2 == 0, F.col("rr")).otherwise(F.col("rr") * 2))
    return K.ectopic_patterns(marked.select("key", "i", "label", "rr"))


def feature_gloss(spark, d):
    p = table(spark, d, "part").select("p_partkey")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("p_partkey") / k) % len(values) + 1).cast("int"))
    name = F.concat_ws("::", pick(["ml_direct", "plane"], 1), pick(["V1", "II", "XY"], 2), pick(["P", "QRS", "U"], 3), F.when(F.col("p_partkey") % 11 != 0, pick(["amp", "dur"], 5)), pick(["acf_lag_8", "alternation_index_p3", "mean", "odd", None], 7))
    return p.select("p_partkey", name.alias("name"), K.feature_gloss(name).alias("gloss"))


def file_names(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("../up/"), F.col("p_name"), F.lit(".hea"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("C:\\x\\.nul.dat.."), F.col("p_name"))).when(F.col("p_partkey") % 4 == 2, F.lit("nul.hea")).otherwise(F.col("p_name"))
    return p.select("p_partkey", K.safe_name(raw).alias("name"))


def code_names(spark, d):
    """Nation keys as codes, of which a dictionary knows some."""
    codes = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("code"))
    words = table(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").cast("string").alias("code"), F.lower("n_name").alias("text"))
    return K.code_texts(codes, words).select("c_custkey", "text")


def diagnosis_codes(spark, d):
    """Codes of a header list, the known ones as texts."""
    known = F.array(*[F.lit(k) for k in list(CODES)[::9]], F.lit("999"))
    codes = table(spark, d, "customer").select("c_custkey", F.element_at(known, (F.col("c_custkey") % F.size(known) + 1).cast("int")).alias("code"))
    dictionary = spark.createDataFrame(list(CODES.items()), "code string, text string")  # under 200 rows
    return K.code_texts(codes, dictionary).groupBy("code", "text").agg(F.count("*").alias("n"))


def final_record(spark, d):
    p = table(spark, d, "part")
    json = K.final_record({"price": F.col("p_retailprice") / 7, "size": F.when(F.col("p_size") > 3, F.col("p_size")).otherwise(F.lit(float("nan")))}, {"big": F.col("p_size") > 25}, F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>")))
    at = lambda path: F.get_json_object("j", path)
    return p.select("p_partkey", json.alias("j")).select("p_partkey", at("$.data.price").cast("double").alias("price"), at("$.data.size").cast("double").alias("size"), at("$.label").alias("label"), at("$.semantic.semantic_flags.big").alias("big"), at("$.semantic.quality_warning").alias("warning"))


def nested_records(spark, d):
    """Orders with their lines as JSON records: numbers rounded at any depth, those that are not finite null."""
    part = F.struct("l_linenumber", (F.col("l_extendedprice") / 7).alias("price"), F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax") / 3).alias("tax"))
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(part)).alias("lines"), F.sum("l_quantity").alias("n"))
    one = li.select("l_orderkey", "lines", F.create_map(F.lit("per_line"), F.col("n") / F.size("lines"), F.lit("infinite"), F.when(F.col("n") > 100, F.lit(float("inf"))).otherwise(F.col("n") / 3)).alias("sums"))
    at = lambda path: F.get_json_object("record", path)
    lines = F.from_json(at("$.lines"), "array<struct<price double, tax double>>")
    total = lambda c: F.round(F.aggregate(F.transform(lines, lambda x: F.coalesce(x[c], F.lit(0.0))), F.lit(0.0), lambda s, x: s + x), 2)
    return K.record_json(one).select(at("$.l_orderkey").cast("long").alias("l_orderkey"), total("price").alias("price"), total("tax").alias("tax"), at("$.sums.per_line").cast("double").alias("per_line"), at("$.sums.infinite").isNull().alias("infinite"))


def colours(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    t = F.col("p_size") / F.lit(50.0)
    names = [F.lit(x) for x in ("#ff0000", "#00ff80", "#123456")]
    return p.select("p_partkey", K.lerp(names[0], names[2], t).alias("lerp"), K.gradient(t, *names).alias("gradient"), K.blend(F.array(names[0], names[1], K.lerp(names[1], names[2], t))).alias("blend"), K.hsl(F.col("p_partkey") % 360, F.col("p_size") % 2 * 60, F.col("p_size")).alias("hsl"))


def notch_rule(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 25 - 1).alias("a"), (F.col("l_partkey") % 80).cast("double").alias("gap"), (F.col("l_discount") * 200 + 5).alias("s"))
    alike = li.groupBy("a", "gap", "s").agg(F.count("*").alias("n"))  # a valley is sought once for equal pairs
    hit = K.notched(F.col("a"), F.lit(0.0), F.col("s"), F.col("a") * 0.8, F.col("gap"), F.col("s"))
    return alike.groupBy(hit.alias("notched")).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("gap") * F.col("n")), 2).alias("gap"))


def region_labels(spark, d):
    li = table(spark, d, "lineitem").select(((F.col("l_partkey") * 13 + F.col("l_suppkey")) % 800 - 300).cast("double").alias("t"), (F.col("l_quantity") * 10 + 500).alias("rr"))
    return li.groupBy(K.region(F.col("t"), F.col("rr")).alias("region")).agg(F.count("*").alias("n"))


def window_containment(spark, d):
    """Times of each order's lines in its own P, QRS and T windows, which follow its interval."""
    li = table(spark, d, "lineitem").select("l_orderkey", ((F.col("l_partkey") * 13 + F.col("l_suppkey")) % 800 - 300).cast("double").alias("t"))
    own = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 600 + 500).alias("rr")).select("o_orderkey", F.inline(K.wave_windows(F.col("rr"))))
    both = li.join(own, F.col("l_orderkey") == F.col("o_orderkey")).where(F.col("t").between(F.col("low"), F.col("high")))
    return both.groupBy("wave").agg(F.count("*").alias("n"), F.sum("t").alias("total"))


def model_choice(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("rec"), (F.col("l_linenumber") - 1).cast("int").alias("k"), (F.col("l_quantity") / (20 * F.col("l_linenumber"))).alias("rss"), (F.col("l_linenumber") * 3 - 2).alias("params"), F.lit(40).alias("n"), (F.col("l_partkey") % 50).cast("double").alias("early"), (F.col("l_discount") * 200 - 8).alias("snr"))
    return K.choose_model(li)


def plane_projection(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    at = lambda a: [F.col("v")[a + i] for i in range(6)]
    limb, chest = K.project(at(0), K.LIMB), K.project(at(6), K.CHEST)
    return v.select("vec_id", *[F.round(c, 5).alias(n) for c, n in zip([*limb, *chest], ("lx", "ly", "lmag", "langle", "cx", "cz", "cmag", "cangle"), strict=True)])


def direction_vectors(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.radians(F.col("p_size") * 7.0).alias("a"), F.radians(F.col("p_partkey") % 180 - 90.0).alias("b"))
    return p.select("p_partkey", *[(F.round(c, 6) + 0.0).alias(n) for c, n in zip(K.direction(F.col("a"), F.col("b")), ("vx", "vy", "vz"), strict=True)])


def spacing_prune(spark, d):
    """Part keys of each order, thinned from the right to gaps of 300 or more."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("at"))
    kept = K.spaced_from_right(F.col("at"), 300)
    return g.select("l_orderkey", F.size(kept).alias("n"), F.array_join(kept.cast("array<string>"), ",").alias("kept"))


def generic_counts(spark, d):
    counts = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return G.generic_counts(counts, "counts", ["src1", "src2", "src3"]).select("lang", F.explode("counts").alias("source", "n"))


def rounded_payload(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", G.thin_samples(F.col("embedding").cast("array<double>")).alias("s"))
    return v.select("vec_id", F.size("s").alias("n"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.col("s")[0].alias("first"))


def unexpected_columns(spark, d):
    """Columns of orders that publication neither keeps nor drops, with how many rows hold a value in them."""
    return K.unexpected_values(table(spark, d, "orders"), ["o_orderkey", "o_custkey"], ["o_orderstatus"])


def ordered_counts(spark, d):
    """Counts by source, the largest first and the unmapped last, with their places."""
    named = table(spark, d, "documents").select(F.when(F.col("source").isin("src5", "src6"), "unmapped").otherwise(F.col("source")).alias("source"))
    counts = named.groupBy("source").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source") == "unmapped", F.desc("n"), "source"))  # one row for each source
    return counts.select(place.alias("place"), "source", "n")


def double_index(spark, d):
    """Orders found by customer or by key, the last row of each customer counting."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    by_customer = K.indexed(o, "o_custkey", "o_orderkey")
    asked = table(spark, d, "customer").select("c_custkey")
    first = asked.join(by_customer, asked["c_custkey"] == by_customer["o_custkey"], "left").select("c_custkey", "o_orderkey")
    return first.join(K.indexed(o, "o_orderkey", "o_totalprice"), "o_orderkey", "left").select("c_custkey", "o_orderkey", "o_totalprice")


def path_index(spark, d):
    """Open records by an index of paths, with those whose file is missing marked."""
    rows = table(spark, d, "documents").where("source in ('src0', 'src1')").select("doc_id", "source")
    paths = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url")
    out = rows.join(paths, "doc_id", "left")
    return out.select("doc_id", F.coalesce("url", F.lit("")).alias("path"), F.col("url").isNull().alias("missing"))


def model_explanations(spark, d):
    """Two folds of boosted trees, saved as a package and loaded again: mean probability and the features that add or take most."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), "p_retailprice", F.length("p_name").cast("double").alias("name"))
    p = p.withColumnRenamed("p_retailprice", "price").withColumn("label", (F.col("size") * 20 + F.col("price") > 1900).cast("double"))
    features, path = ["size", "price", "name"], scratch_folder(spark)
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(p)
    for fold in range(2):
        GBTClassifier(maxIter=2, maxDepth=3, seed=1).fit(rows.where(f"id % 2 <> {fold}")).write().save(f"{path}/dear/{fold}")
    explained = M.explain(p, M.load_package(spark, path, ["dear"], 2), features)
    return M.top_features(explained, features, 2).join(explained.select("id", "class", "p"), ["id", "class"]).select("id", "class", "rank", "feature", F.round("value", 6).alias("value"), F.round("p", 6).alias("p"))


QUERIES = {f.__name__: f for f in (
    nested_records, model_explanations, viewer_pipeline, viewer_exclusive, tribe_filter, filter_cycle, rate_fallback, case_rules, affected_join, wave_variability, energy_bimodality,
    rr_signature, histogram_modes, ectopic_patterns, feature_gloss, file_names, code_names, diagnosis_codes, final_record, colours, notch_rule, region_labels,
    window_containment, model_choice, plane_projection, direction_vectors, spacing_prune, generic_counts, rounded_payload, unexpected_columns,
    ordered_counts, double_index, path_index,
)}

_PT = f"""{RECORDS}, pt AS (SELECT id, source AS cohort, CASE WHEN id % 3 = 0 THEN []::VARCHAR[] ELSE ['t' || id % 4, "primary"] END AS tribes, labels, id % 7 = 0 AS supplement, n_chars FROM r)"""
_ANY = lambda names: "len(list_filter(tribes, lambda x: x IN (" + ", ".join(f"'{n}'" for n in names) + "))) > 0"
_JS = lambda e: f"array_to_string({e}, ';')"
_PICK = lambda values, k: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][(p_partkey // {k}) % {len(values)} + 1]"
_SCORES = f"""sc AS (SELECT o_orderkey AS rec, unnest({CLASSES!r}) AS class, unnest(range(0, {len(CLASSES)})) AS i, o_custkey FROM orders),
 s AS (SELECT rec, class, (rec * 7 + o_custkey * (i + 3)) % 100 / 100.0::DOUBLE AS p, CASE WHEN i % 4 <> 3 THEN 0.6::DOUBLE + i * 0.04::DOUBLE END AS t FROM sc),
 c AS (SELECT rec, class, round(p / coalesce(t, 0.5::DOUBLE), 6) AS ratio FROM s WHERE p >= coalesce(t, 0.5::DOUBLE)),
 rt AS (SELECT o_orderkey AS rec, (o_custkey % 120 + 30)::DOUBLE AS rate FROM orders WHERE o_orderkey % 5 <> 0),
 has AS (SELECT o_orderkey AS rec, coalesce(list(class), []) AS names FROM orders LEFT JOIN c ON c.rec = o_orderkey GROUP BY o_orderkey)"""
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_MUTEX = " UNION ALL ".join(
    f"SELECT rec, 'mutex::{g}' AS rule, round(100 + max(ratio), 6) AS priority, string_agg(class, ';' ORDER BY ratio DESC, class) AS classes FROM c WHERE class IN {_IN(m)} GROUP BY rec HAVING count(*) >= 2"
    + (f" AND count(*) FILTER (class NOT IN {_IN(K.FIBRILLATION)}) > 0" if g == "rhythm" else "")
    for g, m in K.EXCLUSIVE.items()
)
_HUE = "CASE WHEN {t} < 1.0::DOUBLE / 6 THEN p + (q - p) * 6 * {t} WHEN {t} < 0.5 THEN q WHEN {t} < 2.0::DOUBLE / 3 THEN p + (q - p) * (2.0::DOUBLE / 3 - {t}) * 6 ELSE p END"
_HEX = lambda parts: "'#' || " + " || ".join(f"lpad(lower(to_hex(floor({p} + 0.5)::BIGINT)), 2, '0')" for p in parts)
_RGB = {"a": (255, 0, 0), "b": (0, 255, 128), "c": (18, 52, 86)}
_MIX = lambda a, b, t: [f"({x} + ({y} - {x}) * least(1, greatest(0, {t})))" for x, y in zip(_RGB[a], _RGB[b], strict=True)]
_GAIN = sum((a * a + b * b) ** 0.5 for a, b in zip(*K.LIMB, strict=True)) / 6
_DOT = lambda row, at: " + ".join(f"v[{at + i}] * {w / _GAIN!r}::DOUBLE" for i, w in enumerate(row))
_SIG = f"""WITH {E}, f AS (SELECT key, i, CASE WHEN key % 3 = 0 THEN rr ELSE 600 + i % (key % 3 + 1) * 300 + rr % 7 END AS rr FROM rr)"""
_MODES = """ w AS (SELECT key, i, rr, floor(greatest(15, 0.04::DOUBLE * mean)) AS w, min(rr) OVER (PARTITION BY key) AS lo, max(rr) OVER (PARTITION BY key) AS hi FROM own),
 bb AS (SELECT *, ceil((hi + w - lo) / w)::BIGINT - 1 AS bins FROM w WHERE hi > lo), b AS (SELECT key, least(floor((rr - lo) / w)::BIGINT, bins - 1) AS b, any_value(w) AS w, any_value(lo) AS lo, any_value(bins) AS bins, count(*) AS n FROM bb GROUP BY 1, 2),
 g AS (SELECT k.key, unnest(range(0, bins)) AS b, w, lo, bins FROM (SELECT DISTINCT key, w, lo, bins FROM b) k), h AS (SELECT g.key, g.b, g.w, g.lo, g.bins, coalesce(b.n, 0) AS n FROM g LEFT JOIN b ON g.key = b.key AND g.b = b.b),
 x AS (SELECT *, CASE WHEN n = lag(n) OVER o THEN 0 ELSE 1 END AS new FROM h WINDOW o AS (PARTITION BY key ORDER BY b)), y AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY b) AS run FROM x),
 z AS (SELECT key, run, min(b) AS b0, max(b) AS b1, any_value(n) AS n, any_value(w) AS w, any_value(lo) AS lo, any_value(bins) AS bins FROM y GROUP BY key, run),
 q AS (SELECT *, lag(n) OVER o AS p0, lead(n) OVER o AS p1, max(n) OVER (PARTITION BY key) AS top FROM z WINDOW o AS (PARTITION BY key ORDER BY run)),
 modes AS (SELECT key, b0 AS c, lo + (floor((b0 + b1) / 2) + 0.5) * w AS center FROM q WHERE b0 > 0 AND b1 < bins - 1 AND n > p0 AND n > p1 AND n >= greatest(1, floor(0.35::DOUBLE * top)) AND n >= 3)"""

ORACLES = {
    "viewer_pipeline": f"WITH {_PT} SELECT id, cohort, {_JS('labels')} AS labels FROM pt WHERE cohort IN ('src0', 'src1', 'src2', 'src3', 'src4') AND (len(tribes) = 0 OR {_ANY(['t1', 't2', 'en'])}) AND (labels = ['Toxic'] OR list_contains(labels, 'Good')) AND n_chars < 5000 AND NOT supplement",
    "viewer_exclusive": f"WITH {_PT} SELECT id, {_JS('labels')} AS labels FROM pt WHERE {_ANY(['t1', 't2'])} AND len(labels) = 2 AND list_contains(labels, 'Good') AND list_contains(labels, 'Toxic')",
    "tribe_filter": f"WITH {_PT} SELECT id, {_JS('tribes')} AS tribes FROM pt WHERE {_ANY(['t3', 'de'])}",
    "filter_cycle": "WITH n AS (SELECT l_orderkey, count(*) AS presses FROM lineitem GROUP BY 1) SELECT *, CASE presses % 4 WHEN 0 THEN 'off' WHEN 2 THEN 'filled' ELSE 'highlighted' END AS state FROM n",
    "rate_fallback": "WITH w AS (SELECT l_orderkey, max(l_quantity - 20) FILTER (l_partkey % 5 = 0) AS a, max(l_quantity - 20) FILTER (l_partkey % 5 = 1) AS b, max(l_quantity - 20) FILTER (l_partkey % 5 = 2) AS c, max(l_quantity - 20) FILTER (l_partkey % 5 = 3) AS d, count(*) - 1 AS s FROM lineitem GROUP BY 1) SELECT l_orderkey, round(CASE WHEN s > 0 THEN CASE WHEN a > 0 THEN a WHEN b > 0 THEN b WHEN c > 0 THEN c WHEN d > 0 THEN d END / s * 60 END, 6) AS rate FROM w",
    "case_rules": f"""WITH {_SCORES} {_MUTEX.join(['SELECT * FROM (', ')'])}
 UNION ALL SELECT rec, 'rule::af-flutter', 120, 'atrial fibrillation;atrial flutter' FROM has WHERE list_contains(names, 'atrial fibrillation') AND list_contains(names, 'atrial flutter')
 UNION ALL SELECT rec, 'rule::mi-family', 110, string_agg(class, ';' ORDER BY class) FROM c WHERE class IN {_IN(K.INFARCTS)} GROUP BY rec
 UNION ALL SELECT rec, 'rule::rhythm-coverage', 90, '' FROM has WHERE len(list_filter(names, lambda x: x IN {_IN(K.RHYTHMS)})) = 0
 UNION ALL SELECT h.rec, 'rule::rate-consistency', CASE WHEN rate > 100 AND (list_contains(names, 'sinus tachycardia') OR list_contains(names, 'tachycardia')) OR rate BETWEEN 60 AND 100 AND len(list_filter(names, lambda x: x IN ('sinus tachycardia', 'tachycardia'))) = 0 THEN 60 ELSE 95 END,
 array_to_string(list_filter(['sinus tachycardia', 'tachycardia'], lambda x: list_contains(names, x)), ';') FROM has h JOIN rt ON h.rec = rt.rec WHERE len(list_filter(names, lambda x: x IN ('sinus tachycardia', 'tachycardia'))) > 0""",
    "affected_join": "WITH l AS (SELECT l_orderkey AS id, l_returnflag || ';' || l_linenumber AS labels, l_linestatus AS predictions FROM lineitem WHERE l_orderkey % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_returnflag DESC, l_linestatus DESC) = 1) SELECT o_orderstatus AS cohort, o_custkey AS study, o_orderkey AS id, coalesce(labels, '') AS labels, coalesce(predictions, '') AS predictions, coalesce(c_mktsegment, '') AS lines FROM orders LEFT JOIN l ON id = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 <> 0",
    "wave_variability": "WITH w AS (SELECT l_returnflag AS wave, l_quantity / 25 - 1 AS amp, CASE WHEN l_tax > 0.01 THEN l_discount * 1000 END AS duration, (l_partkey % 360 - 180)::DOUBLE AS angle, l_quantity * l_tax AS area FROM lineitem), m AS (SELECT wave, avg(amp) AS a, avg(duration) AS du, avg(angle) AS an, avg(area) AS ar FROM w GROUP BY wave), x AS (SELECT w.wave, amp - a AS amp, duration - du AS duration, angle - an + 180 - 360 * floor((angle - an + 180) / 360) - 180 AS angle, area - ar AS area, (amp * a < 0)::INT AS flip FROM w JOIN m ON w.wave = m.wave), o AS (SELECT wave, count(*) AS n_beats, round(avg(amp), 6) AS amp_mean, round(stddev_pop(amp), 6) AS amp_sd, round(stddev_pop(duration), 6) AS duration_sd, round(stddev_pop(angle), 6) AS axis_sd, round(stddev_pop(area), 6) AS area_sd, round(avg(flip), 6) AS flip_share FROM x GROUP BY wave) SELECT * REPLACE (CASE WHEN amp_mean = 0 THEN 0 ELSE amp_mean END AS amp_mean) FROM o",
    "energy_bimodality": f"WITH {V}, x AS (SELECT key, rr, event_type IN ('purchase', 'error') AS e FROM v), s AS (SELECT key, count(*) FILTER (e) AS n_ectopic, count(*) FILTER (NOT e) AS n_normal, avg(rr) FILTER (e) AS me, avg(rr) FILTER (NOT e) AS mn, sqrt(var_pop(rr) FILTER (e) + var_pop(rr) FILTER (NOT e)) AS sd FROM x GROUP BY key) SELECT key, n_ectopic, n_normal, round(CASE WHEN n_ectopic >= 2 AND n_normal >= 2 AND sd > 1e-9 THEN abs(mn - me) / sd ELSE 0 END, 6) AS ashman FROM s",
    "histogram_modes": f"WITH {E}, own AS (SELECT *, avg(rr) OVER (PARTITION BY key) AS mean FROM rr), {_MODES} SELECT key, c, round(center, 6) AS center FROM modes",
    "rr_signature": f"""{_SIG}, dd AS (SELECT key, rr, rr - lag(rr) OVER (PARTITION BY key ORDER BY i) AS d FROM f), st AS (SELECT key, avg(rr) AS mean, sqrt(avg(d * d)) AS rmssd, 100 * avg(CASE WHEN d IS NOT NULL THEN (abs(d) >= 50)::INT END) AS pnn50, stddev_pop(rr) / avg(rr) AS cv FROM dd GROUP BY key HAVING count(*) >= 12 AND avg(rr) >= 280),
 own AS (SELECT f.*, st.mean FROM f JOIN st ON f.key = st.key), {_MODES},
 nr AS (SELECT own.key, own.i, any_value(own.rr) AS rr, greatest(20, 0.06::DOUBLE * any_value(own.mean)) AS tol, count(c) AS peaks, min(abs(center - own.rr)) AS dist, arg_min(c, (abs(center - own.rr), c)) FILTER (c IS NOT NULL) AS c FROM own LEFT JOIN modes ON own.key = modes.key GROUP BY own.key, own.i),
 pl AS (SELECT key, i, rr, tol, peaks, CASE WHEN dist <= tol THEN c END AS c FROM nr), nx AS (SELECT *, lead(c) OVER (PARTITION BY key ORDER BY i) AS nx FROM pl),
 ti AS (SELECT key, count(*) FILTER (n > 1 AND sd <= 0.5 * tol) AS tight FROM (SELECT key, c, count(*) AS n, stddev_pop(rr) AS sd, any_value(tol) AS tol FROM pl WHERE c IS NOT NULL GROUP BY key, c) GROUP BY key),
 pr AS (SELECT key, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, c, nx) AS r FROM (SELECT key, c, nx, count(*) AS n FROM nx WHERE c IS NOT NULL AND nx IS NOT NULL GROUP BY ALL)), dm AS (SELECT key, sum(n) FILTER (r <= 2)::DOUBLE / sum(n) AS dominance FROM pr GROUP BY key),
 o AS (SELECT p.key, max(peaks)::INT AS n_peaks, count(c)::DOUBLE / count(*) AS coverage FROM pl p GROUP BY p.key), a AS (SELECT o.*, coalesce(ti.tight::DOUBLE / greatest(1, n_peaks), 0) AS tight, coalesce(dominance, 0) AS dominance, cv, pnn50, rmssd FROM o LEFT JOIN ti ON o.key = ti.key LEFT JOIN dm ON o.key = dm.key JOIN st ON o.key = st.key)
 SELECT key, n_peaks, round(coverage, 6) AS coverage, round(tight, 6) AS tight, round(dominance, 6) AS dominance, CASE WHEN n_peaks = 0 OR n_peaks >= 4 OR coverage < 0.65 OR dominance < 0.45 OR (cv >= 0.12 OR pnn50 >= 20) AND rmssd >= 40 THEN 'random_scatter' WHEN n_peaks IN (2, 3) AND tight >= 0.6 AND coverage >= 0.75 AND dominance >= 0.6 THEN 'organized_av_conduction' ELSE 'undetermined' END AS pattern FROM a""",
    "ectopic_patterns": f"""WITH {V}, m AS (SELECT key, i, CASE WHEN rr % 5 < 0.5 THEN 'E' WHEN key % 2 = 0 AND i % 2 = 1 OR key % 2 = 1 AND i % 3 = 2 THEN 'E' ELSE 'N' END AS label, CASE WHEN i % 2 = 0 THEN rr ELSE rr * 2 END AS rr, count(*) OVER (PARTITION BY key) AS n FROM v), k AS (SELECT * FROM m WHERE n >= 6),
 t AS (SELECT a.key, 'bigeminy' AS pattern, a.i // 2 AS i, a.label = 'N' AND b.label = 'E' AND (a.i = 0 OR b.rr > 1.15::DOUBLE * z.rr) AS hit FROM k a JOIN k b ON a.key = b.key AND b.i = a.i + 1 LEFT JOIN k z ON z.key = a.key AND z.i = a.i - 1 WHERE a.i % 2 = 0
 UNION ALL SELECT a.key, 'trigeminy', a.i // 3, a.label = 'N' AND b.label = 'N' AND c.label = 'E' FROM k a JOIN k b ON a.key = b.key AND b.i = a.i + 1 JOIN k c ON a.key = c.key AND c.i = a.i + 2 WHERE a.i % 3 = 0),
 g AS (SELECT *, i - row_number() OVER (PARTITION BY key, pattern, hit ORDER BY i) AS g FROM t), r AS (SELECT key, pattern, hit, count(*) AS n FROM g GROUP BY key, pattern, hit, g),
 o AS (SELECT key, pattern, coalesce(sum(n) FILTER (hit), 0)::BIGINT AS matches, sum(n)::BIGINT AS total, coalesce(max(n) FILTER (hit), 0)::BIGINT AS longest, count(*) FILTER (hit AND n >= 3) AS runs FROM r GROUP BY key, pattern)
 SELECT *, matches >= 3 AND matches::DOUBLE / total >= CASE WHEN pattern = 'bigeminy' THEN 0.6 ELSE 0.5 END AS present FROM o""",
    "feature_gloss": f"""WITH p AS (SELECT p_partkey, {_PICK(['ml_direct', 'plane'], 1)} AS a, {_PICK(['V1', 'II', 'XY'], 2)} AS b, {_PICK(['P', 'QRS', 'U'], 3)} AS c, CASE WHEN p_partkey % 11 <> 0 THEN {_PICK(['amp', 'dur'], 5)} END AS d, {_PICK(['acf_lag_8', 'alternation_index_p3', 'mean', 'odd', None], 7)} AS e FROM part), n AS (SELECT p_partkey, concat_ws('::', a, b, c, d, e) AS name FROM p), s AS (SELECT *, string_split(name, '::') AS x FROM n)
 SELECT p_partkey, name, CASE WHEN len(x) < 4 THEN name ELSE concat_ws(', ', CASE WHEN x[1] = 'ml_direct' THEN 'lead ' || x[2] ELSE x[2] || ' plane' END, CASE x[3] WHEN 'P' THEN 'P wave' WHEN 'QRS' THEN 'QRS complex' ELSE x[3] END, x[4], CASE x[5] WHEN 'acf_lag_8' THEN 'autocorrelation lag 8' WHEN 'alternation_index_p3' THEN 'alternation index (period 3)' ELSE x[5] END) END AS gloss FROM s""",
    "file_names": "WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '../up/' || p_name || '.hea' WHEN 1 THEN 'C:\\x\\.nul.dat..' || p_name WHEN 2 THEN 'nul.hea' ELSE p_name END AS raw FROM part), b AS (SELECT p_partkey, regexp_replace(regexp_replace(trim(regexp_extract(replace(raw, '\\', '/'), '[^/]*$')), '[^A-Za-z0-9._-]', '_', 'g'), '^\\.+', '') AS b FROM r), s AS (SELECT p_partkey, b, regexp_extract(b, '^(.*)\\.([^.]*)$', 1) AS stem, regexp_extract(b, '^(.*)\\.([^.]*)$', 2) AS suffix FROM b) SELECT p_partkey, CASE WHEN b = '' THEN NULL WHEN NOT contains(b, '.') THEN left(b, 100) ELSE left(CASE WHEN lower(stem) = 'nul' THEN '_' || stem ELSE stem END, 100) || '.' || left(suffix, 16) END AS name FROM s",
    "code_names": "SELECT c_custkey, coalesce(lower(n_name), c_nationkey::VARCHAR) AS text FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 3 <> 0",
    "diagnosis_codes": f"WITH t(code, text) AS (VALUES " + ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in CODES.items()) + f"), k AS (SELECT {[*list(CODES)[::9], '999']!r} AS k), c AS (SELECT k[c_custkey % len(k) + 1] AS code FROM customer, k) SELECT c.code, coalesce(text, c.code) AS text, count(*) AS n FROM c LEFT JOIN t ON c.code = t.code GROUP BY ALL",
    "final_record": "SELECT p_partkey, round(p_retailprice / 7, 2) AS price, CASE WHEN p_size > 3 THEN p_size::DOUBLE END AS size, p_brand AS label, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS big, CASE WHEN p_size % 2 = 0 THEN 'Poor quality may degrade feature accuracy. Issues: ' || p_type || '.' END AS warning FROM part",
    "colours": f"WITH t AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS t, (p_partkey % 360) / 360.0::DOUBLE AS h, (p_size % 2) * 60 / 100.0::DOUBLE AS s, p_size / 100.0::DOUBLE AS l FROM part), q AS (SELECT *, CASE WHEN l < 0.5 THEN l * (1 + s) ELSE l + s - l * s END AS q, h + 1.0::DOUBLE / 3 - floor(h + 1.0::DOUBLE / 3) AS t0, h - 1.0::DOUBLE / 3 - floor(h - 1.0::DOUBLE / 3) AS t2 FROM t), c AS (SELECT *, 2 * l - q AS p FROM q) SELECT p_partkey, {_HEX(_MIX('a', 'c', 't'))} AS lerp, CASE WHEN t <= 0.5 THEN {_HEX(_MIX('a', 'b', 't * 2'))} ELSE {_HEX(_MIX('b', 'c', '(t - 0.5) * 2'))} END AS gradient, {_HEX([f'({x} + {y} + floor({z} + 0.5)) / 3' for x, y, z in zip(_RGB['a'], _RGB['b'], _MIX('b', 'c', 't'))])} AS blend, {_HEX([f'({_HUE.format(t=t)}) * 255' for t in ('t0', 'h', 't2')])} AS hsl FROM c",
    "notch_rule": "WITH l AS (SELECT l_quantity / 25 - 1 AS a, (l_partkey % 80)::DOUBLE AS gap, l_discount * 200 + 5 AS s FROM lineitem), v AS (SELECT a, gap, list_min(list_transform(range(0, 200), lambda k: abs(a * exp(-0.5 * pow(gap * k / 199.0::DOUBLE / (s + 1e-9), 2)) + a * 0.8::DOUBLE * exp(-0.5 * pow((gap * k / 199.0::DOUBLE - gap) / (s + 1e-9), 2))))) AS valley FROM l) SELECT a <> 0 AND (greatest(1e-9, abs(a * 0.8::DOUBLE)) - valley) / greatest(1e-9, abs(a * 0.8::DOUBLE)) >= 0.2 AND gap >= 20 AS notched, count(*) AS n, round(sum(gap), 2) AS gap FROM v GROUP BY 1",
    "nested_records": "SELECT l_orderkey, round(sum(round(l_extendedprice / 7, 2)::DECIMAL(18, 2))::DOUBLE, 2) AS price, round(sum(CASE WHEN l_tax <> 0 THEN round(l_tax / 3, 2) ELSE 0 END::DECIMAL(18, 2))::DOUBLE, 2) AS tax, round(sum(l_quantity) / count(*), 2) AS per_line, sum(l_quantity) > 100 AS infinite FROM lineitem GROUP BY l_orderkey",
    "region_labels": "WITH l AS (SELECT ((l_partkey * 13 + l_suppkey) % 800 - 300)::DOUBLE AS t, l_quantity * 10 + 500 AS rr FROM lineitem) SELECT CASE WHEN t BETWEEN -55 AND -45 THEN 'Late-P' WHEN t >= -50 THEN CASE WHEN t < 80 THEN 'QRS' WHEN t / rr < 0.20 THEN 'ST' WHEN t / rr < 0.26 THEN 'Early-T' WHEN t / rr < 0.40 THEN 'Normal-T' ELSE 'Late-T' END WHEN t < -210 THEN 'Early-P' WHEN t < -100 THEN 'Normal-P' ELSE 'Late-P' END AS region, count(*) AS n FROM l GROUP BY 1",
    "window_containment": "WITH l AS (SELECT l_orderkey, ((l_partkey * 13 + l_suppkey) % 800 - 300)::DOUBLE AS t FROM lineitem), o AS (SELECT o_orderkey, o_custkey % 600 + 500 AS rr FROM orders), w AS (SELECT o_orderkey, 'P' AS wave, 75 - rr / 2 AS low, -70 AS high FROM o UNION ALL SELECT o_orderkey, 'QRS', -75, 80 FROM o UNION ALL SELECT o_orderkey, 'T', 80, rr / 2 FROM o) SELECT wave, count(*) AS n, sum(t) AS total FROM l JOIN w ON l_orderkey = o_orderkey AND t BETWEEN low AND high GROUP BY wave",
    "model_choice": "WITH l AS (SELECT l_orderkey AS rec, l_linenumber - 1 AS k, l_quantity / (20 * l_linenumber) AS rss, l_linenumber * 3 - 2 AS p, (l_partkey % 50)::DOUBLE AS e, l_discount * 200 - 8 AS snr FROM lineitem WHERE l_linenumber <= 3), a AS (SELECT *, round(40 * ln(rss / 40 + 1e-12) + 2 * p + (2 * p * (p + 1)) / (39.0::DOUBLE - p), 9) AS a FROM l), w AS (SELECT rec, max(a) FILTER (k = 0) AS a0, max(a) FILTER (k = 1) AS a1, max(a) FILTER (k = 2) AS a2, max(e) FILTER (k = 1) AS e1, max(e) FILTER (k = 2) AS e2, max(snr) FILTER (k = 1) AS s1, max(snr) FILTER (k = 2) AS s2 FROM a GROUP BY rec), b AS (SELECT *, CASE WHEN coalesce(a2 + 4 < a1 OR abs(a2 + 4 - a1) <= 0.75 AND e2 < e1, a1 IS NULL AND a2 IS NOT NULL) THEN 2 ELSE 1 END AS best FROM w) SELECT rec, CASE WHEN coalesce(CASE best WHEN 2 THEN a2 ELSE a1 END + 1 < a0 AND CASE best WHEN 2 THEN s2 ELSE s1 END >= -3, false) THEN best ELSE 0 END AS k FROM b",
    "plane_projection": f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT vec_id, {_DOT(K.LIMB[0], 1)} AS lx, {_DOT(K.LIMB[1], 1)} AS ly, {_DOT(K.CHEST[0], 7)} AS cx, {_DOT(K.CHEST[1], 7)} AS cz FROM v) SELECT vec_id, round(lx, 5) AS lx, round(ly, 5) AS ly, round(sqrt(lx * lx + ly * ly), 5) AS lmag, round(degrees(atan2(ly, lx)), 5) AS langle, round(cx, 5) AS cx, round(cz, 5) AS cz, round(sqrt(cx * cx + cz * cz), 5) AS cmag, round(degrees(atan2(cz, cx)), 5) AS cangle FROM p",
    "direction_vectors": "WITH p AS (SELECT p_partkey, radians(p_size * 7.0::DOUBLE) AS a, radians(p_partkey % 180 - 90.0::DOUBLE) AS b FROM part), v AS (SELECT p_partkey, round(cos(b) * cos(a), 6) + 0.0::DOUBLE AS vx, round(cos(b) * sin(a), 6) + 0.0::DOUBLE AS vy, round(sin(b), 6) + 0.0::DOUBLE AS vz FROM p) SELECT * FROM v",
    "spacing_prune": "WITH RECURSIVE s AS (SELECT l_orderkey AS k, max(l_partkey) AS p FROM lineitem GROUP BY 1 UNION ALL SELECT s.k, max(l.l_partkey) AS p FROM s JOIN lineitem l ON l.l_orderkey = s.k AND l.l_partkey <= s.p - 300 GROUP BY s.k, s.p) SELECT k AS l_orderkey, count(*)::INT AS n, string_agg(p::VARCHAR, ',' ORDER BY p) AS kept FROM s GROUP BY k",
    "generic_counts": "SELECT lang, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'private' ELSE source END AS source, count(*) AS n FROM documents GROUP BY 1, 2",
    "rounded_payload": "WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x, 4)) AS s FROM embeddings) SELECT vec_id, len(s)::INT AS n, round(list_sum(s), 4) AS total, s[1] AS first FROM s",
    "unexpected_columns": " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count({c}) AS filled FROM orders" for c in ("o_orderdate", "o_orderpriority", "o_totalprice")),
    "ordered_counts": "WITH c AS (SELECT CASE WHEN source IN ('src5', 'src6') THEN 'unmapped' ELSE source END AS source, count(*) AS n FROM documents GROUP BY 1) SELECT row_number() OVER (ORDER BY source = 'unmapped', n DESC, source) AS place, source, n FROM c",
    "double_index": "WITH b AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) SELECT c_custkey, b.o_orderkey, o.o_totalprice FROM customer LEFT JOIN b ON b.o_custkey = c_custkey LEFT JOIN orders o ON o.o_orderkey = b.o_orderkey",
    "path_index": "SELECT doc_id, coalesce(url, '') AS path, url IS NULL AS missing FROM documents LEFT JOIN pages ON page_id = doc_id WHERE source IN ('src0', 'src1')",
}

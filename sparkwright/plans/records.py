"""Catalog, label algebra, statements, publication and chats on the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions import labels as L
from sparkwright.operators import catalog as C
from sparkwright.operators import governance as G
from sparkwright.operators.sequences import newest_within
from sparkwright.session import table


def records(spark, d: str) -> DataFrame:
    """(id, source, labels, primary, n_chars) of the documents; labels come from the label table and the language."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang", "n_chars")
    marks = table(spark, d, "labels").withColumnRenamed("doc_id", "id")
    named = F.array_compact(F.array(F.when(F.col("quality") == 1, "Good"), F.when(F.col("quality") == 0, "Poor"), F.when(F.col("toxic") == 1, "Toxic")))
    return docs.join(marks, "id", "left").select("id", "source", named.alias("labels"), F.col("lang").alias("primary"), "n_chars")


def order_sets(spark, d: str) -> DataFrame:
    """(o, gold, preds): return flags and line states of an order as label sets, and another reading of them."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity")
    gold = F.array_sort(F.collect_set("l_returnflag"))
    preds = F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 15, F.col("l_returnflag"))))
    return li.groupBy(F.col("l_orderkey").alias("o")).agg(gold.alias("gold"), preds.alias("preds"), F.array_sort(F.collect_set("l_linestatus")).alias("states"))


STATEMENTS = [
    "Sinus rhythm.", "Supraventricular tachycardia.", "RBBB and left anterior fascicular block", "Ventricular  tachycardia", "Possible inferior infarct - age undetermined",
    "Cannot rule out anterior infarct", "ST elevation, consider acute infarct", "ST depression, consider inferior injury", "Early repolarization with ST elevation",
    "Normal ECG", "Abnormal ECG", "Data quality may affect interpretation", "No other finding", "Atrial fibrillation with rapid response", "PVC(s)",
    "1st degree A-V block", "Left axis deviation", "Probably normal variant?", "T wave changes are normal for age", "Low QRS voltages in precordial leads", "Prolonged QT interval", "3:1 A-V block with atrial flutter", "something else",
]
RAW_LABELS = ["Normal ECG", "2nd av-block", "WPW syndrome", "**STEMI**", "afib 12", "Left_Axis Deviation (mild)", "LVEF <40%", "unknown thing", "vt", "  LVH  ", "45123456", "nsr"]


def statements(spark, d: str) -> DataFrame:
    values = F.array(*[F.lit(s) for s in STATEMENTS])
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("cohort"))
    return rows.withColumn("raw", F.element_at(values, (F.col("id") % len(STATEMENTS) + 1).cast("int"))).withColumn("s", L.normalise_statement(F.col("raw")))


def raw_labels(spark, d: str) -> DataFrame:
    values = F.array(*[F.lit(s) for s in RAW_LABELS])
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return rows.withColumn("raw", F.element_at(values, (F.col("id") % len(RAW_LABELS) + 1).cast("int")))


def catalog_search(spark, d):
    return C.search(records(spark, d), "SRC3", "good", "3").select("id", "source", F.array_join("labels", ";").alias("labels"))


def catalog_page(spark, d):
    return C.page(records(spark, d).select("id", "source", "n_chars"), ["source", "id"], 50, 25)


def source_counts(spark, d):
    return records(spark, d).groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


def label_vocabulary(spark, d):
    return records(spark, d).select(F.explode("labels").alias("label")).distinct()


def suggestions(spark, d):
    """The first eight parts, in order of key, whose name, brand or type holds a text (a report's limit)."""
    p = table(spark, d, "part")
    hit = reduce(lambda a, b: a | b, [F.lower(c).contains("bo") for c in ("p_name", "p_brand", "p_type")])
    return p.where(hit).orderBy("p_partkey").limit(8).select("p_partkey", "p_name", "p_type")


def highlighted_filter(spark, d):
    return order_sets(spark, d).where(C.single_filter(F.col("gold"), highlighted="R")).select("o", F.array_join("gold", ";").alias("gold"))


def filled_filter(spark, d):
    return order_sets(spark, d).where(C.single_filter(F.col("preds"), filled=["A", "N"])).select("o", F.array_join("preds", ";").alias("preds"))


def multi_label_filter(spark, d):
    items = [("A", "filled", 5), ("R", "filled", 3), ("N", "highlighted", 9)]
    return order_sets(spark, d).where(C.group_filter(F.col("gold"), items, {("A", "R"): "and", ("R", "N"): "or"})).select("o", F.array_join("gold", ";").alias("gold"))


def exclusive_filter(spark, d):
    items = [("A", "filled", 5), ("N", "filled", 3)]
    return order_sets(spark, d).where(C.group_filter(F.col("gold"), items, {})).select("o", F.array_join("gold", ";").alias("gold"))


def label_union(spark, d):
    return order_sets(spark, d).select("o", F.array_join(F.array_sort(F.array_union("preds", "states")), ";").alias("labels"))


def label_gain(spark, d):
    """Recovered labels that are new in any case, without summary labels."""
    s = order_sets(spark, d)
    low = F.transform("preds", lambda x: F.lower(x))
    new = F.filter("gold", lambda x: ~F.array_contains(low, F.lower(x)) & (x != "N"))
    return s.select("o", F.array_join(F.array_sort(new), ";").alias("new")).where("new <> ''")


def exact_set_match(spark, d):
    scored = F.array(F.lit("A"), F.lit("N"))
    hit = C.exact_match(F.col("gold"), F.col("preds"), scored)
    return order_sets(spark, d).agg(F.count("*").alias("n"), F.count_if(hit).alias("matched"), F.round(F.avg(hit.cast("int")), 6).alias("rate"))


def error_buckets(spark, d):
    bucket = C.error_bucket(F.col("gold"), F.col("preds"), F.array(F.lit("A"), F.lit("N")))
    return order_sets(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def set_differences(spark, d):
    j = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ";")
    return order_sets(spark, d).select("o", j("preds", "gold").alias("fp"), j("gold", "preds").alias("fn"), F.array_join(F.array_intersect("gold", "preds"), ";").alias("tp"))


def modal_label(spark, d):
    return C.modal(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("v")), "k", "v")


def modal_regrouped(spark, d):
    return modal_label(spark, d).groupBy("v").agg(F.count("*").alias("groups"), F.sum("n").alias("total"))


def folded_counts(spark, d):
    return C.folded_counts(table(spark, d, "documents"), "source", ["src1", "src2", "src3"])


def manifest_last_wins(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("k"), F.col("l_linenumber").cast("long").alias("pos"), "l_partkey")
    keyed = li.withColumn("k", F.when(F.col("l_partkey") % 50 == 0, F.lit("  ")).otherwise(F.col("k")))
    order = F.struct("pos", "l_partkey")
    out = keyed.where(F.trim("k") != "").groupBy("k").agg(F.max(order).alias("m"))
    return out.select("k", F.col("m.pos").alias("pos"), F.col("m.l_partkey").alias("l_partkey"))


def manifest_left_join(spark, d):
    """Orders as a manifest, left joined to customers: a blank name gives way to the order's own status."""
    left = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("name"))
    right = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment")).alias("name"))
    return C.fill_from(left, right, "k", ["name"]).groupBy("name").agg(F.count("*").alias("n"))


def integrity_join(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("p"))
    b = table(spark, d, "lineitem").where("l_linenumber = 1 and l_orderkey % 7 <> 0").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("p"))
    return C.integrity(a, b, "o_orderkey", "p")


def anti_missing(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(table(spark, d, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


def semi_scored(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    hot = table(spark, d, "lineitem").where("l_discount > 0.09 and l_quantity > 48").select("l_suppkey")
    return s.join(hot, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")


def duplicate_keys(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


def set_operations(spark, d):
    """Keys of two readings: how many in the union, in both, and in the first only."""
    a = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "k", "full_outer")
    return both.agg(F.count("*").alias("either"), F.count_if("a = 1 and b = 1" if False else (F.col("a").isNotNull() & F.col("b").isNotNull())).alias("common"), F.count_if(F.col("b").isNull()).alias("only_first"))


def statement_normalise(spark, d):
    return statements(spark, d).groupBy("raw", "s").agg(F.count("*").alias("n"))


def rule_mapping(spark, d):
    return L.map_statements(statements(spark, d)).select("id", F.array_join("labels", ";").alias("labels"), "disposition")


def coverage_rollup(spark, d):
    s = L.map_statements(statements(spark, d))
    return s.rollup("disposition", "cohort").agg(F.count("*").alias("n")).where("disposition is not null").select("disposition", F.coalesce("cohort", F.lit("all")).alias("cohort"), "n")


def hedge_sensitivity(spark, d):
    s = L.map_statements(statements(spark, d)).withColumn("hedged", F.col("s").rlike(L.HEDGE))
    out = s.agg(F.count("*").alias("n"), F.count_if("hedged").alias("hedged"), F.sum(F.size("labels")).alias("labels"), F.sum(F.when(~F.col("hedged"), F.size("labels"))).alias("kept"))
    return out.select("n", "hedged", "labels", "kept", F.round(F.col("kept") / F.col("labels"), 6).alias("share"))


def canonical_label(spark, d):
    return raw_labels(spark, d).select("raw", L.canonical(F.col("raw")).alias("name")).groupBy("raw", "name").agg(F.count("*").alias("n"))


def severity_primary(spark, d):
    """Labels of ten consecutive orders as one record: canonical names and the most severe."""
    r = raw_labels(spark, d).groupBy(F.floor(F.col("id") / 10).alias("g")).agg(F.collect_list("raw").alias("raws"))
    named = r.withColumn("names", L.canonical_all(F.col("raws")))
    return named.select("g", F.array_join("names", ";").alias("names"), L.primary_label(F.col("names")).alias("primary"))


def string_hashes(spark, d):
    h = L.string_hash(F.col("n_name"))
    return table(spark, d, "nation").select("n_name", h.alias("hash"), (F.abs(h) % 12).alias("colour"), L.slug(F.col("n_name")).alias("slug"))


def scrub_rows(spark, d):
    r = records(spark, d).withColumn("labels", F.concat("labels", F.array(F.lit("__cohort__"))))
    out = G.scrub(r, ["n_chars"], ["src0", "src1"])
    return out.groupBy("source").agg(F.count("*").alias("n"), F.count("id").alias("ids"), F.sum(F.size("labels")).alias("labels"))


def audit_violations(spark, d):
    r = records(spark, d)
    return G.audit([("no labels", r.where("size(labels) = 0 and n_chars > 12000").select("id")), ("too short", r.where("n_chars < 20").select("id"))])


def allowlist_paths(spark, d):
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    rows = table(spark, d, "documents").select("source", "lang", path.alias("path"))
    return rows.where(G.path_allowed(F.col("path"), ["src1", "src2", "src4"], ["/de", "99"])).select("path")


def url_host_rules(spark, d):
    return table(spark, d, "pages").select(G.host_of(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("n"))


def identifier_scan(spark, d):
    return G.identifier_lines(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").groupBy("doc_id").agg(F.count("*").alias("lines"))


def source_classes(spark, d):
    kind = G.source_class(F.col("source"), {"src0": "open", "src1": "mimic", "src2": "private"})
    return table(spark, d, "documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def history_truncation(spark, d):
    """The newest turns of each conversation within 200 tokens of three characters."""
    c = table(spark, d, "conversations").withColumn("i", F.col("turn"))
    return newest_within(c, F.floor(F.length("text") / 3), 200, "conv_id").select("conv_id", "turn", F.col("used").cast("long").alias("used"))


def role_filter(spark, d):
    out = G.chat_guard(table(spark, d, "conversations"), ["user", "assistant"])
    return out.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


def think_split(spark, d):
    """The first twenty characters of each text as thought, all the others as answer."""
    marked = F.concat(F.lit("<think>"), F.substring("text", 1, 20), F.lit("</think>"), F.expr("substring(text, 21)"))
    answer, inside = G.split_think(marked)
    return table(spark, d, "conversations").select("conv_id", "turn", answer.alias("answer"), inside.alias("thought"))


def signal_validation(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 4 == 0, 3).otherwise(12).alias("leads"), (F.col("p_size") * 50).alias("rate"), (F.col("p_retailprice") / 10).alias("seconds"))
    ok = G.signal_valid(F.col("leads"), F.col("rate"), F.col("seconds"))
    return p.groupBy(ok.alias("ok"), (F.col("rate") == 500).alias("standard")).agg(F.count("*").alias("n"))


def export_points(spark, d):
    return records(spark, d).select("id", F.array_join("labels", ";").alias("labels"), F.col("primary").alias("cohort")).where("labels <> ''")


def top_counts(spark, d):
    """The ten most frequent words of all texts, ties by word (a report's limit)."""
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(10)


QUERIES = {f.__name__: f for f in (
    catalog_search, catalog_page, source_counts, label_vocabulary, suggestions, highlighted_filter, filled_filter, multi_label_filter,
    exclusive_filter, label_union, label_gain, exact_set_match, error_buckets, set_differences, modal_label, modal_regrouped, folded_counts,
    manifest_last_wins, manifest_left_join, integrity_join, anti_missing, semi_scored, duplicate_keys, set_operations, statement_normalise,
    rule_mapping, coverage_rollup, hedge_sensitivity, canonical_label, severity_primary, string_hashes, scrub_rows, audit_violations,
    allowlist_paths, url_host_rules, identifier_scan, source_classes, history_truncation, role_filter, think_split, signal_validation,
    export_points, top_counts,
)}


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _re(pattern: str) -> str:
    return "'" + pattern.replace("(?<!supra)", "").replace("(?<!st-)", "").replace("'", "''") + "'"


def _rule(pattern: str, labels: list[str], unless: str | None) -> str:
    """A rule without look-behind: where the pattern has one, what it forbids is masked in the text first."""
    text = "replace(replace(s, 'supraventricular', 'supra_'), 'st-t changes', 'st-_')" if "(?<!" in pattern else "s"
    alone = [p for p in pattern.split("|") if "(?<!" in p]
    rest = [p for p in pattern.split("|") if "(?<!" not in p]
    if alone and rest and "(bi" not in pattern:
        test = f"(regexp_matches({text}, {_re('|'.join(alone))}) OR regexp_matches(s, {_re('|'.join(rest))}))"
    else:
        test = f"regexp_matches({text}, {_re(pattern)})"
    block = f" AND NOT regexp_matches(s, {_re(unless)})" if unless else ""
    return f"CASE WHEN {test}{block} THEN {_quoted(labels)}::VARCHAR[] ELSE []::VARCHAR[] END"


R = """r AS (SELECT d.doc_id AS id, d.source, list_filter([CASE WHEN quality = 1 THEN 'Good' END, CASE WHEN quality = 0 THEN 'Poor' END, CASE WHEN toxic = 1 THEN 'Toxic' END], lambda x: x IS NOT NULL) AS labels, d.lang AS "primary", d.n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
O = "os AS (SELECT l_orderkey AS o, list_sort(list(DISTINCT l_returnflag)) AS gold, list_sort(coalesce(list(DISTINCT l_returnflag) FILTER (l_quantity > 15), [])) AS preds, list_sort(list(DISTINCT l_linestatus)) AS states FROM lineitem GROUP BY l_orderkey)"
_ST = f"""st AS (SELECT o_orderkey AS id, o_orderstatus AS cohort, {_quoted(STATEMENTS)}[o_orderkey % {len(STATEMENTS)} + 1] AS raw FROM orders),
 sn AS (SELECT *, trim(regexp_replace(lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))), '\\.+$', '')) AS s FROM st)"""
_RULES = ", ".join(_rule(*r) for r in L.RULES)
_MAP = f"""WITH {_ST}, u AS (SELECT DISTINCT s FROM sn), a AS (SELECT s, list_distinct(flatten([{_RULES}])) AS l FROM u),
 b AS (SELECT s, CASE WHEN regexp_matches(s, 'early repol') THEN list_concat(list_filter(l, lambda x: x <> 'st deviation'), ['early repolarization']) ELSE l END AS l FROM a),
 c AS (SELECT s, CASE WHEN regexp_matches(s, {_re(L.ACUTE)}) AND NOT regexp_matches(s, {_re(L.ACUTE_BLOCK)}) THEN list_concat(l, CASE WHEN contains(s, 'st elevation') OR contains(s, 'st elev') THEN ['myocardial infarction', 'STEMI'] WHEN contains(s, 'st depression') THEN ['myocardial infarction', 'nstemi'] ELSE ['myocardial infarction'] END) ELSE l END AS l FROM b),
 e AS (SELECT s, list_sort(list_distinct(CASE WHEN list_contains(l, 'right bundle branch block') AND (list_contains(l, 'left anterior fascicular block') OR list_contains(l, 'left posterior fascicular block')) THEN list_append(l, 'bifascicular block') ELSE l END)) AS l FROM c),
 m AS (SELECT s, l, CASE WHEN len(l) > 0 THEN 'labelled' WHEN regexp_matches(s, {_re(L.NO_FINDING)}) THEN 'no-finding' WHEN regexp_matches(s, {_re(L.TECHNICAL)}) THEN 'technical' ELSE 'unmapped' END AS disposition FROM e), x AS (SELECT sn.*, m.l, m.disposition FROM sn JOIN m ON sn.s = m.s)"""
_PAIRS = ", ".join(f"('{k}', '{v}')" for k, v in (L.CANONICAL | {n: "sinus rhythm" for n in L.NORMAL} | L.MERGES).items())
_CANON = f"""WITH canon(k, v) AS (VALUES {_PAIRS}), raw AS (SELECT o_orderkey AS id, {_quoted(RAW_LABELS)}[o_orderkey % {len(RAW_LABELS)} + 1] AS raw FROM orders),
 low AS (SELECT id, raw, trim(regexp_replace(trim(regexp_replace(translate(trim(lower(regexp_replace(trim(replace(raw, '**', '')), '\\s+\\d+(\\s+\\d+)?$', ''))), '-_', '  '), '\\s+', ' ', 'g')), '\\s*\\([^)]*\\)\\s*$', '')) AS low FROM raw),
 cn AS (SELECT id, raw, v AS name FROM low LEFT JOIN canon ON low = k)"""
_SEV = "[" + ", ".join("'" + s.lower().replace("'", "''") + "'" for s in L.SEVERITY) + "]"
_J = "list_aggregate({}, 'string_agg', ';')"
_JS = lambda e: f"array_to_string({e}, ';')"
_BUCKET = "CASE WHEN len(list_filter(preds, lambda x: NOT list_contains(own, x))) > 0 AND len(list_filter(own, lambda x: NOT list_contains(preds, x))) > 0 THEN 'both' WHEN len(list_filter(preds, lambda x: NOT list_contains(own, x))) > 0 THEN 'over' WHEN len(list_filter(own, lambda x: NOT list_contains(preds, x))) > 0 THEN 'missed' ELSE 'match' END"

ORACLES = {
    "catalog_search": f"WITH {R} SELECT id, source, {_JS('labels')} AS labels FROM r WHERE lower(source) = 'src3' AND (list_contains(labels, 'Good') OR lower(\"primary\") = 'good') AND contains(id::VARCHAR, '3')",
    "catalog_page": f"WITH {R} SELECT id, source, n_chars FROM r ORDER BY source, id LIMIT 25 OFFSET 50",
    "source_counts": f"WITH {R} SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM r GROUP BY 1",
    "label_vocabulary": f"WITH {R} SELECT DISTINCT unnest(labels) AS label FROM r",
    "suggestions": "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'bo') OR contains(lower(p_brand), 'bo') OR contains(lower(p_type), 'bo') ORDER BY p_partkey LIMIT 8",
    "highlighted_filter": f"WITH {O} SELECT o, {_JS('gold')} AS gold FROM os WHERE list_contains(gold, 'R')",
    "filled_filter": f"WITH {O} SELECT o, {_JS('preds')} AS preds FROM os WHERE len(list_filter(preds, lambda x: x NOT IN ('A', 'N'))) = 0",
    "multi_label_filter": f"WITH {O} SELECT o, {_JS('gold')} AS gold FROM os WHERE list_contains(gold, 'A') AND list_contains(gold, 'R') AND len(gold) = 2 OR list_contains(gold, 'N')",
    "exclusive_filter": f"WITH {O} SELECT o, {_JS('gold')} AS gold FROM os WHERE gold = ['A'] OR gold = ['N']",
    "label_union": f"WITH {O} SELECT o, {_JS('list_sort(list_distinct(list_concat(preds, states)))')} AS labels FROM os",
    "label_gain": f"WITH {O} SELECT o, {_JS('list_filter(gold, lambda x: NOT list_contains(preds, x) AND x <> chr(78))')} AS new FROM os WHERE len(list_filter(gold, lambda x: NOT list_contains(preds, x) AND x <> 'N')) > 0",
    "exact_set_match": f"WITH {O}, h AS (SELECT list_filter(gold, lambda x: x IN ('A', 'N')) = preds AS hit FROM os) SELECT count(*) AS n, count(*) FILTER (hit) AS matched, round(avg(hit::INT), 6) AS rate FROM h",
    "error_buckets": f"WITH {O}, h AS (SELECT list_filter(gold, lambda x: x IN ('A', 'N')) AS own, preds FROM os) SELECT {_BUCKET} AS bucket, count(*) AS n FROM h GROUP BY 1",
    "set_differences": f"WITH {O} SELECT o, {_JS('list_filter(preds, lambda x: NOT list_contains(gold, x))')} AS fp, {_JS('list_filter(gold, lambda x: NOT list_contains(preds, x))')} AS fn, {_JS('list_filter(gold, lambda x: list_contains(preds, x))')} AS tp FROM os",
    "modal_label": "WITH c AS (SELECT l_suppkey AS k, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL) SELECT k, v, n FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, v) = 1",
    "modal_regrouped": "WITH c AS (SELECT l_suppkey AS k, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT k, v, n FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, v) = 1) SELECT v, count(*) AS groups, sum(n)::BIGINT AS total FROM m GROUP BY v",
    "folded_counts": "SELECT CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'private' ELSE coalesce(source, 'unknown') END AS source, count(*) AS n FROM documents GROUP BY 1",
    "manifest_last_wins": "WITH k AS (SELECT CASE WHEN l_partkey % 50 = 0 THEN '  ' ELSE l_orderkey::VARCHAR END AS k, l_linenumber::BIGINT AS pos, l_partkey FROM lineitem) SELECT k, pos, l_partkey FROM k WHERE trim(k) <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos DESC, l_partkey DESC) = 1",
    "manifest_left_join": "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_mktsegment END AS name FROM customer WHERE c_custkey % 3 <> 0) SELECT coalesce(nullif(trim(c.name), ''), o.o_orderstatus) AS name, count(*) AS n FROM orders o LEFT JOIN c ON o.o_custkey = c.c_custkey GROUP BY 1",
    "integrity_join": "WITH b AS (SELECT l_orderkey AS k, l_suppkey AS p FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 7 <> 0), j AS (SELECT o.o_orderkey AS a, o.o_custkey AS p, b.k, b.p AS q FROM orders o FULL JOIN b ON o.o_orderkey = b.k) SELECT count(*) FILTER (k IS NULL) AS missing, count(*) FILTER (a IS NULL) AS extra, count(*) FILTER (a IS NOT NULL AND k IS NOT NULL AND p IS DISTINCT FROM q) AS differ, (SELECT count(*) FROM (SELECT k FROM b GROUP BY k HAVING count(*) > 1)) AS repeated FROM j",
    "anti_missing": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "semi_scored": "SELECT s_suppkey, s_nationkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09 AND l_quantity > 48)",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "set_operations": "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT (SELECT count(*) FROM (FROM a UNION FROM b)) AS either, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS common, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_first",
    "statement_normalise": f"WITH {_ST} SELECT raw, s, count(*) AS n FROM sn GROUP BY ALL",
    "rule_mapping": _MAP + f" SELECT id, {_JS('l')} AS labels, disposition FROM x",
    "coverage_rollup": _MAP + " SELECT disposition, coalesce(cohort, 'all') AS cohort, count(*) AS n FROM x GROUP BY GROUPING SETS ((disposition, cohort), (disposition))",
    "hedge_sensitivity": _MAP + f", h AS (SELECT regexp_matches(s, {_re(L.HEDGE)}) AS hedged, len(l) AS k FROM x) SELECT count(*) AS n, count(*) FILTER (hedged) AS hedged, sum(k)::BIGINT AS labels, sum(k) FILTER (NOT hedged)::BIGINT AS kept, round(sum(k) FILTER (NOT hedged)::DOUBLE / sum(k), 6) AS share FROM h",
    "canonical_label": _CANON + " SELECT raw, name, count(*) AS n FROM cn GROUP BY ALL",
    "severity_primary": _CANON + f", g AS (SELECT id // 10 AS g, list_sort(coalesce(list(DISTINCT name) FILTER (name IS NOT NULL), [])) AS names FROM cn GROUP BY 1), u AS (SELECT g, unnest(names) AS x FROM g), b AS (SELECT g, x FROM u WHERE lower(x) NOT IN ({', '.join(repr(m) if chr(39) not in m else chr(39) + m.replace(chr(39), chr(39) * 2) + chr(39) for m in L.MARKERS)}) QUALIFY row_number() OVER (PARTITION BY g ORDER BY coalesce(list_position({_SEV}, lower(x)), 999), lower(x)) = 1) SELECT g.g, {_JS('names')} AS names, coalesce(x, 'unknown') AS \"primary\" FROM g LEFT JOIN b ON g.g = b.g",
    "string_hashes": "WITH h AS (SELECT n_name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: ((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS hash FROM nation) SELECT n_name, hash, abs(hash) % 12 AS colour, trim(regexp_replace(lower(trim(n_name)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM h",
    "scrub_rows": f"WITH {R}, s AS (SELECT CASE WHEN source IN ('src0', 'src1') THEN source ELSE 'private' END AS source, CASE WHEN source IN ('src0', 'src1') THEN id END AS id, len(labels) AS k FROM r) SELECT source, count(*) AS n, count(id) AS ids, sum(k)::BIGINT AS labels FROM s GROUP BY source",
    "audit_violations": f"WITH {R}, v AS (SELECT 'no labels' AS rule, id::VARCHAR AS key FROM r WHERE len(labels) = 0 AND n_chars > 12000 UNION ALL SELECT 'too short', id::VARCHAR FROM r WHERE n_chars < 20) SELECT * FROM v ORDER BY rule, key LIMIT 21",
    "allowlist_paths": "WITH p AS (SELECT source, source || '/' || lang || '/' || doc_id AS path FROM documents) SELECT path FROM p WHERE split_part(path, '/', 1) IN ('src1', 'src2', 'src4') AND NOT contains(lower(path), '/de') AND NOT contains(path, '99')",
    "url_host_rules": "SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
    "identifier_scan": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines FROM l WHERE regexp_matches(line, {_re(G.IDENTIFIER)}) GROUP BY doc_id",
    "source_classes": "SELECT CASE lower(source) WHEN 'src0' THEN 'open' WHEN 'src1' THEN 'mimic' WHEN 'src2' THEN 'private' ELSE 'unknown' END AS kind, count(*) AS n FROM documents GROUP BY 1",
    "history_truncation": "WITH u AS (SELECT conv_id, turn, sum(length(text) // 3) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS used FROM conversations) SELECT * FROM u WHERE used <= 200",
    "role_filter": "WITH c AS (SELECT conv_id, turn, role, left(trim(text), 8000) AS t FROM conversations WHERE role IN ('user', 'assistant')) SELECT conv_id, turn, role, length(t) AS n FROM c WHERE t <> ''",
    "think_split": "SELECT conv_id, turn, substr(text, 21) AS answer, substr(text, 1, 20) AS thought FROM conversations",
    "signal_validation": "WITH p AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 3 ELSE 12 END AS leads, p_size * 50 AS rate, p_retailprice / 10 AS seconds FROM part) SELECT leads = 12 AND rate BETWEEN 50 AND 2000 AND seconds BETWEEN 2 AND 120 AS ok, rate = 500 AS standard, count(*) AS n FROM p GROUP BY ALL",
    "export_points": f"WITH {R} SELECT id, {_JS('labels')} AS labels, \"primary\" AS cohort FROM r WHERE len(labels) > 0",
    "top_counts": "WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 10",
}

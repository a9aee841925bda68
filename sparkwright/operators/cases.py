"""Cases: the ordered point filter of a viewer, rules over called classes, joins of affected records, beat variability,
interval signatures, and what a brief or a final record is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.functions.signals import CHEST_PLANE, LIMB_PLANE
from sparkwright.operators import catalog as C
from sparkwright.operators import sequences as Q


def tribe_filter(tribes: Column, selected: list[str], show_none: bool) -> Column:
    """Any of the selected tribes; an empty selection passes all; rows without tribes pass if `show_none`."""
    if not selected:
        return F.lit(True)
    own = F.coalesce(tribes, F.array().cast("array<string>"))
    return F.when(F.size(own) == 0, F.lit(show_none)).otherwise(F.arrays_overlap(own, F.array(*[F.lit(t) for t in selected])))


def viewer_points(
    points: DataFrame, cohorts: list[str] = (), tribes: list[str] = (), show_no_tribes: bool = True, highlighted: list[str] = (), filled: list[str] = (),
    operators: dict[tuple[str, str], str] | None = None, predicate: Column | None = None, show_supplements: bool = True, cross_validated: bool = False,
) -> DataFrame:
    """Points (cohort, tribes, labels, supplement, ...) that pass the viewer's filters, in this order: cohort (not for
    cross-validated points), tribe, diagnosis, predicate, supplement. Two or more diagnoses are put in order by their counts
    among the points that passed so far; only these counts, one for each selected diagnosis, are read."""
    out = points
    if cohorts and not cross_validated:
        out = out.where(F.col("cohort").isin(list(cohorts)))
    out = out.where(tribe_filter(F.col("tribes"), list(tribes), show_no_tribes))
    chosen = [(x, "filled") for x in filled] + [(x, "highlighted") for x in highlighted]
    if len(chosen) == 1:
        out = out.where(C.single_filter(F.col("labels"), highlighted[0] if highlighted else None, list(filled)))
    elif chosen:
        has = lambda x: F.sum(F.size(F.filter("labels", lambda y: y == x)))
        counts = out.agg(*[F.coalesce(has(x), F.lit(0)).alias(f"n{i}") for i, (x, _) in enumerate(chosen)]).first()
        items = [(x, state, counts[f"n{i}"]) for i, (x, state) in enumerate(chosen)]
        out = out.where(C.group_filter(F.col("labels"), items, operators or {}))
    if predicate is not None:
        out = out.where(predicate)
    return out if show_supplements else out.where(~F.col("supplement"))


def state_after(presses: Column) -> Column:
    """State of a label's filter after so many presses: off, highlighted, filled, highlighted again, off."""
    return F.element_at(F.array(*[F.lit(s) for s in ("off", "highlighted", "filled", "highlighted")]), (presses % 4 + 1).cast("int"))


#: The leads that give a rate, the first that counted beats first.
RATE_LEADS = ("II", "V2", "I", "V5")


def rate_estimate(beats: dict[str, Column], seconds: Column) -> Column:
    """Beats a minute by the first lead that counted any; null without a duration."""
    usable = [F.when(beats[x] > 0, beats[x]) for x in RATE_LEADS if x in beats]
    return F.when(seconds > 0, F.coalesce(*usable) / seconds * 60)


#: Families of classes.
SINUS = ["sinus rhythm", "sinus bradycardia", "sinus tachycardia", "sinus irregularity"]
OTHER_RHYTHMS = [
    "atrial fibrillation", "atrial flutter", "pacing rhythm", "junctional rhythm", "idioventricular rhythm", "ventricular tachycardia",
    "ventricular fibrillation", "supraventricular tachycardia", "asystole", "2nd av-block", "3rd av-block",
]
RHYTHMS = SINUS + OTHER_RHYTHMS
EXCLUSIVE = {
    "rhythm": RHYTHMS,
    "st_segment": ["st depression", "st elevation", "st deviation"],
    "axis": ["axis left shift", "axis right shift"],
    "block": [
        "left bundle branch block", "right bundle branch block", "left bundle branch block / variations", "incomplete left bundle branch block",
        "incomplete right bundle branch block",
    ],
}
FIBRILLATION = ["atrial fibrillation", "atrial flutter"]
INFARCTS = ["STEMI", "nstemi", "myocardial infarction", "old myocardial infarction"]
RATES = ["tachycardia", "bradycardia"]


def threshold_ratio(p: Column, threshold: Column) -> Column:
    return p / F.when(threshold > 0, threshold).otherwise(0.5)


def case_rules(scores: DataFrame, rates: DataFrame) -> DataFrame:
    """(rec, rule, priority, classes) of the rules that apply to each recording's called classes, from scores (rec, class, p,
    threshold) and rates (rec, rate). Higher priorities come first: fibrillation with flutter 120, infarcts 110, exclusive
    groups 100 and the largest ratio, a rate that contradicts the calls 95 (60 if it agrees), no rhythm 90."""
    ratio = F.round(threshold_ratio(F.col("p"), F.col("threshold")), 6)
    called = F.array_compact(F.collect_list(F.when(F.col("p") >= F.coalesce(F.nullif("threshold", F.lit(0.0)), F.lit(0.5)), F.struct((-ratio).alias("r"), F.col("class")))))
    cases = scores.groupBy("rec").agg(F.array_sort(called).alias("calls")).join(rates, "rec", "left")
    names = F.transform("calls", lambda c: c["class"])
    of = lambda family: F.filter(names, lambda x: x.isin(family))
    members_of = lambda family: F.filter("calls", lambda c: c["class"].isin(family))
    none = F.array().cast("array<string>")
    found = []

    def rule(name: str, when: Column, priority: Column, classes: Column) -> None:
        found.append(F.when(when, F.struct(F.lit(name).alias("rule"), priority.cast("double").alias("priority"), classes.alias("classes"))))

    for group, members in EXCLUSIVE.items():
        own = members_of(members)
        clash = F.size(own) >= 2
        if group == "rhythm":  # the pair has a rule of its own
            clash = clash & F.exists(own, lambda c: ~c["class"].isin(FIBRILLATION))
        rule(f"mutex::{group}", clash, 100 - F.element_at(own, 1)["r"], F.transform(own, lambda c: c["class"]))
    rule("rule::af-flutter", F.size(of(FIBRILLATION)) == 2, F.lit(120), F.array(*[F.lit(x) for x in FIBRILLATION]))
    rule("rule::mi-family", F.size(of(INFARCTS)) > 0, F.lit(110), F.array_sort(of(INFARCTS)))
    rule("rule::rhythm-coverage", F.size(of(RHYTHMS)) == 0, F.lit(90), none)
    sinus, rate_calls = of(SINUS), of(RATES)
    slow, fast = F.col("rate") < 60, F.col("rate") > 100
    agree = (slow & F.arrays_overlap(names, F.array(F.lit("sinus bradycardia"), F.lit("bradycardia")))) | (fast & F.arrays_overlap(names, F.array(F.lit("sinus tachycardia"), F.lit("tachycardia"))))
    agree = agree | (~slow & ~fast & ~F.exists(names, lambda x: x.isin("sinus bradycardia", "sinus tachycardia", *RATES)))
    said = F.concat(F.array_sort(sinus), F.array_sort(rate_calls))
    rule("rule::rate-consistency", F.col("rate").isNotNull() & (F.size(said) > 0), F.when(agree, 60).otherwise(95), said)
    return cases.select("rec", F.inline(F.array_compact(F.array(*found))))


def affected_records(affected: DataFrame, rows: DataFrame, reports: DataFrame, order: str = "i") -> DataFrame:
    """(cohort, study, id, labels, predictions, lines) of affected records (cohort, study, id): rows (id, labels, predictions) by
    id and reports (study, lines) by study, empty where either is missing. Of rows with one id, and of reports with one study, the
    last in `order` counts (where a table has that column, else the largest), so no record multiplies; an affected record that repeats stays."""
    none = F.array().cast("array<string>")

    def last(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
        value = F.struct(*columns)
        return df.groupBy(key).agg((F.max_by(value, F.struct(order, value)) if order in df.columns else F.max(value)).alias("v")).select(key, "v.*")

    out = affected.join(last(rows, "id", ["labels", "predictions"]), "id", "left").join(last(reports, "study", ["lines"]), "study", "left")
    return out.select("cohort", "study", "id", *[F.coalesce(c, none).alias(c) for c in ("labels", "predictions", "lines")])


def indexed(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """One row for each key, the last in `order`, with its columns: an index by key. Rows without a key are not in it."""
    value = F.struct(order, *columns)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, value).alias("v")).select(key, "v.*")


def unexpected_values(rows: DataFrame, keep: list[str], drop: list[str]) -> DataFrame:
    """(name, n, filled) of the columns that are neither kept nor dropped: how many rows there are and in how many the column has a
    value, in one pass over the rows."""
    names = sorted(set(rows.columns) - set(keep) - set(drop))
    counts = rows.agg(F.count("*").alias("rows"), *[F.count(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(names)])
    return counts.select("rows", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("filled")) for i, n in enumerate(names)]))).select("name", F.col("rows").alias("n"), "filled")


def wave_differences(beats: DataFrame, reference: DataFrame, *keys: str) -> DataFrame:
    """Each beat's wave (keys, amp, duration, angle, area) against the reference wave of its keys; a difference is null if a
    side is; angles differ by -180 to 180 degrees."""
    other = reference.select(*keys, *[F.col(c).alias(f"ref_{c}") for c in ("amp", "duration", "angle", "area")])
    both = beats.join(other, list(keys))
    d = lambda c: F.col(c) - F.col(f"ref_{c}")
    return both.select(*keys, d("amp").alias("amp"), d("duration").alias("duration"), Q.wrap(d("angle")).alias("angle"), d("area").alias("area"), F.coalesce(F.col("amp") * F.col("ref_amp") < 0, F.lit(False)).alias("flip"))


def wave_variability(differences: DataFrame, *keys: str) -> DataFrame:
    return differences.groupBy(*keys).agg(
        F.count("*").alias("n_beats"), F.avg("amp").alias("amp_mean"), F.stddev_pop("amp").alias("amp_sd"), F.stddev_pop("duration").alias("duration_sd"),
        F.stddev_pop("angle").alias("axis_sd"), F.stddev_pop("area").alias("area_sd"), F.avg(F.col("flip").cast("int")).alias("flip_share"),
    )


def bimodality(rows: DataFrame, value: str, ectopic: Column, *keys: str) -> DataFrame:
    """Distance of the means of normal and ectopic values over the root of the sum of their variances; 0 with fewer than two
    of a kind or hardly any variance."""
    side = lambda f, on: f(F.when(on, F.col(value)))
    e = F.coalesce(ectopic, F.lit(False))
    out = rows.groupBy(*keys).agg(F.count_if(e).alias("n_ectopic"), F.count_if(~e).alias("n_normal"), side(F.avg, e).alias("me"), side(F.avg, ~e).alias("mn"), side(F.var_pop, e).alias("ve"), side(F.var_pop, ~e).alias("vn"))
    spread = F.sqrt(F.col("vn") + F.col("ve"))
    value = F.when((F.col("n_ectopic") >= 2) & (F.col("n_normal") >= 2) & (spread > 1e-9), F.abs(F.col("mn") - F.col("me")) / spread).otherwise(0.0)
    return out.select(*keys, "n_ectopic", "n_normal", value.alias("ashman"))


def histogram_modes(rows: DataFrame, share: float = 0.35, least: int = 3) -> DataFrame:
    """(key, c, center) of the peaks of each key's histogram, whose bins are 4 % of the mean wide (15 at least, whole) and begin
    at the smallest value; a run of equal bins is one peak at its middle. rows have key, i, rr and the key's `mean`."""
    width = F.floor(F.greatest(F.lit(15.0), 0.04 * F.col("mean")))
    lo, hi = F.min("rr").over(Q.by_key()), F.max("rr").over(Q.by_key())
    wide = rows.withColumn("w", width.cast("double")).withColumn("lo", lo).withColumn("hi", hi).where("hi > lo")
    # as many bins as edges at lo, lo + w, ... below hi + w leave; the last one holds its upper edge
    wide = wide.withColumn("bins", (F.ceil((F.col("hi") + F.col("w") - F.col("lo")) / F.col("w")) - 1).cast("long"))
    bin_of = F.least(F.floor((F.col("rr") - F.col("lo")) / F.col("w")).cast("long"), F.col("bins") - 1)
    counts = wide.withColumn("b", bin_of).groupBy("key", "b").agg(F.count("*").alias("n"), F.first("w").alias("w"), F.first("lo").alias("lo"), F.first("bins").alias("bins"))
    # bins without rows count as 0: a run of equal neighbours ends where the next bin is another or not the next
    order = Window.partitionBy("key").orderBy("b")
    new = F.when((F.col("b") == F.lag("b").over(order) + 1) & (F.col("n") == F.lag("n").over(order)), 0).otherwise(1)
    runs = counts.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    flat = runs.groupBy("key", "run").agg(F.min("b").alias("b0"), F.max("b").alias("b1"), F.first("n").alias("n"), F.first("w").alias("w"), F.first("lo").alias("lo"), F.first("bins").alias("bins"))
    by = Window.partitionBy("key").orderBy("run")
    before = F.when(F.lag("b1").over(by) == F.col("b0") - 1, F.lag("n").over(by)).otherwise(0)
    after = F.when(F.lead("b0").over(by) == F.col("b1") + 1, F.lead("n").over(by)).otherwise(0)
    top = F.max("n").over(Q.by_key())
    flat = flat.withColumn("before", before).withColumn("after", after).withColumn("top", top)
    inner = (F.col("b0") > 0) & (F.col("b1") < F.col("bins") - 1)  # the first and last bin are no peaks
    tall = (F.col("n") >= F.greatest(F.lit(1), F.floor(share * F.col("top")))) & (F.col("n") >= least)
    peaks = flat.where(inner & tall & (F.col("n") > F.col("before")) & (F.col("n") > F.col("after")))
    center = F.col("lo") + (F.floor((F.col("b0") + F.col("b1")) / 2) + 0.5) * F.col("w")
    return peaks.select("key", F.col("b0").alias("c"), center.alias("center"))


def rr_signature(rows: DataFrame, least: int = 12, guard: float = 280.0) -> DataFrame:
    """(key, n_peaks, coverage, tight, dominance, pattern) of each key's intervals: random_scatter, organized_av_conduction or
    undetermined; keys with fewer than `least` intervals or a mean below the guard are left out."""
    stats = Q.hrv(rows).where((F.col("n") >= least) & (F.col("mean") >= guard)).select("key", "mean", "rmssd", "pnn50", "cv")
    own = rows.join(stats.select("key", "mean"), "key")
    centers = histogram_modes(own)
    tolerance = F.greatest(F.lit(20.0), 0.06 * F.col("mean"))
    packed = centers.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("c", "center"))).alias("cs"))
    near = F.array_min(F.transform("cs", lambda x: F.struct(F.abs(x["center"] - F.col("rr")).alias("d"), x["c"].alias("c"))))
    placed = own.join(packed, "key", "left").withColumn("near", near).withColumn("tol", tolerance)
    placed = placed.withColumn("c", F.when(F.col("near.d") <= F.col("tol"), F.col("near.c"))).withColumn("next", F.lead("c").over(Q.in_order())).withColumn("peaks", F.coalesce(F.size("cs"), F.lit(0)))
    groups = placed.where("c is not null").groupBy("key", "c").agg(F.count("*").alias("n"), F.stddev_pop("rr").alias("sd"), F.first("tol").alias("tol"))
    tight = groups.groupBy("key").agg(F.count_if((F.col("n") > 1) & (F.col("sd") <= 0.5 * F.col("tol"))).alias("tight"))
    pairs = placed.where("c is not null and next is not null").groupBy("key", "c", "next").agg(F.count("*").alias("n"))
    best = pairs.withColumn("r", F.row_number().over(Q.by_key().orderBy(F.desc("n"), "c", "next")))
    share = best.groupBy("key").agg((F.sum(F.when(F.col("r") <= 2, F.col("n"))) / F.sum("n")).alias("dominance"))
    out = placed.groupBy("key").agg(F.max("peaks").alias("n_peaks"), (F.count("c") / F.count("*")).alias("coverage"))
    out = out.join(tight, "key", "left").join(share, "key", "left").join(stats, "key")
    out = out.withColumn("tight", F.coalesce(F.col("tight") / F.greatest(F.lit(1), F.col("n_peaks")), F.lit(0.0))).withColumn("dominance", F.coalesce("dominance", F.lit(0.0)))
    scattered = (F.col("n_peaks") == 0) | (F.col("n_peaks") >= 4) | (F.col("coverage") < 0.65) | (F.col("dominance") < 0.45)
    scattered = scattered | (((F.col("cv") >= 0.12) | (F.col("pnn50") >= 20)) & (F.col("rmssd") >= 40))
    organized = F.col("n_peaks").isin(2, 3) & (F.col("tight") >= 0.6) & (F.col("coverage") >= 0.75) & (F.col("dominance") >= 0.6)
    pattern = F.when(scattered, "random_scatter").when(organized, "organized_av_conduction").otherwise("undetermined")
    return out.select("key", "n_peaks", "coverage", "tight", "dominance", pattern.alias("pattern"))


def ectopic_patterns(rows: DataFrame, least: int = 3, pause: float = 1.15) -> DataFrame:
    """(key, pattern, matches, total, longest, runs, present) for bigeminy (N-E pairs, from the second pair on with a pause) and
    trigeminy (N-N-E triples), from (key, i, label, rr); keys with fewer than six labels are not asked."""
    order = Q.in_order()
    ahead = lambda c, k: F.lead(c, k).over(order)
    own = rows.withColumn("l1", ahead("label", 1)).withColumn("l2", ahead("label", 2)).withColumn("r1", ahead("rr", 1)).withColumn("r0", F.lag("rr").over(order)).withColumn("n", F.count("*").over(Q.by_key())).where("n >= 6")
    two = own.where("i % 2 = 0 and l1 is not null").withColumn("hit", (F.col("label") == "N") & (F.col("l1") == "E") & ((F.col("i") == 0) | (F.col("r1") > pause * F.col("r0"))))
    three = own.where("i % 3 = 0 and l2 is not null").withColumn("hit", (F.col("label") == "N") & (F.col("l1") == "N") & (F.col("l2") == "E"))
    each = two.select("key", F.lit("bigeminy").alias("pattern"), F.floor(F.col("i") / 2).alias("i"), "hit").unionByName(three.select("key", F.lit("trigeminy").alias("pattern"), F.floor(F.col("i") / 3).alias("i"), "hit"))
    runs = Q.value_runs(each, "hit", "key", "pattern")
    out = runs.groupBy("key", "pattern").agg(
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).cast("long").alias("matches"), F.sum("n").cast("long").alias("total"),
        F.coalesce(F.max(F.when(F.col("hit"), F.col("n"))), F.lit(0)).cast("long").alias("longest"), F.count_if(F.col("hit") & (F.col("n") >= least)).alias("runs"),
    )
    share = F.when(F.col("pattern") == "bigeminy", 0.6).otherwise(0.5)
    return out.withColumn("present", (F.col("matches") >= least) & (F.col("matches") / F.col("total") >= share))


#: Words of feature names.
WAVES = {"P": "P wave", "QRS": "QRS complex", "T": "T wave", "PQ": "PQ segment", "ST": "ST segment", "TP": "TP segment"}
STATISTICS = {
    "mean": "mean", "median": "median", "std": "standard deviation", "mad": "median abs deviation", "iqr": "interquartile range", "min": "minimum",
    "max": "maximum", "rms": "RMS", "range": "range", "skew": "skewness", "kurtosis": "kurtosis", "cv": "coefficient of variation",
    "alternation_index": "beat-to-beat alternation", "n_beats": "beats detected", "trend_slope": "trend across beats",
}


def feature_gloss(name: Column) -> Column:
    """A readable form of track::place::wave::measure[::statistic]; names of fewer parts stay as they are."""
    parts = F.split(name, "::")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    look = lambda table, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), c)
    scope = F.when(at(1) == "ml_direct", F.concat(F.lit("lead "), at(2))).otherwise(F.concat(at(2), F.lit(" plane")))
    lag = F.concat(F.lit("autocorrelation lag "), F.substring_index(at(5), "_", -1))
    period = F.concat(F.lit("alternation index (period "), F.substring(at(5), -1, 1), F.lit(")"))
    stat = F.when(F.coalesce(at(5), F.lit("")) == "", None).when(at(5).startswith("acf_lag_"), lag).when(at(5).startswith("alternation_index_p"), period).otherwise(look(STATISTICS, at(5)))
    return F.when(F.size(parts) < 4, name).otherwise(F.concat_ws(", ", scope, look(WAVES, at(3)), at(4), stat))


def safe_name(raw: Column, most_stem: int = 100, most_suffix: int = 16) -> Column:
    """A bare file name of letters, digits, dots, underscores and hyphens; null if nothing is left; device names get an
    underscore; the stem is cut, never the extension."""
    base = F.trim(F.substring_index(F.replace(raw, F.lit("\\"), F.lit("/")), "/", -1))
    base = F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]", "_"), r"^\.+", "")
    stem, suffix = F.regexp_extract(base, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(base, r"^(.*)\.([^.]*)$", 2)
    stem = F.when(F.lower(stem).rlike("^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"), F.concat(F.lit("_"), stem)).otherwise(stem)
    whole = F.concat(F.substring(stem, 1, most_stem), F.lit("."), F.substring(suffix, 1, most_suffix))
    return F.when(base == "", None).when(~base.contains("."), F.substring(base, 1, most_stem)).otherwise(whole)


def code_texts(codes: DataFrame, table: DataFrame, code: str = "code") -> DataFrame:
    """codes with `text` from a dictionary (code, text); unknown codes keep their own form. Dictionaries are small tables, and
    the join is a broadcast where Spark finds them so."""
    named = table.select(F.col("code").alias("_code"), F.col("text").alias("_text"))
    out = codes.join(named, F.col(code) == F.col("_code"), "left")
    return out.withColumn("text", F.coalesce("_text", F.col(code))).drop("_code", "_text")


def rounded(value: Column, digits: int = 2) -> Column:
    """A number for a record: not-a-number and infinities become null, others are rounded."""
    d = value.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), F.round(d, digits))


def normalised(value: Column, kind: T.DataType, digits: int = 2) -> Column:
    """A value of any nested type as a record holds it: numbers with a fraction rounded, not finite ones null, bytes as text, keys of maps as
    text, at any depth. The type gives the expression, so rows stay in the JVM."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.round(value.cast("double"), digits))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: normalised(x, kind.elementType, digits))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(F.coalesce(e["key"].cast("string"), F.lit("null")).alias("key"), normalised(e["value"], kind.valueType, digits).alias("value")))
        return F.map_from_entries(entries)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[normalised(value[f.name], f.dataType, digits).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.BinaryType):
        return F.decode(value, "UTF-8")
    return value


def record_json(rows: DataFrame, digits: int = 2, nulls: bool = True) -> DataFrame:
    """(record): each row, with all its columns, as a JSON document of normalised values; nulls are written unless told otherwise."""
    whole = F.struct(*[normalised(F.col(f"`{f.name}`"), f.dataType, digits).alias(f.name) for f in rows.schema.fields])
    return rows.select(F.to_json(whole, {"ignoreNullFields": str(not nulls).lower()}).alias("record"))


def final_record(data: dict[str, Column], flags: dict[str, Column], label: Column, issues: Column) -> Column:
    """JSON of a record: data (rounded numbers), label, semantic flags, and a warning where issues of quality are named."""
    warning = F.when(F.size(issues) > 0, F.concat(F.lit("Poor quality may degrade feature accuracy. Issues: "), F.array_join(issues, ", "), F.lit(".")))
    semantic = F.struct(F.struct(*[c.alias(k) for k, c in flags.items()]).alias("semantic_flags"), warning.alias("quality_warning"))
    return F.to_json(F.struct(F.struct(*[rounded(c).alias(k) for k, c in data.items()]).alias("data"), label.alias("label"), semantic.alias("semantic")))


def channels(colour: Column) -> list[Column]:
    """Red, green and blue of #rrggbb as numbers."""
    return [F.conv(F.substring(colour, k, 2), 16, 10).cast("int") for k in (2, 4, 6)]


def hex_of(parts: list[Column]) -> Column:
    """#rrggbb of three numbers, rounded half up."""
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(F.floor(p + 0.5).cast("long"))), 2, "0") for p in parts])


def lerp(a: Column, b: Column, t: Column) -> Column:
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return hex_of([x + (y - x) * share for x, y in zip(channels(a), channels(b), strict=True)])


def gradient(t: Column, low: Column, mid: Column, high: Column) -> Column:
    return F.when(t <= 0.5, lerp(low, mid, t * 2)).otherwise(lerp(mid, high, (t - 0.5) * 2))


def blend(colours: Column) -> Column:
    """Mean colour of an array; null if it is empty."""
    mean = lambda k: F.aggregate(F.transform(colours, lambda c: channels(c)[k]), F.lit(0), lambda s, x: s + x) / F.size(colours)
    return F.when(F.size(colours) > 0, hex_of([mean(k) for k in range(3)]))


def hsl(hue: Column, saturation: Column, lightness: Column) -> Column:
    """#rrggbb of a hue in degrees, saturation and lightness in per cent."""
    s, li = saturation / 100, lightness / 100
    q = F.when(li < 0.5, li * (1 + s)).otherwise(li + s - li * s)
    p = 2 * li - q

    def part(shift: float) -> Column:
        t = F.pmod(hue / 360 + shift, F.lit(1.0))
        return F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 1 / 2, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)

    return hex_of([part(x) * 255 for x in (1 / 3, 0.0, -1 / 3)])


def direction(angle_xy: Column, angle_xz: Column) -> list[Column]:
    """Unit vector of two plane angles in radians."""
    return [F.cos(angle_xz) * F.cos(angle_xy), F.cos(angle_xz) * F.sin(angle_xy), F.sin(angle_xz)]


LIMB, CHEST = (tuple(map(tuple, plane.tolist())) for plane in (LIMB_PLANE, CHEST_PLANE))


def project(leads: list[Column], plane: tuple) -> tuple[Column, Column, Column, Column]:
    """(x, y, magnitude, angle in degrees) of six leads in a plane; columns have length 1 on average in the limb plane."""
    gain = sum((a * a + b * b) ** 0.5 for a, b in zip(*LIMB, strict=True)) / 6
    x, y = (sum((c * (w / gain) for c, w in zip(leads[1:], row[1:], strict=True)), leads[0] * (row[0] / gain)) for row in plane)
    return x, y, F.sqrt(x * x + y * y), F.degrees(F.atan2(y, x))


def spaced_from_right(places: Column, least: int) -> Column:
    """Sorted places of which, from the largest down, one is left out if it is nearer than `least` to the one kept before."""
    down = F.reverse(F.array_sort(places))
    keep = lambda a, p: F.when((F.size(a) == 0) | (F.element_at(a, 1) - p >= least), F.concat(F.array(p), a)).otherwise(a)
    # the array grows at its front, so its first element is the one kept last
    return F.aggregate(down, F.array().cast("array<bigint>"), keep)


def region(t: Column, rr: Column, offset: float = 50.0, dead: float = 5.0) -> Column:
    """Region of a time in ms around the R peak; around the border of P and QRS a dead zone counts as late P."""
    share = t / rr
    right = F.when(t < 80, "QRS").when(share < 0.20, "ST").when(share < 0.26, "Early-T").when(share < 0.40, "Normal-T").otherwise("Late-T")
    left = F.when(t < -210, "Early-P").when(t < -100, "Normal-P").otherwise("Late-P")
    return F.when(F.abs(t + offset) <= dead, "Late-P").when(t >= -offset, right).otherwise(left)


def wave_windows(rr: Column) -> Column:
    """array<struct<wave, low, high>> of the P, QRS and T windows of an interval."""
    one = lambda w, a, b: F.struct(F.lit(w).alias("wave"), a.cast("double").alias("low"), b.cast("double").alias("high"))
    return F.array(one("P", 75 - rr / 2, F.lit(-70)), one("QRS", F.lit(-75), F.lit(80)), one("T", F.lit(80), rr / 2))


def notched(a1: Column, m1: Column, s1: Column, a2: Column, m2: Column, s2: Column, steps: int = 200) -> Column:
    """Whether two components of one sign, the second later by 20 ms or more, leave a valley of at least 20 % between them."""
    bell = lambda x, a, m, s: a * F.exp(-0.5 * ((x - m) / (s + 1e-9)) * ((x - m) / (s + 1e-9)))
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: m1 + (m2 - m1) * k / F.lit(float(steps - 1)))
    valley = F.array_min(F.transform(grid, lambda x: F.abs(bell(x, a1, m1, s1) + bell(x, a2, m2, s2))))
    least = F.greatest(F.lit(1e-9), F.least(F.abs(a1), F.abs(a2)))
    return (F.signum(a1) == F.signum(a2)) & (a1 != 0) & ((least - valley) / least >= 0.20) & (m2 - m1 >= 20)


def aicc(rss: Column, k: Column, n: Column) -> Column:
    m = F.greatest(n, F.lit(1))
    return m * F.log(rss / m + 1e-12) + 2 * k + (2 * k * (k + 1)) / F.greatest(m - k - 1, F.lit(1))


def choose_model(rows: DataFrame, penalty: float = 4.0, snr: float = -3.0) -> DataFrame:
    """(rec, k) of the model to take from (rec, k, rss, params, n, early, snr): two components if their criterion, with a
    penalty, is smaller than that of one, or within 0.75 of it and their first center is earlier; none unless the one taken
    beats no component by more than 1 (without the penalty) and has enough signal."""
    score = rows.withColumn("a", F.round(aicc(F.col("rss"), F.col("params"), F.col("n")), 9))
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}")
    wide = score.groupBy("rec").agg(*[of(k, c) for k in (0, 1, 2) for c in ("a", "early", "snr")])
    two = F.col("a2") + penalty
    two_better = (two < F.col("a1")) | ((F.abs(two - F.col("a1")) <= 0.75) & (F.col("early2") < F.col("early1")))
    best = F.when(F.coalesce(two_better, F.col("a1").isNull() & F.col("a2").isNotNull()), 2).otherwise(1)
    taken = wide.withColumn("best", best).withColumn("a", F.when(F.col("best") == 2, F.col("a2")).otherwise(F.col("a1"))).withColumn("s", F.when(F.col("best") == 2, F.col("snr2")).otherwise(F.col("snr1")))
    good = F.coalesce((F.col("a") + 1 < F.col("a0")) & (F.col("s") >= snr), F.lit(False))
    return taken.select("rec", F.when(good, F.col("best")).otherwise(0).alias("k"))

"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The corpus is a tree: domain, language, source. A budget of tokens (`share` of all tokens) goes down from the root. At each
node it is split in proportion to the children's weights, and a child gets no more than its subtree can give: its tokens
times `max_epochs`. What a child can't take goes to its siblings in proportion to their weights, round after round; only
what a whole subtree can't take reaches the ancestors' other children, as their split already counts the subtree's limit.
These capped splits have a closed form: children in order of limit over weight, running sums, and one level for all that
are not at their limit.

A leaf with budget b and t tokens gives all its documents floor(b / t) times; the rest of the budget takes a prefix of its
documents in the order of a hash of seed, epoch and doc_id: those whose running sum of tokens stays within the rest.

Scale. Running sums over a leaf that holds a third of all rows are not taken row by row: hashes fall into 4096 buckets,
bucket sums locate the bucket where the prefix ends, and only its rows are sorted. What remains for each leaf is a
threshold hash, so texts are filtered in place and never shuffled. The table of leaves is broadcast if it has at most
`broadcast_leaves` rows (about 100 bytes each), and joined by its key otherwise.

Defined cases: tokens are the pieces between single spaces or line ends; null and empty texts have none and are never
taken; null languages or sources are leaves of their own; sources without a final number are in domain d_; rows with one
doc_id (or a null one) share a hash and are taken together or not at all.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.common import cut

DOMAINS = {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
OTHER, SHARE, MAX_EPOCHS, SEED, BROADCAST_LEAVES = 0.1, 0.6, 3, 17, 50_000

TOKENS = "octet_length(text) - octet_length(replace(replace(text, ' ', ''), '\n', '')) + 1"
DOMAIN = "concat('d', coalesce(cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4 as string), '_'))"


def _leaf(docs: DataFrame) -> DataFrame:
    """doc_id, domain, l, s, tokens of the rows that have tokens."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(DOMAIN).alias("domain"), F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s"), "text")
    return text.where("text <> ''").select("doc_id", "domain", "l", "s", F.expr(TOKENS).cast("long").alias("tokens"))


def _weights(column: str, weights: dict[str, float], other: float):
    found = F.lit(float(other))
    for name, weight in weights.items():
        found = F.when(F.col(column) == name, F.lit(float(weight))).otherwise(found)
    return found


def split_budget(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children with `got`: the share of the parent's `budget` by weight `w`, up to each child's limit `most`."""
    order = [F.col("most") / F.col("w"), F.col(name)]
    by = Window.partitionBy(*parent).orderBy(*order)
    before = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    level = children.withColumn("level", (F.col("budget") - before) / rest)
    level = level.withColumn("line", F.max(F.when(F.col("most") > F.col("w") * F.col("level"), F.col("level"))).over(Window.partitionBy(*parent)))
    return level.withColumn("got", F.when(F.col("line").isNull(), F.col("most")).otherwise(F.least("most", F.col("w") * F.col("line")))).drop("level", "line")


def leaf_budgets(leaves: DataFrame, domains: dict[str, float], languages: dict[str, float], share: float, max_epochs: int) -> DataFrame:
    """domain, l, s, tokens, full (whole epochs) and rest (tokens of the last) of each leaf."""
    total = leaves.agg(F.sum("tokens")).first()[0] or 0  # one number
    most = (F.sum("tokens") * F.lit(max_epochs)).cast("double").alias("most")
    top = leaves.groupBy("domain").agg(most).withColumn("w", _weights("domain", domains, OTHER)).withColumn("root", F.lit(0))
    top = top.withColumn("budget", F.lit(float(math.floor(total * float(share)))))
    top = split_budget(top, ["root"], "domain").select("domain", F.col("got").alias("budget"))
    middle = leaves.groupBy("domain", "l").agg(most).join(top, "domain").withColumn("w", _weights("l", languages, OTHER))
    middle = split_budget(middle, ["domain"], "l").select("domain", "l", F.col("got").alias("budget"))
    low = leaves.withColumn("most", (F.col("tokens") * F.lit(max_epochs)).cast("double")).join(middle, ["domain", "l"]).withColumn("w", F.lit(1.0))
    low = split_budget(low, ["domain", "l"], "s").withColumn("got", F.floor(F.round("got", 6)).cast("long"))
    full = F.expr("got div tokens")
    return low.select("domain", "l", "s", "tokens", full.alias("full"), (F.col("got") - full * F.col("tokens")).alias("rest"))


def _order(seed: int):
    """A hash of seed, epoch and doc_id as 16 hexadecimal digits."""
    return F.expr(f"substring(md5(cast(concat('{seed}:', full, ':', coalesce(cast(doc_id as string), '')) as binary)), 1, 16)")


def mix(
    docs: DataFrame, domains: dict[str, float] | None = None, languages: dict[str, float] | None = None, share: float = SHARE,
    max_epochs: int = MAX_EPOCHS, seed: int = SEED, broadcast_leaves: int = BROADCAST_LEAVES,
) -> DataFrame:
    """The documents of the mixture, one row for each time one is taken, with two more columns, _domain and _epoch; columns of
    docs with these names are replaced."""
    out = taken(docs, domains, languages, share, max_epochs, seed, broadcast_leaves)
    own = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("_domain", "_epoch")]
    return out.select(*own, F.col("domain").alias("_domain"), F.col("epoch").alias("_epoch"))


def taken(
    docs: DataFrame, domains: dict[str, float] | None = None, languages: dict[str, float] | None = None, share: float = SHARE,
    max_epochs: int = MAX_EPOCHS, seed: int = SEED, broadcast_leaves: int = BROADCAST_LEAVES,
) -> DataFrame:
    """(row, domain, epoch): each taking of a document, its columns as row.c0, row.c1, ..."""
    slim = cut(_leaf(docs))
    leaves = cut(slim.groupBy("domain", "l", "s").agg(F.sum("tokens").alias("tokens")))
    few = leaves.count() <= broadcast_leaves
    small = F.broadcast if few else (lambda df: df)
    plan = cut(leaf_budgets(leaves, domains or DOMAINS, languages or LANGUAGES, share, max_epochs))
    keys = ["domain", "l", "s"]
    placed = slim.join(small(plan.drop("tokens").where("rest > 0")), keys).withColumn("h", _order(seed))
    sums = placed.groupBy(*keys, "rest", F.substring("h", 1, 3).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    running = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("running", running).where("running > rest").groupBy(*keys).agg(F.min_by(F.struct("bucket", (F.col("running") - F.col("tokens")).alias("before")), "bucket").alias("end"))
    ends = cut(ends.select(*keys, "end.bucket", "end.before"))
    inside = placed.join(small(ends), keys).where(F.substring("h", 1, 3) == F.col("bucket"))
    within = F.col("before") + F.sum("tokens").over(Window.partitionBy(*keys).orderBy("h"))
    last = inside.withColumn("within", within).where("within <= rest").groupBy(*keys).agg(F.max("h").alias("last"))
    limit = F.greatest(F.col("bucket"), F.coalesce("last", F.lit("")))  # every hash of an earlier bucket sorts before it
    ends = ends.join(last, keys, "left").select(*keys, limit.alias("limit"))
    plan = cut(plan.drop("tokens").join(ends, keys, "left"))
    named = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.expr(DOMAIN).alias("domain"), F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s"), F.col("text").alias("text")).where("text <> ''").drop("text")
    named = named.join(small(plan), keys).withColumn("h", _order(seed))
    last_too = F.when((F.col("rest") > 0) & (F.col("h") <= F.coalesce("limit", F.lit("g"))), 1).otherwise(0)
    times = named.withColumn("times", F.col("full").cast("int") + last_too).where("times > 0")
    return times.select("row", "domain", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixture with the columns of docs; a document taken in several epochs stands several times."""
    return taken(docs).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _sql_weights(column: str, weights: dict[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}::DOUBLE" for k, v in weights.items()) + f" ELSE {OTHER}::DOUBLE END"


def _sql_split(name: str, parent: str, child: str, source: str) -> str:
    return f"""
{name}_a AS (SELECT *, (budget - coalesce(sum(most) OVER (PARTITION BY {parent} ORDER BY most / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (PARTITION BY {parent} ORDER BY most / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {source}),
{name}_b AS (SELECT *, max(CASE WHEN most > w * level THEN level END) OVER (PARTITION BY {parent}) AS line FROM {name}_a),
{name} AS (SELECT *, CASE WHEN line IS NULL THEN most ELSE least(most, w * line) END AS got FROM {name}_b)"""


ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, 'd' || coalesce((try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 4)::VARCHAR, '_') AS domain, coalesce(lang, '') AS l, coalesce(source, '') AS s,
  lang, source, (strlen(text) - strlen(replace(replace(text, ' ', ''), chr(10), '')) + 1)::BIGINT AS tokens FROM documents WHERE text <> ''),
leaves AS (SELECT domain, l, s, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
t1 AS (SELECT 0 AS root, domain, sum(tokens)::DOUBLE * {MAX_EPOCHS} AS most, {_sql_weights("domain", DOMAINS)} AS w, (SELECT floor(sum(tokens) * {SHARE}::DOUBLE) FROM leaves) AS budget FROM leaves GROUP BY domain),
{_sql_split("d1", "root", "domain", "t1")},
t2 AS (SELECT a.domain, a.l, sum(a.tokens)::DOUBLE * {MAX_EPOCHS} AS most, {_sql_weights("a.l", LANGUAGES)} AS w, any_value(d1.got) AS budget FROM leaves a JOIN d1 ON a.domain = d1.domain GROUP BY a.domain, a.l),
{_sql_split("d2", "domain", "l", "t2")},
t3 AS (SELECT a.domain, a.l, a.s, a.tokens, a.tokens::DOUBLE * {MAX_EPOCHS} AS most, 1::DOUBLE AS w, d2.got AS budget FROM leaves a JOIN d2 ON a.domain = d2.domain AND a.l = d2.l),
{_sql_split("d3", "domain, l", "s", "t3")},
plan AS (SELECT domain, l, s, floor(round(got, 6))::BIGINT // tokens AS "full", floor(round(got, 6))::BIGINT % tokens AS rest FROM d3),
placed AS (SELECT d.*, p."full", p.rest, substr(md5('{SEED}:' || p."full" || ':' || coalesce(d.doc_id::VARCHAR, '')), 1, 16) AS h FROM docs d JOIN plan p ON d.domain = p.domain AND d.l = p.l AND d.s = p.s),
taken AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, l, s ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AS last FROM placed),
times AS (SELECT *, ("full" + last::INT)::BIGINT AS times FROM taken)
SELECT doc_id, domain, lang, source, tokens, unnest(range(0, times))::INT AS epoch FROM times WHERE times > 0
"""

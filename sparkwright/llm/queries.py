"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm.ann import nearest
from sparkwright.llm.bpe import bpe_round_trip
from sparkwright.llm import collocations, linededup, mixing, periodic, quality, toxicity, warc
from sparkwright.llm.common import table
from sparkwright.llm.embdedup import embedding_groups
from sparkwright.llm.html import main_text
from sparkwright.llm.simhash import simhash_groups
from sparkwright.llm.suffix import remove_repeats

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of largest inner product for every twentieth vector. Unusable vectors (null, empty, zero, not finite) and null ids
    take no part; ties go to the smaller id; repeated rows are one; an empty table gives no rows."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more and their components. Unusable vectors and null ids link with nothing; each repeated row is a
    vector that links."""
    return embedding_groups(table(spark, sf_dir, "embeddings"), least=0.9)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text. Null and empty texts are scored as padding; repeated rows are scored alike; labels that are null
    are not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left of every document. A null text stays null (no lines, null digest), an empty one empty; of repeated rows the first
    keeps its lines; a null id comes last."""
    out = linededup.remove_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed_lines").alias("n_removed_lines"), F.sha2("text", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every whole text. Null and empty texts have no features; repeated rows are scored alike; null labels are not
    learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.col("severity").alias("expected_severity"), predicted)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights. Null and empty texts are never drawn; rows that share an id are drawn together; null
    languages and sources are leaves."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.expr(mixing.TOKENS).cast("long").alias("tokens"), F.col("_epoch").alias("epoch"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components. Null and empty texts have fingerprint 0 and link like others; repeated rows stay; a null id is
    no representative."""
    out = simhash_groups(table(spark, sf_dir, "documents"), words=4, most=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def token_digests(docs: DataFrame) -> DataFrame:
    """docs, encoded and decoded, with digests in place of the texts; columns of docs with the digests' names are replaced."""
    out = bpe_round_trip(docs, vocabulary_path())
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_tokens", "ids_sha256", "decoded_sha256")],
        F.size("input_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("input_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded_text"), 256).alias("decoded_sha256"),
    )


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null pages are empty; null urls are one host; repeated rows stay."""
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text and the text they decode to. A null text counts as empty; repeated rows stay."""
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left without repeated strings of 200 bytes. A null text counts as empty; repeated rows repeat each other, so both lose
    what they share."""
    out = remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every whole text, some of which are given loops first. Null, empty and blank texts have no runs and an empty
    collapsed text; a null id gives no loop; repeated rows stay."""
    docs = table(spark, sf_dir, "documents")
    return periodic.run_digests(periodic.periodic_runs(periodic.with_loops(docs), exponent=4, shortest=6))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in the archives of all pages, read back. A null html is an empty payload; rows that share the largest id of equal
    payloads are all responses; a null id revisits the largest one; an empty table gives no rows."""
    index = warc.write_archive(table(spark, sf_dir, "pages"), least=1000)
    return warc.read_archive(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language. Null texts are empty, null languages are `und`; every repeated row counts; an
    empty table gives no rows."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


QUERIES = {"op11_periodic": op11_periodic, "op12_warc": op12_warc, "op13_collocations": op13_collocations, "op8_html": op8_html, "op6_toxicity": op6_toxicity, "op1_ann": op1_ann, "op5_embedding_dedup": op5_embedding_dedup, "op3_line_dedup": op3_line_dedup, "op7_mixing": op7_mixing, "op10_suffix": op10_suffix, "op2_quality": op2_quality, "op4_simhash": op4_simhash, "op9_bpe": op9_bpe}
ORACLES: dict[str, str] = {"op3_line_dedup": linededup.ORACLE_SQL, "op7_mixing": mixing.ORACLE_SQL, "op12_warc": warc.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}

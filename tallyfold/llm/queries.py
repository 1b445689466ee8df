"""Registered queries of this subpackage, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import leakage, linkage, mixing, quality
from tallyfold.sources.tables import load, without_codes


def register(spark: SparkSession, folder: str, name: str, entity: str) -> DataFrame:
    rows = without_codes(load(spark, folder, name), ids=[entity, "household_id", "given_code", "family_code"], codes=["sex", "county"])
    return linkage.records(rows, entity, "given_code", "family_code", "birth_tick", "sex", "county", "household_id")


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate pair with its confidence."""
    pairs = linkage.link(register(spark, folder, "population", "person_id"), register(spark, folder, "income", "taxpayer_id"))
    return pairs.select(F.col("id_a").alias("person_id"), F.col("id_b").alias("taxpayer_id"), "confidence")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_links(spark, folder).where(F.col("confidence") >= 0.5).select("person_id", "taxpayer_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(load(spark, folder, "documents"), load(spark, folder, "test_items"))


#: A public tokenizer's file on every machine; another path may be set in the session.
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    tokenizer = spark.conf.get("spark.tallyfold.tokenizer", TOKENIZER_FILE)
    return mixing.mix(load(spark, folder, "documents"), load(spark, folder, "mix_targets"), tokenizer)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(spark, folder).rows


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(spark, folder).report


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.document_statistics(load(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.junk_shares(load(spark, folder, "documents")).where(F.col("junk_share") > 0.5).select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_links": p1_links, "p7_found": p7_found, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_statistics": p9_statistics}
ORACLES: dict[str, str] = {
    "p9_statistics": r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\p{L}+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS lines FROM documents)
SELECT doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x)))::double / nullif(len(w), 0) AS mean_word_length,
  length(regexp_replace(text, '[\p{L}\p{N}\s]+', '', 'g'))::double / nullif(length(text), 0) AS symbol_ratio,
  len(regexp_extract_all(text, '[.!?…][''")]*[ \t\r]*(\n|$)'))::double / nullif(len(lines), 0) AS punctuated_lines,
  len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: x IN (COMMON)))::double / nullif(len(w), 0) AS common_words
FROM w""".replace("COMMON", ", ".join(f"'{w}'" for w in sorted(set(quality.COMMON_WORDS)))),
}

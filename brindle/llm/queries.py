"""The ten queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arrow_tokens, common, decontamination, embeddings, minhash, packing, pii, repeats, token_counts, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text; a null text has none, an empty table gives none."""
    return pii.find(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget, with the distance; null texts and items match nothing."""
    return decontamination.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set's size, its component and whether it is the one kept; texts without words are linked with nothing."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 2048 tokens; a null text is empty and has its end id."""
    return packing.pack(_table(spark, sf_dir, "documents"), keep_ids=False)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and component; unsound vectors and null labels are linked with nothing."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the Arrow files; a null text is empty."""
    return arrow_tokens.read_checksums(arrow_tokens.write_tokens(_table(spark, sf_dir, "documents"), common.fresh_dir(spark, "arrow-tokens")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and verdict; a null text is empty and gets the intercept's score."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, those removed as repeats, and the digest of the rest; a null text is empty."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives through the index; a null payload is empty."""
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages"), common.fresh_dir(spark, "warc")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, from a scan of flat files for the end id; a null text has that id alone."""
    files, roster = token_counts.write_flat(_table(spark, sf_dir, "documents"), common.fresh_dir(spark, "flat-tokens"))
    return roster.join(token_counts.count_tokens(files), ["file", "ordinal"]).select("doc_id", "n_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_decontamination, op3_minhash, op4_pack, op5_embedding_dedup, op6_arrow_tokens, op7_toxicity, op8_repeats, op9_warc, op10_token_counts)}
ORACLE_SQL: dict[str, str] = {
    "op9_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), g AS (
            SELECT payload_bytes, payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY ALL
        )
        SELECT page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN original <> page_id THEN original END AS refers_to
        FROM p LEFT JOIN g USING (payload_bytes, payload_digest)
    """,
}

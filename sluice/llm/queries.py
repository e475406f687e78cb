"""The queries of this subpackage: each applies its operator with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import oracles
from sluice.llm.base import Scratch, crc_mod5
from sluice.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, number of longest verbatim matches and words of the longest of every document."""
    from sluice.llm.decontaminate import find_matches

    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0).cast("long"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_matches"), longest.alias("longest_match"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the positions of removed lines of every document."""
    from sluice.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector at cosine 0.9."""
    from sluice.llm.embedding_links import link_vectors

    return link_vectors(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: four words, similarity 0.85."""
    from sluice.llm.ngram_join import join_documents

    return join_documents(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans of every document."""
    from sluice.llm.pii import BASE_KINDS, KINDS, find_personal_data, spans_text

    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text("base", BASE_KINDS), 256).alias("base_sha256"), spans_text("all", KINDS).alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the model is learned from rows not held out."""
    from sluice.llm.quality_fm import learn_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod5(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from written archives."""
    from sluice.llm.warc import plan_records, read_records, write_archives

    path = Scratch(spark, "warc").path()
    write_archives(plan_records(table(spark, sf_dir, "pages")), path)
    back = read_records(spark, path)
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)").alias
    return back.select(number("record_id")("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to")("refers_to"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document; dictionaries are learned from rows not held out."""
    from sluice.llm.language_id import learn_dictionaries, predict_languages

    docs = table(spark, sf_dir, "documents")
    found = predict_languages(docs, learn_dictionaries(docs))
    return found.select("doc_id", (crc_mod5(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every document."""
    from sluice.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    from sluice.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from written token files."""
    from sluice.llm.token_files import checksums, read_token_files, write_token_files

    path = Scratch(spark, "tokens").path()
    write_token_files(table(spark, sf_dir, "documents"), path)
    return checksums(read_token_files(spark, path)).withColumnRenamed("id", "doc_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word, after misspellings planted by hash."""
    from sluice.llm.spelling import count_words, group_variants

    return group_variants(count_words(table(spark, sf_dir, "documents"), noise=199))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector."""
    from sluice.llm.vector_codes import codebooks_digest, compress

    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))


def queries() -> dict[str, Query]:
    """All queries of the subpackage."""
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that it can express; the others are tested against brute force, round trips or held-out rows."""
    return {"op1_decontamination": oracles.DECONTAMINATION, "op3_embedding_links": oracles.EMBEDDING_LINKS, "op4_ngram_jaccard": oracles.NGRAM_JACCARD, "op7_warc": oracles.WARC, "op12_spelling_variants": oracles.SPELLING_VARIANTS, "op13_vector_codes": oracles.VECTOR_CODES}

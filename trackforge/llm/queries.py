"""Queries that apply each operator, with production parameters, to its whole table; and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackforge.llm import bpe, decontaminate, fim, hmm, jaccard_join, langid, lexical, neighbours, oracles, sharding, simhash, suffix_array, suffix_tree, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.dedup_digests(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return hmm.score(table(spark, sf_dir, "documents"), held_out)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup_bytes(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_classes(table(spark, sf_dir, "documents"), jaccard_join.Similarity(size=3, percent=90)).select("doc_id", "n_shingles", "component_id")


URL_POLICY = url_filter.UrlPolicy(
    rules=(
        url_filter.Rule("org", "/", "allow"),
        url_filter.Rule("example.org", "/es/", "block"),
        url_filter.Rule("example.org", "/en/1", "block"),
        url_filter.Rule("com", "/fr/", "allow"),
        url_filter.Rule("com", "/de/", "block"),
    )
)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_POLICY)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out("doc_id", 5)
    model = langid.train(docs.where(~out), tokenizer_path("piece_bpe_32k.model"))
    return langid.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fingerprint").alias("fingerprint"), "component_id")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    text = fim.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_bpe": op5_bpe,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_url_filter": op7_url_filter,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_simhash": op11_simhash,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_lexical_search": op13_lexical_search,
}

#: The rest can't be said in SQL, or not in reasonable time; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op6_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op7_url_filter": oracles.URL_FILTER,
    "op12_fill_in_middle": oracles.FILL_IN_MIDDLE,
    "op13_lexical_search": oracles.LEXICAL_SEARCH,
}

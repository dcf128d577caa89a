"""A corpus pipeline in five stages: language ID, near-duplicate removal, substring dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. run() writes each stage's result to the shared checkpoint folder before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackforge.llm import bpe, decontaminate, jaccard_join, langid, suffix_tree
from trackforge.llm.durable import staged
from trackforge.llm.repeats import enough_buckets

LEAST_POSTERIOR = 0.5
NEAR_DUPLICATES = jaccard_join.Similarity(size=5, percent=80)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays in doubt; without a labelled row only the former.

    Learns from all labelled rows of docs. Repeated rows all stay or all go; columns may have any names.
    """
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return langid.keep_identified(docs, model, least=LEAST_POSTERIOR)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of smallest id, however often it stands in docs.

    A null id counts as larger than all others. Texts without words are copies of nothing: all their rows stay.
    """
    return jaccard_join.drop_copies(docs, NEAR_DUPLICATES)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated windows of words out of the texts; n_chars follows. A text of nothing else becomes empty.

    Null texts become empty. A row that comes twice is its own repeat. Other columns stay, whatever their names.
    """
    others = {c: f"other_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    plain = docs.select("doc_id", "text", *(docs[c].alias(name) for c, name in others.items()))
    buckets = enough_buckets(docs, "text", 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))  # executors hold what earlier stages left as well
    found = suffix_tree.dedup_texts(plain, buckets=buckets, carry=list(others.values()))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*((made[c] if c in made else F.col(others[c])).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a benchmark item; those without words hold none. Repeated rows share their fate."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, with digests of ids and decoded text. A null text counts as empty."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: Stages 1 and 3 fit models and tokenise by rules that SQL can't express; tests hold the run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

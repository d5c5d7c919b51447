"""From raw documents to token ids: the stages of the pipeline, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``:

1. language ID: a document that the network can't read is rejected (no text or no letter, or a
   score that says no more than chance); ``lang`` becomes the language found;
2. line dedup: repeated three-line windows go; a document that had text and lost all of it goes;
3. MinHash near-dedup: one document of each group of near copies stays;
4. mixing: documents come as often as the source mix takes them, and so may repeat; what a task
   writes is in shuffled order;
5. byte-pair encoding: ids of the tokens and what they decode to.

Defined results, besides those of the operators: a null or empty text goes at the first stage, which
finds no language in it, and null ids, repeated ids and equal rows go on like others until near
dedup keeps one document of each group, of rows equal in id and text all or none. Ties go as the operators say. Texts of any length are read whole.
A table without rows gives none. Columns other than those of ``documents`` are left out by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spendlake.llm import bpe, language_id, line_dedup, mix_sources, near_dedup
from spendlake.llm.queries import vocabulary_file
from spendlake.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Mean probability of the language found, as a multiple of chance: one over the number of languages.
LEAST_SCORE = 1.2


def least_score(languages: int) -> float:
    """With one language, all texts have score 1 and none is rejected by it."""
    return LEAST_SCORE / languages if languages > 1 else 0.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = language_id.learn(docs)
    found = language_id.identify(docs, known=known)
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= least_score(len(known[0]))))
    return kept.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.remove_repeats(docs)
    return left.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))).withColumn(
        "n_chars", F.length("text").cast("long")).select(COLUMNS)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources.mix(docs).sortWithinPartitions("shard", "order_key").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids as little-endian unsigned 32-bit integers, their number and digest, and the decoded text's digest."""
    return bpe.encode_texts(docs, vocabulary_file()).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near_copies),
    ("mix_sources", mix),
    ("bpe", encode),
]

#: No SQL can say a trained network, MinHash or byte-pair merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

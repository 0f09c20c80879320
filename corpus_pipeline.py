"""Training-data pipeline over ``documents``: five stages, each with one text operator.

Every stage works on all documents that the one before kept. All but the last
return the columns of ``documents``; extra columns pass through. A null text is
no language and goes in the first stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, jaccard_join, language_id, sentence_pieces, suffix_dedup
from tidemark.llm.queries import vocabulary


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter go, and those less like every learned language than held-out texts of their size are.

    Null and empty texts go; rows that repeat go or stay together; of equal scores the first language by name
    counts, which decides nothing here; other columns pass under any name. Without labelled rows there is no language, and no row stays.
    """
    common.prepare(spark)
    return language_id.in_some_language(docs, language_id.with_floors(language_id.train(docs), docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the smallest doc_id stays.

    Rows that repeat doc_id and text are one document; of rows that repeat a doc_id with other
    texts each is looked at apart. Rows with a null doc_id stay, texts without a word too.
    """
    common.prepare(spark)
    found = jaccard_join.link_components(docs)
    key, row = common.free_name(docs, "key"), common.free_name(docs, "row")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(key), F.col("row").alias(row)).distinct()
    left = docs.join(gone, (F.col("doc_id") == F.col(key)) & (jaccard_join.row_hash("doc_id", "text") == F.col(row)), "left_anti")
    return left.dropDuplicates(["doc_id", "text"])


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: a passage of 50 words or more stays in one document and is cut from others; a text left without a word goes.

    Null, empty and short texts stay as they are, each row that repeats a doc_id keeps its own spans; an empty table stays empty.
    """
    common.prepare(spark)
    return suffix_dedup.cut_repeats(docs, suffix_dedup.repeated_spans(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go, those with a null doc_id too; null and empty texts stay.

    Of rows that repeat a doc_id only those whose own text holds an item go; equal rows go or stay together.
    """
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of what is left, a row each: doc_id, ids, n_pieces, ids_crc32, round_trip; a null or empty text has no ids.

    Rows that repeat give as many rows; other columns, also of these names, aren't read.
    """
    common.prepare(spark)
    return sentence_pieces.encode_pieces(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("language_id", keep_languages),
    ("jaccard_join", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("decontaminate", drop_benchmark),
    ("sentence_pieces", encode),
]

#: Language models, near-copy components, suffix order and piece paths are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a stage's table goes when the next one stands."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        written = common.Staged("pipeline")
        docs = written(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        before = written
    return docs

"""Queries over the text tables: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the ids that encoding gives, and whether decoding gives the text back."""
    from tidemark.llm.sentence_pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")).select("doc_id", "n_pieces", "ids_crc32", "round_trip")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of 50 words or more that repeat a passage of the documents in kept_ids, which keep it."""
    from tidemark.llm.suffix_dedup import joined_spans, repeated_spans

    return joined_spans(repeated_spans(table(spark, sf_dir, "documents")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language_id import held_out, predict, train

    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in shards by source, a hot one with a third of the rows; they go to 24 shards of equal rows, written and read back."""
    from tidemark.llm.resharding import reshard_and_rewrite

    old = F.pmod(F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")), F.lit(24))
    placed = reshard_and_rewrite(table(spark, sf_dir, "documents"), old, 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ogg_media import store_as_ogg

    return store_as_ogg(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat_format import format_digests

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return format_digests(rows.unionByName(extra))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard_join import link_components

    return link_components(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_files import read_token_blocks, write_token_blocks

    return read_token_blocks(write_token_blocks(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.source_divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents by language, and each one's proof; in a third of the texts capitals are changed before theirs is checked."""
    from tidemark.llm.merkle_manifest import build_manifest, extract_proofs, leaf_digest

    docs = table(spark, sf_dir, "documents")
    changed = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    digest = lambda text: leaf_digest("doc_id", "source", "lang", "n_chars", text)
    leaves = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"), digest(F.col("text")).alias("digest"), F.when(tampered, digest(changed)).alias("claimed"))
    return extract_proofs(build_manifest(leaves)).withColumnRenamed("key", "doc_id")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter an empty index, then lose the lines that ten of them or more have."""
    from tidemark.llm.line_dedup import LineIndex, drop_lines

    docs = table(spark, sf_dir, "documents")
    left = drop_lines(docs, LineIndex.create(spark).insert(docs))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from tidemark.llm.oracles import ORACLES

    return dict(ORACLES)

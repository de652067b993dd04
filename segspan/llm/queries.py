"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chaining, chat, decontam, htmlblocks, jaccard, langid, lengths, mixing, prefixtrie, radix, search, structrepair, suffix


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations")).withColumn("masks", chat.mask_text(F.col("masks")))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlblocks.extract(_table(spark, sf_dir, "pages"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.substring_dedup(_table(spark, sf_dir, "documents"))


def op8_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chaining.fuzzy_dedup(_table(spark, sf_dir, "documents"))
    pairs = F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return found.withColumn("spans", F.coalesce(F.array_join(pairs, ","), F.lit("")))


def op9_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 20 = 0"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_counts(_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.classes(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(prefixtrie.rebuilt(_table(spark, sf_dir, "conversations")))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structrepair.digest(structrepair.repairs(structrepair.damaged(_table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_jaccard_join, op4_chat_perspectives, op5_source_mix, op6_html_extraction, op7_suffix_array_dedup, op8_chained_passages, op9_top_k_search, op10_token_counts, op11_exact_dedup, op12_prefix_trie, op13_structure_repair, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontam.ORACLE, "op4_chat_perspectives": chat.ORACLE, "op5_source_mix": mixing.ORACLE.format(docs="documents"), "op9_top_k_search": search.ORACLE, "op11_exact_dedup": radix.ORACLE, "op12_prefix_trie": prefixtrie.ORACLE, "op13_structure_repair": structrepair.ORACLE}

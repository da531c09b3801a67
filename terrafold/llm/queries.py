"""The queries of the text operators: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import bpe, sql, trie
from terrafold.llm.common import crc_mod, scratch
from terrafold.llm.decontaminate import overlaps
from terrafold.llm.exact_dedup import exact_dedup
from terrafold.llm.html_text import extract
from terrafold.llm.language import identify
from terrafold.llm.lm_score import score as lm_score
from terrafold.llm.manifest import manifest
from terrafold.llm.near_dup import classes
from terrafold.llm.packing import pack
from terrafold.llm.pii import find
from terrafold.llm.token_counts import count_tokens
from terrafold.llm.toxicity import score as toxicity_score


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap the benchmark, one row per document and item."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own for each call, so that every call does the whole work."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), scratch(spark, "token-cache"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def tampered(fields: dict[str, Column]) -> dict[str, Column]:
    """The fields with one more in ``n_chars`` where 7 divides the id's crc32."""
    hit = crc_mod(fields["doc_id"], 7) == 0
    return fields | {"n_chars": F.when(hit, fields["n_chars"] + 1).otherwise(fields["n_chars"])}


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and what tampered ones lead to."""
    proved = manifest(table(spark, sf_dir, "documents"), claimed=tampered)
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def conversation_nodes(rows: DataFrame, **how) -> DataFrame:
    convs = trie.rebuilt(trie.turns(rows), crc_mod(F.col("conv_id"), 4))
    return trie.nodes(convs, **how).withColumn("ends", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256))).withColumnRenamed("ends", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return conversation_nodes(table(spark, sf_dir, "conversations"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what every text encodes to and of what that decodes to."""
    coded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_html_text": op3_html_text,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_language": op7_language,
    "op8_near_dup": op8_near_dup,
    "op9_toxicity": op9_toxicity,
    "op10_lm_score": op10_lm_score,
    "op11_manifest": op11_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_bpe": op13_bpe,
}

ORACLE_SQL: dict[str, str] = {"op4_exact_dedup": sql.OP4, "op11_manifest": sql.OP11, "op12_prefix_trie": sql.OP12}

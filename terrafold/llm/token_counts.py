"""Token counts through a digest cache.

Texts are keyed by the digest of their content and the digest of the tokenizer's
file.  Counts are looked up in a stored table by both; only distinct contents
that the table lacks are encoded, once each, and appended to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import columns_of, path_exists, python_ready

CACHE_SCHEMA = "content_sha256 string, tokenizer_sha256 string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another file is another version."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Counts by the library for the file: sentencepiece for .model, tokenizers for .json.

    No begin, end or added special tokens, no truncation or padding; strings that
    look like special tokens are handled as the library does by default.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    raise ValueError(f"no library for {path}: a .model or .json file is needed")


def _count_batches(path: str, version: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path)
        for batch in batches:
            counts = count(batch.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                names=["content_sha256", "tokenizer_sha256", "n_tokens"],
            )

    return run


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit, content_sha256.

    Content is normalised only as far as counts stay the same for every
    tokenizer: null becomes empty.  ``cache_path`` is a Parquet table in a store
    that driver and executors share; it is made when absent, and what it lacks is
    appended before this returns.  A count that two concurrent runs appended twice
    is read once.  Copies are encoded once however many there are; repeated rows
    and null ids each get their row; extra columns are ignored.
    """
    spark = docs.sparkSession
    python_ready(spark)
    version = tokenizer_version(tokenizer_path)
    content = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = columns_of(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), content.alias("content"))
    rows = rows.withColumn("digest", F.sha2("content", 256))

    # Map-side combining leaves one row per content and task, so copies do not gather in one place.
    missing = rows.groupBy("digest").agg(F.first("content").alias("content"))
    if path_exists(spark, cache_path):
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_sha256") == version)
        missing = missing.join(known, missing["digest"] == known["content_sha256"], "left_anti")
    missing.mapInArrow(_count_batches(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    counts = (
        spark.read.schema(CACHE_SCHEMA)
        .parquet(cache_path)
        .where(F.col("tokenizer_sha256") == version)
        .groupBy(F.col("content_sha256").alias("digest"))
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    return (
        rows.select("id", F.octet_length("content").cast("long").alias("n_bytes"), "digest")
        .join(counts, "digest", "left")
        .select(
            F.col("id").alias(id_col),
            "n_bytes",
            "n_tokens",
            (F.col("n_tokens") > limit).alias("over_limit"),
            F.col("digest").alias("content_sha256"),
        )
    )

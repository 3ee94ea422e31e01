"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``.  All stages but the last return the
columns of ``docs``.  Null and empty texts, repeated rows, extra columns and empty tables are handled as the operators'
docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import byte_bpe, decontamination, language_id, line_templates, near_duplicates


def shielded(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of ``docs``, whose columns of these names keep their values, with the columns of ``docs``."""
    aside = {c: f"__{c}" for c in docs.columns if c in names}
    out = stage(docs.withColumnsRenamed(aside)).drop(*names)
    return out.withColumnsRenamed({v: k for k, v in aside.items()}).select(docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told; those without a letter go."""
    profiles = language_id.learn(docs.where(~language_id.held_out()), key=F.col("doc_id"))
    judged = lambda d: language_id.predict(d, profiles).where(F.col("lang_pred") != language_id.UNDETERMINED)
    return shielded(docs, ("lang_pred", "score"), judged)


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines whose template recurs across documents; ``n_chars`` follows the text."""
    kept = lambda d: line_templates.drop_lines(d, by_family=True).withColumn("n_chars", F.length("text").cast("long"))
    return shielded(docs, ("n_lines", "n_dropped"), kept)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates; of rows that repeat it, one."""
    kept = near_duplicates.classes(docs).where("kept").select("k_id", "k_text").distinct()
    keyed = docs.select("*", *(c.alias(f"__k_{n}") for c, n in zip(near_duplicates.row_keys(docs, "doc_id", "text"), ("id", "text"), strict=True)))
    same = [keyed["__k_text"] == kept["k_text"], keyed["__k_id"].eqNullSafe(kept["k_id"])]
    return keyed.join(kept, same, "left_semi").dropDuplicates(["__k_text", "__k_id"]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a copy of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contaminated(docs, items).select("k_id", "k_text").distinct()
    keyed = docs.withColumn("__k_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = [keyed["__k_text"] == found["k_text"], keyed["doc_id"].eqNullSafe(found["k_id"])]
    return keyed.join(found, same, "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern, decoded=True).drop("text")
    digests = [F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    return encoded.select("doc_id", "lang", "source", "n_tokens", *digests)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_template_lines),
    ("MinHash near-dedup", keep_one_of_each_class),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: The signatures, the alignment and the merges have no SQL form; tests compare with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

"""The stages of corpus_pipeline.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; one without letters, or torn between languages, goes. The text is not changed."""
    from quillon.llm.langid import identify

    return identify(docs.select(*DOCUMENTS), carry=DOCUMENTS).where("kept").select(*DOCUMENTS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8): that of the smallest doc_id."""
    from quillon.llm.minhash import near_duplicates as find

    found = find(docs)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.select(*DOCUMENTS).join(gone, "doc_id", "left_anti").select(*DOCUMENTS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that started earlier. A character that a cut splits goes whole; n_chars follows.

    No document is dropped, also if nothing of its text is left.
    """
    from quillon.llm.suffix import remove_repeats

    left = remove_repeats(docs.select(*DOCUMENTS), payload="text", carry=["lang", "source", "n_chars"])
    n = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n.alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    from quillon.llm.decontaminate import find_leaks

    return find_leaks(docs.select(*DOCUMENTS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=DOCUMENTS).where("kept").select(*DOCUMENTS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids, and whether decoding them gives its text again."""
    import public_tokenizers

    from quillon.llm.bpe import encode_decode

    out = encode_decode(docs.select(*DOCUMENTS), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, carry=["doc_id", "text"])
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", same.alias("round_trip"))


def run_stages(spark: SparkSession, sf_dir: str, stages: list[tuple[str, Stage]]) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if k < len(stages) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs

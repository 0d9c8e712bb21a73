"""The contract queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.oracles import ORACLE_SQL as ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality import assess

    return assess(_table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillon.llm.bpe import encode_decode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, carry=["doc_id"], payload=False)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.lm import score

    return score(_table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), size=2)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillon.llm.tokenout import token_ids

    return token_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.suffix import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.html import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.warc import read_archives, write_archives

    return read_archives(write_archives(_table(spark, sf_dir, "pages")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), carry=["doc_id"])


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op11_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.gif import features, store

    return features(store(_table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.whitening import whiten

    out = whiten(_table(spark, sf_dir, "embeddings"), carry=["vec_id"])
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def pages_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's language from its text, its markup, its address and its host, by a model of the documents' texts."""
    from quillon.llm.langid import fit, identify, markup_language

    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", text.alias("text"), markup_language(F.col("html")).alias("declared"))
    return identify(pages, declared="declared", host=None, url="url", model=fit(_table(spark, sf_dir, "documents")), carry=["page_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_lm": op3_lm,
    "op4_minhash": op4_minhash,
    "op5_token_ids": op5_token_ids,
    "op6_suffix": op6_suffix,
    "op7_main_text": op7_main_text,
    "op8_warc": op8_warc,
    "op9_decontaminate": op9_decontaminate,
    "op10_langid": op10_langid,
    "op11_gif": op11_gif,
    "op12_whitening": op12_whitening,
    "op13_phrases": op13_phrases,
    "pages_langid": pages_langid,
}

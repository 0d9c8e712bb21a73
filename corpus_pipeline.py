"""Five stages from raw documents to token-checked training text; counted as part of quillon.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents; null texts count as empty, rows with a null
doc_id go through every stage, and an empty table gives an empty result.
"""

from __future__ import annotations

from quillon.llm.pipeline import benchmark_decontamination, byte_bpe, language_id, near_duplicates, run_stages, suffix_dedup

STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: SQL has no merge ranks of BPE, so the rows are tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages applied to the documents of sf_dir."""
    return run_stages(spark, sf_dir, STAGES)

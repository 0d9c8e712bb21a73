"""Repetition coverage: characters inside duplicated lines and n-grams, by rolling hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import MUL, WORD, mapped, mix, prepare, schema

SYMBOLS = "#*$%&|<>"
#: Most per cent of the words' characters that repeats of n-grams of so many words may cover: about twice the
#: usual limits, which a short clean text with a single line said twice would break.
MOST = {5: 30, 6: 29, 7: 28, 8: 27, 9: 26, 10: 25}
#: Most per cent of a text's characters that repeated lines may hold.
MOST_LINES = 30
#: Fewest words, and most per cent of words inside repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50


def _again(h: np.ndarray, at: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows of n words at the ascending places at occur twice or more, and which occurred before; h are their hashes.

    Equal hashes are only candidates: neighbours in hash order are compared word by word, and where any
    differ the windows are counted exactly instead.
    """
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice, later = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    if not same.any():
        return twice, later
    a, b = at[order[:-1][same]], at[order[1:][same]]
    if all((ids[a + k] == ids[b + k]).all() for k in range(n)):
        twice[order[:-1][same]] = True
        later[order[1:][same]] = True
        return twice | later, later
    first: dict[bytes, int] = {}
    for k, p in enumerate(at):
        lead = first.setdefault(ids[p : p + n].tobytes(), k)
        if lead != k:
            twice[[lead, k]] = True
            later[k] = True
    return twice, later


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """The words inside windows of n words at the places at."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, lengths: tuple[int, ...] = tuple(MOST)) -> list[int]:
    """[n_words, word_chars, n_symbols, n_dup_lines, dup_line_chars, n_repeat_words, chars covered for each length]."""
    text = text or ""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup_lines += 1
                dup_chars += len(line)
            elif line.strip(" \t\n\r\x0b\x0c"):
                seen.add(line)
    size = len(words)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=size)
    out = [size, int(lens.sum()), sum(map(text.count, SYMBOLS)), dup_lines, dup_chars]
    covered = dict.fromkeys(lengths, 0)
    repeated = 0
    if size > 3:
        known: dict[str, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=size)
        base = mix(np.arange(1, len(known) + 1, dtype=np.uint64) * MUL)[ids]
        at = np.arange(size - 2)
        h = (base[:-2] * MUL + base[1:-1]) * MUL + base[2:]
        for n in range(3, max(lengths) + 1):
            if n > 3:
                at = at[at <= size - n]
                h = mix(h[: len(at)]) + base[at + n - 1]
            twice, later = _again(h, at, ids, n)
            if not twice.any():
                break
            if n == 3:
                repeated = int(_covered(at[twice], 3, size).sum())
            if n in covered:
                covered[n] = int(lens[_covered(at[later], n, size)].sum())
            at, h = at[twice], h[twice]
    return [*out, repeated, *covered.values()]


def assess(docs: DataFrame, text: str = "text", most: dict[int, int] | None = None, most_lines: int = MOST_LINES, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED, carry: list[str] | None = None) -> DataFrame:
    """Every row of docs with its repetition figures, base_failed and kept.

    n_repeat_words counts all occurrences, the first included; dup_chars_N and dup_line_chars count the
    characters from the second occurrence on. A null or empty text has no words and fails. Columns of docs with the names of the
    figures are replaced. Rows are judged one by one: repeated rows and null ids change nothing. carry names
    the columns to return besides the figures (all, if none are named).
    """
    most = most or MOST
    prepare(docs.sparkSession)
    names = ["text_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"dup_chars_{n}" for n in most)]
    docs = docs.drop(*(x for x in (*names, "base_failed", "kept") if x != text))
    carried = [f for f in docs.schema if carry is None or f.name in carry]
    lengths = tuple(sorted(most))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text)
        rows = np.array([[len(x or ""), *measure(x, lengths)] for x in (y.as_py() for y in batch.column(at))], dtype=np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in kept), *(pa.array(rows[:, k]) for k in range(len(names)))], names=[*kept, *names])

    kept = [f.name for f in carried]
    out = mapped(docs, fn, schema(carried, ", ".join(f"{x} bigint" for x in names)), text)
    out = out.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    good = 100 * F.col("dup_line_chars") <= most_lines * F.col("text_chars")
    for n, limit in most.items():
        good &= 100 * F.col(f"dup_chars_{n}") <= limit * F.col("word_chars")
    return out.withColumn("kept", ~F.col("base_failed") & good)

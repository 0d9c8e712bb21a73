"""Language-model scores by prediction by partial matching (PPM) over bytes.

The trie is held as a table: a row per context of ORDER bytes and next symbol, with its count in the training
texts; a shorter context's counts are sums over the longer ones. With a trained trie, the probability of a
symbol depends on its ORDER bytes of context alone, so it is computed once per distinct (context, symbol) of the
corpus and looked up for each byte. Texts travel in packed blocks; a block asks for the entries it needs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, as_bytes, from_blob, materialize, packed, prepare, release, to_blob, trim, trimmed

#: Bytes of context; text bytes in a block, and those of it that are handled at a time.
ORDER, BLOCK, PART = 4, 16 << 20, 2 << 20
END, SYMBOLS = 256, 257
#: Answers that are packed at a time.
GATHERED = 400_000


def codes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code (context of 4 bytes, symbol) for each byte and each end of the texts raw[at[k]:at[k+1]], and n+1 offsets.

    Bytes before a text count as zeros.
    """
    n = len(at) - 1
    size = np.diff(at)
    pad = ORDER + 1
    sym = np.zeros(len(raw) + pad * n, dtype=np.int64)
    row = np.repeat(np.arange(n), size)
    sym[np.arange(len(raw)) + ORDER + pad * row] = LOWER[raw]
    ends = at[1:] + pad * np.arange(1, n + 1) - 1
    sym[ends] = END
    keep = np.ones(len(sym), dtype=bool)
    for k in range(ORDER):
        keep[at[:-1] + pad * np.arange(n) + k] = False
    out = sym.copy()
    for k in range(1, ORDER + 1):
        out[k:] |= sym[:-k] << (9 + 8 * (k - 1))
    return out[keep], np.concatenate([[0], np.cumsum(size + 1)])


def count_codes(values: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order, and how often each stands where train holds."""
    ranked = np.sort((values << 1) | train)
    code = ranked >> 1
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(ranked & 1, first) if len(first) else first


def spread(values: np.ndarray, known: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[k] for each value that is known[k]; known is ascending and holds all values."""
    if len(values) >> 22:
        return table[np.searchsorted(known, values)]
    ranked = np.sort((values << 22) | np.arange(len(values)))  # a code takes 41 bits
    code = ranked >> 22
    new = np.concatenate([[True], code[1:] != code[:-1]])
    out = np.empty(len(values))
    out[ranked & ((1 << 22) - 1)] = table[np.searchsorted(known, code[new])][np.cumsum(new) - 1]
    return out


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _parts(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows start to end of about PART bytes."""
    start = 0
    while start < len(at) - 1:
        end = max(start + 1, int(np.searchsorted(at, at[start] + PART, side="right")) - 1)
        yield start, end
        start = end


def _count_block(rows: pa.Table) -> dict[str, bytes]:
    """The block's distinct words and codes, each with its count in the training texts."""
    raw, at = as_bytes(rows["text"])
    train = np.array(rows["train"].to_pylist(), dtype=bool)
    seen: Counter[bytes] = Counter()
    every: set[bytes] = set()
    known, counts = [], []
    for start, end in _parts(at):
        body = raw[at[start] : at[end]].tobytes()
        for k in range(start, end):
            words = words_of(body[at[k] - at[start] : at[k + 1] - at[start]])
            if train[k]:
                seen.update(words)
            else:
                every.update(words)
        value, to = codes(raw[at[start] : at[end]], at[start : end + 1] - at[start])
        own, count = count_codes(value, np.repeat(train[start:end], np.diff(to)))
        known.append(own)
        counts.append(count)
    every -= seen.keys()
    word = pa.table({"key": pa.array([*seen, *every], pa.binary()), "n": pa.array([*seen.values(), *[0] * len(every)], pa.int64())})
    key, _, n = _sums(np.concatenate(known), np.concatenate(counts))
    return {"words": to_blob(word), "codes": to_blob(pa.table({"key": key, "n": n}))}


def _unpacked(blocks: DataFrame, column: str, kind: str) -> DataFrame:
    def fn(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in from_blob(blob).to_batches(max_chunksize=100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, block, dtype=np.int64)), *part.columns], names=["block", "key", "n"])

    return blocks.select("block", column).mapInArrow(fn, f"block bigint, key {kind}, n bigint")


def _gathered(df: DataFrame, kind: int) -> DataFrame:
    """Rows (block, key, value) as blobs: one for each block and so many rows of a task, in order of key."""

    def over(batches):
        held, have = [], 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            block = rows["block"].to_numpy()
            order = np.argsort(block, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0]))
            blobs = [to_blob(rows.select(["key", "value"]).take(pa.array(order[a:b])).sort_by("key")) for a, b in zip(start, [*start[1:], len(order)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(block[order[start]]), pa.array(np.full(len(start), kind, dtype=np.int32)), pa.array(blobs, pa.binary())], names=["block", "kind", "blob"])

        for batch in batches:
            held.append(batch)
            have += batch.num_rows
            if have >= GATHERED:
                yield flush()
                held, have = [], 0
        if have:
            yield flush()
        trim()

    return df.select("block", "key", "value").mapInArrow(over, "block bigint, kind int, blob binary")


def _sums(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of each key among them, and the sum of weight for each."""
    known, where = np.unique(key, return_inverse=True)
    return known, where, np.bincount(where, weights=weight, minlength=len(known)).astype(np.int64)


def ppm(code: np.ndarray, count: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 P(symbol | context) for the codes that share their last two context bytes, all of them given.

    Escapes follow method C: a context with t symbols seen, d of them distinct, gives a symbol its count over
    t + d and the escape d over t + d. After an escape, all symbols seen in the longer context are excluded.
    A context never seen in training, or one whose symbols are all excluded, is passed over for free.
    one[c, s] counts symbol s after byte c.
    """
    sym = code & 511
    last = int(code[0] >> 9 & 255) if len(code) else 0
    prob = np.ones(len(code))
    done = np.zeros(len(code), dtype=bool)
    # Orders 4, 3, 2: contexts that differ in their older bytes.
    excluded_n = np.zeros(len(code), dtype=np.int64)  # distinct symbols excluded so far, for each row
    ctx_row, ctx_sym, ctx_count = code >> 9, code, count
    back = np.arange(len(code))  # row -> the row of this order's table
    lower_count = None
    for order in (4, 3, 2):
        ctx = ctx_row
        contexts, of, total = _sums(ctx, ctx_count)
        seen = ctx_count > 0
        distinct = np.bincount(of, weights=seen, minlength=len(contexts)).astype(np.int64)
        if order == 4:
            t, d = total[of][back], distinct[of][back]
        else:
            # what the longer context has excluded here: the counts of its seen symbols at this order
            gone = np.bincount(upper_of, weights=np.where(upper_seen, ctx_count[upper_to], 0), minlength=upper_contexts).astype(np.int64)  # noqa: F821
            t, d = total[of][back] - gone[upper_of[upper_back]], distinct[of][back] - excluded_n  # noqa: F821
        c = ctx_count[back]
        hit = ~done & (c > 0)
        whole = np.maximum(t + d, 1)
        prob[hit] *= (c / whole)[hit]
        pass_on = ~done & (c == 0) & (d > 0)
        prob[pass_on] *= (d / whole)[pass_on]
        done |= hit
        excluded_n = distinct[of][back]
        # the next order's table: drop the oldest byte
        upper_of, upper_seen, upper_contexts, upper_back = of, seen, len(contexts), back
        if order > 2:
            mask = (np.int64(1) << np.int64(9 + 8 * (order - 1))) - 1
            shorter, upper_to, sums = _sums(ctx_sym & mask, ctx_count)
            ctx_sym, ctx_count, ctx_row = shorter, sums, shorter >> 9
            back = upper_to[back]
        else:
            seen2 = np.zeros(SYMBOLS, dtype=bool)
            seen2[(ctx_sym & 511)[seen]] = True
            lower_count = seen2
    # Orders 1 and 0, and the symbols never seen: one context each for all rows here.
    above = lower_count
    for counts in (one[last], one.sum(axis=0)):
        t, d = int(counts[~above].sum()), int(((counts > 0) & ~above).sum())
        c = counts[sym]
        hit = ~done & (c > 0)
        prob[hit] *= c[hit] / max(t + d, 1)
        if d:
            prob[~done & (c == 0)] *= d / (t + d)
        done |= hit
        above = above | (counts > 0)
    prob[~done] /= max(SYMBOLS - int(above.sum()), 1)
    return np.log10(prob)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """One row per row of docs: its key, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes.

    Texts whose crc32(key as text) mod folds is held_out do not train (a null key counts as empty text). score is
    the log10 probability of the lower-cased bytes and one end under the PPM trie of the training texts,
    base_score that of the words and one end under add-one unigram counts. A null or empty text is just its end.
    Repeated rows count as often as they stand. Without training texts every symbol is equally likely.
    """
    spark = docs.sparkSession
    prepare(spark)
    train = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds)) != held_out
    rows = docs.select(F.col(key).cast("bigint").alias("key"), train.alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = packed(rows, BLOCK, _count_block, ["words", "codes"], "lm")
    words, grams = _unpacked(blocks, "words", "binary"), _unpacked(blocks, "codes", "bigint")
    ends = int(docs.select(train.alias("t")).agg(F.count_if("t")).first()[0])

    # Words: a block knows its own counts; it is told those of words that other blocks hold too. The sizes of the
    # vocabulary and of the training texts are observed on the way, so the words are dealt out once.
    of_key = Window.partitionBy("key")
    counted = words.withColumn("c", F.sum("n").over(of_key)).withColumn("lead", F.min("block").over(of_key) == F.col("block"))
    sizes = Observation()
    counted = counted.observe(sizes, F.count_if(F.col("lead") & (F.col("c") > 0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    told = materialize(_gathered(counted.where("c != n").withColumnRenamed("c", "value"), 0), "lm-words")
    release(spark)
    vocabulary, total = int(sizes.get["v"]) + (ends > 0), int(sizes.get["n"]) + ends

    # The trie: at most 256 contexts of one byte reach the driver, with at most 257 symbols each.
    summed = grams.groupBy("key").agg(F.sum("n").alias("n"))
    one = np.zeros((256, SYMBOLS), dtype=np.int64)
    for r in grams.where("n > 0").groupBy(F.expr("int(shiftright(key, 9) & 255)").alias("c"), F.expr("int(key & 511)").alias("s")).agg(F.sum("n").alias("n")).collect():
        one[r.c, r.s] = r.n

    def entries(table: pa.Table) -> pa.Table:
        code = table["key"].to_numpy()
        return pa.table({"key": code, "value": ppm(code, table["n"].to_numpy(), one)})

    trie = materialize(summed.groupBy(F.expr("shiftright(key, 9) & 65535")).applyInArrow(entries, "key bigint, value double"), "lm-trie")
    release(spark)
    asked = _gathered(grams.select("block", "key").join(trie, "key"), 1)

    def scored(held: pa.Table, answers: pa.Table) -> pa.Table:
        own = from_blob(held["words"][0].as_py())
        count = dict(zip(own["key"].to_pylist(), own["n"].to_pylist(), strict=True))
        tables = []
        for kind, blob in zip(answers["kind"].to_pylist(), answers["blob"], strict=True):
            part = from_blob(blob.as_py())
            if kind:
                tables.append(part)
            else:
                count.update(zip(part["key"].to_pylist(), part["value"].to_pylist(), strict=True))
        told = pa.concat_tables(tables)
        known = told["key"].to_numpy()
        order = np.argsort(known)  # all codes of the block are answered
        known, values = known[order], told["value"].to_numpy()[order]
        docs = from_blob(held["docs"][0].as_py())
        del own, tables, told
        raw, at = as_bytes(docs["text"])
        size = total + (vocabulary + 1)
        end_log = float(np.log10((ends + 1) / size))
        logs, n_tokens, n_known, base = [], [], [], []
        for start, end in _parts(at):
            value, to = codes(raw[at[start] : at[end]], at[start : end + 1] - at[start])
            logs.append(np.add.reduceat(spread(value, known, values), to[:-1]))
            body = raw[at[start] : at[end]].tobytes()
            for k in range(start, end):
                c = np.fromiter(map(count.__getitem__, words_of(body[at[k] - at[start] : at[k + 1] - at[start]])), dtype=np.int64)
                n_tokens.append(len(c) + 1)
                n_known.append(int((c > 0).sum()) + (ends > 0))
                base.append(float(np.log10((c + 1) / size).sum()) + end_log)
        logs = np.concatenate(logs)
        return pa.table({key: docs["key"], "held_out": pa.array([not x for x in docs["train"].to_pylist()], pa.bool_()), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([total] * len(base), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(logs, pa.float64()), "n_bytes": pa.array(np.diff(at), pa.int64())})

    answers = told.unionByName(asked)
    return blocks.select("block", "docs", "words").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(trimmed(scored), f"{key} bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint")


def adaptive(texts: list[bytes], trained: list[bytes]) -> list[float]:
    """The same scores, text by text, from dictionaries: slow, for tests."""
    table: dict[tuple[int, ...], Counter] = {}
    for text in trained:
        sym = [0] * ORDER + list(text.lower()) + [END]
        for k in range(ORDER, len(sym)):
            for order in range(ORDER + 1):
                table.setdefault(tuple(sym[k - order : k]), Counter())[sym[k]] += 1
    out = []
    for text in texts:
        sym, log = [0] * ORDER + list(text.lower()) + [END], 0.0
        for k in range(ORDER, len(sym)):
            gone: set[int] = set()
            p = 1.0
            for order in range(ORDER, -1, -1):
                c = {s: n for s, n in table.get(tuple(sym[k - order : k]), {}).items() if s not in gone}
                t, d = sum(c.values()), len(c)
                if sym[k] in c:
                    p *= c[sym[k]] / (t + d)
                    break
                if d:
                    p *= d / (t + d)
                gone |= c.keys()
            else:
                p /= SYMBOLS - len(gone)
            log += np.log10(p)
        out.append(log)
    return out

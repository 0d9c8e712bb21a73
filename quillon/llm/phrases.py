"""Phrase collocations: word-id suffix arrays by prefix doubling in each shard, n-gram counts from LCP intervals, merged by key.

Two passes over the shards. The first sends, for every n-gram of a shard, 32 bits of its key and its count to the key's
bucket; a bucket adds them up and answers each shard with a bit per key: can the n-gram reach the least count at all? Keys
that collide only raise a sum, so no phrase is lost. The second pass sends words and exact counts of those n-grams alone.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import MUL, from_blob, materialize, mix, packed, prepare, release, to_blob, trim, trimmed

#: Longest phrases, in words.
LONGEST = 4
#: Fewest occurrences of a candidate, phrases returned of each language, and the factor of scores.
LEAST, TOP, FACTOR = 30, 2000, 2_000_000
#: A candidate goes if a longer one around it has so many per cent of its occurrences.
INSIDE = 80
#: Text bytes of a shard, and of the input for each bucket of keys.
SHARD, BUCKET = 8 << 20, 8 << 20
#: Bytes that are split into words at once.
PIECE = 1 << 20
#: Groups that the best phrases of a language are first found in.
SALTS = 32

#: To lower case, A-Z only, and all marks between pieces to a comma, which no word holds then.
TO = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz,,,,,,,,,")


def word_ids(texts: list[bytes], known: defaultdict[bytes, int]) -> np.ndarray:
    """The ids of the texts' words in order, new words numbered on, and 0 after each piece and text."""
    out, held, have = [], [], 0
    for k, text in enumerate(texts):
        held.append(text)
        have += len(text)
        if have >= PIECE or k == len(texts) - 1:
            words = b",".join(held).translate(TO).replace(b",", b" , ").split()
            words.append(b",")
            out.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            held, have = [], 0
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """The places of words, ordered by the four words from there on, as far as the piece goes.

    Two rounds of prefix doubling: ranks of pairs of words, then of pairs of ranks.
    """
    wide = np.concatenate([ids, np.zeros(LONGEST, ids.dtype)]).astype(np.int64)
    at = np.flatnonzero(ids)
    if not len(at):
        return at
    key = wide[at] * (wide.max() + 1) + wide[at + 1]
    order = np.argsort(key)
    key = key[order]
    rank = np.zeros(len(wide), np.int64)
    rank[at[order]] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
    key = rank[at] * (len(at) + 1) + np.where(wide[at + 1] > 0, rank[at + 2], 0)
    return at[np.argsort(key)]


def intervals(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to LONGEST: (words, counts) of all distinct n-grams within pieces, words as a matrix of n columns.

    An n-gram is a maximal run of suffixes with a common prefix (LCP) of n words or more.
    """
    at = suffix_array(ids)
    wide = np.concatenate([ids, np.zeros(LONGEST, ids.dtype)])
    new, inside = np.zeros(len(at), dtype=bool), np.ones(len(at), dtype=bool)
    new[:1] = True
    for n in range(1, LONGEST + 1):
        word = np.where(inside, wide[at + n - 1], 0)
        inside = word > 0
        new[1:] |= word[1:] != word[:-1]
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(at)))
        kept = inside[starts]
        yield wide[at[starts[kept]][:, None] + np.arange(n)], counts[kept].astype(np.int32)


class Shard:
    """The distinct n-grams of some documents: for each length the words' ids, counts and 64-bit keys."""

    def __init__(self, langs: list[str], texts: list[bytes]) -> None:
        """langs names each text's language; a word of two languages has two ids."""
        number, by = count(1), defaultdict(list)
        for lang, text in zip(langs, texts, strict=True):
            by[lang].append(text)
        parts, self.words, hashes, self.langs, self.totals = [], [b""], [np.zeros(1, np.uint64)], [""], {}
        for lang in sorted(by):
            known: defaultdict[bytes, int] = defaultdict(number.__next__)
            known[b","] = 0
            ids = word_ids(by.pop(lang), known)
            del known[b","]
            seed = xxhash.xxh3_64_intdigest(lang.encode())
            hashes.append(np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in known), np.uint64, len(known)))
            self.words += known
            self.langs += [lang] * len(known)
            self.totals[lang] = int(np.count_nonzero(ids))
            parts.append(ids)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        base = np.concatenate(hashes)
        self.grams, self.counts, keys = [], [], []
        for grams, counts in intervals(ids):
            key = base[grams[:, 0]]
            for k in range(1, grams.shape[1]):
                key = mix(key * MUL + base[grams[:, k]])
            self.grams.append(grams)
            self.counts.append(counts)
            keys.append(mix(key + np.uint64(grams.shape[1])))
        self.keys = np.concatenate(keys)

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each n-gram's key among the distinct ones, those keys, ascending, and where each bucket begins in them).

        A key is its bucket, then 32 more bits.
        """
        high = (self.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        keys, place = np.unique(high << np.uint64(32) | self.keys & np.uint64(0xFFFFFFFF), return_inverse=True)
        return place, keys, np.searchsorted(keys, np.arange(buckets + 1).astype(np.uint64) << np.uint64(32))

    def phrases(self, n: int, passed: np.ndarray) -> tuple[list[str], list[str], np.ndarray]:
        """(languages, phrases, counts) of the n-grams of n words that passed marks."""
        grams = self.grams[n - 1][passed]
        words, langs = self.words, self.langs
        return [langs[k] for k in grams[:, 0]], [b" ".join([words[k] for k in row]).decode() for row in grams.tolist()], self.counts[n - 1][passed]


def _shard(blob: bytes) -> Shard:
    rows = from_blob(blob)
    return Shard(rows.column("lang").to_pylist(), [x.encode() for x in rows.column("text").to_pylist()])


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, shard: int = SHARD, bucket: int = BUCKET) -> DataFrame:
    """(lang, phrase, words, f): every phrase of 1 to LONGEST words that occurs least times or more in its language, and,
    as words = 0 with a null phrase, the number of word occurrences of each language.

    A null language is `und`, a null text has no words. Written to the shared folder.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blocks = packed(source, shard, lambda rows: {"size": str(rows.column("text").nbytes).encode()}, ["size"], "shards")
    total = blocks.agg(F.sum(F.col("size").cast("string").cast("bigint"))).first()[0] or 0
    buckets = int(total // bucket) + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                one = _shard(blob)
                place, keys, starts = one.dealt(buckets)
                sums = np.minimum(np.bincount(place, np.concatenate(one.counts), len(keys)), least).astype(np.uint32 if least > 255 else np.uint8)
                del one, place
                trim()
                for k in np.flatnonzero(starts[1:] > starts[:-1]).tolist():
                    part = slice(starts[k], starts[k + 1])
                    low = (keys[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    planes = np.diff(low, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4)
                    columns = {f"b{j}": np.ascontiguousarray(planes[:, j]) for j in range(4)} | {"f": sums[part]}
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([k], pa.int64()), pa.array([to_blob(pa.table(columns))], pa.binary())], names=["block", "bucket", "keys"])

    @trimmed
    def answer(rows: pa.Table) -> pa.Table:
        keys, sums, sizes = [], [], []
        for blob in rows.column("keys").to_pylist():
            sent = from_blob(blob)
            planes = np.stack([sent.column(f"b{j}").to_numpy() for j in range(4)], axis=1)
            keys.append(np.cumsum(np.ascontiguousarray(planes).view(np.uint32).ravel(), dtype=np.uint32))
            sums.append(sent.column("f").to_numpy())
            sizes.append(len(keys[-1]))
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        passed = (np.bincount(place, np.concatenate(sums), len(found)) >= least)[place]
        bits = [np.packbits(x).tobytes() for x in np.split(passed, np.cumsum(sizes)[:-1])]
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "bits": pa.array(bits, pa.binary())})

    @trimmed
    def resolve(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for blob in rows.column("docs").to_pylist():
            one = _shard(blob)
            place, keys, starts = one.dealt(buckets)
            passed = np.zeros(len(keys), dtype=bool)
            for k, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
                size = starts[k + 1] - starts[k]
                passed[starts[k] : starts[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(size))
            passed = np.split(passed[place], np.cumsum([len(x) for x in one.counts])[:-1])
            out.append((list(one.totals), [None] * len(one.totals), [0] * len(one.totals), list(one.totals.values())))
            for n in range(1, LONGEST + 1):
                langs, phrases, f = one.phrases(n, passed[n - 1])
                out.append((langs, phrases, [n] * len(langs), f))
        kinds = {"lang": pa.string(), "phrase": pa.string(), "words": pa.int32(), "f": pa.int64()}
        return pa.concat_tables([pa.table({name: pa.array(part[k], kind) for k, (name, kind) in enumerate(kinds.items())}) for part in out])

    sent = blocks.select("block", "docs").mapInArrow(send, "block bigint, bucket bigint, keys binary")
    # written, so that the keys' shuffle can go before texts and phrases are dealt out: Python lets go of its plan in the
    # first round, the JVM of its files in the second
    answers = materialize(sent.groupBy("bucket").applyInArrow(answer, "block bigint, bucket bigint, bits binary"), "answers")
    del sent
    for _ in range(2):
        release(spark)
        time.sleep(1)
    found = blocks.select("block", "docs").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(resolve, "lang string, phrase string, words int, f bigint")
    out = found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return materialize(out.where((F.col("f") >= least) | (F.col("words") == 0)), "phrases")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, shard: int = SHARD, bucket: int = BUCKET) -> DataFrame:
    """The best phrases of 2 to 4 words of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Words are what white space parts within pieces, A-Z in lower case; a phrase lies in one piece. a is how often it occurs,
    l and r how often the parts of its weakest cut do, n all words of the language, score floor(2000000 a / (l + r)). A candidate
    inside a longer one with 80 % of its occurrences is left out. Ties go by a, then the phrase's bytes. A null language is
    `und` and shares it with the language of that name, null and empty texts and an empty table give nothing. Repeated rows count
    again, ids are not read, and of the columns of docs only text and lang are.
    """
    found = counts(docs, text, lang, least, shard, bucket)
    totals = found.where("words = 0").select("lang", F.col("f").alias("n"))
    known = found.where("words > 0")
    candidates = known.where("words > 1").withColumn("_w", F.split("phrase", " "))

    def part(start: Column, size: Column) -> Column:
        return F.array_join(F.slice("_w", start, size), " ")

    # each candidate's cuts, the parts' counts, and the cut of the lowest score
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr(f"(cast({FACTOR} as decimal(8,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("_c"))
    scored = scored.select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score")

    # the most occurrences of a longer candidate around each
    longer = candidates.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    longer = longer.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    around = longer.select("lang", part(F.col("start"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_f"))
    hidden = F.lit(100).cast("decimal(3,0)") * F.col("_f").cast("decimal(19,0)") >= F.lit(INSIDE).cast("decimal(3,0)") * F.col("a").cast("decimal(19,0)")
    left_over = scored.join(around, ["lang", "phrase"], "left").where(F.col("_f").isNull() | ~hidden).drop("_f")

    # the best of each salted part of a language, then of the language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left_over.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("_r") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

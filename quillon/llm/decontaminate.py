"""Benchmark passages in documents: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit distance.

An item of n words is found where some stretch of a document is within n * (100 - percent) // 100 word edits of it.

The CGK walk reads words into coordinates: it writes the current word, then a random bit of (coordinate, word)
decides whether to step on. Two sequences with few edits soon fall into step again and agree in many coordinates,
so edit distance becomes Hamming distance. Each of REPEATS walks samples SAMPLES coordinates of the first 2 m of a
window of m words (on average a walk has read the window by then); the sampled words are the key of a bucket. A
window of a document, which may start at any word, is a candidate for the items that share a bucket with it; no
other pair is ever looked at. Candidates are verified by exact edit distance on the whole item.

Items of more than LONGEST words are looked for by chunks of nearly equal size: if the edits are within the
allowed share of the whole, they are so in one chunk at least. Windows have the size of a chunk, rounded down to
one of a ladder of sizes, each at most an eighth above the one before. Windows that can't hold any chunk are left
out before they are walked: e edits spoil at most 2 e of m - 1 word pairs, so the others must stand in the window.
Repeats and samples give a recall of over 0.99 at a fifth of the words edited (tests/llm/test_parts.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import MUL, as_bytes, mapped, materialize, mix, prepare, schema, sliced
from quillon.llm.minhash import word_hashes

#: Walks, coordinates sampled from each, coordinates a word; most words of a chunk.
REPEATS, SAMPLES, STRETCH, LONGEST = 32, 3, 2, 64
#: Items in a block, and bytes of their texts; fewest words of an item.
ITEMS, ITEM_BYTES, LEAST = 20_000, 8 << 20, 5
#: Windows walked at a time, cells of edit tables at a time, text bytes searched at a time.
WALKED, CELLS, PART = 512, 1 << 21, 2 << 20
#: Bytes that part words: all but ASCII letters, digits and bytes beyond ASCII.
APART = np.ones(256, dtype=bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False

_RNG = np.random.default_rng(20)
#: The random bits of the walks, and the sampled coordinates as shares of the embedding.
ODD = _RNG.integers(0, 1 << 63, size=(STRETCH * LONGEST, REPEATS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WHERE = _RNG.random((REPEATS, SAMPLES))


def spaced(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts raw[at[k]:at[k+1]], each text followed by a zero, and where each text starts (n+1 places)."""
    h, row, _, _ = word_hashes(raw, at, APART)
    n = len(at) - 1
    out = np.zeros(len(h) + n, dtype=np.uint64)
    out[np.arange(len(h)) + row] = np.maximum(h, np.uint64(1))
    return out, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n) + 1)]).astype(np.int64)


def walk(words: np.ndarray, start: np.ndarray, steps: int) -> np.ndarray:
    """steps x starts x repeats: how many words each walk has read before each coordinate. A zero stops it."""
    out = np.empty((steps, len(start), REPEATS), dtype=np.int16)
    at = np.repeat(start[:, None], REPEATS, axis=1)
    for t in range(steps):
        out[t] = at - start[:, None]
        at += ((words[at] * ODD[t]) >> np.uint64(63)).astype(np.int64)
    return out


def rung(size: np.ndarray) -> np.ndarray:
    """The largest size of the ladder that is at most size."""
    ladder = [1]
    while ladder[-1] <= int(size.max(initial=0)):
        ladder.append(ladder[-1] + max(1, ladder[-1] // 8))
    return np.array(ladder)[np.searchsorted(ladder, size, "right") - 1]


def buckets(words: np.ndarray, start: np.ndarray, read: np.ndarray, walked: np.ndarray, size: int) -> np.ndarray:
    """starts x repeats: the bucket of each window of size words, given walks and which of them sets out at its start."""
    repeat = np.arange(REPEATS)
    key = np.broadcast_to((repeat.astype(np.uint64) + np.uint64(1)) * MUL + np.uint64(size), (len(start), REPEATS))
    for s in range(SAMPLES):
        step = (WHERE[:, s] * (STRETCH * size)).astype(np.int64)
        offset = read[step[None, :], walked[:, None], repeat[None, :]].astype(np.int64)
        key = mix(key) + np.where(offset < size, words[start[:, None] + offset], np.uint64(0))
    return mix(key)


def pairs_of(words: np.ndarray) -> np.ndarray:
    """A hash of each two neighbouring words; 0 where either is the end of a text."""
    both = mix(words[:-1] * MUL + words[1:])
    return np.where((words[:-1] == 0) | (words[1:] == 0), np.uint64(0), np.maximum(both, np.uint64(1)))


class Lookup:
    """Which of many keys are known: a table of bits rules out most, a sorted list settles the others."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = np.sort(known)
        self.shift = np.uint64(64 - max(12, min(24, int(8 * len(known) + 1).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.table[(self.known >> self.shift).astype(np.int64)] = True

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of keys that are known, and the range of the list that each equals."""
        at = np.flatnonzero(self.table[(keys >> self.shift).astype(np.int64)])
        low, high = np.searchsorted(self.known, keys[at], "left"), np.searchsorted(self.known, keys[at], "right")
        hit = high > low
        return at[hit], low[hit], high[hit]


class Items:
    """A block of items, ready for search."""

    def __init__(self, ids: list[int], texts: list[str], percent: int, least: int) -> None:
        raw = [x.encode() for x in texts]
        at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.words, self.at = spaced(np.frombuffer(b"".join(raw), dtype=np.uint8), at)
        self.ids, self.n = np.array(ids, dtype=np.int64), np.diff(self.at) - 1
        self.k = self.n * (100 - percent) // 100
        item, offset, size = [], [], []
        for i in np.flatnonzero(self.n >= max(least, 1)).tolist():
            cut = np.linspace(0, int(self.n[i]), -(-int(self.n[i]) // LONGEST) + 1).astype(np.int64)
            item += [i] * (len(cut) - 1)
            offset += cut[:-1].tolist()
            size += np.diff(cut).tolist()
        item, offset, size = (np.array(x, dtype=np.int64) for x in (item, offset, size))
        spoilt = 2 * (size * (100 - percent) // 100)
        size = rung(size)
        self.sizes = np.unique(size)
        self.need = np.array([max(m - 1 - int(spoilt[size == m].max()), 0) for m in self.sizes.tolist()], dtype=np.int64)
        pairs = pairs_of(self.words) if len(self.words) else np.zeros(0, np.uint64)
        usable = np.repeat(self.n >= least, np.diff(self.at))[: len(pairs)]
        self.pairs = Lookup(np.unique(pairs[(pairs > 0) & usable]))
        keys, owners, offsets = [], [], []
        for m in self.sizes.tolist():
            mine = np.flatnonzero(size == m)
            for some in np.array_split(mine, -(-len(mine) // WALKED)):
                start = self.at[item[some]] + offset[some]
                keys.append(buckets(self.words, start, walk(self.words, start, STRETCH * m), np.arange(len(start)), m).ravel())
                owners.append(np.repeat(item[some], REPEATS))
                offsets.append(np.repeat(offset[some], REPEATS))
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.buckets = Lookup(key)
        self.owner, self.offset = (np.concatenate(x)[order].astype(np.int32) if keys else np.zeros(0, np.int32) for x in (owners, offsets))

    def windows(self, words: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(size, starts) of the windows that hold enough of the items' word pairs."""
        hit = np.zeros(len(words), dtype=bool)
        hit[self.pairs.places(pairs_of(words))[0]] = True
        upto = np.concatenate([[0], np.cumsum(hit)])
        start = np.flatnonzero(words)
        if self.need.min(initial=1) > 0:
            # a window with enough pairs has a stretch of `tile` pairs with its share of them
            tile = max(int(self.sizes.min()) - 1, 1)
            share = int(np.min(-(-self.need // -(-(self.sizes - 1) // tile))))
            dense = np.flatnonzero(upto[np.minimum(np.arange(len(words)) + tile, len(words))] - upto[:-1] >= share)
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, np.maximum(dense - int(self.sizes.max()), 0), 1)
            np.add.at(edge, dense + 1, -1)
            start = start[np.cumsum(edge[:-1])[start] > 0]
        out = []
        for m, need in zip(self.sizes.tolist(), self.need.tolist(), strict=True):
            own = start[upto[np.minimum(start + m - 1, len(words))] - upto[start] >= need]
            if len(own):
                out.append((m, own))
        return out

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of a window, item, start of the item's chunk) where both share a bucket."""
        found = self.windows(words)
        every = np.unique(np.concatenate([s for _, s in found])) if found else np.zeros(0, np.int64)
        starts, entries = [], []
        for begin in range(0, len(every), WALKED):
            some = every[begin : begin + WALKED]
            parts = [(m, own[np.searchsorted(own, some[0]) : np.searchsorted(own, some[-1], "right")]) for m, own in found]
            read = walk(words, some, STRETCH * max(m for m, own in parts if len(own)))
            for m, own in parts:
                if not len(own):
                    continue
                key = buckets(words, own, read, np.searchsorted(some, own), m).ravel()
                at, low, high = self.buckets.places(key)
                many = high - low
                starts.append(np.repeat(own[at // REPEATS], many))
                entries.append(np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
        none = np.zeros(0, dtype=np.int64)
        start, entry = (np.concatenate(x) if x else none for x in (starts, entries))
        return start, self.owner[entry].astype(np.int64), self.offset[entry].astype(np.int64)


def distances(item: np.ndarray, n: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Least edits between the first n[c] words of item[c] and any stretch of region[c]; zeros in a region match nothing."""
    rows, width = region.shape
    ramp = np.arange(width + 1, dtype=np.int32)
    line = np.zeros((rows, width + 1), dtype=np.int32)
    out = np.zeros(rows, dtype=np.int32)
    for i in range(int(n.max(initial=0))):
        new = np.empty_like(line)
        new[:, 0] = i + 1
        differs = (region != item[:, i : i + 1]) | (region == 0)
        new[:, 1:] = np.minimum(line[:, :-1] + differs, line[:, 1:] + 1)
        line = np.minimum.accumulate(new - ramp, axis=1) + ramp
        done = n == i + 1
        if done.any():
            out[done] = line[done].min(axis=1)
    return out


def search(items: Items, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) of every item found in the texts raw[at[k]:at[k+1]], distinct and sorted."""
    none = np.zeros(0, dtype=np.int64)
    if not len(items.sizes):
        return none, none
    words, first = spaced(raw, at)
    start, item, offset = items.candidates(words) if len(words) > 1 else (none, none, none)
    # starts of the same item are taken together by cells of n words, so a passage is verified a few times at most
    row = np.searchsorted(first, start, side="right") - 1
    cell = (start - offset - first[row]) // items.n[item]
    row, item, cell = np.unique(np.stack([row, item, cell]), axis=1)
    n, k = items.n[item], items.k[item]
    low, high = first[row] + np.maximum(cell * n - 2 * k, 0), np.minimum(first[row] + (cell + 2) * n + 2 * k, first[row + 1])
    good = np.zeros(len(row), dtype=bool)
    order, begin = np.lexsort((high - low, n)), 0
    while begin < len(order):
        # candidates of about the same size at a time
        end = begin + 1
        while end < len(order) and n[order[end]] <= 1.25 * n[order[begin]] + 8 and (end - begin + 1) * int((high - low)[order[end]]) <= CELLS // 8:
            end += 1
        c = order[begin:end]
        body = _cells(items.words, items.at[item[c]], items.at[item[c]] + n[c], int(n[c].max()))
        region = _cells(words, low[c], high[c], int((high - low)[c].max()))
        good[c] = distances(body, n[c], region) <= k[c]
        begin = end
    both = np.unique(np.stack([row[good], item[good]]), axis=1)
    return both[0], both[1]


def _cells(h: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The words start to end of each row, padded with zeros."""
    at = start[:, None] + np.arange(width)[None, :]
    inside = at < end[:, None]
    return np.where(inside, h[np.minimum(at, len(h) - 1)], np.uint64(0))


def _blocks(benchmark: DataFrame, item: str, text: str, percent: int, least: int) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, one at a time on the driver."""
    ids, held, have = [], [], 0
    for r in benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("bigint").alias("i"), F.col(text).alias("t")).toLocalIterator():
        size = len(r.t.encode())
        if held and (len(ids) >= ITEMS or have + size > ITEM_BYTES):
            yield Items(ids, held, percent, least)
            ids, held, have = [], [], 0
        ids.append(r.i)
        held.append(r.t)
        have += size
    if held:
        yield Items(ids, held, percent, least)


def _found(items: Items, column: pa.Array) -> list[list[int]]:
    """The ids of the items in each text."""
    out: list[list[int]] = [[] for _ in range(len(column))]
    row, found = search(items, *as_bytes(column))
    for r, i in zip(row.tolist(), found.tolist(), strict=True):
        out[r].append(int(items.ids[i]))
    return [sorted(set(x)) for x in out]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", percent: int = 80, least: int = LEAST, carry: list[str] | None = None) -> DataFrame:
    """Every row's carried columns with item_ids (ascending), n_items and kept (no item was found).

    Words are runs of letters and digits, A-Z lower-cased. Items of fewer than `least` words, and those without
    an id or a text, are not looked for; items with equal ids are one. A null or empty text holds no item. No row
    is compared with another: repeated rows get equal results. Clashing columns are replaced.

    A benchmark of at most ITEMS items and ITEM_BYTES bytes travels to the tasks whole. A larger one is searched
    block by block, one at a time: each pass gives the items found by the digest of the text, and the passes meet
    in a join, so no task or driver ever holds more than a block (or a single longer item).
    """
    spark = docs.sparkSession
    prepare(spark)
    names = ["item_ids", "n_items", "kept"]
    cols = [f for f in docs.schema if f.name not in names and (carry is None or f.name in carry)]
    rows = docs.select(F.struct(*(F.col(f"`{f.name}`") for f in cols if f.name != text), F.lit(0).alias("none")).alias("row"), F.col(text).cast("string").alias("text"))
    held = any(f.name == text for f in cols)
    fixed = ["row", "text"] if held else ["row"]
    kind = schema([rows.schema[x] for x in fixed], "item_ids array<bigint>")

    def passed(items: Items):
        def fn(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*part.columns[: len(fixed)], pa.array(_found(items, part.column(1)), pa.list_(pa.int64()))], names=[*fixed, "item_ids"])

        return fn

    def hits(items: Items):
        def fn(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = _found(items, part.column(0))
            some = [k for k, x in enumerate(ids) if x]
            sha = [xxhash.xxh3_128_digest(part.column(0)[k].as_py()) for k in some]
            return pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array([ids[k] for k in some], pa.list_(pa.int64()))], names=["sha", "item_ids"])

        return fn

    blocks = _blocks(benchmark, item, item_text, percent, least)
    one = next(blocks, None)
    more = next(blocks, None)
    if one is None:
        out = rows.select(*fixed, F.array().cast("array<bigint>").alias("item_ids"))
    elif more is None:
        out = mapped(rows, passed(one), kind, "text", PART)
    else:
        found = None
        while one is not None:
            part = materialize(mapped(rows.select("text"), hits(one), "sha binary, item_ids array<bigint>", "text", PART), "leaks")
            found = part if found is None else found.unionByName(part)
            one, more = more, next(blocks, None)
        found = found.select("sha", F.explode("item_ids").alias("i")).groupBy("sha").agg(F.array_sort(F.collect_set("i")).alias("found"))

        def digest(part: pa.RecordBatch) -> pa.RecordBatch:
            sha = pa.array([xxhash.xxh3_128_digest(x.as_py() or "") for x in part.column(1)], pa.binary())
            return pa.RecordBatch.from_arrays([*part.columns[: len(fixed)], sha], names=[*fixed, "sha"])

        keyed = mapped(rows, digest, schema([rows.schema[x] for x in fixed], "sha binary"), "text", PART)
        out = keyed.join(found, "sha", "left").select(*fixed, F.coalesce("found", F.array().cast("array<bigint>")).alias("item_ids"))
    return out.select(*(F.col("text" if f.name == text else f"row.`{f.name}`").alias(f.name) for f in cols), "item_ids", F.size("item_ids").cast("bigint").alias("n_items"), (F.size("item_ids") == 0).alias("kept"))

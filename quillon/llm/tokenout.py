"""Token ids as shards of raw payload, each with a minimal perfect hash index from keys to places.

A shard is one byte string:
  magic QTS1, then unsigned 64-bit little-endian: documents, keyless documents, ids, bytes an id, levels, distinct keys, leftovers
  keys of the keyed documents (signed 64-bit), offsets (documents + 1, unsigned 64-bit, in ids)
  for each level of the hash: its size in bits (64-bit), then its bits
  for each slot: fingerprint (32-bit), first place (32-bit), number of documents with that key (32-bit)
  keys left over by all levels, with their slots (64-bit each)
  payload
Documents stand in ascending key order, keyless ones first. A look-up costs a hash a level, a rank in the bits,
one fingerprint and one offset; it never searches.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import MUL, materialize, mix, prepare, same_bytes, sliced, texts, trim
from quillon.llm.minhash import word_spans

#: Payload bytes of a shard, words in each half of a worker's memory, levels of the hash and bits a key in each.
SHARD, REMEMBERED, LEVELS, GAMMA = 8 << 20, 1_000_000, 24, 2
MAGIC = b"QTS1"


class PerfectHash:
    """Maps n distinct 64-bit keys to 0..n-1: keys alone at their bit of a level stay there, the others try the next."""

    def __init__(self, bits: list[np.ndarray], left: dict[int, int]) -> None:
        self.bits, self.left = bits, left
        self.rank = [np.concatenate([[0], np.cumsum(b, dtype=np.int64)]) for b in bits]
        self.base = np.concatenate([[0], np.cumsum([r[-1] for r in self.rank])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, rest = [], keys.astype(np.int64)
        for level in range(LEVELS):
            if not len(rest):
                break
            at = cls.place(rest, level, GAMMA * len(rest))
            alone = np.bincount(at, minlength=GAMMA * len(rest)) == 1
            bits.append(alone)
            rest = rest[~alone[at]]
        done = int(sum(b.sum() for b in bits))
        return cls(bits, {int(k): done + i for i, k in enumerate(rest)})

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that was never stored, any slot, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for level, bit in enumerate(self.bits):
            todo = np.flatnonzero(out < 0)
            if not len(todo):
                break
            at = self.place(keys[todo], level, len(bit))
            here = bit[at]
            out[todo[here]] = self.base[level] + self.rank[level][at[here]]
        for k in np.flatnonzero(out < 0):
            out[k] = self.left.get(int(keys[k]), -1)
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) * MUL + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)


def build_shard(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A shard of documents in ascending key order, keyless ones first; ids are little-endian, width bytes each."""
    none = sum(k is None for k in keys)
    known = np.array(keys[none:], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(x) // width for x in ids])]).astype("<u8")
    distinct, first, many = np.unique(known, return_index=True, return_counts=True)
    hashed = PerfectHash.build(distinct)
    slot = hashed(distinct)
    table = np.zeros((len(distinct), 3), dtype="<u4")
    table[slot, 0], table[slot, 1], table[slot, 2] = fingerprints(distinct), first + none, many
    head = np.array([len(keys), none, offsets[-1], width, len(hashed.bits), len(distinct), len(hashed.left)], dtype="<u8")
    levels = b"".join(np.array([len(b)], dtype="<u8").tobytes() + np.packbits(b).tobytes() for b in hashed.bits)
    left = np.array([x for kv in hashed.left.items() for x in kv], dtype="<i8").tobytes()
    return b"".join([MAGIC, head.tobytes(), known.astype("<i8").tobytes(), offsets.tobytes(), levels, table.tobytes(), left, *ids])


class Shard:
    """Reads a shard: in order, or by key."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a shard")
        self.raw, at = raw, 4

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.n, self.none, self.n_ids, self.width, levels, distinct, left = map(int, take("<u8", 7))
        self.keys, self.offsets = take("<i8", self.n - self.none), take("<u8", self.n + 1)
        bits = []
        for _ in range(levels):
            size = int(take("<u8", 1)[0])
            bits.append(np.unpackbits(take("u1", -(-size // 8)), count=size).astype(bool))
        self.table = take("<u4", 3 * distinct).reshape(-1, 3)
        pairs = take("<i8", 2 * left).reshape(-1, 2)
        self.hash = PerfectHash(bits, dict(map(tuple, pairs.tolist())))
        self.payload = at

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at a place."""
        a, b = int(self.offsets[place]), int(self.offsets[place + 1])
        return np.frombuffer(self.raw, dtype=f"<u{self.width}", count=b - a, offset=self.payload + a * self.width)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place of each key's documents, and how many there are; -1 and 0 if the shard has none.

        A key that was never stored passes the fingerprint once in 2^32; the stored key at the place settles it.
        """
        keys = np.asarray(keys, dtype=np.int64)
        slot = self.hash(keys)
        hit = slot >= 0
        hit[hit] = self.table[slot[hit], 0] == fingerprints(keys[hit])
        place, many = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        place[hit], many[hit] = self.table[slot[hit], 1], self.table[slot[hit], 2]
        wrong = hit.copy()
        wrong[hit] = self.keys[place[hit] - self.none] != keys[hit]
        place[wrong], many[wrong] = -1, 0
        return place, many


#: Characters for which Python's classes and the tokeniser's are known to agree; other texts are encoded directly.
ODD = re.compile(r"[^\t-\r -~\xa1-\u024f]")


#: How byte-level vocabularies write bytes: visible characters of Latin-1 as they are, the others from U+0100 on, in
#: order; a space stays, since it parts pieces here.
SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
HIDDEN = [b for b in range(256) if b not in SEEN]
ALPHABET = "".join(chr(b) if b in SEEN or b == 32 else chr(256 + HIDDEN.index(b)) for b in range(256))


def distinct_words(raw: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word raw[start:end] among the distinct ones, and where each of these stands first; h are the words' hashes."""
    of, distinct = pd.factorize(h)
    first = np.empty(len(distinct), dtype=np.int64)
    first[of[::-1]] = np.arange(len(h))[::-1]
    size, lead = end - start, first[of]
    unlike = np.flatnonzero((size != size[lead]) | ~same_bytes(raw, start, start[lead], np.minimum(size, size[lead])))
    if len(unlike):
        more: dict[bytes, int] = {}
        heads = []
        for k in unlike.tolist():
            n = more.setdefault(raw[start[k] : end[k]].tobytes(), len(more))
            if n == len(heads):
                heads.append(k)
            of[k] = len(first) + n
        first = np.concatenate([first, heads])
    return of, first


class Words:
    """Words with their ids as arrays, by ascending hash; of words with one hash only one is kept. Values are bytes of width * count."""

    def __init__(self, hashes: np.ndarray, keys: bytes, sizes: np.ndarray, values: bytes, lengths: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        at, to = np.cumsum(sizes) - sizes, np.cumsum(lengths) - lengths
        self.hashes, self.keys, self.values = hashes[order], np.frombuffer(keys, np.uint8), np.frombuffer(values, np.uint8)
        self.at, self.sizes, self.to, self.lengths = at[order], sizes[order], to[order], lengths[order]

    def find(self, raw: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each word raw[start:end], or -1; bytes are compared."""
        out = np.full(len(h), -1, dtype=np.int64)
        if not len(self.hashes):
            return out
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[place] == h) & (self.sizes[place] == end - start))
        place = place[hit]
        same = same_bytes(np.concatenate([raw, self.keys]), start[hit], self.at[place] + len(raw), self.sizes[place])
        out[hit[same]] = place[same]
        return out


class Memory:
    """Ids of words: those learned lately, in two halves of bounded size, of which the older one goes. A half holds sets of words learned together."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, [], []

    def find(self, raw: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[Words, np.ndarray, np.ndarray]]:
        """(words, which of those asked for, their places) for all that are known."""
        left, out = np.argsort(h), []  # in order, look-ups stay close to each other
        for words in (*reversed(self.new), *reversed(self.old)):
            place = words.find(raw, h[left], start[left], end[left])
            hit = place >= 0
            if hit.any():
                out.append((words, left[hit], place[hit]))
                left = left[~hit]
        return out

    def keep(self, words: Words) -> None:
        if sum(len(x.hashes) for x in self.new) + len(words.hashes) > self.size:
            self.old, self.new = self.new, []
        self.new.append(words)
        # few sets, so that a word is looked for in few: equals join
        while len(self.new) > 1 and len(self.new[-1].hashes) * 2 > len(self.new[-2].hashes):
            self.new[-2:] = [joined(*self.new[-2:])]


def gathered(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[at:at + size] of all, one after the other."""
    upto = np.cumsum(sizes)
    return flat[np.repeat(at - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]


def joined(a: Words, b: Words) -> Words:
    """Both sets; of a hash in both, the word of b."""
    keep = ~np.isin(a.hashes, b.hashes)
    at, sizes, to, lengths = (x[keep] for x in (a.at, a.sizes, a.to, a.lengths))
    return Words(
        np.concatenate([a.hashes[keep], b.hashes]), gathered(a.keys, at, sizes).tobytes() + gathered(b.keys, b.at, b.sizes).tobytes(), np.concatenate([sizes, b.sizes]),
        gathered(a.values, to, lengths).tobytes() + gathered(b.values, b.to, b.lengths).tobytes(), np.concatenate([lengths, b.lengths]),
    )


class Encoder:
    """The library's tokeniser, asked for each word only once.

    A vocabulary that lower-cases and splits texts into pieces by a pattern, white space dropped, and whose
    pieces end in a token with the end-of-word suffix, encodes piece by piece. The pieces of new words are then
    encoded together, parted by spaces, and the words' ids are told apart by counting those ends. Other
    vocabularies and texts with unusual characters take the library's plain way.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self._library = path, None
        self.plain = Tokenizer.from_file(path)
        self.width = 2 if self.plain.get_vocab_size() <= 1 << 16 else 4
        self.words = Memory(REMEMBERED)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        steps = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        suffix = rules["model"].get("end_of_word_suffix")
        usual = steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == ["Split", "ByteLevel"] and splits[0].get("behavior") == "Removed" and splits[0].get("invert") and suffix
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"]) if usual else None
        if usual:
            # pieces are normalised, split and written in the byte alphabet already: the tokeniser only parts them at spaces
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(self.plain.get_vocab_size(), dtype=bool)
            self.ends[[k for x, k in rules["model"]["vocab"].items() if x.endswith(suffix)]] = True
        #: Strings that the library turns into single ids wherever they stand; texts with one take its plain way.
        self.added = [x["content"].lower() for x in rules.get("added_tokens") or []]

    @property
    def library(self):
        """The tokeniser as its file has it; loaded when first needed."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=f"<u{self.width}").tobytes()

    def pieces(self, word: str) -> list[str]:
        """The pieces of a normalised word; letters are one piece, and so is a mark after them."""
        if word.isalpha():
            return [word]
        if word[-1] in ",.;:!?" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pattern.findall(word)

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of new words, encoded together."""
        out: list[bytes] = []
        for start in range(0, len(words), 20_000):
            some = words[start : start + 20_000]
            pieces = list(map(bytes.decode, some))
            many = np.ones(len(pieces), dtype=np.int64)
            for k in np.flatnonzero(~np.fromiter(map(str.isalpha, pieces), dtype=bool, count=len(pieces))).tolist():
                found = self.pieces(pieces[k])
                pieces[k], many[k] = " ".join(found), len(found)
            upto = np.cumsum(many)
            ids = np.array(self.plain.encode_batch_fast([codecs.charmap_decode(" ".join(pieces).encode(), "strict", ALPHABET)[0]], add_special_tokens=False)[0].ids, dtype=np.int64)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == upto[-1] and (not len(ids) or stop[-1] == len(ids)):
                raw = ids.astype(f"<u{self.width}").tobytes()
                at = (np.concatenate([[0], stop])[np.concatenate([[0], upto])] * self.width).tolist()
                out += map(raw.__getitem__, map(slice, at[:-1], at[1:]))
            else:
                out += [self.whole(x.decode()) for x in some]
        return out

    def values(self, body: bytes, raw: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each of the distinct words raw[start:end] has its own, how many)."""
        flat, at, many, have = [], np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64), 0
        for words, k, place in self.words.find(raw, h, start, end):
            flat.append(gathered(words.values, words.to[place], words.lengths[place]))
            sizes = words.lengths[place]
            at[k], many[k] = have + np.cumsum(sizes) - sizes, sizes
            have += len(flat[-1])
        todo = np.flatnonzero(at < 0)
        if len(todo):
            keys = [body[a:b] for a, b in zip(start[todo].tolist(), end[todo].tolist(), strict=True)]
            made = self.learn(keys)
            sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
            flat.append(np.frombuffer(b"".join(made), np.uint8))
            at[todo], many[todo] = have + np.cumsum(sizes) - sizes, sizes
            first = np.unique(h[todo], return_index=True)[1]
            if len(first) < len(todo):
                keys, made, todo = [keys[k] for k in first.tolist()], [made[k] for k in first.tolist()], todo[first]
            self.words.keep(Words(h[todo], b"".join(keys), end[todo] - start[todo], b"".join(made), many[todo]))
        return np.concatenate(flat).view(f"<u{self.width}"), at // self.width, many // self.width

    def __call__(self, batch: list[str]) -> list[bytes]:
        """The ids of each text. Only distinct words are looked up; those with equal hashes are compared byte by byte."""
        if self.pattern is None:
            return [self.whole(x) for x in batch]
        out: list[bytes] = [b""] * len(batch)
        usual, held = [], []
        for k, text in enumerate(batch):
            low = "" if ODD.search(text) else (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
            if not low and text or any(x in low for x in self.added):
                out[k] = self.whole(text)
            else:
                usual.append(k)
                held.append(low.encode())
        body = b"".join(held)
        at = np.concatenate([[0], np.cumsum([len(x) for x in held], dtype=np.int64)])
        raw = np.frombuffer(body, dtype=np.uint8)
        h, start, end = word_spans(raw, at, plain=True)
        if not len(h):
            return out
        of, first = distinct_words(raw, h, start, end)
        values, at_, many = self.values(body, raw, h[first], start[first], end[first])
        # ids of the distinct words, then of all
        count = many[of]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = values[np.repeat(at_[of] - upto[:-1], count) + np.arange(upto[-1])].tobytes()
        cut = (upto[np.searchsorted(start, at)] * self.width).tolist()
        for k, a, b in zip(usual, cut[:-1], cut[1:], strict=True):
            out[k] = ids[a:b]
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write_shards(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, order by key and write: a table of shards (part, seq, docs, ids, shard), in order of (part, seq)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, keys, held, have = TaskContext.get().partitionId(), 0, [], [], 0
        coder = _encoder(path)
        width = coder.width
        stop = int(end_id).to_bytes(width, "little")

        def flush() -> pa.RecordBatch:
            nonlocal seq, keys, held, have
            out = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "docs": [len(keys)], "ids": [have // width], "shard": pa.array([build_shard(keys, held, width)], pa.binary())})
            seq, keys, held, have = seq + 1, [], [], 0
            return out

        for batch in batches:
            for start, end in sliced(batch.column(1), 3 << 20):
                some = batch.slice(start, end - start)
                for k, ids in zip(some.column(0).to_pylist(), coder(texts(some.column(1))), strict=True):
                    keys.append(k)
                    held.append(ids + stop)
                    have += len(ids) + width
                    if have >= SHARD:
                        yield flush()
        if keys:
            yield flush()
        trim()

    return materialize(rows.mapInArrow(over, "part bigint, seq bigint, docs bigint, ids bigint, shard binary"), "tokens")


def read_shards(shards: DataFrame, key: str = "doc_id", payload: bool = False) -> DataFrame:
    """One row per stored document: its key, start (ids of all before it), n_tokens, ids_crc32 and, with payload, token_ids.

    Each document is fetched by its key through the index; keyless ones by their place.
    """
    sizes = shards.select("part", "seq", "ids")
    per = sizes.groupBy("part").agg(F.sum("ids").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", "seq", F.coalesce(F.sum("ids").over(inside), F.lit(0)).alias("seq_base")).join(per, "part").select("part", "seq", (F.col("part_base") + F.col("seq_base")).alias("base"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                s = Shard(raw)
                distinct = np.unique(s.keys)
                place, many = s.find(distinct)
                at = np.concatenate([np.arange(s.none), np.repeat(place, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]).astype(np.int64)
                ids = [s.ids(k).astype("<u4") for k in at.tolist()]
                cols = [pa.array(np.full(len(at), part)), pa.array(np.full(len(at), seq)), pa.array([None] * s.none + np.repeat(distinct, many).tolist(), pa.int64()), pa.array(s.offsets[at].astype(np.int64)), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                if payload:
                    cols.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["part", "seq", key, "local", "n_tokens", "ids_crc32", *(["token_ids"] if payload else [])])

    more = ", token_ids array<bigint>" if payload else ""
    rows = shards.select("part", "seq", "shard").mapInArrow(over, f"part bigint, seq bigint, {key} bigint, local bigint, n_tokens bigint, ids_crc32 bigint{more}")
    return rows.join(base, ["part", "seq"]).select(key, (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["token_ids"] if payload else []))


def token_ids(docs: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs as shards and read them back: one row per row of docs.

    A null text is just the end id. Null keys come first and are read by place; rows that share a key stand
    together, ordered by text. A text longer than a shard is a shard of its own. An empty table has no shards.
    """
    return read_shards(write_shards(docs, path, end_id, key, text), key)

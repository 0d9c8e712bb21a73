"""Byte-level BPE as a monoid: encodings of neighbours are joined by re-encoding a growing window at their border.

Why the join is right. Merging picks the lowest rank first, leftmost on ties. Suppose each two neighbouring
tokens of a sequence, encoded together, give themselves again. Then no merge of the whole ever crosses a
border: before the first one that does, both of its sides have merged as they would alone, so it would happen
in the encoding of that pair too. Hence a sequence is the encoding of its bytes if all its neighbouring pairs
are stable, and after a window has been re-encoded only the pairs at its two ends remain to be looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillon.llm.common import mapped, prepare, schema, texts

#: Longest bytes that are merged directly, first number of tokens on each side of a border, and bytes of a border window
#: from which its merges are picked from a heap; ids that are decoded at a time.
LEAF, WINDOW, HEAPED, DECODED = 8, 2, 64, 1 << 10
#: Most pieces whose ids a worker remembers.
REMEMBERED = 600_000
NONE = 1 << 60


class Coder:
    """Encodes and decodes with one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        top = max(ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for raw, at in ranks.items():
            self.bytes_of[at] = raw
        self.known: dict[str, bytes] = {}
        self.pair_stable = lru_cache(maxsize=200_000)(self._pair_stable)

    def leaf(self, raw: bytes) -> list[int]:
        """Merge a run of bytes: the lowest rank first, the leftmost on ties."""
        if len(raw) > HEAPED:
            return self.heaped(raw)
        parts = [raw[k : k + 1] for k in range(len(raw))]
        get = self.ranks.get
        ranks = [get(parts[k] + parts[k + 1], NONE) for k in range(len(parts) - 1)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(parts[k - 1] + parts[k], NONE)
            if k < len(ranks):
                ranks[k] = get(parts[k] + parts[k + 1], NONE)
        return [self.ranks[x] for x in parts]

    def heaped(self, raw: bytes) -> list[int]:
        """The same for a long run: pairs wait in a heap by rank and place, those that no longer stand are passed over."""
        n, get = len(raw), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts at a place; a token's place is its first byte's
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := get(raw[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            middle = end[k]
            if middle < 0 or middle >= n or end[middle] != stop:
                continue
            end[k], end[middle] = stop, -1
            if stop < n:
                before[stop] = k
                if (r := get(raw[k : end[stop]])) is not None:
                    heapq.heappush(heap, (r, k, end[stop]))
            left = before[k]
            if left >= 0 and (r := get(raw[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        out, k = [], 0
        while k < n:
            out.append(self.ranks[raw[k : end[k]]])
            k = end[k]
        return out

    def _pair_stable(self, a: int, b: int) -> bool:
        return self.leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def encode_bytes(self, raw: bytes) -> list[int]:
        """Encode halves, then join them."""
        if len(raw) <= LEAF:
            return self.leaf(raw)
        half = len(raw) // 2
        return self.join(self.encode_bytes(raw[:half]), self.encode_bytes(raw[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of left followed by those of right, both of which are encodings."""
        if not left or not right:
            return left + right
        if self.pair_stable(left[-1], right[0]):
            return left + right
        wide = WINDOW
        while True:
            a, b = max(0, len(left) - wide), min(len(right), wide)
            middle = self.leaf(b"".join([self.bytes_of[x] for x in left[a:] + right[:b]]))
            if (a == 0 or self.pair_stable(left[a - 1], middle[0])) and (b == len(right) or self.pair_stable(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            wide *= 2

    def piece(self, piece: str) -> bytes:
        """The ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return np.array([whole] if whole is not None else self.encode_bytes(raw), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers.

        Matches of the pattern are encoded apart, so joining their ids needs no window.
        """
        known, found = self.known, self.pattern.findall(text)
        try:
            return b"".join(map(known.__getitem__, found))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        new = {x: known.get(x) or self.piece(x) for x in set(found)}
        if len(new) <= REMEMBERED:
            known.update(new)
        return b"".join(map(new.__getitem__, found))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids: halves are decoded and concatenated up the tree."""
        at = np.frombuffer(ids, dtype="<u4")
        if len(at) > DECODED:
            half = len(at) // 2 * 4
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.bytes_of.__getitem__, at.tolist()))


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> Coder:
    """The coder of a file of ranks (a base64 token and its rank in each line); kept by each worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return Coder(ranks, pattern)


def encode_decode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", carry: list[str] | None = None, payload: bool = True) -> DataFrame:
    """Every row of docs with n_tokens, ids_sha256, decoded_sha256 and, with payload, ids (binary, unsigned 32-bit) and decoded (binary).

    ranks is the place of the vocabulary file on every node. A null text counts as empty: no ids, and the
    digests of no bytes. Any length of text and of single words is encoded whole. carry names the columns
    to return besides (all, if none are named); clashing names are replaced.
    """
    prepare(docs.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if payload else [])]
    docs = docs.drop(*(x for x in names if x != text))
    carried = [f for f in docs.schema if carry is None or f.name in carry]
    keep = [f.name for f in carried]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(ranks, pattern)
        ids = [c.encode(x) for x in texts(batch.column(batch.schema.get_field_index(text)))]
        raw = [c.decode(x) for x in ids]
        sha = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (ids, raw)]
        more = [pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array(x, pa.string()) for x in sha), *([pa.array(ids, pa.binary()), pa.array(raw, pa.binary())] if payload else [])]
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in keep), *more], names=[*keep, *names])

    kinds = ["bigint", "string", "string", "binary", "binary"]
    return mapped(docs, fn, schema(carried, ", ".join(f"{x} {k}" for x, k in zip(names, kinds, strict=False))), text)

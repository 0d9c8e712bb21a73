"""Removal of repeated byte strings by a sparse suffix sort: front-coded runs, exchanged and merged by loser trees.

Which suffixes. Every window of `length` bytes has an anchor: the leftmost smallest hash among the strings of
SEED bytes inside it. Equal windows have equal anchors at equal places, so it is enough to sort the suffixes that
start at anchors, about one in forty bytes, and of these only those whose SEED bytes stand elsewhere too.

The sort. Each block sorts its suffixes and front-codes them (length of the prefix shared with the one before,
then the rest). Runs are dealt by the hash of the first SEED bytes, so equal prefixes meet, and merged by a loser
tree that compares prefix lengths first and bytes only from the first unknown one on. The merge yields each
suffix's common prefix with the one before.

The windows. A window that starts d bytes before its anchor is equal to another if the suffixes share length - d
bytes, which the merged prefix lengths tell for whole stretches at once, and if the d bytes before agree, which
is found by a hash and then checked byte by byte. All but the first of equal windows are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField
from pyspark.sql.window import Window

from quillon.llm.common import MUL, as_bytes, from_blob, materialize, mix, packed, prepare, release, schema, sliced, to_blob, trimmed
from quillon.llm.minhash import BASE, PART, power_tables

#: Bytes of a seed; text bytes in a block and for each merge task; members above which a seed is split by window.
SEED, BLOCK, MERGE, HOT = 24, 8 << 20, 16 << 20, 200_000
FIRST = -(1 << 63)


def running(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the polynomial hash, and the inverse powers."""
    pow_, inv = power_tables(len(raw))
    run = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * pow_[: len(raw)], out=run[1:])
    return run, inv


def anchors(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows inside the texts raw[at[k]:at[k+1]]: place, hash, and the most and least bytes by which its windows start before it."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none.astype(np.uint64), none, none
    run, inv = running(raw)
    h = mix((run[SEED:] - run[:-SEED]) * inv[: len(raw) - SEED + 1])
    width = length - SEED + 1
    value, place, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        less = value[step:] < value[:-step]
        value, place = np.where(less, value[step:], value[:-step]), np.where(less, place[step:], place[:-step])
        span += step
    edge = np.zeros(len(raw) + 2, dtype=np.int32)
    long = np.diff(at) >= length
    np.add.at(edge, at[:-1][long], 1)
    np.add.at(edge, at[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(edge)[: len(place)] > 0)
    if not len(start):
        return none, none.astype(np.uint64), none, none
    a = place[start].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    pos = a[new]
    last = start[np.concatenate([new[1:], [len(start)]]) - 1]
    return pos, h[pos], pos - start[new], pos - last


def _block_anchors(length: int):
    def extra(rows: pa.Table) -> dict[str, bytes]:
        raw, at = as_bytes(rows["text"])
        column = rows["text"].combine_chunks()
        found = []
        for start, end in sliced(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, PART):
            pos, _, most, least = anchors(raw[at[start] : at[end]], at[start : end + 1] - at[start], length)
            found.append((pos + at[start], most, least))
        pos, most, least = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True))
        return {"anchors": to_blob(pa.table({"gap": np.diff(pos, prepend=0).astype(np.int32), "most": most.astype(np.uint8), "least": least.astype(np.uint8)}))}

    return extra


def _held(docs: bytes, blob: bytes) -> tuple:
    """(rows, raw, at, pos, hash, most, least) of a block."""
    rows, found = from_blob(docs), from_blob(blob)
    raw, at = as_bytes(rows["text"])
    pos = np.cumsum(found["gap"].to_numpy().astype(np.int64))
    h = np.zeros(len(pos), dtype=np.uint64)
    start = 0
    while start < len(pos):
        end = int(np.searchsorted(pos, pos[start] + PART))
        base = pos[start]
        run, inv = running(raw[base : pos[end - 1] + SEED])
        p = pos[start:end] - base
        h[start:end] = mix((run[p + SEED] - run[p]) * inv[p])
        start = end
    return rows, raw, at, pos, h, found["most"].to_numpy().astype(np.int64), found["least"].to_numpy().astype(np.int64)


def _seeds(batches):
    for batch in batches:
        for block, docs, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            key, n = np.unique(_held(docs, blob)[4].view(np.int64), return_counts=True)
            for k in range(0, len(key), 100_000):
                part = key[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), block, dtype=np.int64)), pa.array(n[k : k + 100_000])], names=["key", "block", "n"])


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which known bytes need no look."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known : known + 16], b[known : known + 16]
        if x != y:
            for p, q in zip(x, y, strict=False):
                if p != q:
                    return known
                known += 1
            return known
        known += len(x)
    return n


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs, each given with the prefix lengths that neighbours share.

    Returns (run, place in it) in sorted order, and for each the length of the prefix shared with the one before.
    A node of the tree keeps the loser of its match and the prefix that loser shares with the winner that passed
    it. Of two players measured against the same last winner, the one sharing more with it comes first; only if
    they share equally are bytes compared, from there on.
    """
    live = [k for k, (s, _) in enumerate(runs) if s]
    if not live:
        return [], []
    size = 1
    while size < len(live):
        size *= 2
    runs = [runs[k] for k in live]
    loser: list[int] = [-1] * size
    loser_lcp = [0] * size
    at = [0] * len(runs)
    head: list[bytes | None] = [r[0][0] for r in runs] + [None] * (size - len(runs))

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner, its prefix with the last output, loser, its prefix with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, la, b, 0
        if x is None:
            return b, lb, a, 0
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        k = shared_prefix(x, y, la)
        if k == len(x) or k < len(y) and x[k] < y[k]:
            return a, la, b, k
        return b, lb, a, k

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, 0
        a, la = build(2 * node)
        b, lb = build(2 * node + 1)
        w, lw, loser[node], loser_lcp[node] = play(a, la, b, lb)
        return w, lw

    winner, lcp = build(1)
    order, lcps = [], []
    while head[winner] is not None:
        order.append((live[winner], at[winner]))
        lcps.append(lcp)
        strings, shared = runs[winner]
        at[winner] = k = at[winner] + 1
        if k < len(strings):
            head[winner], lcp = strings[k], shared[k]
        else:
            head[winner], lcp = None, 0
        node = (winner + size) >> 1
        while node:
            other, lo = loser[node], loser_lcp[node]
            if head[winner] is not None and lcp > lo:
                pass  # the usual case: the loser stays, and shares with the new winner what it shared with the old
            else:
                winner, lcp, loser[node], loser_lcp[node] = play(winner, lcp, other, lo)
            node >>= 1
    return order, lcps


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    shared, rest, before = [], [], b""
    for s in strings:
        k = shared_prefix(before, s, 0)
        shared.append(k)
        rest.append(s[k:])
        before = s
    return shared, rest


def front_decode(shared: list[int], rest: list[bytes]) -> list[bytes]:
    out, before = [], b""
    for k, r in zip(shared, rest, strict=True):
        before = before[:k] + r
        out.append(before)
    return out


def _stretches(flag: np.ndarray, first: int, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes [start, end) covered by flagged windows: flag[m, k] is the window that starts first + k bytes before pos[m]."""
    wide = np.zeros((len(flag), flag.shape[1] + 2), dtype=np.int8)
    wide[:, 1:-1] = flag
    turn = np.diff(wide, axis=1)
    row, low = np.nonzero(turn == 1)
    _, high = np.nonzero(turn == -1)
    return pos[row] - (first + high - 1), pos[row] - (first + low) + length


def _runs(length: int, parts: int):
    """Of a block and its live seeds: front-coded runs by part, and stretches that the block itself shows to be repeated."""

    def fn(held: pa.Table, live: pa.Table) -> pa.Table:
        out: dict[str, list] = {"part": [], "kind": [], "block": [], "blob": []}
        if held.num_rows == 0:
            return pa.table(out, schema=RUNS)
        block = held["block"][0].as_py()
        rows, raw, at, pos, h, most, least = _held(held["docs"][0].as_py(), held["anchors"][0].as_py())
        keep = np.isin(h.view(np.int64), live["key"].to_numpy())
        pos, h, most, least = pos[keep], h[keep], most[keep], least[keep]
        row = np.searchsorted(at, pos, side="right") - 1
        doc = rows["key"].to_numpy()[row]
        offset = pos - at[row]
        order = np.lexsort((offset, doc))
        body = raw.tobytes()
        seen: set[tuple[bytes, int]] = set()
        mine, local = [], []
        for k in order.tolist():
            p = int(pos[k])
            context = (body[p - int(most[k]) : p - int(least[k]) + length], int(most[k]))
            if context in seen:
                local.append(k)
            else:
                seen.add(context)
                mine.append(k)
        if local:
            where = np.array(local)
            out["part"].append(int(mix(np.array([block], dtype=np.uint64))[0] % np.uint64(parts)))
            out["kind"].append(1)
            out["block"].append(block)
            out["blob"].append(to_blob(pa.table({"start": (pos[where] - most[where]).astype(np.int32), "end": (pos[where] - least[where] + length).astype(np.int32)})))
        del seen
        dealt = (h >> np.uint64(7)) % np.uint64(parts)
        by: dict[int, list[tuple[bytes, int]]] = {}
        for k in mine:
            p = int(pos[k])
            by.setdefault(int(dealt[k]), []).append((body[p : p - int(least[k]) + length], k))
        for part, run in by.items():
            run.sort()
            where = np.array([k for _, k in run])
            shared, rest = front_code([s for s, _ in run])
            left = [body[int(pos[k]) - int(most[k]) : int(pos[k])] for k in where]
            out["part"].append(part)
            out["kind"].append(0)
            out["block"].append(block)
            out["blob"].append(to_blob(pa.table({"shared": pa.array(shared, pa.uint16()), "rest": pa.array(rest, pa.binary()), "left": pa.array(left, pa.binary()), "doc": doc[where], "offset": offset[where], "pos": pos[where].astype(np.int32), "most": most[where].astype(np.uint8), "least": least[where].astype(np.uint8)})))
        return pa.table(out, schema=RUNS)

    return fn


RUNS = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])
SPANS = pa.schema([("block", pa.int64()), ("blob", pa.binary())])


def later_windows(lcp: np.ndarray, left: np.ndarray, rank: np.ndarray, most: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """flag[m, d]: the window that starts d bytes before suffix m equals one of a member of smaller rank.

    Suffixes are in sorted order, lcp is each one's common prefix with the one before, left[m, -d] the d-th byte before it.
    """
    wide = left.shape[1]
    flag = np.zeros((len(lcp), wide + 1), dtype=bool)
    hashed = np.zeros(len(lcp), dtype=np.uint64)
    for d in range(wide + 1):
        if d:
            hashed = hashed * np.uint64(BASE) + left[:, wide - d].astype(np.uint64) + np.uint64(1)
        at = np.flatnonzero((least <= d) & (d <= most))
        if len(at) < 2:
            continue
        stretch = np.cumsum(lcp < length - d)[at].astype(np.uint64)
        key = mix(stretch * MUL + mix(hashed[at]))
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        if new.all():
            continue
        members, group = at[order], np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        first = np.minimum.reduceat(rank[members], begin)
        twice = ~new
        twice[:-1] |= ~new[1:]
        m, lead = members[twice], members[begin][group[twice]]
        if (stretch[order][twice] != stretch[order][begin][group[twice]]).any() or d and (left[m, wide - d :] != left[lead, wide - d :]).any():
            # two different windows share a hash: group these exactly
            least_of: dict[tuple[int, bytes], int] = {}
            keys = [(int(s), left[k, wide - d :].tobytes()) for s, k in zip(stretch, at, strict=True)]
            for key_, k in zip(keys, at, strict=True):
                least_of[key_] = min(least_of.get(key_, int(rank[k])), int(rank[k]))
            flag[at, d] = [least_of[key_] < rank[k] for key_, k in zip(keys, at, strict=True)]
            continue
        flag[members, d] = rank[members] > first[group]
    return flag


def _merged(length: int):
    def fn(rows: pa.Table) -> pa.Table:
        blocks, blobs, runs, tables = [], [], [], []
        for kind, block, blob in zip(*(rows[x].to_pylist() for x in ("kind", "block", "blob")), strict=True):
            if kind == 1:
                blocks.append(block)
                blobs.append(blob)
                continue
            t = from_blob(blob)
            shared = t["shared"].to_pylist()
            runs.append((front_decode(shared, t["rest"].to_pylist()), shared))
            tables.append((block, t))
        if runs:
            order, lcps = merge(runs)
            del runs
            run_of = np.fromiter((r for r, _ in order), dtype=np.int64, count=len(order))
            base = np.concatenate([[0], np.cumsum([t.num_rows for _, t in tables])])
            at = base[run_of] + np.fromiter((k for _, k in order), dtype=np.int64, count=len(order))
            del order
            whole = pa.concat_tables([t for _, t in tables])
            doc, offset, pos, most, least = (whole[x].to_numpy()[at].astype(np.int64) for x in ("doc", "offset", "pos", "most", "least"))
            raw, to = as_bytes(whole["left"])
            wide = int(most.max(initial=0))
            left = np.zeros((len(at), wide), dtype=np.uint8)
            size = np.diff(to)[at]
            col = np.arange(wide)[None, :] - (wide - size)[:, None]
            inside = col >= 0
            left[inside] = raw[(to[:-1][at][:, None] + col)[inside]]
            rank = np.empty(len(at), dtype=np.int64)
            rank[np.lexsort((pos, run_of, offset, doc))] = np.arange(len(at))
            flag = later_windows(np.array(lcps), left, rank, most, least, length)
            by_run, cut = np.argsort(run_of, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(run_of, minlength=len(tables)))])
            for r, (block, _) in enumerate(tables):
                mine = by_run[cut[r] : cut[r + 1]]
                some = mine[flag[mine].any(axis=1)]
                if len(some):
                    start, end = _stretches(flag[some], 0, pos[some], length)
                    blocks.append(block)
                    blobs.append(to_blob(pa.table({"start": start.astype(np.int32), "end": end.astype(np.int32)})))
        return pa.table({"block": blocks, "blob": blobs}, schema=SPANS)

    return fn


def _hot_windows(length: int):
    """The block's first window of each content at anchors on hot seeds, by a 128-bit hash; the others as spans."""

    def fn(held: pa.Table, hot: pa.Table) -> pa.Table:
        import xxhash

        if held.num_rows == 0 or hot.num_rows == 0:
            return HOTS.empty_table()
        block = held["block"][0].as_py()
        rows, raw, at, pos, h, most, least = _held(held["docs"][0].as_py(), held["anchors"][0].as_py())
        keep = np.isin(h.view(np.int64), hot["key"].to_numpy())
        pos, most, least = pos[keep], most[keep], least[keep]
        body = raw.tobytes()
        count = most - least + 1
        start = np.repeat(pos - most, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        row = np.searchsorted(at, start, side="right") - 1
        doc, offset = rows["key"].to_numpy()[row], start - at[row]
        order = np.lexsort((start, offset, doc))
        start, doc, offset = start[order], doc[order], offset[order]
        sha = np.frombuffer(b"".join(xxhash.xxh3_128_digest(body[p : p + length]) for p in start.tolist()), dtype="<i8").reshape(-1, 2)
        by = np.lexsort((np.arange(len(start)), sha[:, 1], sha[:, 0]))
        lead = np.concatenate([[True], (sha[by[1:]] != sha[by[:-1]]).any(axis=1)]) if len(by) else np.zeros(0, bool)
        first, again = by[lead], np.sort(start[by[~lead]])
        n = len(first)
        out = pa.table({"k1": sha[first, 0], "k2": sha[first, 1], "doc": doc[first], "offset": offset[first], "block": np.full(n, block), "pos": start[first], "blob": pa.nulls(n, pa.binary())}, schema=HOTS)
        if not len(again):
            return out
        one = {x: [None] for x in HOTS.names} | {"block": [block], "blob": [_span_blob(again, length)]}
        return pa.concat_tables([out, pa.table(one, schema=HOTS)])

    return fn


def _span_blob(start: np.ndarray, length: int) -> bytes:
    return to_blob(pa.table({"start": start.astype(np.int32), "end": (start + length).astype(np.int32)}))


HOTS = pa.schema([*((x, pa.int64()) for x in ("k1", "k2", "doc", "offset", "block", "pos")), ("blob", pa.binary())])


def _cut(payload: str | None, key: str):
    def fn(held: pa.Table, spans: pa.Table) -> pa.Table:
        rows = from_blob(held["docs"][0].as_py())
        raw, at = as_bytes(rows["text"])
        edge = np.zeros(len(raw) + 1, dtype=np.int32)
        for blob in spans["blob"].to_pylist():
            t = from_blob(blob)
            np.add.at(edge, t["start"].to_numpy(), 1)
            np.add.at(edge, t["end"].to_numpy(), -1)
        gone = np.cumsum(edge[:-1]) > 0
        n, removed, spans_n, sha, left = [], [], [], [], []
        for k in range(len(at) - 1):
            g, body = gone[at[k] : at[k + 1]], raw[at[k] : at[k + 1]]
            out = body[~g].tobytes()
            n.append(len(body))
            removed.append(int(g.sum()))
            spans_n.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if len(g) else 0)
            sha.append(hashlib.sha256(out).hexdigest())
            left.append(out)
        id_ = pa.array(rows["id"].to_pylist(), pa.int64())
        cols = {key: id_, "row": rows["row"], "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans_n, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if payload == "bytes":
            cols["kept_bytes"] = pa.array(left, pa.binary())
        elif payload == "text":
            cols["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in left], pa.string())
        return pa.table(cols)

    return fn


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, payload: str | None = None, hot: int = HOT, carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: key, the columns in carry, n_bytes, n_removed, n_spans, kept_sha256 and, with payload "bytes" or "text", kept_bytes or kept_text.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a row of a smaller key, or
    earlier in the same row. Strings are judged on the input and never cross rows. A null key comes before all
    others, a null text is empty; of rows that share a key the one in the earlier block comes first. kept_bytes
    may not be UTF-8, as cuts fall on bytes; kept_text leaves out characters that a cut splits. A seed with over `hot` members is not brought to one task: its
    windows are grouped one by one, by hashes of 128 bits, the first of each content in each block.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(key).cast("bigint"), F.lit(FIRST)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(F.lit(0).alias("none"), *(F.col(f"`{x}`") for x in carry or [])).alias("row"))
    blocks = packed(rows, BLOCK, _block_anchors(length), ["anchors"], "suffix")
    total = blocks.count() * BLOCK
    parts = max(12, -(-total // MERGE))
    seeds = blocks.select("block", "docs", "anchors").mapInArrow(_seeds, "key bigint, block bigint, n bigint")
    by_key = Window.partitionBy("key")
    live = materialize(seeds.withColumn("all", F.sum("n").over(by_key)).where("all > 1").select("block", "key", (F.col("all") > hot).alias("hot")), "suffix-live")
    release(spark)
    cold = live.where("not hot").select("block", "key")
    runs = blocks.groupBy("block").cogroup(cold.groupBy("block")).applyInArrow(trimmed(_runs(length, parts)), "part bigint, kind int, block bigint, blob binary")
    spans = runs.groupBy("part").applyInArrow(trimmed(_merged(length)), "block bigint, blob binary")
    if live.where("hot").take(1):
        windows = materialize(blocks.groupBy("block").cogroup(live.where("hot").select("block", "key").groupBy("block")).applyInArrow(trimmed(_hot_windows(length)), "k1 bigint, k2 bigint, doc bigint, offset bigint, block bigint, pos bigint, blob binary"), "suffix-hot")
        local, windows = windows.where("blob is not null").select("block", "blob"), windows.where("blob is null")
        place = F.struct("doc", "offset", "block", "pos")
        first = windows.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
        again = windows.join(first, ["k1", "k2"]).where(place > F.col("first")).select("block", "pos")

        def blobs(batches):
            for batch in batches:
                block, pos = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for b in np.unique(block):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([_span_blob(np.sort(pos[block == b]), length)], pa.binary())], schema=SPANS)

        spans = spans.unionByName(local).unionByName(again.mapInArrow(blobs, "block bigint, blob binary"))
    spans = materialize(spans, "suffix-spans")
    release(spark)
    kept = {"bytes": ", kept_bytes binary", "text": ", kept_text string"}.get(payload, "")
    out = blocks.select("block", "docs").groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(trimmed(_cut(payload, key)), schema([StructField(key, LongType()), rows.schema["row"]], f"n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{kept}"))
    return out.select(key, *(F.col(f"row.`{x}`").alias(x) for x in carry or []), *out.columns[2:])

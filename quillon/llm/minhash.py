"""Near-duplicates by SuperMinHash signatures, banding, verification on full sets, and components.

SuperMinHash gives each element a random order of the slots; its value at the j-th slot of that order is j plus
a fraction. A slot keeps the smallest value. Values of step j are at least j, so a set is done as soon as all of
its slots hold less than the next step's number: long texts need two or three steps. The orders used here are
random affine walks over the slots, which visit each slot once and each equally likely at each step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import LOWER, MUL, SPACE, as_bytes, binary, mapped, materialize, mix, prepare, sliced, trim
from quillon.llm.components import components

#: Slots of a signature (a power of two) and rows of a band: a pair at 0.8 shares none of 32 bands once in 10^7.
SLOTS, ROWS = 128, 4
#: Members up to which a bucket's pairs are listed; members and shingles of a block of a larger one.
FEW, MEMBERS, ITEMS = 8, 1024, 2_000_000
MIXED = 0xA24BAED4963EE407
#: Odd, with an inverse modulo 2^64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
#: A prime, and a primitive root of it: a second hash, without the collisions that any base has modulo a power of two.
PRIME = (1 << 31) - 1
ROOT = pow(7, 65537, PRIME)
#: Text bytes handled at a time, which take some 100 times their size while they are, and powers that are kept.
PART, KEPT = 1 << 20, 2 << 20


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def prime_powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n modulo PRIME, each stretch from the one before."""
    out = np.ones(n + 1, dtype=np.uint32)
    done = 1
    while done <= n:
        more = min(done, n + 1 - done)
        out[done : done + more] = out[:more].astype(np.uint64) * np.uint64(pow(base, done, PRIME)) % np.uint64(PRIME)
        done += more
    return out


_TABLES = [powers(BASE, KEPT), powers(INVERSE, KEPT)]
_PRIME_TABLES = [prime_powers(ROOT, KEPT), prime_powers(pow(ROOT, -1, PRIME), KEPT)]


def prime_tables(n: int) -> list[np.ndarray]:
    """At least n + 1 powers of the root and of its inverse."""
    return _PRIME_TABLES if n < len(_PRIME_TABLES[0]) else [prime_powers(ROOT, n), prime_powers(pow(ROOT, -1, PRIME), n)]


def power_tables(n: int) -> list[np.ndarray]:
    """At least n + 1 powers of the base and of its inverse; kept, up to twice KEPT."""
    if n < len(_TABLES[0]):
        return _TABLES
    if n > 2 * KEPT:
        return [powers(BASE, n), powers(INVERSE, n)]
    _TABLES[:] = powers(BASE, n), powers(INVERSE, n)
    return _TABLES


def word_spans(raw: np.ndarray, at: np.ndarray, between: np.ndarray = SPACE, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word of the lower-cased texts raw[at[k]:at[k+1]]; between marks the bytes that part words.

    A word's hash mixes its length, a polynomial of its bytes modulo 2^64 and another modulo a prime, both taken
    from running sums. plain leaves out the second, for callers that compare the bytes of words with equal hashes.
    """
    low = LOWER[raw]
    gap = between[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[at] = True  # words don't cross texts
    solid = ~gap
    first = solid.copy()
    first[1:] &= gap[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= gap[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    pow_, inv = power_tables(len(low))
    run = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * pow_[: len(low)], out=run[1:])
    h = mix((run[end] - run[start]) * inv[start] + (end - start).astype(np.uint64) * MUL)
    if plain:
        return h, start, end
    pow_, inv = prime_tables(len(low))
    terms = (low.astype(np.uint64) + np.uint64(1)) * pow_[: len(low)]
    if len(low) > 1 << 24:
        terms %= np.uint64(PRIME)  # the sums must stay below 2^64
    np.cumsum(terms, out=run[1:])
    return mix(h + (run[end] - run[start]) % np.uint64(PRIME) * inv[start] % np.uint64(PRIME)), start, end


def word_hashes(raw: np.ndarray, at: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first byte and end byte of every word."""
    h, start, end = word_spans(raw, at, between)
    return h, np.searchsorted(at, start, side="right") - 1, start, end


def shingles(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of size words, row by row in ascending order, and n+1 offsets.

    A text with fewer words, but one at least, has its whole sequence as its only shingle.
    """
    n = len(at) - 1
    h, row, _, _ = word_hashes(raw, at)
    per = np.bincount(row, minlength=n)
    to = np.concatenate([[0], np.cumsum(per)])
    count = np.where(per >= size, per - size + 1, np.minimum(per, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    out_row = np.repeat(np.arange(n), count)
    begin = to[out_row] + np.arange(out_at[-1]) - out_at[out_row]
    length = np.minimum(per[out_row], size)
    s = length.astype(np.uint64) * MUL
    for k in range(size):
        inside = k < length
        s = np.where(inside, mix(s) + h[np.minimum(begin + k, max(len(h) - 1, 0))], s) if len(h) else s
    s = mix(s)
    order = np.lexsort((s, out_row))
    s, out_row = s[order], out_row[order]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != s[:-1]) | (out_row[1:] != out_row[:-1])
    s, out_row = s[keep], out_row[keep]
    return s, np.concatenate([[0], np.cumsum(np.bincount(out_row, minlength=n))])


def signatures(s: np.ndarray, at: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set s[at[k]:at[k+1]]: an array of n x slots; all ones for empty sets.

    A value holds its step in the upper 8 bits and 56 bits of fraction.
    """
    n = len(at) - 1
    out = np.full(n * slots, np.uint64(0xFFFFFFFFFFFFFFFF))
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    seed = mix(s + MUL)
    offset = (seed & np.uint64(slots - 1)).astype(np.int64)
    stride = ((seed >> np.uint64(20)) | np.uint64(1)).astype(np.int64) & (slots - 1)
    for step in range(slots):
        value = (mix(s ^ np.uint64((step + 1) * MIXED & (1 << 64) - 1)) >> np.uint64(8)) | (np.uint64(step) << np.uint64(56))
        np.minimum.at(out, row * slots + ((offset + stride * step) & (slots - 1)), value)
        open_ = out.reshape(n, slots).max(axis=1) >= (np.uint64(step + 1) << np.uint64(56)) if step < 255 else np.zeros(n, bool)
        more = open_[row]
        if not more.any():
            break
        if not more.all():
            s, row, offset, stride = s[more], row[more], offset[more], stride[more]
    return out.reshape(n, slots)




def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of each signature, the band's number mixed in."""
    n, slots = sig.shape
    parts = sig.reshape(n, slots // rows, rows)
    h = np.broadcast_to(np.arange(1, slots // rows + 1, dtype=np.uint64) * MUL, (n, slots // rows)).copy()
    for k in range(rows):
        h = mix(h) + parts[:, :, k]
    return mix(h)


def _profile(docs: DataFrame, size: int, slots: int, rows: int) -> DataFrame:
    def over(batches):
        for batch in batches:
            column = batch.column(1)
            for start, end in sliced(column, PART):
                raw, at = as_bytes(column.slice(start, end - start))
                s, to = shingles(raw, at, size)
                keys = bands(signatures(s, to, slots), rows).view(np.int64)
                body = s.tobytes()
                sha = np.frombuffer(b"".join(xxhash.xxh3_128_digest(body[8 * to[k] : 8 * to[k + 1]]) for k in range(end - start)), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(np.diff(to)), pa.array(sha[:, 0].copy()), pa.array(sha[:, 1].copy()), pa.ListArray.from_arrays(pa.array(np.arange(end - start + 1, dtype=np.int32) * (slots // rows)), pa.array(keys.ravel()))], names=["id", "n", "h1", "h2", "bands"])
        trim()

    return docs.mapInArrow(over, "id bigint, n bigint, h1 bigint, h2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def over(batches):
        for batch in batches:
            column = batch.column(1)
            for start, end in sliced(column, PART):
                raw, at = as_bytes(column.slice(start, end - start))
                s, to = shingles(raw, at, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), binary(to * 8, s.tobytes()).cast(pa.binary())], names=["id", "items"])
        trim()

    return docs.mapInArrow(over, "id bigint, items binary")


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose full sets pass 100 * intersection >= percent * union."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        return pa.RecordBatch.from_arrays([x.filter(pa.array(keep)) for x in batch.columns[:2]], names=["a", "b"])

    # b is the pivot, which many pairs may share: it comes last, so that only the finished join holds its set
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    return mapped(joined.select("a", "b", "x", "y"), fn, "a bigint, b bigint").distinct()


def common_counts(items: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of ascending sets: frequent items add whole squares, rare ones single cells."""
    m = len(items)
    out = np.zeros((m, m), dtype=np.int32)
    flat = np.concatenate(items)
    owner = np.repeat(np.arange(m), [len(x) for x in items])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    often = np.diff(np.concatenate([first, [len(flat)]]))
    for k in np.flatnonzero(often > 16).tolist():
        own = owner[first[k] : first[k] + often[k]]
        out[np.ix_(own, own)] += 1
    cells = out.reshape(-1)
    for size in np.unique(often[(often > 1) & (often <= 16)]).tolist():
        rows = owner[first[often == size][:, None] + np.arange(size)]
        for x in range(size):
            for y in range(x + 1, size):
                np.add.at(cells, rows[:, x] * m + rows[:, y], 1)
                np.add.at(cells, rows[:, y] * m + rows[:, x], 1)
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same nodes as the symmetric matrix: a tree for each component."""
    left, out = np.ones(len(linked), dtype=bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            node = queue.pop()
            near = np.flatnonzero(linked[node] & left)
            left[near] = False
            queue += near.tolist()
            out += [(node, int(x)) for x in near]
    return out


def _block_links(percent: int):
    """Links within a block of a bucket, as a forest over its members."""

    def fn(rows: pa.Table) -> pa.Table:
        ids, sizes = rows["id"].to_numpy(), rows["n"].to_numpy()
        raw, at = as_bytes(rows["items"])
        flat = raw.view(np.uint64)
        common = common_counts([flat[x // 8 : y // 8] for x, y in zip(at[:-1], at[1:], strict=True)])
        linked = 100 * common.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - common)
        np.fill_diagonal(linked, False)
        links = forest(linked)
        return pa.table({"a": pa.array([int(ids[x]) for x, _ in links], pa.int64()), "b": pa.array([int(ids[y]) for _, y in links], pa.int64())})

    return fn


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: its key, n_shingles, component_id and kept.

    Texts are linked if the Jaccard similarity of their sets of size-word shingles is percent or more. Words are
    lower-cased (A-Z) and parted by ASCII white space, and told apart by hashes of 64 bits, from two polynomials of
    their bytes; a text of fewer words is one shingle, one without words is linked with nothing. component_id is the smallest key reachable. Rows that share a key are one document; a
    null key is linked with nothing, has a null component_id and is kept. The key must be an integer.

    Equal sets are grouped first. In each band bucket all members are compared with the smallest. A bucket that
    then still holds more than one component is compared in full: a small one pair by pair, a large one in blocks
    of bounded size, of which those that lie within the component of its smallest member are left out. Buckets of
    the same members are compared once. No bucket is capped.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = materialize(_profile(docs, size, slots, rows), "minhash")
    able = found.where("n > 0 and id is not null")
    groups = materialize(able.groupBy("h1", "h2").agg(F.min("id").alias("rep")), "minhash-groups")
    reps = able.join(groups.select(F.col("rep").alias("id"), "h1", "h2"), ["id", "h1", "h2"]).select("id", "n", F.explode("bands").alias("band")).distinct()
    shared = reps.groupBy("band").agg(F.min("id").alias("center"), F.max("id").alias("other")).where("center != other")
    member = materialize(reps.join(shared, "band").select("band", "id", "n", "center"), "minhash-members")

    pairs = materialize(member.where("id != center").select(F.col("id").alias("a"), F.col("center").alias("b")).distinct(), "minhash-pairs")
    need = member.select("id").distinct()
    sets = materialize(_sets(docs.join(need, "id", "left_semi"), size), "minhash-sets")
    links = materialize(_alike(pairs, sets, percent), "minhash-links")
    same_id = able.select(F.col("id").alias("a"), "h1", "h2").join(groups, ["h1", "h2"]).where("a != rep").select("a", F.col("rep").alias("b"))
    comp = components(links)
    center = member.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    labelled = materialize(center.select("band", "id", "n", "c", "center"), "minhash-labelled")
    first, second = F.xxhash64("id"), F.xxhash64("id", F.lit(1))
    per = labelled.groupBy("band").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.bit_xor(first).alias("x"), F.bit_xor(second).alias("y"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.when(F.col("id") == F.col("center"), F.col("c"))).alias("main"))
    per = per.where("lo != hi").groupBy("m", "w", "x", "y").agg(F.min("band").alias("band"), F.min_by("main", "band").alias("main"))
    active = materialize(labelled.join(per.select("band", "m", "w", "main"), "band").select("band", "id", "n", "c", "m", "w", "main"), "minhash-active")
    p, q = active.where(F.col("m") <= FEW).alias("p"), active.where(F.col("m") <= FEW).alias("q")
    new = p.join(q, F.col("p.band") == F.col("q.band")).where(F.expr(f"p.id > q.id and p.c != q.c and 100 * least(p.n, q.n) >= {percent} * greatest(p.n, q.n)"))
    new = materialize(new.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), "minhash-pairs")
    links = links.unionByName(_alike(new, sets, percent))
    # Large buckets: members of the main component and the others lie in different blocks if there are several;
    # a block meets itself and every other, but blocks of the main component don't meet each other.
    large = active.where(F.col("m") > FEW).withColumn("blocks", F.ceil(F.greatest(F.col("m") / MEMBERS, F.col("w") / ITEMS)).cast("int"))
    own = F.when(F.col("c") == F.col("main"), F.lit(0)).otherwise(1) * F.col("blocks") + F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    large = large.withColumn("own", F.when(F.col("blocks") == 1, 0).otherwise(own))
    meets = F.expr("if(blocks = 1, array(0), filter(sequence(0, 2 * blocks - 1), x -> own >= blocks or x >= blocks))")
    large = large.withColumn("other", F.explode(meets)).select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "n")
    blocked = large.join(sets, "id").groupBy("band", "i", "j").applyInArrow(_block_links(percent), "a bigint, b bigint").distinct()
    links = materialize(links.unionByName(blocked), "minhash-links")
    comp = components(links)
    # documents that share a key link their groups
    tied = same_id.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").limit(1).count() if able.select("id").distinct().count() < able.count() else 0
    if tied:
        comp = components(links.unionByName(same_id))
    group = groups.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = able.join(group, ["h1", "h2"]).select("id", "n", F.col("component").alias("component_id"))
    out = out.unionByName(found.where("not (n > 0 and id is not null)").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

"""Exact neighbour search behind a ball index: pivots, shells of bounded size, bounds by the triangle inequality.

Every vector lies in the ball of its nearest pivot, a ball is cut into shells by the distance from its pivot, and a shell
into chunks of a bounded number of rows. A query whose distance from the pivot is d is at least d - hi and lo - d away from
all of a shell's rows, so shells beyond the distance that a query still cares for are never read. What is left is
compared in blocks of queries and chunks, by matrix products. The pivots come from a bounded sample and decide speed alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillon.plans.written import written

#: Pivots, and rows of the sample that they come from.
PIVOTS, SAMPLE = 64, 4096
#: Shells of a ball, rows of a chunk, and queries that meet a chunk at once.
SHELLS, ROWS, QUERIES = 8, 4096, 1024
#: Distances from pivots are right up to this share of the vectors' lengths.
SLACK = 1e-6


def usable(vector: Column, unit: bool = False) -> Column:
    """A vector with entries, all of them numbers; with unit, not all of them 0."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    some = F.exists(vector, lambda c: c != 0) if unit else F.size(vector) > 0
    return F.coalesce(fine & some, F.lit(False))


def group(by: list[str], vector: str) -> Column:
    """One string for the columns that must be equal, nulls included, and the vector's length: only such vectors meet."""
    return F.to_json(F.struct(*by, F.size(vector).alias("_size")), {"ignoreNullFields": "false"})


def by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)


def matrix(structs: pa.Array, field: str = "v") -> np.ndarray:
    """The vectors, all of one length, of an array of structs."""
    return pc.struct_field(structs, field).flatten().to_numpy(zero_copy_only=False).reshape(len(structs), -1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all of y, up to rounding."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0)


def balls(n: int) -> int:
    """Pivots for n rows, a ball of ROWS rows each where n allows: a query's vector is sent to each region that it reaches, so small regions cost more than they save."""
    return max(1, min(PIVOTS, n // ROWS))


def choose_pivots(vectors: DataFrame, key: str, vector: str, count: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Up to count pivots, each the farthest from those before it, among the sample rows of the smallest key hashes."""
    rows = vectors.select(F.xxhash64(key).alias("h"), F.col(vector).alias("v")).orderBy("h").limit(sample).select("v").toArrow().column("v")
    if not len(rows):
        return np.zeros((0, 1))
    x = max((m for _, m in by_length(rows)), key=len)
    found = [0]
    near = squared(x, x[:1])[:, 0]
    while len(found) < count and near.max() > 0:
        found.append(int(near.argmax()))
        near = np.minimum(near, squared(x, x[found[-1]][None])[:, 0])
    return x[found]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distances of rows from pivots, how far each row's may be wrong). Pivots of another length are cut or filled with zeros."""
    p = np.zeros((len(pivots), x.shape[1]))
    k = min(p.shape[1], pivots.shape[1])
    p[:, :k] = pivots[:, :k]
    return np.sqrt(squared(x, p)), SLACK * (np.sqrt((x * x).sum(axis=1)) + np.sqrt((p * p).sum(axis=1)).max(initial=0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest entry is taken out first, so that no square is lost."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row; a pair's value doesn't depend on the other rows, nor on which of the two comes first."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def alike(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(cosines of all rows of x with all of y, up to rounding; are they least or more, exactly)."""
    cos = scaled(x) @ scaled(y).T
    yes = cos >= least
    at, to = np.nonzero(np.abs(cos - least) < 1e-9)
    yes[at, to] = cosines(x[at], y[to]) >= least
    return cos, yes


@dataclass
class Index:
    """regions (g, ball, shell, lo, hi, e, n, chunks), cells (g, ball, shell, chunk, rows: structs of id, kept columns and v, by id)."""

    pivots: np.ndarray
    unit: bool
    regions: DataFrame
    cells: DataFrame


def _vectors(rows: DataFrame, key: str, vector: str, by: list[str], keep: list[str], unit: bool) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    return rows.where(usable(v, unit)).select(group(by, vector).alias("g"), F.col(key).alias("id"), *keep, v.alias("v"))


def build(rows: DataFrame, key: str, vector: str = "embedding", by: list[str] | None = None, keep: list[str] | None = None, unit: bool = False, pivots: np.ndarray | int = PIVOTS, size: int = ROWS) -> Index:
    """An index of all rows whose vector is usable; with unit, of their directions. Vectors meet where by and their lengths agree.

    Written to the shared folder, in three tables. Repeated rows are all there; many rows of one place share a shell and are
    dealt out to its chunks by turns.
    """
    source = _vectors(rows, key, vector, by or [], keep or [], unit)
    p = choose_pivots(source, "id", "v", pivots) if isinstance(pivots, int) else pivots
    p = scaled(p) if unit and len(p) else p

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            n, names = batch.num_rows, batch.schema.names
            ball, r, e = np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
            for at, x in by_length(batch.column(names.index("v"))):
                d, wrong = to_pivots(scaled(x) if unit else x, p)
                ball[at] = d.argmin(axis=1)
                r[at], e[at] = d[np.arange(len(at)), ball[at]], wrong
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball), pa.array(r), pa.array(e), pa.array(np.arange(turn, turn + n))], names=[*names, "ball", "r", "e", "turn"])
            turn += n

    out_type = StructType([*source.schema.fields, *StructType.fromDDL("ball int, r double, e double, turn bigint").fields])
    placed = written(source.mapInArrow(place, out_type), "placed")
    cuts = placed.groupBy("g", "ball").agg(F.percentile_approx("r", [k / SHELLS for k in range(1, SHELLS)], 1000).alias("cuts"))
    shelled = placed.join(cuts, ["g", "ball"]).withColumn("shell", F.size(F.filter("cuts", lambda c: c < F.col("r")))).drop("cuts")
    regions = shelled.groupBy("g", "ball", "shell").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.max("e").alias("e"), F.count("*").alias("n"))
    regions = written(regions.withColumn("chunks", F.ceil(F.col("n") / F.lit(size)).cast("int")), "regions")
    dealt = shelled.join(regions.select("g", "ball", "shell", "chunks"), ["g", "ball", "shell"]).withColumn("chunk", F.pmod("turn", "chunks").cast("int"))
    cells = dealt.groupBy("g", "ball", "shell", "chunk").agg(F.array_sort(F.collect_list(F.struct("id", *(keep or []), "v"))).alias("rows"))
    return Index(p, unit, regions, written(cells, "cells"))


def ask(queries: DataFrame, index: Index, key: str, vector: str = "embedding", by: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(q, g, id, keep, v, far, e) of the usable queries, written: q is a number of the row's own, far its distances from the pivots."""
    source = _vectors(queries, key, vector, by or [], keep or [], index.unit)
    p, unit = index.pivots, index.unit

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names = batch.num_rows, batch.schema.names
            far, e = np.zeros((n, len(p))), np.zeros(n)
            for at, x in by_length(batch.column(names.index("v"))):
                far[at], e[at] = to_pivots(scaled(x) if unit else x, p)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(p)), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(e)], names=[*names, "far", "e"])

    out_type = StructType([*source.schema.fields, *StructType.fromDDL("far array<double>, e double").fields])
    return written(source.mapInArrow(measure, out_type).withColumn("q", F.monotonically_increasing_id()), "asked")


def reach(asked: DataFrame, index: Index, most: Column) -> DataFrame:
    """asked with a row for each region of its group that may hold a vector at most so far away (all of them for a null), and least.

    most may read the columns of asked.
    """
    far = F.element_at("a.far", F.col("r.ball") + 1)
    least = F.greatest(far - F.col("r.hi"), F.col("r.lo") - far, F.lit(0.0)) - F.col("a.e") - F.col("r.e")
    bounded = asked.withColumn("_most", most).alias("a")
    j = bounded.join(index.regions.alias("r"), (F.col("a.g") == F.col("r.g")) & (F.col("a._most").isNull() | (least <= F.col("a._most"))))
    return j.select(*(f"a.{c}" for c in asked.columns if c != "far"), "r.ball", "r.shell", "r.n", "r.chunks", far.alias("dist"), least.alias("least"))


def chunks(reached: DataFrame) -> DataFrame:
    """A row for each chunk of the regions reached."""
    return reached.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))


Kernel = Callable[[pa.StructArray, pa.StructArray], pa.Table | None]


def meet(visits: DataFrame, index: Index, asks: list[str], kernel: Kernel, schema: StructType, queries: int) -> DataFrame:
    """What kernel makes of each block of visiting queries (structs of asks) and chunk of rows; queries is their number."""
    block = F.pmod("q", F.lit(-(-max(queries, 1) // QUERIES)))
    blocks = visits.groupBy("g", "ball", "shell", "chunk", block.alias("block")).agg(F.collect_list(F.struct(*asks)).alias("asked"))
    pairs = blocks.join(index.cells, ["g", "ball", "shell", "chunk"]).select("asked", "rows")
    names = schema.fieldNames()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = kernel(*(batch.column(c).slice(k, 1).flatten() for c in range(2)))
                if found is not None and found.num_rows:
                    yield from found.select(names).combine_chunks().to_batches()

    return pairs.mapInArrow(over, schema)


def same_ids(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Which ids of x equal which of y; a null equals none."""
    if isinstance(x, pa.ChunkedArray):
        x, y = x.combine_chunks(), y.combine_chunks()
    codes = pa.concat_arrays([x, y.cast(x.type)]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    a, b = codes[: len(x)], codes[len(x) :]
    return (a[:, None] == b) & (a[:, None] >= 0)


def nearest(queries: DataFrame, atlas: DataFrame, k: int = 5, digits: int | None = 4, others: bool = False, pivots: int = PIVOTS, size: int = ROWS) -> DataFrame:
    """(query_id, atlas_id, rank): the k nearest atlas entries of each query, equal (rounded) distances in atlas order.

    queries has (query_id, embedding), atlas (atlas_id, embedding). Exact: a query first meets the chunk that its distances
    from the pivots point to, whose k-th entry bounds what else it must see. Vectors that are null, empty or hold null or
    non-finite entries are left out, and so are entries of another length than the query's; with fewer than k entries a
    query gets fewer rows. Repeated rows of queries are answered one by one, repeated entries of the atlas all count.
    With others, an entry of a query's own id is left out.
    """
    index = build(atlas, "atlas_id", pivots=pivots, size=size)
    return search(queries, index, k, digits, others).select("query_id", "atlas_id", "rank")


def search(queries: DataFrame, index: Index, k: int, digits: int | None = 4, others: bool = False) -> DataFrame:
    """nearest() over an index that is there, with q and d besides."""
    asked = ask(queries, index, "query_id")
    n = asked.count()
    step = 10.0**-digits if digits is not None else 0.0

    def kernel(qs: pa.StructArray, rows: pa.StructArray) -> pa.Table | None:
        x, y = matrix(qs), matrix(rows)
        near = squared(x, y)
        if others:
            near[same_ids(pc.struct_field(qs, "id"), pc.struct_field(rows, "id"))] = np.inf
        most = np.partition(near, k - 1, axis=1)[:, k - 1] if k <= len(y) else np.full(len(x), np.inf)
        edge = np.sqrt(most) + step + SLACK * np.sqrt((x * x).sum(axis=1) + (y * y).sum(axis=1).max())
        at, to = np.nonzero((near <= (edge * edge)[:, None]) & np.isfinite(near))
        # candidates again, by differences, as a distance of two rows that doesn't depend on the others
        d = np.sqrt(((x[at] - y[to]) ** 2).sum(axis=1))
        d = np.round(d, digits) if digits is not None else d
        order = np.lexsort((to, d, at))
        at, to, d = at[order], to[order], d[order]
        kept = np.arange(len(at)) - np.searchsorted(at, at) < k
        return pa.table({"q": pc.struct_field(qs, "q").take(pa.array(at[kept])), "atlas_id": pc.struct_field(rows, "id").take(pa.array(to[kept])), "d": d[kept]})

    id_type = index.cells.schema["rows"].dataType.elementType["id"].dataType
    schema = StructType([*StructType.fromDDL("q bigint").fields, StructField("atlas_id", id_type), *StructType.fromDDL("d double").fields])
    asks = ["q", "id", "v"]
    home = reach(asked, index, F.lit(None).cast("double")).where(F.col("n") > k).groupBy("q").agg(F.min(F.struct("dist", "least", "ball", "shell", "chunks")).alias("h"))
    home = written(home.select("q", "h.ball", "h.shell", F.pmod(F.xxhash64("q"), F.col("h.chunks")).cast("int").alias("chunk")), "home")
    first = written(meet(asked.join(home, "q"), index, asks, kernel, schema, n), "first")
    bound = first.groupBy("q").agg(F.count("*").alias("_k"), F.max("d").alias("_d")).where(F.col("_k") >= k)
    bounded = asked.join(bound.select("q", (F.col("_d") + 2 * step).alias("bound")), "q", "left")
    rest = chunks(reach(bounded, index, F.col("bound"))).join(home, ["q", "ball", "shell", "chunk"], "left_anti")
    found = first.unionByName(meet(rest, index, asks, kernel, schema, n))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "atlas_id"))).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", F.col("id").alias("query_id")), "q")


def most_alike(queries: DataFrame, records: DataFrame, by: list[str], least: float, others: bool = False, pivots: int = PIVOTS, size: int = ROWS) -> DataFrame:
    """(new_id, record_id, cos): each query's record of the largest cosine, if that is least or more; equal ones give the largest id.

    queries has (new_id, embedding, by), records (record_id, embedding, by). The same search on vectors of length 1, whose
    distances fall as the cosine rises. Rows whose vector is unusable or 0 have no partner and no row. With others, never the own id.
    """
    index = build(records, "record_id", by=by, unit=True, pivots=pivots, size=size)
    asked = ask(queries, index, "new_id", by=by)
    n, radius = asked.count(), float(np.sqrt(max(2 - 2 * least, 0.0))) + SLACK

    def kernel(qs: pa.StructArray, rows: pa.StructArray) -> pa.Table | None:
        x, y = matrix(qs), matrix(rows)
        cos, yes = alike(x, y, least)
        if others:
            yes &= ~same_ids(pc.struct_field(qs, "id"), pc.struct_field(rows, "id"))
        cos[~yes] = -np.inf
        at, to = np.nonzero(yes & (cos >= cos.max(axis=1, keepdims=True) - 1e-9))
        c = cosines(x[at], y[to])
        order = np.lexsort((to, c, at))
        at, to, c = at[order], to[order], c[order]
        last = np.append(at[1:] != at[:-1], True) if len(at) else np.zeros(0, dtype=bool)
        return pa.table({"q": pc.struct_field(qs, "q").take(pa.array(at[last])), "record_id": pc.struct_field(rows, "id").take(pa.array(to[last])), "cos": c[last]})

    id_type = index.cells.schema["rows"].dataType.elementType["id"].dataType
    schema = StructType([*StructType.fromDDL("q bigint").fields, StructField("record_id", id_type), *StructType.fromDDL("cos double").fields])
    asks = ["q", "id", "v"]
    home = reach(asked, index, F.lit(radius)).groupBy("q").agg(F.min(F.struct("dist", "least", "ball", "shell", "chunks")).alias("h"))
    home = written(home.select("q", "h.ball", "h.shell", F.pmod(F.xxhash64("q"), F.col("h.chunks")).cast("int").alias("chunk")), "home")
    first = written(meet(asked.join(home, "q"), index, asks, kernel, schema, n), "first")
    bounded = asked.join(first.select("q", (F.sqrt(F.greatest(2 - 2 * F.col("cos"), F.lit(0.0))) + SLACK).alias("bound")), "q", "left")
    rest = chunks(reach(bounded, index, F.coalesce(F.col("bound"), F.lit(radius)))).join(home, ["q", "ball", "shell", "chunk"], "left_anti")
    found = first.unionByName(meet(rest, index, asks, kernel, schema, n))
    best = found.groupBy("q").agg(F.max(F.struct("cos", "record_id")).alias("b"))
    return best.join(asked.select("q", F.col("id").alias("new_id")), "q").select("new_id", "b.record_id", "b.cos")

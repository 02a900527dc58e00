"""Exact top-k by inner product as a Voronoi join.

Vectors are dealt to the Voronoi cells of pivots, queries to those of some of
the pivots. Small summaries of the cells (radius, the nearest few
distances; of query groups the radius) give each query group a score that its
queries' k-th neighbours reach for certain: a vector x at distance d from pivot
b scores at least <a,b> - |a| d - |b| R - R d with every query of group a of
radius R. A cell, then a vector, is sent to a group only if its upper bound
<a,x> + R |x| reaches that score. Query groupings of several sizes are tried on
the summaries, and the one with the least to send and to multiply is used: many
small groups where the bounds leave out cells, few where they can't, so that a
vector which every group needs is not sent more often than the queries have
blocks.
Groups and data are solved in blocks of bounded size, and the blocks' best are
ranked once more.

Components are floor(256 x); scores are exact integers. Defined results:
vectors that are null, or hold a null or non-finite component, and rows without
a key take no part; a row that is repeated, whole or by its key, is a row of its
own, as a query and as a candidate of all others; a query meets vectors of its
own length only; vectors without components score 0; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barleaf.llm.common import drop_path, materialize, pick
from barleaf.llm.tokenstore import mix

SCALE, K, EVERY = 256, 5, 50
#: Pivots: a quarter of the root of the number of vectors, between these; queries in a group, if the bounds are of no use.
PIVOTS, MOST_PIVOTS, GROUP_QUERIES = 64, 1024, 4096
#: As many products cost about as much as one vector that is sent.
SENT_PRODUCTS = 256
#: Vectors in a block of data; queries in a block of a group.
BLOCK, QUERY_BLOCK = 65_536, 16_384
HEAD = "row long, vec_id long, dim int, v binary"


def vectors(table: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, dim, q (array<long>) of the rows that take part."""
    raw = pick(table, vec_id="long", embedding="array<double>").where("vec_id is not null and embedding is not null")
    finite = raw.where(F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)))
    return finite.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("q"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim) if dim else np.zeros((len(column), 0), "i8")


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d2 = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)
    cell = d2.argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def dealt(rows: DataFrame, pivots: dict[int, np.ndarray], sizes: list[int]) -> DataFrame:
    """HEAD with cell and distance; for queries also the groups and distances to their pivots, one for each number of groups in ``sizes``."""
    schema = f"{HEAD}, cell int, d double, grp array<int>, dq array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                flat = part.column("q").flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(part), dim)
                own = pivots.get(dim, np.zeros((1, dim)))
                cell, d = nearest(flat.astype("f8"), own)
                asks = part.column("vec_id").to_numpy() % EVERY == 0
                tried = [nearest(flat[asks].astype("f8"), own[:n]) for n in sizes]
                place, lists = np.cumsum(asks) - 1, [[None] * len(part), [None] * len(part)]
                for i in np.flatnonzero(asks):
                    lists[0][i], lists[1][i] = [int(g[place[i]]) for g, _ in tried], [float(x[place[i]]) for _, x in tried]
                packed = pa.array([x.tobytes() for x in flat], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("vec_id"), part.column("dim"), packed, pa.array(cell.astype("i4")), pa.array(d), pa.array(lists[0], pa.list_(pa.int32())), pa.array(lists[1], pa.list_(pa.float64()))], ["row", "vec_id", "dim", "v", "cell", "d", "grp", "dq"])

    return rows.mapInArrow(run, schema)


def slack(x):
    """Room for rounding in a bound."""
    return 1e-6 * (1 + np.abs(x))


def plan(rows: DataFrame, pivots: dict[int, np.ndarray], sizes: list[int], k: int) -> tuple[int, dict]:
    """Which of ``sizes`` costs least, and for it per (dim, group): its pivot, radius, sure score, the cells that can matter, and its numbers of query blocks and queries. From summaries of the cells only."""
    cells: dict = {}
    near = rows.select("dim", "cell", "d", F.row_number().over(Window.partitionBy("dim", "cell").orderBy("d")).alias("i")).where(F.col("i") <= k + 1)
    near = near.groupBy("dim", "cell").agg(F.collect_list("d").alias("near"))
    for r in rows.groupBy("dim", "cell").agg(F.max("d").alias("radius"), F.count("*").alias("n")).join(near, ["dim", "cell"]).collect():
        cells.setdefault(r.dim, {})[r.cell] = r
    asked = rows.where("grp is not null").select("dim", F.posexplode(F.arrays_zip("grp", "dq")).alias("size", "at"))
    tried: list[dict] = [{} for _ in sizes]
    for r in asked.groupBy("size", "dim", F.col("at.grp").alias("grp")).agg(F.max("at.dq").alias("radius"), F.count("*").alias("n")).collect():
        own = pivots.get(r.dim, np.zeros((1, r.dim)))
        a, radius = own[r.grp], r.radius
        sure, most = [], {}
        for cell in cells[r.dim].values():
            b = own[cell.cell]
            for d in cell.near:
                sure.append(a @ b - np.linalg.norm(a) * d - np.linalg.norm(b) * radius - radius * d)
            most[cell.cell] = a @ b + np.linalg.norm(a) * cell.radius + np.linalg.norm(b) * radius + radius * cell.radius
        # one of the k + 1 best may be the query itself
        least = sorted(sure, reverse=True)[k] if len(sure) > k else -np.inf
        least = least - slack(least) if np.isfinite(least) else least
        tried[r["size"]][r.dim, r.grp] = (a, radius, least, {c for c, x in most.items() if x + slack(x) >= least}, -(-r.n // QUERY_BLOCK), r.n)
    # vectors sent, and products to form
    cost = [sum((g[4] + g[5] / SENT_PRODUCTS) * sum(cells[dim][c].n for c in g[3]) for (dim, _), g in groups.items()) for groups in tried]
    best = min(range(len(sizes)), key=lambda i: (cost[i], i))
    return best, tried[best]


def sent(rows: DataFrame, groups: dict, blocks: int) -> DataFrame:
    """Each vector, once for every block of queries that it can matter to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            block = (mix(batch.column("row").to_numpy().view("u8"), 13) % np.uint64(blocks)).astype("i4")
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = matrix(batch.column("v").take(pa.array(at)), dim).astype("f8")
                norm = np.sqrt((x * x).sum(1))
                for (d, g), (a, radius, least, near, parts, _) in groups.items():
                    if d != dim:
                        continue
                    most = x @ a + radius * norm
                    take = at[(most + slack(most) >= least) & np.isin(cells[at], list(near))]
                    if not len(take):
                        continue
                    part = batch.take(pa.array(take))
                    for q in range(parts):
                        yield pa.RecordBatch.from_arrays([part.column("row"), part.column("vec_id"), part.column("dim"), part.column("v"), pa.array(np.full(len(take), g, "i4")), pa.array(block[take]), pa.array(np.full(len(take), q, "i4"))], ["row", "vec_id", "dim", "v", "grp", "block", "part"])

    return rows.select("row", "vec_id", "dim", "v", "cell").mapInArrow(run, f"{HEAD}, grp int, block int, part int")


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond what a double holds, by Python's integers, cut to 64 bits."""
    top = lambda m: int(np.abs(m.astype("f8")).max(initial=0))
    if top(q) * top(x) * max(1, q.shape[1]) < 1 << 53:
        return (q.astype("f8") @ x.T.astype("f8")).astype("i8")
    return np.clip(q.astype(object) @ x.T.astype(object), -(1 << 63), (1 << 63) - 1).astype("i8")


def solve(key, queries: pa.Table, data: pa.Table, k: int) -> pa.Table:
    dim, best = key[0].as_py(), []
    if len(queries) and len(data):
        own, xrow, xid = queries.column("row").to_numpy(), data.column("row").to_numpy(), data.column("vec_id").to_numpy()
        x = matrix(data.column("v"), dim)
        by_id = np.argsort(xid, kind="stable")
        xrow, xid, x = xrow[by_id], xid[by_id], x[by_id]
        q = matrix(queries.column("v"), dim)
        for a in range(0, len(q), 256):
            scores = products(q[a : a + 256], x)
            for i, row in enumerate(scores, a):
                other = xrow != own[i]
                row, ids = (row, xid) if other.all() else (row[other], xid[other])
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -(1 << 63)
                at = np.flatnonzero(row >= least)
                for j in at[np.argsort(np.invert(row[at]), kind="stable")][:k]:
                    best.append((i, ids[j], row[j]))
    head = queries.select(["row", "vec_id"]).take(pa.array([b[0] for b in best], pa.int64()))
    return pa.Table.from_arrays([head.column("row"), head.column("vec_id"), pa.array([b[1] for b in best], pa.int64()), pa.array([b[2] for b in best], pa.int64())], ["row", "query_id", "vec_id", "score"])


def top_k(table: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score."""
    base = materialize(vectors(table), "vectors")
    total, n_asked = base.agg(F.count("*"), F.count_if(F.col("vec_id") % EVERY == 0)).first()
    n_pivots = min(MOST_PIVOTS, max(PIVOTS, isqrt(total) // 4))
    seen: dict[int, list] = {}
    for r in base.orderBy(F.xxhash64("vec_id", "q"), "row").limit(n_pivots).collect():
        seen.setdefault(r.dim, []).append(r.q)
    pivots = {dim: np.array(rows, "f8").reshape(len(rows), dim) for dim, rows in seen.items()}
    few = min(n_pivots, max(1, -(-n_asked // GROUP_QUERIES)))
    sizes = sorted({few, min(n_pivots, max(few, 8)), n_pivots})
    rows = materialize(dealt(base, pivots, sizes), "cells")
    drop_path(table.sparkSession, base.scratch_path)
    blocks = max(1, -(-total // BLOCK))
    size, groups = plan(rows, pivots, sizes, k)
    data = sent(rows, groups, blocks)
    parts = F.create_map(*(F.lit(x) for (d, g), v in groups.items() for x in (d * MOST_PIVOTS + g, v[4]))) if groups else F.lit(None).cast("map<int,int>")
    asked = rows.where("grp is not null").withColumn("grp", F.get("grp", F.lit(size)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("row"), parts[F.col("dim") * MOST_PIVOTS + F.col("grp")]).cast("int"))
    queries = asked.select("row", "vec_id", "dim", "v", "grp", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ["dim", "grp", "block", "part"]
    best = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(lambda key, q, x: solve(key, q, x, k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


#: The same by SQL: every query against every vector.
ORACLE = f"""
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as q
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.row as row, a.vec_id as query_id, b.vec_id as vec_id,
         cast(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) as bigint) as score
  from v a join v b on a.vec_id % {EVERY} = 0 and a.row <> b.row and len(a.q) = len(b.q)
), r as (
  select query_id, cast(row_number() over (partition by row order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= {K}
"""

"""Exact top-k by inner product with a vector-approximation file (operator 10).

A vector becomes the integers ``floor(64 x)``.

1. *Approximation file.* Vectors are dealt to blocks by a hash. A block lays its own grid over every dimension, 2**``bits`` cells of
   equal width between the block's least and greatest integer, and is written as one row: the cell numbers, one byte a dimension, the
   grid and the row numbers. A stray value widens the cells of its own block only. Exact vectors stay in a table of their own.
2. *Scan.* Query blocks meet approximation blocks. The cells alone give a lower and an upper bound of every score. A candidate leaves
   the scan unless k others of its block are certain to come before it.
3. *Reads.* Over all blocks the kth highest lower bound closes out most of what is left. The exact vectors of the rest are then fetched
   in the order of their bounds, k for each query first, ever more in later rounds, until no bound that is left reaches the query's kth
   exact score: then the k results are certain.

Equal vectors: only the k + 1 smallest vec_ids of a vector can be among the k best of any query, so no more of them are candidates.
Bounds are exact integers while sums of products stay below 2**53, and widened by the rounding error beyond; scores beyond a long
are set to its greatest or least value. At equal scores the smaller vec_id wins.

Vectors that are null or hold a null or non-finite component take no part, neither do rows with a null
vec_id. A shorter vector counts as padded with zeros. Repeated vec_ids are separate rows: each is a query of its
own and a candidate of the other. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from synframe.runtime import Written, lean, shuffle_partitions

SCALE = 64
#: Bytes of cells in one block, most queries of one block, and numbers in one matrix of bounds.
BLOCK_BYTES, QUERIES, BOUNDS = 1 << 21, 4096, 1 << 21
BLOCK = "b int, n int, rows binary, ids binary, low binary, width binary, cells binary"
QUERY = "c int, q_n int, q_rows binary, q_ids binary, q binary"
BOUND = "q_row long, query_id long, row long, vec_id long, lower double, upper double"
MOST = (1 << 63) - 1


def integer_vectors(emb: DataFrame) -> DataFrame:
    """``(vec_id, v)``: v = floor(64 x) of every usable vector."""
    x = F.transform(F.col("embedding"), lambda a: a.cast("double"))
    bad = F.exists(F.col("embedding"), lambda a: a.isNull() | F.isnan(a.cast("double")) | (F.abs(a.cast("double")) == float("inf")))
    ok = emb.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).filter(~bad)
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda a: F.floor(a * SCALE)).alias("v"))


def _matrix(col: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(size), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = col.flatten().to_numpy()
    return out


def quantise(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the vectors and their grid: a component is in ``low + width * cell + [0, width - 1]``."""
    low = v.min(0)
    width = np.array([-(-(int(h) - int(l) + 1) // (1 << bits)) for l, h in zip(low, v.max(0), strict=True)], np.uint64)
    return ((v.view(np.uint64) - low.view(np.uint64)) // width).astype(np.uint8), low, width.view(np.int64)


def block_bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores at the cells' lower corners, and what a query's lower and upper bounds add to them."""
    w, f = width.astype(float), q.astype(float)
    corner = low + cells * w
    base = f @ corner.T
    down, up = (np.minimum(f, 0) * (w - 1)).sum(1), (np.maximum(f, 0) * (w - 1)).sum(1)
    size = np.abs(f) @ (np.maximum(np.abs(corner).max(0, initial=0), np.abs(corner + w).max(0, initial=0)))
    slack = np.where(size < 2.0**52, 0.0, size * (len(low) + 4) * 2.0**-51)
    return base, down - slack, up + slack


def scan(q_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, k: int):
    """``(query, candidate, lower, upper)`` arrays of what may be among a query's k best of the block."""
    order = np.argsort(rows)
    step = max(1, BOUNDS // max(1, len(q)))
    best = np.full((len(q), k), -np.inf)
    found: list[tuple[np.ndarray, ...]] = []
    for s in range(0, len(rows), step):
        base, down, up = block_bounds(q, cells[s : s + step], low, width)
        at = np.minimum(np.searchsorted(rows, q_rows, sorter=order), len(rows) - 1)
        own = np.flatnonzero((rows[order[at]] == q_rows) & (order[at] >= s) & (order[at] < s + step))
        base[own, order[at[own]] - s] = -np.inf
        lower = np.concatenate((best, base + down[:, None]), axis=1)
        best = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k :]
        bar = best.min(1)
        i, j = np.nonzero((base + up[:, None] >= bar[:, None]) & np.isfinite(base))
        found.append((i, j + s, base[i, j] + down[i], base[i, j] + up[i]))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
    i, j, lower, upper = map(np.concatenate, zip(*found, strict=True))
    bar = best.min(1)[i]
    ok = upper >= bar
    i, j, lower, upper, bar = (x[ok] for x in (i, j, lower, upper, bar))
    # of those that can only reach the bar, ids beyond the k smallest of the rows certain to reach it come too late
    sure = np.flatnonzero(lower >= bar)
    sure = sure[np.lexsort((ids[j[sure]], i[sure]))]
    start = np.searchsorted(i[sure], np.arange(len(q)))
    end = np.searchsorted(i[sure], np.arange(len(q)), "right")
    last = np.full(len(q), MOST)
    full = end - start >= k
    last[full] = ids[j[sure[start[full] + k - 1]]]
    ok = (upper > bar) | (ids[j] <= last[i])
    return i[ok], j[ok], lower[ok], upper[ok]


def _approximate(dims: int, bits: int):
    def run(t: pa.Table) -> pa.Table:
        v = _matrix(t["v"], dims)
        cells, low, width = quantise(v, bits)
        raw = lambda x: x.combine_chunks().to_numpy().astype("<i8").tobytes()
        values = (t["b"][0].as_py(), len(v), raw(t["row"]), raw(t["vec_id"]), low.astype("<i8").tobytes(), width.astype("<i8").tobytes(), cells.tobytes())
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
        return pa.table([pa.array([x], y) for x, y in zip(values, kinds, strict=True)], names=["b", "n", "rows", "ids", "low", "width", "cells"])

    return run


def _gather(dims: int):
    def run(t: pa.Table) -> pa.Table:
        raw = lambda x: x.combine_chunks().to_numpy().astype("<i8").tobytes()
        values = (t["c"][0].as_py(), t.num_rows, raw(t["row"]), raw(t["vec_id"]), _matrix(t["v"], dims).astype("<i8").tobytes())
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 3)
        return pa.table([pa.array([x], y) for x, y in zip(values, kinds, strict=True)], names=["c", "q_n", "q_rows", "q_ids", "q"])

    return run


def _scans(dims: int, k: int):
    def run(batches):
        ints = lambda x: np.frombuffer(x.as_py(), "<i8")
        for b in batches:
            for r in range(b.num_rows):
                n, rows, ids, low, width, cells, qn, q_rows, q_ids, q = (b.column(c)[r] for c in range(10))
                rows, ids, q_rows, q_ids = map(ints, (rows, ids, q_rows, q_ids))
                cells = np.frombuffer(cells.as_py(), np.uint8).reshape(n.as_py(), dims)
                i, j, lower, upper = scan(q_rows, ints(q).reshape(qn.as_py(), dims), rows, ids, cells, ints(low), ints(width), k)
                for s in range(0, len(i), 100_000):
                    x, y = i[s : s + 100_000], j[s : s + 100_000]
                    cols = (q_rows[x], q_ids[x], rows[y], ids[y], lower[s : s + 100_000], upper[s : s + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q_row", "query_id", "row", "vec_id", "lower", "upper"])

    return run


def inner_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row; in Python integers where a long might not hold the sum."""
    if not q.size:
        return np.zeros(len(q), np.int64)
    if (np.abs(q.astype(float)) * np.abs(v.astype(float))).sum(1).max() < 2.0**62:
        return np.einsum("ij,ij->i", q, v)
    sums = [sum(a * b for a, b in zip(x, y, strict=True)) for x, y in zip(q.tolist(), v.tolist(), strict=True)]
    return np.array([max(-MOST - 1, min(MOST, s)) for s in sums], np.int64)


def _score(dims: int):
    def run(batches):
        for b in batches:
            s = inner_products(_matrix(b.column(3), dims), _matrix(b.column(4), dims))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(s, pa.int64())], names=["q_row", "query_id", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, queries: str, k: int = 20, bits: int = 8, block: int | None = None, query_block: int = QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest integer inner products of every row of ``vectors`` for which the SQL condition
    ``queries`` holds, with all rows but itself."""
    spark = vectors.sparkSession
    kept, parts = Written(spark, "topk"), shuffle_partitions(spark)
    v = kept.cut(vectors.withColumn("row", F.monotonically_increasing_id()))  # written, so the numbers stay
    q = v.filter(queries)
    dims = v.agg(F.max(F.size("v"))).first()[0] or 0
    copies = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id", "row")
    able = v.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    able = kept.cut(able)
    nv, nq = able.count(), q.count()
    blocks = max(1, -(-nv // (block or max(1, BLOCK_BYTES // max(1, dims)))))
    qblocks = max(1, -(-nq // query_block), min(nq, -(-parts // blocks)))
    file = able.withColumn("b", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(blocks)).cast("int")).groupBy("b").applyInArrow(_approximate(dims, bits), BLOCK)
    file = kept.cut(file)
    asked = q.withColumn("c", F.pmod(F.xxhash64("row", F.lit(11)), F.lit(qblocks)).cast("int")).groupBy("c").applyInArrow(_gather(dims), QUERY)
    asked = kept.cut(asked)
    # every pair of a query block and an approximation block, dealt by the pair
    left = file.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1)))).repartition(parts, "b", "c")
    right = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(parts, "b", "c")
    both = left.hint("merge").join(right, ["b", "c"]).select("n", "rows", "ids", "low", "width", "cells", "q_n", "q_rows", "q_ids", "q")
    bound = both.mapInArrow(lean(_scans(dims, k)), BOUND)
    by = Window.partitionBy("q_row")
    bound = bound.withColumn("n", F.row_number().over(by.orderBy(F.col("lower").desc()))).withColumn("bar", F.max(F.when(F.col("n") == k, F.col("lower"))).over(by))
    bound = bound.filter(F.col("bar").isNull() | (F.col("upper") >= F.col("bar"))).drop("n", "bar", "lower")
    todo = kept.cut(bound.withColumn("at", F.row_number().over(by.orderBy(F.col("upper").desc(), "vec_id"))))

    best, size, done = None, k, 0
    w = by.orderBy(F.col("score").desc(), "vec_id")
    exact = v.select("row", "v")
    while True:
        pairs = todo.filter((F.col("at") > done) & (F.col("at") <= done + size))
        pairs = pairs.join(exact, "row").join(exact.select(F.col("row").alias("q_row"), F.col("v").alias("q")), "q_row").select("q_row", "query_id", "vec_id", "q", "v")
        got = pairs.mapInArrow(lean(_score(dims)), "q_row long, query_id long, vec_id long, score long")
        got = got if best is None else got.unionByName(best.drop("rank"))
        best = kept.cut(got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
        done, size = done + size, size * 4
        last = best.filter(F.col("rank") == k).select("q_row", F.col("score").alias("s"), F.col("vec_id").alias("i"))
        left = todo.filter(F.col("at") > done).join(last, "q_row", "left")
        left = left.filter(F.col("s").isNull() | (F.col("upper") > F.col("s")) | (F.col("upper") == F.col("s")) & (F.col("vec_id") < F.col("i"))).drop("s", "i")
        todo = kept.cut(left)
        if todo.isEmpty():
            return best.select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: k = 20, cells of a byte; queries are the rows whose vec_id is divisible by 20, candidates all rows."""
    v = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return exact_topk(v, "vec_id % 20 = 0")


ORACLE_SQL = """
with v as (select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
           where vec_id is not null and embedding is not null and not coalesce(list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x))), false)),
     s as (select q.n, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from v q join v c on q.vec_id % 20 = 0 and q.n <> c.n)
select query_id, cast(row_number() over o as int) as rank, vec_id, score from s window o as (partition by n order by score desc, vec_id) qualify row_number() over o <= 20
"""

"""Connected components by alternating star contraction (Kiveris et al., 2014), all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synframe.runtime import Written, lean


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is re-attached to the smallest node of u's neighbourhood."""
    sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return sym.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are attached to the smallest of them."""
    d = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = d.groupBy("u").agg(F.min("v").alias("m"))
    out = d.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(low.select("u", F.col("m").alias("v")))


#: Nodes that one task holds before it sends its forest on.
HELD = 1_000_000
#: Edges from which on rounds are needed; fewer fit into one task with room to spare and are finished there.
FEW = 400_000


def _forests(batches):
    """Edges of one task -> (node, smallest node of its tree): what is connected within a task needs no round."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x):
        while (p := parent[x]) != x:
            parent[x] = x = parent[p]
        return x

    def out():
        rows = [(x, find(x)) for x in parent]
        rows = [r for r in rows if r[0] != r[1]]
        for k in range(0, len(rows), 50_000):
            u, v = zip(*rows[k : k + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(_put(parent, u)), find(_put(parent, v))
            if a != c:
                parent[max(a, c)] = min(a, c)
        if len(parent) > HELD:
            yield from out()
            parent.clear()
    yield from out()


def _put(parent: dict[int, int], x: int) -> int:
    parent.setdefault(x, x)
    return x


def _mark(e: DataFrame):
    return e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60, contract: bool = True, few: int = FEW) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component = smallest node reachable.

    Nulls in an end drop the edge; self loops give single-node components; an empty table gives none.
    With ``contract`` each task first contracts its own edges (in Python). State is then at most one row per edge; each round is two
    aggregations and two equi-joins, and its result is written to the shared folder, so that lineage stays short and lost executors cost
    one round. As soon as no more than ``few`` edges are left (at once, for most inputs), a single task finishes them by union and find:
    the components are the same either way.
    """
    spark = edges.sparkSession
    kept = Written(spark, "cc")
    base = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u is not null and v is not null")
    base, base_path = kept.put(base.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = base.filter("u = v").select("u")
    cur, old = base.filter("u <> v"), None
    if contract and base.limit(few + 1).count() > few:
        cur, old = kept.put(cur.mapInArrow(lean(_forests), "u long, v long").distinct())
    seen = _mark(cur)
    for _ in range(max_rounds):
        if seen[0] <= min(few, HELD // 2):
            if seen[0]:
                cur, _ = kept.put(cur.repartition(1).mapInArrow(lean(_forests), "u long, v long"))
            break
        step = _small_star(_large_star(cur).filter("u <> v").distinct()).filter("u <> v").distinct()
        nxt, path = kept.put(step)
        kept.drop(old)
        cur, old = nxt, path
        mark = _mark(cur)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = out.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")))
    out = out.unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("component")))
    return out.groupBy("node").agg(F.min("component").alias("component"))

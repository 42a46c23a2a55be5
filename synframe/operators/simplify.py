"""Synteny-block simplification over several scales (survey J18, J19, J21, J22, F16, C4, B6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synframe.operators.filters import filter_by_size
from synframe.runtime import Written

SEQ = ("genome", "chr")
BLOCK = (*SEQ, "block_id", "sign", "bstart", "bend")


def _lined(blocks: DataFrame) -> DataFrame:
    """Blocks beside their neighbours in their sequence: block ends ``_u`` before and ``_v`` behind (null at a sequence's ends), gaps ``_g1`` and
    ``_g2`` to them. Blocks that have them are left as they are: written with them, a round's tables are put in order once, not by every step."""
    if "_u" in blocks.columns:
        return blocks
    w = Window.partitionBy(*SEQ).orderBy("bstart", "block_id")
    s = F.col("block_id") * F.col("sign")
    return blocks.withColumns({"_u": -F.lag(s).over(w), "_v": F.lead(s).over(w), "_g1": F.col("bstart") - F.lag("bend").over(w), "_g2": F.lead("bstart").over(w) - F.col("bend")})


def _neighbours(lined: DataFrame) -> DataFrame:
    """``(node, nbr, gap)``: what follows each block end, 0 at a sequence's end, and the clamped gap; two rows a block."""
    s = F.col("block_id") * F.col("sign")
    side = lambda node, nbr, gap: F.struct(node.alias("node"), F.coalesce(nbr, F.lit(0)).alias("nbr"), F.greatest(F.lit(0), gap).alias("gap"))
    return lined.select(F.inline(F.array(side(-s, F.col("_v"), F.col("_g2")), side(s, F.col("_u"), F.col("_g1")))))


def compressible_joins(blocks: DataFrame, max_gap: int) -> DataFrame:
    """Block ends (a, b) that are each other's only neighbour in every occurrence, with no sequence end between and gaps of at
    most ``max_gap``; a block is never joined to itself."""
    n = _neighbours(_lined(blocks)).groupBy("node").agg(F.min("nbr").alias("lo"), F.max("nbr").alias("hi"), F.max("gap").alias("gap"))
    one = n.filter((F.col("lo") == F.col("hi")) & (F.col("lo") != 0) & (F.col("gap") <= max_gap) & (F.abs("lo") != F.abs("node")))
    both = one.groupBy(F.least("node", "lo").alias("a"), F.greatest("node", "lo").alias("b")).agg(F.count("*").alias("n"))
    return both.filter("n = 2").select("a", "b")


def compress_paths(blocks: DataFrame, max_gap: int) -> DataFrame:
    """Runs of compressible joins become one block from their first start to their last end. The new block has the smallest id
    of the run and that block's sign."""
    blocks = _lined(blocks)
    j = compressible_joins(blocks, max_gap)
    w = Window.partitionBy(*SEQ).orderBy("bstart", "block_id")
    u, v = F.col("_u"), F.col("block_id") * F.col("sign")
    b = blocks.select(*BLOCK, F.least(u, v).alias("_a"), F.greatest(u, v).alias("_b"))
    b = b.join(j.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(1).alias("_j")), ["_a", "_b"], "left")
    b = b.withColumn("_i", F.sum(F.when(F.col("_j").isNull(), 1).otherwise(0)).over(w))
    out = b.groupBy(*SEQ, "_i").agg(F.min("block_id").alias("id"), F.min_by("sign", "block_id").alias("sign"), F.min("bstart").alias("bstart"), F.max("bend").alias("bend"))
    return out.select(*SEQ, F.col("id").alias("block_id"), "sign", "bstart", "bend")


def bulge_blocks(blocks: DataFrame, max_gap: int) -> DataFrame:
    """Blocks that are the variant of a bulge: all their occurrences lie between the same two block ends, which also follow each
    other directly, or hold another such variant, within ``max_gap``; the two flanks have no other neighbours."""
    lined = _lined(blocks)
    b = lined.select("block_id", (F.col("block_id") * F.col("sign")).alias("s"), F.col("_u").alias("u"), F.col("_v").alias("v"), F.col("_g1").alias("g1"), F.col("_g2").alias("g2"))
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    ends = b.groupBy("block_id").agg(F.min(lo).alias("a"), F.max(lo).alias("a2"), F.min(hi).alias("b"), F.max(hi).alias("b2"), F.max(F.greatest("g1", "g2")).alias("g"), F.max((F.col("u").isNull() | F.col("v").isNull()).cast("int")).alias("open"))
    var = ends.filter((F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")) & (F.col("open") == 0) & (F.col("g") <= max_gap) & (F.abs("a") != F.abs("b")) & (F.abs("a") != F.col("block_id")) & (F.abs("b") != F.col("block_id"))).select("block_id", "a", "b")
    direct = b.filter("v is not null").select(F.least(-F.col("s"), F.col("v")).alias("a"), F.greatest(-F.col("s"), F.col("v")).alias("b")).distinct()
    ways = var.groupBy("a", "b").agg(F.count("*").alias("k")).join(direct.withColumn("d", F.lit(1)), ["a", "b"], "left").withColumn("ways", F.col("k") + F.coalesce("d", F.lit(0)))
    # neighbours of a flank: the other flank directly, or the variants' own ends
    deg = _neighbours(lined).groupBy("node").agg(F.countDistinct("nbr").alias("deg"))
    ok = ways.filter("ways > 1").join(deg.select(F.col("node").alias("a"), F.col("deg").alias("da")), "a").join(deg.select(F.col("node").alias("b"), F.col("deg").alias("db")), "b").filter("da = ways and db = ways")
    return var.join(ok.select("a", "b"), ["a", "b"], "left_semi").select("block_id")


def remove_bulges(blocks: DataFrame, max_gap: int) -> DataFrame:
    gone = bulge_blocks(blocks, max_gap)
    return blocks.drop("_u", "_v", "_g1", "_g2").join(gone, "block_id", "left_anti")


def simplify(blocks: DataFrame, max_gap: int) -> DataFrame:
    """Compression and bulge removal in turn until nothing changes; ends at once if the first compression finds nothing."""
    kept = Written(blocks.sparkSession, "simplify")
    put = lambda df: kept.put(_lined(df.select(*BLOCK)))
    cur, old = put(blocks)
    n = cur.count()
    while True:  # every further round has fewer blocks
        step, path = put(compress_paths(cur, max_gap))
        m = step.count()
        kept.drop(old)
        if m == n:
            return step.select(*BLOCK)
        nxt, path2 = put(remove_bulges(step, max_gap))
        k = nxt.count()
        if k == m:  # no bulge: the blocks are those of the step
            kept.drop(path2)
            return kept.cut(compress_paths(step, max_gap))
        kept.drop(path)
        cur, old, n = nxt, path2, k


def multi_scale(blocks: DataFrame, passes: list[tuple[int, int]], sizes: list[int]) -> dict[int, DataFrame]:
    """Blocks of every wanted size: a size is taken before the first pass whose minimum block exceeds it."""
    cur = simplify(blocks, 0)
    out: dict[int, DataFrame] = {}
    left = sorted(sizes)
    for least, gap in passes:
        while left and left[0] < least:
            size = left.pop(0)
            out[size] = filter_by_size(cur, size)
        cur = simplify(filter_by_size(cur, least), gap)
    for s in left:
        out[s] = filter_by_size(cur, s)
    return out

"""Checks of scaffolds against known positions (survey F17, F18, D11, E15, I11, J29, J32)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synframe.runtime import Written


#: Places of a scaffold that one task folds, and maps that are composed at once.
SPAN = 1024


def _agrees(increasing: bool, a, b):
    """Two hits lie on one chromosome in that direction, or wrap round its ends."""
    low, high = 0.2 * a["chr_len"], 0.8 * a["chr_len"]
    ahead = a["position"] < b["position"] if increasing else a["position"] >= b["position"]
    wraps = (a["start"] > high) & (b["start"] < low) if increasing else (a["start"] < low) & (b["start"] > high)
    return (a["chr"] == b["chr"]) & (ahead | wraps)


def _composed(maps):
    """The maps of consecutive contigs as one: ``n`` where each of the three states leads, ``b`` and ``s`` what is counted on the way."""
    zero = F.struct(F.array(*[F.lit(i) for i in range(3)]).alias("n"), F.array(*[F.lit(0).cast("long")] * 3).alias("b"), F.array(*[F.lit(0).cast("long")] * 3).alias("s"))

    def step(acc, m):
        put = lambda c: F.array(*[acc[c][i] + F.get(m[c], acc["n"][i]) for i in range(3)])
        return F.struct(F.array(*[F.get(m["n"], acc["n"][i]) for i in range(3)]).alias("n"), put("b").alias("b"), put("s").alias("s"))

    return F.aggregate(F.transform(F.array_sort(maps), lambda x: x["m"]), zero, step)


def verify_order(order: DataFrame, hits: DataFrame) -> DataFrame:
    """``(scf, contigs, misordered, misstranded, gaps)`` per scaffold. ``order``: (scf, idx, contig, sign); ``hits``: (contig, chr,
    position, strand, start, chr_len).

    The scan knows no direction yet, a rising or a falling one. A contig with hits, together with the one before it, maps these three states to
    the next, and says what each would count. Such maps are composed within stretches of ``SPAN`` places, then the stretches' maps in turn, so no
    task folds a long scaffold; all of it stays in the JVM.
    """
    h = hits.groupBy("contig").agg(F.sort_array(F.collect_list(F.struct("position", "chr", "strand", "start", "chr_len"))).alias("hits"))
    rows = order.join(h, "contig").filter(F.size("hits") > 0).select("scf", "idx", F.floor(F.col("idx") / SPAN).alias("part"), "hits", F.transform("hits", lambda x: F.col("sign") * x["strand"]).alias("strands"))
    own = F.struct("hits", "strands")
    near = rows.withColumn("prev", F.lag(own).over(Window.partitionBy("scf", "part").orderBy("idx")))
    last = rows.groupBy("scf", "part").agg(F.max_by(own, "idx").alias("last"))
    last = last.select("scf", "part", F.lag("last").over(Window.partitionBy("scf").orderBy("part")).alias("before"))
    near = near.join(last, ["scf", "part"]).withColumn("prev", F.coalesce("prev", "before"))
    any_pair = lambda x, y, f: F.exists(x, lambda a: F.exists(y, lambda b: f(a, b)))
    was, strands = F.col("prev.hits"), F.col("prev.strands")
    apart = F.array_min(F.transform(was, lambda a: F.array_min(F.transform("hits", lambda b: F.abs(a["position"] - b["position"])))))
    near = near.select(
        "scf", "idx", "part", F.col("prev").isNull().alias("first"),
        any_pair(was, F.col("hits"), lambda a, b: _agrees(True, a, b)).alias("up"), any_pair(was, F.col("hits"), lambda a, b: _agrees(False, a, b)).alias("down"),
        any_pair(strands, F.col("strands"), lambda a, b: (a == 1) & (b == 1)).alias("plus"), any_pair(strands, F.col("strands"), lambda a, b: (a == -1) & (b == -1)).alias("minus"),
        F.when((F.size(was) == 1) & (F.size("hits") == 1), F.when(F.col("hits")[0]["position"] > was[0]["position"], 1).otherwise(2)).alias("learns"), F.coalesce(apart > 1, F.lit(False)).alias("gap"),
    )
    nxt, bad, wrong = [], [], []
    for state in range(3):  # none yet, rising, falling
        error = F.lit(False) if not state else ~F.col("up" if state == 1 else "down")
        then = F.coalesce("learns", F.lit(0)) if not state else F.lit(state)
        strand = ~error & ~F.when(then == 1, F.col("plus")).otherwise(F.col("minus"))
        first = F.col("first")
        nxt.append(F.when(first, state).when(error | strand, 0).otherwise(then))
        bad.append(F.when(first | ~error, 0).otherwise(1).cast("long"))
        wrong.append(F.when(first | ~strand, 0).otherwise(1).cast("long"))
    maps = near.select("scf", "part", F.col("idx").alias("at"), "gap", F.struct(F.array(*nxt).alias("n"), F.array(*bad).alias("b"), F.array(*wrong).alias("s")).alias("m"))
    maps = maps.groupBy("scf", "part").agg(F.collect_list(F.struct("at", "m")).alias("maps"), F.count("*").alias("contigs"), F.count_if("gap").alias("gaps"))
    maps = Written(order.sparkSession, "order").cut(maps.select("scf", F.col("part").alias("at"), _composed("maps").alias("m"), "contigs", "gaps"))
    most = (maps.agg(F.max("at")).first()[0] or 0) + 1
    while most > 1:
        maps = maps.withColumn("part", F.floor(F.col("at") / SPAN)).groupBy("scf", "part").agg(F.collect_list(F.struct("at", "m")).alias("maps"), F.sum("contigs").alias("contigs"), F.sum("gaps").alias("gaps"))
        maps = maps.select("scf", F.col("part").alias("at"), _composed("maps").alias("m"), "contigs", "gaps")
        most = -(-most // SPAN)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = order.select("scf").distinct().join(maps, "scf", "left")
    return out.select("scf", zero(F.col("contigs")).alias("contigs"), zero(F.col("m.b")[0]).alias("misordered"), zero(F.col("m.s")[0]).alias("misstranded"), zero(F.col("gaps")).alias("gaps"))


def report_totals(per_scaffold: DataFrame) -> DataFrame:
    """E15."""
    return per_scaffold.agg(F.sum("misordered").alias("misordered"), F.sum("misstranded").alias("misstranded"), F.sum("gaps").alias("gaps"), F.sum("contigs").alias("contigs"), F.count("*").alias("scaffolds"))


def true_adjacencies(hits: DataFrame, ends: DataFrame, circular: bool = False) -> DataFrame:
    """block adjacencies of aligned contigs along each reference, closing the circle; the closing one is an infinity edge
    unless the reference is circular. ``hits``: (chr, start, contig, strand); ``ends``: (contig, left_end, right_end)."""
    h = hits.join(ends, "contig").select("chr", "start", "contig", F.when(F.col("strand") > 0, F.col("left_end")).otherwise(F.col("right_end")).alias("l"), F.when(F.col("strand") > 0, F.col("right_end")).otherwise(F.col("left_end")).alias("r"))
    w = Window.partitionBy("chr").orderBy("start", "contig")
    nxt = F.lead("l").over(w)
    first = F.first("l").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return h.select("chr", F.col("r").alias("u"), F.coalesce(nxt, first).alias("v"), (nxt.isNull() & F.lit(not circular)).alias("infinity"))


def report_graph(base: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Edges (a, b) of three graphs with their kind."""
    tag = lambda d, k: d.select("a", "b", F.lit(k).alias("kind")).distinct()
    return tag(base, "base").unionByName(tag(predicted, "predicted")).unionByName(tag(truth, "true"))


def simulate_inversions(order: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """The signs of a random share of contigs turned; the draw depends on the contig's name alone."""
    u = F.conv(F.substring(F.md5(F.concat("contig", F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return order.withColumn("sign", F.when(u < share, -F.col("sign")).otherwise(F.col("sign")))

"""Signed adjacencies and the breakpoint graph (survey F1-F5, D2, E4, E5, E12, E13, C11, C12, J1, J2, J6, J20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synframe.operators.components import connected_components

SEQ = ("genome", "chr")
INFINITY = 0
ORDER = ("bstart", "block_id")


def signed(c: str = "block_id"):
    return F.col(c) * F.col("sign")


def adjacency_edges(blocks: DataFrame) -> DataFrame:
    """an edge from the tail of each block to the head of the next, with the gap's coordinates."""
    w = Window.partitionBy(*SEQ).orderBy(*ORDER)
    nxt = F.lead(F.struct(signed().alias("s"), F.col("bstart").alias("b"))).over(w)
    e = blocks.withColumn("_n", nxt).filter(F.col("_n").isNotNull())
    return e.select("genome", "chr", (-signed()).alias("u"), F.col("_n.s").alias("v"), F.col("bend").alias("gap_start"), F.col("_n.b").alias("gap_end"), F.lit(False).alias("infinity"))


def _ends(blocks: DataFrame) -> DataFrame:
    order = F.struct(*ORDER)
    return blocks.groupBy(*SEQ).agg(F.min_by(signed(), order).alias("first"), F.max_by(signed(), order).alias("last"))


def infinity_edges(blocks: DataFrame, target: str, drafts: list[str]) -> DataFrame:
    """an edge joins the ends of every complete reference sequence."""
    e = _ends(blocks.filter((F.col("genome") != target) & ~F.col("genome").isin(*drafts)))
    return e.select("genome", "chr", (-F.col("last")).alias("u"), F.col("first").alias("v"), F.lit(None).cast("long").alias("gap_start"), F.lit(None).cast("long").alias("gap_end"), F.lit(True).alias("infinity"))


def contig_ends(blocks: DataFrame, target: str) -> DataFrame:
    """(left, right) end nodes of every target contig."""
    return _ends(blocks.filter(F.col("genome") == target)).select("chr", F.col("first").alias("left_end"), (-F.col("last")).alias("right_end"))


def clamped_edges(blocks: DataFrame) -> DataFrame:
    """adjacencies with sentinels (node 0) before the first and after the last block; overlaps are clamped to no gap."""
    w = Window.partitionBy(*SEQ).orderBy(*ORDER)
    b = blocks.select(*SEQ, signed().alias("s"), "bstart", "bend", F.lead(F.struct(signed().alias("s"), F.col("bstart").alias("b"))).over(w).alias("n"), F.row_number().over(w).alias("ord"))
    inner = b.select(*SEQ, "ord", (-F.col("s")).alias("u"), F.coalesce("n.s", F.lit(INFINITY)).alias("v"), F.least(F.col("bend"), F.coalesce("n.b", "bend")).alias("left_pos"), F.coalesce("n.b", "bend").alias("right_pos"))
    head = b.filter("ord = 1").select(*SEQ, F.lit(0).alias("ord"), F.lit(INFINITY).cast("long").alias("u"), F.col("s").alias("v"), F.col("bstart").alias("left_pos"), F.col("bstart").alias("right_pos"))
    return inner.unionByName(head)


def breakpoint_graph(blocks: DataFrame, target: str, drafts: list[str]) -> DataFrame:
    """Coloured multigraph; every edge is stored once with u < v as (a, b)."""
    e = adjacency_edges(blocks).unionByName(infinity_edges(blocks, target, drafts))
    return e.withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v"))


def edge_support(graph: DataFrame) -> DataFrame:
    """Genomes that have each edge, and whether it is an infinity edge anywhere."""
    s = graph.groupBy("a", "b").agg(F.array_sort(F.collect_set("genome")).alias("genomes"), F.max(F.col("infinity").cast("int")).alias("infinity"))
    return s.select("a", "b", "genomes", (F.col("infinity") == 1).alias("infinity"))


def suspicious_edges(graph: DataFrame, target: str) -> DataFrame:
    """C11: target edges that no reference shares or that coincide with an infinity edge."""
    g = graph.groupBy("a", "b").agg(
        F.max((F.col("genome") == target).cast("int")).alias("t"),
        F.max((F.col("genome") != target).cast("int")).alias("r"),
        F.max(F.col("infinity").cast("int")).alias("i"),
    )
    return g.filter("t = 1 and (r = 0 or i = 1)").select("a", "b", (F.col("i") == 1).alias("infinity"))


def common_genomes(graph: DataFrame) -> DataFrame:
    """Genomes shared by all edges of a node."""
    both = graph.select(F.col("a").alias("node"), F.col("b").alias("nbr"), "genome").unionByName(graph.select(F.col("b").alias("node"), F.col("a").alias("nbr"), "genome"))
    per = both.distinct().groupBy("node", "genome").agg(F.countDistinct("nbr").alias("k"))
    deg = both.groupBy("node").agg(F.countDistinct("nbr").alias("degree"))
    shared = per.join(deg, "node").filter("k = degree").groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("genome")), ",").alias("genomes"))
    return deg.join(shared, "node", "left").select("node", "degree", F.coalesce("genomes", F.lit("")).alias("genomes"))


def genome_distance(blocks: DataFrame) -> DataFrame:
    """Breakpoint distance of every genome pair: min(#A, #B) - #(A and B) over canonical adjacencies."""
    e = adjacency_edges(blocks).select("genome", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    size = e.groupBy("genome").agg(F.count("*").alias("n"))
    # genomes of an edge are few, whatever the input: pairs are made inside the edge's array
    per = e.groupBy("a", "b").agg(F.array_sort(F.collect_list("genome")).alias("gs"))
    pair = per.select(F.explode("gs").alias("g1"), "gs").select("g1", F.explode("gs").alias("g2")).filter("g1 < g2")
    both = pair.groupBy("g1", "g2").agg(F.count("*").alias("shared"))
    x = size.select(F.col("genome").alias("g1"), F.col("n").alias("n1")).join(size.select(F.col("genome").alias("g2"), F.col("n").alias("n2")), F.col("g1") < F.col("g2"))
    return x.join(both, ["g1", "g2"], "left").select("g1", "g2", (F.least("n1", "n2") - F.coalesce("shared", F.lit(0))).alias("distance"))


def discordant_nodes(graph: DataFrame, one: str, two: str) -> DataFrame:
    """Nodes with more than one neighbour in the graph of two genomes."""
    g = graph.filter(F.col("genome").isin(one, two) & ~F.col("infinity"))
    both = g.select(F.col("a").alias("node"), F.col("b").alias("nbr")).unionByName(g.select(F.col("b").alias("node"), F.col("a").alias("nbr")))
    return both.groupBy("node").agg(F.countDistinct("nbr").alias("neighbours")).filter("neighbours > 1")


def bifurcations(graph: DataFrame) -> DataFrame:
    """Nodes where a non-branching path ends: more than one coloured neighbour besides the block edge, or a
    coloured edge parallel to the node's block edge."""
    both = graph.select(F.col("a").alias("node"), F.col("b").alias("nbr")).unionByName(graph.select(F.col("b").alias("node"), F.col("a").alias("nbr")))
    return both.groupBy("node").agg(F.countDistinct("nbr").alias("coloured"), F.max((F.col("nbr") == -F.col("node")).cast("int")).alias("parallel")).select("node", "coloured", ((F.col("coloured") > 1) | (F.col("parallel") == 1)).alias("bifurcation"))


def trimmed_graph(graph: DataFrame, target: str) -> DataFrame:
    """Distinct edges left after both ends of every target edge are removed."""
    t = graph.filter(F.col("genome") == target)
    gone = t.select(F.col("a").alias("n")).unionByName(t.select(F.col("b").alias("n"))).distinct()
    e = graph.filter(F.col("genome") != target).select("a", "b").distinct()
    return e.join(gone, e["a"] == gone["n"], "left_anti").join(gone, F.col("b") == gone["n"], "left_anti")


def graph_components(edges: DataFrame) -> DataFrame:
    """(node, component); component = smallest node."""
    return connected_components(edges, "a", "b")


def pair_adjacencies(edges: DataFrame) -> DataFrame:
    """J4, two-node part: components of the trimmed graph that are one edge are taken as they are."""
    comp = graph_components(edges)
    two = comp.groupBy("component").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).filter("n = 2")
    return two.select("a", "b")


def edge_distances(graph: DataFrame, rank: DataFrame) -> DataFrame:
    """Gap of every edge in the genome nearest to the target that has it. ``rank``: (genome, rank), a row per genome."""
    g = graph.filter(~F.col("infinity")).join(F.broadcast(rank), "genome")
    first = F.struct("rank", "chr", "gap_start", "gap_end")
    return g.groupBy("a", "b").agg(F.min(first).alias("m")).select("a", "b", (F.col("m.gap_end") - F.col("m.gap_start")).alias("distance"))


def repeat_contexts(blocks: DataFrame, repeats: DataFrame, reach: int = 5) -> DataFrame:
    """up to five signed neighbours on each side of every repeat instance, seen along its own strand; ``pos`` is its place on the
    sequence, from 0."""
    w = Window.partitionBy(*SEQ).orderBy(*ORDER)
    left = F.collect_list(signed()).over(w.rowsBetween(-reach, -1))
    right = F.collect_list(signed()).over(w.rowsBetween(1, reach))
    pos = (F.row_number().over(w) - 1).cast("long")
    b = blocks.select(*SEQ, "block_id", "sign", "bstart", pos.alias("pos"), left.alias("l"), right.alias("r")).join(repeats, "block_id", "left_semi")
    flip = lambda c: F.reverse(F.transform(c, lambda x: -x))
    plus = F.col("sign") > 0
    return b.select("genome", "chr", "block_id", "bstart", "pos", "sign", F.when(plus, F.col("l")).otherwise(flip("r")).alias("left"), F.when(plus, F.col("r")).otherwise(flip("l")).alias("right"))


def unique_contexts(contexts: DataFrame) -> DataFrame:
    """Contexts without an identical twin among those of their block and genome."""
    w = Window.partitionBy("genome", "block_id", "left", "right")
    return contexts.withColumn("_n", F.count("*").over(w)).filter("_n = 1").drop("_n")


def scaffold_breakpoints(order: DataFrame, graph: DataFrame, target: str) -> DataFrame:
    """Target-only adjacencies among the joins (u, v) of ``order``."""
    s = suspicious_edges(graph, target).filter("not infinity")
    o = order.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return o.join(s, ["a", "b"], "left_semi").agg(F.count("*").alias("breakpoints"))

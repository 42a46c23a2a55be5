"""Scoring, matching and chimera detection on the breakpoint graph (survey J3-J8, D5)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synframe.operators.adjacency import graph_components, suspicious_edges, trimmed_graph
from synframe.operators.components import connected_components
from synframe.operators.matching import best_matching
from synframe.operators.phylogeny import parsimony_column, rate
from synframe.runtime import Written
from synframe.sources.recipe import Tree, parse_newick


def weighted_graph(graph: DataFrame, tree: Tree | str, target: str) -> DataFrame:
    """``(a, b, weight)``: for each node the parsimony cost of giving the target each candidate neighbour, as a share
    of the node's total, summed over both directions. A genome's state at a node is its neighbour there (the greatest, if there are several);
    a genome without one is VOID."""
    tree = parse_newick(tree) if isinstance(tree, str) else tree
    both = graph.select(F.col("a").alias("node"), F.col("b").alias("nbr"), "genome").unionByName(graph.select(F.col("b").alias("node"), F.col("a").alias("nbr"), "genome"))
    names = {g: f"_s{i}" for i, g in enumerate(tree.leaves()) if g != target}
    per = both.groupBy("node").agg(F.collect_set("nbr").alias("x"), *[F.max(F.when(F.col("genome") == g, F.col("nbr"))).alias(c) for g, c in names.items()])
    cost = parsimony_column(per.withColumn("x", F.explode("x")), tree, names | {target: "x"}, rate(tree), "cost")
    total = F.sum("cost").over(Window.partitionBy("node"))
    w = cost.select("node", "x", F.when(total > 0, F.col("cost") / total).otherwise(0.0).alias("w"))
    return w.groupBy(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).agg(F.round(F.sum("w"), 9).alias("weight"))


def min_weight_matching(graph: DataFrame, tree: Tree | str, target: str) -> DataFrame:
    """``(a, b)``: inside each component left after trimming, the maximum matching of smallest weight. Components of two
    nodes are taken as they are; only larger ones reach Python, one component at a time."""
    kept = Written(graph.sparkSession, "matching")
    graph = kept.cut(graph)
    t = kept.cut(trimmed_graph(graph, target))
    comp = kept.cut(graph_components(t))
    size = comp.groupBy("component").agg(F.count("*").alias("n"))
    e = t.join(comp, t["a"] == comp["node"]).select("a", "b", "component").join(size, "component")
    two = e.filter("n = 2").select("a", "b")
    many = e.filter("n > 2").join(weighted_graph(graph, tree, target), ["a", "b"])

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        m = best_matching({(int(a), int(b)): float(w) for a, b, w in zip(f["a"], f["b"], f["weight"], strict=True)})
        return pd.DataFrame(m, columns=["a", "b"])

    return two.unionByName(many.groupBy("component").applyInPandas(solve, "a long, b long"))


def infer_adjacencies(graph: DataFrame, matched: DataFrame, rank: DataFrame) -> DataFrame:
    """Matched and target edges in both directions: (node, block, distance, supporting, infinity)."""
    s = graph.join(F.broadcast(rank), "genome", "left").groupBy("a", "b").agg(
        F.array_sort(F.collect_set(F.struct("genome", "chr"))).alias("supporting"),
        F.max(F.col("infinity").cast("int")).alias("i"),
        F.min(F.when(~F.col("infinity"), F.struct("rank", "chr", "gap_start", "gap_end"))).alias("m"),
    )
    j = matched.join(s, ["a", "b"])
    inf = F.col("i") == 1
    empty = F.array().cast("array<struct<genome:string,chr:string>>")
    j = j.select("a", "b", F.when(inf, 0).otherwise(F.coalesce(F.col("m.gap_end") - F.col("m.gap_start"), F.lit(0))).alias("distance"), F.when(inf, empty).otherwise(F.col("supporting")).alias("supporting"), inf.alias("infinity"))
    one = j.select(F.col("a").alias("node"), F.col("b").alias("block"), "distance", "supporting", "infinity")
    return one.unionByName(j.select(F.col("b").alias("node"), F.col("a").alias("block"), "distance", "supporting", "infinity"))


def alternating_path(edges: dict[int, dict[int, set[str]]], u: int, v: int, target: str) -> int | None:
    """Half the nodes of a shortest alternating path u..v of more than two nodes: odd steps on edges of a reference, all of
    them of one genome; even steps on target-only edges. None if there is none. ``edges`` or an index of them."""
    index = edges if isinstance(edges, ColourIndex) else ColourIndex(edges, target)
    found = [n for g in index.genomes if (n := index.steps(g, u, v)) is not None]
    return min(found) if found else None


class ColourIndex:
    """Neighbours by genome and by target-only edges. Each genome is searched by itself, breadth first over (node, parity): every
    state is seen once, so a search is linear in the component however long the path."""

    def __init__(self, edges: dict[int, dict[int, set[str]]], target: str):
        self.by: dict[str, dict[int, list[int]]] = {}
        self.only: dict[int, list[int]] = {}
        for a, near in edges.items():
            for b, colours in sorted(near.items()):
                for g in colours - {target}:
                    self.by.setdefault(g, {}).setdefault(a, []).append(b)
                if colours == {target}:
                    self.only.setdefault(a, []).append(b)
        self.genomes = sorted(self.by)

    def steps(self, genome: str, u: int, v: int) -> int | None:
        level, seen, n = [u], {(u, 0), (u, 1)}, 1
        while level:
            odd, nxt = n % 2 == 1, []
            for x in level:
                for y in (self.by[genome] if odd else self.only).get(x, ()):
                    if odd and y == v and n > 1:
                        return (n + 1) // 2
                    if y != v and (y, n % 2) not in seen:
                        seen.add((y, n % 2))
                        nxt.append(y)
            level, n = nxt, n + 1
        return None


def chimeric_edges(graph: DataFrame, target: str) -> DataFrame:
    """Every suspicious target edge (a, b) with ``good`` = an alternating path explains it.

    Where every node has at most one edge of a genome and one target-only edge (always, for blocks that occur once in a genome), the edges of a genome
    and the target-only ones make paths and rings, and alternate by themselves. So a target-only edge has a path of that genome's if it lies
    on a ring, and any other edge if its ends are the two ends of one path: connected components answer all of them at once. Only edges
    whose components hold a node with more edges are searched one graph component at a time.
    """
    return _explained(Written(graph.sparkSession, "chimera").cut(graph), target)


def _explained(graph: DataFrame, target: str) -> DataFrame:
    """``chimeric_edges`` of a written graph."""
    kept = Written(graph.sparkSession, "chimera")
    per = graph.groupBy("a", "b").agg(F.min(F.col("genome") == target).alias("only"))
    asked = kept.cut(suspicious_edges(graph, target).select("a", "b").join(per, ["a", "b"]))
    genomes = [r[0] for r in graph.select("genome").filter(F.col("genome") != target).distinct().collect()]  # those of the recipe
    each = F.explode(F.array(*[F.lit(g) for g in genomes]).cast("array<string>")).alias("g")
    own = graph.filter(F.col("genome") != target).select(F.col("genome").alias("g"), "a", "b", F.lit(False).alias("only")).distinct()
    edges = kept.cut(own.unionByName(per.filter("only").select(each, "a", "b", "only")))
    ends = edges.select("g", F.explode(F.array("a", "b")).alias("node"), "only").groupBy("g", "node").agg((F.greatest(F.count_if("only"), F.count_if(~F.col("only"))) > 1).alias("odd"))
    ends = kept.cut(ends.withColumn("id", F.monotonically_increasing_id()))
    side = lambda c, i: ends.select("g", F.col("node").alias(c), F.col("id").alias(i))
    links = kept.cut(edges.join(side("a", "u"), ["g", "a"]).join(side("b", "v"), ["g", "b"]).select("u", "v"))
    comp = kept.cut(connected_components(links, "u", "v").select(F.col("node").alias("id"), "component"))
    n = comp.join(ends, "id").groupBy("component").agg(F.count("*").alias("nodes"), F.max("odd").alias("odd"))
    n = kept.cut(n.join(links.join(comp, F.col("u") == F.col("id")).groupBy("component").agg(F.count("*").alias("edges")), "component"))
    of = lambda c, i: ends.join(comp, "id").select("g", F.col("node").alias(c), F.col("component").alias(i))
    j = asked.select("a", "b", "only", each).join(of("a", "component"), ["g", "a"]).join(of("b", "other"), ["g", "b"]).filter("component = other").join(n, "component")
    good = ~F.col("odd") & (F.col("nodes") > 2) & (~F.col("only") | (F.col("edges") == F.col("nodes")))
    found = j.groupBy("a", "b").agg(F.max(good).alias("good"), F.max("odd").alias("odd"))
    out = kept.cut(asked.select("a", "b").join(found, ["a", "b"], "left").select("a", "b", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce(~F.col("good") & F.col("odd"), F.lit(False)).alias("open")))
    rest = out.filter("open").select("a", "b")
    if rest.isEmpty():
        return out.select("a", "b", "good")
    return out.filter("not open").select("a", "b", "good").unionByName(_searched_edges(graph, rest, target))


def _searched_edges(graph: DataFrame, asked: DataFrame, target: str) -> DataFrame:
    """``chimeric_edges`` by breadth-first search, for any number of edges at a node; one graph component at a time in Python."""
    comp = graph_components(graph.select("a", "b"))
    s = asked.select("a", "b", F.lit(True).alias("asked"))
    e = graph.groupBy("a", "b").agg(F.collect_set("genome").alias("genomes")).join(s, ["a", "b"], "left").join(comp, F.col("a") == comp["node"]).drop("node")
    todo = e.join(e.filter("asked").select("component").distinct(), "component", "left_semi")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, dict[int, set[str]]] = {}
        for a, b, g in zip(f["a"], f["b"], f["genomes"], strict=True):
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = set(g)
        ask = [(a, b) for a, b, q in zip(f["a"], f["b"], f["asked"], strict=True) if q is True or q == True and q is not None]  # noqa: E712
        index = ColourIndex(near, target)
        return pd.DataFrame([(a, b, alternating_path(index, a, b, target) is not None) for a, b in ask], columns=["a", "b", "good"])

    return todo.groupBy("component").applyInPandas(run, "a long, b long, good boolean")


def contig_breaks(graph: DataFrame, target: str) -> DataFrame:
    """(genome, chr, s, e, good): gaps of the suspicious edges on the target's sequences."""
    graph = Written(graph.sparkSession, "chimera").cut(graph)
    t = graph.filter((F.col("genome") == target) & ~F.col("infinity"))
    return t.join(_explained(graph, target), ["a", "b"]).select("genome", "chr", F.least("gap_start", "gap_end").alias("s"), F.greatest("gap_start", "gap_end").alias("e"), "good")


def hierarchical_breaks(stages: list[DataFrame]) -> DataFrame:
    """(stage, genome, chr, s, e): each bad break of a stage, narrowed stage by stage to its overlap with the first break
    there (good or bad) that overlaps it."""
    out = None
    for i, st in enumerate(stages):
        cur = st.filter("not good").select("genome", "chr", "s", "e").distinct()
        for later in stages[i + 1 :]:
            c = cur.select("genome", "chr", "s", "e", F.struct("s", "e").alias("k"))
            l = later.select("genome", "chr", F.col("s").alias("s2"), F.col("e").alias("e2"))
            hit = c.join(l, ["genome", "chr"]).filter("greatest(s, s2) <= least(e, e2)").groupBy("genome", "chr", "k").agg(F.min(F.struct("s2", "e2")).alias("h"))
            j = c.join(hit, ["genome", "chr", "k"], "left")
            cur = j.select("genome", "chr", F.coalesce(F.greatest("s", "h.s2"), "s").alias("s"), F.coalesce(F.least("e", "h.e2"), "e").alias("e")).distinct()
        cur = cur.withColumn("stage", F.lit(i))
        out = cur if out is None else out.unionByName(cur)
    return out


def break_cuts(breaks: DataFrame, fasta: DataFrame | None = None) -> DataFrame:
    """Cuts (stage, genome, chr, cut): the middle of the longest run of N in the interval if sequences (chr, seq) are given, else its start."""
    if fasta is None:
        return breaks.select("stage", "genome", "chr", F.col("s").alias("cut")).distinct()
    from synframe.functions.sequence import break_position

    j = breaks.join(fasta, "chr")
    return j.select("stage", "genome", "chr", break_position(F.col("seq"), F.col("s"), F.col("e")).alias("cut")).distinct()

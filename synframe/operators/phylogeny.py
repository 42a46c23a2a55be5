"""Trees and parsimony (survey J14-J17, E14, I8). A tree has one leaf per genome and lives on the driver."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from synframe.sources.recipe import Tree, parse_newick

VOID = "void"  # state of a genome without the feature; unlike any real state
MIN_BRANCH = 1e-7


def branches(tree: Tree) -> list[float]:
    return [x for c, d in tree.children for x in (d, *branches(c))]


def lower_median(values: list[float]) -> float:
    """E14."""
    return sorted(values)[(len(values) - 1) // 2]


def rate(tree: Tree) -> float:
    """1 / lower median of the branch lengths (1 if that is 0)."""
    m = lower_median(branches(tree))
    return 1 / m if m else 1.0


def parsimony(tree: Tree, states: dict[str, object], mu: float) -> float:
    """Smallest cost of an assignment of states to inner nodes. A change on a branch costs 1 + exp(-mu * length);
    a child that is VOID costs nothing. A leaf without a state is VOID."""
    values = list(dict.fromkeys([states.get(x, VOID) for x in tree.leaves()]))

    def costs(t: Tree) -> dict:
        if not t.children:
            own = states.get(t.name, VOID)
            return {v: 0.0 if v == own else math.inf for v in values}
        out = dict.fromkeys(values, 0.0)
        for child, length in t.children:
            below, change = costs(child), 1 + math.exp(-mu * max(length, MIN_BRANCH))
            for v in values:
                out[v] += min(c + (0.0 if w == v or w == VOID else change) for w, c in below.items())
        return out

    return min(costs(tree).values())


def parsimony_column(df: DataFrame, tree: Tree, states: dict[str, str], mu: float, out: str) -> DataFrame:
    """J14 as projections: ``df`` with the cost in ``out``. ``states`` names the column of each leaf's state (null: VOID; so are leaves
    without one). The tree is compiled to columns, one for each inner node and leaf: the cost below the node if it has that leaf's state. All work
    stays in the JVM; a row needs (inner nodes) * (leaves)^2 terms."""
    leaves = tree.leaves()
    none = F.lit(None).cast("long")
    value = [F.col(states[x]) if x in states else none for x in leaves]
    change = lambda child, own, length: F.when(child.isNull() | child.eqNullSafe(own), 0.0).otherwise(1 + math.exp(-mu * max(length, MIN_BRANCH)))
    made: list[str] = []

    def cost(t: Tree, length: float):
        """The cost of child ``t`` as a function of the parent's state."""
        if not t.children:
            own = value[leaves.index(t.name)]
            return lambda p: change(own, p, length)
        below = node(t)
        return lambda p: F.least(*[F.col(c) + change(v, p, length) for c, v in zip(below, value, strict=True)]) if len(below) > 1 else F.col(below[0])

    def node(t: Tree) -> list[str]:
        nonlocal df
        parts = [cost(c, length) for c, length in t.children]
        names = [f"_{out}{len(made) + i}" for i in range(len(leaves))]
        made.extend(names)
        df = df.withColumns({c: sum((f(p) for f in parts[1:]), parts[0](p)) for c, p in zip(names, value, strict=True)})
        return names

    root = [F.col(c) for c in node(tree)] if tree.children else [F.lit(0.0)]
    return df.withColumn(out, F.least(*root) if len(root) > 1 else root[0]).drop(*made)


def leaves_by_distance(tree: Tree, name: str) -> list[str]:
    """Other leaves by path length, ties by name."""
    near: dict[int, list[tuple[int, float]]] = defaultdict(list)
    names: dict[int, str] = {}

    def walk(t: Tree, me: int) -> int:
        last = me
        if not t.children:
            names[me] = t.name or ""
        for c, d in t.children:
            child = last + 1
            near[me].append((child, d))
            near[child].append((me, d))
            last = walk(c, child)
        return last

    walk(tree, 0)
    start = next(i for i, n in names.items() if n == name)
    best, heap = {}, [(0.0, start)]
    while heap:
        d, i = heapq.heappop(heap)
        if i not in best:
            best[i] = d
            for j, x in near[i]:
                heapq.heappush(heap, (d + x, j))
    return [n for _, n in sorted((round(best[i], 12), n) for i, n in names.items() if n != name)]


def leaves_depth_first(tree: Tree) -> list[str]:
    """Inner children before leaves, each kind by falling branch length."""
    if not tree.children:
        return [tree.name or ""]
    order = sorted(tree.children, key=lambda x: (not x[0].children, -x[1]))
    return [x for c, _ in order for x in leaves_depth_first(c)]


def neighbour_joining(names: list[str], distance: dict[tuple[str, str], float]) -> Tree:
    """Of the pairs with the lowest Q the first in name order is joined; branches are 1e-6 at least; the last two share their distance."""
    d = {}
    for (a, b), x in distance.items():
        d[a, b] = d[b, a] = float(x)
    nodes: dict[str, Tree] = {n: Tree(n) for n in names}
    if len(nodes) == 1:
        return nodes[names[0]]
    while len(nodes) > 2:
        ids = sorted(nodes, key=lambda k: nodes[k].newick())
        n = len(ids)
        total = {i: sum(d[i, j] for j in ids if j != i) for i in ids}
        best = None
        for x, i in enumerate(ids):
            for j in ids[x + 1 :]:
                q = (n - 2) * d[i, j] - total[i] - total[j]
                if best is None or q < best[0] - 1e-12:
                    best = (q, i, j)
        _, i, j = best
        half = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        new = f"({i},{j})"
        for k in ids:
            if k not in (i, j):
                d[new, k] = d[k, new] = (d[i, k] + d[j, k] - d[i, j]) / 2
        nodes[new] = Tree(None, [(nodes.pop(i), max(1e-6, half)), (nodes.pop(j), max(1e-6, d[i, j] - half))])
    a, b = sorted(nodes, key=lambda k: nodes[k].newick())
    x = max(1e-6, d[a, b] / 2)
    return Tree(None, [(nodes[a], x), (nodes[b], x)])


def infer_tree(distances: DataFrame, names: list[str]) -> Tree:
    """J17 over E5: one row per genome pair reaches the driver."""
    return neighbour_joining(names, {(r["g1"], r["g2"]): r["distance"] for r in distances.collect()})


def rank_table(spark: SparkSession, tree: Tree | str, target: str) -> DataFrame:
    """(genome, rank): the target first, others by distance."""
    tree = parse_newick(tree) if isinstance(tree, str) else tree
    return spark.createDataFrame([(n, i) for i, n in enumerate([target, *leaves_by_distance(tree, target)])], "genome string, rank int")


def newick_nodes(trees: DataFrame) -> DataFrame:
    """A5 over a table of trees (tree, text): ``(tree, node, parent, name, length, depth, leaf)`` of all nodes but the roots. ``node`` is a token's
    place in the text (an inner node's closing bracket), ``parent`` the place of its parent's; a missing length is 1. Tokens of a tree are
    numbered in windows over it; a node's parent is the next bracket that closes its depth. Nulls and empty texts give no rows."""
    names = r"""'(?:[^']|'')*'|"[^"]*"|[(),:;]|[^(),:;\s'"]+"""
    plain = F.regexp_replace("text", r"\[[^\]]*\]", "")
    t = trees.select("tree", F.posexplode(F.regexp_extract_all(plain, F.lit(f"({names})"), F.lit(1))).alias("at", "t"))
    row = Window.partitionBy("tree").orderBy("at")
    mark = ["(", ")", ",", ":", ";"]
    t = t.withColumns({"depth": F.sum(F.when(F.col("t") == "(", 1).when(F.col("t") == ")", -1).otherwise(0)).over(row), "last": F.lag("t").over(row), **{f"n{i}": F.lead("t", i).over(row) for i in (1, 2, 3)}})
    close = F.col("t") == ")"
    leaf = ~F.col("t").isin(*mark) & F.coalesce(F.col("last").isin("(", ","), F.lit(True))
    own = close & F.coalesce(~F.col("n1").isin(*mark), F.lit(False))  # an inner name or bootstrap value stands before the length
    length = F.when(own, F.when(F.col("n2") == ":", F.col("n3"))).otherwise(F.when(F.col("n1") == ":", F.col("n2")))
    quote = F.col("t").rlike("^'")
    name = F.when(leaf, F.when(quote, F.replace(F.expr("substring(t, 2, length(t) - 2)"), F.lit("''"), F.lit("'"))).when(F.col("t").rlike('^"'), F.expr("substring(t, 2, length(t) - 2)")).otherwise(F.col("t")))
    n = t.filter(close | leaf).select("tree", F.col("at").alias("node"), name.alias("name"), F.coalesce(length.cast("double"), F.lit(1.0)).alias("length"), F.col("depth").cast("int").alias("depth"), leaf.alias("leaf"))
    # each bracket is a node of its depth, and closes the depth above
    level = n.select("*", F.lit(False).alias("closing")).unionByName(n.filter("not leaf").withColumn("depth", F.col("depth") + 1).withColumn("closing", F.lit(True)))
    behind = Window.partitionBy("tree", "depth").orderBy("node").rowsBetween(1, Window.unboundedFollowing)
    level = level.withColumn("parent", F.min(F.when(F.col("closing"), F.col("node"))).over(behind))
    return level.filter("not closing and depth > 0").select("tree", "node", "parent", "name", "length", "depth", "leaf")

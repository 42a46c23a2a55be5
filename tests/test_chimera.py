"""Alternating paths of all suspicious edges at once, against a search for each."""

import random

import pytest
from synframe.operators import inference as inf

GRAPH = "genome string, chr string, a long, b long, u long, v long, gap_start long, gap_end long, infinity boolean"


def matching(nodes, rnd, share):
    free = [n for n in nodes if rnd.random() < share]
    rnd.shuffle(free)
    return list(zip(free[::2], free[1::2], strict=False))


@pytest.mark.parametrize("seed", range(6))
def test_components_against_searches(spark, seed):
    rnd = random.Random(seed)
    nodes = list(range(1, 61))
    rows, colours = [], {}
    target = matching(nodes, rnd, 0.95)

    def rearranged(edges, times):
        edges = list(edges)
        for _ in range(times):
            i, j = rnd.sample(range(len(edges)), 2)
            (a, b), (c, d) = edges[i], edges[j]
            edges[i], edges[j] = rnd.choice([((a, c), (b, d)), ((a, d), (b, c))])
        return edges

    base = rearranged(target, 6)
    for g in ("t", "r1", "r2", "r3"):
        edges = target if g == "t" else [e for e in rearranged(base, 2) if rnd.random() < 0.85]
        if g == "r3" and seed >= 3:
            edges += [tuple(rnd.sample(nodes, 2)) for _ in range(4)]  # nodes with several edges
        for a, b in edges:
            a, b = min(a, b), max(a, b)
            rows.append((g, "c", a, b, a, b, 0, 1, g != "t" and rnd.random() < 0.15))
            colours.setdefault((a, b), set()).add(g)
    near = {}
    for (a, b), g in colours.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = g
    closed = {(r[2], r[3]) for r in rows if r[-1]}
    want = {(a, b, inf.alternating_path(near, a, b, "t") is not None) for (a, b), g in colours.items() if "t" in g and (g == {"t"} or (a, b) in closed)}
    got = {tuple(r) for r in inf.chimeric_edges(spark.createDataFrame(rows, GRAPH), "t").collect()}
    assert got == want and len({x[2] for x in want}) == 2


def test_no_references_and_no_edges(spark):
    one = spark.createDataFrame([("t", "c", 1, 2, 1, 2, 0, 1, False)], GRAPH)
    assert [tuple(r) for r in inf.chimeric_edges(one, "t").collect()] == [(1, 2, False)]
    assert inf.chimeric_edges(one.limit(0), "t").count() == 0


def test_breaks_derive_their_graph_once(spark):
    """The breaks' plan reads the written graph, not the blocks that it is derived from a second time."""
    from synframe.plans import registry

    breaks = inf.contig_breaks(registry.graph(spark, "/root/testdata/sf0.001"), "g0")
    assert "lineitem" not in breaks._jdf.queryExecution().optimizedPlan().toString() and not any("lineitem" in f for f in breaks.inputFiles())

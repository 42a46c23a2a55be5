import random

from synframe.operators.components import connected_components


def test_rounds_and_one_task_agree(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (2000, 2000), (-3, 2)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    want = {}
    for a, b in edges:
        want.setdefault(a, {a}), want.setdefault(b, {b})
        if want[a] is not want[b]:
            want[a] |= want[b]
            for x in want[b] - {b}:
                want[x] = want[a]
            want[b] = want[a]
    plain = {x: min(c) for x, c in want.items()}
    for few in (0, 40, 400_000):
        for contract in (True, False):
            got = connected_components(df, contract=contract, few=few).collect()
            assert {r.node: r.component for r in got} == plain and len(got) == len(plain)

"""Hand-checked results of operators and readers on tiny inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from synframe.functions import sequence as sq
from synframe.operators import adjacency as ad
from synframe.operators import filters as fl
from synframe.operators import inference as inf
from synframe.operators import intervals as iv
from synframe.operators import overlap as ov
from synframe.operators import phylogeny as ph
from synframe.operators import repeats as rp
from synframe.operators import scaffold as sc
from synframe.operators import simplify as si
from synframe.operators import verify as ve
from synframe.operators.components import connected_components
from synframe.operators.matching import best_matching
from synframe.operators.phylogeny import VOID, leaves_by_distance, neighbour_joining, parsimony, rate
from synframe.plans.scaffolding import run_scaffolding, write_outputs
from synframe.sinks import reports
from synframe.sources import recipe as rc
from synframe.sources import text_formats as tf

BLOCKS = "genome string, chr string, block_id long, sign int, bstart long, bend long"
CONTIGS = "scf string, idx long, chr string, s long, e long, sign int, gap long"


def one(spark, expr, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols.values())], names).select(expr).first()[0]


def test_sequence_functions(spark):
    assert one(spark, sq.reverse_complement(F.col("s")), s="AACGTN") == "NACGTT"
    assert one(spark, sq.wrap(F.col("s"), 3), s="ABCDEFG") == "ABC\nDEF\nG" and one(spark, sq.wrap(F.col("s"), 3), s="ABCDEF") == "ABC\nDEF"
    for a, want in ((0, "c"), (10, "c[10:100]")):
        assert one(spark, sq.fragment_name(F.lit("c"), F.col("a"), F.lit(100), F.lit(100)), a=a) == want
    assert one(spark, sq.break_position(F.col("s"), F.lit(4), F.lit(12)), s="ACGTANNNNACG") == 7
    assert one(spark, sq.break_position(F.col("s"), F.lit(4), F.lit(12)), s="ACGTACGTACGT") == 4


def test_trees_of_a_table(spark):
    texts = ["((a:1,'b c':2)0.9:3,(d,5:0.5):1e-1)[note];", "(x,(y:2,(z,w):4)inner,v:7);", "a;", "", None, "('it''s':1,\"q\":2);"]
    got = ph.newick_nodes(spark.createDataFrame(list(enumerate(texts)), "tree long, text string")).collect()
    for k, text in enumerate(texts):
        rows = {r.node: r for r in got if r.tree == k}

        def walk(t):
            return [(c.name, d, sorted(walk(c), key=str)) for c, d in t.children]

        def below(parent):
            own = [r for r in rows.values() if r.parent == parent]
            return [(r["name"], r.length, sorted(below(r.node), key=str)) for r in own]

        roots = {r.parent for r in rows.values()} - rows.keys()
        want = walk(rc.parse_newick(text)) if text else []
        assert len(roots) == bool(want) and sorted(below(roots.pop()) if roots else [], key=str) == sorted(want, key=str)


@pytest.mark.parametrize("lengths, want", [((100, 80, 60, 40, 20), 80), ((50, 50), 50)])
def test_n50(spark, lengths, want):
    assert iv.n50(spark.createDataFrame([(x,) for x in lengths], "size long")).first()["n50"] == want


def test_adjacency_and_ends(spark):
    b = spark.createDataFrame([("r", "x", 1, 1, 0, 10), ("r", "x", 2, -1, 20, 30), ("r", "x", 3, 1, 40, 50), ("t", "c", 5, 1, 0, 10), ("t", "c", 7, -1, 20, 30)], BLOCKS)
    assert {(r.u, r.v) for r in ad.adjacency_edges(b.filter("genome = 'r'")).collect()} == {(-1, -2), (2, 3)}
    assert [(r.u, r.v) for r in ad.infinity_edges(b, "t", []).collect()] == [(-3, 1)]
    assert [(r.left_end, r.right_end) for r in ad.contig_ends(b, "t").collect()] == [(5, 7)]


def test_trees(tmp_path):
    t = rc.parse_newick("((a:1,'b c':2)0.9:3,(d,5:0.5):1e-1)[note];")
    assert t.leaves() == ["a", "b c", "d", "5"] and rate(t) == 1.0
    with pytest.raises(rc.RecipeError):
        rc.parse_newick("((a,b)")
    d = {("a", "b"): 5, ("a", "c"): 9, ("a", "d"): 6, ("b", "c"): 10, ("b", "d"): 7, ("c", "d"): 5}
    assert neighbour_joining(list("abcd"), d).newick() == "(('a' : 2.0, 'b' : 3.0) : 1.5, ('c' : 4.0, 'd' : 1.0) : 1.5)"
    q = rc.parse_newick("((a:1,b:1):1,(c:1,d:1):1);")
    assert parsimony(q, dict.fromkeys("abcd", 7), 1.0) == 0
    assert parsimony(q, {"a": 7, "b": 7, "c": 9, "d": VOID}, 1.0) > 0
    assert parsimony(q, {"a": 7, "b": 7, "c": VOID, "d": VOID}, 1.0) == 0
    assert leaves_by_distance(q, "a") == ["b", "c", "d"]


def test_matching_is_maximum_then_lightest():
    assert best_matching({(1, 2): 1.0, (2, 3): 0.1, (3, 4): 1.0}) == [(1, 2), (3, 4)]
    assert best_matching({(1, 2): 1.0, (2, 3): 0.5, (1, 3): 0.7}) == [(2, 3)]
    import itertools
    import random

    rnd = random.Random(3)
    for _ in range(60):
        e = {(a, b): rnd.randint(1, 9) / 2 for a, b in itertools.combinations(range(7), 2) if rnd.random() < 0.5}
        best = min(((-len(s), sum(e[x] for x in s)) for k in range(4) for s in itertools.combinations(e, k) if len({n for x in s for n in x}) == 2 * k), default=(0, 0))
        m = best_matching(e)
        assert (-len(m), pytest.approx(sum(e[x] for x in m))) == best


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (None, 4), (8, 9)], "u long, v long")
    assert sorted(map(tuple, connected_components(e).collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (8, 8), (9, 8)]
    chain = spark.range(400).selectExpr("id as u", "id + 1 as v")
    assert connected_components(chain).filter("component <> 0").count() == 0
    assert connected_components(e.limit(0)).count() == 0


def test_positions_agp_links_and_gaps(spark):
    c = spark.createDataFrame([("s", 0, "a", 0, 100, 1, 11), ("s", 1, "b", 0, 50, -1, 20), ("s", 2, "c", 0, 70, 1, 0)], CONTIGS)
    assert [r.start for r in iv.scaffold_positions(c).orderBy("idx").collect()] == [0, 111, 181]
    rows = sorted((r.part, r.kind, r.from_, r.to_) for r in iv.agp_rows(c).collect())
    assert rows == [(1, "W", 1, 100), (2, "N", 101, 111), (3, "W", 112, 161), (4, "N", 162, 181), (5, "W", 182, 251)]
    lines = [r.line for r in reports.links_lines(c).orderBy("ord").collect()]
    assert lines[0].startswith("s\nsequence  start  length  gap") and lines[2].split() == ["-b", "111", "50", "20"]
    g = spark.createDataFrame([("s", 0, "ACGNN", 5, False), ("s", 1, "NCGT", -7, True), ("s", 2, "NNNN", 3, False), ("s", 3, "A", 0, False)], "scf string, idx long, seq string, gap long, assembly boolean")
    got = [tuple(r)[2:] for r in iv.fix_gaps(g).orderBy("idx").collect()]
    assert got == [(0, 2, 11), (1, 7, 0), (0, 3, 11), (0, 0, 0)]


def test_ranges_cuts_sizes_names(spark):
    used = spark.createDataFrame([("c", 10, 30), ("c", 60, 100)], "chr string, s long, e long")
    seqs = spark.createDataFrame([("c", 100), ("d", 50)], "chr string, seq_len long")
    assert sorted(r.name for r in iv.range_complement(used, seqs).collect()) == ["c[0:10]", "c[30:60]", "d"]
    b = spark.createDataFrame([("g", "c", i, 1, s, e) for i, s, e in ((1, 0, 10), (2, 20, 30), (3, 60, 70))], BLOCKS)
    full = seqs.withColumn("genome", F.lit("g"))
    got = sorted((r.frag_start, r.frag_end, r.bstart, r.bend) for r in iv.cut_fragments(b, full, spark.createDataFrame([("g", "c", 40)], "genome string, chr string, cut long")).collect())
    assert got == [(0, 40, 0, 10), (0, 40, 20, 30), (40, 100, 20, 30)]
    z = spark.createDataFrame([("g", "c", 1, 1, 0, 100), ("g", "c", 1, 1, 200, 240), ("g", "c", 2, 1, 300, 380), ("g", "c", 2, 1, 400, 490)], BLOCKS)
    assert {r.block_id for r in fl.filter_by_size(z, 50).collect()} == {2}
    n = spark.createDataFrame([("x", "chr_A", 9), ("y", "chr_A", 5), ("z", "chr_A", 2)], "scf string, name string, contigs long")
    assert {r.scf: r.name for r in iv.suffix_names(n).collect()} == {"x": "chr_A", "y": "chr_A_unlocalized.1", "z": "chr_A_unlocalized.2"}
    votes = [("s", i, 1) for i in range(16)]
    ref = [(i, "chrA" if i < 12 else "chrB" if i < 15 else "chrC", 1) for i in range(16)]
    v = iv.name_votes(spark.createDataFrame(votes, "scf string, block_id long, sign int"), spark.createDataFrame(ref, "block_id long, ref_chr string, ref_sign int")).first()
    assert (v.name, v.total, v.agree, v.flip) == ("chr_chrA_chrB", 16, 16, False)


@pytest.mark.parametrize("seqs, want", [
    ({"1": "AAACGT", "2": "CGTTTT"}, {("+1", "+2", 3), ("-2", "-1", 3), ("+1", "-1", 4), ("-1", "+2", 5), ("-2", "+1", 5)}),
    ({"1": "GGATCCA", "2": "CCATTG"}, {("+1", "+2", 3), ("-2", "-1", 3), ("-1", "+1", 6)}),
])
def test_overlaps(spark, seqs, want):
    f = spark.createDataFrame(list(seqs.items()), "name string, seq string")
    assert {tuple(r) for r in ov.overlaps(tf.with_complements(f), 3, 10).collect()} == want


def test_overlap_mode_and_refinement(spark):
    e = spark.createDataFrame([("+a", "+b", 55), ("+b", "+c", 55), ("+x", "+y", 40)], "src string, dst string, size int")
    assert ov.filter_by_mode(e).count() == 2
    links = spark.createDataFrame([("s", 0, "+a", "+c"), ("s", 1, "+c", "+z"), ("s", 2, "+a", "+b")], "scf string, idx long, src string, dst string").filter("idx < 2")
    lens = spark.createDataFrame([("a", 100), ("b", 200), ("c", 100)], "name string, length long")
    got = sorted((r.idx, r.pos, r.node, r.gap) for r in ov.refine_paths(links, e, lens).collect())
    assert got == [(0, 0, "+a", 11), (0, 1, "+b", 11)]


def test_chains_cycle_and_single(spark):
    ends = spark.createDataFrame([("a", 1, 2), ("b", 3, 4), ("c", 5, 6), ("d", 7, 8)], "chr string, left_end long, right_end long")
    sup = F.array(F.struct(F.lit("g1").alias("genome"), F.lit("r").alias("chr"))).alias("supporting")
    pairs = [(2, 4, 10, False), (3, 5, 20, False), (7, 8, 0, True)]
    rows = [(x, y, d, i) for u, v, d, i in pairs for x, y in ((u, v), (v, u))]
    adj = spark.createDataFrame(rows, "node long, block long, distance long, infinity boolean").select("node", "block", "distance", sup, "infinity")
    got = sorted((r.scf, r.idx, r.chr, r.sign, r.gap) for r in sc.build_chains(ends, adj).collect())
    assert got == [("scf_a", 0, "a", 1, 10), ("scf_a", 1, "b", -1, 20), ("scf_a", 2, "c", 1, 0), ("scf_d", 0, "d", 1, 0)]
    ring = [(x, y, 1, False) for u, v in ((2, 3), (4, 1)) for x, y in ((u, v), (v, u))]
    adj = spark.createDataFrame(ring, "node long, block long, distance long, infinity boolean").select("node", "block", "distance", sup, "infinity")
    assert [(r.chr, r.idx) for r in sc.build_chains(ends, adj).orderBy("idx").collect()] == [("a", 0), ("b", 1)]


def test_merge_splices_small_contigs(spark):
    s = "scf string, idx long, chr string, sign int, gap long"
    big = spark.createDataFrame([("B", 0, "a", 1, 100), ("B", 1, "d", 1, 0)], s)
    fwd = spark.createDataFrame([("S", 0, "a", 1, 5), ("S", 1, "b", -1, 6), ("S", 2, "d", 1, 0)], s)
    rev = spark.createDataFrame([("S", 0, "d", -1, 6), ("S", 1, "b", 1, 5), ("S", 2, "a", -1, 0)], s)
    for small in (fwd, rev):
        got = [(r.chr, r.sign, r.gap) for r in sc.merge_scaffolds(big, small).orderBy("idx").collect()]
        assert got == [("a", 1, 5), ("b", -1, 6), ("d", 1, 0)]


def test_chimera_and_alternating_path():
    g = {1: {2: {"t"}, 3: {"r"}}, 2: {1: {"t"}, 4: {"r"}}, 3: {1: {"r"}, 4: {"t"}}, 4: {2: {"r"}, 3: {"t"}}}
    assert inf.alternating_path(g, 1, 2, "t") == 2
    g[4][2] = g[2][4] = {"q"}
    assert inf.alternating_path(g, 1, 2, "t") is None


def test_long_alternating_paths_explain_as_well():
    n = 400  # a ring of 2n nodes: reference edges (2i, 2i + 1), target edges (2i + 1, 2i + 2)
    g = {}
    for i in range(n):
        for a, b, c in ((2 * i, 2 * i + 1, "r"), (2 * i + 1, (2 * i + 2) % (2 * n), "t")):
            g.setdefault(a, {})[b] = g.setdefault(b, {})[a] = {c}
    assert inf.alternating_path(g, 0, 2 * n - 1, "t") == n
    g[100][101] = g[101][100] = {"q"}
    assert inf.alternating_path(g, 0, 2 * n - 1, "t") is None


def test_overlap_joins_stop_at_contigs(spark):
    ends = spark.createDataFrame([("a", 1, 2), ("b", 3, 4), ("c", 5, 6)], "chr string, left_end long, right_end long")
    edges = [("+a", "+x"), ("+x", "-b"), ("-b", "+c"), ("+c", "+y"), ("+y", "+z")]
    e = spark.createDataFrame([(x, y, 9) for x, y in edges], "src string, dst string, size int")
    assert sorted(map(tuple, ov.overlap_joins(ends, e).collect())) == [(2, 4), (3, 5)]
    assert ov.overlap_joins(ends, e, 1).collect()[0] == (3, 5)


def test_refinement_searches_from_both_ends(spark):
    import random

    rnd = random.Random(2)
    for steps in (1, 4, 7):
        edges = {(f"+n{rnd.randrange(14)}", f"+n{rnd.randrange(14)}") for _ in range(22)}
        e = spark.createDataFrame([(a, b, 5) for a, b in edges if a != b], "src string, dst string, size int")
        pairs = [(f"+n{rnd.randrange(14)}", f"+n{rnd.randrange(14)}") for _ in range(8)]
        links = spark.createDataFrame([("s", i, a, b) for i, (a, b) in enumerate(pairs) if a != b], "scf string, idx long, src string, dst string")
        got = {}
        for r in ov.surroundings(links, e, steps).collect():
            got.setdefault(r.idx, set()).add(r.x)

        def depths(start, way):
            d, level = {start: 0}, [start]
            while level:
                level = [y for x in level for y in {p[way] for p in edges if p[1 - way] == x and p[0] != p[1]} if d.setdefault(y, d[x] + 1) == d[x] + 1]
            return d

        for i, (a, b) in enumerate(pairs):
            if a != b:
                f, w = depths(a, 1), depths(b, 0)
                need = {x for x in f if x in w and f[x] + w[x] <= steps}
                assert need <= got.get(i, set()) and bool(need) == (i in got)


def test_simplify_joins_collinear_blocks(spark):
    rows = [(g, "c", i + 1, 1, 100 * i, 100 * i + 90) for g in ("x", "y") for i in range(4)]
    got = si.compress_paths(spark.createDataFrame(rows, BLOCKS), 20).collect()
    assert sorted((r.genome, r.block_id, r.bstart, r.bend) for r in got) == [("x", 1, 0, 390), ("y", 1, 0, 390)]
    assert si.compress_paths(spark.createDataFrame(rows, BLOCKS), 5).count() == 8
    bulge = [("x", "c", 1, 1, 0, 10), ("x", "c", 2, 1, 12, 20), ("x", "c", 3, 1, 22, 30), ("y", "c", 1, 1, 0, 10), ("y", "c", 4, 1, 12, 20), ("y", "c", 3, 1, 22, 30)]
    assert {r.block_id for r in si.remove_bulges(spark.createDataFrame(bulge, BLOCKS), 5).collect()} == {1, 3}


def test_contexts_align():
    def align(one, two, repeats, same):
        return int(rp.align(*rp.padded([one], False), *rp.padded([two], False), np.array(sorted(repeats), np.int64), same)[0, 0])

    assert align([1, 2, 3], [1, 2, 3], set(), True) == 6
    assert align([2, 3], [1, 2, 3], set(), True) == 2
    assert align([1, 2], [1, 2], {2}, True) == 3
    assert align([], [1, 2], set(), False) == 0


def test_order_check(spark):
    o = spark.createDataFrame([("s", i, c, 1) for i, c in enumerate("abdc")], "scf string, idx long, contig string, sign int")
    h = spark.createDataFrame([(c, "chr1", i, 1, 100 * i, 1000) for i, c in enumerate("abcd")], "contig string, chr string, position long, strand int, start long, chr_len long")
    r = ve.verify_order(o, h).first()
    assert (r.contigs, r.misordered, r.gaps) == (4, 1, 1)


def test_readers(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    fa = tf.read_fasta(spark, file("a.fa", ">one x > y\nACGT\nnn\n>two\nRY\n"))
    assert sorted(map(tuple, fa.collect())) == [("one", "ACGTnn"), ("two", "RY")]
    with pytest.raises(tf.FormatError):
        tf.read_fasta(spark, file("b.fa", ">one\nACQ\n"))
    dash = "-" * 10
    coords = tf.read_blocks_coords(spark, file("c.txt", f"Seq_id\tSize\tDescription\n1\t100\tg.chr.1\n2\t90\th.x\n{dash}\nBlock #3\nSeq_id\tStrand\tStart\tEnd\tLength\n1\t+\t5\t25\t20\n2\t-\t40\t20\t20\n{dash}\n"))
    assert sorted(map(tuple, coords.collect())) == [("g", "chr.1", 100, 3, 1, 5, 25), ("h", "x", 90, 3, -1, 20, 40)]
    maf = tf.read_maf(spark, file("d.maf", "##maf\n\na score=1\ns g.c 10 20 - 100 ACGTACGTACGTACGTACGT\ns h.c 0 20 + 50 ACGTACGTACGTACGTACGT\n\na\ns g.c 0 5 + 100 ACGTA\ns h.c 0 20 + 50 ACGTACGTACGTACGTACGT\n"), 10)
    assert sorted(map(tuple, maf.collect())) == [("g", "c", 100, 1, -1, 70, 90), ("h", "c", 50, 1, 1, 0, 20)]
    gff = tf.read_gff(spark, file("e.gff", "#x\ng.c\t.\tb\t11\t30\t.\t-\t.\tname=q;id=4\n"))
    assert tuple(gff.first()) == ("g", "c", 30, 4, -1, 10, 30)
    dot = tf.read_overlap_dot(spark, file("f.dot", 'digraph {\n"+a" -> "-b" [label="57"];\n}\n'))
    assert [tuple(r) for r in dot.collect()] == [("+a", "-b", 57)]
    nuc = tf.read_nucmer_coords(spark, file("g.coords", "x\n====\n 100 200 | 30 10 | 101 21 | 99.0 | refA\tq1\n 5 9 | 1 5 | 5 5 | 99 | refB\tq2\n"))
    assert sorted((r.ref, r.qry, r.strand, r.ref_start, r.qry_start, r.qry_end) for r in nuc.collect()) == [("chr1", "q1", -1, 100, 10, 30), ("chr2", "q2", 1, 5, 1, 5)]
    paf = tf.read_paf(spark, file("h.paf", "q\t50\t1\t20\t-\tr\t90\t5\t24\t19\t19\t60\n"))
    assert (paf.first().strand, paf.first().ref_start, paf.first().qry_len) == (-1, 5, 50)
    pm = tf.read_pairwise_maf(spark, file("i.maf", "a\ns r 5 10 + 100 AAAAAAAAAA\ns q 10 20 - 100 CCCCCCCCCC\n\n")).first()
    assert (pm.ref_end, pm.qry_start, pm.qry_end, pm.strand) == (15, 69, 89, -1)
    perm = tf.read_permutations(spark, file("j.txt", ">g.c\n+1 -2 $\n>h.c\n+3 $\n"))
    assert sorted(map(tuple, perm.collect())) == [("g.c", 0, 1), ("g.c", 1, -2), ("h.c", 0, 3)]
    order = tf.read_order(spark, file("k.ord", ">s1\n+a[0:5]\n-b\n"))
    assert sorted(map(tuple, order.collect())) == [("s1", 0, "a", 1), ("s1", 1, "b", -1)]
    assert tf.genome_scale(fa) == "small"


def test_recipe(tmp_path):
    p = tmp_path / "x.rcp"
    p.write_text("#c\n.references = r1, r2\n.target = t\n.blocks = small\n*.draft = false\nr2.draft = True\nt.fasta = t.fa\n.tree = ((r1,r2),t);\n")
    r = rc.parse_recipe(str(p))
    assert r["blocks"] == [5000, 500, 100] and r["genomes"]["r2"]["draft"] and r["genomes"]["t"]["fasta"] == str(tmp_path / "t.fa")
    for bad in (".target = t\n", ".references = a\n.target = t\n.tree = (a,b);\n", ".references = a\n.target = t\nz.draft = true\n", ".foo = 1\n"):
        p.write_text(bad)
        with pytest.raises(rc.RecipeError):
            rc.parse_recipe(str(p))


def test_broken_genome_is_put_back_in_order(spark, tmp_path):
    """A genome cut into contigs, scaffolded against two copies of itself, comes out in its own order."""
    n, size = 24, 1000
    rows = [(g, "chr", i + 1, 1, i * size, i * size + 800) for g in ("r1", "r2") for i in range(n)]
    for k in range(n // 4):
        flip = k % 2
        for j in range(4):
            i = 4 * k + (3 - j if flip else j)
            rows.append(("t", f"c{k}", i + 1, -1 if flip else 1, j * size, j * size + 800))
    b = spark.createDataFrame(rows, BLOCKS)
    seqs = spark.createDataFrame([("t", f"c{k}", 4 * size) for k in range(n // 4)], "genome string, chr string, seq_len long")
    import random

    rnd = random.Random(1)
    fa = spark.createDataFrame([(f"c{k}", "".join(rnd.choice("ACGT") for _ in range(4 * size))) for k in range(n // 4)], "name string, seq string")
    out = run_scaffolding(spark, {500: b}, seqs, "t", ["r1", "r2"], [], "((t:1,r1:1):1,r2:1);", fasta=fa)
    got = [(r.chr, r.sign) for r in out["contigs"].orderBy("idx").collect()]
    want = [(f"c{k}", -1 if k % 2 else 1) for k in range(n // 4)]
    assert got in (want, [(c, -s) for c, s in reversed(want)])
    assert out["contigs"].first().scf == "chr_chr"
    s = out["statistics"].first()
    assert s.scaffolds == 1 and s.contigs == n // 4
    assert len(out["fasta"].first().seq) == s.contig_length + s.gap_length
    write_outputs(out, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/scaffolds.agp")).count() == 2 * (n // 4) - 1

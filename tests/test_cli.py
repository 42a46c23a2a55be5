import random

from synframe.__main__ import main


def test_scaffold_overlap_synteny_and_verify(spark, tmp_path):
    rnd = random.Random(2)
    n, size = 4, 4000
    seqs = {f"c{k}": "".join(rnd.choice("ACGT") for _ in range(size)) for k in range(n)}
    (tmp_path / "t.fa").write_text("".join(f">{k}\n{s}\n" for k, s in seqs.items()))
    table = [("t", f"c{k}", size) for k in range(n)] + [("r", "chr", n * size)]
    ids = {(g, c): i + 1 for i, (g, c, _) in enumerate(table)}
    out = ["Seq_id\tSize\tDescription"] + [f"{ids[g, c]}\t{s}\t{g}.{c}" for g, c, s in table]
    for b in range(4 * n):
        k, j = divmod(b, 4)
        s = 1000 * j
        out += ["-" * 20, f"Block #{b + 1}", "Seq_id\tStrand\tStart\tEnd\tLength", f"{ids['t', f'c{k}']}\t+\t{s}\t{s + 800}\t800", f"{ids['r', 'chr']}\t+\t{size * k + s}\t{size * k + s + 800}\t800"]
    (tmp_path / "b500.txt").write_text("\n".join(out) + "\n")
    (tmp_path / "x.rcp").write_text(".references = r\n.target = t\n.blocks = 500\n.tree = (t:1,r:1);\nt.fasta = t.fa\n")
    assert main(["scaffold", str(tmp_path / "x.rcp"), "-o", str(tmp_path / "out"), "--coords", str(tmp_path / "b{size}.txt"), "--debug"]) == 0
    dot = [r.value for r in spark.read.text(str(tmp_path / "out/debug/500/breakpoint_graph.dot")).collect()]
    assert dot[0] == "graph {" and dot[-1] == "}" and '-1 -- 2 [genome="r", infinity="False"];' in dot
    assert spark.read.text(str(tmp_path / "out/debug/phylogeny.txt")).count() == 2
    agp = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "out/scaffolds.agp")).collect()]
    assert [x[5] for x in agp if x[4] == "W"] == [f"c{k}" for k in range(n)]
    assert main(["scaffold", str(tmp_path / "none.rcp")]) == 1

    (tmp_path / "o.fa").write_text(">1\nAAACGT\n>2\nCGTTTT\n")
    assert main(["overlap", str(tmp_path / "o.fa"), str(tmp_path / "o.dot"), "--min", "3", "--max", "6"]) == 0

    maf = "##maf\n\n" + "\n".join(f"a\ns g.c {100 * i} 50 + 1000 {'A' * 50}\ns h.c {100 * i} 50 + 1000 {'A' * 50}\n" for i in range(5))
    (tmp_path / "x.maf").write_text(maf)
    (tmp_path / "p.txt").write_text("30 60\n")
    assert main(["synteny", str(tmp_path / "x.maf"), "-o", str(tmp_path / "blocks"), "-b", "20,40", "-s", str(tmp_path / "p.txt")]) == 0
    assert [r.value for r in spark.read.text(str(tmp_path / "blocks/40/genomes_permutations.txt")).collect()] == [">g.c", "+1 $", ">h.c", "+1 $"]
    assert spark.read.text(str(tmp_path / "blocks/20/genomes_permutations.txt")).filter("value like '%+5%'").count() == 2

    (tmp_path / "a.paf").write_text("".join(f"c{k}\t100\t0\t100\t+\tr\t1000\t{200 * k}\t{200 * k + 100}\t100\t100\t60\n" for k in range(3)))
    (tmp_path / "a.ord").write_text(">s\n+c0\n+c1\n+c2\n")
    assert main(["verify", str(tmp_path / "a.paf"), str(tmp_path / "a.ord")]) == 0


def test_sources_are_looked_up_by_name(spark, tmp_path):
    import pytest

    from synframe.sources import recipe as rc

    assert rc.source_of({}) == "sequences" and rc.source_of({"hal": "x"}) == "hal" and rc.source_of({"hal": "x", "maf": "y"}) == "maf"
    with pytest.raises(rc.RecipeError, match="MAF"):
        rc.run_source("hal", spark, {"hal": "x"}, [500])
    with pytest.raises(rc.RecipeError, match="no source"):
        rc.run_source("none", spark, {}, [500])
    with pytest.raises(rc.RecipeError, match="exists"):
        rc.register_source("maf", rc.MafSource)
    (tmp_path / "p.txt").write_text(rc.simplify_passes_text(rc.SIMPLIFY_PASSES))
    assert rc.parse_simplify_passes(str(tmp_path / "p.txt")) == list(rc.SIMPLIFY_PASSES)
    assert rc.simplify_passes_text([(30, 150)], counted=True) == "1\n30 150\n"


def test_maf_without_blank_lines_and_repeated_fasta_names(spark, tmp_path):
    from synframe.sources import text_formats as tf

    (tmp_path / "a.maf").write_text("a\ns g.c 0 20 + 100 " + "A" * 20 + "\ns h.gi|7 5 20 + 50 " + "A" * 20 + "\na score=2\ns g.c 30 20 + 100 " + "A" * 20 + "\ns h.gi|7| 30 20 - 50 " + "A" * 20 + "\n")
    got = sorted(map(tuple, tf.read_maf(spark, str(tmp_path / "a.maf"), 10).collect()))
    assert got == [("g", "c", 100, 1, 1, 0, 20), ("g", "c", 100, 2, 1, 30, 50), ("h", "gi|7|", 50, 1, 1, 5, 25), ("h", "gi|7|", 50, 2, -1, 0, 20)]
    (tmp_path / "a.fa").write_text(">one\nTTTT\n>two\nA\n>one\nACGT\n")
    assert sorted(map(tuple, tf.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("one", "ACGT"), ("two", "A")]


def test_orders_of_two_files_and_of_split_files(spark, tmp_path):
    from synframe.sources import text_formats as tf

    for f in "ab":
        (tmp_path / f"{f}.ord").write_text("".join(f">{f}{s}\n" + "".join(f"+{f}{s}x{i}\n" for i in range(40)) for s in range(5)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = tf.read_order(spark, str(tmp_path) + "/*.ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.scf, r.idx, r.contig) for r in got) == sorted((f"{f}{s}", i, f"{f}{s}x{i}") for f in "ab" for s in range(5) for i in range(40))


def test_scaffolds_from_sequences_alone(spark, tmp_path):
    """No alignment and no blocks: contigs of a genome, some turned round, against two relatives with single differences."""
    rnd = random.Random(5)
    n, size = 6, 1500
    genome = "".join(rnd.choice("ACGT") for _ in range(n * size))

    def relative(every):
        s = list(genome)
        for i in range(every // 2, len(s), every):
            s[i] = {"A": "C", "C": "G", "G": "T", "T": "A"}[s[i]]
        return "".join(s)

    turn = str.maketrans("ACGT", "TGCA")
    contigs = {f"c{k}": genome[size * k : size * (k + 1)] for k in range(n)}
    contigs = {k: s[::-1].translate(turn) if k in ("c1", "c4") else s for k, s in contigs.items()}
    (tmp_path / "t.fa").write_text("".join(f">{k}\n{s}\n" for k, s in contigs.items()))
    for g, every in (("r1", 211), ("r2", 173)):
        (tmp_path / f"{g}.fa").write_text(f">chr\n{relative(every)}\n")
    (tmp_path / "x.rcp").write_text(".references = r1,r2\n.target = t\n.blocks = 100,50\n.tree = ((t:1,r1:1):1,r2:1);\n" + "".join(f"{g}.fasta = {g}.fa\n" for g in ("t", "r1", "r2")))
    assert main(["scaffold", str(tmp_path / "x.rcp"), "-o", str(tmp_path / "out")]) == 0
    agp = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "out/scaffolds.agp")).collect()]
    got = [(x[5], x[8]) for x in agp if x[4] == "W"]
    want = [(f"c{k}", "-" if k in (1, 4) else "+") for k in range(n)]
    back = [(c, "+" if s == "-" else "-") for c, s in reversed(want)]
    assert got in (want, back)
    (tmp_path / "y.rcp").write_text(".references = r1\n.target = t\n.blocks = 100\n.tree = (t:1,r1:1);\nt.fasta = t.fa\n")
    assert main(["scaffold", str(tmp_path / "y.rcp"), "-o", str(tmp_path / "no")]) == 1


def test_scaffolds_from_an_alignment(spark, tmp_path):
    seq = "ACGT" * 150
    rows, at = [], 0
    for k in range(6):
        c, i = divmod(k, 2)
        rows.append(f"a\ns t.c{c} {700 * i} 600 + 1400 {seq}\ns r.chr {at} 600 + 9000 {seq}\n")
        at += 700
    (tmp_path / "x.maf").write_text("##maf\n\n" + "\n".join(rows))
    (tmp_path / "x.rcp").write_text(".references = r\n.target = t\n.blocks = 500\n.maf = x.maf\n.tree = (t:1,r:1);\n")
    assert main(["scaffold", str(tmp_path / "x.rcp"), "-o", str(tmp_path / "out")]) == 0
    agp = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "out/scaffolds.agp")).collect()]
    assert [x[5] for x in agp if x[4] == "W"] == ["c0", "c1", "c2"]

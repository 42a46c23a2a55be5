"""The whole scaffolding run: stages of falling block size, chimera cuts, merging, naming, refinement, output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synframe.functions.sequence import fragment_name
from synframe.operators import adjacency as ad
from synframe.operators import filters as fl
from synframe.operators import inference as inf
from synframe.operators import intervals as iv
from synframe.operators import overlap as ov
from synframe.operators import phylogeny as ph
from synframe.operators import repeats as rp
from synframe.operators import scaffold as sc
from synframe.runtime import Written
from synframe.sinks import reports
from synframe.sources.recipe import Tree, parse_newick
from synframe.sources.text_formats import with_complements


@dataclass(frozen=True)
class Stage:
    """One pass: blocks of a size, which indels to allow, whether repeats are resolved and rearrangements projected."""

    name: str
    size: int
    ref_indels: bool
    repeats: bool
    rearrange: bool


def stage_plan(sizes: list[int], resolve_repeats: bool = False) -> list[Stage]:
    order = sorted(sizes, reverse=True)
    return [Stage(str(s), s, False, False, True) for s in order] + [Stage("refine", order[-1], True, resolve_repeats, False)]


def fragments(seqs: DataFrame, cuts: DataFrame) -> DataFrame:
    """``(chr, fs, fe, name)``: pieces of the target's sequences between cuts (chr, cut)."""
    c = cuts.select("chr", "cut").distinct().groupBy("chr").agg(F.collect_list("cut").alias("cuts"))
    s = seqs.join(c, "chr", "left")
    at = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), F.col("seq_len")), F.coalesce("cuts", F.array().cast("array<bigint>")))))
    s = s.withColumn("at", F.filter(at, lambda x: (x >= 0) & (x <= F.col("seq_len"))))
    p = F.arrays_zip(F.slice("at", F.lit(1), F.size("at") - 1).alias("fs"), F.slice("at", F.lit(2), F.size("at") - 1).alias("fe"))
    return s.select("chr", "seq_len", F.inline(p)).select("chr", "fs", "fe", fragment_name(F.col("chr"), F.col("fs"), F.col("fe"), F.col("seq_len")).alias("name"))


def _on_fragments(blocks: DataFrame, frags: DataFrame, target: str) -> DataFrame:
    """Target blocks re-based on their fragments, named after them; other genomes as they are."""
    t = blocks.filter(F.col("genome") == target).join(frags, "chr").filter("fs <= bstart and bstart < fe")
    t = t.select("genome", F.col("name").alias("chr"), "block_id", "sign", (F.col("bstart") - F.col("fs")).alias("bstart"), (F.least("bend", "fe") - F.col("fs")).alias("bend"))
    return t.unionByName(blocks.filter(F.col("genome") != target).select("genome", "chr", "block_id", "sign", "bstart", "bend"))


def _unfold(chains: DataFrame, frags: DataFrame) -> DataFrame:
    """Chains of fragment names as contigs (scf, idx, chr, s, e, sign, gap)."""
    f = frags.select(F.col("name").alias("chr"), F.col("chr").alias("c"), "fs", "fe")
    return chains.join(f, "chr").select("scf", "idx", F.col("c").alias("chr"), F.col("fs").alias("s"), F.col("fe").alias("e"), "sign", "gap")


def _refit(contigs: DataFrame, frags: DataFrame) -> DataFrame:
    """Contigs in terms of finer fragments, with their names in ``chr``."""
    c = iv.containment(contigs, frags.select("chr", "fs", "fe"))
    c = c.join(frags, ["chr", "fs", "fe"])
    return c.select("scf", (F.col("idx") * 1_000_000 + F.col("n")).alias("idx"), F.col("name").alias("chr"), "sign", "gap")


def scaffold_stage(blocks: DataFrame, target: str, drafts: list[str], tree: Tree, n_genomes: int, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Chains of one stage and its breakpoint graph."""
    kept = Written(blocks.sparkSession, "stage")
    blocks = kept.cut(blocks)
    origin = None
    if stage.repeats:
        blocks = kept.cut(fl.filter_indels(blocks, target, n_genomes, stage.ref_indels))
        r = kept.cut(fl.repeat_blocks(blocks))
        pure = fl.sequence_uniqueness(blocks, r).filter((F.col("genome") == target) & F.col("all_repeats"))
        blocks = kept.cut(rp.resolve_repeats(blocks, rp.match_profiles(ad.repeat_contexts(blocks, r), r, tree, target, drafts=drafts, repetitive=pure), target))
        clean = kept.cut(fl.without_blocks(blocks.drop("origin"), r))
        origin = blocks.filter((F.col("genome") == target) & (F.col("chr") != F.col("origin"))).select("chr", "origin").distinct()
    else:
        clean = kept.cut(fl.clean_blocks(blocks, target, n_genomes, stage.ref_indels))
    g = kept.cut(ad.breakpoint_graph(clean, target, drafts))
    known = g.filter((F.col("genome") == target)).select("a", "b").distinct()
    adj = inf.infer_adjacencies(g, inf.min_weight_matching(g, tree, target).unionByName(known).distinct(), ph.rank_table(blocks.sparkSession, tree, target))
    chains = sc.build_chains(ad.contig_ends(clean, target), adj)
    if origin is not None:  # copies of a contig go by its own name again
        chains = chains.join(origin, "chr", "left").withColumn("chr", F.coalesce("origin", "chr")).drop("origin")
    return kept.cut(chains), g


def run_scaffolding(
    spark: SparkSession,
    blocks_by_size: dict[int, DataFrame],
    seqs: DataFrame,
    target: str,
    references: list[str],
    drafts: list[str],
    tree: Tree | str | None = None,
    naming_ref: str | None = None,
    resolve_repeats: bool = False,
    solid_scaffolds: bool = False,
    fasta: DataFrame | None = None,
    refine: bool = False,
    overlap: tuple[int, int] = (33, 200),
    debug: str | None = None,
) -> dict[str, DataFrame]:
    """Scaffolds of the target (survey 3.1): ``contigs`` (scf, idx, chr, s, e, sign, gap), ``names``, ``unplaced``, ``statistics`` and,
    if sequences are given, ``fasta``. ``seqs``: (genome, chr, seq_len). With ``debug`` the breakpoint graph of every stage, its blocks of the
    target and the tree are written there (B12)."""
    kept = Written(spark, "run")
    n = len(references) + 1
    plan = stage_plan(list(blocks_by_size), resolve_repeats)
    if tree is None:
        small = fl.clean_blocks(blocks_by_size[plan[-1].size], target, n, True)
        tree = ph.infer_tree(ad.genome_distance(small), [target, *references])
    tree = parse_newick(tree) if isinstance(tree, str) else tree
    if debug:
        reports.write_lines(spark.createDataFrame([("a", 0, tree.newick()), ("b", 0, target)], "part string, ord int, line string"), f"{debug}/phylogeny.txt")
    own = kept.cut(seqs.filter(F.col("genome") == target).select("chr", "seq_len"))
    cuts = spark.createDataFrame([], "stage int, genome string, chr string, cut long")
    if not solid_scaffolds:
        per = [kept.cut(inf.contig_breaks(ad.breakpoint_graph(fl.clean_blocks(blocks_by_size[s.size], target, n, s.ref_indels), target, drafts), target)) for s in plan]
        cuts = inf.break_cuts(inf.hierarchical_breaks(per), None if fasta is None else fasta.select(F.col("name").alias("chr"), "seq"))
    cuts = kept.cut(cuts)
    merged = None
    for i, stage in enumerate(plan):
        f = fragments(own, cuts.filter(F.col("stage") == i))
        own_blocks = _on_fragments(blocks_by_size[stage.size], f, target)
        chains, g = scaffold_stage(own_blocks, target, drafts, tree, n, stage)
        if debug:
            reports.write_lines(reports.graph_dot_lines(g), f"{debug}/{stage.name}/breakpoint_graph.dot")
            reports.write_lines(reports.permutation_lines(own_blocks.filter(F.col("genome") == target)), f"{debug}/{stage.name}/contigs.txt")
        now = _unfold(chains, f)
        if merged is None:
            merged = kept.cut(now)
            continue
        fine = fragments(own, cuts.filter(F.col("stage") <= i))
        old, new = kept.cut(_refit(merged, fine)), kept.cut(_refit(now, fine))
        out = sc.merge_scaffolds(old, new)
        if stage.rearrange:
            # accepted k-breaks change the joins of the old scaffolds; chains are built anew from them
            joins = kept.cut(sc.project_rearrangements(old, new))
            ends = old.select("chr").distinct().withColumn("n", F.abs(F.xxhash64("chr")))
            ends = kept.cut(ends.select("chr", F.col("n").alias("left_end"), (-F.col("n")).alias("right_end")))
            side = lambda c, s: F.when(F.col(s) == "L", F.col(c)).otherwise(-F.col(c))
            e2 = ends.select(F.col("chr").alias("chr2"), F.col("left_end").alias("n2"))
            j = joins.join(ends.select("chr", F.col("left_end").alias("n1")), "chr").join(e2, "chr2").select(side("n1", "side").alias("u"), side("n2", "side2").alias("v"), "gap")
            j = kept.cut(j)
            empty = F.array().cast("array<struct<genome:string,chr:string>>")
            a = j.select(F.col("u").alias("node"), F.col("v").alias("block"), F.col("gap").alias("distance"), empty.alias("supporting"), F.lit(False).alias("infinity"))
            a = a.unionByName(j.select(F.col("v").alias("node"), F.col("u").alias("block"), F.col("gap").alias("distance"), empty.alias("supporting"), F.lit(False).alias("infinity")))
            out = sc.merge_scaffolds(kept.cut(sc.build_chains(ends, a).drop("supporting")), new)
        merged = kept.cut(_unfold(out, fine))
    contigs = iv.merge_consecutive(merged)
    last = blocks_by_size[plan[-1].size]
    t = last.filter(F.col("genome") == target)
    # the links' gaps lie between outer blocks; those parts of the contigs are taken off
    outer = contigs.join(t, "chr").filter("s <= bstart and bstart < e").groupBy("scf", "idx").agg((F.min("bstart") - F.first("s")).alias("l"), (F.first("e") - F.max("bend")).alias("r"))
    c = contigs.join(outer, ["scf", "idx"], "left").select("scf", "idx", "chr", "s", "e", "sign", "gap", F.coalesce(F.when(F.col("sign") > 0, F.col("l")).otherwise(F.col("r")), F.lit(0)).alias("left_gap"), F.coalesce(F.when(F.col("sign") > 0, F.col("r")).otherwise(F.col("l")), F.lit(0)).alias("right_gap"))
    contigs = kept.cut(iv.update_gaps(c).drop("left_gap", "right_gap"))
    ref = last.filter(F.col("genome") == (naming_ref or references[0]))
    once = ref.groupBy("block_id").count().filter("count = 1").select("block_id")
    ref = ref.join(once, "block_id").select("block_id", F.col("chr").alias("ref_chr"), F.col("sign").alias("ref_sign"))
    mine = contigs.join(t.select("chr", "block_id", F.col("sign").alias("bs"), "bstart"), "chr").filter("s <= bstart and bstart < e").select("scf", "block_id", (F.col("sign") * F.col("bs")).alias("sign"))
    votes = kept.cut(iv.name_votes(mine, ref))
    sizes = contigs.groupBy("scf").agg(F.count("*").alias("contigs"))
    names = iv.suffix_names(sizes.join(votes, "scf", "left").select("scf", F.coalesce("name", F.lit("chr")).alias("name"), "contigs"))
    contigs = iv.flip_scaffolds(contigs, votes.filter("flip").select("scf"))
    contigs = kept.cut(contigs.join(names.select("scf", F.col("name").alias("_n")), "scf").withColumn("scf", F.col("_n")).drop("_n"))
    used = contigs.select("chr", "s", "e")
    out = {"unplaced": iv.range_complement(used, own)}
    if fasta is not None:
        part = F.expr("substring(seq, int(s) + 1, int(e - s))")
        assembly = F.lit(False)
        if refine:
            contigs = kept.cut(_refined(contigs, fasta, overlap))
            assembly = F.col("assembly")
        from synframe.functions.sequence import reverse_complement

        seq = contigs.join(fasta.select(F.col("name").alias("chr"), "seq"), "chr")
        seq = seq.select("scf", "idx", F.when(F.col("sign") > 0, part).otherwise(reverse_complement(part)).alias("seq"), "gap", assembly.alias("assembly"))
        fixed = iv.fix_gaps(seq)
        plus = F.col("sign") > 0
        contigs = contigs.drop("gap").join(fixed, ["scf", "idx"]).select("scf", "idx", "chr", (F.col("s") + F.when(plus, F.col("trim_left")).otherwise(F.col("trim_right"))).alias("s"), (F.col("e") - F.when(plus, F.col("trim_right")).otherwise(F.col("trim_left"))).alias("e"), "sign", "gap")
        contigs = kept.cut(contigs)
        out["fasta"] = reports.scaffold_sequences(contigs, fasta)
    return out | {"contigs": contigs, "names": names, "statistics": iv.assembly_statistics(contigs)}


def _refined(contigs: DataFrame, fasta: DataFrame, overlap: tuple[int, int]) -> DataFrame:
    """J23/J27 on the overlap graph of the target's sequences: inserted contigs and new gaps, flagged ``assembly``."""
    from pyspark.sql import Window

    kept = Written(contigs.sparkSession, "refine")
    edges = kept.cut(ov.overlap_graph(fasta, *overlap))
    w = Window.partitionBy("scf").orderBy("idx")
    name = F.concat(F.when(F.col("sign") > 0, "+").otherwise("-"), "chr")
    links = contigs.withColumn("src", name).withColumn("dst", F.lead(name).over(w)).filter("dst is not null").select("scf", "idx", "src", "dst")
    length = fasta.select("name", F.length("seq").cast("long").alias("length"))
    p = kept.cut(ov.refine_paths(links, edges, length))
    head = p.filter("pos = 0").select("scf", "idx", F.col("gap").alias("_g"))
    old = contigs.join(head, ["scf", "idx"], "left").select("scf", (F.col("idx") * 1000).alias("idx"), "chr", "s", "e", "sign", F.coalesce("_g", "gap").alias("gap"), F.col("_g").isNotNull().alias("assembly"))
    new = p.filter("pos > 0").withColumn("chr", F.expr("substring(node, 2)")).join(length.withColumnRenamed("name", "chr"), "chr")
    new = new.select("scf", (F.col("idx") * 1000 + F.col("pos")).alias("idx"), "chr", F.lit(0).cast("long").alias("s"), F.col("length").alias("e"), F.when(F.col("node").startswith("+"), 1).otherwise(-1).alias("sign"), "gap", F.lit(True).alias("assembly"))
    return old.unionByName(new)


def write_outputs(result: dict[str, DataFrame], folder: str) -> None:
    """Links, AGP, statistics, unplaced ranges and, if present, sequences."""
    reports.write_lines(reports.links_lines(result["contigs"]), f"{folder}/scaffolds.links")
    reports.write_lines(reports.agp_lines(result["contigs"]), f"{folder}/scaffolds.agp")
    result["statistics"].write.mode("overwrite").json(f"{folder}/statistics")
    result["unplaced"].write.mode("overwrite").parquet(f"{folder}/unplaced")
    if "fasta" in result:
        reports.write_lines(reports.fasta_lines(result["fasta"]), f"{folder}/scaffolds.fasta")

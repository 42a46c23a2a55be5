"""Command line: ``python -m synframe scaffold|synteny|overlap|verify ...``."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from synframe.operators import filters, intervals, verify
from synframe.operators.overlap import overlap_graph, overlap_rate
from synframe.operators.simplify import multi_scale
from synframe.plans.scaffolding import run_scaffolding, write_outputs
from synframe.runtime import clean
from synframe.sinks import reports
from synframe.sources import recipe as rc
from synframe.sources import text_formats as tf

log = logging.getLogger("synframe")


def scaffold(spark, a) -> None:
    recipe = rc.parse_recipe(a.recipe)
    target, refs = recipe["target"], recipe["references"]
    path = recipe["genomes"][target].get("fasta")
    fasta = tf.read_fasta(spark, path).persist() if path else None
    sizes = recipe.get("blocks") or rc.BLOCK_SIZES[tf.genome_scale(fasta) if fasta is not None else "small"]
    name = "coords" if a.coords else rc.source_of(recipe)
    options = {"coords": {"pattern": a.coords}, "maf": {"cache": f"{a.out}/blocks", "overwrite": a.overwrite}}.get(name, {})
    blocks = rc.run_source(name, spark, recipe, sizes, **options)
    known = [target, *refs]
    blocks = {s: b.filter(F.col("genome").isin(known)) for s, b in blocks.items()}
    seqs = None
    for b in blocks.values():
        s = b.select("genome", "chr", "seq_len")
        seqs = s if seqs is None else seqs.unionByName(s)
    seqs = seqs.groupBy("genome", "chr").agg(F.max("seq_len").alias("seq_len")).persist()
    if fasta is not None:  # sequences without a block belong to the unplaced ones
        own = fasta.select(F.lit(target).alias("genome"), F.col("name").alias("chr"), F.length("seq").cast("long").alias("seq_len"))
        seqs = seqs.filter(F.col("genome") != target).unionByName(own)
    missing = set(known) - {r["genome"] for r in seqs.select("genome").distinct().collect()}
    if missing:
        raise rc.RecipeError(f"genomes without blocks: {sorted(missing)}")
    small = blocks[min(blocks)]
    for r in filters.genome_coverage(small, seqs).filter("low").collect():
        log.warning("low coverage of %s: %.3f", r["genome"], r["coverage"])
    drafts = [g for g, p in recipe["genomes"].items() if p.get("draft") and g != target]
    out = run_scaffolding(spark, blocks, seqs, target, refs, drafts, recipe.get("tree"), recipe.get("naming_ref"), a.repeats, a.solid_scaffolds, fasta, a.refine, debug=f"{a.out}/debug" if a.debug else None)
    write_outputs(out, a.out)
    log.info("%s", out["statistics"].first().asDict())


def synteny(spark, a) -> None:
    blocks = tf.read_gff(spark, a.alignment) if a.alignment.endswith(("gff", "gff3")) else tf.read_maf(spark, a.alignment, 1)
    passes = rc.parse_simplify_passes(a.params) if a.params else rc.SIMPLIFY_PASSES
    seqs = blocks.select("genome", "chr", "seq_len").distinct()
    for size, b in multi_scale(blocks, passes, [int(x) for x in a.blocks.split(",")]).items():
        b = intervals.renumber(b)
        folder = f"{a.out}/{size}"
        reports.write_lines(reports.coords_lines(b, seqs), f"{folder}/blocks_coords.txt")
        reports.write_lines(reports.permutation_lines(b), f"{folder}/genomes_permutations.txt")
        filters.multiplicity_histogram(b).write.mode("overwrite").json(f"{folder}/multiplicity")
        filters.sequence_coverage(b, seqs).write.mode("overwrite").json(f"{folder}/coverage")


def overlap(spark, a) -> None:
    fasta = tf.read_fasta(spark, a.fasta, upper=True, gaps=True)
    edges = overlap_graph(fasta, a.min, a.max)
    reports.write_lines(reports.dot_lines(edges), a.out)
    if overlap_rate(edges, fasta).first()["low"]:
        log.warning("few overlaps for so many contigs")


def check(spark, a) -> None:
    aln = tf.read_paf(spark, a.alignment) if a.alignment.endswith("paf") else tf.read_nucmer_coords(spark, a.alignment)
    aln = filters.filter_by_coverage(intervals.join_collinear(aln), 0.45)
    pos = intervals.dense_position(aln.select("ref", "qry", "ref_start", "ref_end"))
    size = aln.groupBy("ref").agg(F.max("ref_end").alias("chr_len"))
    strand = aln.groupBy("ref", "qry", "ref_start").agg(F.first("strand").alias("strand"))
    hits = pos.join(strand, ["ref", "qry", "ref_start"]).join(size, "ref").select(F.col("qry").alias("contig"), F.col("ref").alias("chr"), "position", "strand", F.col("ref_start").alias("start"), "chr_len")
    per = verify.verify_order(tf.read_order(spark, a.order), hits).persist()
    per.orderBy("scf").show(1000, truncate=False)
    verify.report_totals(per).show(truncate=False)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="synframe")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scaffold", help="order a target's contigs by related genomes")
    s.add_argument("recipe")
    s.add_argument("-o", "--out", default="synframe-out")
    s.add_argument("--coords", help="block files with {size} in their path; else the recipe's alignment, else the genomes' sequences are used")
    s.add_argument("--refine", action="store_true", help="refine by the overlap graph of the contigs")
    s.add_argument("--repeats", action="store_true", help="resolve repeats")
    s.add_argument("--solid-scaffolds", action="store_true", help="do not break input sequences")
    s.add_argument("--debug", action="store_true", help="write the graphs and contigs of every stage, and the tree")
    s.add_argument("--overwrite", action="store_true", help="do not reuse blocks of an earlier run")
    s.set_defaults(run=scaffold)
    s = sub.add_parser("synteny", help="alignment (MAF, GFF) to synteny blocks of several sizes")
    s.add_argument("alignment")
    s.add_argument("-o", "--out", default="synframe-blocks")
    s.add_argument("-b", "--blocks", default="5000,500,100")
    s.add_argument("-s", "--params", help="file of (minimum block, maximum gap) passes")
    s.set_defaults(run=synteny)
    s = sub.add_parser("overlap", help="overlap graph of contigs")
    s.add_argument("fasta")
    s.add_argument("out")
    s.add_argument("--min", type=int, default=33)
    s.add_argument("--max", type=int, default=200)
    s.set_defaults(run=overlap)
    s = sub.add_parser("verify", help="order of scaffolds against alignments")
    s.add_argument("alignment")
    s.add_argument("order")
    s.set_defaults(run=check)
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    spark = SparkSession.builder.appName(f"synframe {a.command}").getOrCreate()
    try:
        a.run(spark, a)
    except (rc.RecipeError, tf.FormatError, OSError) as e:
        log.error("%s", e)
        return 1
    finally:
        clean(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())

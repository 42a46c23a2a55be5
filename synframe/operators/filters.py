"""Filters and predicates over block rows and alignments (survey C1-C16, E1-E3, E16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEQ = ("genome", "chr")
MIN_COVERAGE = 0.6
MIN_OVERLAP_RATE = 0.5


def tag_genomes(blocks: DataFrame, genomes: DataFrame) -> DataFrame:
    """Rows of known genomes with ``is_target`` and ``draft``. ``genomes``: (genome, is_target, draft), one row per recipe entry."""
    return blocks.join(F.broadcast(genomes), "genome")


def missing_genomes(blocks: DataFrame, genomes: DataFrame) -> DataFrame:
    """C1 check: recipe genomes without a single row (an error for the caller)."""
    return genomes.join(blocks.select("genome").distinct(), "genome", "left_anti")


def block_counts(blocks: DataFrame, target: str) -> DataFrame:
    return blocks.groupBy("block_id").agg(
        F.count("*").alias("copies"),
        F.max((F.col("genome") == target).cast("int")).alias("in_target"),
        F.max((F.col("genome") != target).cast("int")).alias("in_reference"),
    )


def filter_indels(blocks: DataFrame, target: str, n_genomes: int, allow_ref_indels: bool) -> DataFrame:
    """Blocks of the target and any reference, or blocks with at least as many copies as there are genomes."""
    c = block_counts(blocks, target)
    keep = c.filter("in_target = 1 and in_reference = 1") if allow_ref_indels else c.filter(F.col("copies") >= n_genomes)
    return blocks.join(keep.select("block_id"), "block_id", "left_semi")


def repeat_blocks(blocks: DataFrame) -> DataFrame:
    """Ids with two or more copies in one genome."""
    return blocks.groupBy("genome", "block_id").count().filter("count > 1").select("block_id").distinct()


def without_blocks(blocks: DataFrame, ids: DataFrame, inverse: bool = False) -> DataFrame:
    """Drop (or keep only) the rows of given ids; emptied sequences vanish with their rows."""
    return blocks.join(ids, "block_id", "left_semi" if inverse else "left_anti")


def clean_blocks(blocks: DataFrame, target: str, n_genomes: int, allow_ref_indels: bool) -> DataFrame:
    """The unique, shared blocks that graphs are built from."""
    kept = filter_indels(blocks, target, n_genomes, allow_ref_indels)
    return without_blocks(kept, repeat_blocks(kept))


def filter_by_size(blocks: DataFrame, min_block: int, require_all: bool = True) -> DataFrame:
    """C4: a block id stays if all (or any) of its instances reach ``min_block``."""
    size = F.col("bend") - F.col("bstart")
    keep = blocks.groupBy("block_id").agg((F.min(size) if require_all else F.max(size)).alias("s")).filter(F.col("s") >= min_block)
    return blocks.join(keep.select("block_id"), "block_id", "left_semi")


def genome_coverage(blocks: DataFrame, seqs: DataFrame) -> DataFrame:
    """Covered share of every genome; ``low`` warns below the threshold."""
    per = blocks.groupBy(*SEQ).agg(F.sum(F.col("bend") - F.col("bstart")).alias("covered"))
    g = per.join(seqs, list(SEQ)).groupBy("genome").agg(F.sum("covered").alias("covered"), F.sum("seq_len").alias("total"))
    share = F.round(F.col("covered") / F.col("total"), 9)
    return g.select("genome", "covered", "total", share.alias("coverage"), (share < MIN_COVERAGE).alias("low"))


def sequence_coverage(blocks: DataFrame, seqs: DataFrame) -> DataFrame:
    """Covered percentage of every sequence."""
    per = blocks.groupBy(*SEQ).agg(F.sum(F.col("bend") - F.col("bstart")).alias("covered"))
    return per.join(seqs, list(SEQ)).select(*SEQ, F.round(100 * F.col("covered") / F.col("seq_len"), 6).alias("percent"))


def multiplicity_histogram(blocks: DataFrame) -> DataFrame:
    """How many blocks have how many copies."""
    return blocks.groupBy("block_id").agg(F.count("*").alias("multiplicity")).groupBy("multiplicity").agg(F.count("*").alias("n_blocks"))


def sequence_uniqueness(blocks: DataFrame, repeats: DataFrame) -> DataFrame:
    """Per sequence, is it purely repetitive, and has it any unique block?"""
    r = blocks.join(repeats.select("block_id", F.lit(1).alias("_r")), "block_id", "left")
    return r.groupBy(*SEQ).agg(F.min(F.col("_r").isNotNull().cast("int")).cast("boolean").alias("all_repeats"), F.max(F.col("_r").isNull().cast("int")).cast("boolean").alias("has_unique"))


def unique_contigs(aln: DataFrame) -> DataFrame:
    """Alignments of queries that have exactly one."""
    once = aln.groupBy("qry").count().filter("count = 1")
    return aln.join(once.select("qry"), "qry", "left_semi")


def long_contigs(aln: DataFrame, least: int) -> DataFrame:
    """Queries whose reference span reaches ``least``."""
    return aln.groupBy("qry").agg((F.max("ref_end") - F.min("ref_start")).alias("span")).filter(F.col("span") >= least)


def filter_by_coverage(aln: DataFrame, share: float) -> DataFrame:
    """Alignments longer than ``share`` of the query's longest."""
    w = Window.partitionBy("qry")
    size = F.col("qry_end") - F.col("qry_start")
    return aln.withColumn("_m", F.max(size).over(w)).filter(size > share * F.col("_m")).drop("_m")


def filter_by_length(aln: DataFrame, least: int) -> DataFrame:
    """Both sides longer than ``least``."""
    return aln.filter((F.col("ref_end") - F.col("ref_start") > least) & (F.col("qry_end") - F.col("qry_start") > least))


def filter_intersecting(rows: DataFrame, bucket: int = 10_000) -> DataFrame:
    """Of two rows (id, seq, s, e) of a sequence, ordered by (s, e, id), whose second starts inside the first:
    the second goes, and the first too unless the second is nested in it. Rows meet in buckets of coordinates."""
    spans = rows.select("id", "seq", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor((F.col("e") - 1) / bucket))).alias("b"))
    starts = rows.select(F.col("id").alias("id2"), "seq", F.col("s").alias("s2"), F.col("e").alias("e2"), F.floor(F.col("s") / bucket).alias("b"))
    hit = spans.join(starts, ["seq", "b"]).filter("(s2 > s or s2 = s and (e2 > e or e2 = e and id2 > id)) and s <= s2 and s2 < e")
    # an id may stand in several sequences: what goes is a row, not an id
    second, first = F.struct(F.col("id2").alias("id"), F.col("s2").alias("s"), F.col("e2").alias("e")), F.struct("id", "s", "e")
    gone = hit.select("seq", F.inline(F.filter(F.array(second, F.when(F.col("e2") > F.col("e"), first)), lambda x: x.isNotNull()))).distinct()
    return rows.join(gone, ["id", "seq", "s", "e"], "left_anti").select(*rows.columns)


def alignment_hits(queries: DataFrame, aln: DataFrame) -> DataFrame:
    """Queries with no hit or with several."""
    n = aln.groupBy("qry").agg(F.count("*").alias("hits"))
    return queries.join(n, "qry", "left").select("qry", F.coalesce("hits", F.lit(0)).alias("hits")).filter("hits <> 1")

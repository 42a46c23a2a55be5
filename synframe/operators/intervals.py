"""Interval and order operators over contigs, fragments and alignments (survey D4, F6-F15, E8-E10, B10, J13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synframe.runtime import Written, shuffle_partitions

MIN_GAP = 11


def containment(contigs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Each contig (scf, idx, chr, s, e, sign, gap) becomes its fragments (chr, fs, fe) whose start lies in [s, e),
    in the direction of the scaffold; inner gaps are distances between fragments, the last keeps the contig's gap."""
    j = contigs.join(fragments, "chr").filter("s <= fs and fs < e")
    w = Window.partitionBy("scf", "idx").orderBy(F.when(F.col("sign") > 0, F.col("fs")).otherwise(-F.col("fs")))
    nxt = F.lead(F.struct("fs", "fe")).over(w)
    j = j.withColumn("n", F.row_number().over(w)).withColumn("_x", nxt)
    gap = F.when(F.col("_x").isNull(), F.col("gap")).when(F.col("sign") > 0, F.col("_x.fs") - F.col("fe")).otherwise(F.col("fs") - F.col("_x.fe"))
    return j.select("scf", "idx", "n", "chr", "fs", "fe", "sign", gap.alias("gap"), F.col("_x").isNotNull().alias("inner"))


def cut_fragments(blocks: DataFrame, seqs: DataFrame, cuts: DataFrame) -> DataFrame:
    """sequences cut at positions (genome, chr, cut): a block belongs to the fragment that holds its start; its
    coordinates are re-based and a block over a cut is clipped at it."""
    key = ["genome", "chr"]
    c = cuts.distinct().groupBy(*key).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    b = blocks.join(seqs, key).join(c, key, "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))
    lo = F.coalesce(F.array_max(F.filter("cuts", lambda x: x <= F.col("bstart"))), F.lit(0))
    hi = F.coalesce(F.array_min(F.filter("cuts", lambda x: x > F.col("bstart"))), F.col("seq_len"))
    b = b.withColumn("frag_start", lo.cast("long")).withColumn("frag_end", hi.cast("long"))
    return b.select(*key, "frag_start", "frag_end", "block_id", "sign", (F.col("bstart") - F.col("frag_start")).alias("bstart"), (F.least("bend", "frag_end") - F.col("frag_start")).alias("bend"))


def merge_consecutive(contigs: DataFrame) -> DataFrame:
    """F8: runs of contigs of a scaffold that touch on one sequence in one direction become one contig."""
    w = Window.partitionBy("scf").orderBy("idx")
    prev = F.lag(F.struct("chr", "s", "e", "sign")).over(w)
    c = contigs.withColumn("_p", prev)
    touch = F.when(F.col("sign") > 0, F.col("_p.e") == F.col("s")).otherwise(F.col("e") == F.col("_p.s"))
    same = F.coalesce((F.col("_p.chr") == F.col("chr")) & (F.col("_p.sign") == F.col("sign")) & touch, F.lit(False))
    c = c.withColumn("_i", F.sum((~same).cast("int")).over(w))
    out = c.groupBy("scf", "_i").agg(F.min("idx").alias("idx"), F.first("chr").alias("chr"), F.min("s").alias("s"), F.max("e").alias("e"), F.first("sign").alias("sign"), F.max_by("gap", "idx").alias("gap"))
    return out.select("scf", "idx", "chr", "s", "e", "sign", "gap")


def join_collinear(aln: DataFrame) -> DataFrame:
    """runs of neighbouring alignments on a reference with the same query and strand become one."""
    w = Window.partitionBy("ref").orderBy("ref_start", "ref_end", "qry", "qry_start")
    same = F.coalesce((F.lag("qry").over(w) == F.col("qry")) & (F.lag("strand").over(w) == F.col("strand")), F.lit(False))
    a = aln.withColumn("_new", (~same).cast("int")).withColumn("_i", F.sum("_new").over(w))
    return a.groupBy("ref", "_i").agg(F.first("qry").alias("qry"), F.first("strand").alias("strand"), F.min("ref_start").alias("ref_start"), F.max("ref_end").alias("ref_end"), F.min("qry_start").alias("qry_start"), F.max("qry_end").alias("qry_end")).drop("_i")


def counts_before(per: DataFrame, order: list[str], n: str) -> DataFrame:
    """``per`` with ``before``, the sum of ``n`` over all rows that come before in that order. Rows are dealt to ranges; sums run within a range
    and over one row for each range, so no window spans the table."""
    p = Written(per.sparkSession, "ranges").cut(per.repartitionByRange(shuffle_partitions(per.sparkSession), *order).withColumn("_p", F.spark_partition_id()))
    up = lambda w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = p.groupBy("_p").agg(F.sum(n).alias(n)).select("_p", up(Window.orderBy("_p")).alias("_b"))
    own = p.withColumn("_w", up(Window.partitionBy("_p").orderBy(*order)))
    return own.join(F.broadcast(base), "_p").withColumn("before", F.col("_b") + F.col("_w")).drop("_p", "_b", "_w")  # a row for each partition


def dense_position(aln: DataFrame) -> DataFrame:
    """Index of every alignment along the reference: it rises when the start does and is not reset between
    sequences (in name order). Counts of the sequences before are added, so no window spans more than a sequence."""
    w = Window.partitionBy("ref").orderBy("ref_start", "qry", "ref_end")
    up = F.coalesce((F.col("ref_start") > F.lag("ref_start").over(w)).cast("int"), F.lit(0))
    a = aln.withColumn("_up", up).withColumn("_k", F.sum("_up").over(w))
    per = a.groupBy("ref").agg((F.max("_k") + 1).alias("_n"))
    before = counts_before(per, ["ref"], "_n")
    return a.join(before, "ref").select("ref", "qry", "ref_start", "ref_end", (F.col("_k") + F.col("before")).alias("position"))


def alignment_extents(aln: DataFrame) -> DataFrame:
    """Length of every query and reference as seen in the alignments."""
    q = aln.groupBy(F.col("qry").alias("name")).agg(F.max("qry_end").alias("size")).withColumn("kind", F.lit("query"))
    r = aln.groupBy(F.col("ref").alias("name")).agg(F.max("ref_end").alias("size")).withColumn("kind", F.lit("reference"))
    return q.unionByName(r)


def range_complement(used: DataFrame, seqs: DataFrame) -> DataFrame:
    """parts of every sequence (chr, seq_len) not covered by the ranges (chr, s, e), by the previous range's end only."""
    s = seqs.select("chr", "seq_len")
    rows = used.select("chr", "s", "e").join(s.select("chr"), "chr", "left_semi")
    rows = rows.unionByName(s.select("chr", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e"))).unionByName(s.select("chr", F.col("seq_len").alias("s"), F.col("seq_len").alias("e")))
    w = Window.partitionBy("chr").orderBy("s", "e")
    r = rows.withColumn("_n", F.lead("s").over(w)).filter("e < _n").join(s, "chr")
    name = F.when((F.col("e") == 0) & (F.col("_n") == F.col("seq_len")), F.col("chr")).otherwise(F.format_string("%s[%d:%d]", "chr", "e", "_n"))
    return r.select("chr", F.col("e").alias("s"), F.col("_n").alias("e"), name.alias("name"))


def scaffold_positions(contigs: DataFrame) -> DataFrame:
    """Start of every contig in its scaffold = lengths and gaps of those before it."""
    w = Window.partitionBy("scf").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("e") - F.col("s")
    return contigs.withColumn("length", size).withColumn("start", F.coalesce(F.sum(size + F.col("gap")).over(w), F.lit(0)))


def agp_rows(contigs: DataFrame) -> DataFrame:
    """AGP 2.0 rows: W for a contig (1-based, number 2i + 1), N for a gap above 0 (number 2i + 2)."""
    p = scaffold_positions(contigs).withColumn("_i", F.row_number().over(Window.partitionBy("scf").orderBy("idx")) - 1)
    w = p.select("scf", (F.col("start") + 1).alias("from_"), (F.col("start") + F.col("length")).alias("to_"), (2 * F.col("_i") + 1).alias("part"), F.lit("W").alias("kind"), F.col("chr").alias("component"), F.col("length").alias("size"), F.when(F.col("sign") > 0, "+").otherwise("-").alias("strand"))
    n = p.filter("gap > 0").select("scf", (F.col("start") + F.col("length") + 1).alias("from_"), (F.col("start") + F.col("length") + F.col("gap")).alias("to_"), (2 * F.col("_i") + 2).alias("part"), F.lit("N").alias("kind"), F.lit("scaffold").alias("component"), F.col("gap").alias("size"), F.lit("").alias("strand"))
    return w.unionByName(n)


def update_gaps(contigs: DataFrame) -> DataFrame:
    """the link's gap minus what lies between the outer blocks and the contig ends on both sides."""
    w = Window.partitionBy("scf").orderBy("idx")
    nxt = F.lead("left_gap").over(w)
    return contigs.withColumn("gap", F.when(nxt.isNull(), F.col("gap")).otherwise(F.col("gap") - F.col("right_gap") - nxt))


def _n_tail(seq: Column) -> Column:
    """Number of trailing Ns that a scan finds which leaves one character."""
    inner = F.substring(seq, F.lit(2), F.length(seq) - 1)
    return F.length(inner) - F.length(F.regexp_replace(inner, "[Nn]+$", ""))


def fix_gaps(contigs: DataFrame) -> DataFrame:
    """contigs (scf, idx, seq, gap, assembly). Overlap links trim the left contig and close; other links take the
    Ns at both sides into the gap, which is ``MIN_GAP`` at least."""
    w = Window.partitionBy("scf").orderBy("idx")
    nxt = F.lead("seq").over(w)
    right = _n_tail(F.col("seq"))
    left_next = _n_tail(F.reverse(nxt))
    last = nxt.isNull()
    c = contigs.withColumn("_nl", left_next).withColumn("_last", last)
    trim = F.when(F.col("_last"), 0).when(F.col("assembly"), F.greatest(F.lit(0), -F.col("gap"))).otherwise(right)
    gap = F.when(F.col("_last"), F.col("gap")).when(F.col("assembly"), F.greatest(F.lit(0), F.col("gap"))).otherwise(F.greatest(F.col("gap") + right + F.col("_nl"), F.lit(MIN_GAP)))
    c = c.withColumn("trim_right", trim.cast("long")).withColumn("gap", gap.cast("long"))
    take = F.when(F.col("_last") | F.col("assembly"), 0).otherwise(F.col("_nl"))
    c = c.withColumn("_t", take)
    return c.withColumn("trim_left", F.coalesce(F.lag("_t").over(w), F.lit(0)).cast("long")).select("scf", "idx", "trim_left", "trim_right", "gap")


def n50(lengths: DataFrame) -> DataFrame:
    """First length, in falling order, at which the running sum exceeds half of the total (integer division).

    The running sum goes over classes of 65,536 lengths, and then over the distinct lengths of the class that it ends in."""
    size = F.col("size").cast("long")
    down = lambda c: Window.orderBy(F.col(c).desc()).rowsBetween(Window.unboundedPreceding, 0)
    big = lengths.groupBy(F.shiftright(size, 16).alias("b")).agg(F.sum(size).alias("mass"))
    total = big.agg(F.sum("mass").alias("total"))
    run = big.withColumn("run", F.sum("mass").over(down("b"))).crossJoin(F.broadcast(total)).filter(F.col("run") > F.floor(F.col("total") / 2))
    at = run.agg(F.max_by(F.struct("b", (F.col("run") - F.col("mass")).alias("above"), "total"), "b").alias("at")).select("at.*")
    h = lengths.select(size.alias("size")).join(F.broadcast(at), F.shiftright("size", 16) == F.col("b")).groupBy("size", "above", "total").agg(F.sum("size").alias("mass"))
    h = h.withColumn("run", F.col("above") + F.sum("mass").over(down("size")))
    return h.filter(F.col("run") > F.floor(F.col("total") / 2)).agg(F.max("size").alias("n50"), F.max("total").alias("total"))


def assembly_statistics(contigs: DataFrame) -> DataFrame:
    """One row of counts, lengths and shares."""
    p = contigs.withColumn("length", F.col("e") - F.col("s"))
    g = F.greatest("gap", F.lit(0))
    return p.agg(
        F.countDistinct("scf").alias("scaffolds"),
        F.count("*").alias("contigs"),
        F.sum("length").alias("contig_length"),
        F.sum(F.when(F.col("gap") > 0, 1).otherwise(0)).alias("gaps"),
        F.sum(g).alias("gap_length"),
        F.round(100 * F.sum(g) / F.sum(g + F.col("length")), 6).alias("gap_percent"),
    )


def name_votes(blocks: DataFrame, reference: DataFrame) -> DataFrame:
    """Per scaffold, votes of the naming reference's sequences, the name made of those above a tenth, and the number
    of blocks that agree in sign. ``blocks``: (scf, block_id, sign); ``reference``: (block_id, ref_chr, ref_sign)."""
    j = blocks.join(reference, "block_id")
    v = j.groupBy("scf", "ref_chr").agg(F.count("*").alias("votes"), F.sum((F.col("sign") == F.col("ref_sign")).cast("long")).alias("agree"))
    t = v.groupBy("scf").agg(F.sum("votes").alias("total"), F.sum("agree").alias("agree"), F.collect_list(F.struct((-F.col("votes")).alias("v"), "ref_chr")).alias("vs"))
    kept = F.filter(F.array_sort("vs"), lambda x: -x["v"] * 10 > F.col("total"))
    return t.select("scf", F.concat(F.lit("chr_"), F.array_join(F.transform(kept, lambda x: x["ref_chr"]), "_")).alias("name"), "total", "agree", (F.col("agree") < F.floor(F.col("total") / 2)).alias("flip"))


def suffix_names(scaffolds: DataFrame) -> DataFrame:
    """of the scaffolds (scf, name, contigs) of one name the largest keeps it, the others are unlocalized and numbered if several."""
    w = Window.partitionBy("name")
    o = w.orderBy(F.col("contigs").desc(), "scf")
    k, n = F.row_number().over(o), F.count("*").over(w)
    s = scaffolds.withColumn("_k", k).withColumn("_n", n)
    tail = F.when(F.col("_k") == 1, "").when(F.col("_n") == 2, "_unlocalized").otherwise(F.format_string("_unlocalized.%d", F.col("_k") - 1))
    return s.select("scf", F.concat("name", tail).alias("name"), "contigs")


def flip_scaffolds(contigs: DataFrame, flips: DataFrame) -> DataFrame:
    """Reverse the scaffolds (scf) of ``flips``: order and signs turn, each link moves to the previous contig, the last is cleared."""
    f = contigs.join(flips.select("scf", F.lit(1).alias("_f")), "scf", "left")
    w = Window.partitionBy("scf").orderBy("idx")
    n = F.count("*").over(Window.partitionBy("scf"))
    f = f.withColumn("_g", F.coalesce(F.lag("gap").over(w), F.lit(0))).withColumn("_i", n - F.row_number().over(w))
    t = F.col("_f") == 1
    return f.select("scf", F.when(t, F.col("_i")).otherwise(F.row_number().over(w) - 1).cast("long").alias("idx"), "chr", "s", "e", F.when(t, -F.col("sign")).otherwise(F.col("sign")).alias("sign"), F.when(t, F.col("_g")).otherwise(F.col("gap")).alias("gap"))


def renumber(blocks: DataFrame) -> DataFrame:
    """F16: dense ids by first appearance (genome, chr, start); the first instance becomes positive."""
    key = F.struct("genome", "chr", "bstart", "block_id")
    first = blocks.groupBy("block_id").agg(F.min(key).alias("k"), F.min_by("sign", key).alias("fs"))
    # ranks from counts per sequence plus the rank inside it: no window over all blocks
    first = first.select("block_id", "k", "fs", F.col("k.genome").alias("g"), F.col("k.chr").alias("c"))
    inner = first.withColumn("r", F.row_number().over(Window.partitionBy("g", "c").orderBy("k")))
    per = first.groupBy("g", "c").agg(F.count("*").alias("n"))
    ids = inner.join(counts_before(per, ["g", "c"], "n"), ["g", "c"]).select("block_id", (F.col("r") + F.col("before")).alias("new_id"), "fs")
    return blocks.join(ids, "block_id").select("genome", "chr", F.col("new_id").alias("block_id"), (F.col("sign") * F.col("fs")).alias("sign"), "bstart", "bend")

"""Readers of sequence, block, alignment, graph and order files (survey A2-A15, A20-A23).

Record formats are read with the record's own separator, so that a record is one row wherever the file is split;
nothing depends on the order of rows. Row schemas are in each docstring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from synframe.functions.sequence import gap_rate, is_nucleotide, maf_start, reverse_complement_acgt

MAX_GAP_RATE = 0.3


class FormatError(ValueError):
    """A file does not have the form its reader needs."""


def _refuse(bad: DataFrame, what: str) -> None:
    row = bad.limit(1).collect()
    if row:
        raise FormatError(f"{what}: {row[0][0]}")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"))


def _order(number: Column | None = None) -> Column:
    """Order of records over all files of a path: file, start of the split, place in the split."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), number if number is not None else F.monotonically_increasing_id())


def read_fasta(spark: SparkSession, path: str, validate: bool = True, upper: bool = False, gaps: bool = False) -> DataFrame:
    """``(name, seq)``; name = first token of the header. Of records with one name the last one wins."""
    rec = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^>|\r", "").alias("r"), _order().alias("at")).filter(F.trim("r") != "")
    out = rec.select("at", F.regexp_extract("r", r"^\s*(\S*)", 1).alias("name"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s+", "").alias("seq"))
    if upper:
        out = out.withColumn("seq", F.upper("seq"))
    if validate:
        _refuse(out.filter((F.col("name") == "") | (F.col("seq") == "")).select(F.coalesce("name", F.lit(""))), "empty header or sequence")
        _refuse(out.filter(~is_nucleotide(F.col("seq"), gaps)).select("name"), "not a nucleotide sequence")
    return out.groupBy("name").agg(F.max_by("seq", "at").alias("seq"))


def with_complements(fasta: DataFrame) -> DataFrame:
    """A3: rows ``+name`` and ``-name`` (reverse complement) of every sequence."""
    both = F.array(F.struct(F.concat(F.lit("+"), "name").alias("name"), F.col("seq").alias("seq")), F.struct(F.concat(F.lit("-"), "name").alias("name"), reverse_complement_acgt(F.col("seq")).alias("seq")))
    return fasta.select(F.inline(both))


def fragments(fasta: DataFrame, parts: DataFrame) -> DataFrame:
    """Substrings ``name[s:e]`` of sequences."""
    return fasta.join(parts, "name").select(F.format_string("%s[%d:%d]", "name", "s", "e").alias("name"), F.expr("substring(seq, int(s) + 1, int(e - s))").alias("seq"))


def read_blocks_coords(spark: SparkSession, path: str) -> DataFrame:
    """A4: ``(genome, chr, seq_len, block_id, sign, bstart, bend)``. Rows of sign - list their end first."""
    sec = spark.read.text(path, lineSep="Block #")
    # the table of sequences may go on in the next file of a path; rows of blocks have a strand where it has a size
    head = sec.select(F.explode(F.split("value", "\n")).alias("l")).filter(F.col("l").rlike(r"^\d+\t\d+\t"))
    p = F.split("l", "\t")
    name = F.trim(p[2])
    head = head.select(p[0].cast("long").alias("seq_id"), p[1].cast("long").alias("seq_len"), F.substring_index(name, ".", 1).alias("genome"), F.regexp_extract(name, r"^[^.]*\.(.*)$", 1).alias("chr"))
    rows = sec.filter(F.col("value").rlike(r"^\d+")).select(F.regexp_extract("value", r"^(\d+)", 1).cast("long").alias("block_id"), F.explode(F.split("value", "\n")).alias("l")).filter(F.col("l").rlike(r"^\d+\t[+-]\t"))
    r = rows.select("block_id", p[0].cast("long").alias("seq_id"), F.when(p[1] == "-", -1).otherwise(1).alias("sign"), p[2].cast("long").alias("x"), p[3].cast("long").alias("y"))
    r = r.select("block_id", "seq_id", "sign", F.when(F.col("sign") > 0, F.col("x")).otherwise(F.col("y")).alias("bstart"), F.when(F.col("sign") > 0, F.col("y")).otherwise(F.col("x")).alias("bend"))
    _refuse(r.filter("bend < bstart").select("block_id"), "block ends before it starts")
    return r.join(head, "seq_id").select("genome", "chr", "seq_len", "block_id", "sign", "bstart", "bend")


def read_maf(spark: SparkSession, path: str, min_len: int) -> DataFrame:
    """Block rows of an alignment: long rows with few gaps, of alignments that keep two sequences or more; ids are dense, in file
    order. An alignment starts at each line that starts with ``a``; blank lines mean nothing."""
    rec = spark.read.text(path, lineSep="\na").select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("o"), F.monotonically_increasing_id().alias("n"))
    s = rec.select("f", "o", "n", F.explode(F.split("value", "\r?\n")).alias("l")).filter(F.col("l").rlike(r"^s\s"))
    p = F.split(F.trim("l"), r"\s+")
    bare = F.regexp_replace(p[1], r"^[^.]*\.", "")
    name = F.when(bare.startswith("gi") & ~p[1].endswith("|"), F.concat(p[1], F.lit("|"))).otherwise(p[1])
    r = s.select("f", "o", "n", name.alias("name"), p[2].cast("long").alias("start"), p[3].cast("long").alias("size"), p[4].alias("strand"), p[5].cast("long").alias("seq_len"), p[6].alias("text"))
    r = r.filter((F.col("size") >= min_len) & (gap_rate(F.col("text")) < MAX_GAP_RATE))
    ok = r.groupBy("f", "o", "n").agg(F.countDistinct("name").alias("k")).filter("k > 1")
    # dense ids from counts per split of the files: no window over all alignments
    before = F.sum("c").over(Window.orderBy("f", "o").rowsBetween(Window.unboundedPreceding, -1))
    base = ok.groupBy("f", "o").agg(F.count("*").alias("c")).withColumn("b", F.coalesce(before, F.lit(0)))
    ids = ok.withColumn("r", F.row_number().over(Window.partitionBy("f", "o").orderBy("n"))).join(base.select("f", "o", "b"), ["f", "o"]).select("f", "o", "n", (F.col("r") + F.col("b")).cast("long").alias("block_id"))
    b = maf_start(F.col("strand"), F.col("start"), F.col("size"), F.col("seq_len"))
    return r.join(ids, ["f", "o", "n"]).select(F.substring_index("name", ".", 1).alias("genome"), F.regexp_extract("name", r"^[^.]*\.(.*)$", 1).alias("chr"), "seq_len", "block_id", F.when(F.col("strand") == "-", -1).otherwise(1).alias("sign"), b.alias("bstart"), (b + F.col("size")).alias("bend"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Block rows from features with an ``id=`` attribute; a sequence is as long as its last feature."""
    p = F.split("line", "\t")
    r = _lines(spark, path).filter(~F.col("line").startswith("#") & (F.size(p) >= 9))
    r = r.select(p[0].alias("name"), (p[3].cast("long") - 1).alias("bstart"), p[4].cast("long").alias("bend"), F.when(p[6] == "-", -1).otherwise(1).alias("sign"), F.expr("try_cast(regexp_extract(split(line, '\t')[8], '(?i)(?:^|;)\\\\s*id=(\\\\d+)', 1) as bigint)").alias("block_id"))
    _refuse(r.filter("coalesce(block_id, 0) = 0").select("name"), "feature without a block id")
    size = F.max("bend").over(Window.partitionBy("name"))
    return r.select(F.substring_index("name", ".", 1).alias("genome"), F.regexp_extract("name", r"^[^.]*\.?(.*)$", 1).alias("chr"), size.alias("seq_len"), "block_id", "sign", "bstart", "bend")


def read_overlap_dot(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst, size)`` edges; an edge that occurs twice is an error."""
    pat = r'^\s*"([^"]+)"\s*->\s*"([^"]+)"\s*\[label\s*=\s*"(\d+)"'
    out = _lines(spark, path).filter(F.col("line").rlike(pat)).select(F.regexp_extract("line", pat, 1).alias("src"), F.regexp_extract("line", pat, 2).alias("dst"), F.regexp_extract("line", pat, 3).cast("int").alias("size"))
    _refuse(out.groupBy("src", "dst").count().filter("count > 1").select("src"), "edge given twice")
    return out


def _strand(s: Column, e: Column) -> Column:
    return F.when(e > s, 1).otherwise(-1)


def read_nucmer_coords(spark: SparkSession, path: str) -> DataFrame:
    """A10: ``(ref, qry, strand, ref_start, ref_end, qry_start, qry_end)``; references are named chr1.. by first place on the list of names."""
    p = F.split(F.trim("line"), r"\s*\|\s*")
    num = lambda i, k: F.split(p[i], r"\s+")[k].cast("long")
    names = F.split(F.element_at(p, -1), r"\s+")
    at = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"), _order().alias("n"))
    r = at.filter(F.col("line").rlike(r"^\s*\d+\s+\d+\s*\|")).select(num(0, 0).alias("a"), num(0, 1).alias("b"), num(1, 0).alias("c"), num(1, 1).alias("d"), names[0].alias("r"), names[1].alias("qry"), F.col("n"))
    first = r.groupBy("r").agg(F.min("n").alias("n"))
    alias = first.select("r", F.concat(F.lit("chr"), F.row_number().over(Window.orderBy("n"))).alias("ref"))
    return r.join(alias, "r").select("ref", "qry", _strand(F.col("a"), F.col("b")).alias("ref_strand"), _strand(F.col("c"), F.col("d")).alias("strand"), F.least("a", "b").alias("ref_start"), F.greatest("a", "b").alias("ref_end"), F.least("c", "d").alias("qry_start"), F.greatest("c", "d").alias("qry_end"))


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a PAF file."""
    p = F.split("line", "\t")
    r = _lines(spark, path).filter(F.size(p) >= 9)
    return r.select(p[5].alias("ref"), p[0].alias("qry"), F.when(p[4] == "-", -1).otherwise(1).alias("strand"), p[7].cast("long").alias("ref_start"), p[8].cast("long").alias("ref_end"), p[2].cast("long").alias("qry_start"), p[3].cast("long").alias("qry_end"), p[1].cast("long").alias("qry_len"), p[6].cast("long").alias("ref_len"))


def read_pairwise_maf(spark: SparkSession, path: str) -> DataFrame:
    """Pairwise alignments; a reverse row [s, s + n) of a sequence of size L ends at L - 1 - s."""
    rec = spark.read.text(path, lineSep="\n\n")
    rows = F.filter(F.split("value", "\n"), lambda l: l.rlike(r"^s\s"))
    rec = rec.select(rows.alias("rows")).filter(F.size("rows") >= 2)

    def side(i):
        p = F.split(F.trim(F.col("rows")[i]), r"\s+")
        s, n, size = p[2].cast("long"), p[3].cast("long"), p[5].cast("long")
        rev = p[4] == "-"
        return p[1], F.when(rev, size - 1 - s - n).otherwise(s), F.when(rev, size - 1 - s).otherwise(s + n), F.when(rev, -1).otherwise(1)

    r, q = side(0), side(1)
    return rec.select(r[0].alias("ref"), q[0].alias("qry"), r[3].alias("ref_strand"), q[3].alias("strand"), r[1].alias("ref_start"), r[2].alias("ref_end"), q[1].alias("qry_start"), q[2].alias("qry_end"))


def read_order(spark: SparkSession, path: str, strip_ranges: bool = True) -> DataFrame:
    """``(scf, idx, contig, sign)`` from links reports or ``.ord`` files: ``>scf`` (or a bare title line) and signed names. Files are
    read line by line: a line's title is the last one before it in its split of the file, else the last one of the splits before."""
    one = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\r$", "")).alias("line"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("o"), F.monotonically_increasing_id().alias("n"))
    head = F.when(F.col("line").startswith(">"), F.substring("line", 2, 1 << 20)).when(F.col("line").rlike(r"^[^+\-\s]\S*$") & ~F.col("line").startswith("sequence"), F.col("line"))
    w = Window.partitionBy("f", "o").orderBy("n")
    one = one.withColumn("own", F.last(head, ignorenulls=True).over(w))
    ends = one.groupBy("f", "o").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("n"))).alias("last"))
    ends = ends.withColumn("came", F.last("last", ignorenulls=True).over(Window.partitionBy("f").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)))
    rows = one.filter(F.col("line").rlike(r"^[+-][^-+\s]")).join(ends.select("f", "o", "came"), ["f", "o"])
    rows = rows.withColumn("name", F.split("line", r"\s+")[0]).withColumn("scf", F.coalesce("own", "came"))
    c = F.substring("name", 2, 1 << 20)
    c = F.regexp_replace(c, r"\[\d+:\d+\]$", "") if strip_ranges else c
    return rows.select("scf", (F.row_number().over(Window.partitionBy("f", "scf").orderBy("o", "n")) - 1).alias("idx"), c.alias("contig"), F.when(F.col("name").startswith("-"), -1).otherwise(1).alias("sign"))


def read_permutations(spark: SparkSession, path: str) -> DataFrame:
    """``(name, ord, signed_id)`` from ``>name`` and ``+1 -2 $`` lines."""
    rec = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^>|\r", "").alias("r")).filter(F.trim("r") != "")
    ids = F.filter(F.split(F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"[\n$]", " "), r"\s+"), lambda x: x.rlike(r"^[+-]?\d+$"))
    return rec.select(F.regexp_extract("r", r"^\s*(\S+)", 1).alias("name"), F.posexplode(ids).alias("ord", "x")).select("name", "ord", F.col("x").cast("long").alias("signed_id"))


def rename_sequences(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows (chr, ...) get the genome that owns the sequence; a sequence of two genomes is an error."""
    _refuse(owners.groupBy("chr").count().filter("count > 1").select("chr"), "sequence name used twice")
    return rows.join(owners.select("chr", "genome"), "chr")


def genome_scale(fasta: DataFrame, big: int = 500 * 1024 * 1024) -> str:
    """``small`` or ``large`` block preset by the genome's size."""
    size = fasta.agg(F.sum(F.length("seq"))).first()[0] or 0
    return "small" if size < big else "large"

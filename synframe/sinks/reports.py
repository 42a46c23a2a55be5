"""Text sinks (survey B1-B7, B10): each function returns rows (part, ord, line); ``write_lines`` stores them in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synframe.functions.sequence import reverse_complement, signed_name, wrap
from synframe.operators.intervals import agp_rows, scaffold_positions


def fasta_lines(fasta: DataFrame, width: int = 60) -> DataFrame:
    """B1: one row per record, wrapped."""
    return fasta.select(F.col("name").alias("part"), F.lit(0).alias("ord"), F.concat(F.lit(">"), "name", F.lit("\n"), wrap(F.col("seq"), width)).alias("line"))


def links_lines(contigs: DataFrame, support: str = "supporting") -> DataFrame:
    """B2: a padded table for each scaffold."""
    p = scaffold_positions(contigs).withColumn("name", signed_name(F.col("chr"), F.col("sign")))
    s = F.col(support) if support in contigs.columns else F.lit("")
    w = Window.partitionBy("scf")
    cols = [F.col("name"), F.col("start").cast("string"), F.col("length").cast("string"), F.col("gap").cast("string")]
    heads = ["sequence", "start", "length", "gap"]
    p = p.withColumn("_w", F.array(*[F.greatest(F.max(F.length(c)).over(w), F.lit(len(h))) for c, h in zip(cols, heads, strict=True)]))
    row = F.concat(*[F.concat(F.expr(f"rpad({x}, _w[{i}], ' ')"), F.lit("  ")) for i, x in enumerate(["name", "cast(start as string)", "cast(length as string)", "cast(gap as string)"])], s)
    body = p.select(F.col("scf").alias("part"), (F.col("idx") + 2).cast("int").alias("ord"), row.alias("line"))
    head = F.concat(*[F.concat(F.expr(f"rpad('{h}', w[{i}], ' ')"), F.lit("  ")) for i, h in enumerate(heads)], F.lit("support"))
    top = p.groupBy("scf").agg(F.first("_w").alias("w")).select(F.col("scf").alias("part"), F.lit(0).alias("ord"), F.concat("scf", F.lit("\n"), head).alias("line"))
    return top.unionByName(body)


def agp_lines(contigs: DataFrame) -> DataFrame:
    """B3."""
    w = F.concat_ws("\t", "scf", F.col("from_"), F.col("to_"), F.col("part"), "kind", "component", F.lit("1"), F.col("size"), "strand")
    n = F.concat_ws("\t", "scf", F.col("from_"), F.col("to_"), F.col("part"), "kind", F.col("size"), "component", F.lit("yes"), F.lit("align_genus"))
    return agp_rows(contigs).select(F.col("scf").alias("_p"), F.col("part").cast("int").alias("ord"), F.when(F.col("kind") == "W", w).otherwise(n).alias("line")).withColumnRenamed("_p", "part")


def permutation_lines(blocks: DataFrame) -> DataFrame:
    """``>genome.chr`` and signed ids up to $."""
    s = F.struct("bstart", "block_id", F.format_string("%+d", F.col("block_id") * F.col("sign")).alias("t"))
    g = blocks.groupBy("genome", "chr").agg(F.array_sort(F.collect_list(s)).alias("bs"))
    name = F.concat_ws(".", "genome", "chr")
    return g.select(name.alias("part"), F.lit(0).alias("ord"), F.concat(F.lit(">"), name, F.lit("\n"), F.array_join(F.transform("bs", lambda x: x["t"]), " "), F.lit(" $")).alias("line"))


def gene_order_lines(blocks: DataFrame) -> DataFrame:
    """``>genome`` and the permutations of its sequences, a line each, as gene-order tools read them."""
    p = permutation_lines(blocks)
    at = F.substring_index("part", ".", 1)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: F.substring_index(x["line"], "\n", -1)), "\n")
    return p.groupBy(at.alias("genome")).agg(body.alias("t")).select(F.col("genome").alias("part"), F.lit(0).alias("ord"), F.concat(F.lit(">"), "genome", F.lit("\n"), "t").alias("line"))


def graph_dot_lines(graph: DataFrame) -> DataFrame:
    """A breakpoint graph as an undirected graph with the genome and kind of each edge."""
    e = graph.select(F.lit("b").alias("part"), F.lit(0).alias("ord"), F.format_string('%d -- %d [genome="%s", infinity="%s"];', "a", "b", "genome", F.initcap(F.col("infinity").cast("string"))).alias("line"))
    one = graph.sparkSession.createDataFrame([("a", 0, "graph {"), ("c", 0, "}")], "part string, ord int, line string")
    return e.unionByName(one)


def coords_lines(blocks: DataFrame, seqs: DataFrame) -> DataFrame:
    """The block file: table of sequences, then a section for each block; - rows list their end first."""
    # numbers from counts per genome: no window over all sequences
    before = F.sum("n").over(Window.orderBy("genome").rowsBetween(Window.unboundedPreceding, -1))
    base = seqs.groupBy("genome").agg(F.count("*").alias("n")).select("genome", F.coalesce(before, F.lit(0)).alias("base"))
    ids = seqs.withColumn("r", F.row_number().over(Window.partitionBy("genome").orderBy("chr"))).join(base, "genome").withColumn("seq_id", (F.col("r") + F.col("base")).cast("int")).drop("r", "base")
    head = ids.select(F.lit("").alias("part"), F.col("seq_id").alias("ord"), F.concat_ws("\t", F.col("seq_id"), F.col("seq_len"), F.concat_ws(".", "genome", "chr")).alias("line"))
    top = ids.limit(1).select(F.lit("").alias("part"), F.lit(0).alias("ord"), F.lit("Seq_id\tSize\tDescription").alias("line"))
    rows = blocks.join(ids, ["genome", "chr"])
    plus = F.col("sign") > 0
    l = F.concat_ws("\t", F.col("seq_id"), F.when(plus, "+").otherwise("-"), F.when(plus, F.col("bstart")).otherwise(F.col("bend")), F.when(plus, F.col("bend")).otherwise(F.col("bstart")), F.col("bend") - F.col("bstart"))
    sec = rows.groupBy("block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_id", "bstart", l.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    dash = "-" * 80
    body = sec.select(F.lit("~").alias("part"), F.col("block_id").cast("int").alias("ord"), F.concat(F.lit(f"{dash}\nBlock #"), "block_id", F.lit("\nSeq_id\tStrand\tStart\tEnd\tLength\n"), "t").alias("line"))
    return top.unionByName(head).unionByName(body)


def dot_lines(edges: DataFrame) -> DataFrame:
    """A directed graph with labels from (src, dst, size)."""
    e = edges.select(F.lit("b").alias("part"), F.lit(0).alias("ord"), F.format_string('"%s" -> "%s" [label="%d"];', "src", "dst", "size").alias("line"))
    one = edges.sparkSession.createDataFrame([("a", 0, "digraph {"), ("c", 0, "}")], "part string, ord int, line string")
    return e.unionByName(one)


def scaffold_sequences(contigs: DataFrame, fasta: DataFrame) -> DataFrame:
    """``(name, seq)``: oriented contig slices joined by Ns."""
    j = contigs.join(fasta.select(F.col("name").alias("chr"), "seq"), "chr")
    part = F.expr("substring(seq, int(s) + 1, int(e - s))")
    part = F.when(F.col("sign") > 0, part).otherwise(reverse_complement(part))
    piece = F.concat(part, F.when(F.col("gap") > 0, F.repeat(F.lit("N"), F.col("gap").cast("int"))).otherwise(""))
    g = j.groupBy("scf").agg(F.array_sort(F.collect_list(F.struct("idx", piece.alias("p")))).alias("ps"))
    return g.select(F.col("scf").alias("name"), F.array_join(F.transform("ps", lambda x: x["p"]), "").alias("seq"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Range-partitioned and sorted, so that the part files are in order."""
    lines.repartitionByRange("part", "ord").sortWithinPartitions("part", "ord").select("line").write.mode("overwrite").text(path)

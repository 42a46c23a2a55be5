"""Synteny blocks from sequences alone (survey A16): a de Bruijn graph of all genomes' k-mers, contracted and simplified.

A node is a k-mer or its reverse complement, whichever is smaller; it has a left and a right side. Every two k-mers next to each other in a
sequence join two sides. A side is *simple* if all its occurrences lead to the same side of the same node and none is a sequence's end;
a join is contracted if both its sides are simple (and of two nodes). A contracted join holds in every occurrence of its nodes, so each
stretch of contracted joins in a sequence is a whole path of the graph, and equal paths are found without searching the
graph: a path is named by its smallest node. Paths that occur at least twice are blocks.

Sequences are cut into pieces; a stretch that crosses pieces is put together from its parts. All steps are aggregations, equi-joins and
windows over pieces. K-mers are many times the sequences, so little of them moves: a node with its letters, then a node and its place, then a
place and whether its sides are simple, beside the piece, from which its nodes are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from synframe.functions.sequence import reverse_complement_acgt
from synframe.operators.kmers import CODED, PACKED, PIECE, canonical, kmer, packed_steps, packed_walk, pieces, stretches
from synframe.operators.simplify import multi_scale
from synframe.runtime import Written, bound_text_batches, lean, release, shuffle_partitions

#: Passes (smallest block, largest gap) after contraction.
PASSES = [(30, 150), (100, 500), (500, 1500)]
#: Rounds in which places are looked up, and the pieces that a round has at least.
PARTS, ROUND = 2, 500

WALK = [StructField("pos", LongType()), StructField("node", LongType()), StructField("sign", IntegerType()), StructField("right", LongType()), StructField("left_end", BooleanType())]


def kmer_walk(seqs: DataFrame, k: int, piece: int = PIECE) -> DataFrame:
    """``(genome, chr, pos, node, sign, right, left_end)`` of every k-mer of ``seqs`` (genome, chr, seq): the side that follows
    (null at an end) and whether nothing precedes it. Nodes are packed in longs up to k = 31, else k-mers; a side is made by ``_side``."""
    if k % 2 == 0:
        raise ValueError("k must be odd: a k-mer of even length can be its own reverse complement")
    p = pieces(seqs.select("genome", "chr", "seq"), 1, k, piece)
    # sequences are small beside their k-mers, and often lie in one file: pieces are dealt out before they are cut
    p = p.repartition(shuffle_partitions(seqs.sparkSession), "genome", "chr", "at")
    first = F.least("at", F.lit(1)).cast("int")  # offset of the piece's first position
    if k <= PACKED:
        bound_text_batches(seqs.sparkSession)
        p = p.select("genome", "chr", "at", first.alias("o"), "p")
        schema = StructType([*p.select("genome", "chr").schema.fields, *WALK])
        return p.mapInArrow(lean(packed_walk(k, piece)), schema)
    p = p.select("genome", "chr", "at", "p", first.alias("o"), F.explode(F.sequence(F.lit(0), F.lit(piece - 1))).alias("i")).filter("i + o < length(p)")
    at = F.col("i") + F.col("o")
    w = p.select("genome", "chr", (F.col("at") + F.col("i")).alias("pos"), kmer(F.col("p"), at, k).alias("here"), kmer(F.col("p"), at + 1, k).alias("next"), kmer(F.col("p"), at - 1, k).alias("last"))
    w = w.filter("here is not null")
    node, sign = canonical(F.col("here"))
    after, turn = canonical(F.col("next"))
    return w.select("genome", "chr", "pos", node.alias("node"), sign.alias("sign"), F.concat(after, F.when(turn > 0, "L").otherwise("R")).alias("right"), F.col("last").isNull().alias("left_end"))


def _packed(df: DataFrame, c: str = "node") -> bool:
    return isinstance(df.schema[c].dataType, LongType)


def _side(df: DataFrame, right: Column) -> Column:
    """The right or the left side of ``node``."""
    return F.col("node") * 2 + right.cast("int") if _packed(df) else F.concat("node", F.when(right, "R").otherwise("L"))


def _node(df: DataFrame, c: str) -> Column:
    """The node of a side."""
    return F.shiftright(c, 1) if _packed(df, c) else F.expr(f"substring({c}, 1, length({c}) - 1)")


def sides(walk: DataFrame) -> DataFrame:
    """``(me, low, high, open)`` of every side: the smallest and greatest side that it leads to, and whether it is a sequence's end somewhere."""
    out, back = _side(walk, F.col("sign") > 0), _side(walk, F.col("sign") < 0)
    kind = walk.schema["node"].dataType
    pairs = ((out, F.col("right")), (F.col("right"), out), (F.when(F.col("left_end"), back), F.lit(None).cast(kind)))
    half = walk.select(F.inline(F.array(*[F.struct(me.alias("me"), to.alias("to")) for me, to in pairs]))).filter("me is not null")
    return half.groupBy("me").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max(F.col("to").isNull()).alias("open"))


def spelled(side: DataFrame, k: int) -> DataFrame:
    """Sides as ``(node, side, low, high, open)`` in letters."""
    if not _packed(side, "me"):
        return side.select(_node(side, "me").alias("node"), F.right("me", F.lit(1)).alias("side"), "low", "high", "open")
    node = lambda c: F.translate(F.lpad(F.conv(F.shiftright(c, 1).cast("string"), 10, 4), k, "0"), "0123", "ACGT")
    letter = lambda c: F.when(F.col(c) % 2 == 1, "R").when(F.col(c) % 2 == 0, "L")
    return side.select(node("me").alias("node"), letter("me").alias("side"), F.concat(node("low"), letter("low")).alias("low"), F.concat(node("high"), letter("high")).alias("high"), "open")


def kmer_pieces(seqs: DataFrame, k: int, piece: int) -> DataFrame:
    """``(sid, at, p)``: the pieces of ``seqs`` (sid, seq), each with a letter ahead of it: N at a sequence's start."""
    if k % 2 == 0:
        raise ValueError("k must be odd: a k-mer of even length can be its own reverse complement")
    p = pieces(seqs.select("sid", "seq"), 1, k, piece).repartition(shuffle_partitions(seqs.sparkSession), "sid", "at")
    return p.select("sid", "at", F.when(F.col("at") == 0, F.concat(F.lit(b"N"), F.col("p"))).otherwise(F.col("p")).alias("p"))


def kmer_steps(seqs: DataFrame, k: int, piece: int, cols: list[str]) -> DataFrame:
    """Columns ``cols`` of ``(sid, pos, node, sign, bits)`` of every k-mer of ``seqs`` (sid, seq): what follows on either side of its node is
    told by the letter (``kmers.letter_bits``), so that a row is a node and twelve bits."""
    return piece_steps(kmer_pieces(seqs, k, piece), k, piece, cols)


def piece_steps(p: DataFrame, k: int, piece: int, cols: list[str]) -> DataFrame:
    """``kmer_steps`` of pieces (sid, at, p). A ``place`` is sid times ``piece`` and the place in the piece, for pieces with a sid each."""
    if k <= PACKED:
        kinds = {"sid": "long", "pos": "long", "place": "long", "node": "long", "sign": "int", "bits": "int"}
        return p.select("sid", "at", "p").mapInArrow(lean(packed_steps(k, piece, cols)), ", ".join(f"{c} {kinds[c]}" for c in cols))
    p = p.select("sid", "at", "p", F.explode(F.sequence(F.lit(0), F.lit(piece - 1))).alias("i")).filter("i + 1 < length(p)")
    at = F.col("i") + 1
    w = p.select("sid", (F.col("at") + F.col("i")).alias("pos"), (F.col("sid") * piece + F.col("i")).alias("place"), kmer(F.col("p"), at, k).alias("here"), kmer(F.col("p"), at + 1, k).alias("next"), kmer(F.col("p"), at - 1, k).alias("last"))
    node, sign = canonical(F.col("here"))
    w = w.filter("here is not null").select("*", node.alias("node"), sign.alias("sign"))

    def near(c, letter):
        own = F.when(F.col("sign") > 0, letter).otherwise(F.translate(letter, "ACGT", "TGCA"))
        bit = F.when(own == "A", 1).when(own == "C", 2).when(own == "G", 4).otherwise(8)
        return F.when(F.col(c).isNull(), 16).otherwise(bit + F.when(canonical(F.col(c))[0] == F.col("node"), 32).otherwise(0))

    w = w.withColumns({"a": near("next", F.right("next", F.lit(1))), "b": near("last", F.left("last", F.lit(1)))})
    return w.withColumn("bits", F.when(F.col("sign") > 0, F.col("a") + 64 * F.col("b")).otherwise(F.col("b") + 64 * F.col("a"))).select(*cols)


def kmer_nodes(p: DataFrame, k: int, piece: int) -> DataFrame:
    """``(node, n, bits)``: every node of pieces (sid, at, p), how often it occurs and what follows on its sides anywhere."""
    return piece_steps(p, k, piece, ["node", "bits"]).groupBy("node").agg(F.count("*").alias("n"), F.bit_or("bits").alias("bits"))


def branching(seqs: DataFrame, k: int, piece: int = PIECE) -> DataFrame:
    """``(node, side, low, high, open)`` in letters of the sides of the k-mers of ``seqs`` (genome, chr, seq) that lead to several sides, or are a
    sequence's end somewhere: told by the letters, so that a row for each k-mer moves, not one for each step."""
    bound_text_batches(seqs.sparkSession)
    named = seqs.filter("seq is not null").select("seq", F.monotonically_increasing_id().alias("sid"))
    nodes = kmer_nodes(kmer_pieces(named, k, piece), k, piece)
    side = F.explode(F.array(F.struct(F.lit("R").alias("side"), F.col("bits").bitwiseAND(31).alias("b")), F.struct(F.lit("L").alias("side"), F.shiftright("bits", 6).bitwiseAND(31).alias("b"))))
    s = nodes.select("node", side.alias("x")).select("node", "x.*").filter("b >= 16 or bit_count(b) > 1")
    if k <= PACKED:
        s = s.withColumn("node", F.translate(F.lpad(F.conv(F.col("node").cast("string"), 10, 4), k, "0"), "0123", "ACGT"))

    def to(letter, bit):
        right = F.col("side") == "R"
        f = F.when(right, F.concat(F.expr("substring(node, 2)"), F.lit(letter))).otherwise(F.concat(F.lit(letter), F.expr("left(node, length(node) - 1)")))
        r = reverse_complement_acgt(f)
        return F.when(F.col("b").bitwiseAND(bit) > 0, F.concat(F.least(f, r), F.when((f <= r) == right, "L").otherwise("R")))

    led = F.array_compact(F.array(*[to(x, 1 << i) for i, x in enumerate("ACGT")]))
    return s.select("node", "side", F.array_min(led).alias("low"), F.array_max(led).alias("high"), (F.col("b") >= 16).alias("open"))


def unitig_blocks(seqs: DataFrame, k: int = 15, piece: int = PIECE, least: int = 2) -> DataFrame:
    """Blocks ``(genome, chr, block_id, sign, bstart, bend)``: the contracted paths that occur ``least`` times or more.

    Up to k = 15 a block's id is its smallest node's code plus one; for longer k-mers ids are unique but depend on the run. Rows with a null
    genome, chr or sequence are ignored; of equal (genome, chr) one row is expected. Letters other than A, C, G, T break a path.
    """
    spark = seqs.sparkSession
    bound_text_batches(spark)
    kept, deal = Written(spark, "finder"), shuffle_partitions(spark)
    named = kept.cut(seqs.filter("genome is not null and chr is not null and seq is not null").select("genome", "chr", "seq", F.monotonically_increasing_id().alias("sid")))
    cut = kept.cut(kmer_pieces(named, k, piece).select(F.monotonically_increasing_id().alias("pid"), "sid", "at", "p"))
    # two adjacent k-mers are joined if both sides are simple: each occurrence of one leads to the other, so neither needs to be looked up there.
    # K-mers are cut three times, for their nodes, their places and their stretches: a table of them would be many times the sequences' size
    own = cut.select(F.col("pid").alias("sid"), "at", "p")
    letters = own.repartition(deal, "sid")
    simple = lambda x: x.isin(1, 2, 4, 8).cast("int")
    bits = F.col("bits")
    node = kmer_nodes(letters, k, piece).filter(F.col("n") >= least).select("node", (simple(bits.bitwiseAND(63)) + 2 * simple(F.shiftright(bits, 6)) + 1).alias("x"))
    node = kept.cut(node)
    kind = node.schema["node"].dataType.simpleString()
    edge = (F.col("s") == 0) & F.col("before") | (F.col("e") == piece - 1) & F.col("after")
    part, rounds = None, min(PARTS, max(1, cut.count() // ROUND))
    for i in range(rounds):  # pieces know nothing of each other here: only the shuffles of some of them lie on disk at a time
        mine = F.col("sid") % rounds == i
        # of a place, three bits; a piece itself stands ahead of its places. The written nodes are small, but not once they are read: no broadcast
        code = piece_steps(letters.filter(mine), k, piece, ["node", "place"]).join(node.hint("merge"), "node")
        code = code.select((F.col("place") * 8 + F.col("x")).alias("code"), F.lit(None).cast("binary").alias("p"))
        code = code.unionByName(own.filter(mine).select((F.col("sid") * (piece * 8)).alias("code"), "p"))
        code = code.repartition(deal, F.expr(f"code div {piece * 8}")).sortWithinPartitions("code")
        # stretches within a piece
        found = code.mapInArrow(lean(stretches(k, piece)), f"pid long, s int, e int, before boolean, after boolean, node {kind}, sign int")
        # parts that reach the edge of their piece and may go on beyond it: at most two a piece
        release(spark)
        found = kept.cut(found.select("pid", "s", "e", "before", "after", F.struct("node", "sign").alias("m"), edge.alias("edge")))
        part = found if part is None else part.unionByName(found)
    release(spark)
    part = part.join(cut.select("pid", "sid", "at"), "pid").select("sid", (F.col("at") + F.col("s")).alias("s"), (F.col("at") + F.col("e")).alias("e"), "before", "after", "m", "edge")
    v = Window.partitionBy("sid").orderBy("s")
    over = part.filter("edge")
    more = ~F.coalesce((F.lag("e").over(v) == F.col("s") - 1) & F.lag("after").over(v) & F.col("before"), F.lit(False))
    over = over.withColumn("more", more.cast("int")).withColumn("g", F.sum("more").over(v))
    over = over.groupBy("sid", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("m").alias("m")).drop("g")
    whole = kept.cut(part.filter("not edge").select("sid", "s", "e", "m").unionByName(over).join(named.select("sid", "genome", "chr"), "sid"))
    # packed codes have two bits a letter, ids four
    ids = F.conv(F.conv(F.col("m.node").cast("string"), 10, 4), 16, 10).cast("long") + 1 if k <= CODED else F.col("id")
    if k > CODED:
        names = kept.cut(whole.select(F.col("m.node").alias("node")).distinct().withColumn("id", F.monotonically_increasing_id() + 1))
        whole = whole.join(names, F.col("m.node") == F.col("node"))
    return whole.select("genome", "chr", ids.alias("block_id"), F.col("m.sign").alias("sign"), F.col("s").alias("bstart"), (F.col("e") + k).alias("bend"))


def find_blocks(seqs: DataFrame, sizes: list[int], k: int = 15, passes: list[tuple[int, int]] = PASSES) -> dict[int, DataFrame]:
    """Blocks of each size from sequences (genome, chr, seq): contracted paths, then bulges removed and paths compressed pass by pass
    (J18 to J22)."""
    blocks = Written(seqs.sparkSession, "found").cut(unitig_blocks(seqs, k))
    return multi_scale(blocks, passes, sizes)

"""Contigs against references without an external tool (survey A22): minimiser seeds, segments, colinear chains.

1. *Sketch.* Of every ``w`` consecutive k-mers the one of the smallest scrambled code (ties: the first) is a minimiser; a shorter
   sequence is one window. Equal minimisers of a contig and a reference are an anchor; those that occur more than ``most`` times in the
   references are no seeds. Both sides of that join are written tables, so that a hot minimiser's rows can be split.
2. *Segments.* Anchors of one diagonal whose distance is at most ``gap`` are one segment (windows over a diagonal).
3. *Chains.* A segment may follow another if it starts and ends after it on both sequences (on the contig: before it, for strand -1), they
   overlap by less than k and are at most ``gap`` apart. The cost is the larger distance plus the shift of the diagonal. Every segment
   chooses its cheapest predecessor, every chosen one its cheapest successor (ties: the first on the reference, then on the contig);
   joins on which both agree make chains, which are put together by list ranking. Candidates meet in buckets of the reference.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from synframe.operators.kmers import CODED, PIECE, coded, pieces
from synframe.operators.lists import rank_lists
from synframe.runtime import Written, bound_text_batches, lean

K, W, GAP, MOST = 15, 5, 300, 256
#: A multiplier that scrambles codes modulo a prime, and the prime.
MULTIPLIER, PRIME = 48271, 2147483647


def _sketch(seqs: DataFrame, k: int = K, w: int = W, piece: int = PIECE) -> DataFrame:
    """``minimisers`` with k-mers as their codes (a hexadecimal digit a letter)."""
    if not 0 < k <= CODED or k % 2 == 0:
        raise ValueError(f"k must be odd and at most {CODED}")
    bound_text_batches(seqs.sparkSession)
    p = pieces(seqs.filter("name is not null").select("name", "seq"), 0, k + w - 2, piece)
    p = p.select("name", "at", "size", "p")
    schema = StructType([p.schema["name"], StructField("code", LongType()), StructField("pos", LongType()), StructField("sign", IntegerType())])
    return p.mapInArrow(lean(_least(k, w, piece)), schema).distinct()  # a place may be least in windows of two pieces


def _least(k: int, w: int, piece: int):
    """Batches of pieces ``(name, at, size, p)`` -> rows of ``_sketch``, an Arrow batch for about 65,000 of them."""
    far = np.int64((1 << 62) + (1 << 61))

    def rows(p, at, size):
        own, plus, ok = coded(p, k)
        n = max(min(piece, size - at - (k + w - 2)), int(at == 0))  # windows that start here
        if not len(own) or n <= 0:
            return own[:0], own[:0], own[:0]
        v = np.where(ok, (own % PRIME * MULTIPLIER % PRIME) * (1 << 31) + at + np.arange(len(own)), far)
        v = np.concatenate((v, np.full(max(0, n + w - 1 - len(v)), far)))
        best = v[:n]
        for j in range(1, w):
            best = np.minimum(best, v[j : j + n])
        best = np.unique(best[best < far])
        pos = best % (1 << 31)
        return own[pos - at], pos, np.where(plus[pos - at], 1, -1)

    def run(batches):
        for b in batches:
            at, size, ps = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)
            held, who, n = [], [], 0
            for i in range(b.num_rows):
                held.append(rows(ps[i].as_py(), at[i], size[i]))
                who.append(np.full(len(held[-1][0]), i))
                n += len(who[-1])
                if n and (n >= 65_536 or i == b.num_rows - 1):
                    own, pos, sign = (np.concatenate(x) for x in zip(*held, strict=True))
                    cols = [b.column(0).take(pa.array(np.concatenate(who))), pa.array(own), pa.array(pos), pa.array(sign.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names=["name", "code", "pos", "sign"])
                    held, who, n = [], [], 0

    return run


def minimisers(seqs: DataFrame, k: int = K, w: int = W, piece: int = PIECE) -> DataFrame:
    """``(name, kmer, pos, sign)`` of ``seqs`` (name, seq): the sketch, each place once. K-mers with other letters than A, C, G, T are
    passed over; windows count them."""
    return _sketch(seqs, k, w, piece).select("name", F.translate(F.lpad(F.hex("code"), k, "0"), "0123", "ACGT").alias("kmer"), "pos", "sign")


def segments(queries: DataFrame, refs: DataFrame, k: int = K, w: int = W, gap: int = GAP, most: int = MOST) -> DataFrame:
    """``(qry, ref, strand, ref_start, ref_end, qry_start, qry_end, anchors)`` from sequences (name, seq)."""
    kept = Written(queries.sparkSession, "seeds")
    r = kept.cut(_sketch(refs, k, w))
    rare = r.groupBy("code").count().filter(F.col("count") <= most).select("code")
    r = kept.cut(r.join(rare, "code", "left_semi"))
    q = kept.cut(_sketch(queries, k, w))
    q = q.select("code", F.col("name").alias("qry"), F.col("pos").alias("q"), F.col("sign").alias("qs"))
    a = q.join(r.select("code", F.col("name").alias("ref"), F.col("pos").alias("r"), F.col("sign").alias("rs")), "code")
    a = a.select("qry", "ref", (F.col("qs") * F.col("rs")).alias("strand"), "q", "r").withColumn("d", F.col("r") - F.col("strand") * F.col("q"))
    by = Window.partitionBy("qry", "ref", "strand", "d").orderBy("r")
    a = a.withColumn("new", F.coalesce((F.col("r") - F.lag("r").over(by) > gap).cast("int"), F.lit(1))).withColumn("no", F.sum("new").over(by))
    s = a.groupBy("qry", "ref", "strand", "d", "no").agg(
        F.min("r").alias("ref_start"), (F.max("r") + k).alias("ref_end"), F.min("q").alias("qry_start"), (F.max("q") + k).alias("qry_end"), F.count("*").alias("anchors")
    )
    return s.drop("d", "no")


def chain_segments(seg: DataFrame, k: int = K, gap: int = GAP) -> DataFrame:
    """Chains of segments, in the columns of ``segments``."""
    kept = Written(seg.sparkSession, "chaining")
    s = kept.cut(seg.withColumn("id", F.monotonically_increasing_id()))
    # along the contig in the direction of the strand
    plus = F.col("strand") > 0
    along = s.select("id", "qry", "ref", "strand", F.col("ref_start").alias("rs"), F.col("ref_end").alias("re"), F.when(plus, F.col("qry_start")).otherwise(-F.col("qry_end")).alias("qs"), F.when(plus, F.col("qry_end")).otherwise(-F.col("qry_start")).alias("qe"))
    before = along.withColumn("b", F.floor(F.col("re") / gap))
    after = along.withColumn("b", F.explode(F.sequence(F.floor((F.col("rs") - gap) / gap), F.floor((F.col("rs") + k) / gap))))
    after = after.select("qry", "ref", "strand", "b", *[F.col(c).alias(f"{c}2") for c in ("id", "rs", "re", "qs", "qe")])
    dr, dq = F.col("rs2") - F.col("re"), F.col("qs2") - F.col("qe")
    pair = before.join(after, ["qry", "ref", "strand", "b"]).filter("rs < rs2 and re < re2 and qs < qs2 and qe < qe2")
    pair = pair.filter((F.greatest(dr, dq) <= gap) & (F.least(dr, dq) > -k))
    # of equal costs the first on the reference, then on the contig
    cost = F.struct((F.greatest(dr, dq) + F.abs(dr - dq)).alias("cost"), "rs", "qs", "re", "qe", "id")
    chosen = pair.groupBy("id2").agg(F.min(cost).alias("m"), F.first("rs2").alias("rs2"), F.first("qs2").alias("qs2"), F.first("re2").alias("re2"), F.first("qe2").alias("qe2"))
    back = F.min(F.struct("m.cost", "rs2", "qs2", "re2", "qe2", "id2")).alias("m")
    links = chosen.groupBy(F.col("m.id").alias("prev")).agg(back).select("prev", F.col("m.id2").alias("id"))
    ranked = kept.cut(rank_lists(s.select("id").join(links, "id", "left")))
    out = s.join(ranked, "id").groupBy("head", "qry", "ref", "strand")
    return out.agg(F.min("ref_start").alias("ref_start"), F.max("ref_end").alias("ref_end"), F.min("qry_start").alias("qry_start"), F.max("qry_end").alias("qry_end"), F.sum("anchors").alias("anchors")).drop("head")


def align(queries: DataFrame, refs: DataFrame, k: int = K, w: int = W, gap: int = GAP, most: int = MOST, least: int = 1) -> DataFrame:
    """Alignments ``(qry, ref, strand, ref_start, ref_end, qry_start, qry_end, anchors)`` of queries to references (name, seq): the chains of
    ``least`` anchors or more. A null name or sequence and sequences shorter than k give none; one row for each name is expected."""
    return chain_segments(segments(queries, refs, k, w, gap, most), k, gap).filter(F.col("anchors") >= least)

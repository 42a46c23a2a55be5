"""Scalar functions on nucleotide strings and signed names (survey I1-I7, F12, B1, A3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements, upper and lower case.
IUPAC = "ATGCURYKMSWBVDHNXatgcurykmswbvdhnx"
IUPAC_COMPLEMENT = "TACGAYRMKSWVBHDNXtacgayrmkswvbhdnx"


def reverse_complement(seq: Column) -> Column:
    """Reverse complement over the IUPAC alphabet, case kept."""
    return F.reverse(F.translate(seq, IUPAC, IUPAC_COMPLEMENT))


def reverse_complement_acgt(seq: Column) -> Column:
    """Only A, C, G and T are complemented."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def is_nucleotide(seq: Column, gaps: bool = False) -> Column:
    """A2: alphabet check."""
    return seq.rlike(f"^[{IUPAC}{'-' if gaps else ''}]*$")


def wrap(seq: Column, width: int = 60) -> Column:
    """B1: lines of ``width`` characters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def fragment_name(chr_: Column, start: Column, end: Column, length: Column) -> Column:
    """I4: plain name of a whole sequence, ``name[start:end]`` otherwise."""
    return F.when((start == 0) & (end == length), chr_).otherwise(F.format_string("%s[%d:%d]", chr_, start, end))


def signed_name(name: Column, sign: Column) -> Column:
    return F.concat(F.when(sign > 0, "+").otherwise("-"), name)


def support_string(pairs: Column, assembly: Column) -> Column:
    """``genome:chr`` sorted and joined, ``~>`` at the end for overlap support. ``pairs``: array of (genome, chr)."""
    names = F.array_sort(F.transform(pairs, lambda p: F.concat(p["genome"], F.lit(":"), p["chr"])))
    return F.array_join(F.when(assembly, F.array_append(names, "~>")).otherwise(names), ",")


def maf_start(strand: Column, start: Column, size: Column, src: Column) -> Column:
    """Forward-strand start of a MAF row."""
    return F.when(strand == "-", src - (start + size)).otherwise(start)


def gap_rate(aligned: Column) -> Column:
    """Share of gap characters."""
    return (F.length(aligned) - F.length(F.replace(aligned, F.lit("-"), F.lit("")))) / F.length(aligned)


def break_position(seq: Column, start: Column, end: Column) -> Column:
    """middle of the first longest run of N in [start, end); start if there is none."""
    part = F.substring(F.upper(seq), start + 1, end - start)
    longest = F.array_max(F.transform(F.regexp_extract_all(part, F.lit("(N+)"), F.lit(1)), lambda r: F.length(r)))
    at = F.instr(part, F.repeat(F.lit("N"), longest)) - 1
    return F.when(longest.isNull(), start).otherwise(start + at + F.floor(longest / 2)).cast("long")

"""Recipes, Newick trees and block sources (survey A1, A5, A8, A16-A18, 2.K)."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synframe.sources.text_formats import read_blocks_coords, read_fasta, read_maf

#: Minimum block sizes of the presets.
BLOCK_SIZES = {"small": [5000, 500, 100], "large": [10000, 500, 100]}
#: Fixed values: (minimum block, maximum gap) passes of the block simplification.
SIMPLIFY_PASSES = [(30, 500), (100, 5000), (500, 50000), (5000, 500000)]
GLOBAL_KEYS = {"tree", "target", "references", "blocks", "maf", "hal", "naming_ref", "circular"}
GENOME_KEYS = {"fasta", "draft", "circular"}


class RecipeError(ValueError):
    pass


@dataclass
class Tree:
    """A node: children with branch lengths, or a leaf's name."""

    name: str | None = None
    children: list[tuple["Tree", float]] = field(default_factory=list)

    def leaves(self) -> list[str]:
        return [self.name or ""] if not self.children else [x for c, _ in self.children for x in c.leaves()]

    def newick(self) -> str:
        def text(t):
            return f"'{t.name}'" if not t.children else "(" + ", ".join(f"{text(c)} : {round(d, 10)}" for c, d in t.children) + ")"

        return text(self)


def parse_newick(text: str) -> Tree:
    """A5: nested lists with optional names, bootstrap values and lengths (missing: 1); quoted and numeric names; comments in []."""
    tokens = re.findall(r"'(?:[^']|'')*'|\"[^\"]*\"|\[[^\]]*\]|[(),:;]|[^\s(),:;\[\]'\"]+", text)
    tokens = [t for t in tokens if not t.startswith("[")]
    pos = 0

    def peek():
        return tokens[pos] if pos < len(tokens) else ""

    def take(what=None):
        nonlocal pos
        if pos >= len(tokens) or what and tokens[pos] != what:
            raise RecipeError(f"tree: {what or 'more'} expected at token {pos}")
        pos += 1
        return tokens[pos - 1]

    def name(t):
        return t[1:-1].replace("''", "'") if t[:1] in "'\"" else t

    def node():
        out = Tree()
        if peek() == "(":
            take()
            while True:
                c = node()
                length = 1.0
                if peek() == ":":
                    take()
                    length = float(take())
                out.children.append((c, length))
                if take() == ")":
                    break
                if tokens[pos - 1] != ",":
                    raise RecipeError("tree: , or ) expected")
            if peek() and peek() not in "(),:;":
                take()  # an inner name or bootstrap value
        else:
            t = take()
            if t in "(),:;":
                raise RecipeError("tree: a name was expected")
            out.name = name(t)
        return out

    root = node()
    if peek() == ":":
        take()
        take()
    if peek() == ";":
        take()
    if pos != len(tokens):
        raise RecipeError("tree: text after its end")
    return root


def _flag(value: str) -> bool:
    return value.strip().lower() in ("true", "yes", "1", "on")


def parse_recipe(path: str) -> dict:
    """A1: ``.key = value`` for the run, ``*.key`` for all genomes, ``genome.key`` for one; # starts a comment."""
    out: dict = {"genomes": {}}
    default: dict = {}
    base = os.path.dirname(os.path.abspath(path))
    with open(path) as f:
        for number, line in enumerate(f, 1):
            line = line.split("#")[0].strip()
            if not line:
                continue
            m = re.fullmatch(r"(\S+)\s*=\s*(.+)", line)
            if not m or "." not in m[1]:
                raise RecipeError(f"line {number}: {line}")
            owner, key = m[1].rsplit(".", 1)
            value: object = m[2].strip()
            if key not in (GENOME_KEYS if owner else GLOBAL_KEYS):
                raise RecipeError(f"line {number}: unknown parameter {key}")
            if key == "circular":
                continue
            if key in ("fasta", "maf", "hal"):
                value = os.path.normpath(os.path.join(base, os.path.expanduser(str(value))))
            elif key == "draft":
                value = _flag(str(value))
            elif key == "references":
                value = [x.strip() for x in str(value).split(",") if x.strip()]
            elif key == "blocks":
                value = BLOCK_SIZES[str(value)] if value in BLOCK_SIZES else [int(x) for x in str(value).split(",")]
            if owner == "*":
                default[key] = value
            elif owner:
                out["genomes"].setdefault(owner, {})[key] = value
            else:
                out[key] = value
    for need in ("references", "target"):
        if not out.get(need):
            raise RecipeError(f"{need} is missing")
    known = [*out["references"], out["target"]]
    if strange := set(out["genomes"]) - set(known):
        raise RecipeError(f"genomes that are neither target nor reference: {sorted(strange)}")
    for g in known:
        own = out["genomes"].setdefault(g, {})
        for k, v in ({"draft": False} | default).items():
            own.setdefault(k, v)
    if "tree" in out and set(parse_newick(out["tree"]).leaves()) != set(known):
        raise RecipeError("the tree's leaves are not the recipe's genomes")
    if out.get("naming_ref", known[0]) not in known:
        raise RecipeError("naming_ref is not a genome of the recipe")
    return out


def parse_simplify_passes(path: str) -> list[tuple[int, int]]:
    """``minBlock maxGap`` per line."""
    with open(path) as f:
        return [(int(a), int(b)) for a, b in (x.split() for x in f if x.strip())]


def simplify_passes_text(passes: list[tuple[int, int]], counted: bool = False) -> str:
    """The parameter file of ``parse_simplify_passes``; ``counted`` starts it with the number of passes, as block finders want it."""
    return "".join([f"{len(passes)}\n"] * counted + [f"{a} {b}\n" for a, b in passes])


class BlockSource(Protocol):
    def load(self, spark: SparkSession, recipe: dict, sizes: list[int]) -> dict[int, DataFrame]: ...


class CoordsSource:
    """Precomputed block files of external block finders, one per size: ``pattern`` with {size}."""

    def __init__(self, pattern: str):
        self.pattern = pattern

    def load(self, spark, recipe, sizes):
        return {s: read_blocks_coords(spark, self.pattern.format(size=s)) for s in sizes}


def _with_lengths(blocks: dict[int, DataFrame], seqs: DataFrame) -> dict[int, DataFrame]:
    """Blocks with the ``seq_len`` of their sequences."""
    length = seqs.groupBy("genome", "chr").agg(F.max("seq_len").alias("seq_len"))
    return {size: b.join(length, ["genome", "chr"]) for size, b in blocks.items()}


class SequenceSource:
    """Blocks found in the genomes' sequences alone, each from the file that the recipe's ``fasta`` of the genome names."""

    def __init__(self, k: int = 15):
        self.k = k

    def load(self, spark, recipe, sizes):
        from synframe.operators.blockfinder import find_blocks
        from synframe.runtime import Written

        seqs = None
        for g, own in recipe["genomes"].items():
            if not own.get("fasta"):
                raise RecipeError(f"{g} has no fasta: blocks are found in the sequences of all genomes")
            s = read_fasta(spark, own["fasta"]).select(F.lit(g).alias("genome"), F.col("name").alias("chr"), "seq")
            seqs = s if seqs is None else seqs.unionByName(s)
        seqs = Written(spark, "sequences").cut(seqs)
        return _with_lengths(find_blocks(seqs, sizes, self.k), seqs.withColumn("seq_len", F.length("seq").cast("long")))


class MafSource:
    """Blocks from the recipe's alignment, simplified once per pass; ``cache`` reuses written blocks."""

    def __init__(self, cache: str | None = None, overwrite: bool = False):
        self.cache, self.overwrite = cache, overwrite

    def load(self, spark, recipe, sizes):
        from synframe.operators.simplify import multi_scale

        if "maf" not in recipe:
            raise RecipeError("the recipe names no maf file")
        if self.cache and not self.overwrite:
            try:
                return {s: spark.read.parquet(f"{self.cache}/block_size={s}") for s in sizes}
            except Exception as e:  # noqa: BLE001  Spark's analysis error has no stable class
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        rows = read_maf(spark, recipe["maf"], 1)
        out = _with_lengths(multi_scale(rows, SIMPLIFY_PASSES, sizes), rows)
        if self.cache:
            for s, df in out.items():
                df.write.mode("overwrite").parquet(f"{self.cache}/block_size={s}")
            out = {s: spark.read.parquet(f"{self.cache}/block_size={s}") for s in sizes}
        return out


class HalSource:
    """A HAL file is read by the tools of its own library only; it is refused with what to do instead."""

    def load(self, spark, recipe, sizes):
        raise RecipeError("HAL files are not read: export the alignment as MAF and name it with .maf")


_SOURCES: dict[str, Callable[..., BlockSource]] = {}


def register_source(name: str, make: Callable[..., BlockSource]) -> None:
    """K1: ``make(**options)`` gives a source of blocks."""
    if name in _SOURCES:
        raise RecipeError(f"source {name} exists")
    _SOURCES[name] = make


def run_source(name: str, spark: SparkSession, recipe: dict, sizes: list[int], **options) -> dict[int, DataFrame]:
    if name not in _SOURCES:
        raise RecipeError(f"no source {name}; there are {sorted(_SOURCES)}")
    return _SOURCES[name](**options).load(spark, recipe, sizes)


def source_of(recipe: dict) -> str:
    """The source that a recipe asks for: its MAF alignment, else its HAL alignment, else the genomes' own sequences."""
    return "maf" if "maf" in recipe else "hal" if "hal" in recipe else "sequences"


register_source("coords", CoordsSource)
register_source("maf", MafSource)
register_source("hal", HalSource)
register_source("sequences", SequenceSource)

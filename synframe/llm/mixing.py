"""Mixing sources to target weights by iterative proportional fitting (operator 5).

Token weights are summed by (source, language, topic) class, raked to the three target marginals, and every
document is then sampled with the probability that its class's fitted weight gives it. A target names some
categories and puts all others under ``*``; without a target for sources, the ``NAMED`` sources with most tokens
are named, each by the square root of its tokens (tempering). So the class table is bounded by the targets,
whatever the number of sources; it is the only thing that reaches the driver, and the only thing broadcast.

The default topic is a stand-in for a topic model: the signs of three fixed random projections of the counts of
the text's long words, over the whole text, give one of eight classes; texts with like words share their class.

Targets that no weights of the classes present can meet (a target for a pair of marginals whose documents are
missing) leave a gap after the last sweep; it is told as a warning, and the weights are those of that sweep.

A class's ratio is its fitted weight over its own. Documents are kept with probability
``p = min(1, scale * ratio)``, where ``scale`` makes the expected tokens kept equal ``rate`` of all; where p is
cut at 1, the row's weight ``scale * ratio / p`` stays calibrated. Draws are hashes of doc_id and text: they do
not depend on partitions, and repeated rows share their draw.

Nulls: a null source or lang falls under ``*``; a null text has no tokens (it takes its class's probability).
Target categories without any tokens are left out and the others rescaled. Empty table: no rows. Extra
columns are kept, whatever their names; the columns added are ``topic``, ``tokens``, ``probability`` and ``weight``, and own columns of these
names are replaced.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from synframe.llm.columns import named
from synframe.runtime import Written, bound_text_batches, lean

TOPICS = 8
#: Sources that the default target names.
NAMED = 64
#: Bytes of a long word.
LONG = 6


def tokens_and_topic(text: bytes) -> tuple[int, str]:
    """Words between ASCII white space, and the default topic."""
    words = text.lower().split()
    bins = [0] * TOPICS
    for w, n in Counter([w for w in words if len(w) >= LONG]).items():
        bins[xxhash.xxh64_intdigest(w) & 7] += n
    signs = (sum(n if i >> b & 1 else -n for i, n in enumerate(bins)) > 0 for b in range(3))
    return len(words), str(sum(s << b for b, s in enumerate(signs)))


@dataclass(frozen=True)
class Targets:
    """Shares by category; ``source=None`` names the largest sources of the table."""

    source: dict[str, float] | None = None
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.17, "fr": 0.17, "es": 0.14, "*": 0.02})
    topic: dict[str, float] = field(default_factory=lambda: {str(i): 1 / TOPICS for i in range(TOPICS)})


def rake(cells: dict[tuple[str, ...], float], marginals: list[dict[str, float]], tolerance: float = 1e-10, sweeps: int = 500) -> dict[tuple[str, ...], float]:
    """Fitted weights (sum 1) of the cells with tokens."""
    keys = [k for k, v in cells.items() if v > 0]
    if not keys:
        return {}
    w = np.array([cells[k] for k in keys], float)
    w /= w.sum()
    dims = []
    for d, target in enumerate(marginals):
        names = sorted({k[d] for k in keys})
        at = np.array([names.index(k[d]) for k in keys])
        want = np.array([target.get(n, 0.0) for n in names])
        if not want.sum():
            want = np.ones(len(names))
        dims.append((at, want / want.sum()))
    for _ in range(sweeps):
        worst = 0.0
        for at, want in dims:
            have = np.bincount(at, w, len(want))
            f = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            worst = max(worst, float(np.abs(have - want).max()))
            w = w * f[at]
        if worst < tolerance:
            break
    else:
        if sweeps and worst > 1e-6:
            warnings.warn(f"the targets cannot all be met: a gap of {worst:.2g} is left after {sweeps} sweeps", stacklevel=2)
    return dict(zip(keys, (w / w.sum()).tolist(), strict=True))


def probabilities(cells: dict[tuple[str, ...], float], fitted: dict[tuple[str, ...], float], rate: float) -> tuple[dict, float]:
    """Ratio of every cell and the scale at which the expected tokens kept are ``rate`` of all (bisection)."""
    total = sum(cells.values())
    ratio = {k: fitted.get(k, 0.0) * total / v if v > 0 else 1.0 for k, v in cells.items()}
    kept = lambda s: sum(v * min(1.0, s * ratio[k]) for k, v in cells.items())
    lo, hi = 0.0, 1.0
    while kept(hi) < rate * total and hi < 1e9:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if kept(mid) < rate * total else (lo, mid)
    return ratio, hi


def _class(col: Column, names) -> Column:
    return F.when(col.isin(*[n for n in names if n != "*"]), col).otherwise("*")


def classified(docs: DataFrame, topic: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(_row, _s, _l, _t, _n)``: the row, its source, language and topic, and its tokens."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = topic(text).cast("string") if topic else F.lit(None).cast("string")
    d = docs.select(F.struct(*map(named, docs.columns)).alias("_row"), text.alias("text"), own.alias("topic"))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                n, t = zip(*[tokens_and_topic(x.as_py()) for x in part.column(1).cast(pa.binary())], strict=True)
                t = part.column(2) if topic else pa.array(t, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), t, pa.array(n, pa.int64())], names=["_row", "_t", "_n"])

    bound_text_batches(docs.sparkSession)
    t = d.mapInArrow(lean(run), StructType().add("_row", d.schema["_row"].dataType).add("_t", StringType()).add("_n", LongType()))
    star = lambda c: F.coalesce(F.col("_row")[c].cast("string"), F.lit("*"))
    return t.select("_row", star("source").alias("_s"), star("lang").alias("_l"), F.coalesce("_t", F.lit("*")).alias("_t"), "_n")


def source_targets(sums: DataFrame) -> dict[str, float]:
    """The default target of sources from ``(_s, n)`` sums: square roots of tokens, of the largest sources and of all others."""
    per = sums.filter("_s <> '*'").groupBy("_s").agg(F.sum("n").alias("n")).filter("n > 0")
    top = {r["_s"]: float(r["n"]) for r in per.orderBy(F.desc("n"), "_s").limit(NAMED).collect()}
    rest = max(0.0, float(sums.agg(F.sum("n")).first()[0] or 0) - sum(top.values()))
    total = sum(v**0.5 for v in top.values()) + rest**0.5
    return {k: v**0.5 / total for k, v in [*top.items(), ("*", rest)] if v} if total else {"*": 1.0}


def fit(docs: DataFrame, targets: Targets = Targets(), rate: float = 0.8, topic: Callable[[Column], Column] | None = None) -> tuple[DataFrame, list[tuple]]:
    """The classified documents, and of every class (source, language, topic, probability, scaled ratio)."""
    t = classified(docs, topic)
    sums = Written(docs.sparkSession, "mix").cut(t.groupBy("_s", "_l", "_t").agg(F.sum("_n").alias("n")))  # a row for each source, language and topic
    m = [source_targets(sums) if targets.source is None else targets.source, targets.lang, targets.topic]
    by = [_class(F.col(c), names).alias(c) for c, names in zip(("_s", "_l", "_t"), m, strict=True)]
    rows = sums.select(*by, "n").groupBy("_s", "_l", "_t").agg(F.sum("n").alias("n")).collect()  # at most (sources + 1) * (langs + 1) * (topics + 1) of the targets
    cells = {(r["_s"], r["_l"], r["_t"]): float(r["n"]) for r in rows}
    ratio, scale = probabilities(cells, rake(cells, m), rate)
    return t.select("_row", *by, "_n"), [(*k, min(1.0, scale * v), scale * v) for k, v in ratio.items()]


def unit(doc_id: Column, text: Column, seed: int = 17) -> Column:
    """The draw of a document, in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, targets: Targets = Targets(), rate: float = 0.8, seed: int = 17, topic: Callable[[Column], Column] | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with their topic, tokens, probability and weight."""
    t, classes = fit(docs, targets, rate, topic)
    table = docs.sparkSession.createDataFrame(classes, "_s string, _l string, _t string, _p double, _q double")
    row = F.col("_row")
    j = t.join(F.broadcast(table), ["_s", "_l", "_t"]).filter(unit(row["doc_id"], row["text"], seed) < F.col("_p"))
    new = {"topic", "tokens", "probability", "weight"}
    return j.select(*[row[c].alias(c) for c in docs.columns if c not in new], F.col("_t").alias("topic"), F.col("_n").alias("tokens"), F.col("_p").alias("probability"), (F.col("_q") / F.col("_p")).alias("weight"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: default targets (all large sources, five language classes, eight topics), 80 % of the tokens, all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "lang", "topic", "tokens", "probability", "weight")

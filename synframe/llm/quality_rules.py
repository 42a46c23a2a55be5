"""Quality rules: a threshold table compiled into one Spark projection (operator 9, native).

Every statistic is a Catalyst expression over the whole text; no user function runs. Words are maximal
runs of characters other than the six ASCII white spaces.

Nulls: a null text has no words (all counts 0, base_failed, not kept). Repeated rows and rows with a null
``doc_id`` are judged like any other. Empty table: no rows. Other columns are ignored. A very long text is worked on as a whole: the arrays of its
words, of their hashes and of its windows stand in one row at a time, about a hundred bytes a word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8
BULLET, ELLIPSIS = rf"^{SPACE}*(?:[-*]|•)", rf"(?:\.\.\.|…){SPACE}*$"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was by this from or an are "
    "de la le les et des un une du en que est pour dans "
    "der die und das ein eine von mit zu den ist nicht sich auf "
    "el los las del y por con se una para"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if ``stat`` (an expression over the base columns) is below ``low`` or above ``high``."""

    stat: str
    low: float | None = None
    high: float | None = None


#: The threshold table; every row becomes one conjunct of the verdict.
RULES = (
    Rule("n_words", low=20),
    Rule("word_chars / n_words", low=2.0, high=12.0),
    Rule("n_symbols / n_words", high=0.1),
    Rule("n_dup_lines / greatest(n_lines, 10)", high=0.3),  # one repeated line of a few is no ground
    Rule("n_repeat_words / n_words", high=0.3),
    Rule("n_bullet_lines / greatest(n_lines, 1)", high=0.9),
    Rule("n_ellipsis_lines / greatest(n_lines, 1)", high=0.3),
    Rule("n_alpha_words / n_words", low=0.7),
    Rule("n_stop_words / n_words", low=0.02),
)


def _count(array: Column, test) -> Column:
    return F.size(F.filter(array, test)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    d = d.withColumn("_words", F.filter(F.split("_text", SPACE + "+"), lambda w: w != ""))
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda l: l.rlike(WORD)))
    n = F.size("_words")
    # window hashes over word hashes; equal neighbours after a sort are windows found twice or more
    d = d.withColumn("_codes", F.transform("_words", lambda w: F.xxhash64(w)))
    c = F.size("_codes")  # several references keep the optimizer from computing _codes anew inside the lambda
    d = d.withColumn("_hashes", F.when(c >= WINDOW, F.transform(F.sequence(F.lit(1), c - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_codes"), i, WINDOW)))))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    d = d.withColumn("_sorted", F.when(repeats, F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    m = F.size("_sorted")
    pairs = F.arrays_zip(F.slice("_sorted", F.lit(1), m - 1).alias("a"), F.slice("_sorted", F.lit(2), m - 1).alias("b"))
    hits = F.flatten(F.transform(F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"]), lambda p: F.array(p["a"]["i"], p["b"]["i"])))
    d = d.withColumn("_hits", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.array_distinct(hits))))
    k = F.size("_hits")
    gaps = F.zip_with(F.slice("_hits", F.lit(2), k - 1), F.slice("_hits", F.lit(1), k - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(k > 0, F.aggregate(gaps, F.lit(WINDOW), lambda acc, x: acc + x)).otherwise(0)
    # an expression that is not deterministic keeps filters on the result from being pushed below, where every
    # reference would be expanded into the whole chain above
    fence = F.when(F.monotonically_increasing_id() < 0, F.lit(1)).otherwise(0)
    return d.select(
        "doc_id",
        (n + fence).cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _count(F.col("_lines"), lambda l: l.rlike(BULLET)).alias("n_bullet_lines"),
        _count(F.col("_lines"), lambda l: l.rlike(ELLIPSIS)).alias("n_ellipsis_lines"),
        F.regexp_count("_text", F.lit(r"[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*+")).cast("long").alias("n_alpha_words"),
        _count(F.col("_words"), lambda w: F.lower(w).isin(STOP_WORDS)).alias("n_stop_words"),
    )


def compile_rules(rules=RULES) -> Column:
    """The table as one boolean expression: true if no rule fails. Divisions are only reached by texts with words."""
    ok = F.lit(True)
    for r in rules:
        x = F.expr(r.stat)
        for fails in ([x < r.low] if r.low is not None else []) + ([x > r.high] if r.high is not None else []):
            ok = ok & ~fails
    return F.when(F.col("n_words") > 0, ok).otherwise(False)


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """The statistics, base_failed and kept of every document."""
    s = statistics(docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return s.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: the threshold table RULES, all documents."""
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql(rules=RULES) -> str:
    """The query in DuckDB's SQL."""
    fails = " or ".join(f"({r.stat}) {op} {x}" for r in rules for op, x in (("<", r.low), (">", r.high)) if x is not None)
    return f"""
with d as (select row_number() over () as n, doc_id, coalesce(text, '') as t from documents),
     w as (select n, doc_id, t, regexp_extract_all(t, '{WORD}+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as ls from d),
     u as (select n, unnest(ws) as x, generate_subscripts(ws, 1) as i from w),
     v as (select n, i, {" || ' ' || ".join(["x", *(f"lead(x, {k}) over o" for k in range(1, WINDOW))])} as g from u window o as (partition by n order by i)),
     r as (select n, i from (select n, i, count(*) over (partition by n, g) as c from v where g is not null) where c > 1),
     k as (select n, sum(least({WINDOW}, coalesce(j - i, {WINDOW}))) as c from (select n, i, lead(i) over (partition by n order by i) as j from r) group by n),
     s as (select doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
             len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(c, 0) as n_repeat_words, len(ls) as n_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '{BULLET}'))) as n_bullet_lines, len(list_filter(ls, lambda x: regexp_matches(x, '{ELLIPSIS}'))) as n_ellipsis_lines,
             len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) as n_alpha_words, len(list_filter(ws, lambda x: lower(x) in ({", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) as n_stop_words
           from w left join k on w.n = k.n),
     b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from s)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
       cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and not coalesce({fails}, true) as kept from b
"""


ORACLE_SQL = oracle_sql()

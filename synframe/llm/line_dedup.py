"""Line dedup by pairwise alignment (operator 7).

1. Every line with a word becomes a 64-bit hash; the lines of a document are an array made in the scan.
2. *Overlapping documents.* A line found in two or more documents links each later document to the first one
   that has it. No line is too frequent to be used: one of a third of all documents costs one row each. Links
   with the same two ends are one. Step 4 adds what these links leave.
3. *Alignment.* The two hash arrays of a link are aligned by patience diff: common head and tail, then lines
   that occur once on both sides in their longest increasing order (of several the one that, read from its end, always takes
   the latest line of the earlier document), then the same between them. Maximal runs of
   aligned lines are common blocks; blocks with ``min_words`` words or more are deleted from the later document.
4. *The rest.* Every block of ``min_words`` words is covered by shortest runs of lines that reach them. Runs that an earlier
   document holds and that are not deleted yet link their document to the run's first owner; runs that are left after
   that (their order crosses another common block) to the other earlier owners, in rounds of ever more of them until the
   run is gone or none is left, documents of equal lines being one. The outcome is that of the alignment with every
   earlier document.

Documents are ordered by doc_id (null last), then by a checksum of the text. Lines are compared without
trailing carriage returns; blank lines belong to the block that surrounds them.

Lines and runs are compared by 64-bit hashes, not by their text.

Nulls: a null text has no lines and stays null. Rows that are equal in doc_id and text are one document: they do
not delete each other. A document all of whose lines go keeps an empty text. Empty table: no rows. Extra
columns are kept; ``deleted_lines`` is added (and replaces a column of that name).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from synframe.llm.columns import named
from synframe.runtime import Written, bound_text_batches, lean

MIN_WORDS = 10
#: Owners of a run that the first round of step 4 tries; each later round tries so many times more.
SOME = 8
KEY = "k struct<n:boolean,d:long,t:long>"


def _increasing(b: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(b)
    for i, x in enumerate(b):
        k = bisect_left(tops, x)
        if k == len(tops):
            tops.append(x)
            at.append(i)
        else:
            tops[k], at[k] = x, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned index pairs of two sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: list[dict[int, int]] = []
        for s, lo, hi in ((a, a0, a1), (b, b0, b1)):
            place: dict[int, int] = {}
            for i in range(lo, hi):
                place[s[i]] = -1 if s[i] in place else i
            once.append(place)
        anchors = [(i, once[1][x]) for x, i in once[0].items() if i >= 0 and once[1].get(x, -1) >= 0]
        if not anchors:
            continue
        anchors = [anchors[i] for i in _increasing([j for _, j in anchors])]
        pa_, pb_ = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            if pa_ < i and pb_ < j:
                todo.append((pa_, i, pb_, j))
            if i < a1 or j < b1:
                out.append((i, j))
            pa_, pb_ = i + 1, j + 1
    return sorted(set(out))


def common_blocks(early: list[int], late: list[int], words: list[int], min_words: int) -> list[int]:
    """Indices of ``late`` in aligned blocks of ``min_words`` words or more."""
    out: list[int] = []
    run: list[int] = []
    last = None
    for i, j in [*patience(early, late), (-1, -1)]:
        if last is not None and (i, j) == (last[0] + 1, last[1] + 1):
            run.append(j)
        else:
            if sum(words[x] for x in run) >= min_words:
                out += run
            run = [j]
        last = (i, j)
    return out


def line_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, tk, at, hash, words)``: arrays of the lines with a word of every document; ``at`` is the line's number."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda l, i: F.struct(F.regexp_replace(l, r"\r+$", "").alias("l"), i.alias("i"))), lambda x: x["l"].rlike(r"\S"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text.cast("binary")).alias("tk"), lines.alias("ls"))
    return d.select(
        "doc_id",
        "tk",
        F.transform("ls", lambda x: x["i"]).alias("at"),
        F.transform("ls", lambda x: F.xxhash64(x["l"])).alias("hash"),
        F.transform("ls", lambda x: F.regexp_count(x["l"], F.lit(r"\S+"))).alias("words"),
    )


def runs(words: list[int], min_words: int) -> set[tuple[int, int]]:
    """Shortest runs of lines with ``min_words`` words or more, as (first, last), from every first and to every last line: each line
    of a block of that many words lies in one that the block holds."""
    ends = list(accumulate(words, initial=0))
    out = set()
    for i in range(len(words)):
        if (j := bisect_left(ends, ends[i] + min_words)) < len(ends):
            out.add((i, max(i, j - 1)))
        if (j := bisect_right(ends, ends[i + 1] - min_words) - 1) >= 0:
            out.add((min(i, j), i))
    return out


def run_table(table: DataFrame, min_words: int) -> DataFrame:
    """``(k, same, r, i, j)``: runs of every document; ``r`` is the hash of their lines, ``same`` that of all lines."""

    def run(batches):
        for b in batches:
            k, same, r, i, j = [], [], [], [], []
            for d in range(b.num_rows):
                h, w = b.column(1)[d].values.to_numpy(), b.column(2)[d].as_py()
                for x, y in runs(w, min_words):
                    k.append(d)
                    r.append(xxhash.xxh64_intdigest(h[x : y + 1].tobytes()))
                    i.append(x)
                    j.append(y)
                same += [xxhash.xxh64_intdigest(h.tobytes())] * (len(k) - len(same))
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            cols = [b.column(0).take(pa.array(k, pa.int32())), long(same), long(r), pa.array(i, pa.int32()), pa.array(j, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "same", "r", "i", "j"])

    return table.select("k", "hash", "words").mapInArrow(lean(run), f"{KEY}, same long, r long, i int, j int")


def aligned(links: DataFrame, arrays: DataFrame, min_words: int) -> DataFrame:
    """``(k, gone)``: indices of the lines in common blocks of each link (k, first)."""
    both = links.join(arrays, "k").join(arrays.select(F.col("k").alias("first"), F.col("hash").alias("early")), "first")

    def run(batches):
        for b in batches:
            h, w, early = (b.column(i) for i in (1, 2, 3))
            gone = [common_blocks(early[i].as_py(), h[i].as_py(), w[i].as_py(), min_words) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["k", "gone"])

    return both.select("k", "hash", "words", "early").mapInArrow(lean(run), f"{KEY}, gone array<int>").filter(F.size("gone") > 0)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, tk, gone)``: numbers of the lines to delete, for documents that have any."""
    spark = docs.sparkSession
    kept = Written(spark, "lines")
    bound_text_batches(spark)
    table = line_table(docs).dropDuplicates(["doc_id", "tk"])
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("tk").alias("t"))
    table = kept.cut(table.select(key.alias("k"), "at", "hash", "words"))
    arrays = table.select("k", "hash", "words")
    rows = table.select("k", F.explode(F.array_distinct("hash")).alias("h"))
    first = rows.groupBy("h").agg(F.min("k").alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
    first = kept.cut(first)  # both sides of the join are then exchanges, whose hot keys can be split
    links = kept.cut(rows.join(first, "h").filter("k <> first").select("k", "first").distinct())
    merge = lambda df: df.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    gone = kept.cut(merge(aligned(links, arrays, min_words)))

    # runs that an earlier document holds and that are not gone yet: first with their first owner, then with all others
    every = kept.cut(run_table(table, min_words))
    owner = every.groupBy("r").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first <> last").select("r", "first")
    shared = kept.cut(every.join(kept.cut(owner), "r").filter("k <> first").select("k", "same", "r", "i", "j", "first"))

    def left(gone):
        j = shared.join(gone, "k", "left")
        return j.filter(F.size(F.array_except(F.sequence("i", "j"), F.coalesce("gone", F.array().cast("array<int>")))) > 0).select("k", "r", "first")

    done = kept.cut(left(gone).select("k", "first").distinct().join(links, ["k", "first"], "left_anti"))
    gone = kept.cut(merge(gone.unionByName(aligned(done, arrays, min_words))))
    done = links.unionByName(done)
    rest = kept.cut(left(gone).select("k", "r").distinct())
    # documents of equal lines align alike: the first of them stands for all
    owners = shared.select(F.col("k").alias("first"), "same", "r").distinct().join(rest.select("r").distinct(), "r", "left_semi")
    owners = kept.cut(owners)
    many = kept.cut(owners.groupBy("r").agg(F.count("*").alias("m")))
    most = many.agg(F.max("m")).first()[0] or 0
    some = SOME
    while most and not rest.isEmpty():
        # about ``some`` owners of each run, by hash; all of them in the last round
        part = owners.join(many, "r").filter(F.pmod(F.xxhash64("same", "r"), F.col("m")) < some).select("r", "first", "same")
        links = rest.join(part, "r").filter("first < k").groupBy("k", "same").agg(F.min("first").alias("first")).select("k", "first").join(done, ["k", "first"], "left_anti")
        links = kept.cut(links)
        gone = kept.cut(merge(gone.unionByName(aligned(links, arrays, min_words))))
        if some >= most:
            break
        some, done = some * SOME, done.unionByName(links)
        rest = kept.cut(left(gone).select("k", "r").distinct())
    found = gone
    found = found.join(table.select("k", "at"), "k").select("k", F.transform("gone", lambda x: F.get("at", x)).alias("gone"))
    return found.select(F.when(~F.col("k.n"), F.col("k.d")).alias("doc_id"), F.col("k.t").alias("tk"), "gone")


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated blocks cut out of ``text`` and ``deleted_lines``."""
    gone = repeated_lines(docs, min_words).withColumnsRenamed({"doc_id": "_id", "tk": "_tk", "gone": "_gone"})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.struct(*map(named, docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_d"), F.crc32(text.cast("binary")).alias("_t"))
    j = d.join(gone, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_tk")), "left").select("_row", "_gone")

    bound_text_batches(docs.sparkSession)
    cols = [c for c in docs.columns if c != "deleted_lines"]

    def run(batches):
        # small batches: whole texts pass through, and a set look-up for each line is linear in the lines
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                gone = part.column(1).to_pylist()
                text = pa.array([t.as_py() if not g else "\n".join(l for i, l in enumerate(t.as_py().split("\n")) if i not in g) for t, g in zip(part.column(0).field("text"), [g and set(g) for g in gone], strict=True)], pa.string())
                row = part.column(0)
                names = [f.name for f in row.type]
                new = pa.StructArray.from_arrays([text if n == "text" else row.field(n) for n in names], fields=[pa.field(n, pa.string() if n == "text" else row.type.field(n).type) for n in names])
                yield pa.RecordBatch.from_arrays([new, pa.array([len(g or ()) for g in gone], pa.int32())], names=["row", "n"])

    kind = StructType([f if f.name != "text" else StructField("text", StringType()) for f in docs.schema.fields])
    out = j.withColumn("_row", F.col("_row").cast(kind)).mapInArrow(lean(run), StructType().add("row", kind).add("n", IntegerType()))
    return out.select(*[F.col("row")[c].alias(c) for c in cols], F.col("n").alias("deleted_lines"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: blocks of ten words or more, all documents."""
    out = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("deleted_lines").cast("long").alias("deleted_lines"), F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))

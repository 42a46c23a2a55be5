"""Canonical ``blocks`` rows and the view that derives them from the driver's tables.

Schema: genome STRING, chr STRING, block_id BIGINT (>= 1), sign INT, bstart BIGINT, bend BIGINT; coordinates are
0-based and half-open; blocks of a sequence are ordered by (bstart, block_id).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One text, valid in Spark and DuckDB. g0 is the target, g1..g4 are references, g4 counts as draft.
BLOCKS_SQL = """
with inst as (
  select l_suppkey % 5 as gno, l_partkey + 1 as block_id, count(*) as n
  from lineitem group by l_suppkey % 5, l_partkey + 1 having count(*) >= 3),
cp as (
  select gno, block_id, block_id as anchor, 0 as copy_no from inst
  union all
  select gno, block_id, block_id + 37 as anchor, 1 as copy_no from inst where n >= 12),
pos as (
  select gno, block_id, copy_no, anchor,
    case when gno = 0 then concat('c', cast(cast(floor(anchor / 8) as bigint) as string))
         else concat('r', cast(cast(floor(anchor / 100) as bigint) as string)) end as chr,
    case when (block_id * 7 + gno) % 13 = 0 then -1 else 1 end as sign,
    2000 + (anchor % (case when gno = 0 then 8 else 100 end)) * 1000
      + case when (block_id + gno) % 11 = 0 then -1500 else 0 end + copy_no * 300 as bstart
  from cp)
select concat('g', cast(gno as string)) as genome, chr, cast(block_id as bigint) as block_id,
       cast(sign as int) as sign, cast(bstart as bigint) as bstart,
       cast(bstart + 400 + (block_id * 31 + gno * 17) % 500 as bigint) as bend
from pos
"""

_COPIES = """  select gno, block_id, block_id as anchor, 0 as copy_no from inst
  union all
  select gno, block_id, block_id + 37 as anchor, 1 as copy_no from inst where n >= 12"""
#: The same rows without a union: Spark 4.1 takes a union of tables dealt alike for one dealt alike, and a sort-merge join of the view with
#: itself (tables too large to broadcast) then fails on unequal numbers of partitions. ``inst`` is also made once, not twice.
_COPIES_SPARK = """  select gno, block_id, block_id + 37 * copy_no as anchor, copy_no
  from (select gno, block_id, explode(if(n >= 12, array(0, 1), array(0))) as copy_no from inst)"""

TARGET = "g0"
DRAFT = "g4"
GENOMES = ("g0", "g1", "g2", "g3", "g4")
TREE = "((g0:0.02,g1:0.05):0.03,(g2:0.04,(g3:0.06,g4:0.01):0.02):0.05);"


def from_files(text: str, sf_dir: str, tables: tuple[str, ...] = ("lineitem", "documents", "part")) -> str:
    """The SQL text with its tables read from their files; no view is made in the caller's session."""
    text = text.replace(_COPIES, _COPIES_SPARK)
    return re.sub(rf"\b(from|join)\s+({'|'.join(tables)})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", text, flags=re.I)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(from_files(BLOCKS_SQL, sf_dir))


def sequences(b: DataFrame) -> DataFrame:
    """``(genome, chr, seq_len)``; a sequence ends 1000 after its last block."""
    return b.groupBy("genome", "chr").agg((F.max("bend") + 1000).alias("seq_len"))

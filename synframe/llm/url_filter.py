"""Temporal list join for URL filters (operator 6).

A list is a table of dated entries: a host pattern is added or removed at some time. Entries become validity
intervals (an addition holds until the next entry of its pattern and list), and every capture is evaluated
against the entries active at its fetch time. A pattern covers its host and all hosts below it.

Only distinct hosts meet the list: each host's own name and its parent domains are joined with the patterns by
equality, which gives one row of intervals per host. Captures then join their host once (an equi-join that AQE
can split for a host with a third of all rows) and the as-of test runs inside the row, so captures are never
multiplied or grouped and repeated rows stay.

Nulls: a capture with a null URL, host or time matches nothing; entries with a null pattern or time are ignored.
Of several entries of a pattern and list at one time a removal wins. An interval holds from its start,
inclusive, to its end, exclusive. Empty tables: no captures give no rows, no entries block nothing.
Other columns of the captures are kept, whatever their names; own columns named host, active or blocked are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from synframe.llm.columns import named
from synframe.runtime import Written
from synframe.sources.blocks_view import from_files


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a final dot; empty if there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+?)\.?(?:[:/?#]|$)", 1)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``(pattern, list_name, entry_from, entry_to)`` from ``(pattern, list_name, action, at)``; entry_to is null while open."""
    e = entries.filter(F.col("pattern").isNotNull() & F.col("at").isNotNull())
    e = e.groupBy(F.lower("pattern").alias("pattern"), "list_name", "at").agg(F.max((F.col("action") == "remove").cast("int")).alias("gone"))
    w = Window.partitionBy("pattern", "list_name").orderBy("at")
    e = e.withColumn("entry_to", F.lead("at").over(w))
    return e.filter("gone = 0").select("pattern", "list_name", F.col("at").alias("entry_from"), "entry_to")


def temporal_list_join(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with ``host``, ``active`` (sorted ``list:pattern`` of the entries active at the fetch time) and ``blocked``."""
    spans = validity_intervals(entries)
    c = captures.select(F.struct(*map(named, captures.columns)).alias("_row"), F.nullif(host_of(named(url)), F.lit("")).alias("_host"), named(at).alias("_at"))
    hosts = c.select("_host").filter("_host is not null").distinct()
    labels = F.split("_host", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    per = hosts.select("_host", F.explode(up).alias("pattern")).join(spans, "pattern")
    per = per.groupBy("_host").agg(F.collect_list(F.struct("pattern", "list_name", "entry_from", "entry_to")).alias("_spans"))
    # written, so that its size is known before the join: small ones are broadcast and captures do not move, for others both sides
    # are exchanges whose hot keys can be split
    per = Written(captures.sparkSession, "urls").cut(per)
    j = c.join(per.withColumnRenamed("_host", "_key"), F.col("_host") == F.col("_key"), "left")
    on = F.filter("_spans", lambda s: (s["entry_from"] <= F.col("_at")) & (s["entry_to"].isNull() | (F.col("_at") < s["entry_to"])))
    names = F.array_sort(F.transform(on, lambda s: F.concat_ws(":", s["list_name"], s["pattern"])))
    j = j.withColumn("_active", F.coalesce(names, F.array().cast("array<string>")))
    new = {"host", "active", "blocked"}
    return j.select(*[F.col("_row")[x].alias(x) for x in captures.columns if x not in new], F.col("_host").alias("host"), F.col("_active").alias("active"), (F.size("_active") > 0).alias("blocked"))


#: The tables hold neither fetch times nor a list. Both are derived from whole tables by these texts, valid in Spark and DuckDB:
#: a page is fetched on one of 730 days; a host's domain is listed, removed or listed again on days read off its MD5.
CAPTURES = "select page_id, url, date '2023-01-01' + cast((page_id * 37) % 730 as int) as fetched_at from pages"
ENTRIES = """
with d as (select distinct concat_ws('.', {part2}, {part1}, {part0}) as pattern from pages where url like '%.%.%'),
     m as (select pattern, md5(pattern) as h from d)
select pattern, 'spam' as list_name, 'add' as action, date '2023-01-01' + ascii(substr(h, 2, 1)) as at from m where substr(h, 1, 1) < '6'
union all
select pattern, 'spam', 'remove', date '2023-01-01' + (ascii(substr(h, 2, 1)) + 3 * ascii(substr(h, 3, 1))) from m where substr(h, 1, 1) < '6' and substr(h, 4, 1) < '9'
union all
select pattern, 'spam', 'add', date '2023-01-01' + (ascii(substr(h, 2, 1)) + 3 * ascii(substr(h, 3, 1)) + 2 * ascii(substr(h, 5, 1))) from m where substr(h, 1, 1) < '3'
union all
select pattern, 'adult', 'add', date '2023-01-01' + 4 * ascii(substr(h, 6, 1)) from m where substr(h, 7, 1) < '4'
"""
HOST = {"spark": "split(regexp_extract(url, '://([^/:?#]+)', 1), '[.]')", "duckdb": "string_split(regexp_extract(url, '://([^/:?#]+)', 1), '.')"}


def entries_sql(engine: str) -> str:
    h = HOST[engine]
    get = (lambda i: f"element_at({h}, -{i + 1})") if engine == "spark" else (lambda i: f"list_extract({h}, -{i + 1})")
    return ENTRIES.format(part0=get(0), part1=get(1), part2=get(2))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: all pages against the list derived from all hosts."""
    table = lambda text: spark.sql(from_files(text, sf_dir, ("pages",)))
    out = temporal_list_join(table(CAPTURES), table(entries_sql("spark")))
    return out.select("page_id", "host", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), F.array_join("active", ",").alias("active"), "blocked")


ORACLE_SQL = f"""
with e as (select pattern, list_name, t.at, max(case when action = 'remove' then 1 else 0 end) as gone
           from ({entries_sql("duckdb")}) as t group by pattern, list_name, t.at),
     s as (select *, lead(e.at) over (partition by pattern, list_name order by e.at) as ends from e),
     c as (select page_id, fetched_at, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+?)\\.?(?:[:/?#]|$)', 1), '') as host from ({CAPTURES})),
     r as (select row_number() over () as n, * from c),
     m as (select r.n, string_agg(s.list_name || ':' || s.pattern, ',' order by s.list_name || ':' || s.pattern) as active
           from r join s on s.gone = 0 and (r.host = s.pattern or ends_with(r.host, '.' || s.pattern)) and s.at <= r.fetched_at and (s.ends is null or r.fetched_at < s.ends)
           group by r.n)
select r.page_id, r.host, strftime(r.fetched_at, '%Y-%m-%d') as fetched_on, coalesce(m.active, '') as active, m.active is not null as blocked
from r left join m on r.n = m.n
"""

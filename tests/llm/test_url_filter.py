import datetime as dt

import duckdb

from synframe.llm.url_filter import ORACLE_SQL, op6_url_filter, temporal_list_join

DATA = "/root/testdata/sf0.001"
D = dt.date


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{DATA}/pages.parquet'")
    want = sorted(con.sql(ORACLE_SQL).fetchall())
    got = sorted((r.page_id, r.host, r.fetched_on, r.active, r.blocked) for r in op6_url_filter(spark, DATA).collect())
    assert got == want and any(w[4] for w in want) and not all(w[4] for w in want)


def test_intervals_suffixes_nulls_and_ties(spark):
    entries = [("bad.com", "a", "add", D(2024, 1, 10)), ("bad.com", "a", "remove", D(2024, 2, 1)), ("bad.com", "a", "add", D(2024, 3, 1)), ("BAD.com", "b", "add", D(2024, 1, 15)), ("tie.org", "a", "add", D(2024, 1, 1)), ("tie.org", "a", "remove", D(2024, 1, 1)), (None, "a", "add", D(2024, 1, 1)), ("x.net", "a", "add", None)]
    e = spark.createDataFrame(entries, "pattern string, list_name string, action string, at date")
    caps = [("http://bad.com/x", D(2024, 1, 9)), ("https://u:p@Sub.Bad.com.:80/", D(2024, 1, 10)), ("http://bad.com", D(2024, 1, 20)), ("http://bad.com?q", D(2024, 2, 1)), ("http://bad.com#f", D(2024, 3, 1)), ("http://notbad.com/", D(2024, 3, 1)), ("http://tie.org/", D(2024, 1, 5)), (None, D(2024, 1, 20)), ("http://bad.com/", None), ("mailto:x@bad.com", D(2024, 1, 20)), ("http://x.net/", D(2024, 5, 1))]
    c = spark.createDataFrame([(u, t, i, "z") for i, (u, t) in enumerate(caps + caps[1:2])], "url string, fetched_at date, pattern int, host string")
    got = {r.pattern: (r.blocked, ",".join(r.active)) for r in temporal_list_join(c, e).collect()}
    assert got == {0: (False, ""), 1: (True, "a:bad.com"), 2: (True, "a:bad.com,b:bad.com"), 3: (True, "b:bad.com"), 4: (True, "a:bad.com,b:bad.com"), 5: (False, ""), 6: (False, ""), 7: (False, ""), 8: (False, ""), 9: (False, ""), 10: (False, ""), 11: (True, "a:bad.com")}
    assert temporal_list_join(c.limit(0), e).count() == 0
    assert not temporal_list_join(c, e.limit(0)).filter("blocked").count()


def test_very_long_urls_and_no_view_in_the_session(spark):
    long = "http://" + "a." * 20000 + "bad.com/" + "x" * 100000
    c = spark.createDataFrame([(long, D(2024, 1, 20), 1), ("http://bad.com/" + "y" * 10**6, D(2024, 1, 20), 2)], "url string, fetched_at date, page_id long")
    e = spark.createDataFrame([("bad.com", "a", "add", D(2024, 1, 10))], "pattern string, list_name string, action string, at date")
    assert {r.page_id: r.blocked for r in temporal_list_join(c, e).collect()} == {1: True, 2: True}
    op6_url_filter(spark, DATA)
    assert not [t for t in spark.catalog.listTables() if t.name == "pages"]

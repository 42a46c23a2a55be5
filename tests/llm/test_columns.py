"""Columns of any name beside those that an operator uses."""

import datetime

from pyspark.sql import functions as F
from synframe.llm import language_id, line_dedup, mixing, url_filter
from synframe.llm.columns import freed, held

NAMES = ["a.b", "c`d", "`", "x.`y`", "_rest", "select *"]


def rows(n=12):
    return [(i, f"the cat number{i} and the dog sat on the mat in the sun\nline {i} of its own words", "en", "src0", *[f"{c}{i}" for c in NAMES]) for i in range(n)]


def check(df):
    assert {tuple(r[c] for c in NAMES) for r in df.collect()} == {tuple(f"{c}{i}" for c in NAMES) for i in range(12)}


def test_held_and_freed(spark):
    df = spark.createDataFrame(rows(), ["doc_id", "text", "lang", "source", *NAMES])
    out = freed(held(df, "text").withColumn("text", F.upper("text")), df, "text")
    assert out.columns == df.columns
    check(out)


def test_operators_keep_columns_of_any_name(spark):
    df = spark.createDataFrame(rows(), ["doc_id", "text", "lang", "source", *NAMES])
    check(language_id.predict(df, language_id.train(df), ["doc_id", *NAMES]))
    check(line_dedup.drop_repeated_lines(df))
    check(mixing.mix(df, rate=1.0))


def test_captures_with_columns_of_any_name(spark):
    day = datetime.date(2024, 1, 1)
    df = spark.createDataFrame([(f"http://h{i}.x.org/", day, *[f"{c}{i}" for c in NAMES]) for i in range(12)], ["u.rl", "at`", *NAMES])
    entries = spark.createDataFrame([("h3.x.org", "spam", "add", day)], "pattern string, list_name string, action string, at date")
    out = url_filter.temporal_list_join(df, entries, "u.rl", "at`")
    check(out)
    assert out.filter("blocked").count() == 1

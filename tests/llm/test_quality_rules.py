import re

from pyspark.sql import functions as F

from synframe.llm.quality_rules import STOP_WORDS, Rule, compile_rules, op9_quality_rules, quality_rules

DATA = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [l for l in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", l)]
    seen, dup = set(), 0
    for l in lines:
        dup += l in seen
        seen.add(l)
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for p in where.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def verdict(text):
    """The threshold table, read as plain comparisons."""
    n, chars, symbols, dup, repeat, failed = brute(text)
    if failed:
        return False
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [l for l in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", l)]
    bullets = sum(l.lstrip(" \t\n\x0b\x0c\r")[0] in "-*•" for l in lines)
    dots = sum(l.rstrip(" \t\n\x0b\x0c\r").endswith(("...", "…")) for l in lines)
    letters = sum(any(c.isalpha() for c in w) for w in words)
    stops = sum(w.lower() in STOP_WORDS for w in words)
    ok = 2 <= chars / n <= 12 and symbols / n <= 0.1 and dup / max(len(lines), 10) <= 0.3 and repeat / n <= 0.3
    return ok and bullets / len(lines) <= 0.9 and dots / len(lines) <= 0.3 and letters / n >= 0.7 and stops / n >= 0.02


def base(df):
    return sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect())


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    out = op9_quality_rules(spark, DATA)
    assert base(out) == sorted((r.doc_id, *brute(r.text)) for r in docs)
    assert {r.doc_id: r.kept for r in out.collect()} == {r.doc_id: verdict(r.text) for r in docs}


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    kept = op9_quality_rules(spark, DATA).join(docs.filter("quality = 1"), "doc_id")
    assert kept.filter("not base_failed and not kept").count() == 0


def test_edge_texts(spark):
    texts = [None, "", " \n\x0b\n", "one", "a " * 30, "a b c d e f g h " * 3, "a b c d e f g h i a b c d e f g h", "x\ny\nx\n x\n\nx\r\ny", "é# ü* <|>  b c", "w1 " * 7 + "\n" + "z " * 20000, "\U0001f600 a", "the w… " * 40, "• the x\n" * 3 + "- of y z\n" * 30, "the end of it...\n" + "word in a line\n" * 9, "The THE of word " * 9]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    assert base(quality_rules(df)) == sorted((i, *brute(t)) for i, t in enumerate(texts))
    assert {r.doc_id: r.kept for r in quality_rules(df).collect()} == {i: verdict(t) for i, t in enumerate(texts)}
    assert quality_rules(df.limit(0)).count() == 0
    assert quality_rules(df.union(df)).count() == 2 * len(texts)


def test_plan_is_native(spark):
    plan = op9_quality_rules(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_rules_compile(spark):
    df = spark.createDataFrame([(5, 1), (50, 1), (0, 0)], "n_words long, x long")
    got = [r[0] for r in df.select(compile_rules((Rule("n_words", 10, 100), Rule("x / n_words", high=1.0))).alias("k")).collect()]
    assert got == [False, True, False]

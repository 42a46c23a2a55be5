import random

import corpus_pipeline as cp
from pyspark.sql import functions as F
from synframe.llm import mixing, near_text, simhash

from tests.llm.test_line_dedup import brute as plain_lines
from tests.llm.test_mixing import plain_rake, plain_topic
from tests.llm.test_models import PlainLanguage
from tests.llm.test_near_text import brute as plain_components
from tests.llm.test_packing import verify

DATA = "/root/testdata/sf0.001"


def drawn(docs):
    """Ids that the mixing stage draws, from plain sums and loops; only the draw itself is the operator's hash."""
    rows = docs.withColumn("u", mixing.unit(F.col("doc_id"), F.col("text"))).collect()
    words = {r.doc_id: len(r.text.split()) for r in rows}
    per = {}
    for r in rows:
        per[r.source] = per.get(r.source, 0) + words[r.doc_id]
    t = mixing.Targets()
    cls = {r.doc_id: (r.source, r.lang if r.lang in t.lang else "*", plain_topic(r.text)) for r in rows}
    cells = {}
    for d, c in cls.items():
        cells[c] = cells.get(c, 0.0) + words[d]
    fit = plain_rake(cells, [{s: n**0.5 for s, n in per.items()}, t.lang, t.topic], 500)
    ratio, scale = mixing.probabilities(cells, fit, 0.8)
    return {r.doc_id for r in rows if r.u < min(1, scale * ratio[cls[r.doc_id]])}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cols = docs.columns
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_neardup", "mix_sources", "pack"]

    one = cp.identify_language(spark, docs, DATA)
    assert one.columns == cols and one.schema == docs.schema
    rows = docs.collect()
    model = PlainLanguage([(r.text, r.lang) for r in rows if r.lang])
    pred = {r.doc_id: model.predict(r.text) for r in rows}
    want = {d for d, (p, s) in pred.items() if p != "und" and s > 0}
    kept = one.collect()
    assert {r.doc_id for r in kept} == want

    two = cp.dedup_lines(spark, one, DATA)
    assert two.columns == cols
    plain = {d: t for d, t, n in plain_lines([(r.doc_id, r.text) for r in kept]) if not n or t.strip()}
    got = {r.doc_id: r for r in two.collect()}
    assert {d: r.text for d, r in got.items()} == plain
    assert all(r.n_chars == len(r.text) for r in got.values())

    three = cp.dedup_near(spark, two, DATA)
    assert three.columns == cols
    # those that lost lines are compared by their earlier texts as well
    before = {r.doc_id: r.text for r in rows}
    nodes = [(d, r.text) for d, r in got.items()]
    nodes += [(d, before[d]) for d, r in got.items() if r.text != before[d]]
    gone = {d for d, c in plain_components(nodes) if d != c}
    assert {r.doc_id for r in three.collect()} == got.keys() - gone

    four = cp.mix_sources(spark, three, DATA)
    assert four.columns == cols and {r.doc_id for r in four.collect()} == drawn(three)

    verify(cp.pack_sequences(spark, four, DATA).collect(), [(r.doc_id, r.text) for r in four.collect()])


def test_columns_of_any_name_pass_through(spark):
    own = ["x`y", "`", "a.b.c", "score", "lang_pred", "deleted_lines", "tokens", "weight", "topic", "probability", "_rest", "_row", "_gone", "k", "fp", "component_id", "a b", "x.y"]
    rows = [(i, f"the cat number{i} and the dog{i % 3} sat on the mat\n" * 3 + f"line {i} of its own words", "en", "src0", 9, *[f"{c}{i}" for c in own]) for i in range(30)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *own])
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, df, DATA)
        assert out.columns == df.columns
        df = spark.createDataFrame(out.collect(), df.schema)
    kept = df.collect()
    assert kept and all(r[own[j]] == f"{own[j]}{r.doc_id}" for r in kept for j in range(len(own)))
    assert cp.pack_sequences(spark, df, DATA).count() == len(kept)


def test_edge_documents_pass_all_stages(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (3, "the cat " * 30, None, None, 240), (3, "the cat " * 30, None, None, 240), (None, "the dog and the cat " * 9, "en", None, 180), (5, "12 34", "en", "src1", 5)]
    df = spark.createDataFrame(rows, schema)
    for _, stage in cp.STAGES[:-1]:
        df = stage(spark, df, DATA)
    assert df.schema.names == schema.names
    assert {r.doc_id for r in df.collect()} <= {3, None}
    empty = spark.createDataFrame([], schema)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, DATA)
    assert empty.count() == 0


def test_simhash_links_are_named_by_the_smallest(spark):
    assert simhash.near_components(spark.createDataFrame([(2, "a"), (1, "a")], "doc_id long, text string")).filter("component_id <> 1").count() == 0


def test_near_copies_do_not_survive_as_remnants(spark, tmp_path):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 8)))
    line = lambda: " ".join(word() for _ in range(12))
    rows, near, clean = [], {}, set()
    for k in range(12):
        text = [line() for _ in range(8)]
        rows.append((k, "\n".join(text)))
        clean.add(k)
        for c in range(2):  # one word of one line differs, so that line dedup leaves that line
            copy = list(text)
            w = copy[c].split()
            w[5] = "changed"
            copy[c] = " ".join(w)
            rows.append((100 + 10 * k + c, "\n".join(copy)))
            near[100 + 10 * k + c] = k
    # shares a passage with another document, and is a document of its own
    rows.append((900, rows[0][1].split("\n")[0] + "\n" + rows[0][1].split("\n")[1] + "\n" + "\n".join(line() for _ in range(9))))
    clean.add(900)
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(cp.STAGES)
    df = stages["line_dedup"](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    df.write.parquet(f"{tmp_path}/lines")
    kept = {r.doc_id for r in stages["simhash_neardup"](spark, spark.read.parquet(f"{tmp_path}/lines"), str(tmp_path)).collect()}
    assert kept == clean
    # the stage's own input alone shows remnants only
    alone = {r.doc_id for r in near_text.drop_near_texts(spark.read.parquet(f"{tmp_path}/lines")).collect()}
    assert near.keys() <= alone
    # the whole pipeline: what is packed was drawn from the clean ones
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} <= clean

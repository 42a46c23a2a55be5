import math
import statistics as stat
import zlib
from collections import Counter

import numpy as np
import pytest

from synframe.llm import language_id, quality_classifier
from synframe.llm.language_id import op4_language_id
from synframe.llm.quality_classifier import NAMES, fit, op3_quality_classifier, score_documents, statistics

DATA = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    s, rank = np.asarray(score)[order], np.empty(len(y))
    _, inv, n = np.unique(s, return_inverse=True, return_counts=True)
    rank[order] = (np.cumsum(n) - (n - 1) / 2)[inv]
    y = np.asarray(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


class PlainLanguage:
    """The language model in plain Python: dictionaries, sets of slots and unlimited integers; no code of the operator."""

    def __init__(self, rows, share=0.4, least=3):
        counts = {}
        for text, lang in rows:
            for w in self.words(text or ""):
                counts.setdefault(lang, Counter()).update(self.grams(w))
        counts = {lang: c for lang, c in counts.items() if c}
        self.langs = sorted(counts)
        total = {lang: sum(c.values()) for lang, c in counts.items()}
        self.filled = {lang: set() for lang in self.langs}
        for g in set().union(*counts.values()):
            use = {lang: counts[lang][g] / total[lang] for lang in self.langs if counts[lang][g] >= least}
            for lang, u in use.items():
                if u >= share * max(use.values()):
                    self.filled[lang].update(self.slots(g))
        self.rate = {lang: min(0.99, (len(f) / 2**20) ** 3) for lang, f in self.filled.items()}

    @staticmethod
    def words(text):
        return "".join(c if c.isalpha() else " " for c in text.lower()).split()

    @staticmethod
    def grams(word):
        w = "\0" + word + "\0"
        return [w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1)]

    @staticmethod
    def slots(gram):
        mask = 2**64 - 1
        h = len(gram) * 0x632BE59BD9B4E019 & mask
        for c, p in zip(gram, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)):
            h = h + ord(c) * p & mask
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & mask
        h ^= h >> 32
        return [(h % 2**32 + i * (h >> 32 | 1)) % 2**20 for i in range(3)]

    def predict(self, text):
        grams = [g for w in self.words(text or "") for g in self.grams(w)]
        if not grams or not self.langs:
            return "und", 0.0
        hits = {lang: sum(n for g, n in Counter(grams).items() if self.filled[lang].issuperset(self.slots(g))) for lang in self.langs}
        own = {lang: max(0.0, (h - self.rate[lang] * len(grams)) / (1 - self.rate[lang])) for lang, h in hits.items()}
        best = max(self.langs, key=own.get)
        return best, own[best] / sum(own.values()) if sum(own.values()) else 0.0


def test_language_against_brute_force(spark):
    small = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    model = PlainLanguage([(r.text, r.lang) for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2])
    want = {r.doc_id: model.predict(r.text) for r in rows}
    for r in op4_language_id(spark, small).collect():
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-9)


def plain_statistics(text):
    b = (text or "").encode()
    words = b.split()
    if not words:
        return [0.0] * 17
    n, size = len(words), len(b)
    odds = lambda p: math.log((p + 0.002) / (1.002 - p))
    share = lambda test: odds(sum(1 for c in b if test(c)) / size)
    lens, freq = [len(w) for w in words], Counter(words)
    lines = [x for x in b.split(b"\n") if x.split()]
    return [
        math.log(1 + n), math.log(stat.fmean(lens)), math.log(1 + stat.pstdev(lens)), math.log(max(lens)),
        math.log(len(freq)) / math.log(n + 1), odds(max(freq.values()) / n), odds(len({(words[i], words[i + 1]) for i in range(n - 1)}) / n),
        share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c in b".,;:?"), share(lambda c: c == 33),
        share(lambda c: c in b"#*$%&|<>@^~=+_{}[]\\/"), share(lambda c: c > 127),
        math.log(1 + len(lines)), odds(1 - len(set(lines)) / len(lines)), math.log(1 + n / len(lines)),
        -sum(f / n * math.log(f / n) for f in freq.values()) / math.log(n + 1),
    ]


def test_quality_against_brute_force(spark):
    """Both classes' densities from all training rows by direct formulas, over the whole table."""
    small = "/root/testdata/sf0.001"
    docs = {r.doc_id: np.array(plain_statistics(r.text)) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    learn = {0: [], 1: []}
    for r in spark.read.parquet(f"{small}/labels.parquet").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in docs and r.quality in (0, 1):
            learn[r.quality].append(docs[r.doc_id])
    n = {k: len(v) for k, v in learn.items()}
    cov = {k: np.cov(np.array(v).T, bias=True) for k, v in learn.items()}
    pooled = sum(n[k] * cov[k] for k in (0, 1)) / sum(n.values())

    def density(x, k):
        c = 0.7 * cov[k] + 0.3 * pooled
        c = 0.98 * c + 0.02 * np.diag(np.diag(c)) + 1e-3 * np.eye(17)
        d = x - np.mean(learn[k], axis=0)
        return -0.5 * d @ np.linalg.solve(c, d) - 0.5 * np.linalg.slogdet(c)[1] + math.log(n[k] / sum(n.values()))

    got = op3_quality_classifier(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        odds = density(docs[r.doc_id], 1) - density(docs[r.doc_id], 0)
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-500, min(500, odds)))), abs=1e-6)
        assert r.predicted == (r.score >= 0.5)


def test_language_held_out(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = op4_language_id(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97


def test_language_edges(spark):
    rows = [(1, "the cat and the dog " * 5, "en", 1), (2, "der hund und die katze " * 5, "de", 1), (3, None, None, 1), (4, "123 !!", "en", 1), (5, "", None, 1), (6, "zzzzq", None, 1), (None, "the dog", None, 1), (1, "the cat and the dog " * 5, "en", 1), (7, "katze" * 5000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    m = language_id.train(df)
    got = sorted(((r.doc_id, r.lang_pred) for r in language_id.predict(df, m).collect()), key=str)
    assert got == sorted([(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, got[[g[0] for g in got].index(6)][1]), (None, "en"), (7, "de")], key=str)
    assert dict(got)[6] in ("en", "de")
    empty = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, empty).collect()} == {"und"}
    assert language_id.predict(df.limit(0), m).count() == 0


def test_language_kept_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "der hund " * 9, "de", 7, "q"), (2, "the dog " * 9, "en", 7, "q")], "doc_id long, text string, lang string, score int, lang_pred string")
    got = sorted(language_id.predict(df, language_id.train(df), df.columns).collect())
    assert [(r.doc_id, r.lang, r.lang_pred) for r in got] == [(1, "de", "de"), (2, "en", "en")]


def test_words_of_training_and_prediction():
    assert language_id.letter_runs("aⅧb x²y ß1é_z") == ["a", "b", "x", "y", "ß", "é", "z"]


def test_bloom_holds_what_was_put_in(spark):
    df = spark.createDataFrame([(1, "abcd efgh " * 3, "x"), (2, "ijkl mnop " * 3, "y")], "doc_id long, text string, lang string")
    m = language_id.train(df)
    assert m.langs == ["x", "y"]
    h = m.hits("abcd")
    assert h[0] == h[2] and h[1] <= 1


def test_quality_held_out(spark):
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = op3_quality_classifier(spark, DATA).collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in lab]
    assert auc([r.score for r in held], [lab[r.doc_id] for r in held]) > 0.95


def test_quality_density_against_direct_formula():
    rnd = np.random.default_rng(1)
    x = {0: rnd.normal(size=(200, 3)) @ np.diag([1, 2, 3]), 1: rnd.normal(1, 1, size=(300, 3))}
    m = fit({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()}, pool=0.2, diagonal=0.1, floor=0.0)
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = (200 * cov[0] + 300 * cov[1]) / 500
    dens = []
    p = np.array([0.3, -1.0, 2.0])
    for k in (0, 1):
        c = 0.8 * cov[k] + 0.2 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c))
        d = p - x[k].mean(0)
        dens.append(-0.5 * d @ np.linalg.inv(c) @ d - 0.5 * np.log(np.linalg.det(c)) + np.log(len(x[k]) / 500))
    assert m.score(p[None])[0] == pytest.approx(1 / (1 + np.exp(dens[0] - dens[1])))


def test_quality_edges(spark):
    rows = [(1, "a b c", 1), (2, None, 1), (3, "", 1), (4, "x" * 50000, 1), (None, "one two", 1), (1, "a b c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in score_documents(df, one).collect()} == {(1.0, 1)}
    assert {r.score for r in score_documents(df, one.limit(0)).collect()} == {0.5}
    assert score_documents(df.limit(0), one).count() == 0
    assert len(statistics("a\n\nb!")) == len(NAMES)

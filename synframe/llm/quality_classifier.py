"""Quality classifier: regularised quadratic discriminant over document statistics (operator 3).

Each text becomes a fixed vector of transformed statistics. Per class the mean and the covariance are summed
over all labelled training rows (counts, sums and sums of products: nothing but these sums, of fixed size,
leaves the executors). A class covariance is shrunk towards the pooled one and then towards its own
diagonal; its Cholesky factor is computed once and cached in the broadcast model. The score is the logistic
of the difference of the two Gaussian log densities (Mahalanobis distance and log determinant) plus the log
prior ratio.

Nulls: a null text counts as empty and gets a score; a label row with a null id or quality is not learned from;
a null ``doc_id`` counts as the empty text in the fold. If one class has no training row every score is that of
the other class (1 or 0), 0.5 with no training rows. Repeated rows are scored one by one; of labels that
contradict each other for one id all count. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synframe.runtime import Written, bound_text_batches, lean

UPPER = bytes(range(65, 91))
DIGIT = bytes(range(48, 58))
HIGH = bytes(range(128, 256))
END = b".,;:?"
MARK = b"!"
SYMBOL = b"#*$%&|<>@^~=+_{}[]\\/"
NAMES = ("log_words", "word_length", "word_length_sd", "longest_word", "distinct", "top_word", "distinct_pairs", "upper", "digit", "end", "mark", "symbol", "other_bytes", "log_lines", "repeated_lines", "words_a_line", "entropy")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of NAMES."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    size = len(b)
    share = lambda chars: (size - len(b.translate(None, chars))) / size
    odds = lambda p: float(np.log((p + 0.002) / (1.002 - p)))
    lens = np.fromiter(map(len, words), np.float64, n)
    count = Counter(words)
    freq = np.fromiter(count.values(), np.float64, len(count))
    lines = [x for x in b.split(b"\n") if x.strip()]
    p = freq / n
    return [
        np.log1p(n),
        float(np.log(lens.mean())),
        float(np.log1p(lens.std())),
        float(np.log(lens.max())),
        float(np.log(len(count)) / np.log(n + 1)),
        odds(float(freq.max()) / n),
        odds(len(set(zip(words, words[1:], strict=False))) / n),
        odds(share(UPPER)),
        odds(share(DIGIT)),
        odds(share(END)),
        odds(share(MARK)),
        odds(share(SYMBOL)),
        odds(share(HIGH)),
        float(np.log1p(len(lines))),
        odds(1 - len(set(lines)) / len(lines)),
        float(np.log1p(n / len(lines))),
        float(-(p * np.log(p)).sum() / np.log(n + 1)),
    ]


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)``: the statistics of every text."""

    def run(batches):
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, x array<double>")


@dataclass
class Model:
    """Per class: mean, inverse of the Cholesky factor, log determinant, log prior; ``fixed`` if a class is missing."""

    mean: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray
    prior: np.ndarray
    fixed: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        dens = [-0.5 * (((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(1) - 0.5 * self.logdet[k] + self.prior[k] for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(dens[1] - dens[0], -500, 500)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = 0.3, diagonal: float = 0.02, floor: float = 1e-3) -> Model:
    """From (count, sum, sum of products) of each class. pool: weight of the pooled covariance; diagonal: of the own diagonal."""
    if len(sums) < 2:
        return Model(*[np.zeros(0)] * 4, fixed=float(next(iter(sums))) if sums else 0.5)
    n = np.array([sums[k][0] for k in (0, 1)])
    mean = np.stack([sums[k][1] / sums[k][0] for k in (0, 1)])
    own = [sums[k][2] / sums[k][0] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    inverse, logdet = [], []
    for k in (0, 1):
        c = (1 - pool) * own[k] + pool * pooled
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + floor * np.eye(len(c))
        chol = np.linalg.cholesky(c)
        inverse.append(np.linalg.inv(chol))
        logdet.append(2 * np.log(np.diag(chol)).sum())
    return Model(mean, np.stack(inverse), np.array(logdet), np.log(n / n.sum()))


def class_sums(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Sums over all rows ``(x, y)`` by class: partial sums per task, then one aggregation over positions."""
    d = len(NAMES)

    def run(batches):
        acc = {}
        for b in batches:
            y = b.column(1).to_numpy()
            x = np.array(b.column(0).to_pylist(), np.float64).reshape(len(y), d)
            for k in np.unique(y):
                z = x[y == k]
                acc[int(k)] = acc.get(int(k), 0) + np.concatenate(([len(z)], z.sum(0), (z.T @ z).ravel()))
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), pa.array([v.tolist() for v in acc.values()], pa.list_(pa.float64()))], names=["y", "v"])

    part = labelled.select("x", F.col("y").cast("int").alias("y")).mapInArrow(lean(run), "y int, v array<double>")
    rows = part.select("y", F.posexplode("v").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * d) rows
    out = {}
    for k in {r["y"] for r in rows}:
        v = np.zeros(1 + d + d * d)
        for r in rows:
            if r["y"] == k:
                v[r["i"]] = r["v"]
        out[k] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return out


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; one scan of the texts."""
    bound_text_batches(docs.sparkSession)
    spark = docs.sparkSession
    x = Written(spark, "quality").cut(features(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    model = fit(class_sums(x.join(known.filter(~held_out()), "doc_id")))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            v = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(v))], names=["doc_id", "score"])

    out = x.mapInArrow(lean(run), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production parameters: labels of folds 0 and 2 of 3, all documents scored."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return score_documents(read("documents"), read("labels"))

"""Quality classifier: regularised quadratic discriminant over transformed text statistics.

Class means and covariances come from sums over all labelled training rows (two rows reach the driver). Covariances
are shrunk towards the pooled diagonal and get a floor; their inverted Cholesky factors are kept with the model and
turn a document's statistics into two Mahalanobis distances, all as columns. The score is the logistic function of
the tempered log-density difference. Labels, language, source and doc_id are no inputs of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import stored, text_of
from strideline.llm.textstats import with_stats

SHRINKAGE = 0.2
FLOOR = 0.02
TEMPERATURE = 4.0
HELD_OUT = 2
ACCEPT = 0.7


def _share(a: str, b: str, scale: float) -> Column:
    return F.log1p(F.col(a) * scale / F.greatest(F.col(b), F.lit(1)))


FEATURES = {
    "word_length": lambda: _share("word_chars", "n_words", 1.0),
    "symbols": lambda: _share("n_symbols", "n_words", 10.0),
    "marks": lambda: _share("n_marks", "n_words", 10.0),
    "upper": lambda: _share("n_upper", "word_chars", 10.0),
    "dup_lines": lambda: _share("n_dup_lines", "n_lines", 10.0),
    "repeats": lambda: _share("n_repeat_words", "n_words", 10.0),
    "distinct": lambda: F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(F.col("n_distinct") / F.col("n_words")),
}


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): mean, inverted Cholesky factor of the covariance, and log density at the mean plus log prior."""

    means: list[list[float]]
    whitening: list[list[list[float]]]
    levels: list[float]

    def log_odds(self, x: list[Column]) -> Column:
        parts = []
        for mean, w, level in zip(self.means, self.whitening, self.levels):
            d2 = F.lit(0.0)
            for i, row in enumerate(w):
                z = F.lit(0.0)
                for j in range(i + 1):
                    z = z + F.lit(row[j]) * (x[j] - F.lit(mean[j]))
                d2 = d2 + z * z
            parts.append(F.lit(level) - d2 / 2)
        return parts[1] - parts[0]


def fit(train: DataFrame, label: str = "quality") -> Discriminant | None:
    """Fit on feature columns f0, f1, ... and a 0/1 label; None unless both classes have rows."""
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    rows = (
        train.filter(F.col(label).isin(0, 1))
        .groupBy(label)
        .agg(F.count("*").alias("n"), *[F.sum(f"f{i}").alias(f"t{i}") for i in range(p)], *[F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"q{i}_{j}") for i, j in pairs])
        .collect()
    )
    by = {int(r[label]): r for r in rows}
    if len(by) < 2:
        return None
    n = np.array([by[k]["n"] for k in (0, 1)], float)
    means, covs = [], []
    for k in (0, 1):
        m = np.array([by[k][f"t{i}"] for i in range(p)]) / n[k]
        s = np.zeros((p, p))
        for i, j in pairs:
            s[i, j] = s[j, i] = by[k][f"q{i}_{j}"] / n[k] - m[i] * m[j]
        means.append(m)
        covs.append(s)
    pooled = np.diag(np.diag(covs[0] * n[0] + covs[1] * n[1]) / n.sum())
    whitening, levels = [], []
    for k in (0, 1):
        s = (1 - SHRINKAGE) * covs[k] + SHRINKAGE * pooled + FLOOR * np.eye(p)
        low = np.linalg.cholesky(s)
        whitening.append(np.linalg.inv(low).tolist())
        levels.append(float(-np.log(np.diag(low)).sum() + np.log(n[k] / n.sum())))
    return Discriminant([m.tolist() for m in means], whitening, levels)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, text_hash, held_out, score, predicted` of every row of `docs`."""
    d = with_stats(docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64(text_of()))).drop("text")
    d = stored(d.select("doc_id", "text_hash", *[value().alias(f"f{i}") for i, value in enumerate(FEATURES.values())]), "features")
    held = fold(F.col("doc_id")) == HELD_OUT
    model = fit(d.filter(~held).join(labels.select("doc_id", "quality").dropna(), "doc_id"))
    if model is None:
        score = F.lit(1.0)
    else:
        score = F.lit(1.0) / (1 + F.exp(-model.log_odds([F.col(f"f{i}") for i in range(len(FEATURES))]) / TEMPERATURE))
    d = d.select("doc_id", "text_hash", held.alias("held_out"), score.alias("score"))
    return d.withColumn("predicted", F.when(F.col("score") >= ACCEPT, 1).otherwise(0))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every row of `docs` (doc_id, text; other columns are ignored).

    `labels` has doc_id and quality; rows without either, and of the held-out fold, are not learnt from. An empty or
    NULL text is scored by its zero statistics. Repeated rows get equal scores. Without labelled rows of both
    classes nothing can be told apart and every score is 1. An empty table gives no rows.
    """
    return scored(docs, labels).drop("text_hash")


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is at least `ACCEPT`."""
    good = scored(docs, labels).filter("predicted = 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = docs["doc_id"].eqNullSafe(good["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == good["_hash"])
    return docs.join(good, same, "left_semi")

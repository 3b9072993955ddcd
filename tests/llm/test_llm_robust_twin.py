"""The robust estimate of the quality rules, and the classifier's score, against NumPy versions."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm import classifier, outliers
from strideline.llm.textstats import with_stats

FIELDS = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType())]


def corpus(sizes, seed):
    """Documents by (lang, source) group, with some odd ones in each."""
    rng, rows = random.Random(seed), []
    for (lang, source), n in sizes.items():
        for _ in range(n):
            words = [f"{rng.choice('bcdfgh')}{rng.randrange(10**4):0{rng.randrange(3, 7)}d}" for _ in range(rng.randrange(55, 90))]
            if rng.random() < 0.12:
                words = [w + "$$#" for w in words]
            if rng.random() < 0.2:
                words = words[:30] * 2 + words[30:]
            lines = [" ".join(words[k : k + 8]) for k in range(0, len(words), 8)]
            if rng.random() < 0.1:
                lines += [lines[0]] * rng.randrange(1, 12)
            rows.append((len(rows), "\n".join(lines), lang, source))
    return rows


def twin(x, groups):
    """Squared distance of every row of x from its group's shrunk robust centre."""
    p, tol = x.shape[1], np.array([t for _, t in outliers.STATISTICS.values()]) * outliers.UNIT

    def factor(s, scale):
        return np.linalg.cholesky(s * scale + np.diag(tol**2))

    def measured(rows, m, low):
        y = np.linalg.solve(low, (rows - m).T)
        return (y * y).sum(axis=0)

    def percentile(r, q):
        r = np.sort(r)
        at = (len(r) - 1) * q
        lo, hi = math.floor(at), math.ceil(at)
        return r[lo] if lo == hi else (hi - at) * r[lo] + (at - lo) * r[hi]

    def moments(rows):
        m = rows.sum(axis=0) / len(rows)
        return m, rows.T @ rows / len(rows) - np.outer(m, m)

    def settle(rows):
        found = []
        for start in (moments(rows), (np.median(rows, axis=0), np.zeros((p, p)))):
            (m, s), det = start, None
            while True:
                r = np.floor(np.log1p(measured(rows, m, factor(s, 1.0))) * outliers.UNIT)
                new = moments(rows[r <= percentile(r, outliers.CORE)])
                d = np.log(np.diag(factor(new[1], 1.0))).sum()
                if det is not None and not d < det - 1e-9:
                    break
                (m, s), det = new, d
            found.append((det, m, s))
        return found[0][1:] if found[0][0] <= found[1][0] else found[1][1:]

    whole = settle(x)
    out = np.zeros(len(x))
    for g in set(groups):
        at = np.array([k for k, v in enumerate(groups) if v == g])
        own, w = settle(x[at]), len(at) / (len(at) + outliers.PRIOR_ROWS)
        m, s = (w * a + (1 - w) * b for a, b in zip(own, whole))
        out[at] = measured(x[at], m, factor(s, outliers.CONSISTENCY))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_distances_and_verdicts_match_numpy(spark, seed):
    """Groups of 1, 29, 30, 31 and 120 rows, among them NULL languages and sources."""
    rows = corpus({("en", "a"): 120, ("en", None): 31, (None, "a"): 30, (None, None): 29, ("rare", "b"): 1}, seed)
    docs = spark.createDataFrame(rows, T.StructType([T.StructField(*f) for f in FIELDS]))
    d = with_stats(docs)
    for x, (value, _) in zip(outliers.XS, outliers.STATISTICS.values()):
        d = d.withColumn(x, F.round(value() * outliers.UNIT).cast("long"))
    seen = {r.doc_id: [r[c] for c in outliers.XS] for r in d.collect()}
    want = twin(np.array([seen[r[0]] for r in rows], float), [r[2:] for r in rows])
    out = {r.doc_id: r for r in outliers.quality_verdicts(docs).collect()}
    assert np.array([out[r[0]].distance ** 2 for r in rows]) == pytest.approx(want, rel=1e-6)
    assert [out[r[0]].kept for r in rows] == [bool(w <= outliers.CUTOFF) and not out[r[0]].base_failed for r, w in zip(rows, want)]
    assert 0 < sum(out[r[0]].kept for r in rows) < len(rows)


def test_one_more_document_changes_little(spark):
    """A group of 29 and the same with one more row: no switch moves the distances of the others far."""
    rows = corpus({("en", "a"): 200, ("de", "b"): 30}, 5)
    make = lambda r: {x.doc_id: x.distance for x in outliers.quality_verdicts(spark.createDataFrame(r, T.StructType([T.StructField(*f) for f in FIELDS]))).collect()}
    a, b = make(rows[:-1]), make(rows)
    moved = [abs(a[k] - b[k]) / (1 + b[k]) for k in a]
    assert np.median(moved) < 0.05


def features_of(text):
    """The classifier's statistics of a text, in plain Python."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = len({i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)})
    chars = sum(map(len, w))
    marks = len(re.findall(r"[!-/:-@\[-`{-~]", text))
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    share = lambda a, b, scale: math.log1p(a * scale / max(b, 1))
    return [
        share(chars, len(w), 1.0), share(len(re.findall(r"[#*$%&|<>]", text)), len(w), 10.0), share(marks, len(w), 10.0), share(upper, chars, 10.0),
        share(len(lines) - len(set(lines)), len(lines), 10.0), share(repeat, len(w), 10.0), len(set(w)) / len(w) if w else 0.0,
    ]


def twin_scores(docs, labels):
    """Scores by doc_id and text: class covariances shrunk to the pooled diagonal, tempered difference of log densities."""
    x = {(d, t): np.array(features_of(t)) for d, t in docs}
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2
    rows = {k: np.array([x[d, t] for d, t in docs for i, q in labels if i == d and i is not None and q == k and not held(d)]) for k in (0, 1)}
    if not len(rows[0]) or not len(rows[1]):
        return dict.fromkeys(x, 1.0)
    n = {k: len(v) for k, v in rows.items()}
    covs = {k: np.cov(v.T, bias=True) for k, v in rows.items()}
    pooled = np.diag(np.diag(covs[0] * n[0] + covs[1] * n[1]) / (n[0] + n[1]))
    density = {}
    for k in (0, 1):
        s = (1 - classifier.SHRINKAGE) * covs[k] + classifier.SHRINKAGE * pooled + classifier.FLOOR * np.eye(len(pooled))
        inv, det = np.linalg.inv(s), np.linalg.slogdet(s)[1]
        density[k] = lambda v, m=rows[k].mean(0), inv=inv, level=-det / 2 + math.log(n[k] / (n[0] + n[1])): level - (v - m) @ inv @ (v - m) / 2
    return {key: 1 / (1 + math.exp(-(density[1](v) - density[0](v)) / classifier.TEMPERATURE)) for key, v in x.items()}


def test_scores_match_numpy(spark):
    """With repeated documents and labels, ties, labels without an id or a grade, and texts without words."""
    rows = [(d, t) for d, t, *_ in corpus({("en", "a"): 160}, 3)]
    rows += [(5, rows[5][1]), (5, "another text with the same id " * 9), (900, ""), (901, None), (None, rows[7][1]), (902, "ÄÖ! " * 30)]
    labels = [(k, int("$" not in t)) for k, t in rows[:160]] + [(7, 1), (7, 1), (None, 0), (8, None), (900, 0), (12345, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = classifier.quality_scores(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    want = twin_scores(rows, labels)
    got, exact = sorted((r.doc_id is not None, r.doc_id or 0, r.score) for r in out), sorted((k is not None, k or 0, want[k, t]) for k, t in rows)
    assert [g[:2] for g in got] == [e[:2] for e in exact] and [g[2] for g in got] == pytest.approx([e[2] for e in exact], abs=1e-9)
    assert all(r.predicted == int(r.score >= 0.7) for r in out) and 0 < sum(r.predicted for r in out) < len(out)

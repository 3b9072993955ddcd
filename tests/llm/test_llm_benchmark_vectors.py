"""Benchmark windows, the vector-approximation file and whitening against brute force, and on awkward rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from strideline.llm import decontaminate, vafile, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def content(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(docs, items, window=10, shingle=5, share=1.0):
    out = []
    windows = [(i, w[s : s + window]) for i, t in items for w in [content(t)] if w for s in range(max(len(w) - window, 0) + 1)]
    for doc, text, *_ in docs:
        words, hit, named = content(text), set(), set()
        for i, w in windows:
            k = min(shingle, len(w))
            m = len(w) - k + 1
            need = max(1, math.ceil(m * share - 1e-9))
            for s in range(len(words) - len(w) + 1):
                if sum(words[s + j : s + j + k] == w[j : j + k] for j in range(m)) >= need:
                    hit |= set(range(s, s + len(w)))
                    named |= {str(i)} if i is not None else set()
        ids = ",".join(sorted(named))
        out.append((doc is not None, doc or 0, len(words), len(hit), len(named), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def rows_of(frame):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect())


@pytest.fixture(scope="module")
def leaked():
    rng = random.Random(8)
    text = lambda n, v=30: " ".join(f"b{rng.randrange(v)}" for _ in range(n))
    items = [(1, text(25)), (2, text(40, 4)), (10, "Short item, only six WORDS here"), (11, None), (12, " . "), (3, "one"), (None, text(14)), (4, text(10)), (4, text(11))]
    items += [(20, items[0][1]), (21, " ".join(content(items[0][1])[:12]) + " tail of its own")]
    docs = [(k, text(60, 6)) for k in range(6)]
    docs += [(50 + k, f"{text(9)} {t} {text(7)} {t}") for k, (_, t) in enumerate(items) if t]
    words = content(items[0][1])
    return items, docs + [(80, " ".join(words[:9])), (81, " ".join(words[:9] + ["x"] + words[9:20])), (82, "b1 " * 200), (83, " ".join(words[3:16]).upper().replace(" ", "--"))]


@pytest.mark.parametrize(("share", "limit"), [(1.0, 100_000), (1.0, 3), (0.6, 100_000), (0.6, 3)])
def test_contamination_matches_brute_force(spark, documents, awkward, leaked, share, limit):
    items, docs = leaked
    docs = docs + [r for r in awkward if len(r[1] or "") < 1000] + [(90, "ſhort item only six worKs here"), (-(1 << 63), items[0][1]), ((1 << 63) - 1, None)]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as words", "2 as wid", "3 as h")
    out = decontaminate.contamination(documents(docs, extra=True), bench, share=share, broadcast_rows=limit)
    assert rows_of(out) == brute_contamination(docs, items, share=share)


def test_contamination_of_long_empty_and_missing(spark, documents, awkward, leaked):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontaminate.contamination(documents(awkward), none).collect()} == {False}
    assert decontaminate.contamination(documents(awkward), none).count() == len(awkward)
    bench = spark.createDataFrame([(7, " ".join(f"w{k % 977}" for k in range(40)))], "item_id long, text string")
    assert rows_of(decontaminate.contamination(documents(awkward), bench)) == brute_contamination(awkward, [(7, " ".join(f"w{k % 977}" for k in range(40)))])
    assert decontaminate.contamination(documents([]), bench).count() == 0
    clean = decontaminate.clean_documents(documents(awkward, extra=True), bench)
    assert "_copy" in clean.columns and sorted(r.doc_id or 0 for r in clean.collect()) == sorted(r[0] or 0 for r in awkward if r[0] not in (8, 9))
    spans = {(r.start, r.stop, r.item_id) for r in decontaminate.benchmark_spans(documents([(1, "x " + " ".join(f"w{k}" for k in range(12)))]), bench).collect()}
    assert spans == {(1, 11, 7), (2, 12, 7), (3, 13, 7)}


# --- vector-approximation file ----------------------------------------------------------------------------------


def brute_clusters(rows, dims, clusters, rounds):
    kept = [(i, [math.floor(64 * np.float64(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    cents = [v for _, v in first[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    pick = lambda v: min(range(len(cents)), key=lambda c: (far(v, cents[c]), c))
    for _ in range(rounds):
        own = [pick(v) for _, v in kept]
        for c in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine)]
    own = [(i, pick(v), v) for i, v in kept]
    inertia = [sum(far(v, cents[o]) for _, o, v in own if o == c) for c in range(len(cents))]
    return sorted((i is not None, i or 0, o, far(v, cents[o]), inertia[o], sum(inertia), hashlib.sha256(",".join(map(str, cents[o])).encode()).hexdigest()) for i, o, v in own)


def vector_rows(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    return [(k, (centres[k % 5] + rng.normal(size=dims) * spread).astype(np.float32).tolist(), 1) for k in range(n)]


@pytest.mark.parametrize(("bits", "limit"), [(1, 100_000), (5, 100_000), (5, 2), (8, 100_000)])
def test_clusters_match_brute_force(spark, bits, limit):
    dims = 8
    rows = vector_rows(150, dims, bits) + [(500 + k, [0.5] * dims, 1) for k in range(60)] + [(None, [0.25] * dims, 1), (None, [0.25] * dims, 1), (3, [-1e3] * dims, 1)]
    rows += [(900, None, 1), (901, [1.0] * 7, 1), (902, [None] + [1.0] * 7, 1), (903, [float("nan")] * dims, 1), (904, [float("inf")] + [0.0] * 7, 1), (905, [], 1)]
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as row", "2 as cluster", "3 as cells", "4 as v")
    out = vafile.cluster_vectors(table, dims, 6, 3, bits=bits, broadcast_rows=limit).collect()
    got = sorted((r.vec_id is not None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out)
    assert got == brute_clusters(rows, dims, 6, 3)


def test_clusters_of_few_equal_and_no_vectors(spark):
    few = [(1, [1.0, 2.0], 0), (2, [5.0, 2.0], 0)]
    for rows in (few, [(k, [1.0, 1.0], 0) for k in range(9)]):
        out = vafile.cluster_vectors(spark.createDataFrame(rows, VECTORS), 2, 4, 3).collect()
        assert sorted((True, r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out) == brute_clusters(rows, 2, 4, 3)
    assert vafile.cluster_vectors(spark.createDataFrame([], VECTORS), 2, 4, 3).count() == 0
    with pytest.raises(Exception, match="beyond"):
        vafile.cluster_vectors(spark.createDataFrame([(1, [1e30, 0.0], 0)], VECTORS), 2, 4, 3).count()


def test_cells_are_narrow_where_the_numbers_are():
    flat = [round(k * 70 / 64) - 35 for k in range(1, 64)]
    starts = vafile.cell_starts(-35, flat, 35)
    assert len(starts) <= 64 and max(b - a for a, b in zip(starts, starts[1:])) <= 2
    tailed = vafile.cell_starts(-(10**9), flat, 10**12)
    assert len(tailed) <= 64 and sum(b - a <= 3 for a, b in zip(tailed, tailed[1:])) > 50
    assert vafile.cell_starts(5, [5, 5, 5], 5) == [5] and vafile.cell_starts(0, [1], 3)[0] == 0


def test_intervals_decide_without_vectors():
    """Cells alone settle well separated vectors: an interval that is never wide enough to overlap."""
    x = np.array([[0, 0], [1, 1], [100, 100], [101, 99]])
    borders = vafile.Borders({0: [0, 50, 100, 101], 1: [0, 50, 99, 100]}, 2, 4)
    left = vafile.enclosed(borders.codes(x), borders.tables(np.array([[0, 0], [100, 100]])))
    assert left.tolist() == [[True, False]] * 2 + [[False, True]] * 2
    codes = np.random.default_rng(1).integers(0, 32, (7, 5))
    assert (vafile.unpack_cells(vafile.pack_cells(codes, 5), 5, 5) == codes).all()


# --- whitening --------------------------------------------------------------------------------------------------


def checked_whitening(spark, rows, wanted, tolerance=1e-8):
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as e", "2 as n", "3 as component"), wanted).collect()
    kept = [(i, [math.floor(64 * np.float64(np.float32(x))) + 1_000_000 for x in v]) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([v for _, v in kept], np.int64)
    n, sums = len(x), x.sum(axis=0)
    z = (x - sums / n).astype(float)
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1], v[:, ::-1]
    rank = int((e > 1e-9 * max(e[0], 1)).sum())
    k = min(wanted, rank)
    assert len(out) == n * k
    deviation = {i: set() for i, _ in kept}
    for (i, w), d in zip(kept, ((n * x - sums).astype(object) ** 2).sum(axis=1)):
        deviation[i].add(int(d))
    got = {}
    for r in out:
        assert r.n == n and r.deviation in deviation[r.vec_id] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        got.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r.whitened)
    for c in range(1, k + 1):
        want, sign = z @ v[:, c - 1] / np.sqrt(e[c - 1]), 0
        have = np.array([got[c][i][0] for i, _ in kept])
        sign = 1 if want @ have > 0 else -1
        apart = min([abs(e[c - 1] - e[j]) for j in range(len(e)) if j != c - 1], default=1)
        if apart > 1e-6 * e[0]:
            assert np.abs(want - sign * have).max() < tolerance
    w = np.array([[got[c][i][0] for c in range(1, k + 1)] for i, _ in kept])
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9


def test_whitening_matches_eigh(spark):
    rows = [(k, v, 1) for k, v, _ in vector_rows(120, 10, 4)]
    rows += [(900, None, 1), (902, [None] + [1.0] * 9, 1), (903, [float("nan")] * 10, 1), (904, [float("-inf")] + [0.0] * 9, 1), (905, [], 1)]
    checked_whitening(spark, rows, 32)
    checked_whitening(spark, rows, 3)


def test_whitening_of_deficient_and_equal_axes(spark):
    rng = np.random.default_rng(2)
    low = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 6))
    checked_whitening(spark, [(k, r.round(1).tolist(), 0) for k, r in enumerate(low[:4])], 32)
    # four axes of the same variance: one root of multiplicity four
    cross = [(2 * d + s, [(1.0 if s else -1.0) if j == d else 0.0 for j in range(4)], 0) for d in range(4) for s in range(2)]
    checked_whitening(spark, cross, 32)
    wide = [(k, [float(s) * (3.0 if d == 0 else 1.0) if j == d else 0.0 for j in range(3)], 0) for k, (d, s) in enumerate((d, s) for d in range(3) for s in (1, -1))]
    checked_whitening(spark, wide, 2)


def test_whitening_of_few_and_no_vectors(spark):
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, None, 0)], [(k, [3.0, 4.0], 0) for k in range(5)]):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (None, [2.0, 4.0], 0), (7, [1.0], 0)], VECTORS)).collect()
    assert [abs(r.whitened) for r in two] == pytest.approx([1.0, 1.0]) and {r.vec_id for r in two} == {1, None}


def test_polynomial_and_roots():
    rng = np.random.default_rng(3)
    b = rng.integers(-9, 10, (6, 6))
    a = b.T @ b
    p = (1 << 31) - 1
    lam = 12345
    want = round(np.linalg.det(lam * np.eye(6) - a))
    assert sum(int(c) * pow(lam, k, p) for k, c in enumerate(whitening.polynomial_mod(a, p))) % p == pytest.approx(want % p, abs=0) or abs(want) > 1 << 50
    # (x - 1)^2 (x - 3) (x - 10)^3
    c = [1]
    for r in (1, 1, 3, 10, 10, 10):
        c = [(c[k - 1] if k else 0) - r * (c[k] if k < len(c) else 0) for k in range(len(c) + 1)]
    assert whitening.square_free(c) == [-30, 43, -14, 1]
    assert [(r / 2**s, m) for r, s, m in whitening.largest_roots(c, 6)] == [(10, 3), (3, 1), (1, 2)]
    assert whitening.roots_above(c, 3) == 3 and whitening.roots_above(c, 0) == 6

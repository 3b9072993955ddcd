import hashlib

import numpy as np
from pyspark.sql import functions as F

from strideline.functions import vectors as V
from strideline.operators import aggregate as G
from strideline.operators import sequence as S
from strideline.operators import timeseries as ts
from strideline.operators.scan import ordered_scan, quantiles
from strideline.operators.spectrum import spectrum_features


def test_segmented_scan_equals_plain_window(spark):
    d = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 200).alias("t"), F.col("id").alias("v")).withColumn("seg", F.floor(F.col("t") / 10))
    a = ordered_scan(d, ["k"], ["t"], "seg", prev=["v"], next=["v"], row="n").drop("seg")
    b = ordered_scan(d, ["k"], ["t"], None, prev=["v"], next=["v"], row="n").drop("seg")
    assert sorted(map(tuple, a.select("k", "t", "prev_v", "next_v", "n").fillna(-1).collect())) == sorted(map(tuple, b.select("k", "t", "prev_v", "next_v", "n").fillna(-1).collect()))


def test_quantiles_match_numpy(spark):
    x = np.random.default_rng(0).normal(size=101)
    d = spark.createDataFrame([(1, float(v)) for v in x], "k int, v double")
    r = quantiles(d, ["k"], "v", {"a": 0.1, "b": 0.5}).first()
    assert abs(r["a"] - np.percentile(x, 10)) < 1e-12 and abs(r["b"] - np.percentile(x, 50)) < 1e-12


def test_long_series_spectrum_equals_direct(spark):
    x = np.random.default_rng(1).normal(size=37)
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, t int, v double").withColumn("seg", F.floor(F.col("t") / 8))
    a = spectrum_features(d, ["k"], ["t"], "v").first()
    b = spectrum_features(d, ["k"], ["t"], "v", "seg", direct=10).first()
    assert abs(a["low_share"] - b["low_share"]) < 1e-9 and a["peak_bin"] == b["peak_bin"]


def test_event_exactly_at_the_gap_joins_the_session(spark):
    d = spark.createDataFrame([("a", 1, 0, 0), ("a", 2, 10, 10), ("a", 3, 21, 21)], "k string, id int, s int, e int").withColumn("seg", F.floor(F.col("s") / 5))
    got = {r["id"]: r["b"] for r in ts.gap_sessions(d, ["k"], "s", "e", "id", 10, "b", "seg").collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_gravity_is_recovered_and_sign_does_not_matter(spark):
    q = [0.5, 0.5, 0.5, 0.5]
    d = spark.range(1)
    for sign in (1, -1):
        r = d.select(*V.rotate_to_world([F.lit(sign * x) for x in q], [F.lit(0.0), F.lit(1.0), F.lit(0.0)])).first()
        assert np.allclose(list(r), [0, 0, 1])


def test_empty_file_list_digest(spark):
    d = spark.createDataFrame([("c", None)], "k string, name string")
    assert G.list_digest(d, ["k"], "name").first()["digest"] == hashlib.sha1(b"").hexdigest()


def test_viterbi_flips_only_with_weight(spark):
    rows = [("g", 1, 0, [0.98, 0.01, 0.01]), ("g", 2, 1, [0.01, 0.45, 0.54])]
    d = spark.createDataFrame(rows, "g string, id long, t long, probs array<double>").withColumn("seg", F.lit(0))
    packed = S.pack_sequences(d, "g", ["t"], "id", "probs", "seg")
    trans = np.log(np.array([[1, 11, 1], [1, 1, 1], [1, 1, 1]]) / np.array([[13], [3], [3]]))
    for w, want in ((0.0, [0, 2]), (2.0, [0, 1])):
        got = S.viterbi_decode(packed, "g", "id", np.zeros(3), trans, w).orderBy("id").collect()
        assert [r["decoded"] for r in got] == want


def _tied_rows(spark):
    from pyspark.sql import functions as F

    rows = [(g, i, g * 1000 + i, [0.4, 0.4, 0.2] if i % 3 else [0.2, 0.4, 0.4]) for g, n in ((1, 1), (2, 2), (3, 4), (4, 9), (5, 40)) for i in range(n)]
    return spark.createDataFrame(rows, "g long, i long, s long, probs array<double>").withColumn("seg", F.floor(F.col("i") / 3))


def test_viterbi_ties_fall_alike_whatever_the_chunk(spark):
    import numpy as np

    from strideline.operators import sequence as S

    rows = _tied_rows(spark)
    trans = np.log(np.array([[0.4, 0.4, 0.2], [0.4, 0.2, 0.4], [0.2, 0.4, 0.4]]))
    out = []
    for chunk in (4096, 2, 3):
        packed = S.pack_sequences(rows, "g", ["i"], "s", "probs", "seg", chunk)
        got = S.viterbi_decode(packed, "g", "s", np.zeros(3), trans, 1.0, chunk=chunk).collect()
        out.append({r.s: r.decoded for r in got})
    assert len(out[0]) == 56 and out[0] == out[1] == out[2]


def test_distinct_assignment_of_groups_larger_than_the_classes(spark):
    from itertools import permutations

    import numpy as np

    from strideline.operators.assignment import group_distinct_assignment

    rng = np.random.default_rng(4)
    table = rng.dirichlet(np.ones(3), 7)
    rows = [(1, k, p.tolist()) for k, p in enumerate(table)] + [(2, 100, [0.2, 0.5, 0.3])]
    got = group_distinct_assignment(spark.createDataFrame(rows, "g long, s long, probs array<double>"), "g", "s", "probs", 3).collect()
    solved = {r.s: r.assigned for r in got if r.solved}
    assert sorted(solved.values()) == [0, 1, 2]
    best = min(sum(-np.log(table[r, c] + 1e-9) for c, r in enumerate(pick)) for pick in permutations(range(7), 3))
    assert abs(sum(-np.log(table[s, c] + 1e-9) for s, c in solved.items()) - best) < 1e-9
    assert all(r.assigned == int(np.argmax(r.probs)) for r in got if not r.solved) and len(got) == 8


def test_scans_keep_null_keys_null_times_and_empty_tables(spark):
    from pyspark.sql import functions as F

    from strideline.operators.scan import count_breaks, neighbours, ordered_scan, quantiles, ranked
    from strideline.operators.timeseries import asof_nearest, covering_interval

    rows = [("a", 1.0, 1), ("a", 5.0, 2), ("a", None, 3), (None, 2.0, 4), (None, 9.0, 5), (None, None, 6), ("b", 2.5, 7)]
    d = spark.createDataFrame(rows, "k string, t double, id long").withColumn("seg", F.floor(F.col("t") / 2))
    for table in (d, d.limit(0)):
        n = table.count()
        scanned = ordered_scan(table, ["k"], ["t", "id"], "seg", prev=["id"], next=["id"], row="row")
        plain = ordered_scan(table, ["k"], ["t", "id"], None, prev=["id"], next=["id"], row="row")
        key = lambda x: sorted(map(str, ((r.id, r.prev_id, r.next_id, r.row) for r in x.collect())))
        assert key(scanned) == key(plain)
        assert count_breaks(table, ["k"], ["t", "id"], "seg", ["t"], lambda c, p: c["t"] - p["t"] > 3, "block").count() == n
        assert ranked(table.filter("t is not null"), ["k"], "t", ["id"], "rk").count() == table.filter("t is not null").count()
        assert quantiles(table, ["k"], "t", {"m": 0.5}).count() == table.filter("t is not null").select("k").distinct().count()
        near = neighbours(table.withColumn("mark", F.col("id") % 2 == 1), ["k"], ["t", "id"], "seg", "mark", [])
        assert near.count() == n and near.filter("t is null and (before is not null or after is not null)").count() == 0
        got = asof_nearest(table.select("k", "t", "id"), d.select("k", "t", F.col("id").alias("tie")), ["k"], "t", "tie", [], 10.0, 2.0)
        assert got.count() == n and got.filter("t is null and matched_t is not null").count() == 0
        ranges = d.filter("t is not null").select("k", F.col("t").alias("lo"), (F.col("t") + 1).alias("hi"))
        inside = covering_interval(table.select("k", "t", "id"), ranges, ["k"], "t", "lo", "hi", 2.0)
        assert inside.count() == n and inside.filter("covered").count() == table.filter("t is not null").count()


def test_gate_writes_template_labels_and_falls_back(spark):
    from strideline.operators import sequence as S

    rows = spark.createDataFrame([(1, 1, 9), (1, 2, 9), (2, 1, 8), (3, 1, 7)], "g long, pos long, base int")
    gated = spark.createDataFrame([(1, [4, 5], True), (2, [6], False)], "g long, labels array<int>, accepted boolean")
    got = {(r.g, r.pos): (r.pred, r.from_template) for r in S.apply_gate(rows, gated, "g", "pos", "base").collect()}
    assert got == {(1, 1): (4, True), (1, 2): (5, True), (2, 1): (8, False), (3, 1): (7, False)}


def test_covering_batches_hold_every_row(spark):
    from collections import Counter, defaultdict

    from strideline.operators.sampling import covering_batches

    # a common class, a scarce one, one that a single subject has nearly all of, one of three rows, one of one subject
    sizes = {0: [9] * 20, 1: [2, 3], 2: [61, 1, 1], 3: [2, 1], 4: [7]}
    rows, eligible = [], set()
    for label, users in sizes.items():
        for u, n in enumerate(users):
            for _ in range(n):
                if label != 4:
                    eligible.add(len(rows))
                rows.append((len(rows), label, u))
    rows.append((len(rows), None, 1))
    d = spark.createDataFrame(rows, "id long, label int, subject int")
    out = covering_batches(d, "label", "subject", "id", 3, 4, 5).collect()
    assert {r["id"] for r in out} == eligible
    cells = defaultdict(list)
    for r in out:
        cells[r["batch"], r["label"]].append(r)
    batches = Counter(b for b, _ in cells)
    assert set(batches.values()) == {3} and sorted(batches) == list(range(45))  # 180 rows of class 0, 4 a batch
    for (_, label), x in cells.items():
        assert len(x) == 4 and len({r["subject"] for r in x}) >= 2
        assert len({r["id"] for r in x}) == (3 if label == 3 else 4)
    assert sorted(out) == sorted(covering_batches(d.repartition(5), "label", "subject", "id", 3, 4, 5).collect())

"""The SQL decode takes partitions of many recordings and decodes them in blocks."""

import numpy as np

from strideline.functions import tables
from strideline.operators import sequence as S


def test_recordings_that_share_a_partition_are_decoded_each_for_itself(spark):
    rng, c = np.random.default_rng(3), 3
    rows = [(g if g else None, t, 100 * g + t, rng.dirichlet(np.ones(c)).tolist(), 0, g % 2) for g in range(40) for t in range(1 + g % 7)]
    d = spark.createDataFrame(rows, "g long, t long, id long, probs array<double>, seg int, bucket int")
    trans = np.log(rng.dirichlet(np.ones(c), c))
    want = {r.id: r.decoded for r in S.viterbi_decode(S.pack_sequences(d.filter("g is not null"), "g", ["t", "id"], "id", "probs", "seg"), "g", "id", np.zeros(c), trans, 0.7).collect()}
    tables.register(spark)
    scores = ", ".join(f"{x!r}D" for x in trans.ravel().tolist())
    got = spark.sql(f"select * from viterbi_decode(table(select * from {{d}}) partition by bucket order by (g, t), 'id', 'probs', array({scores}), 0.7D, 'g')", d=d).collect()
    assert len(got) == len(rows) and {r.id: r.decoded for r in got if r.id >= 100} == want


def test_blocks_end_between_recordings(monkeypatch):
    monkeypatch.setattr(tables, "BLOCK", 4)
    rng = np.random.default_rng(4)
    rows = [{"g": g, "id": 10 * g + t, "p": rng.dirichlet(np.ones(2)).tolist()} for g in range(6) for t in range(3)]
    scores, f, out, held = [0.0, -1.0, -2.0, 0.0], tables.ViterbiDecode(), [], 0
    for r in rows:
        out += list(f.eval(r, "id", "p", scores, 1.0, "g"))
        held = max(held, len(f.ids))
    out += list(f.terminate())
    assert held == 6 and [i for i, _ in out] == [r["id"] for r in rows]
    for g in range(6):
        alone = tables.ViterbiDecode()
        for r in rows[3 * g : 3 * g + 3]:
            list(alone.eval(r, "id", "p", scores, 1.0))
        assert list(alone.terminate()) == out[3 * g : 3 * g + 3]

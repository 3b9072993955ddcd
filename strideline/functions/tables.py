"""Table functions for SQL: decoding of partitioned, ordered tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from strideline.operators import sequence as S


BLOCK = 65536  # rows after which the recordings of a partition that are complete are decoded


class ViterbiDecode:
    """viterbi_decode(TABLE (rows) PARTITION BY recording ORDER BY time, 'id', 'probs', scores, weight[, 'recording']): `id, decoded`.

    `id` and `probs` name columns of the table; the id keeps its type. `scores` holds the C x C transition scores row by
    row. The label of every row on the best path of its recording is given. A partition is one recording, or, with the
    column that names the recording, many whole ones, ordered by it first; these are decoded in blocks of about BLOCK
    rows. A recording is held whole.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, sample: AnalyzeArgument, probs: AnalyzeArgument, scores: AnalyzeArgument, weight: AnalyzeArgument, recording: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise Exception("viterbi_decode needs a table as its first argument")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        for name in (sample.value, probs.value, *([recording.value] if recording else [])):
            if name not in kinds:
                raise Exception(f"viterbi_decode: the table has no column {name}")
        return AnalyzeResult(T.StructType([T.StructField(sample.value, kinds[sample.value]), T.StructField("decoded", T.IntegerType())]))

    def __init__(self):
        self.ids: list = []
        self.rows: list = []
        self.starts: list[int] = []
        self.here = None
        self.model: tuple | None = None

    def eval(self, row: Row, sample: str, probs: str, scores: list, weight: float, recording: str | None = None) -> Iterator[tuple]:
        key = row[recording] if recording else None
        if not self.ids or key != self.here:
            if len(self.ids) >= BLOCK:
                yield from self.decoded()
            self.starts.append(len(self.ids))
            self.here = key
        self.ids.append(row[sample])
        self.rows.append(row[probs])
        self.model = (scores, weight)

    def decoded(self) -> Iterator[tuple]:
        """The rows gathered so far, which are whole recordings, with their labels."""
        scores, weight = self.model
        c = int(round(len(scores) ** 0.5))
        e = np.log(np.clip(np.asarray(self.rows, dtype=np.float64), 1e-12, 1.0))
        moves = float(weight) * np.asarray(scores, dtype=np.float64).reshape(c, c)
        path = S.best_paths(e, np.diff([*self.starts, len(e)]), moves, np.zeros(c))
        ids, self.ids, self.rows, self.starts = self.ids, [], [], []
        yield from zip(ids, path.tolist())

    def terminate(self) -> Iterator[tuple]:
        if self.ids:
            yield from self.decoded()


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL."""
    spark.udtf.register("viterbi_decode", udtf(ViterbiDecode))

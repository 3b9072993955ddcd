"""Streaming twins of the batch operators. Every job reads and writes through Structured Streaming,
bounds its state with a watermark and can be run to the end of what is there (`availableNow`)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strideline.operators.sequence import best_paths
from strideline.session import ensure_checkpoint_dir


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over all available input into a Parquet folder and read it back."""
    spark = stream.sparkSession
    base = workspace(spark, name)
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/offsets").option("path", f"{base}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def gap_sessions(events: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of point events, emitted once the watermark passes their end; an event exactly at the
    gap still joins. Later events than `late` behind the newest are dropped."""
    return (
        events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .select(*keys, "n", "first_ts", "last_ts")
    )


def window_counts(events: DataFrame, ts: str, label: str, size: str, slide: str | None, late: str) -> DataFrame:
    """Label counts per tumbling (or sliding) window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    d = events.withWatermark(ts, late).groupBy(w.alias("w"), label).agg(F.count("*").alias("n"))
    return d.select(F.col("w.start").alias("start"), label, "n")


def clip_metadata(events: DataFrame, clip: str, event_id: str, ts: str, kind: str, kinds: list[str], late: str, name: str) -> DataFrame:
    """Clip metadata, each event counted once: repeats within the watermark are dropped, every micro-batch
    overwrites its own folder of partial aggregates (so a repeated batch changes nothing), and partials
    are merged when read."""
    spark = events.sparkSession
    base = workspace(spark, name)
    parts = [F.count(F.when(F.col(kind) == k, 1)).alias(f"n_{k}") for k in kinds]

    def write(batch: DataFrame, batch_id: int) -> None:
        g = batch.groupBy(clip).agg(F.min(ts).alias("t0"), F.max(ts).alias("t1"), *parts)
        g.write.mode("overwrite").parquet(f"{base}/partials/batch={batch_id}")

    d = events.withWatermark(ts, late).dropDuplicatesWithinWatermark([event_id])
    q = d.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    partial = spark.read.parquet(f"{base}/partials")
    return partial.groupBy(clip).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in kinds])


def decode_closed_recordings(clips: DataFrame, group: str, ts: str, close_ms: str, sample: str, probs: str, start: np.ndarray, trans: np.ndarray, weight: float, late: str,
                             start_weight: float = 0.0, slots: int = 1024) -> DataFrame:
    """Best label paths of recordings, emitted when the watermark passes a recording's closing time (the same in all its
    rows), or with the next step of the watermark where it already has. Start scores weigh in by `start_weight`, as in
    `viterbi_decode`.

    Recordings are dealt over `slots` by a hash; state is a slot's clips of one closing time, which are decoded together
    and dropped with the emission.
    """
    c = trans.shape[0]
    moves, entry = weight * trans, start_weight * start
    gtype = dict(clips.dtypes)[group]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        groups, ids, times, flat = [list(x) for x in state.get] if state.exists else ([], [], [], [])
        if state.hasTimedOut:
            codes, _ = pd.factorize(pd.Series(groups, dtype=object), use_na_sentinel=False)
            order = np.lexsort((np.asarray(ids), np.asarray(times), codes))
            lens = np.bincount(codes)
            path = best_paths(np.log(np.clip(np.asarray(flat).reshape(-1, c)[order], 1e-12, 1.0)), lens, moves, entry)
            state.remove()
            pos = np.arange(len(order)) - np.repeat(np.cumsum(lens) - lens, lens) + 1
            yield pd.DataFrame({group: [groups[i] for i in order], "pos": pos, sample: [ids[i] for i in order], "decoded": path})
            return
        for pdf in batches:
            groups += pdf[group].tolist()
            ids += pdf[sample].tolist()
            times += pdf["_us"].tolist()
            flat += np.concatenate(list(pdf[probs])).tolist()
        state.update((groups, ids, times, flat))
        state.setTimeoutTimestamp(max(int(key[1]), state.getCurrentWatermarkMs() + 1))

    d = clips.withWatermark(ts, late).withColumns({"_us": F.unix_micros(F.col(ts).cast("timestamp")), "_slot": F.pmod(F.xxhash64(group), F.lit(slots)).cast("int")})
    return d.groupBy("_slot", close_ms).applyInPandasWithState(
        step, f"{group} {gtype}, pos int, {sample} bigint, decoded int", f"groups array<{gtype}>, ids array<bigint>, times array<bigint>, flat array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )

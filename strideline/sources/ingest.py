"""From file listings and messy text to tidy long tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.functions.text import parse_timestamp, timestamp_from_name

# fixed values: file-tree modalities, device prefixes in match order, and header aliases per channel
MODALITIES = ["IR", "Depth_Color", "Thermal", "Skeleton", "IMU", "Radar"]
DEVICE_PREFIXES = ["WTLA", "WTRA", "WTLL", "WTRL", "WTC"]
HEADER_ALIASES = {
    "acc_x": ["加速度X", "AccX"], "acc_y": ["加速度Y", "AccY"], "acc_z": ["加速度Z", "AccZ"],
    "gyr_x": ["角速度X", "AsX"], "gyr_y": ["角速度Y", "AsY"], "gyr_z": ["角速度Z", "AsZ"],
    "ang_x": ["角度X", "AngleX"], "ang_y": ["角度Y", "AngleY"], "ang_z": ["角度Z", "AngleZ"],
    "mag_x": ["磁场X", "HX"], "mag_y": ["磁场Y", "HY"], "mag_z": ["磁场Z", "HZ"],
    "q0": ["四元数0", "Q0"], "q1": ["四元数1", "Q1"], "q2": ["四元数2", "Q2"], "q3": ["四元数3", "Q3"],
}
PERSON_JOINTS = 17


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths, sizes and times of all files below a folder; the contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("bytes"), "modificationTime")


def index_clips(files: DataFrame, path: str, root_parts: Column, modalities: Sequence[str]) -> DataFrame:
    """One row per (clip, modality) of a listing.

    `root_parts` is the array of path components below the tree's root: [clip, modality, ...]. Hidden
    folders and archive leftovers are skipped, and so is a folder without a known modality.
    """
    d = files.withColumn("_p", root_parts).filter(F.size("_p") >= 2)
    clip, modality = F.col("_p")[0], F.col("_p")[1]
    keep = ~clip.startswith(".") & (clip != "__MACOSX") & modality.isin(list(modalities))
    return d.filter(keep).groupBy(clip.alias("sample_id"), modality.alias("modality")).agg(F.count("*").alias("n_files"), F.min(path).alias("first_path"))


def index_training_clips(files: DataFrame, root_parts: Column) -> DataFrame:
    """The training layout [modality, class_name, user, trial, ...]: ids, class, user, trial, station."""
    p = F.col("_p")
    cls = F.split(p[1], "_")[0].try_cast("int")
    d = files.withColumn("_p", root_parts).filter(F.size("_p") >= 4).withColumns({"class_id": cls, "user": p[2], "trial": p[3], "modality": p[0]})
    d = d.filter(F.col("class_id").isNotNull())
    sid = F.concat_ws("_", F.lpad(F.col("class_id").cast("string"), 2, "0"), "user", "trial")
    return d.groupBy(sid.alias("sample_id"), "class_id", "user", "trial", F.split("trial", "-")[0].alias("station"), "modality").agg(F.count("*").alias("n_files"))


def frame_times(files: DataFrame, name: str) -> DataFrame:
    """Only the frames whose name carries a time."""
    return files.withColumn("t", timestamp_from_name(name)).filter(F.col("t").isNotNull())


def resolve_headers(headers: DataFrame, key: str, names: str, aliases: Mapping[str, Sequence[str]] = HEADER_ALIASES, least: int = 16) -> DataFrame:
    """(key, columns map channel -> position) from an array of header names; first header containing any
    alias wins, and a file that resolves fewer than `least` channels is dropped."""
    def find(alts):
        hits = F.transform(F.col(names), lambda h, i: F.when(F.exists(F.array(*[F.lit(a) for a in alts]), lambda a: F.contains(h, a)), i))
        return F.array_min(F.array_compact(hits))

    pairs = F.array(*[F.struct(F.lit(c).alias("key"), find(a).alias("value")) for c, a in aliases.items()])
    d = headers.select(key, F.filter(pairs, lambda p: p["value"].isNotNull()).alias("_f"))
    return d.filter(F.size("_f") >= least).select(key, F.map_from_entries("_f").alias("columns"))


def device_of(text, prefixes: Sequence[str] = DEVICE_PREFIXES) -> Column:
    """The first known prefix of a device name, NULL for a stranger."""
    t, out = (F.col(text) if isinstance(text, str) else text), None
    for p in prefixes:
        out = F.when(t.startswith(p), F.lit(p)) if out is None else out.when(t.startswith(p), F.lit(p))
    return out


def sensor_rows(lines: DataFrame, key: str, cells: str, columns: str, channels: Sequence[str], device: Column | None = None) -> DataFrame:
    """Split rows into (key, device, t, channels): short rows, unknown devices, bad times and cells that
    are not numbers are dropped. Cell 0 is the time, cell 1 the device."""
    # the cells and the values are each bound by exploding an array of one, below which no filter is pushed: cells are cut
    # and cast once per line, not once more for every column and every condition
    c, m = F.col("_c"), F.col(columns)
    longest = F.array_max(F.map_values(m))
    who = device if device is not None else device_of(c[1])
    d = lines.withColumn("_c", F.explode(F.array(cells))).filter((F.size(c) > longest) & (F.size(c) > 1))
    values = F.struct(who.alias("device"), parse_timestamp(c[0]).alias("t"), *[F.trim(F.get(c, m[ch])).try_cast("double").alias(ch) for ch in channels])
    d = d.select(key, F.explode(F.array(values)).alias("_r")).select(key, "_r.*")
    return d.filter(reduce(Column.__and__, [F.col(x).isNotNull() for x in ("t", "device", *channels)]))


def split_cells(line: Column) -> Column:
    """Cells of a CSV line: commas inside double quotes part nothing, outer quotes go, and doubled ones are single."""
    # a comma parts cells where an even number of quotes comes after it; a line holds no line break, so that can mark the cuts
    cut = lambda p: F.transform(p, lambda x, i: F.when((F.size(p) - i) % 2 == 1, F.translate(x, ",", "\n")).otherwise(x))
    pieces = F.transform(F.array(F.split(line, '"')), cut)[0]
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r'^\s*"|"\s*$', ""), '""', '"')
    return F.transform(F.split(F.array_join(pieces, '"'), "\n"), lambda c: F.when(F.contains(c, F.lit('"')) & c.rlike(r'^\s*".*"\s*$'), bare(c)).otherwise(c))


def read_sensor_csv(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]] = HEADER_ALIASES, pattern: str = "*.csv") -> DataFrame:
    """Sensor files as (path, device, t, one column per channel of `aliases`).

    Files are split by line. A file's header is its first line: the one of the block at offset 0 that comes first in it.
    A file whose header misses a channel is dropped, and so is a file without a header.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") == 0).alias("_head"), F.monotonically_increasing_id().alias("_at"), "value")
    heads = lines.filter("_head").groupBy("path").agg(F.min(F.struct("_at", "value")).alias("_h"))
    heads = heads.select(F.struct("path", F.col("_h._at").alias("_first")).alias("_file"), split_cells(F.col("_h.value")).alias("names"))
    cols = resolve_headers(heads, "_file", "names", aliases, len(aliases)).select("_file.*", "columns")
    body = lines.join(cols, "path").filter(F.col("_at") != F.col("_first")).withColumn("cells", split_cells(F.col("value")))
    return sensor_rows(body, "path", "cells", "columns", list(aliases))


PERSONS_SCHEMA = "array<struct<keypoints:array<array<double>>>>"


def joints_long(frames: DataFrame, keys: Sequence[str], text: str, joints: int = PERSON_JOINTS) -> DataFrame:
    """(keys, person, joint, x, y, z) of the persons with exactly `joints` joints, numbered as kept."""
    people = F.filter(F.from_json(text, PERSONS_SCHEMA), lambda p: F.size(p["keypoints"]) == joints)
    d = frames.select(*keys, F.posexplode(people).alias("person", "_p")).select(*keys, "person", F.posexplode("_p.keypoints").alias("joint", "_k"))
    return d.select(*keys, "person", "joint", *[F.col("_k")[i].alias(n) for i, n in enumerate("xyz")])


def person_counts(frames: DataFrame, keys: Sequence[str], text: str, joints: int = PERSON_JOINTS) -> DataFrame:
    """(keys, n_persons); a frame whose text does not parse is dropped."""
    parsed = F.from_json(text, PERSONS_SCHEMA)
    d = frames.withColumn("_j", parsed).filter(F.col("_j").isNotNull())
    return d.select(*keys, F.size(F.filter("_j", lambda p: F.size(p["keypoints"]) == joints)).alias("n_persons"))


def merge_files(tables: Sequence[DataFrame]) -> DataFrame:
    """The rows of several files of a clip as one table; order is given by (t, tie) where it is used."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def clip_metadata(streams: DataFrame, clip: str, kind: str, t: str, persons: str | None = None, devices: Sequence[str] = ()) -> DataFrame:
    """One row per clip from a long stream table (clip, kind, t): bounds over all sensors, frames per
    kind, most persons in a frame, device list. All aggregates combine map-side."""
    n = lambda k: F.count(F.when(F.col(kind) == k, 1))
    seen = [F.when(F.max((F.col(kind) == d).cast("int")) == 1, F.lit(d)) for d in devices]
    aggs = [F.min(t).alias("t0"), F.max(t).alias("t1"), *[n(k).alias(f"n_{k}") for k in ("depth", "ir", "skel")], F.concat_ws("|", *seen).alias("devices")]
    if persons:
        aggs.append(F.coalesce(F.max(persons), F.lit(0)).alias("max_persons"))
    return streams.groupBy(clip).agg(*aggs)


def pending(index: DataFrame, sink: DataFrame, key: str) -> DataFrame:
    """Rows whose key the sink does not hold yet."""
    return index.join(sink.select(key).distinct(), key, "left_anti")


def append_new(index: DataFrame, path: str, key: str, build) -> int:
    """Build what is missing in a Parquet folder and append it; returns the rows added.

    The new rows are written once and counted from what was written.
    """
    spark = index.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)
    before = spark.read.parquet(path) if exists else None
    n0 = before.count() if exists else 0
    todo = pending(index, before, key) if exists else index
    build(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - n0


def modality_census(index: DataFrame, clip: str, modality: str) -> DataFrame:
    """Clips that have any file, per modality."""
    return index.groupBy(modality).agg(F.count_distinct(clip).alias("n_clips"))


def storage_estimate(sizes: DataFrame, bytes_col: str, clips: DataFrame, upper_bytes: int) -> DataFrame:
    """Mean size of what exists times the number of clips, beside an upper bound."""
    s = sizes.agg(F.count("*").alias("existing"), F.avg(bytes_col).alias("mean_bytes"))
    n = clips.agg(F.count("*").alias("n")).scalar()
    return s.withColumn("total_clips", n).withColumns(
        {"projected_bytes": F.bround(F.col("mean_bytes") * F.col("total_clips"), 0).cast("long"), "upper_bytes": F.col("total_clips") * F.lit(upper_bytes)}
    )

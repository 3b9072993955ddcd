"""Centroid clustering of integer vectors over a vector-approximation file.

Every vector is written once with its *cells*: per dimension the number of the interval it lies in, `bits` bits each,
packed. Interval borders come from quantile sketches and exact extremes of the dimension (see `cell_starts`). For given centroids, tables
of (dimension, cell, centroid) hold the least and largest squared difference; summed over the dimensions they enclose
every distance. A vector whose interval for one centroid ends before all others begin is assigned by its cells alone.

- First and last assignment need all vectors anyway (sums, distances): one scan of cells and vectors, no join; exact
  distances only where intervals overlap.
- Rounds between read cells and the assignment before. Only vectors with overlapping intervals or another centroid
  than before are *fetched*; they alone change the sums, which are kept exactly. The fetch list is broadcast up to
  `broadcast_rows` rows, so that full vectors are filtered where they lie; beyond it is a join on the row number.

Sums are added per task and dimension before they are shuffled, so that a cluster with most rows is no hot key. The
driver holds the centroids and sums: `clusters` times the dimensions, whatever the number of rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import stored
from strideline.llm.intvectors import SCALE, floors, is_finite, vector_of
from strideline.llm.tokens import batches_of

BITS = 6
BATCH = 2048
# distances of vectors up to this many units per entry fit a long in up to 512 dimensions
LARGEST = float(1 << 26)
BROADCAST_ROWS = 100_000
SUMS = "row long, cells binary, cluster int, count long, sums array<long>"
SUMS_ARROW = pa.schema([("row", pa.int64()), ("cells", pa.binary()), ("cluster", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.int64()))])


def pack_cells(codes: np.ndarray, bits: int) -> pa.Array:
    """One binary value per row of `codes` (rows, dims), `bits` bits per dimension."""
    planes = (codes[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1
    packed = np.packbits(planes.reshape(len(codes), -1).astype(np.uint8), axis=1)
    return pa.array([r.tobytes() for r in packed], pa.binary())


def unpack_cells(cells: pa.Array, dims: int, bits: int) -> np.ndarray:
    width = -(-dims * bits // 8)
    raw = np.frombuffer(b"".join(cells.to_pylist()), np.uint8).reshape(-1, width)
    planes = np.unpackbits(raw, axis=1)[:, : dims * bits].reshape(len(raw), dims, bits)
    return planes.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1))


class Borders:
    """Cells of each dimension: cell k begins at start[d, k] and holds the integers from low[d, k] to high[d, k]."""

    def __init__(self, ranges: dict[int, list[int]], dims: int, cells: int):
        """`ranges`: by dimension its least number, borders and its largest number."""
        self.start = np.full((dims, cells), np.iinfo(np.int64).max)
        self.low, self.high = np.zeros((dims, cells), np.int64), np.zeros((dims, cells), np.int64)
        for d, (*starts, last) in ranges.items():
            starts = np.unique(starts)
            self.start[d, : len(starts)] = self.low[d, : len(starts)] = starts
            self.high[d, : len(starts)] = [*(starts[1:] - 1), last]

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.int64)
        for d in range(x.shape[1]):
            out[:, d] = np.searchsorted(self.start[d], x[:, d], "right") - 1
        return out

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared difference by (dimension, cell, centroid)."""
        c = centroids.T[:, None, :]
        below, above = self.low[:, :, None] - c, c - self.high[:, :, None]
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(np.abs(below), np.abs(above))
        return least * least, most * most


def cell_starts(low: int, marks: list[int], high: int) -> list[int]:
    """Where the cells of one dimension begin, of `len(marks) + 1` cells from low to high; `marks` are its quantiles.

    Of cells of equal width, the same between the outer quantiles with a cell beyond each, and cells of equal counts, those
    that are narrowest on average over the quantiles: an outlier or a heavy tail takes the width from no other number.
    """
    n = len(marks) + 1
    even = lambda lo, hi, k: sorted({min(lo + -(-(hi - lo + 1) * i // k), hi) for i in range(k)})
    choices = [even(low, high, n), [low, *marks]]
    if n > 2 and low < marks[0] < marks[-1] < high:
        choices.append([low, *even(marks[0], marks[-1], n - 2), marks[-1] + 1])

    def width(starts: list[int]) -> float:
        starts = np.unique(starts)
        ends = np.append(starts[1:], high + 1)
        at = np.searchsorted(starts, marks, "right") - 1
        return float(((ends - starts)[at] - 1).mean())

    return min(choices, key=width)


def cell_borders(vectors: DataFrame, dims: int, bits: int) -> Borders:
    """Borders of vectors (e) from extremes and quantile sketches of every dimension, combined map-side; a dimension gives
    one row of 2**bits numbers."""
    cells = 1 << bits
    each = vectors.select(F.posexplode("e").alias("d", "x")).withColumn("x", F.floor(F.col("x") * SCALE))
    probs = F.array(*[F.lit(k / cells) for k in range(1, cells)])
    rows = each.groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.percentile_approx("x", probs, 10_000).alias("q")).collect()
    return Borders({r.d: [*cell_starts(r.lo, list(r.q), r.hi), r.hi] for r in rows}, dims, cells)


def approximated(embeddings: DataFrame, name: str, dims: int, bits: int) -> tuple[DataFrame, Borders]:
    """The stored file `vec_id, cells, v, row` of all vectors of `dims` finite entries, and its borders."""
    d = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector_of(name).alias("e")).filter(is_finite(F.col("e")) & (F.size("e") == dims))
    borders = cell_borders(d, dims, bits)
    schema = pa.schema([("vec_id", pa.int64()), ("cells", pa.binary()), ("v", pa.list_(pa.int64()))])

    def cells(batches):
        for big in batches:
            for b in batches_of(big, BATCH):
                x = floors(b.column(1), dims, LARGEST)
                yield pa.RecordBatch.from_arrays([b.column(0), pack_cells(borders.codes(x), bits), _lists(x)], schema=schema)

    return stored(d.mapInArrow(cells, "vec_id long, cells binary, v array<long>").withColumn("row", F.monotonically_increasing_id()), "cells"), borders


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))


def _matrix(v: pa.Array, dims: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def enclosed(codes: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(rows, centroids): whether a centroid's distance interval begins no later than every other one ends."""
    least = np.zeros((len(codes), tables[0].shape[2]), np.int64)
    most = np.zeros_like(least)
    for d in range(codes.shape[1]):
        least += tables[0][d, codes[:, d]]
        most += tables[1][d, codes[:, d]]
    return least <= most.min(axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Of the centroids left open for each row, the nearest by exact distance, the smaller number on ties."""
    out = open_.argmax(axis=1)
    rows = np.flatnonzero(open_.sum(axis=1) > 1)
    best = np.full(len(rows), np.iinfo(np.int64).max)
    for c in range(len(centroids)):
        at = np.flatnonzero(open_[rows, c])
        far = ((x[rows[at]] - centroids[c]) ** 2).sum(axis=1)
        closer = far < best[at]
        best[at[closer]] = far[closer]
        out[rows[at[closer]]] = c
    return out


def _sums(x: np.ndarray, cluster: np.ndarray, k: int, sign: int = 1) -> list[tuple]:
    """(cluster, count, sums) of a batch."""
    out = []
    for c in np.unique(cluster):
        at = cluster == c
        out.append((int(c), sign * int(at.sum()), (sign * x[at].sum(axis=0)).tolist()))
    return out


def _assigned(row: pa.Array, cells: pa.Array, cluster: np.ndarray, sums: list[tuple]) -> pa.RecordBatch:
    """Rows of an assignment, then rows without a row number that carry changes of sums."""
    n = len(sums)
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([row, pa.nulls(n, pa.int64())]),
            pa.concat_arrays([cells, pa.nulls(n, pa.binary())]),
            pa.array(np.concatenate([cluster, [s[0] for s in sums]]).astype(np.int32)),
            pa.concat_arrays([pa.nulls(len(cluster), pa.int64()), pa.array([s[1] for s in sums], pa.int64())]),
            pa.concat_arrays([pa.nulls(len(cluster), pa.list_(pa.int64())), pa.array([s[2] for s in sums], pa.list_(pa.int64()))]),
        ],
        schema=SUMS_ARROW,
    )


def first_assignment(file: DataFrame, borders: Borders, centroids: np.ndarray, bits: int) -> DataFrame:
    """`SUMS` rows of the first round, from one scan of cells and vectors."""
    tables, (k, dims) = borders.tables(centroids), centroids.shape

    def assign(batches):
        for big in batches:
            for b in batches_of(big, BATCH):
                x = _matrix(b.column(2), dims)
                cluster = nearest(x, centroids, enclosed(unpack_cells(b.column(1), dims, bits), tables))
                yield _assigned(b.column(0), b.column(1), cluster, _sums(x, cluster, k))

    return file.select("row", "cells", "v").mapInArrow(assign, SUMS)


def next_assignment(file: DataFrame, before: DataFrame, borders: Borders, centroids: np.ndarray, bits: int, broadcast_rows: int) -> DataFrame:
    """`SUMS` rows of a later round: rows decided by their cells and as before, and fetched rows with their changes."""
    tables, (k, dims) = borders.tables(centroids), centroids.shape
    schema = pa.schema([("row", pa.int64()), ("cells", pa.binary()), ("cluster", pa.int32()), ("open", pa.list_(pa.int32()))])

    def look(batches):
        for big in batches:
            for b in batches_of(big, BATCH):
                left = enclosed(unpack_cells(b.column(1), dims, bits), tables)
                was = b.column(2).to_numpy()
                settled = (left.sum(axis=1) == 1) & left[np.arange(len(was)), was]
                at, c = np.nonzero(left & ~settled[:, None])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(was)))])
                open_ = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(c.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), open_], schema=schema)

    def settle(batches):
        for big in batches:
            for b in batches_of(big, BATCH):
                x, was = _matrix(b.column(4), dims), b.column(2).to_numpy()
                left = np.zeros((len(was), k), bool)
                lists = b.column(3)
                left[np.repeat(np.arange(len(was)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
                now = nearest(x, centroids, left)
                moved = now != was
                yield _assigned(b.column(0), b.column(1), now, _sums(x[moved], was[moved], k, -1) + _sums(x[moved], now[moved], k))

    seen = stored(before.mapInArrow(look, "row long, cells binary, cluster int, open array<int>"), "intervals")
    wanted = seen.filter("size(open) > 0")
    small = wanted.limit(broadcast_rows + 1).count() <= broadcast_rows
    fetched = file.select("row", "v").join(F.broadcast(wanted) if small else wanted, "row").select("row", "cells", "cluster", "open", "v").mapInArrow(settle, SUMS)
    done = seen.filter("size(open) = 0").select("row", "cells", "cluster", F.lit(None).cast("long").alias("count"), F.lit(None).cast("array<long>").alias("sums"))
    return done.unionByName(fetched)


def last_assignment(file: DataFrame, borders: Borders, centroids: np.ndarray, bits: int) -> DataFrame:
    """`vec_id, cluster, distance` of all vectors."""
    tables, (_, dims) = borders.tables(centroids), centroids.shape
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def assign(batches):
        for big in batches:
            for b in batches_of(big, BATCH):
                x = _matrix(b.column(2), dims)
                cluster = nearest(x, centroids, enclosed(unpack_cells(b.column(1), dims, bits), tables))
                far = ((x - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(far)], schema=schema)

    return file.select("vec_id", "cells", "v").mapInArrow(assign, "vec_id long, cluster int, distance long")


def added_sums(assigned: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Changes of count and sums by cluster, exactly."""
    d = assigned.filter("row is null").select("cluster", "count", F.posexplode("sums").alias("d", "x"))
    rows = d.groupBy("cluster", "d").agg(F.sum("count").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).orderBy("cluster", "d").collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r.cluster, (r.n, []))[1].append(int(r.x))
    return out


def first_centroids(file: DataFrame, clusters: int) -> np.ndarray:
    """The vectors with the smallest sha256 of `1:<vec_id>` (`null` without an id; ties by the vector)."""
    h = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256).alias("h")
    return np.array([r.v for r in file.select(h, "v").orderBy("h", "v").limit(clusters).collect()], np.int64)


def cluster_vectors(embeddings: DataFrame, dims: int = 64, clusters: int = 16, rounds: int = 3, bits: int = BITS, name: str = "embedding", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256` of every vector of `dims` finite entries.

    Entries count as floor(64 * x); one beyond 2**26 in these units raises, as distances would leave a long. Vectors that
    are NULL, of other lengths or hold NULL, NaN or infinite entries are dropped. NULL and repeated ids stay rows of
    their own. With fewer vectors than `clusters` there are as many centroids as vectors; equal centroids are ties, of
    which the smaller number takes all. Other columns are ignored; without vectors there are no rows.
    """
    file, borders = approximated(embeddings, name, dims, bits)
    centroids = first_centroids(file, clusters)
    if not len(centroids):
        return file.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).limit(0)
    k = len(centroids)
    counts, sums = [0] * k, [[0] * dims for _ in range(k)]
    before = None
    for _ in range(rounds):
        assigned = first_assignment(file, borders, centroids, bits) if before is None else next_assignment(file, before, borders, centroids, bits, broadcast_rows)
        assigned = stored(assigned, "assigned")
        for c, (n, x) in added_sums(assigned).items():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], x)]
        centroids = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(k)], np.int64)
        before = assigned.filter("row is not null").select("row", "cells", "cluster")
    out = stored(last_assignment(file, borders, centroids, bits), "clusters")
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    per = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    inertia = dict.fromkeys(range(k), 0) | {r.cluster: r.cluster_inertia for r in per}
    at = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    longs = at([int(inertia[c]) for c in range(k)]).cast("long")
    return out.select("vec_id", "cluster", "distance", longs.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), at(names).alias("centroid_sha256"))


def _sql(dims: int = 64, clusters: int = 16, rounds: int = 3) -> str:
    """DuckDB SQL of the same result, every distance computed."""
    far = "list_sum(list_transform(list_zip(k.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"k as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings where len(embedding) = {dims} and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))",
        f"c0 as (select row_number() over (order by h) - 1 as n, v as c from (select sha256('1:' || vec_id) as h, v from k order by h limit {clusters}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} as (select vec_id, v, n, d from (select k.vec_id, k.v, c.n, {far} as d, row_number() over (partition by k.vec_id order by {far}, c.n) as o from k cross join c{r} c) where o = 1)")
        if r < rounds:
            parts.append(f"s{r} as (select n, j, sum(v[j]) as s, count(*) as m from (select n, v, unnest(range(1, {dims + 1})) as j from a{r}) group by n, j)")
            parts.append(f"m{r} as (select n, list((s - ((s % m) + m) % m) // m order by j) as c from s{r} group by n)")
            parts.append(f"c{r + 1} as (select c.n, coalesce(m.c, c.c) as c from c{r} c left join m{r} m using (n))")
    last = rounds
    return f"""
with {", ".join(parts)}
select a.vec_id, cast(a.n as int) as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.n) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia,
  sha256(array_to_string(list_transform(c.c, lambda x: cast(x as varchar)), ',')) as centroid_sha256
from a{last} a join c{last} c using (n)
"""


SQL = _sql()

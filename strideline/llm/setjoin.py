"""Exact Jaccard join of documents' word n-gram sets by universe partition and the pigeonhole principle.

Two sets of at most `hi` grams with Jaccard >= t differ in at most H = 2*hi*(1-t)/(1+t) grams. Set sizes are cut into
bands, and each band fixes H and a hash partition of the universe of grams into segments with H+1 (plus slack) slots:

- a segment of one slot is indexed by its whole subset; if it must fail, it costs at least one difference;
- a segment of two slots is indexed by its subset and by all its one-deletion neighbours; to fail it costs two.

Two similar sets therefore agree on a segment. The allocation per band takes the cheaper kind, counting index
entries and expected chance agreements of nearly empty subsets. With one-slot segments, `slack` more segments allow
every set to leave out up to `slack` of its smallest subsets, which would match by chance. A set is indexed in the band
of its size and in the higher bands that a similar set can lie in.

Sets that agree are *candidates*; every link is verified by the exact intersection. Equal sets are one node, so that
copies never meet. Within an agreeing group nodes are first verified against one hub; then every pair that is still
apart and can be similar is verified: no link between
different components is assumed or lost, and no group is written out as all its pairs. Groups of up to `FEW` nodes
compare their nodes' parities in one task (see `near_pairs`), larger ones are divided (see `met_pairs`).
A group that is hot inside one input batch enters the shuffle through one node. Before whole sets move for a
verification, a pair has to pass a bound on parities of one or two bits per gram.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.llm.common import dropped, stored
from strideline.llm.components import label_components
from strideline.llm.substring import BASES, WordRuns, mix64
from strideline.llm.tokens import batches_of

FALSE_COST = 50.0
GROWTH = 1.25
KEYS = pa.schema([("group", pa.int64()), ("key", pa.int64()), ("node", pa.int64())])
U = np.uint64
BATCH = 512
FEW = 4096
MANY = 64


class Band:
    """Sizes lo..hi and their partition: `deletion` segments of two slots, then `exact` segments of one."""

    def __init__(self, number: int, lo: int, hi: int, percent: int):
        self.number, self.lo, self.hi = number, lo, hi
        self.differences = 2 * hi * (100 - percent) // (100 + percent)
        base = self.differences + 1
        load = lo / base
        tiny = math.exp(-load) * (1 + load)
        slack = math.ceil(2 * base * tiny)
        slots = base + slack
        load = lo / slots
        exact_cost = 2 * (1 + FALSE_COST * math.exp(-load))
        deletion_cost = 1 + 2 * lo / base + FALSE_COST * math.exp(-2 * lo / base)
        if deletion_cost < exact_cost:
            slack, slots = 0, base
            self.deletion = slots // 2
        else:
            self.deletion = 0
        self.slack, self.slots = slack, slots
        self.exact = slots - 2 * self.deletion
        self.segments = self.deletion + self.exact


def bands_upto(largest: int, percent: int) -> list[Band]:
    out, lo = [], 1
    while lo <= largest:
        hi = max(lo, int(lo * GROWTH) - (lo >= 8))
        out.append(Band(len(out), lo, hi, percent))
        lo = hi + 1
    return out


def segment_keys(tokens: np.ndarray, owner: np.ndarray, n: int, band: Band) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of `n` sets in one band, and the row of each key's set. `owner` is the row of each token's set."""
    salt = mix64(np.array([band.number + 1], U))[0]
    placed = mix64(tokens ^ salt)
    slot = (placed % U(band.slots)).astype(np.int64)
    segment = np.where(slot < 2 * band.deletion, slot // 2, slot - band.deletion)
    value = mix64(placed + U(0x9E3779B97F4A7C15))
    cell = owner * band.segments + segment
    sums = np.zeros(n * band.segments, U)
    np.add.at(sums, cell, value)
    sizes = np.bincount(cell, minlength=n * band.segments)
    code = mix64(np.arange(band.segments, dtype=U) * U(0x9FB21C651E98DF25) + salt)

    def key(total, size, seg):
        return mix64(total ^ mix64(code[seg] + size.astype(U)))

    keys, rows = [], []
    every = np.arange(n * band.segments)
    seg, own = every % band.segments, every // band.segments
    keep = np.ones(len(every), bool)
    if band.exact:
        grid = sizes.reshape(n, band.segments)[:, band.deletion :]
        least = np.partition(grid, min(band.slack, band.exact - 1), axis=1)[:, min(band.slack, band.exact - 1)]
        keep = (seg < band.deletion) | (sizes >= least[own])
    keys.append(key(sums[keep], sizes[keep], seg[keep]))
    rows.append(own[keep])
    if band.deletion:
        near = slot < 2 * band.deletion
        c = cell[near]
        keys.append(key(sums[c] - value[near], sizes[c] - 1, segment[near]))
        rows.append(owner[near])
    return np.concatenate(keys), np.concatenate(rows)


def gram_sets(texts: Sequence[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word runs of `size` words of each text, in lower case (A-Z only), all in a row, and
    where each text's begin. A shorter sequence of words is one run; NULL and empty texts have none."""
    split = [(t or "").encode().lower().split() for t in texts]
    counts = np.array([len(x) for x in split], np.int64)
    words = np.array([w for x in split for w in x], object)
    hashes = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, U)
    runs = WordRuns(hashes, BASES[0])
    first = np.concatenate([[0], np.cumsum(counts)])
    parts = []
    for k, n in enumerate(counts.tolist()):
        lo = int(first[k])
        start = np.arange(lo, lo + max(n - size, 0) + 1) if n else np.zeros(0, np.int64)
        parts.append(np.unique(runs.of(start, min(size, n)) ^ U(min(size, n))))
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, U)), at


def _set_digest(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit name per set, independent of order; the empty set has 0."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix64(tokens), dtype=U)])
    sizes = np.diff(at).astype(U)
    return np.where(sizes == 0, U(0), mix64((sums[at[1:]] - sums[at[:-1]]) ^ mix64(sizes))).view(np.int64)


def doc_nodes(docs: DataFrame, size: int, marks: Sequence[str] = ()) -> DataFrame:
    """`doc_id, node, n`: the node that stands for the document's set, and the set's size; then the text columns `marks` of `docs`."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), *[(c, pa.string()) for c in marks]])

    def name(batches):
        for big in batches:
            for b in batches_of(big, BATCH):
                tokens, at = gram_sets(b.column("text").to_pylist(), size)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_set_digest(tokens, at)), pa.array(np.diff(at)), *[b.column(c) for c in marks]], schema=schema)

    kinds = ", ".join(["doc_id long, node long, n long", *[f"{c} string" for c in marks]])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *marks).mapInArrow(name, kinds)


def index_keys(docs: DataFrame, size: int, percent: int, bands: Sequence[Band]) -> DataFrame:
    """`group, key, node`: index entries. `group` is the key, or a private group for nodes that share a key in one batch."""
    ends = np.array([b.hi for b in bands], np.int64)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in batches_of(big, BATCH):
                tokens, at = gram_sets(b.column("text").to_pylist(), size)
                node, sizes = _set_digest(tokens, at), np.diff(at)
                _, first = np.unique(node, return_index=True)
                live = np.zeros(len(node), bool)
                live[first] = True
                live &= sizes > 0
                lowest = np.searchsorted(ends, sizes)
                highest = np.searchsorted(ends, sizes * 100 // percent)
                keys, nodes = [], []
                for band in bands:
                    if band.differences == 0:
                        continue
                    pick = np.flatnonzero(live & (lowest <= band.number) & (highest >= band.number))
                    if len(pick):
                        own = np.concatenate([tokens[at[k] : at[k + 1]] for k in pick])
                        k, r = segment_keys(own, np.repeat(np.arange(len(pick)), sizes[pick]), len(pick), band)
                        keys.append(k)
                        nodes.append(node[pick][r])
                if not keys:
                    continue
                key, who = np.concatenate(keys), np.concatenate(nodes)
                order = np.lexsort((who, key))
                key, who = key[order], who[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
                key, who = key[new], who[new]
                head = np.ones(len(key), bool)
                head[1:] = key[1:] != key[:-1]
                lead = who[np.flatnonzero(head)][np.cumsum(head) - 1]
                private = mix64(key ^ mix64(lead.view(U)))
                rest = ~head
                shared = np.zeros(len(key), bool)
                shared[:-1] = rest[1:]
                shared &= head
                group = np.concatenate([key[head], private[rest], private[shared]]).view(np.int64)
                true = np.concatenate([key[head], key[rest], key[shared]]).view(np.int64)
                member = np.concatenate([who[head], who[rest], who[shared]])
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(true), pa.array(member)], schema=KEYS)

    return docs.select("text").mapInArrow(entries, "group long, key long, node long")


def agreeing(entries: DataFrame) -> DataFrame:
    """`key, node, hub` of every index group with two nodes or more; the hub is the group's least node.

    Groups are read from sorted partitions as they come; none is held in memory.
    """
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("hub", pa.int64())])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub, told, true = None, 0, False, 0
        for b in batches:
            group, key, node = (b.column(k).to_numpy() for k in range(3))
            if not len(group):
                continue
            head = np.ones(len(group), bool)
            head[1:] = group[1:] != group[:-1]
            head[0] = last is None or group[0] != last
            firsts = np.flatnonzero(head)
            lead = np.concatenate([[hub], node[firsts]])[np.cumsum(head)]
            lead_key = np.concatenate([[true], key[firsts]])[np.cumsum(head)]
            later = node != lead
            lead_new = np.concatenate([[told], np.zeros(len(firsts), bool)]).astype(bool)
            number = np.cumsum(head)
            meets = np.unique(number[later])
            fresh = meets[~lead_new[meets]]
            leads = np.concatenate([[hub], node[firsts]])
            lead_keys = np.concatenate([[true], key[firsts]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((key[later], lead_keys[fresh]), (node[later], leads[fresh]), (lead[later], leads[fresh]))], schema=schema)
            told = bool(number[-1] in meets) or bool(lead_new[number[-1]])
            last, hub, true = group[-1], lead[-1], lead_key[-1]

    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(parts, "group").sortWithinPartitions("group", "node")
    return dealt.mapInArrow(stars, "key long, node long, hub long")


def parity(tokens: np.ndarray) -> bytes:
    """Parity of the set's hashes in at least one bit per gram (a power of two, 64 or more).

    Two sets that differ in d grams have parities that differ in at most d bits: a bound that never rejects a similar pair."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    at = (mix64(tokens) & U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """A parity (or rows of them) of fewer bits, by exclusive or of its halves. Bits are counted from the front, so halves are the two ends."""
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def node_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """`node, n, parity, set` (sorted 64-bit gram hashes as bytes) of the wanted nodes; `wanted` has `rep` (a doc_id) and `node`."""
    schema = pa.schema([("node", pa.int64()), ("want", pa.int64()), ("n", pa.int32()), ("parity", pa.binary()), ("set", pa.binary())])

    def pack(batches):
        for big in batches:
            for b in batches_of(big, BATCH):
                tokens, at = gram_sets(b.column("text").to_pylist(), size)
                own = [tokens[at[k] : at[k + 1]] for k in range(b.num_rows)]
                cols = [pa.array(_set_digest(tokens, at)), b.column("want"), pa.array(np.diff(at).astype(np.int32)), pa.array([parity(x) if len(x) else b"" for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x.astype("<u8").tobytes() for x in own], pa.binary())], schema=schema)

    w = wanted.select(F.col("rep").alias("_rep"), F.col("node").alias("want"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(w, F.col("doc_id").eqNullSafe(F.col("_rep")))
    sets = d.select("text", "want").mapInArrow(pack, "node long, want long, n int, parity binary, set binary")
    return sets.filter("node = want").drop("want").dropDuplicates(["node"])


def furthest(total: Column, percent: int) -> Column:
    """The most grams that two similar sets of `total` grams together can differ in."""
    return F.floor(total * (100 - percent) / (100 + percent) + F.lit(1e-9)).cast("long")


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose sizes and parities allow a similarity; none that is similar is lost."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def test(batches):
        for b in batches:
            ok = []
            for x, y, most in zip(b.column("x"), b.column("y"), b.column("most").to_pylist()):
                u, v = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(u), len(v))
                ok.append(int(np.bitwise_count(folded(u, size) ^ folded(v, size)).sum()) <= most)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], schema=schema)

    x = sets.select(F.col("node").alias("a"), F.col("n").cast("long").alias("_p"), F.col("parity").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("n").cast("long").alias("_q"), F.col("parity").alias("y"))
    d = pairs.join(x, "a").join(y, "b").filter(f"least(_p, _q) * 100L >= {percent} * greatest(_p, _q)")
    return d.select("a", "b", "x", "y", furthest(F.col("_p") + F.col("_q"), percent).alias("most")).mapInArrow(test, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of plausible pairs (a, b) those with 100 * intersection >= percent * union. Whole sets move here."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def test(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y")):
                u, v = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                at = np.searchsorted(v, u)
                common = int((v[np.minimum(at, len(v) - 1)] == u).sum())
                ok.append(100 * common >= percent * (len(u) + len(v) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], schema=schema)

    x = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    d = pairs.join(y, "b").join(x, "a")
    return d.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def mixed_groups(members: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """`group, node, label` of the keys whose nodes are in different components, each row once. Keys with one pivot are one
    group, named by it: a key's node with the most verified links so far, a centre of its copies where they have one; the
    least node on ties."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    m = members.select("key", "node").distinct().join(labels, "node").join(ends, "node", "left")
    best = F.max_by("node", F.struct(F.coalesce("degree", F.lit(0)), -F.col("node"))).alias("group")
    mixed = m.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), best)
    return m.join(mixed.filter("_lo < _hi").select("key", "group"), "key").select("group", "node", "label").distinct()


def with_size(groups: DataFrame) -> DataFrame:
    return groups.join(groups.groupBy("group").agg(F.count("*").alias("n_nodes")), "group")


def _close(n: np.ndarray, label: np.ndarray, parities: Sequence[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs of one group with different labels whose sizes and parities allow a similarity."""
    wide = np.array([len(x) for x in parities])
    kinds = [(w, np.flatnonzero(wide == w)) for w in np.unique(wide)]
    for w, left in kinds:
        x = np.frombuffer(b"".join([parities[k] for k in left]), np.uint64).reshape(len(left), -1)
        for v, right in kinds:
            right = right[n[right] * percent <= n[left].max() * 100]
            if v < w or not len(right):
                continue
            y = folded(np.frombuffer(b"".join([parities[k] for k in right]), np.uint8).reshape(len(right), -1), w).copy().view(np.uint64)
            step = max(1, (1 << 21) // y.size)
            for lo in range(0, len(left), step):
                own = left[lo : lo + step]
                p, q = n[own][:, None], n[right][None]
                apart = (label[own][:, None] != label[right][None]) & (np.minimum(p, q) * 100 >= percent * np.maximum(p, q))
                if v == w:
                    apart &= own[:, None] < right[None]
                if not apart.any():
                    continue
                far = np.bitwise_count(x[lo : lo + step, None] ^ y[None]).sum(2, dtype=np.int64)
                i, j = np.nonzero(apart & (far <= (p + q) * (100 - percent) // (100 + percent)))
                yield own[i], right[j]


def near_pairs(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs (a, b), in one order, of nodes with different labels of `groups` (group, node, label) of up to `FEW` nodes.

    A task reads its groups one after another and holds the parities of one; no pair is written that they rule out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        node, label, n = (t.column(c).to_numpy() for c in ("node", "label", "n"))
        for i, j in _close(n, label, t.column("parity").to_pylist(), percent):
            yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j])

    def compare(batches):
        open_rows, name, out, held = [], None, [], 0
        for b in batches:
            group = b.column("group").to_numpy()
            if not len(group):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if group[lo] != name and open_rows:
                    for x in pairs(open_rows):
                        out.append(x)
                        held += len(x[0])
                    open_rows = []
                    if held > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)
                        out, held = [], 0
                name = group[lo]
                open_rows.append(b.slice(lo, hi - lo))
        if open_rows:
            out += pairs(open_rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)

    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = groups.select("group", "node", "label").join(sets.select("node", F.col("n").cast("long").alias("n"), "parity"), "node").select("group", "node", "label", "n", "parity")
    dealt = known.repartition(parts, "group").sortWithinPartitions("group")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _ordered(d: DataFrame, one: str, other: str) -> DataFrame:
    return d.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))


def differences(many: DataFrame, sets: DataFrame) -> DataFrame:
    """`group, node, n, lost, added` of `many` (pivot, node): what each node lacks of its pivot's grams and has besides them."""
    schema = pa.schema([("group", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("lost", pa.list_(pa.int64())), ("added", pa.list_(pa.int64()))])

    def differ(batches):
        for b in batches:
            n, lost, added = [], [], []
            for x, y in zip(b.column("x"), b.column("y")):
                u, v = np.frombuffer(x.as_buffer(), "<i8"), np.frombuffer(y.as_buffer(), "<i8")
                n.append(len(u))
                lost.append(np.setdiff1d(v, u, assume_unique=True))
                added.append(np.setdiff1d(u, v, assume_unique=True))
            cols = [pa.array(x, f.type) for x, f in zip((n, lost, added), list(schema)[2:])]
            yield pa.RecordBatch.from_arrays([b.column("pivot"), b.column("node"), *cols], schema=schema)

    x = sets.select("node", F.col("set").alias("x"))
    y = sets.select(F.col("node").alias("pivot"), F.col("set").alias("y"))
    d = many.join(x, "node").join(y, "pivot").select("pivot", "node", "x", "y")
    return d.mapInArrow(differ, "group long, node long, n long, lost array<long>, added array<long>")


def recentred(d: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Differences of groups with several components, from their group's centre: the grams that most of its nodes have.

    Adds `label`, the numbers `n_lost` and `n_added`, `slack` (two sets of one group whose slacks sum to 0 or more are
    similar for certain, as their differences together are no more than similar sets may differ in), `most`, what a set
    can differ in from a similar one of its group, and `_width`, more than any of its group can."""
    d = d.join(labels, "node")
    per = d.groupBy("group").agg(F.count("*").alias("_nodes"), F.max("n").alias("_widest"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo < _hi")
    d = d.join(per.drop("_lo", "_hi"), "group")
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("grams")) for c in ("lost", "added")])
    each = d.select("group", "_nodes", F.explode(sides).alias("s")).select("group", "_nodes", "s.side", F.explode("s.grams").alias("gram"))
    most = each.groupBy("group", "gram", "side", "_nodes").agg(F.count("*").alias("_c")).filter("2 * _c > _nodes")
    common = most.groupBy("group").agg(*[F.collect_list(F.when(F.col("side") == c, F.col("gram"))).alias(f"_{c}") for c in ("lost", "added")])
    none = F.array().cast("array<bigint>")
    d = d.join(common, "group", "left")
    more, less = F.coalesce("_added", none), F.coalesce("_lost", none)
    added = F.concat(F.array_except("added", more), F.array_except(less, F.col("lost")))
    lost = F.concat(F.array_except("lost", less), F.array_except(more, F.col("added")))
    d = d.select("group", "node", "label", "n", "_widest", lost.alias("lost"), added.alias("added"))
    d = d.withColumns({"n_lost": F.size("lost").cast("long"), "n_added": F.size("added").cast("long")})
    slack = F.col("n") * (100 - percent) - (F.col("n_lost") + F.col("n_added")) * (100 + percent)
    most = furthest(F.col("n") + F.least(F.floor(F.col("n") * 100 / percent), F.col("_widest")), percent)
    width = furthest(F.col("_widest") * 2, percent) + 1
    return d.withColumns({"slack": slack, "most": most, "_width": width}).drop("_widest")


FACTS = ["node", "label", "n", "n_lost", "n_added", "slack"]


def _rarest(d: DataFrame, held: DataFrame, grams: str, size: Column) -> DataFrame:
    """The `size` rarest `grams` of every row of `d` among the grams of `held`, one a row, where another row has them, too."""
    counts = held.groupBy("group", "gram").agg(F.count("*").alias("_times"))
    each = d.withColumn("_size", size).filter("_size > 0").select("group", *FACTS, *[c for c in ("_thin", "_width") if c in d.columns], "_size", F.explode(grams).alias("gram"))
    order = W.partitionBy("group", "node").orderBy(F.coalesce("_times", F.lit(0)), "gram")
    ranked = each.join(counts, ["group", "gram"], "left").withColumn("_rank", F.row_number().over(order))
    return ranked.filter("_rank <= _size and _times > 1").drop("_times", "_rank", "_size")


def met_pairs(d: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (group, node, _o) of recentred differences that can be similar, and groups (group, child, node) yet to be divided.

    Similar sets differ by what their differences from the centre differ by. Pairs whose slacks sum to 0 are linked
    already; any other similar pair has a gram in common in its differences:
    - either an added one. Then one of the `most / 2 + 1` rarest added grams of the side with fewer of them stands among
      the added grams of the other. Edits of one's own give grams that few or none share.
    - or only lost ones. Then both sides together have at most `most` added grams, so one of them (a *thin* one) at most
      half of that, and the rarest lost grams of the side with fewer of them are looked up among sides whose number of
      lost grams is near (metric bound).
    A gram that up to `MANY` nodes hold gives pairs. The holders of a more frequent one are a group of their own: it has
    a nearer centre, of which that gram is a part.
    """
    bound = lambda: furthest(F.col("n") + F.col("_on"), percent)
    gap = F.abs(F.col("n_lost") - F.col("_olost")) + F.abs(F.col("n_added") - F.col("_oadded"))
    apart = (F.col("label") != F.col("_ol")) & (F.col("slack") + F.col("_oslack") < 0) & (gap <= bound())
    other = dict(zip(FACTS, ["_o", "_ol", "_on", "_olost", "_oadded", "_oslack"]))
    pairs, children = [], []

    def meet(prefix: DataFrame, held: DataFrame, key: list[str], fits: Column) -> None:
        right = held.select(*key, *[F.col(c).alias(x) for c, x in other.items()], F.count("*").over(W.partitionBy(*key)).alias("_times"), *[F.col("_thin").alias("_othin")] * ("_thin" in held.columns))
        pairs.append(prefix.join(right.filter(F.col("_times") <= MANY), key).filter(apart & fits).select("group", "node", "_o"))
        wide = right.filter(F.col("_times") > MANY)
        asked = prefix.join(wide.select(*key).distinct(), key).select(*key, "node")
        whole = asked.unionByName(wide.join(asked.select(*key).distinct(), key).select(*key, F.col("_o").alias("node")))
        children.append(whole.select("group", F.xxhash64(F.lit(len(key)), *key).alias("child"), "node").distinct())

    held = d.select("group", *FACTS, F.explode("added").alias("gram"))
    meet(_rarest(d, held, "added", F.least(F.col("n_added"), F.floor(F.col("most") / 2) + 1)), held, ["group", "gram"], F.col("_oadded") >= F.col("n_added"))

    rest = d.filter(F.col("n_added") <= F.col("most")).withColumn("_thin", F.col("n_added") * 2 <= F.col("most"))
    band = F.floor(F.col("n_lost") / F.col("_width"))
    held = rest.select("group", *FACTS, "_thin", band.alias("band"), F.explode("lost").alias("gram"))
    need = F.greatest(F.ceil((2 * F.col("n_lost") + F.col("n_added") - F.col("most")) / 2), F.lit(1))
    prefix = _rarest(rest, held, "lost", F.col("n_lost") - need + 1).withColumn("band", F.explode(F.array(band, band + 1)))
    few = (F.col("n_added") + F.col("_oadded") <= bound()) & (F.col("_olost") >= F.col("n_lost")) & (F.col("_thin") | F.col("_othin"))
    meet(prefix, held, ["group", "gram", "band"], few)
    found = reduce(DataFrame.unionByName, pairs).filter("node <> _o").select("group", F.least("node", "_o").alias("node"), F.greatest("node", "_o").alias("_o")).distinct()
    return found, reduce(DataFrame.unionByName, children)


def settled(d: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Stored links (a, b) of groups of differences, and the stored differences of groups that are yet to be divided."""
    d = stored(recentred(d, labels, percent), "centred")
    best = d.groupBy("group").agg(F.max_by(F.struct("node", "slack"), F.struct("slack", -F.col("node"))).alias("_b"))
    star = d.join(best, "group").filter("slack + _b.slack >= 0 and node <> _b.node").withColumn("_o", F.col("_b.node"))
    found, children = met_pairs(d, percent)
    found = stored(found, "pairs")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def test(batches):
        for b in batches:
            ok = [len(np.setxor1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True)) <= most for x, y, most in zip(b.column("x"), b.column("y"), b.column("most").to_pylist())]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], schema=schema)

    side = lambda node, n, grams: d.select("group", F.col("node").alias(node), F.col("n").alias(n), F.concat("lost", "added").alias(grams))
    met = found.withColumnRenamed("node", "a").withColumnRenamed("_o", "b").join(side("a", "_p", "x"), ["group", "a"]).join(side("b", "_q", "y"), ["group", "b"])
    met = met.select("a", "b", "x", "y", furthest(F.col("_p") + F.col("_q"), percent).alias("most")).mapInArrow(test, "a long, b long")
    links = stored(_ordered(star, "node", "_o").unionByName(met).distinct(), "links")
    rest = stored(children.join(d.select("group", "node", "n", "lost", "added"), ["group", "node"]).select(F.col("child").alias("group"), "node", "n", "lost", "added"), "differences")
    dropped(d, found)
    return links, rest


def _components(docs: DataFrame, size: int, percent: int, marks: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The stored nodes of all rows, and `node, rep, label` of every node with grams: its least doc_id and its component.

    After every node has met its keys' hubs, every pair that a key still holds apart is settled: groups of up to `FEW`
    nodes by their parities (see `near_pairs`), larger ones by their differences (see `met_pairs`), in groups that grow
    smaller. Tables that only this work reads are dropped on the way."""
    nodes = stored(doc_nodes(docs, size, marks), "nodes")
    largest = nodes.agg(F.max("n")).first()[0] or 1
    reps = nodes.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"))
    members = stored(agreeing(index_keys(docs, size, percent, bands_upto(largest * 100 // percent + 1, percent))), "agreeing")
    sets = stored(node_sets(docs, members.select("node").distinct().join(reps, "node"), size), "sets")
    every = sets.select("node")

    star = members.filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    met = stored(plausible(star, sets, percent), "pairs")
    links = [stored(verified(met, sets, percent), "links")]
    labels = label_components(every, links[0])
    mixed = stored(mixed_groups(members, labels, links[0]), "mixed")
    dropped(members, met)

    def join(more: DataFrame) -> None:
        nonlocal labels
        links.append(more)
        if not more.isEmpty():
            dropped(labels)
            labels = label_components(every, reduce(DataFrame.unionByName, links))

    def settle_local(groups: DataFrame) -> None:
        near = stored(near_pairs(groups.filter(F.col("n_nodes") <= FEW), sets, percent), "pairs")
        if not near.isEmpty():
            join(stored(verified(near, sets, percent), "links"))
        dropped(near)

    sized = with_size(mixed)
    settle_local(sized)
    large = sized.filter(F.col("n_nodes") > FEW).select(F.col("group").alias("pivot"), "node")
    rest = None if large.isEmpty() else stored(differences(large, sets), "differences")
    dropped(mixed)
    while rest is not None:
        more, smaller = settled(rest, labels, percent)
        join(more)
        dropped(rest)
        sized = with_size(smaller)
        settle_local(sized.join(labels, "node"))
        large = sized.filter(F.col("n_nodes") > FEW).drop("n_nodes")
        rest = None if large.isEmpty() else stored(large, "differences")
        dropped(smaller)
    out = stored(reps.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "components")
    dropped(sets, labels, *links)
    return nodes, out


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """`doc_id, n_shingles, component_id` of every row of `docs` (doc_id, text; other columns are ignored).

    A document with fewer words than `size` has its whole sequence as its one gram; a NULL or empty text has none and
    links with nothing. component_id is the smallest doc_id reachable by links, itself included; NULL ids are passed
    over and take the component's smallest known id. Repeated rows are equal sets, so one component.
    """
    nodes, joined = _components(docs, size, percent)
    least = joined.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = joined.join(least, "label").select("node", "component_id")
    out = nodes.join(named, "node", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_per_component(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns: one of each component, and all documents without words.

    The row of the least doc_id stays; a row with a NULL id only where no row of the component has one, and then that
    of the least text hash. Of rows with the same doc_id and text one stays.
    """
    # a NULL id is stood for by the text's hash, so that rows without an id never meet on one key
    no_id, own, md5 = (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), F.md5(F.coalesce("text", F.lit(""))))
    row = docs.select(own.alias("doc_id"), "text", F.concat(F.when(no_id, F.lit("1")).otherwise(F.lit("0")), md5).alias("mark"))
    nodes, joined = _components(row, size, percent, ["mark"])
    same = nodes.filter("n > 0").join(joined.select("node", "label"), "node").groupBy("label", "doc_id", "mark").agg(F.count("*").alias("times"))
    best = same.groupBy("label").agg(F.min(F.struct(F.substring("mark", 1, 1).alias("no_id"), "doc_id", "mark", "times")).alias("r")).select("r.doc_id", "r.mark", "r.times")
    empty = nodes.filter("n = 0").select("doc_id", "mark", F.lit(1).cast("long").alias("times")).distinct()
    first = stored(best.unionByName(empty).toDF("_id", "_mark", "_times"), "first")
    dropped(nodes, joined)

    # names of `docs` may clash with any of ours, so the join is by its own columns
    key = [F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"])), F.concat(F.when(docs["doc_id"].isNull(), F.lit("1")).otherwise(F.lit("0")), F.md5(F.coalesce(docs["text"], F.lit(""))))]
    picked = lambda f: docs.join(f, (key[0] == f["_id"]) & (key[1] == f["_mark"]), "left_semi")
    repeated = first.filter("_times > 1")
    if repeated.isEmpty():
        return picked(first)
    # repeats differ in other columns at most: one of them, map-side
    tie = F.xxhash64(*[docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    one = picked(repeated).groupBy(*key).agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), tie).alias("_row")).select("_row.*")
    return picked(first.filter("_times = 1")).union(one)


SQL = r"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select distinct doc_id, case when len(w) >= 3 then unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i : i + 2], ' '))) else array_to_string(w, ' ') end as g from w where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.c >= 90 * (x.n + y.n - p.c)),
u as (select a, b from e union all select b, a from e),
r(doc_id, reach) as (select doc_id, doc_id from w union select r.doc_id, u.b from r join u on u.a = r.reach)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.component_id from w left join n using (doc_id)
join (select doc_id, min(reach) as component_id from r group by doc_id) m using (doc_id)
"""

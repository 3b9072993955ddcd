"""Removal of word sequences that an earlier document already has, by seed and extend.

1. Seeds. Of every `length`-word window the least hash among its `seed`-word runs is its anchor (winnowing). Equal
   windows have equal anchors, and neighbouring windows mostly share theirs: a document is a row of *stretches*, the
   widest runs of windows with one anchor. Anchors are joined over documents; those that two documents have are seeds.
2. Extension. Around a seed the match is extended both ways. Where the whole stretch is equal to one of an earlier
   document, it is a repeat as a whole. Only anchors that stand in different stretches are looked at window by window,
   and there only the first document of each stretch: it has every window that later ones have.
3. Repeats that overlap or touch are merged to maximal repeats, and their words are removed.

No pair of documents is ever formed: a passage that n documents share costs n rows, combined before the shuffle.
Sequences are compared by 128 bits of hash (anchor and stretch) or 160 (anchor and window).

A row is known by (doc_id, hash of its text). A NULL or empty text has no words. A NULL doc_id counts as smaller
than any other. Rows that repeat a doc_id are never earlier than each other. Other columns are kept or ignored.
Windows are judged on the input, not on what is left, so the result does not depend on order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.llm.common import split_words, stored, text_of
from strideline.llm.tokens import batches_of

NO_ID = -(1 << 63)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
STRETCHES = "anchor long, stretch long, doc long, text_hash int, start int, windows int"
WINDOWS = "anchor long, w1 long, w2 int, doc long, text_hash int, start int"
KINDS = {"long": pa.int64(), "int": pa.int32()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(n, KINDS[t]) for n, t in (c.split() for c in text.split(", "))])


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordRuns:
    """Polynomial hashes modulo 2**64 of any runs of a row of words, by prefix sums."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        self.powers = np.ones(n + 1, np.uint64)
        self.powers[1:] = np.multiply.accumulate(np.full(n, base, np.uint64))
        back = np.ones(n + 1, np.uint64)
        back[1:] = np.multiply.accumulate(np.full(n, pow(base, -1, 1 << 64), np.uint64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * back[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return mix64((self.sums[start + size] - self.sums[start]) * self.powers[start])

    def all(self, size: int) -> np.ndarray:
        return mix64((self.sums[size:] - self.sums[:-size]) * self.powers[: len(self.sums) - size])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _columns(batch: pa.RecordBatch):
    """Document ids, text hashes, all word hashes in a row, and where each document's words begin and end."""
    lists = batch.column("words")
    at = lists.offsets.to_numpy()
    words = lists.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
    lo = int(at[0])
    return batch.column("doc").to_numpy(zero_copy_only=False), batch.column("text_hash").to_numpy(zero_copy_only=False), words[lo : int(at[-1])], at - lo


def _windows(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in the row of all words) of all whole windows, and the row number of their documents."""
    sizes = np.maximum(np.diff(at) - length + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return np.arange(len(owner)) - first[owner] + at[:-1][owner], owner


def keyed(docs: DataFrame) -> DataFrame:
    """`doc, text_hash, text`: none of them NULL. Dealt by key once; joins on the key share that shuffle."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.hash(text_of()).alias("text_hash"), text_of().alias("text"))
    return d.repartition(parts, "doc", "text_hash")


def _hashed(words_of: DataFrame, *others: str) -> DataFrame:
    return words_of.select("doc", "text_hash", *others, F.transform(split_words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))


def stretches(docs: DataFrame, length: int = 50, seed: int = 12) -> DataFrame:
    """All stretches of all documents: `anchor, stretch, doc, text_hash, start, windows`."""
    schema = _schema(STRETCHES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in batches_of(big):
                doc, text, words, at = _columns(b)
                if len(words) < length:
                    continue
                start, owner = _windows(at, length)
                seq = WordRuns(words, BASES[0])
                least = sliding_min(seq.all(seed), length - seed + 1)[start]
                new = np.ones(len(start), bool)
                new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(start)))
                whole = seq.of(start[head], n - 1 + length) ^ mix64(n.astype(np.uint64))
                own = owner[head]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip((least[head].view(np.int64), whole.view(np.int64), doc[own], text[own], start[head] - at[:-1][own], n), schema)], schema=schema
                )

    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.hash(text_of()).alias("text_hash"), text_of().alias("text"))
    return _hashed(d).mapInArrow(rows, STRETCHES)


def anchored_windows(places: DataFrame, texts: DataFrame, length: int = 50, seed: int = 12) -> DataFrame:
    """The windows of `places` (doc, text_hash, start, windows): `anchor, w1, w2, doc, text_hash, start`."""
    schema = _schema(WINDOWS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in batches_of(big):
                doc, text, words, at = _columns(b)
                lists = b.column("places")
                cut = lists.offsets.to_numpy()
                flat = lists.values.slice(int(cut[0]), int(cut[-1] - cut[0]))
                first, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "windows"))
                own = np.repeat(np.arange(len(doc)), np.diff(cut))
                each = np.repeat(np.arange(len(n)), n)
                start = first[each] + np.arange(len(each)) - np.concatenate([[0], np.cumsum(n)])[:-1][each]
                owner = own[each]
                place = start + at[:-1][owner]
                one, two = WordRuns(words, BASES[0]), WordRuns(words, BASES[1])
                anchor = sliding_min(one.all(seed), length - seed + 1)[place].view(np.int64)
                w1 = one.of(place, length).view(np.int64)
                w2 = (two.of(place, length) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((anchor, w1, w2, doc[owner], text[owner], start), schema)], schema=schema)

    lists = places.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("start", "windows")).alias("places"))
    return _hashed(texts.join(lists, ["doc", "text_hash"]), "places").mapInArrow(rows, WINDOWS)


def repeated_spans(docs: DataFrame, length: int = 50, seed: int = 12) -> DataFrame:
    """Maximal repeats of each document that has some: `doc, text_hash, begins, ends` (word positions, ends exclusive)."""
    every = stretches(docs, length, seed)
    kinds = every.groupBy("anchor", "stretch").agg(F.min("doc").alias("first"), F.max("doc").alias("_last"))
    anchors = kinds.groupBy("anchor").agg(F.min("first").alias("_lo"), F.max("_last").alias("_hi"), (F.min("stretch") < F.max("stretch")).alias("varied")).filter("_lo < _hi")
    seeds = kinds.join(anchors.select("anchor", "varied"), "anchor").filter("varied or first < _last").select("anchor", "stretch", "first", "varied")
    found = stored(every.join(seeds, ["anchor", "stretch"]).select("doc", "text_hash", "start", "windows", (F.col("doc") > F.col("first")).alias("repeat"), "varied"), "seeds")

    wide = found.filter("repeat").select("doc", "text_hash", F.col("start").alias("begin"), (F.col("start") + F.col("windows") - 1 + length).alias("end"))
    windows = anchored_windows(found.filter("not repeat and varied").select("doc", "text_hash", "start", "windows"), keyed(docs), length, seed)
    key = ["anchor", "w1", "w2"]
    first = windows.groupBy(*key).agg(F.min("doc").alias("_first"), F.max("doc").alias("_last")).filter("_first < _last").drop("_last")
    narrow = windows.join(first, key).filter("doc > _first").select("doc", "text_hash", F.col("start").alias("begin"), (F.col("start") + length).alias("end"))

    inside = W.partitionBy("doc", "text_hash").orderBy("begin", "end")
    reach = F.max("end").over(inside.rowsBetween(W.unboundedPreceding, -1))
    spans = wide.unionByName(narrow).withColumn("_new", F.when(reach >= F.col("begin"), 0).otherwise(1))
    spans = spans.withColumn("_k", F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    merged = spans.groupBy("doc", "text_hash", "_k").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    both = merged.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("s"))
    return both.select("doc", "text_hash", F.col("s.begin").alias("begins"), F.col("s.end").alias("ends"))


def kept_words(words: Column, begins: Column, ends: Column) -> Column:
    """The words outside the spans, in order."""
    lo = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
    hi = lambda i: F.coalesce(F.get(begins, i), F.size(words))
    gaps = F.transform(F.sequence(F.lit(0), F.size(begins)), lambda i: F.slice(words, lo(i) + 1, hi(i) - lo(i)))
    return F.when(begins.isNull(), words).otherwise(F.flatten(gaps))


def remove_repeated_passages(docs: DataFrame, length: int = 50, seed: int = 12) -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256, kept_text` of every row; the kept words are joined by one space."""
    d = keyed(docs).join(repeated_spans(docs, length, seed), ["doc", "text_hash"], "left").withColumn("_words", split_words(F.col("text")))
    d = d.withColumn("_left", kept_words(F.col("_words"), F.col("begins"), F.col("ends")))
    d = d.withColumns({"n_words": F.size("_words").cast("long"), "n_removed": (F.size("_words") - F.size("_left")).cast("long"), "kept_text": F.array_join("_left", " ")})
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return d.select(doc_id.alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "kept_text")


def deduplicated_documents(docs: DataFrame, length: int = 50, seed: int = 12) -> DataFrame:
    """`docs` with its own columns, where repeats are cut out of `text` and the kept words joined by one space. Texts
    without a repeat stay as they are; `n_chars`, where there is one, counts the new text."""
    spans = repeated_spans(docs, length, seed)
    row = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.hash(text_of()).alias("text_hash"))
    text = F.col("row.text")
    cut = F.array_join(kept_words(split_words(F.coalesce(text, F.lit(""))), F.col("begins"), F.col("ends")), " ")
    d = row.join(spans, ["doc", "text_hash"], "left").withColumn("new", F.when(F.col("begins").isNull(), text).otherwise(cut))
    changed = {"text": F.col("new"), "n_chars": F.char_length("new").cast("long")}
    d = d.select(*[(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns])
    return d


SQL = r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
p as (select doc_id, unnest(range(0, len(w) - 49)) as i from w where len(w) >= 50),
k as (select p.doc_id, p.i, md5(array_to_string(w.w[p.i + 1 : p.i + 50], ' ')) as k from p join w using (doc_id)),
f as (select k, min(doc_id) as first_id from k group by k),
h as (select k.doc_id, k.i from k join f using (k) where k.doc_id > f.first_id),
c as (select distinct doc_id, i + unnest(range(0, 50)) as pos from h),
r as (select doc_id, count(*) as n_removed, count(pos) as n from c group by doc_id),
x as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as pos from w),
l as (select x.doc_id, string_agg(word, ' ' order by x.pos) as kept from x left join c on c.doc_id = x.doc_id and c.pos = x.pos where c.pos is null group by x.doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(r.n_removed, 0) as bigint) as n_removed, sha256(coalesce(l.kept, '')) as kept_sha256
from w left join r using (doc_id) left join l using (doc_id)
"""

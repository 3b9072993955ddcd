"""Benchmark passages in documents by a prefix-filtered set join.

1. Every item is cut into windows of `window` consecutive words (a shorter item is one window); equal windows of
   different items are one. A window is the set of its placed shingles of `shingle` words.
2. Shingles are ordered by rarity, counted over all documents. If a window of m shingles must agree in `need` of them,
   one of its m - need + 1 rarest has to be there: only this *prefix* is looked up in the documents. With full
   containment it is one shingle, and a window whose rarest shingle stands nowhere is gone before the join.
3. A match of shingle t of a window at word p of a document places the window at p - t. It must lie inside the document
   (length and positional bounds), and then the document's window of the item window's size is compared with it word
   by word.

Texts are read twice (count, match). Item tables of at most `broadcast_rows` rows are broadcast; beyond that both joins
shuffle hashes and places only, and candidates fetch their documents once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.llm.common import content_words, grams, stored, text_of

MARKER = -1
BROADCAST_ROWS = 100_000
KEY = ["doc_id", "text_hash"]


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """`wid, words, item_id`: the windows of all items with words. `wid` is a digest of the words."""
    words, n = F.col("_w"), F.size("_w")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))), lambda i: F.slice(words, i + 1, F.lit(window)))
    d = items.select("item_id", content_words(text_of()).alias("_w")).filter(n > 0).select("item_id", F.explode(cut).alias("words"))
    return d.select(F.md5(F.array_join("words", " ")).alias("wid"), "words", "item_id").distinct()


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """`wid, words, size, k, t, h` of windows (wid, words): shingle t of k words; a shorter window is one shingle."""
    d = windows.select("wid", "words", F.size("words").alias("size"), F.least(F.size("words"), F.lit(shingle)).alias("k"))
    return d.select("*", F.posexplode(grams(F.col("words"), shingle)).alias("t", "h"))


def _placed_grams(docs: DataFrame, sizes: Sequence[int], marked: bool) -> DataFrame:
    """One row per document and gram of each of `sizes`: `doc_id, text_hash, words, pos, h`; `marked` adds one row with h = MARKER."""
    d = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), content_words(text_of()).alias("words"))
    every = [grams(F.col("words"), m, short=False) for m in sizes] + [F.array(F.lit(MARKER).cast("long"))] * marked
    return d.select("*", F.posexplode(F.concat(*every)).alias("pos", "h"))


def _start(sizes: Sequence[int], n: Column) -> Column:
    """The word at which the gram of size `k` at `pos` of the grams of `n` words begins; markers (k = 0) stand at 0, if last."""
    before, out = F.lit(0), F.lit(None).cast("int")
    for m in sizes:
        out = F.when(F.col("k") == m, F.col("pos") - before).otherwise(out)
        before = before + F.greatest(n - (m - 1), F.lit(0))
    return F.when(F.col("k") == 0, F.when(F.col("pos") == before, F.lit(0))).otherwise(out)


def prefixes(shingles: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """The rarest shingles of every window of `shingles`, as many as must hold one of `share` of them: adds `need`."""
    d = shingles.join(counts, "h", "left").withColumn("_seen", F.coalesce("_seen", F.lit(0)))
    m = F.col("size") - F.col("k") + 1
    need = F.greatest(F.ceil(m * F.lit(share) - 1e-9), F.lit(1)).cast("int")
    rank = F.row_number().over(W.partitionBy("wid").orderBy("_seen", "h", "t"))
    d = d.withColumns({"need": need, "_rank": rank}).filter((F.col("_rank") <= m - F.col("need") + 1) & (F.col("_seen") > 0))
    return d.select("h", "k", "t", "wid", "words", "size", "need")


def _agrees(share: float) -> Column:
    """Whether the document's window at `s` holds enough shingles of the item window `_win`, in their places."""
    there = F.slice("words", F.col("s") + 1, F.col("size"))
    if share >= 1:
        return there == F.col("_win")
    fit = lambda j: F.slice("words", F.col("s") + j + 1, F.col("k")) == F.slice("_win", j + 1, F.col("k"))
    return F.size(F.filter(F.sequence(F.lit(0), F.col("size") - F.col("k")), fit)) >= F.col("need")


def _matches(docs: DataFrame, prefix: DataFrame, sizes: Sequence[int], share: float, small: bool) -> DataFrame:
    """`doc_id, text_hash, n_words, s, size, wid` of verified windows, and one row with NULL `wid` for every row of `docs`."""
    kept = [*KEY, F.size("words").cast("long").alias("n_words"), "s", "size", "wid"]
    inside = (F.col("s") >= 0) & (F.col("s") + F.col("size") <= F.size("words"))
    p = prefix.withColumnRenamed("words", "_win")
    if small:
        mark = {"h": F.lit(MARKER).cast("long"), "k": F.lit(0), "t": F.lit(0), "wid": F.lit(None).cast("string"), "_win": F.array().cast("array<string>"), "size": F.lit(0), "need": F.lit(0)}
        p = p.unionByName(docs.sparkSession.range(1).select(*[v.alias(c) for c, v in mark.items()]))
        d = _placed_grams(docs, sizes, True).join(F.broadcast(p), "h").withColumn("s", _start(sizes, F.size("words")) - F.col("t"))
        return d.filter(inside & (F.col("wid").isNull() | _agrees(share))).select(*kept)
    every = _placed_grams(docs, [], True).select(*KEY, F.size("words").cast("long").alias("n_words"), F.lit(0).alias("s"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("wid"))
    # only hashes and places are shuffled; a document's candidates then fetch its words once
    g = _placed_grams(docs, sizes, False).select(*KEY, "h", "pos", F.size("words").alias("_n"))
    c = g.join(p.drop("_win", "need"), "h").withColumn("s", _start(sizes, F.col("_n")) - F.col("t"))
    c = c.filter((F.col("s") >= 0) & (F.col("s") + F.col("size") <= F.col("_n"))).groupBy(*KEY).agg(F.collect_set(F.struct("s", "wid")).alias("_found"))
    c = c.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_found")
    words = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), content_words(text_of()).alias("words"))
    d = words.join(c, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select(*KEY, "words", F.explode("_found").alias("_f"))
    w = p.select("wid", "_win", "size", "k", "need").dropDuplicates(["wid"])
    d = d.select(*KEY, "words", "_f.s", "_f.wid").join(w, "wid").filter(_agrees(share))
    return every.unionByName(d.select(*kept))


def benchmark_matches(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, share: float = 1.0, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Stored `doc_id, text_hash, n_words, s, size, wid` (see `_matches`), and `wid, item_id` of the items' windows."""
    wins = stored(item_windows(items, window), "windows")
    shingles = stored(window_shingles(wins.select("wid", "words").distinct(), shingle), "shingles")
    # at most `shingle` different sizes
    sizes = sorted(r[0] for r in shingles.select("k").distinct().collect())
    small = shingles.limit(broadcast_rows + 1).count() <= broadcast_rows
    own = shingles.select("h").distinct()
    seen = _placed_grams(docs, sizes, False).select("h") if sizes else shingles.select("h").limit(0)
    counts = seen.join(F.broadcast(own) if small else own, "h").groupBy("h").agg(F.count("*").alias("_seen"))
    prefix = stored(prefixes(shingles, counts, share), "prefixes")
    return stored(_matches(docs, prefix, sizes, share, small), "matches"), wins.select("wid", "item_id").distinct()


def benchmark_spans(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, share: float = 1.0) -> DataFrame:
    """`doc_id, start, stop, item_id`: every place (words from 0, stop excluded) where a window of an item occurs in a row of `docs`."""
    found, owners = benchmark_matches(docs, items, window, shingle, share)
    hits = found.filter("wid is not null").select("doc_id", F.col("s").alias("start"), (F.col("s") + F.col("size")).alias("stop"), "wid")
    return hits.join(owners, "wid").select("doc_id", "start", "stop", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, share: float = 1.0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash` of every row of `docs` (doc_id, text).

    `items` has (item_id, text). NULL and empty texts have no words; items without words match nothing, and items
    without an id hit words but are not counted or named. With `share` below 1 a window counts where that share of its
    shingles stands in place. Repeated rows get one row each; equal items and repeated windows count once; other columns
    of both tables are ignored. Without items nothing is hit; an empty table of documents gives no rows.
    """
    found, owners = benchmark_matches(docs, items, window, shingle, share, broadcast_rows)
    hits = found.filter("wid is not null").join(owners, "wid").select(*KEY, "n_words", "s", "size", "item_id", F.lit(0).alias("_row"))
    every = found.filter("wid is null").select(*KEY, "n_words", F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("size"), F.lit(None).cast(hits.schema["item_id"].dataType).alias("item_id"), F.lit(1).alias("_row"))
    span = F.when(F.col("s").isNotNull(), F.struct("s", "size"))
    per = every.unionByName(hits).groupBy(*KEY, "n_words").agg(
        F.sum("_row").cast("int").alias("_copies"), F.sort_array(F.collect_set(span)).alias("_spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("_items")
    )
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["s"] + x["size"]).alias("end"), (a["hit"] + F.greatest(x["s"] + x["size"] - F.greatest(a["end"], x["s"]), F.lit(0))).alias("hit"))
    per = per.withColumn("n_hit", F.aggregate("_spans", begin, step)["hit"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return per.select(
        "doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "text_hash"
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, max_hit_share: float = 0.0) -> DataFrame:
    """The rows of `docs`, with all their columns, of whose words at most `max_hit_share` are inside benchmark windows."""
    bad = contamination(docs, items, window, shingle).filter(F.col("n_hit") > F.col("n_words") * max_hit_share)
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash"))
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (own == bad["_bad_hash"]), "left_anti")


SQL = r"""
with dw as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
iw as (select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark),
ip as (select item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) as s from iw where len(w) > 0),
wn as (select distinct item_id, array_to_string(w[s + 1 : s + 10], ' ') as g, least(len(w), 10) as size from ip),
dp as (select doc_id, w, unnest(range(0, len(w))) as s from dw where len(w) > 0),
dg as (select dp.doc_id, dp.s, z.size, array_to_string(dp.w[dp.s + 1 : dp.s + z.size], ' ') as g from dp cross join (select distinct size from wn) z where dp.s + z.size <= len(dp.w)),
m as (select dg.doc_id, dg.s, dg.size, wn.item_id from dg join wn on dg.g = wn.g and dg.size = wn.size),
c as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(s, s + size)) as at from m) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as named from (select distinct doc_id, cast(item_id as varchar) as x from m) group by doc_id)
select dw.doc_id, cast(len(dw.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(named, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from dw left join c using (doc_id) left join i using (doc_id)
"""

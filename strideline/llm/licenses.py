"""License phrases in documents by diagonal voting.

All rolling word k-gram hashes of all documents are joined to the k-grams of the templates (a template shorter than
k is one gram of its own length). A match of text position s with template position t votes for the diagonal s - t.
Votes are summed per (document, template, diagonal) before the shuffle; neighbouring diagonals, which a missing or
added word sets apart, are merged to one span; a span counts if it holds enough of the template within a plausible
length. Every gram match is checked word by word right after the hash join.

Each document adds one marker entry to its grams, which meets a marker template: so documents without any license
keep their row, and their texts are read once. Templates are a parameter of bounded size, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.llm.common import content_words, grams, text_of

MAX_TEMPLATE_WORDS = 20_000
MARKER = -1


class Template(NamedTuple):
    label: str
    base: bool
    words: str


# The base phrases and their labels.
BASE = (Template("cc-by", True, "cc by"), Template("gpl", True, "general public license"), Template("reserved", True, "all rights reserved"))
# The method's own templates: public wordings of license notices.
NOTICES = (
    Template("apache-2.0", False, "licensed under the apache license version 2 0"),
    Template("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by-nc", False, "licensed under cc by nc 4 0"),
    Template("cc-by-sa", False, "licensed under cc by sa 4 0"),
    Template("gpl-3.0", False, "this work is licensed under the gnu general public license version 3"),
    Template("mit", False, "released under the mit license"),
    Template("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("mpl-2.0", False, "subject to the terms of the mozilla public license v 2 0"),
    Template("public-domain", False, "released into the public domain"),
)


def template_grams(spark: SparkSession, templates: Sequence[Template], k: int) -> DataFrame:
    """`h, template, k, t, gram, size` of all templates, and the marker's row."""
    split = [t.words.split() for t in templates]
    if sum(map(len, split)) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words; they would be broadcast")
    rows = [(n, min(k, len(w)), t, w[t : t + min(k, len(w))], len(w)) for n, w in enumerate(split) for t in range(len(w) - min(k, len(w)) + 1)]
    entries = [
        F.struct(F.xxhash64(*map(F.lit, gram)).alias("h"), F.lit(n).alias("template"), F.lit(size).alias("k"), F.lit(t).alias("t"), F.array(*map(F.lit, gram)).alias("gram"), F.lit(whole).alias("size"))
        for n, size, t, gram, whole in rows
    ]
    empty = F.array().cast("array<string>")
    entries.append(F.struct(F.lit(MARKER).cast("long").alias("h"), F.lit(MARKER).alias("template"), F.lit(0).alias("k"), F.lit(0).alias("t"), empty.alias("gram"), F.lit(0).alias("size")))
    return spark.range(1).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def gram_matches(docs: DataFrame, templates: Sequence[Template], k: int = 3) -> DataFrame:
    """Verified gram matches and one marker per document: `doc_id, text_hash, n_words, template, k, t, s, size`."""
    sizes = sorted({min(k, len(t.words.split())) for t in templates})
    d = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), content_words(text_of()).alias("words"))
    d = d.withColumn("grams", F.concat(*[grams(F.col("words"), m, short=False) for m in sizes], F.array(F.lit(MARKER).cast("long"))))
    d = d.select("doc_id", "text_hash", "words", F.posexplode_outer("grams").alias("pos", "h"))
    n = F.size("words")
    count = lambda m: F.greatest(n - (m - 1), F.lit(0))
    start, before = F.lit(None).cast("int"), F.lit(0)
    for m in sizes:
        start = F.when(F.col("k") == m, F.col("pos") - before).otherwise(start)
        before = before + count(m)
    start = F.when(F.col("k") == 0, F.when(F.col("pos") == before, F.lit(0))).otherwise(start)
    d = d.join(F.broadcast(template_grams(docs.sparkSession, templates, k)), "h")
    d = d.withColumns({"s": start, "n_words": n.cast("long")}).filter((F.col("s") >= 0) & (F.slice("words", F.col("s") + 1, F.col("k")) == F.col("gram")))
    return d.select("doc_id", "text_hash", "n_words", "template", "k", "t", "s", "size")


def license_spans(matches: DataFrame, shift: int = 3, coverage: float = 0.6) -> DataFrame:
    """Spans of templates: `doc_id, text_hash, n_words, template, start, stop, share`; markers have template -1 and their
    number of equal rows as share, by which all votes of repeated rows are divided."""
    key = ["doc_id", "text_hash"]
    votes = matches.groupBy(*key, "n_words", "template", "k", "size", (F.col("s") - F.col("t")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("s").alias("start"), F.max(F.col("s") + F.col("k")).alias("stop")
    )
    along = W.partitionBy(*key, "template").orderBy("diagonal")
    whole = F.col("size") == F.col("k")
    apart = F.when(whole | F.lag("diagonal").over(along).isNull() | (F.col("diagonal") - F.lag("diagonal").over(along) > shift), 1).otherwise(0)
    votes = votes.withColumn("_new", apart).withColumn("_span", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    spans = votes.groupBy(*key, "n_words", "template", "k", "size", "_span").agg(F.sum("votes").alias("votes"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    marker = F.col("template") == MARKER
    copies = F.sum(F.when(marker, F.col("votes"))).over(W.partitionBy(*key))
    share = F.when(marker, F.col("votes").cast("double")).otherwise(F.least(F.lit(1.0), F.col("votes") / copies / (F.col("size") - F.col("k") + 1)))
    spans = spans.withColumn("share", share)
    fits = marker | ((F.col("share") >= coverage) & (F.col("stop") - F.col("start") <= F.col("size") + shift))
    return spans.filter(fits).select(*key, "n_words", "template", "start", "stop", "share")


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES, k: int = 3, shift: int = 3, coverage: float = 0.6) -> DataFrame:
    """`doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score` of every row of `docs` (doc_id, text).

    A NULL or empty text has no words and no labels; labels are empty texts where there are none, and the score is
    the largest share of a template that a span holds, 0 without spans. Repeated rows each get the row of one of
    them; rows with equal doc_id and other texts are apart. Other columns are ignored; an empty table gives no rows.
    """
    spans = license_spans(gram_matches(docs, templates, k), shift, coverage)
    names = F.array(*[F.lit(t.label) for t in templates])
    based = F.array(*[F.lit(t.base) for t in templates])
    found = F.col("template") != MARKER
    base = found & F.get(based, F.col("template"))
    label = F.when(found, F.get(names, F.col("template")))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    out = spans.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, label)).alias("base_labels"),
        joined(label).alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("share"))), F.lit(0.0)).alias("score"),
        F.max(F.when(~found, F.col("share"))).cast("int").alias("_copies"),
    )
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copy", "_copies", "text_hash")


def _sql(templates: Sequence[Template], k: int = 3, shift: int = 3, coverage: float = 0.6) -> str:
    values = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, '{t.words}', {min(k, len(t.words.split()))})" for n, t in enumerate(templates))
    return rf"""
with tp(id, label, base, txt, k) as (values {values}),
tw as (select *, string_split(txt, ' ') as ws from tp),
tg as (select id, k, len(ws) as size, u.t as t, array_to_string(ws[u.t + 1 : u.t + k], ' ') as g from tw, lateral (select unnest(range(0, len(ws) - k + 1)) as t) u),
w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from documents),
p as (select doc_id, unnest(range(0, len(ws))) as s from w where len(ws) > 0),
dg as (select p.doc_id, p.s, ks.k, array_to_string(w.ws[p.s + 1 : p.s + ks.k], ' ') as g from p join w using (doc_id) cross join (select distinct k from tp) ks where p.s + ks.k <= len(w.ws)),
v as (select dg.doc_id, tg.id, tg.k, tg.size, dg.s - tg.t as diag, count(*) as votes, min(dg.s) as a, max(dg.s + tg.k) as z from dg join tg on dg.k = tg.k and dg.g = tg.g group by all),
n as (select *, case when size = k or lag(diag) over o is null or diag - lag(diag) over o > {shift} then 1 else 0 end as fresh from v window o as (partition by doc_id, id order by diag)),
c as (select *, sum(fresh) over (partition by doc_id, id order by diag rows between unbounded preceding and current row) as span from n),
s as (select doc_id, id, least(1.0::double, sum(votes)::double / (size - k + 1)) as share, min(a) as a, max(z) as z, size from c group by doc_id, id, span, size, k),
f as (select s.*, tp.label, tp.base from s join tp using (id) where share >= {coverage} and z - a <= size + {shift}),
r as (select doc_id, count(*) filter (where base) as n_base, min(a) filter (where base) as first_word, max(a) filter (where base) as last_word,
  string_agg(distinct label, ',' order by label) filter (where base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score from f group by doc_id)
select w.doc_id, cast(len(w.ws) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score from w left join r using (doc_id)
"""


SQL = _sql(BASE + NOTICES)

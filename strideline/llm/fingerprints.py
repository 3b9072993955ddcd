"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing, in column functions.

Each word 5-gram is hashed once. The top bits of the hash choose one of `BINS` bins, and a bin keeps its least hash.
An empty bin borrows from a full one: its own fixed pseudo-random order of all bins says from which, the first full one in
that order, so that two documents borrow alike wherever they can (optimal densification). Of every bin the low `BITS`
bits are kept; two unequal values still agree there by chance once in 2**BITS, which the likeness corrects for.

Bins are filled without a shuffle: hashes are sorted together with one sentinel per bin, the largest value of the bin,
so that the first value of each bin in sorted order is its minimum, and a sentinel marks an empty bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strideline.llm.common import grams, let, split_words, stored, text_of

BINS = 128
BITS = 8
SHIFT = 63 - BINS.bit_length() + 1
PROBES = 6
WORDS = 5


def _donor_bin(h: Column, t: Column) -> Column:
    """The t-th bin in the order that the hash `h` of an empty bin stands for: an odd step from a start, so that 0 to
    BINS - 1 give every bin once."""
    mask = F.lit(BINS - 1).cast("long")
    step = F.shiftright(h, 20).bitwiseAND(mask).bitwiseOR(F.lit(1).cast("long"))
    return (h.bitwiseAND(mask) + step * t).bitwiseAND(mask).cast("int")


def _low_bits(values: Column) -> Column:
    """`BITS` low bits of the `BINS` values as fixed-width hexadecimal digits."""
    digits = BITS // 4
    return F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit((1 << BITS) - 1))), digits, "0")), ""))


def fingerprint(hashes: Column) -> Column:
    """Packed fingerprint of an array of 64-bit gram hashes; the empty text for no hashes."""
    bounds = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.shiftleft(j.cast("long"), SHIFT).bitwiseOR(F.lit((1 << SHIFT) - 1)))
    values = F.transform(hashes, lambda h: h.bitwiseAND(F.lit((1 << 63) - 1)))
    ordered = F.sort_array(F.concat(values, bounds))
    number = lambda v: F.shiftright(v, SHIFT)
    firsts = let(ordered, lambda o: F.filter(o, lambda v, i: (i == 0) | (number(v) != number(F.get(o, i - 1)))))
    full = lambda v: v.bitwiseAND(F.lit((1 << SHIFT) - 1)) != F.lit((1 << SHIFT) - 1)

    def densified(m: Column) -> Column:
        at = lambda h, t: F.get(m, _donor_bin(h, t))

        def donor(h: Column) -> Column:
            near = [F.when(full(at(h, F.lit(t))), at(h, F.lit(t))) for t in range(PROBES)]
            rest = F.filter(F.sequence(F.lit(PROBES), F.lit(BINS - 1)), lambda t: full(at(h, t)))
            return F.coalesce(*near, at(h, F.get(rest, F.lit(0))))

        return F.transform(m, lambda v, j: F.when(full(v), v).otherwise(let(F.xxhash64(j), donor)))

    return F.when(F.size(hashes) == 0, F.lit("")).otherwise(_low_bits(let(firsts, densified)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two fingerprints, corrected for chance agreement of low bits, from 0 to 1. Two empty ones are
    alike, an empty one and another are not."""
    digits = BITS // 4
    same = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda s, i: s + (F.substring(a, i * digits + 1, F.lit(digits)) == F.substring(b, i * digits + 1, F.lit(digits))).cast("int"))
    chance = 1.0 / (1 << BITS)
    est = F.greatest(F.lit(0.0), (same / float(BINS) - chance) / (1 - chance))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(est)


def text_fingerprint(text: Column) -> Column:
    return fingerprint(grams(split_words(text), WORDS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """`docs` with `fingerprint` of its `text`. A text of fewer than five words has them all as its one gram."""
    d = docs.withColumn("_hashes", grams(split_words(text_of()), WORDS))
    return d.withColumn("fingerprint", fingerprint(F.col("_hashes"))).drop("_hashes")


def id_slices(docs: DataFrame, slices: int) -> Column:
    """A slice number that never decreases along (doc_id, NULL first, then `_hash`), of nearly equal row counts.

    Borders are quantile sketches of the ids. An id that is a border itself, as one that many rows have, is cut by its
    rows' hashes, and so are NULL ids. Borders are searched in two steps of about the square root of their number.
    """
    probs = F.array(*[F.lit(k / slices) for k in range(1, slices)])
    found = docs.agg(F.percentile_approx("doc_id", probs, 10 * slices)).first()[0] if slices > 1 else None
    borders = sorted(set(found or []))
    step = max(1, int(len(borders) ** 0.5))
    blocks = [borders[k : k + step] for k in range(0, len(borders), step)]
    none, v = F.array().cast("array<bigint>"), F.col("doc_id")
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else none
    coarse = F.size(F.filter(longs([b[0] for b in blocks]), lambda x: x <= v))
    block = F.coalesce(F.get(F.array(*[longs(b) for b in blocks]) if blocks else F.array(none), coarse - 1), none)
    at = let(F.struct(coarse.alias("c"), block.alias("b")), lambda x: 2 * (step * F.greatest(x["c"] - 1, F.lit(0)) + F.size(F.filter(x["b"], lambda y: y <= v))) - F.array_contains(x["b"], v).cast("int"))
    part = F.shiftright("_hash", 54) + 512
    return F.when(v.isNull(), part - 1024).otherwise(let(F.struct(at.alias("at"), part.alias("part")), lambda x: x["at"].cast("long") * 1024 + F.when(x["at"] % 2 == 1, x["part"]).otherwise(F.lit(0))))


def with_next(docs: DataFrame, more, cols: list[str]) -> DataFrame:
    """Attach `next_<col>` of the next row in descending doc_id order to `docs` (doc_id, text), to which `more` adds columns;
    the last row gets the first row's.

    Slices along the ids are windowed apart. Their edge rows are found by id and hash alone, and only those rows' texts are
    fetched and seen by `more` once again. Rows of equal ids are ordered by a hash of their text.
    """
    n = docs.count()
    placed = docs.withColumn("_hash", F.xxhash64("text"))
    slices = id_slices(docs, min(4096, max(1, int(4 * n**0.5))))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash")]
    inside = W.partitionBy("_slice").orderBy(*order)
    d = more(placed.withColumn("_slice", slices))
    d = d.withColumns({"_first": F.row_number().over(inside) == 1, **{f"_{c}": F.lag(c).over(inside) for c in cols}})

    # one row per slice
    top = F.max_by(F.struct("doc_id", "_hash"), F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "_hash")).alias("_top")
    ends = stored(placed.select("doc_id", "_hash", slices.alias("_slice")).groupBy("_slice").agg(top), "edges")
    chain = W.orderBy("_slice")
    before = F.coalesce(F.lag("_top").over(chain), F.max_by("_top", "_slice").over(W.partitionBy()))
    ends = ends.select("_slice", before.alias("_t")).select("_slice", F.col("_t.doc_id").alias("_id"), F.col("_t._hash").alias("_h"))
    rows = placed.join(ends.select("_id", "_h").distinct(), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left_semi").dropDuplicates(["doc_id", "_hash"])
    rows = more(rows).select(F.col("doc_id").alias("_rid"), F.col("_hash").alias("_rh"), F.struct(*cols).alias("_top"))
    links = ends.join(rows, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_h") == F.col("_rh"))).select("_slice", "_top")
    d = d.join(links, "_slice").drop("_slice", "_hash")
    return d.select(*[c for c in d.columns if c[0] != "_"], *[F.when(F.col("_first"), F.col("_top")[c]).otherwise(F.col(f"_{c}")).alias(f"next_{c}") for c in cols])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the head of the next document's.

    `doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`. NULL is the empty text,
    which has an empty fingerprint; NULL ids come last in descending order; rows with equal ids are ordered by a hash
    of their text; a single row is its own next one. Other columns are ignored; an empty table gives no rows.
    """
    d = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), fingerprints, ["text", "fingerprint"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), "fingerprint", "next_fingerprint")
    d = d.withColumn("_hashes", grams(split_words(F.col("_edited")), WORDS)).withColumn("edited_sha256", F.sha2("_edited", 256))
    d = d.withColumn("edited_fingerprint", fingerprint(F.col("_hashes")))
    near = {"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint"))}
    return d.withColumns(near).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)

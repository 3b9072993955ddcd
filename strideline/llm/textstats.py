"""Statistics of whole texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import split_words, text_of

SYMBOLS = r"[#*$%&|<>]"


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words inside runs of `size` words that occur twice or more in the text, first occurrences included.

    Run hashes are sorted; only if two are equal are they sorted again with their places, and the places of
    repeated runs are turned into covered words by the gaps between them.
    """
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(size)]).alias("h"), i.alias("i")))
    placed = F.sort_array(runs)

    def covered(p: Column) -> Column:
        h = lambda i: F.get(p, i)["h"]
        again = F.filter(p, lambda x, i: (x["h"] == h(i - 1)).eqNullSafe(True) | (x["h"] == h(i + 1)).eqNullSafe(True))
        at = F.sort_array(F.transform(again, lambda x: x["i"]))
        return F.transform(F.array(at), lambda a: F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(0), lambda s, i: s + F.least(F.coalesce(F.get(a, i + 1) - F.get(a, i), F.lit(size)), F.lit(size))))[0]

    some = F.transform(F.array(placed), lambda p: F.when(F.exists(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.get(p, i)["h"] == F.get(p, i - 1)["h"]), covered(p)).otherwise(0))[0]
    return F.when(n > size, some).otherwise(0)


def with_stats(docs: DataFrame) -> DataFrame:
    """`docs` with counts of its `text` (NULL: no words): `n_words, word_chars, n_symbols, n_upper, n_digits, n_marks,
    n_lines, n_dup_lines, n_repeat_words, n_distinct`, all long."""
    t = text_of()
    d = docs.withColumn("_words", split_words(t)).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w, lines = F.col("_words"), F.col("_lines")
    counts = {
        "n_words": F.size(w),
        "word_chars": F.char_length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "n_digits": F.regexp_count(t, F.lit("[0-9]")),
        "n_marks": F.regexp_count(t, F.lit(r"[!-/:-@\[-`{-~]")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(w),
        "n_distinct": F.size(F.array_distinct(w)),
    }
    return d.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("_words", "_lines")

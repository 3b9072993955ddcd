"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.session import ensure_checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """A text column with NULL read as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def split_words(text: Column) -> Column:
    """Words between runs of ASCII white space, none of them empty."""
    return F.array_remove(F.split(text, SPACE), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is. Texts of ASCII alone take the quicker `lower`."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def content_words(text: Column) -> Column:
    """Lower-case words (A-Z only) of digits, a-z and characters beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(text), NON_WORD), "")


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it several times in `body`."""
    return F.transform(F.array(value), body)[0]


def grams(words: Column, size: int, short: bool = True) -> Column:
    """64-bit hashes of all runs of `size` words; with `short`, a shorter sequence that isn't empty counts as one run."""

    def hashed(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
        none = F.array().cast("array<bigint>")
        rest = F.when(n == 0, none).otherwise(F.array(F.xxhash64(w))) if short else none
        return F.when(n >= size, runs).otherwise(rest)

    # bound once: the optimizer may move `words` itself into the function that runs once a word
    return let(words, hashed)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder below the checkpoint folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write `df` to the shared folder as Parquet and go on from the written table. The shuffle files of the write are
    let go at once: the table stands for them. `dropped` removes the table when nothing reads it any more."""
    spark = df.sparkSession
    path, before = shared_path(spark, kind), spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove stored tables that no later job reads."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(conf).delete(path, True)

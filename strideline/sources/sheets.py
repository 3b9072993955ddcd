"""Order sheets, ordered output, metadata contracts and tables scraped from logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.functions.text import last_component, scrape_cells, section_from
from strideline.operators.align import id_issues


class SheetError(ValueError):
    """The sheet cannot be answered: ids are missing."""


def read_sheet(sheet: DataFrame, path: str, pos: str) -> DataFrame:
    """(pos, path, id) of a sheet: the id is the last path component."""
    return sheet.select(pos, path, last_component(path).alias("id"))


def sheet_issues(sheet: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(id, issue): blank and duplicate ids, listed ids without a clip, clips not listed."""
    blank = sheet.filter((F.col("id") == "") | F.col("id").isNull()).select(F.lit("").alias("id"), F.lit("blank").alias("issue"))
    good = sheet.filter(F.col("id") != "").select("id")
    found = id_issues(good, index.select(F.col(key).alias("id")), "id")
    named = F.when(F.col("issue") == "missing", "listed_but_missing").when(F.col("issue") == "extra", "present_but_unlisted").otherwise("duplicate")
    return blank.unionByName(found.select("id", named.alias("issue")))


def fill_sheet(sheet: DataFrame, predictions: DataFrame, key: str, pred: str) -> DataFrame:
    """Exactly the sheet's rows with their prediction (NULL where there is none); others are dropped."""
    return sheet.join(predictions.select(F.col(key).alias("id"), pred), "id", "left").select("pos", "path", pred)


def write_sheet(filled: DataFrame, pred: str, path: str, parts: int | None = None) -> None:
    """Write in sheet order, after checking that every row has a prediction.

    Rows are range-partitioned by position: file names in order hold rows in order, whatever their
    number, and no single task sees them all. One part gives the single small file of a submission.
    """
    lost = filled.filter(F.col(pred).isNull()).count()
    if lost:
        raise SheetError(f"{lost} sheet rows have no prediction")
    ranged = filled.repartitionByRange(parts, "pos") if parts else filled.repartitionByRange("pos")
    ranged.sortWithinPartitions("pos").select("path", pred).write.mode("overwrite").option("header", "true").csv(path)


def contract_violations(meta: DataFrame, key: str, label: str, required: Sequence[str], n_classes: int) -> DataFrame:
    """(rule, n) for every broken rule: missing columns, repeated or empty ids, labels out of range or
    classes without a row."""
    spark = meta.sparkSession
    missing = [c for c in required if c not in meta.columns]
    empty = F.sum((F.col(key).isNull() | (F.col(key).cast("string") == "")).cast("long"))
    outside = F.sum((F.col(label).isNull() | ~F.col(label).between(0, n_classes - 1)).cast("long"))
    one = meta.agg(empty.alias("empty_id"), outside.alias("label_out_of_range"))
    dup = meta.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("n")).scalar()
    seen = meta.filter(F.col(label).between(0, n_classes - 1)).agg(F.count_distinct(label).alias("n")).scalar()
    d = one.withColumns({"duplicate_id": dup, "classes_without_rows": F.lit(n_classes) - seen, "missing_columns": F.lit(len(missing)).cast("long")})
    rules = ["empty_id", "label_out_of_range", "duplicate_id", "classes_without_rows", "missing_columns"]
    return d.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("long").alias("n")) for r in rules])).alias("x")).select("x.*").filter("n > 0")


def scrape_table(texts: DataFrame, key: str, text: str, start: str, pattern: str, span: int | None = None) -> DataFrame:
    """(key, name, value) cells of the section that begins with a marker."""
    d = texts.select(key, section_from(text, start, span).alias("_s")).filter(F.col("_s").isNotNull())
    return d.select(key, F.explode(scrape_cells("_s", pattern)).alias("_c")).select(key, F.col("_c.key").alias("name"), F.col("_c.value").alias("value"))

"""Column functions that read structure out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed value: date and time as file names carry them.
NAME_TIME = r"(\d{4}-\d{2}-\d{2})_(\d{2}-\d{2}-\d{2}\.\d+)"


def timestamp_from_name(name) -> Column:
    """`..2024-01-31_12-05-09.25..` inside a file name, NULL where there is none."""
    day, time = (F.regexp_extract(_col(name), NAME_TIME, k) for k in (1, 2))
    text = F.concat_ws(" ", day, F.translate(time, "-", ":"))
    return F.when(day != "", F.try_to_timestamp(text))


def parse_timestamp(text) -> Column:
    """`Y-M-D h:m:s[.f]`, also with one-digit parts; NULL where it does not parse."""
    s = F.trim(_col(text))
    shape = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?$"
    return F.when(F.regexp_like(s, F.lit(shape)), F.try_to_timestamp(s, F.lit("yyyy-M-d H:m:s[.SSSSSS]")))


def last_component(path) -> Column:
    """The id in `folder/id/` or `folder/id`."""
    return F.element_at(F.split(F.trim(_col(path), F.lit("/")), "/"), -1)


def role_overrides(text) -> Column:
    """`role=tag+tag;role=tag` -> map of role to its list of tags."""
    specs = F.filter(F.split(_col(text), ";"), lambda s: F.contains(s, F.lit("=")))
    role = lambda s: F.split(s, "=", 2)[0]
    tags = lambda s: F.filter(F.split(F.split(s, "=", 2)[1], r"\+"), lambda t: t != "")
    return F.map_from_arrays(F.transform(specs, role), F.transform(specs, tags))


def scrape_cells(text, pattern: str) -> Column:
    """Every match of a two-group pattern as (key, value); a later match of a key wins downstream."""
    keys = F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(2))
    return F.arrays_zip(keys.alias("key"), values.alias("value"))


def section_from(text, start: str, span: int | None = None) -> Column:
    """The text from the first `start` marker on (at most `span` characters), NULL without one."""
    t = _col(text)
    at = F.locate(start, t)
    tail = F.substring(t, at, F.lit(span) if span else F.length(t))
    return F.when(at > 0, tail)

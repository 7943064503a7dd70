"""Edge lists and node lists in text files, whose names may carry a date."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.resolution import Resolution

DATE = r"(\d{4}-\d{2}-\d{2})"


def in_range(names: Iterable[str], first: datetime.date, last: datetime.date) -> list[str]:
    """Names with a date from first to last, both inclusive."""
    import re

    found = ((n, re.search(DATE, n)) for n in names)
    return [n for n, m in found if m and first <= datetime.date.fromisoformat(m[1]) <= last]


def monthly_paths(root: str, kind: str, first: datetime.date, last: datetime.date) -> list[str]:
    """`<kind>yyyy-mm-01.txt` for every month from first to last."""
    months = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
    return [f"{root}/{kind}{m // 12:04d}-{m % 12 + 1:02d}-01.txt" for m in months]


def edge_list(spark: SparkSession, paths: str | list[str], canonical: bool = False) -> DataFrame:
    """(src, dst, attr) of lines "src dst [int]"; blank lines and comments (#) are skipped, a missing value is 1.

    Canonical turns edges so that src <= dst. Small files are packed into splits by Spark's reader.
    """
    lines = spark.read.text(paths).select("*", F.col("_metadata.file_path").alias("file"))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.trim("value").rlike("^(#|$)")).select("file", parts.alias("p"))
    bad = F.raise_error(F.concat(F.lit("not an edge: "), F.array_join("p", " ")))
    src, dst = (F.when(F.size("p") >= 2, F.get("p", F.lit(i)).cast("long")).otherwise(bad) for i in (0, 1))
    rows = rows.select("file", src.alias("src"), dst.alias("dst"), F.coalesce(F.get("p", F.lit(2)).cast("int"), F.lit(1)).alias("attr"))
    if canonical:
        rows = rows.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    return rows.select("src", "dst", "attr", "file")


def dated_edge_lists(spark: SparkSession, paths: list[str], first: datetime.date, resolution: Resolution, canonical: bool = False) -> DataFrame:
    """Edge lists with the time index of the date in each file's path, counted in the resolution from first."""
    day = F.to_date(F.regexp_extract("file", DATE, 1))
    return edge_list(spark, paths, canonical).withColumn("t", resolution.index(day, resolution.anchor(F.lit(first)))).drop("file")


def node_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(vid, attr) of lines "vid [text]"."""
    lines = spark.read.text(paths).where(~F.trim("value").rlike("^(#|$)"))
    m = F.regexp_extract(F.trim("value"), r"^(\S+)\s*(.*)$", 1), F.regexp_extract(F.trim("value"), r"^(\S+)\s*(.*)$", 2)
    return lines.select(m[0].cast("long").alias("vid"), m[1].alias("attr"))


def write_degree_distribution(distribution: DataFrame, path: str) -> None:
    """Lines "degree count" in the order of degrees; the distribution has a row for each degree."""
    distribution.orderBy("degree").select(F.concat_ws(" ", "degree", "n").alias("value")).coalesce(1).write.text(path)

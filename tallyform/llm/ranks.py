"""Row numbers within ordered classes without gathering a class in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def id_hash(col) -> F.Column:
    """0 .. 2^32-1 from the MD5 of the id's text; a null id as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def salts(n_rows: int) -> int:
    """Parts of each class: about 100,000 rows in each even when one class holds all rows."""
    return max(64, -(-n_rows // 100_000))


def class_ranks(rows: DataFrame, classes: list[str], id_col: str, n_salts: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows and ``rank``: 1, 2, ... within each class, by (id_hash mod n_salts, id, ties).

    Each class is dealt over n_salts parts; a row's rank is its number within its part plus the sizes of the parts
    before, so the largest window is one part. classes may not be null.
    """
    salted = rows.withColumn("salt", F.pmod(id_hash(id_col), F.lit(n_salts)))
    parts = salted.groupBy(*classes, "salt").agg(F.count("*").alias("part_n"))
    before = parts.withColumn("before", F.sum("part_n").over(Window.partitionBy(*classes).orderBy("salt")) - F.col("part_n")).drop("part_n")
    own = F.row_number().over(Window.partitionBy(*classes, "salt").orderBy(F.col(id_col).asc_nulls_first(), *ties))
    return salted.withColumn("own", own).join(before, [*classes, "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt")

"""Shared plumbing: row locators, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, remove, scratch, scratch_dir, settings, written

__all__ = ["WORD", "connected_components", "located", "new_path", "remove", "scratch", "scratch_dir", "settings", "small_batches", "written"]

#: Spark SQL (Java) pattern of a word: what no ASCII white space breaks.
WORD = r"[^\x20\x09-\x0D]+"


def located(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of docs as one struct, so that no name can clash), ``loc_file`` and ``loc_row``: where the row is stored.

    A table that isn't read straight from Parquet files is written to the shared folder first.
    """
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except Exception:  # noqa: BLE001  the analyser has no narrower type for a missing metadata column
        docs = written(docs, "docs")[0]
    meta = docs.metadataColumn("_metadata")
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), meta["file_path"].alias("loc_file"), meta["row_index"].alias("loc_row"))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds what one Arrow batch of long texts can hold, for a plan that the caller runs later: the session keeps the setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): for each end of an edge (src, dst; longs) the smallest id that it reaches.

    Alternating large-star and small-star rounds: each node's neighbours are hung on their smallest, until
    nothing changes. Rounds are cut by tables in the shared folder. A hub's edges stay rows of joins and
    partial aggregates; no task or driver gathers them.
    """
    spark = edges.sparkSession
    up = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, path = written(up, "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        then, to = written(small, "edges")
        after = _mark(then)
        remove(spark, path)
        now, path = then, to
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]

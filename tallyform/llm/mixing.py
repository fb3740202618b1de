"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import class_ranks, salts
from .util import WORD, located, written

WEIGHTS = (5, 2, 1)
MOST = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(has_source, source, source_size, target) of (has_source, source, source_size long): one row per source.

    Sources by code point, null last, take the weights in turn. Targets share the whole size by weight, none above
    ``most`` times its source; in the order of limit to weight a source is held at its limit while its share of
    what is left, by the weights left, exceeds it. Integers until the last division. Windows run over one row per
    source.
    """
    order = Window.orderBy(F.col("has_source").desc(), "source")
    named = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("decimal(38,0)")).withColumn("cap", (F.col("source_size") * most).cast("decimal(38,0)"))
    by_limit = Window.orderBy((F.col("cap").cast("double") / F.col("w").cast("double")), F.col("has_source").desc(), "source").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy()
    left = named.withColumn("left", F.sum("source_size").over(all_of) - F.coalesce(F.sum("cap").over(by_limit), F.lit(0))).withColumn("w_left", F.sum("w").over(all_of) - F.coalesce(F.sum("w").over(by_limit), F.lit(0)))
    held = left.withColumn("held", F.col("left").cast("decimal(30,0)") * F.col("w").cast("decimal(8,0)") > F.col("cap").cast("decimal(30,0)") * F.col("w_left").cast("decimal(8,0)"))
    free = held.withColumn("free_n", F.sum("source_size").over(all_of) - F.coalesce(F.sum(F.when(F.col("held"), F.col("cap"))).over(all_of), F.lit(0))).withColumn("free_w", F.sum(F.when(~F.col("held"), F.col("w"))).over(all_of))
    target = F.when(F.col("held"), F.col("cap").cast("double")).otherwise(F.col("free_n").cast("double") * F.col("w").cast("double") / F.col("free_w").cast("double"))
    return free.select("has_source", "source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken, loc_file, loc_row.

    Each row of a source is expected target / source_size times. In the order (size falling, salted id, id, locator)
    the prefix sum of that, plus one offset in [0, 1) from the source's name, crosses an integer once per copy; larger
    rows first keep the words taken within the largest row's size of the target. Null texts have size 0; a null
    source is a source of its own; a source without words takes nothing; an empty table gives no rows. Repeated rows
    count as rows.
    """
    return _mix(located(docs), id_col, text_col, source_col)


def _mix(base: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text, source = F.col(f"row.`{text_col}`"), F.col(f"row.`{source_col}`").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows, _ = written(base.select(F.col(f"row.`{id_col}`").alias("doc_id"), source.isNotNull().alias("has_source"), F.coalesce(source, F.lit("")).alias("source"), size.alias("size"), "loc_file", "loc_row"), "sizes")
    classes = ["has_source", "source", "size"]
    n = rows.count()
    counts = rows.groupBy(*classes).agg(F.count("*").alias("n"))
    below = counts.withColumn("larger", F.sum("n").over(Window.partitionBy("has_source", "source").orderBy(F.col("size").desc())) - F.col("n")).drop("n")
    targets = source_targets(counts.groupBy("has_source", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    offset = (F.conv(F.substring(F.md5("source"), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20)))
    ranked = class_ranks(rows, classes, "doc_id", salts(n), ("loc_file", "loc_row")).join(below.join(targets, ["has_source", "source"]), classes)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("rank") + F.col("larger")
    copies = F.least(F.floor(offset + rank * rate) - F.floor(offset + (rank - 1) * rate), F.lit(MOST)).cast("long")
    return ranked.withColumn("copies", copies).select(
        "doc_id", F.when(F.col("has_source"), F.col("source")).alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "loc_file", "loc_row",
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it, in their own columns."""
    base = located(docs)
    copies = _mix(base, id_col, text_col, source_col).where("copies > 0").select("loc_file", "loc_row", "copies")
    return base.join(copies, ["loc_file", "loc_row"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


MIX_SQL = r"""
WITH r AS (
  SELECT doc_id, source IS NOT NULL AS has_source, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % (SELECT greatest(64, (count(*) + 99999) // 100000) FROM documents) AS salt
  FROM documents),
s AS (SELECT has_source, source, sum(size)::BIGINT AS source_size FROM r GROUP BY ALL),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY has_source DESC, source) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS t_left, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left
      FROM w WINDOW o AS (ORDER BY cap / w, has_source DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, t_left * w > cap * w_left AS held FROM l),
t AS (SELECT *, CASE WHEN held THEN cap::DOUBLE ELSE
        (sum(source_size) OVER () - coalesce(sum(cap) FILTER (held) OVER (), 0))::DOUBLE * w::DOUBLE / (sum(w) FILTER (NOT held) OVER ())::DOUBLE END AS target FROM h),
k AS (SELECT doc_id, size, source_size, target, ('0x' || substr(md5(r.source), 1, 5))::INT / 1048576.0::DOUBLE AS u,
        row_number() OVER (PARTITION BY has_source, source ORDER BY size DESC, salt, doc_id NULLS FIRST) AS rank,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
      FROM r JOIN t USING (has_source, source))
SELECT doc_id, size, source_size, target, (size * least(floor(u + rank * rate) - floor(u + (rank - 1) * rate), 3))::BIGINT AS taken FROM k
"""

"""Image statistics: brightness and contrast, blank pages, a global threshold, scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, brightness, contrast, is_blank): mean and population deviation; blank under 2, or over 252 and under 5."""
    stats = pixels.groupBy(*keys).agg(F.avg(value).alias("brightness"), F.stddev_pop(value).alias("contrast"))
    return stats.withColumn("is_blank", (F.col("contrast") < 2) | ((F.col("brightness") > 252) & (F.col("contrast") < 5)))


def estimated_dpi(width: Column, stated: Column) -> Column:
    return F.coalesce(stated.cast("int"), F.when(width >= 2000, 300).when(width >= 1000, 150).otherwise(96))


def adaptive_scale(width: Column, height: Column, target: int = 2400) -> Column:
    return F.when((width >= target) | (height >= target), 1.0).otherwise(F.least(F.lit(3.0), F.greatest(F.lit(1.0), F.lit(float(target)) / F.greatest(width, F.lit(1)))))


def thresholds(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold): the first bin of 0..255 with the greatest variance between classes; 128 if none is above zero."""
    counts = bins.groupBy(*keys, "bin").agg(F.count("*").cast("double").alias("n"))
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy(*keys)
    mass = F.col("bin") * F.col("n")
    cum = counts.select(*keys, "bin", F.sum("n").over(up).alias("wb"), F.sum(mass).over(up).alias("sb"), F.sum("n").over(all_of).alias("w"), F.sum(mass).over(all_of).alias("s"))
    between = F.when(F.col("wb") < F.col("w"), F.col("wb") * (F.col("w") - F.col("wb")) * F.pow(F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / (F.col("w") - F.col("wb")), 2)).otherwise(0.0)
    best = cum.groupBy(*keys).agg(F.min(F.struct((-between).alias("v"), "bin")).alias("_best"))
    return best.select(*keys, F.when(F.col("_best.v") < 0, F.col("_best.bin")).otherwise(128).cast("int").alias("threshold"))


def padded_crop(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column, padding: int = 6) -> Column:
    left, top = F.greatest(F.lit(0), x - padding), F.greatest(F.lit(0), y - padding)
    return F.struct(left.alias("left"), top.alias("top"), F.least(image_width, x + width + padding).alias("right"), F.least(image_height, y + height + padding).alias("bottom"))

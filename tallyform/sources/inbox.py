"""Where data comes from: image folders, the OCR boundary, JSON batches, OCR text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..schemas import BATCH, OCR_TOKENS


def is_image(path) -> F.Column:
    return F.lower(F.regexp_extract(path, r"[.]([^.]+)$", 1)).isin(*fixed.IMAGE_SUFFIXES)


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content, sha256 of non-empty images of a folder or one file."""
    found = spark.read.format("binaryFile").load(path).where(is_image(F.col("path")) & (F.col("length") > 0))
    return found.withColumn("sha256", F.sha2("content", 256))


def image_stream(spark: SparkSession, path: str, archive: str | None = None, per_batch: int = 1000) -> DataFrame:
    """The same as a stream; files are put there by rename, so what is listed is complete. archive: where done ones go."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    found = reader.load(path).where(is_image(F.col("path")) & (F.col("length") > 0))
    return found.withColumn("sha256", F.sha2("content", 256))


def ocr_tokens(found: DataFrame, engine: Callable[[], Callable[[bytes, str], list[tuple]]], variants: tuple[str, ...] = ("A", "B", "C"), faint: str = "D", faint_below: float = 20.0) -> DataFrame:
    """OCR_TOKENS of images (sha256, content, maybe contrast) by any engine: a factory, called once per task, of
    (content, variant) -> [(text, left, top, width, height, confidence, scale)].

    Images whose contrast is below faint_below are read in one variant more.

    Blank texts and negative or null confidences are dropped; coordinates are taken back to the image's own pixels.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = engine()
        for batch in batches:
            rows = []
            for sha, content, variant in zip(batch["sha256"], batch["content"], batch["variant"], strict=True):
                for k, (text, x, y, w, h, conf, scale) in enumerate(read(bytes(content), variant)):
                    s = max(scale, 1e-4)
                    rows.append((sha, variant, k, text, *(int(round(v / s)) for v in (x, y, w, h)), conf))
            yield pd.DataFrame(rows, columns=[f.name for f in OCR_TOKENS.fields])

    usual = F.array(*map(F.lit, variants))
    asked = F.when(F.col("contrast") < faint_below, F.concat(usual, F.array(F.lit(faint)))).otherwise(usual) if "contrast" in found.columns else usual
    each = found.select("sha256", "content", F.explode(asked).alias("variant"))
    return sound_tokens(each.mapInPandas(run, OCR_TOKENS))


def sound_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.where((F.trim("text") != "") & (F.col("confidence") >= 0))


def json_batches(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of written batches: image, file_no and the record's columns."""
    found = spark.read.schema(BATCH).json(list(paths), multiLine=True)
    return found.select("image", "file_no", F.explode("records").alias("r")).select("image", "file_no", "r.*")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed non-blank lines of OCR text."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")

"""Where results go. Spark's commit protocol takes the place of write-then-rename."""

from __future__ import annotations

import glob
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import columns as C
from ..functions import fixed
from ..operators import ledger


def write_batch(records: DataFrame, path: str) -> None:
    """records (image, file_no, status, ...) as JSON under structured/ by file number and status.

    Each image's rows keep its key, so images of one file number don't overwrite each other.
    """
    records.write.mode("append").partitionBy("file_no", "status").json(f"{path}/structured")


#: Outcome tables of a batch.
SUCCESSFUL, REVIEW, FAILED = "successful", "review", "failed"


def outcome(status: Column) -> Column:
    """Which table a result belongs to by its status: what is neither validated nor in review has failed."""
    return F.when(status == "VALIDATED", SUCCESSFUL).when(status == "REVIEW_REQUIRED", REVIEW).otherwise(FAILED)


class BatchOutputs:
    """Outcome tables of a stream of batches, each result in them once, however often a batch runs.

    A batch is one folder, ``batch=<number>/outcome=<table>/``, written in one pass over its results and replaced as a
    whole when the batch runs again. Readers take the batches that Spark has marked as complete, so what a killed batch
    left half-written is not seen. ``write`` fits ``foreachBatch``.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, results: DataFrame, batch: int) -> dict[str, int]:
        """Writes results (status and any other columns) and returns their counts by status, issues too where they have
        them. The counts are taken on the way of the same pass and stand, with
        the seconds it took, as one row in the table of counts."""
        seen, began = Observation(f"batch {batch}"), time.perf_counter()
        n_issues = F.coalesce(F.sum(F.size("issues")), F.lit(0)) if "issues" in results.columns else F.lit(0)
        status = F.coalesce("status", F.lit("FAILED"))
        of = {name: F.count_if(status == name) for name in ("VALIDATED", "REVIEW_REQUIRED")}
        watched = results.observe(seen, F.count("*").alias("results"), *[n.alias(name) for name, n in of.items()], n_issues.cast("long").alias("issues"))
        watched.withColumn("outcome", outcome(F.col("status"))).write.mode("overwrite").partitionBy("outcome").json(f"{self.path}/results/batch={batch}")
        counts = {k: v or 0 for k, v in seen.get.items()}
        counts["FAILED"] = counts["results"] - counts["VALIDATED"] - counts["REVIEW_REQUIRED"]
        row = results.sparkSession.createDataFrame([(counts["results"], counts["VALIDATED"], counts["REVIEW_REQUIRED"], counts["FAILED"], counts["issues"], round(time.perf_counter() - began, 3))], COUNTS)
        row.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(f"{self.path}/counts/batch={batch}")
        return counts

    def _complete(self, spark: SparkSession, table: str) -> list[str]:
        """Folders of batches that were written to their end."""
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return [f"{self.path}/{table}/{n}" for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/{n}/_SUCCESS"))]

    def read(self, spark: SparkSession, table: str, schema: str) -> DataFrame:
        """The results of one outcome table: schema's columns and batch."""
        folders, columns = self._complete(spark, "results"), f"{schema}, batch long, outcome string"
        rows = spark.read.schema(columns).option("basePath", f"{self.path}/results").json(folders) if folders else spark.createDataFrame([], columns)
        return rows.where(F.col("outcome") == table).drop("outcome")

    def counts(self, spark: SparkSession) -> DataFrame:
        """One row per complete batch: COUNTS, written_at, batch."""
        folders, columns = self._complete(spark, "counts"), f"{COUNTS}, written_at timestamp, batch long"
        return spark.read.schema(columns).option("basePath", f"{self.path}/counts").json(folders) if folders else spark.createDataFrame([], columns)

    def rebuilt(self, spark: SparkSession, schema: str) -> DataFrame:
        """Every record once, over all batches: of equal fingerprints a successful one first, then the earliest batch's."""
        both = (self.read(spark, name, schema) for name in (SUCCESSFUL, REVIEW))
        return ledger.newest_records(*both)


COUNTS = "results long, validated long, review_required long, failed long, issues long, seconds double"


def conversion_proofs(pairs: DataFrame) -> DataFrame:
    """(image, source_sha256, converted_sha256, created_at) of (image, source, converted) contents."""
    return pairs.select("image", F.sha2("source", 256).alias("source_sha256"), F.sha2("converted", 256).alias("converted_sha256"), F.current_timestamp().alias("created_at"))


def entry_script(records: DataFrame) -> DataFrame:
    """(k, line): for each complete record that is validated or in review, its values as escaped literals, in order of form_no."""
    whole = records.where(F.col("status").isin("VALIDATED", "REVIEW_REQUIRED") & (F.size("fields") == len(fixed.FIELDS)))
    values = F.transform(F.array(*map(F.lit, fixed.FIELDS)), lambda n: F.concat(F.lit('"'), C.escaped_keys(F.coalesce(F.try_element_at(F.col("fields"), n)["value"], F.lit(""))), F.lit('"')))
    return whole.select("form_no", "record_number", F.concat(F.lit("records.Push(["), F.array_join(values, ", "), F.lit("])")).alias("line"))


SCRIPT_HEAD = ("#Requires AutoHotkey v2.0", "#SingleInstance Force", "records := []")
SCRIPT_TAIL = (
    "at := 1", "F6:: {", "    global at", "    if (at > records.Length)", "        return", "    for i, value in records[at] {",
    "        A_Clipboard := value", '        Send("^v")', "        Sleep(80)", '        Send("{Tab}")', "        Sleep(70)", "    }", "    at += 1", "}", "Esc::ExitApp()",
)


class ScriptSink(DataSource):
    """``write.format("keystroke_script").save(path)``: lines of sorted ranges, joined in order between head and tail.

    Each task writes its range as a part beside the script, on a mounted folder that all share; the committer copies the
    parts, one buffer at a time, into a file that takes the script's place when it is whole.
    """

    @classmethod
    def name(cls) -> str:
        return "keystroke_script"

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        return _ScriptWriter(self.options["path"], uuid.uuid4().hex)


@dataclass
class _Part(WriterCommitMessage):
    index: int
    path: str


class _ScriptWriter(DataSourceWriter):
    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        task = TaskContext.get()
        part = f"{self.path}.{self.job}.{task.partitionId()}.{task.taskAttemptId()}"
        with open(part, "w", encoding="utf-8") as out:
            out.writelines(row["line"] + "\n" for row in iterator)
        return _Part(task.partitionId(), part)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        whole = f"{self.path}.{self.job}.whole"
        with open(whole, "wb") as out:
            out.write(("\n".join(SCRIPT_HEAD) + "\n").encode())
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.index):
                with open(part.path, "rb") as lines:
                    shutil.copyfileobj(lines, out)
            out.write(("\n".join(SCRIPT_TAIL) + "\n").encode())
        os.replace(whole, self.path)
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for left in glob.glob(f"{glob.escape(self.path)}.{self.job}.*"):  # parts of lost attempts too
            os.remove(left)


def write_script(records: DataFrame, path: str) -> int:
    """Writes the keystroke script in order of form_no and record_number, by tasks; returns the records written."""
    spark, seen = records.sparkSession, Observation("script")
    spark.dataSource.register(ScriptSink)
    lines = entry_script(records).repartitionByRange("form_no", "record_number").sortWithinPartitions("form_no", "record_number")
    lines.observe(seen, F.count("*").alias("n")).select("line").write.format("keystroke_script").mode("overwrite").save(path)
    return seen.get["n"]

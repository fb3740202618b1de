"""Continuous ingestion: contents once each by state, gap-free numbers by commits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.commits import Ledger
from . import arrivals


def ingest(images: DataFrame, book: Ledger, checkpoint: str, name: str = "inbox"):
    """Starts the stream over what is there: new contents get file numbers in the ledger.

    What was seen is state of the stream (begun from what the ledger holds), and the next number stands in the newest
    commit, so a batch costs as much as it brings. A commit carries its batch, so one that runs again after a crash
    numbers nothing twice.
    """
    new = arrivals.first_seen(images, book.snapshot().images())
    return new.writeStream.foreachBatch(lambda rows, batch: book.append_files(rows, (name, batch)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_by_key(stream: DataFrame, key: str, checkpoint: str, sink: str):
    """A stream without repeats of a key, kept in state, appended to Parquet."""
    return stream.dropDuplicates([key]).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

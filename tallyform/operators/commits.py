"""A ledger as numbered commits: images, records, sessions and sequences that several writers may change at once.

A commit is one small JSON file, named by its number, that says which data folders came and went and where the
sequences stand after it. A writer reads the newest commit, writes its rows as new folders that nobody sees yet, and
publishes its file under the next number, which only one writer can do; whoever was second starts over on what the
first left. Readers hold the number they began with, so what they see never changes under them.
"""

from __future__ import annotations

import dataclasses
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import remove, scratch
from . import ledger as L

IMAGES = "sha256 string, file_no bigint, path string, processed_at timestamp"
RECORDS = "fingerprint string, form_no bigint, status string, created_at timestamp"
SESSION = "session_date string, started_at string, file_no bigint, starting_form_no bigint, last_form_no bigint, status string"
ENTRY = (
    "version bigint, kind string, at string, batches map<string, bigint>, since bigint, adds array<string>, drops array<string>, next_form_no bigint, starting_file_no bigint, "
    f"group_start bigint, images bigint, highest_form_no bigint, highest_file_no bigint, session struct<{SESSION.replace(' ', ':').replace(',:', ', ')}>"
)
#: Records lie in folders by this many leading digits of their fingerprint's MD5, so a change of status rewrites few.
BUCKET_DIGITS = 1


class Refused(ValueError):
    """The numbers asked for are in use."""


class Lost(RuntimeError):
    """Other writers were first each time."""


@dataclasses.dataclass(frozen=True)
class Snapshot:
    """The ledger as of one commit."""

    book: Ledger
    entry: dict

    @property
    def version(self) -> int:
        return self.entry["version"]

    def _folders(self, kind: str) -> list[str]:
        """Live data folders: what commits since the last reset or compaction added and none dropped."""
        held: dict[str, None] = {}
        for e in self.book.entries(self.entry["since"], self.version):
            for name in e["drops"]:
                held.pop(name, None)
            held.update(dict.fromkeys(e["adds"]))
        return [f"{self.book.data}/{name}" for name in held if name.startswith(f"{kind}/")]

    def _read(self, kind: str, schema: str, names: list[str] | None = None) -> DataFrame:
        names = self._folders(kind) if names is None else names
        reader = self.book.spark.read.schema(f"{schema}, commit string, bucket string").option("basePath", f"{self.book.data}/{kind}")
        return reader.parquet(*names) if names else self.book.spark.createDataFrame([], f"{schema}, commit string, bucket string")

    def images(self) -> DataFrame:
        return self._read("images", IMAGES).drop("commit", "bucket")

    def records(self) -> DataFrame:
        return self._read("records", RECORDS).drop("commit", "bucket")

    def sessions(self) -> DataFrame:
        """All sessions up to this commit, those before a reset too: id, and the session's columns."""
        log = self.book.history().where((F.col("version") <= self.version) & F.col("session").isNotNull())
        return L.sequence(log.select("version", "session.*"), ["version"], "id").select("id", *[c.split()[0] for c in SESSION.split(", ")])

    def next_form_no(self) -> int:
        """After the highest unless the setting is beyond it."""
        return max(self.entry["next_form_no"], (self.entry["highest_form_no"] or 0) + 1)

    def next_file_no(self) -> int:
        return self.entry["starting_file_no"] + max(0, self.entry["images"] - self.entry["group_start"]) // L.IMAGES_PER_FILE

    def numbering_state(self) -> dict:
        return {"file_no": self.next_file_no(), "last_file_no": self.entry["highest_file_no"], "last_form_no": self.entry["highest_form_no"], "next_form_no": self.next_form_no()}

    def file_no_exists(self, file_no: int) -> bool:
        of_session = self.book.history().where((F.col("version") <= self.version) & (F.col("session.file_no") == file_no))
        return of_session.limit(1).count() > 0 or self.images().where(F.col("file_no") == file_no).limit(1).count() > 0

    def refusal(self, file_no: int, starting_form_no: int) -> str:
        """Why a new session can't have these numbers; empty if it can."""
        if file_no <= 0 or starting_form_no <= 0:
            return "numbers start at 1"
        if self.file_no_exists(file_no):
            return f"file number {file_no} is in use"
        if starting_form_no <= (self.entry["highest_form_no"] or 0):
            return f"form number {starting_form_no} isn't beyond {self.entry['highest_form_no']}"
        return ""


class Ledger:
    """The ledger in a folder that all writers share; one object per writer, or one for several threads.

    tries and pause: a writer that finds its number taken waits pause seconds more each time, tries times in all.
    """

    def __init__(self, spark: SparkSession, path: str, first_form: int = 110, first_file: int = 28, tries: int = 20, pause: float = 0.05):
        self.spark, self.tries, self.pause = spark, tries, pause
        self.log, self.data = f"{path.rstrip('/')}/log", f"{path.rstrip('/')}/data"
        self._jvm = spark.sparkContext._jvm
        where = self._jvm.org.apache.hadoop.fs.Path(self.log)
        self._fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(where)
        if not self._numbers():
            none = {"highest_form_no": None, "highest_file_no": None, "session": None, "batches": {}}
            self._publish({"version": 0, "kind": "start", "at": _now(), "since": 0, "adds": [], "drops": [], "next_form_no": first_form, "starting_file_no": first_file, "group_start": 0, "images": 0, **none})

    # the log

    def _file(self, version: int) -> str:
        return f"{self.log}/{version:020d}.json"

    def _numbers(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(self.log)))
        return sorted(int(n[:20]) for n in names if n.endswith(".json") and not n.startswith("."))

    def entries(self, first: int, last: int) -> list[dict]:
        """Commits first to last, oldest first: a few short lines each, no rows."""
        read = self.spark.read.schema(ENTRY).json([self._file(v) for v in range(first, last + 1)])
        return [r.asDict(recursive=True) for r in read.orderBy("version").collect()]

    def history(self) -> DataFrame:
        """The log as a table."""
        return self.spark.read.schema(ENTRY).json(self.log)

    def snapshot(self, version: int | None = None) -> Snapshot:
        version = self._numbers()[-1] if version is None else version
        return Snapshot(self, self.entries(version, version)[0])

    def _publish(self, entry: dict) -> bool:
        """Puts the commit's file in place, whole, unless another writer has that number.

        On a local disk a hard link to a finished file either makes the name or fails; elsewhere a rename that finds
        the name taken fails (on HDFS the name node decides). Stores without such a rename can't hold a ledger.
        """
        text, name = json.dumps(entry), f".{uuid.uuid4().hex}.tmp"
        there, tmp = (self._jvm.org.apache.hadoop.fs.Path(p) for p in (self._file(entry["version"]), f"{self.log}/{name}"))
        if self._fs.getUri().getScheme() == "file":
            files = self._jvm.java.nio.file.Files
            at = lambda p: self._jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri())
            files.write(at(tmp), bytearray(text.encode()), self.spark.sparkContext._gateway.new_array(self._jvm.java.nio.file.OpenOption, 0))
            try:
                files.createLink(at(there), at(tmp))
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            finally:
                files.delete(at(tmp))
            return True
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.rename(tmp, there):
            return True
        self._fs.delete(tmp, False)
        return False

    def commit(self, kind: str, change: Callable[[Snapshot], dict | None], batch: tuple[str, int] | None = None) -> Snapshot:
        """The ledger after ``change``, which is made anew on each snapshot until its commit is first; None changes nothing.

        batch: a stream's name and the number of its batch. A batch that runs again after its commit changes nothing.
        """
        for k in range(self.tries):
            held = self.snapshot()
            done = held.entry["batches"] or {}
            if batch is not None and done.get(batch[0], -1) >= batch[1]:
                return held
            with scratch(self.spark):
                change_of = change(held)
            if change_of is None:
                return held
            entry = held.entry | {"kind": kind, "at": _now(), "version": held.version + 1, "adds": [], "drops": [], "session": None, "batches": done | dict([batch] if batch else [])} | change_of
            if self._publish(entry):
                return Snapshot(self, entry)
            remove(self.spark, *(f"{self.data}/{name.split('/bucket=')[0]}" for name in entry["adds"]))
            time.sleep(self.pause * (k + 1))
        raise Lost(f"{kind}: {self.tries} times another writer was first")

    def _write(self, kind: str, rows: DataFrame, bucket: Column | None = None) -> tuple[list[str], DataFrame]:
        """Writes rows as new folders that no commit names yet; their names, and the rows read back."""
        token = f"commit={uuid.uuid4().hex}"
        schema = IMAGES if kind == "images" else RECORDS
        rows.withColumn("bucket", F.lit("all") if bucket is None else bucket).write.partitionBy("bucket").parquet(f"{self.data}/{kind}/{token}")
        status = self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(f"{self.data}/{kind}/{token}"))
        names = sorted(f"{kind}/{token}/{s.getPath().getName()}" for s in status if s.getPath().getName().startswith("bucket="))
        return names, self.spark.read.schema(schema).parquet(*(f"{self.data}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    # numbers

    def allocate_forms(self, fingerprints: DataFrame, order: list[str], batch: tuple[str, int] | None = None) -> DataFrame:
        """(fingerprint, form_no) of fingerprints (fingerprint and the order's columns): known ones keep their number,
        new ones get the next, in first-seen order, without gaps, and are PENDING until told otherwise."""
        seen = fingerprints.groupBy("fingerprint").agg(F.min(F.struct(*order)).alias("_first"))

        def change(held: Snapshot) -> dict | None:
            fresh = L.sequence(seen.join(held.records().select("fingerprint"), "fingerprint", "left_anti"), ["_first"])
            rows = fresh.select("fingerprint", (F.col("k") + held.next_form_no() - 1).alias("form_no"), F.lit("PENDING").alias("status"), F.current_timestamp().alias("created_at"))
            names, made = self._write("records", rows, bucket_of(F.col("fingerprint")))
            top = made.agg(F.max("form_no")).first()[0]
            return None if top is None else {"adds": names, "highest_form_no": top, "next_form_no": top + 1}

        held = self.commit("records", change, batch).records()
        return held.join(seen, "fingerprint").select("fingerprint", "form_no")

    def allocate_files(self, images: DataFrame, batch: tuple[str, int] | None = None) -> Snapshot:
        """Commits the images (sha256, path, modificationTime) that the ledger doesn't hold, numbered in order of time and path."""
        first = images.groupBy("sha256").agg(F.min(F.struct("modificationTime", "path")).alias("f")).select("sha256", "f.*")
        return self._append_files(lambda held: first.join(held.images().select("sha256"), "sha256", "left_anti"), batch)

    def append_files(self, images: DataFrame, batch: tuple[str, int] | None = None) -> Snapshot:
        """The same for images that are known to be new, once each: reads the newest commit, never the images before."""
        return self._append_files(lambda held: images.select("sha256", "path", "modificationTime"), batch)

    def _append_files(self, new: Callable[[Snapshot], DataFrame], batch: tuple[str, int] | None) -> Snapshot:
        def change(held: Snapshot) -> dict | None:
            e = held.entry
            numbered = L.file_numbers(new(held), ["modificationTime", "path"], e["starting_file_no"], held=e["images"], group_start=e["group_start"])
            names, made = self._write("images", numbered.select("sha256", "file_no", "path", F.current_timestamp().alias("processed_at")))
            n, top = made.agg(F.count("*"), F.max("file_no")).first()
            return {"adds": names, "images": e["images"] + n, "highest_file_no": max(top, e["highest_file_no"] or top)} if n else None

        return self.commit("images", change, batch)

    def set_status(self, changes: DataFrame) -> Snapshot:
        """Sets the status of records (fingerprint, status). Only folders that hold one of them are written again."""
        new = changes.groupBy("fingerprint").agg(F.max("status").alias("_s"))

        def change(held: Snapshot) -> dict | None:
            names = held._folders("records")
            all_rows = held._read("records", RECORDS, names)
            hit = all_rows.join(new, "fingerprint", "left_semi").select("commit", "bucket").distinct()
            touched = {f"records/commit={r['commit']}/bucket={r['bucket']}" for r in hit.collect()}  # folders of the log, not rows
            if not touched:
                return None
            rows = held._read("records", RECORDS, [n for n in names if n.removeprefix(f"{self.data}/") in touched])
            told = rows.join(new, "fingerprint", "left").withColumn("status", F.coalesce("_s", "status"))
            adds, _ = self._write("records", told.select("fingerprint", "form_no", "status", "created_at", "bucket"), F.col("bucket"))
            return {"adds": adds, "drops": sorted(touched)}

        return self.commit("status", change)

    # sessions and settings

    def start_session(self, file_no: int, starting_form_no: int, started_at: str) -> Snapshot:
        """A new session (started_at: ISO time) with numbers of its own and a fresh group of images; Refused if they are in use."""

        def change(held: Snapshot) -> dict:
            why = held.refusal(file_no, starting_form_no)
            if why:
                raise Refused(why)
            return {"next_form_no": starting_form_no, "starting_file_no": file_no, "group_start": held.entry["images"], "session": _session(started_at, file_no, starting_form_no, held)}

        return self.commit("session", change)

    def continue_session(self, started_at: str) -> Snapshot:
        """Notes that work went on, without changing a number."""
        return self.commit("continuation", lambda held: {"session": _session(started_at, held.next_file_no(), held.next_form_no(), held)})

    def reset(self, first_form: int = 110, first_file: int = 28) -> Snapshot:
        """Starts over without images and records; sessions stay, and so does what earlier snapshots read."""
        return self.commit("reset", lambda held: {"since": held.version + 1, "next_form_no": first_form, "starting_file_no": first_file, "group_start": 0, "images": 0, "highest_form_no": None, "highest_file_no": None})

    def set_next_form_no(self, form_no: int) -> Snapshot:
        return self.commit("setting", lambda held: {"next_form_no": form_no})

    def set_starting_file_no(self, file_no: int) -> Snapshot:
        return self.commit("setting", lambda held: {"starting_file_no": file_no})

    def repair(self, first_form: int = 110) -> Snapshot:
        """Counts what is held again and sets the sequences right: after the highest form number, or the setting beyond it."""

        def change(held: Snapshot) -> dict:
            top = held.records().agg(F.max("form_no")).first()[0]
            n, file_top = held.images().agg(F.count("*"), F.max("file_no")).first()
            setting = held.entry["next_form_no"]
            following = top + 1 if top is not None and setting <= top else max(setting, first_form)
            return {"highest_form_no": top, "next_form_no": following, "images": n, "highest_file_no": file_top}

        return self.commit("repair", change)

    def compact(self) -> Snapshot:
        """Rewrites what is held as one set of folders, so that readers need no commit before this one."""

        def change(held: Snapshot) -> dict:
            records, _ = self._write("records", held.records(), bucket_of(F.col("fingerprint")))
            images, _ = self._write("images", held.images())
            return {"since": held.version + 1, "adds": records + images}

        return self.commit("compact", change)

    def vacuum(self, keep: int) -> list[str]:
        """Deletes data folders that no commit from ``keep`` on reads; the folders deleted. For times without writers."""
        last = self.snapshot().version
        kept = {n for v in range(keep, last + 1) for kind in ("images", "records") for n in self.snapshot(v)._folders(kind)}
        gone = sorted({f"{self.data}/{n}" for e in self.entries(0, last) for n in e["adds"]} - kept)
        remove(self.spark, *gone)
        return gone


def bucket_of(fingerprint: Column) -> Column:
    return F.substring(F.md5(fingerprint), 1, BUCKET_DIGITS)


def _now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


def _session(started_at: str, file_no: int, starting_form_no: int, held: Snapshot) -> dict:
    return {"session_date": started_at[:10], "started_at": started_at, "file_no": file_no, "starting_form_no": starting_form_no, "last_form_no": held.entry["highest_form_no"], "status": "ACTIVE"}

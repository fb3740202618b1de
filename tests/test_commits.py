"""The ledger of commits, and streams that number and settle files."""

import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyform import storage
from tallyform.operators import commits
from tallyform.sources import inbox
from tallyform.streaming import arrivals, ingest


def prints(spark, names, start=0):
    return spark.createDataFrame([(n, k + start) for k, n in enumerate(names)], "fingerprint string, seen int")


def forms(book, spark, *names):
    return {r["fingerprint"]: r["form_no"] for r in book.allocate_forms(prints(spark, names), ["seen"]).collect()}


@pytest.fixture
def book(spark, tmp_path):
    return commits.Ledger(spark, str(tmp_path / "ledger"))


def filled(book, spark):
    assert forms(book, spark, *(f"record-{n}" for n in range(110, 116))) == {f"record-{n}": n for n in range(110, 116)}
    return book


def test_known_prints_keep_their_number_and_new_ones_follow_as_first_seen(book, spark):
    filled(book, spark)
    assert forms(book, spark, "new", "record-111", "new", "newer") == {"new": 116, "record-111": 111, "newer": 117}
    version = book.snapshot().version
    assert forms(book, spark, "newer") == {"newer": 117} and book.snapshot().version == version  # nothing new, no commit
    assert {r["status"] for r in book.snapshot().records().collect()} == {"PENDING"}


def test_racing_writers_lose_no_number(spark, tmp_path):
    path = str(tmp_path / "ledger")
    commits.Ledger(spark, path)
    got, barrier = {}, threading.Barrier(4)

    def write(k):
        own = commits.Ledger(spark, path)
        barrier.wait()
        got[k] = forms(own, spark, f"own-{k}-a", "shared", f"own-{k}-b")

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    every = {}
    for numbers in got.values():
        for name, no in numbers.items():
            assert every.setdefault(name, no) == no
    assert len(got) == 4 and sorted(every.values()) == list(range(110, 119))
    held = commits.Ledger(spark, path).snapshot()
    assert held.version == 4 and held.records().count() == 9
    assert {c.name for c in (tmp_path / "ledger/data/records").iterdir() if c.name.startswith("commit=")} == {n.split("/")[1] for e in held.book.entries(0, 4) for n in e["adds"]}  # losers' folders are gone


def test_a_number_has_one_commit(book, spark):
    entry = book.snapshot().entry | {"version": 1}
    assert book._publish(entry | {"kind": "a"}) and not book._publish(entry | {"kind": "b"})
    assert book.snapshot().entry["kind"] == "a"
    late = commits.Ledger(spark, book.log.removesuffix("/log"), tries=2, pause=0)
    late._publish = lambda entry: False
    with pytest.raises(commits.Lost):
        forms(late, spark, "x")


def test_readers_keep_their_snapshot(book, spark):
    before = filled(book, spark).snapshot()
    forms(book, spark, "later")
    book.set_status(spark.createDataFrame([("record-110", "VALIDATED")], "fingerprint string, status string"))
    assert before.records().count() == 6 and {r["status"] for r in before.records().collect()} == {"PENDING"}
    assert book.snapshot(before.version).records().count() == 6 and book.snapshot().records().count() == 7


def test_sessions(book, spark):
    filled(book, spark)
    book.continue_session("2024-03-01T08:00:00+00:00")
    assert book.snapshot().next_form_no() == 116
    began = book.start_session(29, 116, "2024-03-02T08:00:00+00:00")
    assert began.numbering_state() == {"file_no": 29, "last_file_no": None, "last_form_no": 115, "next_form_no": 116}
    assert forms(book, spark, "new-day") == {"new-day": 116}
    for file_no, form_no in ((29, 117), (30, 116), (0, 200), (31, -1)):
        with pytest.raises(commits.Refused):
            book.start_session(file_no, form_no, "2024-03-03T08:00:00+00:00")
    book.start_session(31, 400, "2024-03-04T08:00:00+00:00")
    assert forms(book, spark, "jump") == {"jump": 400}
    rows = [tuple(r) for r in book.snapshot().sessions().orderBy("id").collect()]
    assert [r[0] for r in rows] == [1, 2, 3] and rows[1][1:] == ("2024-03-02", "2024-03-02T08:00:00+00:00", 29, 116, 115, "ACTIVE")


def test_reset_keeps_sessions(book, spark):
    filled(book, spark).start_session(40, 200, "2024-03-02T08:00:00+00:00")
    book.allocate_files(arrived(spark, 3))
    before = book.snapshot()
    book.reset(110, 28)
    now = book.snapshot()
    assert now.records().count() == now.images().count() == 0 and now.sessions().count() == 1 and before.records().count() == 6
    assert now.numbering_state() == {"file_no": 28, "last_file_no": None, "last_form_no": None, "next_form_no": 110}
    assert forms(book, spark, "record-115") == {"record-115": 110}
    with pytest.raises(commits.Refused):
        book.start_session(40, 300, "2024-03-05T08:00:00+00:00")  # a session before the reset has that file number


def arrived(spark, n, first=0):
    return spark.createDataFrame([(f"sha-{k}", f"/in/{k}.png", datetime(2024, 1, 1, 0, 0, k)) for k in range(first, first + n)], arrivals.ARRIVAL)


def test_file_numbers_change_every_four_images_of_a_session(book, spark):
    book.allocate_files(arrived(spark, 5))
    book.allocate_files(arrived(spark, 6))  # five of them known
    number = lambda: [r["file_no"] for r in book.snapshot().images().orderBy("sha256").collect()]
    assert number() == [28] * 4 + [29] * 2
    book.start_session(35, 110, "2024-03-02T08:00:00+00:00")
    book.allocate_files(arrived(spark, 3, 6))
    assert number() == [28] * 4 + [29] * 2 + [35] * 3 and book.snapshot().next_file_no() == 35


def test_status_rewrites_touched_folders_only(book, spark):
    forms(book, spark, *(f"r{k}" for k in range(60)))
    before = set(book.snapshot()._folders("records"))
    book.set_status(spark.createDataFrame([("r7", "VALIDATED"), ("unknown", "VALIDATED")], "fingerprint string, status string"))
    after, rows = set(book.snapshot()._folders("records")), {r["fingerprint"]: r for r in book.snapshot().records().collect()}
    assert len(before - after) == len(after - before) == 1 and len(before & after) >= 10
    assert [n for n, r in rows.items() if r["status"] == "VALIDATED"] == ["r7"] and len(rows) == 60 and sorted(r["form_no"] for r in rows.values()) == list(range(110, 170))


def test_settings_repair_compaction_and_vacuum(book, spark):
    filled(book, spark)
    book.set_next_form_no(50)  # below what is held: the next number is beyond it all the same
    assert book.snapshot().next_form_no() == 116 and book.repair().entry["next_form_no"] == 116
    book.set_next_form_no(300)
    assert book.repair().next_form_no() == 300 and forms(book, spark, "far") == {"far": 300}
    book.set_starting_file_no(50)
    book.allocate_files(arrived(spark, 1))
    small = book.compact()
    assert small.entry["since"] == small.version and small.records().count() == 7 and small.images().first()["file_no"] == 50
    assert forms(book, spark, "record-112", "next") == {"record-112": 112, "next": 301}
    assert len(book.vacuum(small.version)) > 0 and book.snapshot().records().count() == 8 and book.vacuum(small.version + 1)


def test_commits_leave_no_scratch_tables(book, spark):
    left = lambda: set(storage._LEFT)
    before = left()
    for k in range(3):
        forms(book, spark, f"x{k}")
    assert left() == before


def test_ingestion_survives_restarts_and_batches_that_run_again(spark, tmp_path):
    box = tmp_path / "inbox"
    box.mkdir()
    for i in range(5):
        (box / f"{i}.png").write_bytes(b"image %d" % (i % 4))
    book = commits.Ledger(spark, str(tmp_path / "ledger"))
    book.allocate_files(spark.createDataFrame([(r["sha256"], "/old/0.png", datetime(2024, 1, 1)) for r in inbox.images(spark, str(box / "0.png")).collect()], arrivals.ARRIVAL))
    run = lambda: ingest.ingest(inbox.image_stream(spark, str(box)), commits.Ledger(spark, str(tmp_path / "ledger")), str(tmp_path / "check")).awaitTermination()
    run()
    held = book.snapshot()
    assert sorted(r["file_no"] for r in held.images().collect()) == [28] * 4  # the ledger's own content came again and was known
    assert book.append_files(arrived(spark, 2), ("inbox", 0)).version == held.version  # batch 0 again
    (box / "9.jpeg").write_bytes(b"new")
    (box / "again.jpg").write_bytes(b"image 1")
    run()
    rows = book.snapshot().images().collect()
    assert len(rows) == 5 and max(r["file_no"] for r in rows) == 29


def test_settling_tells_growing_stable_and_late_files_apart(spark, tmp_path):
    source, check, out = (str(tmp_path / n) for n in ("seen", "check", "out"))
    at = datetime(2024, 1, 1)

    def look(k, *files):
        rows = [(p, n, at.replace(second=t), at.replace(minute=k)) for p, n, t in files]
        spark.createDataFrame(rows, arrivals.OBSERVATION).coalesce(1).write.mode("append").json(source)
        found = arrivals.settled(spark.readStream.schema(arrivals.OBSERVATION).json(source), wait_seconds=60 if k < 5 else 1)
        found.writeStream.format("json").option("path", out).option("checkpointLocation", check).trigger(once=True).start().awaitTermination()
        return {(r["path"], r["length"], r["verdict"]) for r in spark.read.schema(arrivals.SETTLED).json(out).collect()}

    assert look(0, ("a", 5, 1), ("b", 1, 1), ("c", 0, 1)) == set()
    assert look(1, ("a", 5, 1), ("b", 2, 2), ("c", 0, 1)) == {("a", 5, "stable")}
    assert look(2, ("a", 5, 1), ("b", 2, 3)) == {("a", 5, "stable")}  # told once; b has the same size at another time
    assert look(3, ("a", 6, 9), ("b", 2, 3)) == {("a", 5, "stable"), ("b", 2, "stable")}
    assert look(4, ("a", 6, 9)) == {("a", 5, "stable"), ("b", 2, "stable"), ("a", 6, "stable")}
    before = look(5, ("late", 7, 1), ("void", 0, 1))
    time.sleep(2)
    assert look(6, ("other", 1, 1)) - before == {("late", 7, "timed_out"), ("void", 0, "empty")}


def test_a_watched_folder_is_a_stream_of_observations(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    (box / "x.png").write_bytes(b"12345")
    spark.dataSource.register(arrivals.FolderWatch)
    found = arrivals.settled(spark.readStream.format("folder_watch").load(str(box)))
    running = found.writeStream.format("memory").queryName("settled_files").trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("settled_files").count() == 0:
            time.sleep(0.3)
    finally:
        running.stop()
    row = spark.table("settled_files").first()
    assert row["path"].endswith("x.png") and row["length"] == 5 and row["verdict"] == "stable"
    assert spark.table("settled_files").select(F.countDistinct("path")).first()[0] == 1

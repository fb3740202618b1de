import json

from pyspark.sql import functions as F

from tallyform.functions import fixed
from tallyform.plans import queries, record_plan
from tallyform.schemas import OCR_TOKENS
from tallyform.sources import inbox, sinks

from .test_operators import LINES, page


def test_inbox_lists_images_that_are_not_empty(spark, tmp_path):
    box = tmp_path / "inbox"
    box.mkdir()
    for i in range(5):
        (box / f"{i}.PNG").write_bytes(b"image %d" % (i % 4))
    (box / "empty.png").write_bytes(b"")
    (box / "note.txt").write_bytes(b"x")
    found = inbox.images(spark, str(box))
    assert found.count() == 5 and found.select("sha256").distinct().count() == 4


def test_boundary_drops_blank_and_uncertain(spark):
    found = spark.createDataFrame([("s", bytearray(b"x"))], "sha256 string, content binary")
    engine = lambda: lambda content, variant: [("a", 30, 40, 50, 60, 91.0, 2.0), (" ", 0, 0, 1, 1, 90.0, 1.0), ("b", 0, 0, 1, 1, -1.0, 1.0)]
    rows = inbox.ocr_tokens(found, engine, ("A", "B")).collect()
    assert sorted((r["variant"], r["text"], r["x"], r["height"]) for r in rows) == [("A", "a", 15, 30), ("B", "a", 15, 30)]


def test_faint_images_are_read_once_more(spark):
    found = spark.createDataFrame([("faint", bytearray(b"x"), 12.0), ("clear", bytearray(b"x"), 40.0), ("unknown", bytearray(b"x"), None)], "sha256 string, content binary, contrast double")
    rows = inbox.ocr_tokens(found, lambda: lambda content, variant: [("a", 0, 0, 1, 1, 91.0, 1.0)]).collect()
    assert {n: sorted(r["variant"] for r in rows if r["image_id"] == n) for n in ("faint", "clear", "unknown")} == {"faint": ["A", "B", "C", "D"], "clear": ["A", "B", "C"], "unknown": ["A", "B", "C"]}


def test_records_round_trip_and_script(spark, tmp_path):
    made = record_plan.structured(spark.createDataFrame(page(LINES), OCR_TOKENS))
    n = sinks.write_script(made.withColumn("MY", F.col("MY")), str(tmp_path / "script.ahk"))
    text = (tmp_path / "script.ahk").read_text(encoding="utf-8")
    assert n == 1 and '"Nora"' in text and text.count("records.Push") == 1
    sinks.write_batch(made.select("form_no", "status", F.lit(28).alias("file_no")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/structured")).first()["form_no"] == 110
    batch = {"image": "i", "file_no": 28, "records": [{"record_number": 1, "form_no": 110, "fields": {"Title": {"value": "Mr"}}}]}
    (tmp_path / "review.json").write_text(json.dumps(batch))
    assert inbox.json_batches(spark, str(tmp_path / "review.json")).first()["fields"]["Title"]["value"] == "Mr"


def test_retry_merges_accepted_readings(spark):
    made = record_plan.structured(spark.createDataFrame(page(LINES), OCR_TOKENS))
    runs = spark.createDataFrame([("i", "A", 1, "IMEI 1", "351806012233445", 88.0, 1), ("i", "A", 1, "City", "", 0.0, 1)], "image_id string, variant string, record_number int, field string, raw_text string, confidence double, run_seq int")
    got = record_plan.retried(made, runs).first()
    assert got["fields"]["IMEI 1"]["value"] == "351806012233445" and got["fields"]["City"]["value"] == "Selby, East Riding" and len(got["fields"]) == 31


def test_every_sql_has_a_query():
    assert set(queries.SQL) <= set(queries.QUERIES)

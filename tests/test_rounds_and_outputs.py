"""Row clustering against a sequential version, retries until nothing changes, outputs that hold each result once."""

import random

import pytest
from pyspark.sql import functions as F

from tallyform.functions import fixed
from tallyform.operators import layout, localization, validation
from tallyform.plans import record_plan
from tallyform.schemas import FIELD, OCR_TOKENS
from tallyform.sources import sinks

from .test_operators import GOOD

# rows


def first_fit(tokens):
    """A page's rows, token by token: each joins the first row whose mean middle is within reach, or opens one."""
    tall = sorted(t[7] for t in tokens if t[7] > 4)
    middle = len(tall) // 2
    reach = 15 if not tall else min(35, max(8, round((tall[middle] if len(tall) % 2 else (tall[middle - 1] + tall[middle]) / 2) * 0.6)))
    rows = []
    for t in sorted(tokens, key=lambda t: (t[5], t[4], t[2])):
        at = t[5] + t[7] / 2
        row = next((r for r in rows if abs(at - sum(m for m, _ in r) / len(r)) <= reach), None)
        if row is None:
            rows.append(row := [])
        row.append((at, t))
    texts = [(r[0][1][5], [t for _, t in sorted(r, key=lambda m: m[1][4])]) for r in sorted(rows, key=lambda r: r[0][1][5])]
    kept = [(y, row) for y, row in texts if " ".join(t[3] for t in row).strip() not in fixed.ARTIFACT_ROWS]
    return [(k, y, " ".join(t[3] for t in row), [tuple(t[3:9]) for t in row]) for k, (y, row) in enumerate(kept)]


@pytest.mark.parametrize("kind", ["dense", "lines", "odd"])
def test_rows_are_those_of_first_fit(spark, kind):
    draw, pages = random.Random(kind), []
    for page in range(40):
        for k in range(draw.randrange(1, 90)):
            y = draw.randrange(300) if kind != "lines" else draw.randrange(8) * 45 + draw.randrange(9)
            height = draw.choice([0, 2, 12, 18, 20, 31, 60, -9]) if kind == "odd" else draw.randrange(14, 24)
            pages.append((f"p{page}", draw.choice("AB"), k, draw.choice(["—", "•", "a", "bc", "-", "d e"]), draw.randrange(0, 400, 50), y, 30, height, float(draw.randrange(100))))
    got = {}
    for r in layout.cluster_rows(spark.createDataFrame(pages, OCR_TOKENS)).collect():
        got.setdefault((r["image_id"], r["variant"]), []).append((r["row_seq"], r["y"], r["text"], [tuple(w) for w in r["words"]]))
    for key in {(t[0], t[1]) for t in pages}:
        assert sorted(got.get(key, [])) == first_fit([t for t in pages if (t[0], t[1]) == key])


def test_rows_run_without_python_and_with_one_shuffle(spark):
    plan = layout.cluster_rows(spark.createDataFrame([], OCR_TOKENS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Pandas" not in plan


# retries

BOX = {"x": 40, "y": 10, "width": 30, "height": 12}


def record(name, **changed):
    values = {n: "" for n in fixed.FIELDS} | GOOD | {"Title": "Ms", "First Name": "Ada", "Last Name": "Ek"} | {n: v[0] for n, v in changed.items()}
    none = {n: v[1] for n, v in changed.items() if len(v) > 1}
    return (name, "A", 1, {n: (v, v, none.get(n, {}).get("confidence", 90.0), none.get(n, {}).get("needs_review", False), none.get(n, {}).get("boxes", [BOX])) for n, v in values.items()})


def review(spark, rows, said, labels=(), rounds=31, images=(("i", 800, 600),)):
    """Final records by image, decisions by (image, field) -> (round, decision, value), and what was asked."""
    keys = "image_id string, variant string, record_number int"
    records = validation.validated(validation.calculated(spark.createDataFrame(rows, f"{keys}, fields map<string,{FIELD.simpleString()}>")))
    box = "struct<x:int,y:int,width:int,height:int>"
    labelled = spark.createDataFrame([(i, "A", 1, f, b, b, f, 0.95, "label_right") for i, f, b in labels], f"{keys}, field string, value_box {box}, label_box {box}, anchor string, confidence double, source string")
    runs = spark.createDataFrame([(f, t, c, k) for f, ts in said.items() for k, (t, c) in enumerate(ts)] or [("none", "", 0.0, 0)], "field string, raw_text string, confidence double, run_seq int")
    read = lambda asked: asked.join(runs, "field").select(*record_plan.KEYS, "field", "raw_text", "confidence", "run_seq")
    told, decisions = record_plan.reviewed(records, labelled, spark.createDataFrame(list(images), "image_id string, width int, height int"), read, rounds)
    found = {(r["image_id"], r["field"]): (r["round"], r["decision"], r["value"]) for r in decisions.collect()}
    return {r["image_id"]: r for r in told.collect()}, found, record_plan.evidence(told, decisions)


def test_all_decisions(spark):
    rows = [record("i", **{"IMEI 1": ("12",), "Postal Code": ("QX",), "Email": ("a@b",), "Gender": ("male",), "City": ("Y", {"confidence": 20.0}), "Country": ("", {"boxes": []}), "Contact": ("1x", {"boxes": [BOX | {"x": 900}]})}), record("gone", Email=("a@b",))]
    said = {"IMEI 1": [("Nokia 351806012233445", 30.0), ("351806012233445", 80.0)], "Postal Code": [("WNI 4RD", 60.0)], "Email": [("b@c.org", 20.0)], "Gender": [("Male", 70.0), ("Male", 72.0), ("Mate", 99.0)]}
    told, found, evidence = review(spark, rows, said)
    assert {f: d[1:] for (i, f), d in found.items() if i == "i"} == {
        "IMEI 1": ("ACCEPTED_STRICT_IMEI", "351806012233445"), "Postal Code": ("ACCEPTED_POSTCODE", "WN1 4RD"), "Email": ("NO_SAFE_CORRECTION", None), "Gender": ("ACCEPTED_CONSENSUS", "Male"),
        "City": ("NO_OCR_OUTPUT", None), "Country": ("FIELD_REGION_NOT_LOCATED", None), "Contact": ("EMPTY_CROP_REGION", None), "Installments": ("FIELD_REGION_NOT_LOCATED", None), "Amount in Words": ("FIELD_REGION_NOT_LOCATED", None),
    }
    assert found["gone", "Email"][1] == "INVALID_IMAGE_INPUT"
    fields, reasons = told["i"]["fields"], [(i["field"], i["reason"]) for i in told["i"]["issues"]]
    assert fields["IMEI 1"]["raw_text"] == "351806012233445" and fields["IMEI 1"]["confidence"] == 55.0 and fields["Gender"]["needs_review"] is False and fields["Email"]["value"] == "a@b"
    assert ("Email", "INVALID_EMAIL") in reasons and ("Country", "FIELD_REGION_NOT_LOCATED") in reasons and ("IMEI 1", "INVALID_IMEI1") not in reasons and told["i"]["status"] == "REVIEW_REQUIRED"
    shown = {r["field"]: r for r in evidence.where("image_id = 'i'").collect()}
    assert len(shown) == 31 and shown["Email"]["validation"] == "REVIEW" and shown["Email"]["failure_reasons"] == ["INVALID_EMAIL"] and shown["Email"]["decision"] == "NO_SAFE_CORRECTION"
    assert shown["Gender"]["validation"] == "PASS" and shown["Gender"]["decision"] == "ACCEPTED_CONSENSUS" and shown["Title"]["decision"] == "NOT_REQUIRED"


def test_rounds_go_on_until_nothing_changes(spark):
    rows = [record("i", **{"Issue Date": ("31/02/2020",)})]
    said = {"Issue Date": [("05/06/1985", 90.0)], "DOB": [("07/08/1960", 90.0)], "Installments": [], "Amount in Words": []}
    told, found, _ = review(spark, rows, said)
    assert found["i", "Issue Date"] == (1, "ACCEPTED_CONSENSUS", "05/06/1985") and found["i", "DOB"] == (2, "ACCEPTED_CONSENSUS", "07/08/1960")
    assert told["i"]["fields"]["Installments"]["value"] not in ("", "INVALID") and [i["reason"] for i in told["i"]["issues"]] == ["FIELD_REGION_NOT_LOCATED"] * 2
    once, first, _ = review(spark, rows, said, rounds=1)
    assert ("i", "DOB") not in first and "DOB_AFTER_ISSUE_DATE" in [i["reason"] for i in once["i"]["issues"]]


def test_review_flags_count_only_beside_an_issue(spark):
    blank = ("", {"needs_review": True, "boxes": []})
    told, found, _ = review(spark, [record("clean", **{"SIM No": blank}), record("i", **{"SIM No": blank, "Email": ("a@b",)})], {"Email": [("a@b.org", 90.0)]}, images=[("i", 800, 600), ("clean", 800, 600)])
    assert set(found) == {("i", "SIM No"), ("i", "Email")} and told["clean"]["status"] == "VALIDATED"
    assert [(i["field"], i["reason"]) for i in told["i"]["issues"]] == [("SIM No", "FIELD_REGION_NOT_LOCATED")]


def test_labels_come_before_a_fields_own_tokens(spark):
    asked = record_plan.requests(
        validation.validated(spark.createDataFrame([record("i", Email=("a@b",), City=("Y", {"confidence": 20.0}))], f"image_id string, variant string, record_number int, fields map<string,{FIELD.simpleString()}>").withColumn("MY", F.lit(24))),
        spark.createDataFrame([("i", "A", 1, "Email", (100, 20, 50, 10), (60, 20, 30, 10), "E-mail", 0.95, "label_right")], "image_id string, variant string, record_number int, field string, value_box struct<x:int,y:int,width:int,height:int>, label_box struct<x:int,y:int,width:int,height:int>, anchor string, confidence double, source string"),
        spark.createDataFrame([("i", 800, 600)], "image_id string, width int, height int"),
    )
    crops = {r["field"]: tuple(r["crop"]) for r in asked.collect()}
    assert crops["Email"] == (94, 14, 156, 36) and crops["City"] == (34, 4, 76, 28)
    assert localization.RECORD == record_plan.KEYS


# outputs

RESULT = "image string, file_no int, record_number int, form_no int, fingerprint string, status string, error string"


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    out, source = sinks.BatchOutputs(str(tmp_path / "out")), str(tmp_path / "in")
    rows = [("a", 28, 1, 110, "f1", "VALIDATED", None), ("a", 28, 2, 111, "f2", "REVIEW_REQUIRED", None), ("b", 28, None, None, None, None, "no records")]
    more = [("c", 28, 1, 111, "f2", "VALIDATED", None), ("c", 28, 2, 112, "f3", "REVIEW_REQUIRED", None)]
    fail = {"next": True}

    def write(batch_rows, batch):
        out.write(batch_rows, batch)
        if fail.pop("next", False):
            raise RuntimeError("killed before the batch was marked as done")

    def run():
        spark.readStream.schema(RESULT).json(source).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame(rows, RESULT).coalesce(1).write.json(source)
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    spark.createDataFrame(more, RESULT).coalesce(1).write.mode("append").json(source)
    run()
    of = lambda name: sorted((r["image"], r["fingerprint"], r["batch"]) for r in out.read(spark, name, RESULT).collect())
    assert of(sinks.SUCCESSFUL) == [("a", "f1", 0), ("c", "f2", 1)] and of(sinks.REVIEW) == [("a", "f2", 0), ("c", "f3", 1)]
    assert [(r["image"], r["error"]) for r in out.read(spark, sinks.FAILED, RESULT).collect()] == [("b", "no records")]
    assert sorted((r["batch"], r["results"], r["validated"], r["review_required"], r["failed"]) for r in out.counts(spark).collect()) == [(0, 3, 1, 1, 1), (1, 2, 1, 1, 0)]
    assert sorted((r["fingerprint"], r["image"], r["status"]) for r in out.rebuilt(spark, RESULT).collect()) == [("f1", "a", "VALIDATED"), ("f2", "c", "VALIDATED"), ("f3", "c", "REVIEW_REQUIRED")]


def test_half_written_batches_are_not_read(spark, tmp_path):
    out = sinks.BatchOutputs(str(tmp_path / "out"))
    assert out.read(spark, sinks.REVIEW, RESULT).count() == 0 and out.counts(spark).count() == 0
    out.write(spark.createDataFrame([("a", 28, 1, 110, "f1", "VALIDATED", None)], RESULT), 0)
    out.write(spark.createDataFrame([("b", 28, 1, 111, "f2", "VALIDATED", None)], RESULT), 1)
    (tmp_path / "out/results/batch=1/_SUCCESS").unlink()
    assert [r["image"] for r in out.read(spark, sinks.SUCCESSFUL, RESULT).collect()] == ["a"]


def test_script_is_written_by_tasks_in_order(spark, tmp_path):
    fields = {n: (f"{n} {{1}}", n, 90.0, False, []) for n in fixed.FIELDS}
    rows = [(k * 7919 % 1000, 1, "VALIDATED" if k % 3 else "PENDING", fields) for k in range(300)] + [(5, 2, "REVIEW_REQUIRED", dict(list(fields.items())[:30]))]
    records = spark.createDataFrame(rows, f"form_no int, record_number int, status string, fields map<string,{FIELD.simpleString()}>").repartition(7)
    path = tmp_path / "script.ahk"
    path.write_text("old")
    assert sinks.write_script(records, str(path)) == 200
    lines = [r["line"] for r in sinks.entry_script(records).orderBy("form_no", "record_number").collect()]
    assert path.read_text(encoding="utf-8").split("\n") == [*sinks.SCRIPT_HEAD, *lines, *sinks.SCRIPT_TAIL, ""] and [p.name for p in tmp_path.iterdir()] == ["script.ahk"]


def test_a_later_round_works_on_changed_records_alone(spark, tmp_path, monkeypatch):
    """Two records of eight are told a new value that leaves another round; the other rounds must not calculate all records again."""
    from tallyform.operators import validation
    from tallyform.plans import queries as Q

    spark.range(16).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    seen, real = [], validation.calculated
    monkeypatch.setattr(validation, "calculated", lambda records: seen.append(records.count()) or real(records))
    rows = Q.retry_rounds(spark, str(tmp_path)).collect()
    assert {r["o_orderkey"] for r in rows} == set(range(16)) and max(r["round"] or 0 for r in rows) == 2
    assert seen[0] == 16 and seen[1] < 16 and seen[2:] == [2]

import pytest
from pyspark.sql import functions as F

from tallyform.functions import fixed
from tallyform.operators import consensus, extraction, layout, ledger, localization, quality, validation
from tallyform.plans import record_plan
from tallyform.schemas import OCR_TOKENS, TOKEN

#: An invented record over three rows.
LINES = (
    "Miss Nora Vale nora@vale.example.org Prof. Vale 09/10/1984 Female Business MillLane Selby, East Riding YO8 4EH",
    "Scotland Virgin Sierra - 5550123 Virg77QX!@##&L9 KoLm778899001A2 CDMA Samsung E250 351806 - 01 - 223344 -5",
    "%@R$T - #!-998877-1 Ultra VisaGold €640 14/02/2019 14/08/2021",
)


def token(text, x=0, y=0, conf=90.0):
    return (text, x, y, 40, 20, conf)


def page(lines, image="i", variant="A"):
    rows, k = [], 0
    for n, line in enumerate(lines):
        for i, word in enumerate(line.split(" ")):
            rows.append((image, variant, k, *token(word, i * 50, n * 40)))
            k += 1
    return rows


def test_full_record(spark):
    made = record_plan.structured(spark.createDataFrame(page(LINES), OCR_TOKENS)).collect()
    assert len(made) == 1
    got = {n: f["value"] for n, f in made[0]["fields"].items()}
    want = {
        "File No": "28", "Form No": "110", "Title": "Miss", "First Name": "Nora", "Last Name": "Vale", "Email": "nora@vale.example.org", "Father Name": "Vale", "DOB": "09/10/1984",
        "Gender": "Female", "Profession": "Business", "Mailing Street": "MillLane", "City": "Selby, East Riding", "Postal Code": "YO8 4EH", "Country": "Scotland",
        "Service Provider": "Virgin", "File Ref": "Sierra - 5550123", "Reference No": "Virg77QX!@##&L9", "SIM No": "KoLm778899001A2", "Network Type": "CDMA",
        "Mobile Model": "Samsung E250", "IMEI 1": "351806 - 01 - 223344 -5", "IMEI 2": "%@R$T - #!-998877-1", "Plan Type": "Ultra", "Card Type": "VisaGold",
        "Contact": "640", "Issue Date": "14/02/2019", "Renewal Date": "14/08/2021", "Initial": "MNV", "Installments": "36.99", "Amount in Words": "Thirty Six Point Nine Nine", "Remarks": "Not Applicable",
    }
    assert got == want and len(got) == 31
    assert made[0]["MY"] == 24 and made[0]["issues"] == [] and made[0]["status"] == "VALIDATED"


def test_models_and_device_numbers(spark):
    records = {
        "none": [], "nulls": [None, ""], "brand": "GSM Nokia 6230 351806012233445".split(), "bare": "GSM K750 998 - 41 - 223344 - 5".split(), "masked": "GSM LG 351806 - 01 - 223344 -5 %@R$T - #!-998877-1".split(),
        "halves": "GSM LG 111111 222222 333333 444444".split(), "dates": ["Mr", "A", "B", "01/02/2000", "03/04/2010"], "glued": ["Dr", "IvyMoss", "o7/O3/1971"], "mail": ["Mr", "Ola", "ola_berg@mail.example.org", "01/02/2000"],
    }
    rows = [(k, [token(w, i * 50) for i, w in enumerate(words)]) for k, words in records.items()] + [("null", None)]
    df = spark.createDataFrame(rows, f"k string, tokens array<{TOKEN.simpleString()}>")
    got = {r["k"]: {n: f["value"] for n, f in r["fields"].items()} for r in extraction.extract_fields(df, ("k",)).collect()}
    some = lambda k, *names: tuple(got[k][n] for n in names)
    device = ("Mobile Model", "IMEI 1", "IMEI 2")
    assert got["none"] == got["null"] == dict.fromkeys(fixed.FIELDS, "") | {"Remarks": "Not Applicable"}
    assert got["nulls"] == got["none"] | {"Title": "Mr"}
    assert some("brand", *device) == ("Nokia 6230", "351806012233445", "")
    assert some("bare", *device) == ("K750", "998 - 41 - 223344 - 5", "")
    assert some("masked", *device) == ("LG", "351806 - 01 - 223344 -5", "%@R$T - #!-998877-1")
    assert some("halves", *device) == ("LG", "111111 222222", "333333 444444")
    assert some("dates", "DOB", "Issue Date", "Renewal Date") == ("01/02/2000", "01/02/2000", "03/04/2010")
    assert some("glued", "First Name", "Last Name", "DOB") == ("Ivy", "Moss", "07/03/1971")
    assert some("mail", "First Name", "Last Name", "Email") == ("Ola", "ola", "berg@mail.example.org")


def test_rows_follow_the_moving_centre(spark):
    rows = [("i", "A", k, *token(f"w{k}", x, y)) for k, (x, y) in enumerate([(100, 0), (0, 6), (50, 12), (0, 40), (10, 90)])]
    got = [(r["row_seq"], r["text"]) for r in layout.cluster_rows(spark.createDataFrame(rows, OCR_TOKENS)).orderBy("row_seq").collect()]
    assert got == [(0, "w1 w2 w0"), (1, "w3"), (2, "w4")]
    lone = spark.createDataFrame([("i", "A", 0, *token("—"))], OCR_TOKENS)
    assert layout.cluster_rows(lone).count() == 0


@pytest.mark.parametrize(("words", "starts"), [(["1.Mr", "X"], True), (["x", "y", "Collins"], True), (["x", "y", "z", "Mr"], False), (["Field", "Marshal"], True), (["—", "—"], False), ([], False)])
def test_record_start(spark, words, starts):
    df = spark.createDataFrame([(words,)], "w array<string>")
    assert df.select(layout.starts_record(F.col("w"))).first()[0] is starts


def test_segments(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("a", 4, True), ("b", 1, False), ("b", 2, None)], "g string, o int, s boolean")
    got = [r["record_number"] for r in layout.number_records(df, F.col("s"), ["g"], ["o"]).orderBy("g", "o").collect()]
    assert got == [0, 1, 1, 2, 1, 1]


def test_best_variant_first_of_equals(spark):
    rows = [("i", v, 1, [token("a", conf=c)]) for v, c in (("B", 80.0), ("A", 80.0), ("C", 70.0))]
    df = spark.createDataFrame(rows, f"image_id string, variant string, record_number int, tokens array<{TOKEN.simpleString()}>")
    assert [r["variant"] for r in layout.best_variant(df).collect()] == ["A"]


def test_vote(spark):
    df = spark.createDataFrame([(1, "x", 10.0, 2), (1, "y", 90.0, 1), (1, "x", 0.0, 3), (2, "a", 90.0, 1), (2, "b", 95.0, 2), (3, "q", 20.0, 1)], "k int, value string, confidence double, run_seq int")
    got = {r["k"]: (r["value"], r["votes"], r["mean_confidence"], r["accepted"]) for r in consensus.vote(df, ["k"]).collect()}
    assert got == {1: ("x", 2, 10.0, True), 2: ("a", 1, 90.0, True), 3: ("q", 1, 20.0, False)}


def test_decisions(spark):
    rows = [(1, "IMEI 1", "351806012233445", 90.0, 1), (2, "IMEI 1", "12", 90.0, 1), (3, "Postal Code", "BSI 4TX", 60.0, 1), (4, "City", "", 0.0, 1), (5, "Contact", "a 580", 10.0, 1), (5, "Contact", "580", 10.0, 2)]
    df = spark.createDataFrame(rows, "k int, field string, raw_text string, confidence double, run_seq int")
    got = {r["k"]: (r["decision"], r["value"]) for r in consensus.decide(df, ["k"]).collect()}
    assert got == {1: ("ACCEPTED_STRICT_IMEI", "351806012233445"), 2: ("NO_SAFE_CORRECTION", None), 3: ("ACCEPTED_POSTCODE", "BS1 4TX"), 4: ("NO_OCR_OUTPUT", None), 5: ("ACCEPTED_CONSENSUS", "580")}


GOOD = {n: "x" for n in fixed.REQUIRED} | {
    "Email": "a@b.org", "DOB": "01/01/1990", "Gender": "Male", "Postal Code": "S16 8AG", "Contact": "580", "Issue Date": "06/07/2020", "Renewal Date": "06/01/2022",
    "Installments": "34.49", "Initial": "MJD", "IMEI 1": "351806012233445", "Mobile Model": "Nokia",
}


@pytest.mark.parametrize(("change", "my", "reasons"), [
    ({}, 24, []), ({"Email": "a@b"}, 24, ["INVALID_EMAIL"]), ({"DOB": "06/07/2020"}, 24, ["DOB_AFTER_ISSUE_DATE"]), ({"Renewal Date": "05/07/2020"}, 24, ["RENEWAL_BEFORE_ISSUE_DATE"]),
    ({"Postal Code": "BSI 4TX"}, 24, ["INVALID_POSTAL_CODE"]), ({"Mobile Model": "351806012233445 x"}, 24, ["MOBILE_MODEL_IMEI_CONFLICT"]), ({"IMEI 1": "1234"}, 24, ["INVALID_IMEI1", "AMBIGUOUS_IMEI1"]),
    ({"IMEI 1": "123456789012345678"}, 24, ["INVALID_IMEI1"]), ({"Initial": "M1"}, 24, ["INVALID_INITIAL"]), ({"Amount in Words": ""}, 0, ["CALCULATION_MISMATCH"]),
    ({"Installments": "INVALID", "Amount in Words": ""}, 0, []), ({"City": None}, 24, ["MISSING_REQUIRED_FIELD"]), ({"Amount in Words": ""}, 24, ["MISSING_REQUIRED_FIELD", "EMPTY_AMOUNT_WORDS"]),
])
def test_rules(spark, change, my, reasons):
    fields = {k: (v, 90.0, False) for k, v in (GOOD | change).items()}
    df = spark.createDataFrame([(fields, my)], "fields map<string, struct<value:string,confidence:double,needs_review:boolean>>, MY int")
    got = validation.validated(df).first()
    assert [i["reason"] for i in got["issues"]] == reasons
    assert got["status"] == ("REVIEW_REQUIRED" if reasons else "VALIDATED")


def test_low_confidence_spares_exact_titles(spark):
    fields = {k: (v, 90.0, False) for k, v in GOOD.items()} | {"Title": ("Mr", 42.0, True), "City": ("York", 42.0, False)}
    df = spark.createDataFrame([(fields, 24)], "fields map<string, struct<value:string,confidence:double,needs_review:boolean>>, MY int")
    assert [(i["field"], i["severity"]) for i in validation.validated(df).first()["issues"]] == [("City", "REVIEW")]


def regions(spark, *lines):
    rows = [("i", "A", 1, n, [token(w, i * 80, n * 40) for i, w in enumerate(line)]) for n, line in enumerate(lines)]
    df = spark.createDataFrame(rows, f"image_id string, variant string, record_number int, row_seq int, words array<{TOKEN.simpleString()}>")
    return {r["field"]: r for r in localization.field_regions(df).collect()}


def test_regions(spark):
    got = regions(spark, ["IMEI", "1", "351806012233445"])
    assert list(got) == ["IMEI 1"] and got["IMEI 1"]["value_box"]["x"] == 160 and got["IMEI 1"]["anchor"] == "IMEI 1"
    assert regions(spark, ["351806012233445"]) == {}
    assert "IMEI 1" in regions(spark, ["1MEI", "1:", "351806012233445"])
    two = regions(spark, ["IMEI", "1:", "11", "IMEI", "2:", "22"])
    assert two["IMEI 1"]["value_box"]["x"] + two["IMEI 1"]["value_box"]["width"] <= 240 and two["IMEI 2"]["value_box"]["x"] == 400
    below = regions(spark, ["City"], ["Leeds"])
    assert below["City"]["source"] == "label_below" and below["City"]["confidence"] == 0.85
    assert regions(spark, ["City"])["City"]["source"] == "label_estimated_right"


def test_numbers(spark):
    docs = spark.createDataFrame([(i, f"f{i % 6}") for i in range(40)], "doc_id int, fingerprint string")
    forms = {r["fingerprint"]: r["form_no"] for r in ledger.form_numbers(docs, ["doc_id"]).collect()}
    assert forms == {f"f{i}": 110 + i for i in range(6)}
    held = spark.createDataFrame([("f3", 300)], "fingerprint string, form_no int")
    forms = {r["fingerprint"]: r["form_no"] for r in ledger.form_numbers(docs, ["doc_id"], ledger=held).collect()}
    assert forms == {"f3": 300, "f0": 301, "f1": 302, "f2": 303, "f4": 304, "f5": 305}
    files = {r["doc_id"]: r["file_no"] for r in ledger.file_numbers(docs, ["doc_id"]).collect()}
    assert files == {i: 28 + i // 4 for i in range(40)}


@pytest.mark.parametrize("parts", [4, 64])
def test_sequence_numbers_three_million_rows(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.range(3_000_000, numPartitions=4).select(F.pmod(F.col("id") * 7919 + 13, F.lit(3_000_000)).alias("o"), F.concat(F.lit("f"), "id").alias("fingerprint"), F.lit("kept").alias("more"))
        wrong = ledger.sequence(rows, ["o"]).where("k <> o + 1 or more <> 'kept'")
        assert wrong.count() == 0
        assert ledger.file_numbers(rows, ["o"]).where("file_no <> 28 + floor(o / 4) or more is null").count() == 0
        forms = ledger.form_numbers(rows, ["o"]).join(rows, "fingerprint")
        assert forms.where("form_no = o + 110").count() == 3_000_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ledger(spark):
    images = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "r")], "sha256 string, path string")
    assert [r["sha256"] for r in ledger.unseen(images, spark.createDataFrame([("b",)], "sha256 string")).collect()] == ["a"]
    got = spark.sql("SELECT * FROM VALUES (115, 100), (115, 200), (NULL, 50) AS t(h, s)").select(ledger.repaired_next(F.col("h"), F.col("s"), 110)).collect()
    assert [r[0] for r in got] == [116, 200, 110]
    done = spark.createDataFrame([("x", 1, 1), ("", 2, 7)], "fingerprint string, form_no int, record_number int")
    review = spark.createDataFrame([("x", 9, 3), ("", 2, 7), ("y", 4, 4)], "fingerprint string, form_no int, record_number int")
    assert sorted(r["form_no"] for r in ledger.newest_records(done, review).collect()) == [1, 2, 4]
    assert ledger.session_row(spark, "2026-01-02 03:04:05", 29, 116, None, "NEW").first()["last_form_no"] is None


def test_quality(spark):
    px = spark.createDataFrame([("blank", 255.0), ("blank", 254.0), ("text", 0.0), ("text", 200.0)], "k string, v double")
    assert {r["k"]: r["is_blank"] for r in quality.gate(px, ["k"], "v").collect()} == {"blank": True, "text": False}
    bins = spark.createDataFrame([("a", b) for b in [10] * 5 + [12] * 5 + [200] * 9] + [("flat", 7)] * 3, "k string, bin long")
    assert {r["k"]: r["threshold"] for r in quality.thresholds(bins, ["k"]).collect()} == {"a": 12, "flat": 128}


def test_values_alone_are_a_small_plan_and_the_fields_values(spark):
    """Reading values took minutes of planning and interpreted expressions; the plan must not grow with the fields' rules."""
    from tallyform.plans import queries as Q

    made = spark.range(30).select(F.col("id").alias("k"), Q._laid_out(Q._texts(F.col("id"))).alias("tokens"))
    values = extraction.extract_values(made, ("k",))
    assert len(values._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    whole = {r["k"]: {n: r[n]["value"] for n in fixed.FIELDS} for r in extraction.extract_columns(made, ("k",)).collect()}
    assert {r["k"]: {n: r[n] for n in fixed.FIELDS} for r in values.collect()} == whole


def test_heavy_rows_are_dealt_over_the_cores(spark, tmp_path):
    from tallyform.plans import queries as Q

    spark.range(50).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    cores = spark.sparkContext.defaultParallelism
    rows = Q.extract31(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= cores and rows.count() == 50


def test_structured_keeps_tokens_once(spark, monkeypatch):
    """What is kept on disk between the passes held every word twice: in its row and in the record's tokens."""
    kept, real = [], layout.best_variant
    monkeypatch.setattr(layout, "best_variant", lambda records: kept.append(records.columns) or real(records))
    record_plan.structured(spark.createDataFrame([], OCR_TOKENS))
    assert kept == [["image_id", "variant", "record_number", "tokens", "source_text"]]

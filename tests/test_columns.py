from decimal import ROUND_DOWN, Decimal

import pytest
from pyspark.sql import functions as F

from tallyform.functions import columns as C
from tallyform.functions import fixed


def values(spark, rows, made, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.withColumn("y", made(F.col("x"))).orderBy("i").select("y").collect()]


def test_words(spark):
    assert values(spark, [0, 14, 580, 1005, 20_000, 999_999, 1_000_000, -1], C.integer_words, "long") == [
        "Zero", "Fourteen", "Five Hundred Eighty", "One Thousand Five", "Twenty Thousand", "Nine Hundred Ninety Nine Thousand Nine Hundred Ninety Nine", None, None,
    ]
    assert values(spark, ["10.30", "580", "34.49", "", "x.5", "7.999"], C.amount_words) == [
        "Ten Point Three Zero", "Five Hundred Eighty Point Zero Zero", "Thirty Four Point Four Nine", "", "Zero Point Five Zero", "Seven Point Nine Nine",
    ]


def test_installments_are_cut_not_rounded(spark):
    grid = [(c, m) for c in (0, 1, 341, 533, 580, 720, 99_999) for m in (0, 12, 24, 36, 120, -12)]
    df = spark.createDataFrame(grid, "c long, m int").select("c", "m", C.installment_text(F.col("c"), F.col("m")).alias("t"))
    for c, m, t in df.collect():
        want = "INVALID" if m == 0 else "" if m < 0 else str((Decimal(c) / m + Decimal("10.33")).quantize(Decimal("0.01"), ROUND_DOWN))
        assert t == want, (c, m)


def test_months_ignore_months(spark):
    row = spark.sql("SELECT DATE '2020-07-06' AS a, DATE '2022-01-06' AS b").select(C.months_between_years(F.col("a"), F.col("b"))).first()
    assert row[0] == 24


def test_dates(spark):
    assert values(spark, ["o1/09/2023", "14/O8/1988", "32/01/2020", "15/13/2020", "1.2.1999", "29/02/2023", "01/01/1899", None, ""], C.clean_date) == [
        "01/09/2023", "14/08/1988", None, None, "01/02/1999", None, None, None, None,
    ]


def test_email(spark):
    made = values(spark, ["user@domaincom", "desk@examplecouk", "Smith_smith@domain.com", "Oakleyoakley@mail.com", "x", ""], C.clean_email)
    assert [(m.email, m.last_name) for m in made] == [("user@domain.com", ""), ("desk@example.co.uk", ""), ("smith@domain.com", "Smith"), ("oakley@mail.com", "Oakley"), ("x", ""), ("", "")]


def test_postcode(spark):
    assert values(spark, ["HG13EZ", "S168AG", "BSI 4TX", "nothing", "AL1 2AB"], C.repaired_postcode) == ["HG1 3EZ", "S16 8AG", "BS1 4TX", "nothing", "A11 2AB"]
    assert values(spark, ["BSI 4TX", "BS] 4TX", "YO61 4AD", "gir 0aa"], C.is_postcode) == [False, False, True, True]


def test_contact_initials_escape(spark):
    assert values(spark, ["£507", "€ 580", "£50.25", "abc", None], C.contact_digits) == ["507", "580", "5025", "", ""]
    assert values(spark, ["jo", " x", "1a", ""], lambda x: C.initials(x, F.lit("Ann"))) == ["JA", "XA", "A", "A"]
    assert values(spark, ['a`"\r\n'], C.escaped_keys) == ['a```"`n']


@pytest.mark.parametrize(("w", "h", "scale"), [(1200, 600, 3.0), (100, 50, 4.0), (4000, 10, 1.0)])
def test_scale(spark, w, h, scale):
    assert spark.range(1).select(C.hd_scale(F.lit(w), F.lit(h))).first()[0] == scale


def test_fields():
    assert len(fixed.FIELDS) == 31 and len(fixed.REQUIRED) == 19


def test_cents_follow_the_binary_value(spark):
    import math
    import random

    draw = random.Random(1)
    values = [2.675, 0.125, 0.375, 0.005, 0.015, 1.005, 0.0005, 0.0, -2.675, -0.125, 99.995, 1e-300, 5e-324, 2.0**44 + 0.125, 0.001, math.nextafter(0.125, 1), math.nextafter(0.125, 0), math.nextafter(0.005, 0)]
    values += [draw.uniform(-1, 1) * 10 ** draw.uniform(-3, 4) for _ in range(200_000)] + [draw.randrange(10**7) / 1000 + 0.0005 for _ in range(100_000)] + [k / 8 for k in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    wrong = [r for r in df.select("x", C.rounded_cents(F.col("x")).alias("y")).collect() if r["y"] != round(r["x"], 2)]
    assert not wrong, wrong[:5]
    odd = spark.createDataFrame([(None,), (math.inf,), (math.nan,), (1e300,)], "x double").select(C.rounded_cents(F.col("x")).alias("y")).collect()
    assert [r["y"] is None or not math.isfinite(r["y"]) or r["y"] == 1e300 for r in odd] == [True] * 4

"""Registered queries of the record operators over the driver's tables, each with the SQL that gives the same rows.

Tables without dates, codes or addresses of their own give them by a formula on keys, the same on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators import commits, consensus, extraction, layout, ledger, localization, quality, validation
from ..storage import new_path
from . import record_plan


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows of a task where a row takes much work: a table of narrow rows is few files, and so few tasks.
TASK_ROWS = 10_000


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly over all cores, in as many parts as they need; for narrow rows that much work follows."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.repartition(parts)


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_ONES, _TENS = f"[{_in(C.ONES)}]", f"[{_in(C.TENS)}]"


def _w100(n: str) -> str:
    return f"CASE WHEN {n} < 20 THEN {_ONES}[({n}) + 1] WHEN ({n}) % 10 = 0 THEN {_TENS}[({n}) // 10 + 1] ELSE {_TENS}[({n}) // 10 + 1] || ' ' || {_ONES}[({n}) % 10 + 1] END"


def _w1000(n: str) -> str:
    return f"CASE WHEN {n} < 100 THEN {_w100(n)} ELSE {_ONES}[({n}) // 100 + 1] || ' Hundred' || CASE WHEN ({n}) % 100 > 0 THEN ' ' || ({_w100(f'(({n}) % 100)')}) ELSE '' END END"


def words_sql(n: str) -> str:
    """DuckDB text of an integer column n in words."""
    thousands = f"({_w1000(f'({n} // 1000)')}) || ' Thousand' || CASE WHEN {n} % 1000 > 0 THEN ' ' || ({_w1000(f'({n} % 1000)')}) ELSE '' END"
    return f"CASE WHEN {n} < 0 OR {n} > 999999 THEN NULL WHEN {n} < 1000 THEN {_w1000(n)} ELSE {thousands} END"


# money, dates, names

_PLAN_SQL = """
SELECT o_orderkey, floor(o_totalprice)::BIGINT AS contact, ((year(max(l_shipdate)) - year(any_value(o_orderdate))) * 12)::BIGINT AS my
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice
"""


def _plans(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("renewal"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").alias("contact"), "o_orderdate")
    return orders.join(last, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "contact", C.months_between_years(F.col("o_orderdate"), F.col("renewal")).cast("long").alias("my"))


@query(f"""
WITH p AS ({_PLAN_SQL}), c AS (SELECT *, CASE WHEN my > 0 THEN (100 * contact + 1033 * my) // my END AS cents FROM p)
SELECT o_orderkey, contact, my, cents,
  CASE WHEN my = 0 THEN 'INVALID' WHEN my < 0 THEN '' ELSE (cents // 100)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0') END AS installment,
  CASE WHEN my > 0 THEN ({words_sql("(cents // 100)")}) || ' Point ' || {_ONES}[(cents // 10) % 10 + 1] || ' ' || {_ONES}[cents % 10 + 1] ELSE '' END AS in_words
FROM c""")
def installment_plan(spark: SparkSession, sf: str) -> DataFrame:
    p = _plans(spark, sf).withColumn("cents", C.installment_cents(F.col("contact"), F.col("my")))
    return p.withColumn("installment", C.installment_text(F.col("contact"), F.col("my"))).withColumn("in_words", F.when(F.col("my") > 0, C.cents_words(F.col("cents"))).otherwise(""))


@query(f"""
WITH a AS (SELECT o_orderkey, o_orderkey * 37 % 1000000 AS n FROM orders)
SELECT o_orderkey, {words_sql("n")} AS n_words, ({words_sql("n")}) || ' Point ' || {_ONES}[n % 10 + 1] || ' Zero' AS amount_words FROM a""")
def amount_words(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey") * 37 % 1_000_000
    amount = F.concat(n.cast("string"), F.lit("."), (n % 10).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", C.integer_words(n).alias("n_words"), C.amount_words(amount).alias("amount_words"))


_INITIAL = lambda c: f"CASE WHEN regexp_matches(trim({c}), '^\\p{{L}}') THEN upper(left(trim({c}), 1)) ELSE '' END"


@query(f"SELECT c_custkey, {_INITIAL('c_name')} || {_INITIAL('c_mktsegment')} || {_INITIAL('n_name')} AS initial FROM customer JOIN nation ON c_nationkey = n_nationkey")
def initials(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select("c_custkey", C.initials(F.col("c_name"), F.col("c_mktsegment"), F.col("n_name")).alias("initial"))


# a date with misread digits; every 7th has an impossible month, every 11th a two-digit year
_NOISY = "translate(lpad(CAST(o_orderkey % 31 + 1 AS VARCHAR), 2, '0') || '/' || CAST(CASE WHEN o_orderkey % 7 = 0 THEN 13 ELSE o_orderkey % 12 + 1 END AS VARCHAR) || '.' || CAST(CASE WHEN o_orderkey % 11 = 0 THEN 99 ELSE 1895 + o_orderkey % 210 END AS VARCHAR), '015', 'oIS')"


@query(f"""
WITH r AS (SELECT o_orderkey, {_NOISY} AS raw FROM orders),
t AS (SELECT *, try_strptime(CASE WHEN regexp_matches(translate(raw, 'oOlI|SsBbZzgq', '0011155862299'), '^[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{4}}$')
        THEN regexp_replace(translate(raw, 'oOlI|SsBbZzgq', '0011155862299'), '[.-]', '/', 'g') END, '%d/%m/%Y') AS d FROM r)
SELECT o_orderkey, raw, CASE WHEN year(d) BETWEEN 1900 AND 2100 THEN strftime(d, '%d/%m/%Y') END AS cleaned FROM t""")
def date_clean(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "orders").select("o_orderkey", F.expr(_NOISY.replace("VARCHAR", "STRING")).alias("raw"))
    return raw.withColumn("cleaned", C.clean_date(F.col("raw")))


@query("""
WITH d AS (SELECT l_orderkey, list(strftime(l_shipdate, '%d/%m/%Y') ORDER BY l_linenumber, l_shipdate) AS days FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, days[1] AS dob, CASE WHEN len(days) >= 2 THEN days[-2] ELSE '' END AS issue, CASE WHEN len(days) >= 2 THEN days[-1] ELSE '' END AS renewal FROM d""")
def date_pick(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_shipdate"))), lambda s: F.date_format(s["l_shipdate"], "dd/MM/yyyy")).alias("days"))
    late = lambda k: F.when(F.size("days") >= 2, F.element_at("days", F.lit(k))).otherwise("")
    return days.select("l_orderkey", F.element_at("days", 1).alias("dob"), late(-2).alias("issue"), late(-1).alias("renewal"))


# e-mail, postcode, contact, device numbers

_MAIL = "CASE c_custkey % 6 WHEN 0 THEN 'Name_user' || c_custkey || '@mail.com' WHEN 1 THEN 'Brownbrown@site' || c_custkey || 'com' WHEN 2 THEN '*user' || c_custkey || '@examplecouk.' WHEN 3 THEN 'x' || c_custkey || '@uniacuk' WHEN 4 THEN 'desk@firmde' ELSE 'nobody' || c_custkey END"


@query(f"""
WITH m AS (SELECT c_custkey, {_MAIL} AS raw FROM customer),
n AS (SELECT *, trim(raw, '.,*') AS t FROM m),
s AS (SELECT *, CASE c_custkey % 6 WHEN 0 THEN 'Name' WHEN 1 THEN 'Brown' ELSE '' END AS last_name, CASE c_custkey % 6 WHEN 0 THEN t[6:] WHEN 1 THEN t[6:] ELSE t END AS u FROM n)
SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN regexp_replace(u, 'com$', '.com') WHEN 2 THEN regexp_replace(u, 'couk$', '.co.uk') WHEN 3 THEN regexp_replace(u, 'acuk$', '.ac.uk') WHEN 4 THEN regexp_replace(u, 'de$', '.de') ELSE u END AS email, last_name FROM s""")
def email_clean(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "customer").select("c_custkey", C.clean_email(F.expr(_MAIL)).alias("m"))
    return raw.select("c_custkey", "m.email", "m.last_name")


@query("""
WITH f AS (SELECT doc_id, regexp_extract(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+') AS email FROM documents)
SELECT doc_id, email FROM f WHERE email <> ''""")
def email_find(spark: SparkSession, sf: str) -> DataFrame:
    mail = F.regexp_extract("text", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", 0)
    return table(spark, sf, "documents").select("doc_id", mail.alias("email")).where("email <> ''")


_CODE = "CASE c_custkey % 5 WHEN 0 THEN 'LK' || c_custkey % 10 || '5NW' WHEN 1 THEN 'WNI ' || c_custkey % 10 || 'RD' WHEN 2 THEN 'K27 3PL' WHEN 3 THEN 'B' || c_custkey % 10 || ' OXD' ELSE 'QQ' || c_custkey END"
_CODE_OK = "'(?i)^(GIR\\s*0AA|SAN\\s*TA1|[A-Z]{1,2}[0-9][A-Z0-9]?\\s*[0-9][A-Z]{2}|[A-Z]{1,2}[0-9]{1,2}[A-Z]?\\s*[0-9][A-Z]{2})$'"


@query(f"""
WITH r AS (SELECT c_custkey, {_CODE} AS raw FROM customer),
f AS (SELECT *, CASE c_custkey % 5 WHEN 0 THEN raw[:3] || ' ' || raw[4:] WHEN 1 THEN 'WN1 ' || raw[5:] WHEN 3 THEN raw[:2] || ' 0XD' ELSE raw END AS made FROM r)
SELECT c_custkey, raw, CASE WHEN c_custkey % 5 = 4 THEN raw ELSE made END AS repaired, regexp_matches(trim(CASE WHEN c_custkey % 5 = 4 THEN raw ELSE made END), {_CODE_OK}) AS is_valid FROM f""")
def postcode_repair(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "customer").select("c_custkey", F.expr(_CODE).alias("raw"))
    return raw.withColumn("repaired", C.repaired_postcode(F.col("raw"))).withColumn("is_valid", C.is_postcode(F.col("repaired")))


_CONTACT = "CASE o_orderkey % 4 WHEN 0 THEN '£' || CAST(floor(o_totalprice) % 100000 AS BIGINT) WHEN 1 THEN '€ ' || o_orderkey % 90 || '.25' WHEN 2 THEN CAST(o_orderkey AS VARCHAR) ELSE '$abc' END"


@query(f"WITH r AS (SELECT o_orderkey, {_CONTACT} AS raw FROM orders) SELECT o_orderkey, CASE WHEN regexp_matches(raw, '[£€$]\\s*[0-9]{{2,5}}') THEN regexp_replace(raw, '[^0-9]', '', 'g') ELSE '' END AS contact FROM r")
def contact_parse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", C.contact_digits(F.expr(_CONTACT.replace("VARCHAR", "STRING"))).alias("contact"))


@query("SELECT o_orderkey, 'Nokia 7210' AS model, lpad(o_orderkey::VARCHAR, 6, '4') || ' - ' || lpad((o_custkey * 7)::VARCHAR, 9, '3') AS imei1, '%@7$2 - #1-4!' AS imei2 FROM orders")
def imei_split(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(F.lit("Nokia"), F.lit("7210"), F.lpad(F.col("o_orderkey").cast("string"), 6, "4"), F.lit("-"), F.lpad((F.col("o_custkey") * 7).cast("string"), 9, "3"), F.lit("%@7$2"), F.lit("-"), F.lit("#1-4!"))
    got = extraction.extract_values(table(spark, sf, "orders").select("o_orderkey", _laid_out(F.array_join(words, " ")).alias("tokens")), ("o_orderkey",))
    return got.select("o_orderkey", F.col("`Mobile Model`").alias("model"), F.col("`IMEI 1`").alias("imei1"), F.col("`IMEI 2`").alias("imei2"))


# rules

_RECORD_FIELDS = ("Email", "DOB", "Issue Date", "Gender", "Contact", "Initial", "Installments", "Amount in Words", "IMEI 1", "Mobile Model")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    value = {
        "Email": F.when(k % 3 == 0, "a@b").otherwise(F.concat(F.lit("u"), k, F.lit("@mail.org"))), "DOB": F.lit("01/02/1990"), "Issue Date": F.when(k % 5 == 0, "31/02/2020").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")),
        "Gender": F.when(k % 4 == 0, "male").otherwise("Male"), "Contact": F.when(k % 7 == 0, "12a").otherwise("580"), "Initial": F.when(k % 2 == 0, "M1").otherwise("MAB"),
        "Installments": F.when(k % 6 == 0, "INVALID").otherwise("34.49"), "Amount in Words": F.when(k % 6 == 1, "").otherwise("Thirty"), "IMEI 1": F.when(k % 9 == 0, "1234").otherwise("351806012233445"), "Mobile Model": F.when(k % 10 == 0, "1234 x").otherwise("Nokia"),
    }
    field = lambda v: F.struct(v.alias("value"), F.when(k % 8 == 0, 42.5).otherwise(90.0).alias("confidence"), (k % 16 == 0).alias("needs_review"))
    entries = [x for name, v in value.items() for x in (F.lit(name), field(v))]
    return table(spark, sf, "orders").select("o_orderkey", F.create_map(*entries).alias("fields"), F.when(k % 6 == 0, 0).otherwise(24).alias("MY"))


_RULES_SQL = f"""
r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'a@b' ELSE 'u' END AS mail, strftime(o_orderdate, '%d/%m/%Y') AS issue, o_orderdate, o_orderkey % 8 = 0 AS low, o_orderkey % 6 = 0 AS zero FROM orders),
i AS (
  {" UNION ALL ".join(f"SELECT k, '{n}' AS field, 'LOW_OCR_CONFIDENCE' AS reason, 'REVIEW' AS severity FROM r WHERE low" for n in fixed.EVIDENCE if n in _RECORD_FIELDS)}
  {" ".join(f"UNION ALL SELECT k, '{n}', 'MISSING_REQUIRED_FIELD', 'FATAL' FROM r" for n in fixed.REQUIRED if n not in _RECORD_FIELDS)}
  UNION ALL SELECT k, 'Amount in Words', 'MISSING_REQUIRED_FIELD', 'FATAL' FROM r WHERE k % 6 = 1
  UNION ALL SELECT k, 'Email', 'INVALID_EMAIL', 'FATAL' FROM r WHERE mail = 'a@b'
  UNION ALL SELECT k, 'Issue Date', 'INVALID_ISSUE_DATE', 'FATAL' FROM r WHERE k % 5 = 0
  UNION ALL SELECT k, 'DOB', 'DOB_AFTER_ISSUE_DATE', 'FATAL' FROM r WHERE k % 5 <> 0 AND DATE '1990-02-01' >= o_orderdate::DATE
  UNION ALL SELECT k, 'Gender', 'INVALID_GENDER', 'FATAL' FROM r WHERE k % 4 = 0
  UNION ALL SELECT k, 'Contact', 'INVALID_CONTACT', 'FATAL' FROM r WHERE k % 7 = 0
  UNION ALL SELECT k, 'IMEI 1', 'MOBILE_MODEL_IMEI_CONFLICT', 'FATAL' FROM r WHERE k % 9 = 0 AND k % 10 = 0
  UNION ALL SELECT k, 'IMEI 1', 'INVALID_IMEI1', 'FATAL' FROM r WHERE k % 9 = 0
  UNION ALL SELECT k, 'IMEI 1', 'AMBIGUOUS_IMEI1', 'REVIEW' FROM r WHERE k % 9 = 0
  UNION ALL SELECT k, 'Initial', 'INVALID_INITIAL', 'WARNING' FROM r WHERE k % 2 = 0
  UNION ALL SELECT k, 'Amount in Words', 'EMPTY_AMOUNT_WORDS', 'FATAL' FROM r WHERE k % 6 = 1)
"""


@query(f"WITH {_RULES_SQL} SELECT k AS o_orderkey, field, reason, severity FROM i")
def validate_issues(spark: SparkSession, sf: str) -> DataFrame:
    return validation.validated(_records(spark, sf)).select("o_orderkey", F.explode("issues").alias("i")).select("o_orderkey", "i.field", "i.reason", "i.severity")


@query(f"WITH {_RULES_SQL}, n AS (SELECT k, count(*) AS n FROM i GROUP BY k) SELECT CASE WHEN n > 0 THEN 'REVIEW_REQUIRED' ELSE 'VALIDATED' END AS status, count(*) AS records, sum(n)::BIGINT AS issues FROM n GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return validation.validated(_records(spark, sf)).groupBy("status").agg(F.count("*").alias("records"), F.sum(F.size("issues")).alias("issues"))


@query("""
WITH i AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, event_type AS reason, event_id AS seq FROM i WHERE k = 1""")
def issue_dedup(spark: SparkSession, sf: str) -> DataFrame:
    long = table(spark, sf, "events").select("user_id", F.col("event_type").alias("reason"), F.lit("f").alias("field"), F.struct("ts", "event_id").alias("seq"))
    return validation.first_issues(long, ["user_id"]).select("user_id", "reason", F.col("seq.event_id").alias("seq"))


@query("""
SELECT c_custkey, f AS missing FROM customer, (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) AS r(f) WHERE f <> c_mktsegment""")
def required_missing(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))
    return table(spark, sf, "customer").select("c_custkey", F.explode(F.array_except(asked, F.array("c_mktsegment"))).alias("missing"))


# rows and records

@query("""
WITH s AS (SELECT *, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS st FROM events),
w AS (SELECT user_id, event_id, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n, max(st) OVER (PARTITION BY user_id) AS a FROM s)
SELECT user_id, event_id, (CASE WHEN a = 0 THEN 1 ELSE n END)::INT AS record_number FROM w""")
def segment_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return layout.number_records(rows, F.col("event_type") == "signup", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "record_number")


@query(f"""
WITH w AS (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: regexp_replace(trim(lower(x), $t${fixed.TRIM_TITLE}$t$), '^[0-9]+[.\\-_)]', '')), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, list_bool_or(list_transform(w[1:3], lambda x: x IN ({_in(fixed.START_TITLES)}) OR regexp_matches(x, '^({"|".join(sorted({t.replace(" ", "").replace(".", "") for t in fixed.START_TITLES if len(t.replace(" ", "").replace(".", "")) >= 3}))})'))) IS TRUE AS starts FROM w""")
def record_starts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", layout.starts_record(F.split("text", " ")).alias("starts"))


def _synthetic_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """All words of documents, laid out 12 to a row with a wavering y."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    each = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("image_id"), F.posexplode(words).alias("token_seq", "text"))
    k = F.col("token_seq")
    return each.select("image_id", F.lit("A").alias("variant"), "token_seq", "text", ((k % 12) * 60).cast("int").alias("x"), (F.floor(k / 12) * 40 + k % 5).cast("int").alias("y"), F.lit(50).alias("width"), (18 + k % 4).cast("int").alias("height"), (40.0 + (k * 13) % 60).alias("confidence"))


#: By the layout of _synthetic_tokens: twelve words to a row, rows too far apart to meet.
_ROWS_SQL = f"""
WITH w AS (SELECT doc_id, unnest(x) AS t, unnest(range(len(x))) AS k FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS x FROM documents)),
r AS (SELECT doc_id, k // 12 AS row, min((k // 12) * 40 + k % 5)::INT AS y, count(*)::INT AS n_words, string_agg(t, ' ' ORDER BY k) AS text FROM w GROUP BY ALL)
SELECT doc_id::VARCHAR AS image_id, (row_number() OVER (PARTITION BY doc_id ORDER BY row) - 1)::INT AS row_seq, y, n_words, text FROM r WHERE trim(text) NOT IN ({_in(fixed.ARTIFACT_ROWS)})"""


@query(_ROWS_SQL)
def row_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return layout.cluster_rows(_synthetic_tokens(spark, sf)).select("image_id", "row_seq", "y", F.size("words").alias("n_words"), "text")


@query()
def structured_records(spark: SparkSession, sf: str) -> DataFrame:
    made = record_plan.structured(_synthetic_tokens(spark, sf))
    return made.select("image_id", "record_number", "form_no", "status", "fingerprint", F.size("issues").alias("n_issues"))


@query("""
WITH m AS (SELECT user_id, event_type, coalesce(avg(value), 0) AS mean FROM events GROUP BY ALL)
SELECT user_id, event_type AS variant, mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean DESC, event_type) AS k FROM m) WHERE k = 1""")
def variant_pick(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    records = e.select(F.col("user_id").alias("image_id"), F.col("event_type").alias("variant"), F.array(F.struct(F.col("value").alias("confidence"))).alias("tokens"))
    best = layout.best_variant(records)
    return best.select("image_id", "variant", F.explode("tokens").alias("t")).groupBy(F.col("image_id").alias("user_id"), "variant").agg(F.avg("t.confidence").alias("mean"))


@query("""
WITH t AS (SELECT user_id, event_type AS value, count(*) AS votes, min(event_id) AS f, avg(value) FILTER (value > 0) AS mean, max(value) AS top FROM events GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) AS k FROM t)
SELECT user_id, value, votes, coalesce(mean, top) >= 55 OR votes >= 2 AS accepted FROM b WHERE k = 1""")
def consensus_vote(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "events").select("user_id", F.col("event_type").alias("value"), F.col("value").alias("confidence"), F.col("event_id").alias("run_seq"))
    return consensus.vote(runs, ["user_id"]).select("user_id", "value", "votes", "accepted")


@query()
def retry_decisions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    field = F.element_at(F.array(*map(F.lit, ("IMEI 1", "Postal Code", "DOB", "Contact", "City", "Title"))), (k % 6 + 1).cast("int"))
    raw = F.when(k % 5 == 0, "").when(field == "IMEI 1", F.lpad((k * 7919).cast("string"), 15, "4")).when(field == "Postal Code", "BSI 4TX").when(field == "DOB", "x 01/02/1990").otherwise(F.concat(F.lit("v"), k % 3))
    runs = table(spark, sf, "orders").select(F.floor(k / 8).alias("region"), field.alias("field"), raw.alias("raw_text"), (k * 31 % 101).cast("double").alias("confidence"), k.alias("run_seq"))
    return consensus.decide(runs, ["region"])


def _retried_records(spark: SparkSession, sf: str) -> DataFrame:
    """A sound record of every order, with one fault by its key."""
    k = F.col("o_orderkey")
    case, blank = k % 8, F.array().cast("array<struct<x:int,y:int,width:int,height:int>>")
    value = {n: F.lit("x") for n in fixed.REQUIRED} | {
        "Title": F.lit("Ms"), "First Name": F.lit("Ada"), "Last Name": F.lit("Ek"), "Email": F.when(case == 4, "nobody").otherwise("ada@ek.example.org"), "DOB": F.lit("03/02/1990"), "Gender": F.when(case == 5, "male").otherwise("Female"),
        "Postal Code": F.when(case == 2, "QX").otherwise("K27 3PL"), "Contact": F.when(case == 6, "12a").otherwise("720"), "Issue Date": F.when(case == 0, "31/02/2020").otherwise("04/05/2020"), "Renewal Date": F.lit("06/07/2022"),
        "City": F.concat(F.lit("Town "), k), "IMEI 1": F.when(case == 1, "1234").otherwise("351806012233445"), "Mobile Model": F.lit("Nokia"), "SIM No": F.lit(""),
    }
    box = lambda x: F.array(F.struct(F.lit(x).alias("x"), F.lit(10).alias("y"), F.lit(30).alias("width"), F.lit(12).alias("height")))
    boxes = {n: box(40) for n in ("Issue Date", "DOB", "Postal Code", "IMEI 1", "City", "Contact")} | {"Gender": box(5000)}
    field = lambda n, v: F.struct(v.alias("value"), v.alias("raw_text"), F.when((case == 3) & F.lit(n == "City"), 30.0).otherwise(90.0).alias("confidence"), F.lit(n == "SIM No").alias("needs_review"), boxes.get(n, blank).alias("coordinates"))
    made = F.create_map(*[x for n, v in value.items() for x in (F.lit(n), field(n, v))])
    keyed = spread(table(spark, sf, "orders").select("o_orderkey")).select(k.cast("string").alias("image_id"), F.lit("A").alias("variant"), F.lit(1).alias("record_number"), "o_orderkey", made.alias("fields"))
    return validation.validated(validation.calculated(keyed))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 8 AS c FROM orders),
d AS (
  SELECT k, 1 AS round, 'Issue Date' AS field, 'ACCEPTED_CONSENSUS' AS decision, '05/06/1985' AS value FROM o WHERE c = 0
  UNION ALL SELECT k, 2, 'DOB', 'ACCEPTED_CONSENSUS', '07/08/1960' FROM o WHERE c = 0
  UNION ALL SELECT k, 1, 'IMEI 1', CASE WHEN k % 3 = 0 THEN 'NO_SAFE_CORRECTION' ELSE 'ACCEPTED_STRICT_IMEI' END, CASE WHEN k % 3 = 0 THEN NULL ELSE lpad(k::VARCHAR, 15, '4') END FROM o WHERE c = 1
  UNION ALL SELECT k, 1, 'Postal Code', 'ACCEPTED_POSTCODE', 'WN1 4RD' FROM o WHERE c = 2
  UNION ALL SELECT k, 1, 'City', 'NO_OCR_OUTPUT', NULL FROM o WHERE c = 3
  UNION ALL SELECT k, 1, 'Email', 'FIELD_REGION_NOT_LOCATED', NULL FROM o WHERE c = 4
  UNION ALL SELECT k, 1, 'Gender', 'EMPTY_CROP_REGION', NULL FROM o WHERE c = 5
  UNION ALL SELECT k, 1, 'Contact', 'INVALID_IMAGE_INPUT', NULL FROM o WHERE c = 6
  UNION ALL SELECT k, 1, 'Installments', 'FIELD_REGION_NOT_LOCATED', NULL FROM o WHERE c = 6
  UNION ALL SELECT k, 1, 'Amount in Words', 'FIELD_REGION_NOT_LOCATED', NULL FROM o WHERE c = 6
  UNION ALL SELECT k, 1, 'Installments', 'FIELD_REGION_NOT_LOCATED', NULL FROM o WHERE c = 0
  UNION ALL SELECT k, 1, 'Amount in Words', 'FIELD_REGION_NOT_LOCATED', NULL FROM o WHERE c = 0
  UNION ALL SELECT k, 1, 'SIM No', 'FIELD_REGION_NOT_LOCATED', NULL FROM o WHERE c < 7)
SELECT k AS o_orderkey, round::INT AS round, field, decision, value, CASE WHEN c = 7 THEN 'VALIDATED' ELSE 'REVIEW_REQUIRED' END AS status FROM o LEFT JOIN d USING (k)""")
def retry_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Retries until nothing changes: a corrected issue date makes the birth date fail, which the second round asks for."""
    records = _retried_records(spark, sf)
    k = F.col("image_id").cast("long")
    images = table(spark, sf, "orders").where("o_orderkey % 8 <> 6").select(F.col("o_orderkey").cast("string").alias("image_id"), F.lit(800).alias("width"), F.lit(600).alias("height"))
    none = records.select(*record_plan.KEYS, F.lit("").alias("field"), *[F.lit(None).cast("struct<x:int,y:int,width:int,height:int>").alias(c) for c in ("value_box", "label_box")], F.lit("").alias("anchor"), F.lit(0.0).alias("confidence"), F.lit("").alias("source")).where("false")

    def read(asked: DataFrame) -> DataFrame:
        device = F.when(k % 3 == 0, "Nokia 12").otherwise(F.concat(F.lit("Nokia "), F.lpad(F.col("image_id"), 15, "4")))
        said = F.when(F.col("field") == "Issue Date", "on 05/06/1985").when(F.col("field") == "DOB", "07/08/1960").when(F.col("field") == "IMEI 1", device).when(F.col("field") == "Postal Code", "WNI 4RD").otherwise("")
        return asked.select(*record_plan.KEYS, "field", said.alias("raw_text"), F.explode(F.array(F.lit(1), F.lit(2))).alias("run_seq")).withColumn("confidence", F.col("run_seq") * 20.0)

    told, decisions = record_plan.reviewed(records, none, images, read)
    return told.select(*record_plan.KEYS, "o_orderkey", "status").join(decisions, record_plan.KEYS, "left").select("o_orderkey", "round", "field", "decision", "value", "status")


@query("""
WITH f AS (SELECT sha256(o_custkey::VARCHAR) AS fingerprint, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY p) AS nth FROM f)
SELECT fingerprint, 109 + row_number() OVER (ORDER BY p, k) AS form_no FROM n WHERE nth = 1""")
def ledger_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Form numbers over one commit per order priority: a customer keeps the number of the first commit that brought it."""
    book, orders = commits.Ledger(spark, new_path(spark, "ledger")), table(spark, sf, "orders")
    for name in [r[0] for r in orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]:
        brought = orders.where(F.col("o_orderpriority") == name).select(F.sha2(F.col("o_custkey").cast("string"), 256).alias("fingerprint"), "o_orderkey")
        book.allocate_forms(brought, ["o_orderkey"])
    return book.snapshot().records().select("fingerprint", "form_no")


@query("""
SELECT l_orderkey, min(l_partkey % 1000)::BIGINT AS x, min(l_suppkey % 500)::BIGINT AS y, (max(l_partkey % 1000 + l_quantity) - min(l_partkey % 1000))::BIGINT AS width, (max(l_suppkey % 500 + l_linenumber) - min(l_suppkey % 500))::BIGINT AS height
FROM lineitem GROUP BY l_orderkey""")
def bbox_union(spark: SparkSession, sf: str) -> DataFrame:
    box = layout.union_box(F.col("l_partkey") % 1000, F.col("l_suppkey") % 500, F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(box.alias("b")).select("l_orderkey", "b.*")


@query("SELECT l_orderkey, coalesce(least(greatest(round_even(median(l_quantity) FILTER (l_quantity > 4) * 0.6, 0)::INT, 8), 35), 15) AS tolerance FROM lineitem GROUP BY l_orderkey")
def dyn_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.lit("A").alias("variant"), F.col("l_quantity").alias("height"))
    return layout.tolerances(t).select(F.col("image_id").alias("l_orderkey"), "tolerance")


#: Two decimals of the binary value: cents are counted in units of 2^-52, halves go to even.
_MEAN_SQL = """
WITH a AS (SELECT user_id, coalesce(avg(value) FILTER (value > 0), avg(value)) AS m, count(*) FILTER (value < 50) AS low FROM events GROUP BY user_id),
n AS (SELECT *, 100 * (m * 4503599627370496)::HUGEINT AS t FROM a),
c AS (SELECT *, t // 4503599627370496 AS q, t % 4503599627370496 AS r FROM n)
SELECT user_id, (q + CASE WHEN r > 2251799813685248 OR r = 2251799813685248 AND q % 2 = 1 THEN 1 ELSE 0 END)::DOUBLE / 100 AS confidence, low FROM c"""


@query(_MEAN_SQL)
def confidence_mean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(layout.mean_confidence(F.col("value")).alias("confidence"), F.count_if(F.col("value") < 50).alias("low"))


# localisation

@query(f"""
WITH a AS (SELECT DISTINCT field, regexp_replace(lower(alias), '[^a-z0-9]', '', 'g') AS alias FROM (VALUES {", ".join(f"('{f}', '{a.replace(chr(39), chr(39) * 2)}')" for f, names in fixed.LABELS.items() for a in names)}) AS v(field, alias)),
c AS (SELECT DISTINCT regexp_replace(lower(w), '[^a-z0-9]', '', 'g') AS candidate FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT x FROM (VALUES ('1ME1'), ('lMEI'), ('postcod'), ('Referense No'), ('tittle'), ('citty'), ('IMEI 2')) AS t(x)))
SELECT DISTINCT candidate, field FROM c, a WHERE candidate <> '' AND NOT (field = 'IMEI 1' AND contains(candidate, '2')) AND NOT (field = 'IMEI 2' AND contains(candidate, '1'))
AND (candidate = alias OR (regexp_replace(candidate, '[^0-9]', '', 'g') = regexp_replace(alias, '[^0-9]', '', 'g') AND
  CASE WHEN length(alias) >= 4 AND abs(length(candidate) - length(alias)) <= 1 THEN levenshtein(candidate, alias) <= 1
       WHEN length(alias) >= 9 AND abs(length(candidate) - length(alias)) <= 2 THEN levenshtein(candidate, alias) <= 2 ELSE false END))""")
def label_match(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("w"))
    more = spark.sql("SELECT * FROM VALUES ('1ME1'), ('lMEI'), ('postcod'), ('Referense No'), ('tittle'), ('citty'), ('IMEI 2') AS t(w)")
    c = words.union(table(spark, sf, "customer").select("c_mktsegment")).union(more).select(localization.normal(F.col("w")).alias("candidate")).distinct()
    return c.join(F.broadcast(localization.label_aliases(spark)), localization.label_matches(F.col("candidate"), F.col("field"), F.col("alias"))).select("candidate", "field").distinct()


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_x FROM lineitem")
def spatial_next_label(spark: SparkSession, sf: str) -> DataFrame:
    right = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, Window.unboundedFollowing)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.min("l_partkey").over(right).alias("next_x"))


@query()
def field_regions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    words = F.when(k % 3 == 0, F.array(F.lit("IMEI"), F.lit("1:"), F.lit("351806012233445"), F.lit("Post"), F.lit("code"), F.lit("BS1"))).when(k % 3 == 1, F.array(F.lit("City"), F.lit("Country"))).otherwise(F.array(F.lit("Leeds"), F.lit("England")))
    boxed = F.transform(words, lambda w, i: F.struct(w.alias("text"), (i * 80).alias("x"), F.lit(0).alias("y"), F.lit(60).alias("width"), F.lit(20).alias("height"), F.lit(90.0).alias("confidence")))
    rows = table(spark, sf, "orders").select(F.floor(k / 3).alias("image_id"), F.lit("A").alias("variant"), F.lit(1).alias("record_number"), (k % 3).cast("int").alias("row_seq"), boxed.alias("words"))
    found = localization.field_regions(rows)
    return found.select("image_id", "field", "value_box.x", "value_box.width", "anchor", "confidence", "source")


# images

@query("SELECT user_id, avg(value) AS brightness, stddev_pop(value) AS contrast, stddev_pop(value) < 2 OR (avg(value) > 252 AND stddev_pop(value) < 5) AS is_blank FROM events GROUP BY user_id")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return quality.gate(table(spark, sf, "events"), ["user_id"], "value")


@query("""
WITH b AS (SELECT event_type, least(255, greatest(0, floor(value)))::BIGINT AS bin, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
c AS (SELECT event_type, bin, sum(n) OVER u AS wb, sum(bin * n) OVER u AS sb, sum(n) OVER (PARTITION BY event_type) AS w, sum(bin * n) OVER (PARTITION BY event_type) AS s FROM b WINDOW u AS (PARTITION BY event_type ORDER BY bin)),
v AS (SELECT event_type, bin, CASE WHEN wb < w THEN wb * (w - wb) * pow(sb / wb - (s - sb) / (w - wb), 2) ELSE 0 END AS v FROM c)
SELECT event_type, CASE WHEN v > 0 THEN bin ELSE 128 END::INT AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, bin) AS k FROM v) WHERE k = 1""")
def otsu_threshold(spark: SparkSession, sf: str) -> DataFrame:
    bins = table(spark, sf, "events").select("event_type", F.least(F.lit(255), F.greatest(F.lit(0), F.floor("value"))).cast("long").alias("bin"))
    return quality.thresholds(bins, ["event_type"])


@query("SELECT p_partkey, round_even(least(4.0, greatest(1.0, 3600.0 / greatest(p_size * 40, p_partkey % 5000 + 1)))::DOUBLE, 4) AS scale FROM part")
def hd_scale(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", C.hd_scale(F.col("p_size") * 40, F.col("p_partkey") % 5000 + 1).alias("scale"))


# ledgers

@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_content(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(ledger.content_key(F.col("text")).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_PRINTED = {"Title": "l_returnflag", "Email": "l_linestatus", "File Ref": "l_partkey", "SIM No": "l_suppkey"}


@query(f"SELECT l_orderkey, l_linenumber, sha256(concat_ws('|', {', '.join(_PRINTED[n] + '::VARCHAR' if n in _PRINTED else chr(39) * 2 for n in fixed.FIELDS)})) AS fingerprint FROM lineitem")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    fields = F.create_map(*[x for n, c in _PRINTED.items() for x in (F.lit(n), F.struct(F.col(c).cast("string").alias("raw_text")))])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", extraction.fingerprint(fields).alias("fingerprint"))


@query("SELECT fingerprint, 109 + row_number() OVER (ORDER BY doc_id) AS form_no FROM (SELECT sha256(text) AS fingerprint, min(doc_id) AS doc_id FROM documents GROUP BY 1)")
def form_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.form_numbers(table(spark, sf, "documents").select(ledger.content_key(F.col("text")).alias("fingerprint"), "doc_id"), ["doc_id"])


@query("SELECT doc_id, (28 + (row_number() OVER (ORDER BY doc_id) - 1) // 4)::BIGINT AS file_no FROM documents")
def file_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.file_numbers(table(spark, sf, "documents").select("doc_id"), ["doc_id"])


@query("WITH m AS (SELECT source, max(doc_id) AS highest, (count(*) * 7)::BIGINT AS setting FROM documents GROUP BY source) SELECT source, highest, CASE WHEN setting <= highest THEN highest + 1 ELSE greatest(setting, 110) END AS next_form FROM m")
def ledger_repair(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "documents").groupBy("source").agg(F.max("doc_id").alias("highest"), (F.count("*") * 7).alias("setting"))
    return m.select("source", "highest", ledger.repaired_next(F.col("highest"), F.col("setting"), 110).alias("next_form"))


@query("""
WITH u AS (SELECT o_custkey AS fingerprint, o_orderkey, 0 AS p FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderstatus <> 'F')
SELECT fingerprint, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY p, o_orderkey) AS k FROM u) WHERE k = 1""")
def review_union(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("fingerprint"), "o_orderstatus", F.col("o_orderkey").alias("record_number"), F.lit(0).alias("form_no"))
    best = ledger.newest_records(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"))
    return best.select("fingerprint", F.col("record_number").alias("o_orderkey"))


@query("""
WITH d AS (SELECT ts::DATE AS day, user_id % 7 AS file_no, count(*) AS n FROM events GROUP BY ALL)
SELECT day::VARCHAR AS session_date, file_no, n, (110 + coalesce(sum(n) OVER (PARTITION BY file_no ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS starting_form_no FROM d""")
def session_log(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 7).alias("file_no")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("file_no").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return days.select(F.col("day").cast("string").alias("session_date"), "file_no", "n", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 110).alias("starting_form_no"))


# dictionaries

@query("SELECT n_nationkey, CASE regexp_replace(lower(n_name), '[^a-z]', '', 'g') WHEN 'unitedkingdom' THEN 'United Kingdom' END AS country, CASE n_nationkey % 3 WHEN 0 THEN 'CDMA+GSM' WHEN 1 THEN 'GSM' END AS network FROM nation")
def dict_lookup(spark: SparkSession, sf: str) -> DataFrame:
    key = F.element_at(F.array(F.lit("CDMA*GSM"), F.lit("gsm"), F.lit("lte")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    letters = F.regexp_replace(F.lower("n_name"), "[^a-z]", "")
    return table(spark, sf, "nation").select("n_nationkey", C.lookup(letters, fixed.COUNTRIES).alias("country"), C.lookup(C.normalized(key), fixed.NETWORKS).alias("network"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Hutchison Whampoa' WHEN 1 THEN 'Vodafone' WHEN 2 THEN CASE WHEN length('o2' || p_partkey) > 4 THEN NULL ELSE 'O2' END END AS provider FROM part")
def prefix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.element_at(F.array(*map(F.lit, ("Hutchison-", "VODAF0NE=", "o2", "Telco"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_partkey").cast("string"))
    norm = C.normalized(said)
    hits = F.coalesce(*[F.when(F.startswith(norm, F.lit(k)) & ((F.length(norm) <= 4) if k in ("o2", "02") else F.lit(True)), n) for k, n in fixed.PROVIDERS])
    return table(spark, sf, "part").select("p_partkey", hits.alias("provider"))


# Invented records, in three shapes: k % 3 picks the shape, k the numbers in it.
_SHAPES = (
    "Mrs. Tessa Quill tquill@post.example.org Dr. Quill 05/11/1979 Female Student Elm Lane Ripon HG41AB England Orange Kilo - {ref} ORN77X9 AbC1234567dEf CDMA Nokia 3310 356938 - 03 - 564380 - 9 Classic Visa £{sum} 12/03/2019 12/03/2021",
    "Rev AdaLark 23-O4-1966 ma1e Self Employed 4 Mill Row, Thirsk YO71AB Wales 02 {ref} TM-44 zz99887766x GSM T610 490154 -2 %1#4 SMS+ {sum} 01/02/2020 01/02/2023",
    "Capt Bo Finch bo@finch.example.net 30/06/1988 {ref} Foxtrot",
)


def _texts(k: F.Column) -> F.Column:
    ref, total = F.lpad(k.cast("string"), 7, "4"), (k % 900 + 99).cast("string")
    filled = [F.replace(F.replace(F.lit(s), F.lit("{ref}"), ref), F.lit("{sum}"), total) for s in _SHAPES]
    return F.get(F.array(*filled), (k % 3).cast("int"))


def _laid_out(text: F.Column) -> F.Column:
    return F.transform(F.split(text, " "), lambda w, i: F.struct(w.alias("text"), (i * 50).alias("x"), F.lit(0).alias("y"), F.lit(40).alias("width"), F.lit(20).alias("height"), F.lit(90.0).alias("confidence")))


def _expected_sql() -> str:
    """The fields of _SHAPES as they must be read; {ref} and {sum} stand for the key's numbers."""
    shapes = (
        {"Title": "Mrs", "First Name": "Tessa", "Last Name": "Quill", "Email": "tquill@post.example.org", "Father Name": "Quill", "DOB": "05/11/1979", "Gender": "Female", "Profession": "Student", "Mailing Street": "Elm Lane", "City": "Ripon", "Postal Code": "HG4 1AB", "Country": "England", "Service Provider": "Orange", "File Ref": "Kilo - {ref}", "Reference No": "ORN77X9", "SIM No": "AbC1234567dEf", "Network Type": "CDMA", "Mobile Model": "Nokia 3310", "IMEI 1": "356938 - 03 - 564380 - 9", "Plan Type": "Classic", "Card Type": "Visa", "Contact": "{sum}", "Issue Date": "12/03/2019", "Renewal Date": "12/03/2021"},
        {"Title": "Rev", "First Name": "Ada", "Last Name": "Lark", "DOB": "23/04/1966", "Gender": "Male", "Profession": "Self Employed", "Mailing Street": "4 Mill Row", "City": "Thirsk", "Postal Code": "YO7 1AB", "Country": "Wales", "Service Provider": "O2", "File Ref": "{ref}", "Reference No": "TM-44", "SIM No": "zz99887766x", "Network Type": "GSM", "Mobile Model": "T610", "IMEI 1": "490154 -2", "IMEI 2": "%1#4", "Plan Type": "SMS", "Contact": "{sum}", "Issue Date": "01/02/2020", "Renewal Date": "01/02/2023"},
        {"Title": "Capt", "First Name": "Bo", "Last Name": "Finch", "Email": "bo@finch.example.net", "DOB": "30/06/1988", "Mailing Street": "{ref} Foxtrot", "File Ref": "{ref}"},
    )
    said = lambda v: f"replace(replace('{v}', '{{ref}}', lpad(o_orderkey::VARCHAR, 7, '4')), '{{sum}}', (o_orderkey % 900 + 99)::VARCHAR)"
    each = [f"CASE o_orderkey % 3 WHEN 0 THEN {said(shapes[0].get(n, ''))} WHEN 1 THEN {said(shapes[1].get(n, ''))} ELSE {said(shapes[2].get(n, ''))} END AS {n.lower().replace(' ', '_')}" for n in fixed.FIELDS if n != "Remarks"]
    return f"SELECT o_orderkey, {', '.join(each)}, 'Not Applicable' AS remarks FROM orders"


@query(_expected_sql())
def extract31(spark: SparkSession, sf: str) -> DataFrame:
    got = extraction.extract_values(spread(table(spark, sf, "orders").select("o_orderkey")).select("o_orderkey", _laid_out(_texts(F.col("o_orderkey"))).alias("tokens")), ("o_orderkey",))
    return got.select("o_orderkey", *[F.col(f"`{n}`").alias(n.lower().replace(" ", "_")) for n in fixed.FIELDS])

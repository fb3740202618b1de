"""Schemas of the tables that operators exchange. Nothing is inferred."""

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x", "y", "width", "height")])
TOKEN = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("confidence", T.DoubleType()),
])
OCR_TOKENS = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("variant", T.StringType()), T.StructField("token_seq", T.IntegerType()), *TOKEN.fields])
OCR_ROWS = T.StructType([
    T.StructField("image_id", T.StringType()), T.StructField("variant", T.StringType()), T.StructField("row_seq", T.IntegerType()),
    T.StructField("y", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("words", T.ArrayType(TOKEN)),
])
FIELD = T.StructType([
    T.StructField("value", T.StringType()), T.StructField("raw_text", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("needs_review", T.BooleanType()), T.StructField("coordinates", T.ArrayType(BOX)),
])
ISSUE = T.StructType([T.StructField(c, T.StringType()) for c in ("field", "reason", "severity", "detail")])
RECORD = T.StructType([
    T.StructField("record_number", T.IntegerType()), T.StructField("form_no", T.IntegerType()), T.StructField("MY", T.IntegerType()),
    T.StructField("status", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), FIELD)), T.StructField("issues", T.ArrayType(ISSUE)),
])
BATCH = T.StructType([T.StructField("image", T.StringType()), T.StructField("file_no", T.IntegerType()), T.StructField("records", T.ArrayType(RECORD))])
LEDGER_IMAGES = T.StructType([T.StructField("sha256", T.StringType()), T.StructField("file_no", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("processed_at", T.TimestampType())])
LEDGER_RECORDS = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("form_no", T.IntegerType()), T.StructField("status", T.StringType())])
SESSIONS = T.StructType([
    T.StructField("session_date", T.StringType()), T.StructField("started_at", T.TimestampType()), T.StructField("file_no", T.IntegerType()),
    T.StructField("starting_form_no", T.IntegerType()), T.StructField("last_form_no", T.IntegerType()), T.StructField("status", T.StringType()),
])

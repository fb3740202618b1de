"""Competing readings of a field: candidate cleaning, majority vote, merge of accepted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

LEAST_MEAN, LEAST_VOTES = 55.0, 2
DATES, NAMES, PLACES = ("Issue Date", "Renewal Date", "DOB"), ("First Name", "Last Name", "Father Name"), ("Mailing Street", "City", "Country")


def device_digits(raw: Column) -> Column:
    """The digits of a reading from its first part on that has no letter, or has a mask sign: what leads is a model's name."""
    parts = F.split(raw, " ")
    leads = lambda t: C.let(C.trimmed(t), lambda x: x.rlike(r"\p{L}") & ~x.rlike(r"[%$*?@!&#|]"))
    first = F.array_position(F.transform(parts, lambda t: ~leads(t)), F.lit(True)).cast("int")
    return F.regexp_replace(F.array_join(F.slice(parts, F.greatest(first, F.lit(1)), F.size(parts)), " "), "[^0-9]", "")


def cleaned_candidate(field: Column, raw: Column) -> Column:
    """struct(value, is_valid) of a reading by the rules of its field."""
    day = F.regexp_extract(raw, r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b", 0)
    digits, bare = F.regexp_replace(raw, "[^0-9]", ""), C.trimmed(raw)
    made = lambda v, ok: F.struct(v.alias("value"), ok.alias("is_valid"))
    return (
        F.when(field == "IMEI 1", C.let(device_digits(raw), lambda d: made(d, F.length(d) == 15)))
        .when(field == "Postal Code", C.let(C.repaired_postcode(raw), lambda code: made(code, C.is_postcode(code))))
        .when(field.isin(*DATES), made(F.when(day != "", day).otherwise(raw), day != ""))
        .when(field == "Contact", made(digits, digits != ""))
        .when(field.isin(*NAMES), made(bare, bare.rlike(r"\p{L}")))
        .when(field.isin(*PLACES), made(bare, F.length(bare) >= 2))
        .otherwise(made(raw, F.length(raw) > 0))
    )


def vote(candidates: DataFrame, keys: list[str], value: str = "value", confidence: str = "confidence", seq: str = "run_seq", carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, value, votes, mean_confidence, accepted, carry): the commonest value, the first met of equals.

    carry: columns of its most confident reading, the first of equals. The mean is over positive confidences, else their maximum; a value is accepted from a mean of 55 or two votes on.
    """
    tally = candidates.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(seq).alias("_first"), F.avg(F.when(F.col(confidence) > 0, F.col(confidence))).alias("_mean"), F.max(confidence).alias("_max"), F.max_by(F.struct(F.lit(0).alias("_"), *carry), F.struct(F.col(confidence), -F.col(seq))).alias("_own"))
    best = tally.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("votes").desc(), "_first"))).where("_k = 1")
    mean = F.coalesce(C.rounded_cents(F.col("_mean")), F.col("_max"))
    return best.select(*keys, value, "votes", mean.alias("mean_confidence"), ((mean >= LEAST_MEAN) | (F.col("votes") >= LEAST_VOTES)).alias("accepted"), *[F.col(f"_own.{c}").alias(c) for c in carry])


def decide(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One decision per region of candidates (keys, field, raw_text, confidence, run_seq, maybe boxes): keys, field, decision,
    value, confidence, votes, and the raw_text (and boxes) of the most confident reading of the value."""
    own = tuple(c for c in ("raw_text", "boxes") if c in candidates.columns)
    made = candidates.withColumn("_c", cleaned_candidate(F.col("field"), F.col("raw_text"))).select("*", F.col("_c.value").alias("value"), F.col("_c.is_valid").alias("_ok"))
    asked = made.groupBy(*keys, "field").agg(F.count(F.when(F.col("raw_text") != "", 1)).alias("_seen"))
    won = vote(made.where("_ok and raw_text <> ''"), [*keys, "field"], carry=own).where("accepted")
    accepted = F.when(F.col("field") == "IMEI 1", "ACCEPTED_STRICT_IMEI").when(F.col("field") == "Postal Code", "ACCEPTED_POSTCODE").otherwise("ACCEPTED_CONSENSUS")
    decision = F.when(F.col("_seen") == 0, "NO_OCR_OUTPUT").when(F.col("votes").isNull(), "NO_SAFE_CORRECTION").otherwise(accepted)
    return asked.join(won, [*keys, "field"], "left").select(*keys, "field", decision.alias("decision"), "value", F.col("mean_confidence").alias("confidence"), "votes", *own)


def merge_decisions(fields: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Long fields with accepted values, texts and confidences put in place; others stay; decision is NOT_REQUIRED where none was asked."""
    new = decisions.select(*keys, "field", "decision", F.col("value").alias("_v"), F.col("confidence").alias("_c"), F.col("raw_text").alias("_r"))
    took = F.col("_v").isNotNull()
    joined = fields.join(new, [*keys, "field"], "left")
    return joined.withColumn("value", F.coalesce("_v", "value")).withColumn("raw_text", F.coalesce("_r", "raw_text")).withColumn("confidence", F.coalesce("_c", "confidence")).withColumn("needs_review", F.when(took, F.lit(False)).otherwise(F.col("needs_review"))).withColumn("decision", F.coalesce("decision", F.lit("NOT_REQUIRED"))).drop("_v", "_c", "_r")


def best_pass(tokens: DataFrame, keys: list[str], run: str = "run") -> DataFrame:
    """keys and the run with the highest mean confidence times its token count up to 100; the first of equals."""
    score = tokens.groupBy(*keys, run).agg((F.avg("confidence") * F.least(F.count("*"), F.lit(100))).alias("score"))
    return score.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), run)).alias("_best")).select(*keys, F.col(f"_best.{run}").alias(run), (-F.col("_best.s")).alias("score"))

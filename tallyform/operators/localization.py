"""Where the values of labelled fields lie: label hits, value boxes, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed

RECORD = ["image_id", "variant", "record_number"]


def label_aliases(spark: SparkSession) -> DataFrame:
    """(field, field_pos, alias): normalised spellings; about 150 rows whatever the corpus, so joins broadcast it."""
    values = sorted({(f, i, "".join(c for c in a if c.isascii() and c.isalnum())) for i, (f, names) in enumerate(fixed.LABELS.items()) for a in names})
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{f}', {i}, '{a}')" for f, i, a in values) + " AS t(field, field_pos, alias)")


def normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def label_matches(candidate: Column, field: Column, alias: Column) -> Column:
    """Equal, or one edit away from 4 letters on, or two edits from 9 on where the lengths differ by two; digits must agree."""
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    apart = F.abs(F.length(candidate) - F.length(alias))
    barred = ((field == "IMEI 1") & F.contains(candidate, F.lit("2"))) | ((field == "IMEI 2") & F.contains(candidate, F.lit("1")))
    one = (F.length(alias) >= 4) & (apart <= 1)
    near = F.when(one, F.levenshtein(candidate, alias, 1) >= 0).when((F.length(alias) >= 9) & (apart <= 2), F.levenshtein(candidate, alias, 2) >= 0).otherwise(False)
    return (candidate != "") & ~barred & ((candidate == alias) | ((digits(candidate) == digits(alias)) & near))


def box_of(words: Column) -> Column:
    """The box around an array of words; null without words."""
    low = lambda k: F.array_min(F.transform(words, lambda w: w[k]))
    high = lambda k, n: F.array_max(F.transform(words, lambda w: w[k] + w[n]))
    return F.when(F.size(words) > 0, F.struct(low("x").alias("x"), low("y").alias("y"), (high("x", "width") - low("x")).alias("width"), (high("y", "height") - low("y")).alias("height")))


def label_hits(rows: DataFrame) -> DataFrame:
    """(RECORD, row_seq, field, at, n, words, label_box, anchor): each field's first label of a row, widest first.

    rows: RECORD, row_seq, words. Candidates are the row's runs of 4 to 1 words; the distinct ones meet the broadcast
    aliases once.
    """
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.transform(F.filter(F.array(*map(F.lit, (4, 3, 2, 1))), lambda n: i + n - 1 <= F.size("words")), lambda n: F.struct(i.alias("at"), n.alias("n")))))
    each = rows.where("size(words) > 0").select(*RECORD, "row_seq", "words", F.explode(runs).alias("r")).select(*RECORD, "row_seq", F.col("r.at").alias("at"), F.col("r.n").alias("n"), F.slice("words", F.col("r.at"), F.col("r.n")).alias("chunk"))
    named = each.withColumn("candidate", normal(F.array_join(F.transform("chunk", lambda w: w["text"]), " ")))
    aliases = F.broadcast(label_aliases(rows.sparkSession))
    known = named.select("candidate").distinct().join(aliases, label_matches(F.col("candidate"), F.col("field"), F.col("alias"))).select("candidate", "field", "field_pos").distinct()
    hits = named.join(known, "candidate")
    first = F.row_number().over(Window.partitionBy(*RECORD, "row_seq", "field").orderBy("at", F.col("n").desc()))
    return hits.withColumn("k", first).where("k = 1").select(*RECORD, "row_seq", "field", "field_pos", "at", "n", box_of(F.col("chunk")).alias("label_box"), F.array_join(F.transform("chunk", lambda w: w["text"]), " ").alias("anchor"))


def field_regions(rows: DataFrame) -> DataFrame:
    """(RECORD, field, value_box, label_box, anchor, confidence, source): the first label of each field in reading order.

    The value is right of the label up to the row's next label (0.95), else below it (0.85), else estimated (0.60).
    """
    hits = label_hits(rows)
    next_at = Window.partitionBy(*RECORD, "row_seq").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    soon = hits.withColumn("next", F.min(F.struct("at", F.col("field_pos"), F.col("label_box.x").alias("x"))).over(next_at))
    own = rows.select(*RECORD, "row_seq", "words", F.lead("row_seq").over(Window.partitionBy(*RECORD).orderBy("row_seq")).alias("below_seq"), F.lead("words").over(Window.partitionBy(*RECORD).orderBy("row_seq")).alias("below"))
    seen = soon.join(own, [*RECORD, "row_seq"])
    box, right = F.col("label_box"), F.col("label_box.x") + F.col("label_box.width")
    after = F.col("at") + F.col("n")
    stop = F.coalesce(F.col("next.at"), F.size("words") + 1)
    beside = box_of(F.when(stop > after, F.slice("words", after, stop - after)).otherwise(F.slice("words", 1, 0)))
    low, high = F.greatest(F.lit(0), box["x"] - 25), F.coalesce(F.col("next.x"), right + 250)
    under = box_of(F.filter(F.coalesce("below", F.slice("words", 1, 0)), lambda w: w["x"].between(low, high)))
    wide = F.when(F.lower("field").rlike("imei|reference"), 180).otherwise(120)
    guess_right = F.least(F.coalesce(F.when(F.col("next.x") != 0, F.col("next.x")), right + wide), right + wide)
    guess = F.struct((right + 4).alias("x"), box["y"].alias("y"), F.greatest(F.lit(40), guess_right - right - 4).alias("width"), box["height"].alias("height"))
    region = F.when(beside.isNotNull(), F.struct(beside.alias("b"), F.lit(0.95).alias("c"), F.lit("label_right").alias("s"))).when(under.isNotNull(), F.struct(under.alias("b"), F.lit(0.85).alias("c"), F.lit("label_below").alias("s"))).otherwise(F.struct(guess.alias("b"), F.lit(0.6).alias("c"), F.lit("label_estimated_right").alias("s")))
    placed = seen.withColumn("region", region).withColumn("k", F.row_number().over(Window.partitionBy(*RECORD, "field").orderBy("row_seq", box["x"], "field_pos"))).where("k = 1")
    return placed.select(*RECORD, "field", F.col("region.b").alias("value_box"), "label_box", "anchor", F.col("region.c").alias("confidence"), F.col("region.s").alias("source"))


def with_token_spans(fields: DataFrame, regions: DataFrame) -> DataFrame:
    """Long fields (RECORD, field, coordinates) with their region: the label's, else the box around their tokens (0.70)."""
    own = box_of(F.col("coordinates"))
    joined = fields.join(regions, [*RECORD, "field"], "left")
    return joined.withColumn("source", F.coalesce("source", F.when(own.isNotNull(), "token_span"))).withColumn("anchor", F.coalesce("anchor", F.when(own.isNotNull(), ""))).withColumn("confidence_region", F.coalesce(regions["confidence"], F.when(own.isNotNull(), 0.7))).withColumn("value_box", F.coalesce("value_box", own)).withColumn("label_box", F.coalesce("label_box", own))

"""Quality rules: base counts of a text, then how far its histograms lie from those of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from .util import written

#: Character classes, each taken out of what the ones before left; letters beyond ASCII and the rest follow.
CLASSES = ("[a-z]+", "[A-Z]+", r"[\x20\x09-\x0D]+", "[0-9]+", r"[.,;:!?'\"()\-]+", r"[\x21-\x7E]+", r"\p{L}+")
#: The common words of a language: its most frequent ones over all its documents.
COMMON_WORDS = 32
#: Jensen-Shannon distances (square root, base 2) from which a text is unlike its language.
MOST_CLASS_DISTANCE = 0.30
MOST_WORD_DISTANCE = 0.42
#: A shorter text's histogram, or one of a language with fewer words in all, says too little to reject it.
LEAST_CHARS = 200
LEAST_WORDS = 80
LEAST_LANGUAGE_WORDS = 2_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three that the text holds twice or more; words is an array in a variable.

    Hashes tell most texts to have no such window; else windows are sorted by hash and words, so equal ones are
    neighbours, and the places that they cover are counted in one pass.
    """
    n = F.size(words) - 2
    parts = [F.slice(words, k, n) for k in (1, 2, 3)]
    same = lambda a, b: F.coalesce((a["0"] == b["0"]) & (a["1"] == b["1"]) & (a["2"] == b["2"]) & (a["3"] == b["3"]), F.lit(False))
    places = lambda z: F.sort_array(F.transform(F.filter(z, lambda x, i: same(x, F.get(z, i - 1)) | same(x, F.get(z, i + 1))), lambda x: x["4"]))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = lambda z: F.aggregate(places(z), none, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["upto"])).alias("n"), (p + 3).alias("upto")))["n"]
    ordered = lambda h: F.sort_array(F.arrays_zip(F.slice(h, 1, n), *parts, F.sequence(F.lit(0), n - 1)))
    counted = lambda h: F.when(F.size(F.array_distinct(h)) == n, 0).otherwise(let(ordered(h), covered))
    return F.when(n < 2, 0).otherwise(let(F.transform(F.arrays_zip(*parts), lambda x: F.xxhash64(x)), counted)).cast("long")


def common_counts(words: Column, common: Column, most: int) -> Column:
    """array<long>: how often each of the common words occurs, 0 up to ``most`` words, and last all other words.

    Each word becomes its place among the common ones, 0 for none; places are then taken out one after the other.
    """
    places = F.array_remove(F.transform(words, lambda w: F.array_position(common, w).cast("int")), 0)
    start = lambda p: F.struct(p.alias("left"), F.array().cast("array<bigint>").alias("counts"))
    cut = lambda a, left: F.struct(left.alias("left"), F.concat(a["counts"], F.array((F.size(a["left"]) - F.size(left)).cast("long"))).alias("counts"))
    each = F.sequence(F.lit(1), F.lit(most))
    counts = lambda p: F.aggregate(each, start(p), lambda a, k: let(F.array_remove(a["left"], k), lambda left: cut(a, left)), lambda a: F.concat(a["counts"], F.array((F.size(words) - F.size(p)).cast("long"))))
    return let(places, counts)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.coalesce(F.size(lines) - F.size(F.array_distinct(lines)), F.lit(0)).cast("long")


def class_counts(text: Column) -> Column:
    """array<long>: code points of each class, in order of CLASSES, then of no class."""

    def cut(left: Column, counts: list[Column], patterns: tuple[str, ...]) -> Column:
        if not patterns:
            return F.array(*counts, F.length(left).cast("long"))
        return let(F.regexp_replace(left, patterns[0], ""), lambda rest: cut(rest, [*counts, (F.length(left) - F.length(rest)).cast("long")], patterns[1:]))

    return let(F.coalesce(text, F.lit("")), lambda t: cut(t, [], CLASSES))


def js_distance(found: Column, expected: Column) -> Column:
    """Jensen-Shannon distance, 0 to 1, of two arrays of counts; null where one has none."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: F.transform(F.array(total(a)), lambda n: F.transform(a, lambda x: x / n))[0]
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    both = F.zip_with(share(found), share(expected), lambda p, q: (part(p, q) + part(q, p)) / 2)
    return F.when((total(found) > 0) & (total(expected) > 0), F.sqrt(F.greatest(total(both), F.lit(0.0))))


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON_WORDS) -> DataFrame:
    """(has_lang, lang, common, word_counts, class_counts, lang_words) from every document: one row per language.

    Documents without a language are one of their own. Words are counted as they stand, over all texts, before the
    most frequent are chosen, ties by code point; what isn't among them is the last bin.
    """
    key = [F.col(f"`{lang_col}`").isNotNull().alias("has_lang"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    counted, _ = written(docs.select(*key, F.explode(words_of(text)).alias("word")).groupBy("has_lang", "lang", "word").agg(F.count("*").alias("n")), "vocabulary")
    order = Window.partitionBy("has_lang", "lang").orderBy(F.col("n").desc(), "word")
    top = counted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= common).groupBy("has_lang", "lang").agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("top"))
    every = counted.groupBy("has_lang", "lang").agg(F.sum("n").alias("lang_words"))
    sums = docs.select(*key, class_counts(text).alias("c")).groupBy("has_lang", "lang").agg(F.array(*[F.sum(F.col("c")[i]) for i in range(len(CLASSES) + 1)]).alias("class_counts"))
    joined = sums.join(top, ["has_lang", "lang"], "left").join(every, ["has_lang", "lang"], "left")
    none = F.array().cast("array<struct<k:int,word:string,n:bigint>>")
    top_words = F.coalesce("top", none)
    seen = F.transform(top_words, lambda x: x["n"])
    words = F.coalesce("lang_words", F.lit(0))
    rest = words - F.aggregate(seen, F.lit(0).cast("long"), lambda s, x: s + x)
    fill = F.array_repeat(F.lit(0).cast("long"), F.lit(common) - F.size(seen))
    return joined.select("has_lang", "lang", F.transform(top_words, lambda x: x["word"]).alias("common"), F.concat(seen, fill, F.array(rest)).alias("word_counts"), "class_counts", words.alias("lang_words"))


def _stats(text: Column, words: Column, common: Column, most: int) -> Column:
    """All that is counted of a text, as one struct; text and words are variables, so each is worked out once."""
    return F.struct(
        F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        repeated_lines(text).alias("n_dup_lines"), repeated_words(words).alias("n_repeat_words"), class_counts(text).alias("classes"), common_counts(words, common, most).alias("found"),
    )


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON_WORDS) -> DataFrame:
    """One row per row of docs: ``row`` (all its columns as a struct), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, class_distance, word_distance, kept.

    A text fails the base rules with fewer than 50 words, or with more than half its words in windows of three that
    occur twice or more. Any other is dropped if its character classes, or its common words, lie too far from those of
    its language by Jensen-Shannon distance. Short texts and small languages are not judged by distance (LEAST_*), and
    a text can't fail by one that is null. Null and empty texts count 0 of everything and fail; a null language is a
    language of its own; repeated rows are judged alike; an empty table gives no rows.

    References are a table of one row per language, so no text is shuffled: the join is a broadcast while that table
    is small by its file size, which Spark checks.
    """
    reference, _ = written(language_references(docs, text_col, lang_col, common), "references")
    row, lang = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(f"row.`{lang_col}`")
    keyed = docs.select(row).select("row", lang.isNotNull().alias("has_lang"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang"))
    met = keyed.join(reference, ["has_lang", "lang"], "left")
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    stats = let(text, lambda t: let(words_of(t), lambda w: _stats(t, w, F.col("common"), common)))
    told = met.select("row", "class_counts", "word_counts", "lang_words", stats.alias("s")).select(
        "row", "lang_words", *[F.col(f"s.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes")],
        js_distance(F.col("s.classes"), F.col("class_counts")).alias("class_distance"), js_distance(F.col("s.found"), F.col("word_counts")).alias("word_distance"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x)
    large = F.col("lang_words") >= LEAST_LANGUAGE_WORDS
    odd_classes = large & (chars >= LEAST_CHARS) & (F.col("class_distance") > MOST_CLASS_DISTANCE)
    odd_words = large & (F.col("n_words") >= LEAST_WORDS) & (F.col("word_distance") > MOST_WORD_DISTANCE)
    kept = ~(F.col("base_failed") | F.coalesce(odd_classes, F.lit(False)) | F.coalesce(odd_words, F.lit(False)))
    return told.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", kept.alias("kept"))


def of_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, in their own columns."""
    return judged(docs, text_col, lang_col).where("kept").select("row.*")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    found = judged(docs, text_col, lang_col)
    return found.select(F.col(f"row.`{id_col}`").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_CUTS = ", ".join(f"regexp_replace(t{i}, '{p.replace(chr(39), chr(39) * 2)}', '', 'g') AS t{i + 1}" for i, p in enumerate(CLASSES))
_COUNTS = ", ".join([*(f"length(t{i}) - length(t{i + 1})" for i in range(len(CLASSES))), f"length(t{len(CLASSES)})"])
_DIVERGENCE = "sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2"

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, lang IS NOT NULL AS has_lang FROM documents),
w AS (SELECT r, lang, has_lang, unnest(x) AS w, unnest(range(len(x))) AS p FROM (SELECT r, lang, has_lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS x FROM d)),
n AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM w GROUP BY r),
three AS (SELECT r, p, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, w, w2, w3) AS c FROM three WHERE w3 IS NOT NULL) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY r),
dup AS (SELECT r, (count(*) - count(DISTINCT l))::BIGINT AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
vocabulary AS (SELECT has_lang, lang, w AS word, count(*) AS c FROM w GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY has_lang, lang ORDER BY c DESC, word) AS k FROM vocabulary) WHERE k <= {COMMON_WORDS}),
total AS (SELECT has_lang, lang, sum(c)::BIGINT AS lang_words FROM vocabulary GROUP BY ALL),
expected AS (SELECT has_lang, lang, k, c FROM top UNION ALL
             SELECT has_lang, lang, 0, lang_words - (SELECT sum(c) FROM top WHERE top.lang = total.lang AND top.has_lang = total.has_lang) FROM total),
found AS (SELECT r, coalesce(k, 0) AS k, count(*) AS c FROM w LEFT JOIN top ON top.word = w.w AND top.lang = w.lang AND top.has_lang = w.has_lang GROUP BY ALL),
wd AS (SELECT r, sqrt(greatest(0, {_DIVERGENCE})) AS word_distance FROM (
         SELECT d.r, coalesce(found.c, 0) / n_words::DOUBLE AS p, expected.c / lang_words::DOUBLE AS q
         FROM d JOIN n USING (r) JOIN expected USING (has_lang, lang) JOIN total USING (has_lang, lang) LEFT JOIN found ON found.r = d.r AND found.k = expected.k) GROUP BY r),
cut AS (SELECT r, has_lang, lang, [{_COUNTS}] AS c FROM (SELECT r, has_lang, lang, text AS t0, {_CUTS} FROM d)),
cls AS (SELECT r, has_lang, lang, unnest(c) AS c, unnest(range(len(c))) AS k, list_sum(c) AS chars FROM cut),
ref AS (SELECT has_lang, lang, k, sum(c) AS c FROM cls GROUP BY ALL),
cd AS (SELECT r, any_value(chars) AS chars, sqrt(greatest(0, {_DIVERGENCE})) AS class_distance FROM (
         SELECT cls.r, cls.chars, cls.c / cls.chars::DOUBLE AS p, ref.c / sum(ref.c) OVER (PARTITION BY cls.r)::DOUBLE AS q FROM cls JOIN ref USING (has_lang, lang, k) WHERE chars > 0) GROUP BY r),
f AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_words, 0) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) AS base_failed,
        coalesce(lang_words >= {LEAST_LANGUAGE_WORDS} AND (chars >= {LEAST_CHARS} AND class_distance > {MOST_CLASS_DISTANCE} OR n_words >= {LEAST_WORDS} AND word_distance > {MOST_WORD_DISTANCE}), false) AS odd
      FROM d LEFT JOIN n USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN wd USING (r) LEFT JOIN cd USING (r) LEFT JOIN total USING (has_lang, lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR odd) AS kept FROM f
"""

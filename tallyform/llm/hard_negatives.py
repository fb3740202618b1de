"""Hard negatives: rows of another label that score just below an anchor's positives."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import written

#: Rows and anchors of a block of products.
ROWS, ANCHORS = 4096, 512
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of its positive's.
LEAST_SHARE, MOST_SHARE = 50, 95
#: Scores are 64-bit integers; what lies beyond counts as their end.
END = 2**63 - 1

FOUND = "key binary, same boolean"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def pack(anchor: int, anchor_id: int, score: int, row_id: int, row: int) -> bytes:
    """A key whose bytes sort by (anchor, score falling, id, row): each part as a shifted unsigned integer."""
    return struct.pack(">5Q", anchor, anchor_id + END + 1, END - score, row_id + END + 1, row)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    """(anchor, anchor_id, score, row_id)."""
    anchor, anchor_id, score, row_id, _ = struct.unpack(">5Q", key)
    return anchor, anchor_id - END - 1, END - score, row_id - END - 1


def window(positive: int) -> tuple[int, int]:
    """Lowest and highest integer score s with 50 * positive <= 100 * s <= 95 * positive."""
    return -(-LEAST_SHARE * positive // 100), MOST_SHARE * positive // 100


def _scores(anchors, rows):
    """Exact integer inner products of floor(256 * x), clipped to 64 bits."""
    import numpy as np

    a, b = (np.stack([np.asarray(v, dtype=np.float64) for v in x]) for x in (anchors, rows))
    with np.errstate(over="ignore"):
        qa, qb = np.floor(a * 256), np.floor(b * 256)
    if np.abs(qa).max(initial=0) * np.abs(qb).max(initial=0) * max(1, a.shape[1]) < 2.0**52:
        return (qa @ qb.T).astype(np.int64)  # every sum is an integer below 2^53: doubles are exact
    whole = lambda m: np.array([[math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in r] for r in m.tolist()], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -END, END).astype(np.int64)


def _tile(anchors: pd.DataFrame, rows: pd.DataFrame):
    """Scores of a block, rows in order of (id, row), and masks of same and unlike labels; an anchor doesn't meet itself."""
    import numpy as np

    rows = rows.sort_values(["vec_id", "row"])
    s = _scores(anchors["v"], rows["v"])
    same = anchors["label"].to_numpy()[:, None] == rows["label"].to_numpy()[None, :]
    itself = anchors["row"].to_numpy()[:, None] == rows["row"].to_numpy()[None, :]
    return np, rows, s, same & ~itself, ~same


def _first(np, s, mask, k: int):
    """Columns of the k highest scores under the mask, lower columns first of equals."""
    at = np.flatnonzero(mask)
    if len(at) > 4 * k:
        at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
    return at[np.argsort(-s[at], kind="stable")[:k]]


def _positives(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Of a block: the scores of each anchor's first rows of the same label (others can't be among its first of all)."""
    out = []
    if len(anchors) and len(rows):
        np, rows, s, same, _ = _tile(anchors, rows)
        for k, row in enumerate(anchors["row"]):
            out += [(row, int(s[k, c])) for c in _first(np, s[k], same[k], POSITIVES)]
    return pd.DataFrame(out, columns=["row", "score"])


def _candidates(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Of a block: the packed keys of the rows that the anchor's stream needs: its first of the same label, and for each
    positive score the first others within its window (a later one of this block can't be among the window's first)."""
    out = []
    if len(anchors) and len(rows):
        np, rows, s, same, unlike = _tile(anchors, rows)
        ids, places = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
        for k, (row, anchor_id, positives) in enumerate(zip(anchors["row"], anchors["vec_id"], anchors["positives"], strict=True)):
            key = lambda c: pack(int(row), int(anchor_id), int(s[k, c]), int(ids[c]), int(places[c]))  # noqa: B023, E731
            out += [(key(c), True) for c in _first(np, s[k], same[k], POSITIVES)]
            picked = set()
            for p in {int(p) for p in positives}:
                low, high = window(p)
                if low <= high:
                    picked.update(_first(np, s[k], unlike[k] & (s[k] >= low) & (s[k] <= high), NEGATIVES).tolist())
            out += [(key(c), False) for c in sorted(picked)]
    return pd.DataFrame(out, columns=["key", "same"])


def mine(stream: Iterator[tuple[bytes, bool]]) -> Iterator[tuple]:
    """RESULT rows from keys in order: one pass, holding an anchor's open windows and never its rows.

    A positive opens its window; as scores fall, each other row goes to every window it lies in, until a window has its
    negatives. Windows lie below their positive, but for a score of 0, whose window is 0 itself: others of score 0
    may come before the positive by id, so the first few of them are held.
    """
    anchor, opened, zeros, n_same = None, [], [], 0
    for key, same in stream:
        at, anchor_id, score, row_id = unpack(key)
        if at != anchor:
            anchor, opened, zeros, n_same = at, [], [], 0
        if same:
            n_same += 1
            if n_same <= POSITIVES:
                low, high = window(score)
                opened.append([low, high, row_id, score, 0])
                for negative in zeros if score == 0 else ():
                    opened[-1][4] += 1
                    yield anchor_id, row_id, opened[-1][4], negative, score, 0
        else:
            if score == 0 and len(zeros) < NEGATIVES:
                zeros.append(row_id)
            for one in opened:
                if one[0] <= score <= one[1] and one[4] < NEGATIVES:
                    one[4] += 1
                    yield anchor_id, one[2], one[4], row_id, one[3], score


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block_rows: int = ROWS, block_anchors: int = ANCHORS) -> DataFrame:
    """RESULT: for each anchor and each of its first positives, the first hard negatives.

    Scores are inner products of floor(256 * x); higher come first, ties by smaller id. Rows with a null id, label or
    vector, or with a null or non-finite component, take no part; vectors of unlike length don't meet; rows of equal id
    are rows of their own, and an anchor meets all but itself. A score beyond 64 bits counts as their end. Empty vectors
    score 0. Anchors without positives, positives without negatives, and an empty table give no rows.

    Anchors meet all rows in blocks of bounded size, twice: first for the scores of each anchor's positives, then for
    what its stream needs of each block, a few packed keys. The keys are sorted within partitions by anchor, falling
    score and id in one secondary-sort shuffle, and an iterator mines them as they come.
    """
    spark, parts = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(f"`{vec_col}`").cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: F.coalesce((F.abs(x) < F.lit(math.inf)) & ~F.isnan(x), F.lit(False))), F.lit(False))
    told = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound)
    made, path = written(told.withColumn("row", F.monotonically_increasing_id()), "vectors", 4096)
    sizes = made.agg(F.count("*"), F.count_if("is_anchor")).first()
    n_rows, n_anchors = max(1, -(-sizes[0] // block_rows)), max(1, -(-sizes[1] // block_anchors))
    draw = F.xxhash64("row")
    dim = F.size("v").alias("dim")
    right = made.select("vec_id", "row", "label", "v", dim, F.pmod(draw, F.lit(n_rows)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))).alias("j"))

    def left(extra: DataFrame | None = None) -> DataFrame:
        own = spark.read.schema(made.schema).parquet(path).where("is_anchor")
        own = own if extra is None else own.join(extra, "row")
        return own.select("vec_id", "row", "label", "v", *([] if extra is None else ["positives"]), dim, F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("i"), F.pmod(draw, F.lit(n_anchors)).cast("int").alias("j"))

    def meet(own: DataFrame, each, schema: str) -> DataFrame:
        tile = ["dim", "i", "j"]
        return own.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(each, schema)

    falling = Window.partitionBy("row").orderBy(F.col("score").desc())
    first = meet(left(), _positives, "row long, score long").withColumn("k", F.row_number().over(falling)).where(F.col("k") <= POSITIVES)
    positives, _ = written(first.groupBy("row").agg(F.collect_set("score").alias("positives")), "positives")
    keys, _ = written(meet(left(positives), _candidates, FOUND), "keys", 4096)
    ordered = keys.rdd.map(lambda r: (bytes(r[0]), r[1])).repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(ordered.mapPartitions(mine), RESULT)


_SCORE = "list_inner_product(list_transform({0}.embedding, lambda x: floor(256 * x::DOUBLE)), list_transform({1}.embedding, lambda x: floor(256 * x::DOUBLE)))::BIGINT"

NEGATIVES_SQL = f"""
WITH r AS (SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, {_SCORE.format('a', 'b')} AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= {POSITIVES})
SELECT * FROM (
  SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LEAST_SHARE} * positive_score <= 100 * score AND 100 * score <= {MOST_SHARE} * positive_score) WHERE rank <= {NEGATIVES}
"""

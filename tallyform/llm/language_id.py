"""Language ID: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL-proximal, calibrated by a temperature."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import small_batches

#: Hashed n-gram features, and the lengths of n-grams.
FEATURES, ORDERS = 1 << 15, (1, 2, 3)
#: Labelled rows that the classifier is fitted on at most: of each language, and about so many of all (one of each language at least).
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 800, 200_000
#: Characters that are hashed at once.
SPAN = 1 << 18
UNDETERMINED = "und"


def ngrams(text: str, features: int = FEATURES) -> Iterator:
    """Arrays of hashed n-gram features of the lower-cased text between spaces, span by span: every n-gram once."""
    import numpy as np

    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint32)
    longest = max(ORDERS)
    for k in range(0, len(codes), SPAN):
        span = codes[k : k + SPAN + longest - 1]
        for n in ORDERS:
            count = min(SPAN, len(codes) - k, len(span) - n + 1)
            if count <= 0:
                continue
            h = np.full(count, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
            for i in range(n):
                h = (h ^ span[i : i + count]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(13)
            yield h & np.uint32(features - 1)


def counts_of(text: str, features: int = FEATURES):
    import numpy as np

    total = np.zeros(features, dtype=np.int64)
    for h in ngrams(text, features):
        total += np.bincount(h, minlength=features)
    return total


@dataclass
class Model:
    """languages; weights (features x languages) with the IDF multiplied in; bias; temperature."""

    languages: list[str]
    weights: object = None
    bias: object = None
    temperature: float = 1.0

    def logits(self, text: str):
        import numpy as np

        total, n = np.zeros(len(self.languages)), 0
        for h in ngrams(text, len(self.weights)):
            total += self.weights[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        import numpy as np

        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def train(rows: list[tuple[str, object, object]], languages: list[str], idf, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> Model:
    """FTRL-proximal with elastic net over rows of (language, feature ids, relative counts); every fifth row calibrates.

    The gradient of a row is (p - y) x its TF-IDF scaled to unit length, so the learned weights apply to the same
    scaled vector; the scale is folded back by predicting on relative counts times SCALE.
    """
    import numpy as np

    c = len(languages)
    z, n = np.zeros((len(idf) + 1, c)), np.zeros((len(idf) + 1, c))
    at = {x: i for i, x in enumerate(languages)}
    made = [(at[lang], np.append(ids, len(idf)), np.append(tf * idf[ids] * SCALE, 1.0)) for lang, ids, tf in rows]
    fit, held = [r for i, r in enumerate(made) if i % 5], made[::5]
    rng = np.random.default_rng(11)

    def weights(ids):
        zi, ni = z[ids], n[ids]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            y, ids, x = fit[i]
            w = weights(ids)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
            z[ids] += g - sigma * w
            n[ids] += g * g
    w = weights(np.arange(len(idf) + 1))
    scores = np.array([x @ w[ids] for _, ids, x in held]) if held else np.zeros((0, c))
    labels = np.array([y for y, _, _ in held], dtype=int)

    def loss(log_t: float) -> float:
        s = scores / math.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]).mean())

    low, high = math.log(0.05), math.log(20.0)
    for _ in range(60 if len(scores) else 0):
        a, b = low + 0.382 * (high - low), low + 0.618 * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return Model(languages, (w[:-1] * idf[:, None] * SCALE).astype(np.float32), w[-1], math.exp((low + high) / 2) if len(scores) else 1.0)


#: Relative counts are small; this brings a row's TF-IDF to about unit length.
SCALE = 20.0


def fit(docs: DataFrame, features: int = FEATURES, per_language: int = SAMPLE_PER_LANGUAGE, most_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from text and non-null lang of rows whose crc32(doc_id) mod 3 isn't 1.

    Document frequencies count every such row: each task adds its rows up to one count per feature. The rows fitted on
    are about ``per_language`` of each language, fewer where all would be more than about ``most_rows``, by hash of the id;
    no language is left out. Executors send their feature counts, not their texts. Without rows nothing is learned and everything is undetermined.
    """
    import numpy as np

    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text is not null").where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0)) != 1)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return Model([])
    n_rows = sum(r["n"] for r in sizes)
    per_language = max(1, min(per_language, most_rows // len(sizes)))
    share = spark.createDataFrame([(r["lang"], min(1.0, per_language / r["n"])) for r in sizes], "lang string, share double")
    drawn = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(features, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                seen = np.zeros(features, dtype=bool)
                for h in ngrams(text, features):
                    seen[h] = True
                total += seen
        some = np.flatnonzero(total)
        yield pd.DataFrame({"feature": some, "n": total[some]})

    def features_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [counts_of(t, features) for t in batch["text"]]
            ids = [np.flatnonzero(x) for x in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "ids": ids, "tf": [(x[i] / max(1, x.sum())).astype(np.float32) for x, i in zip(found, ids, strict=True)]})

    df = np.zeros(features)
    for r in known.select("text").mapInPandas(frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r["feature"]] = r["n"]
    idf = np.log((1 + n_rows) / (1 + df)) + 1
    rows = drawn.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text").mapInPandas(features_of, "doc_id string, lang string, ids array<int>, tf array<float>").toPandas()
    order = sorted(range(len(rows)), key=lambda i: (rows["doc_id"][i] or "", rows["lang"][i]))
    languages = sorted(set(rows["lang"]))
    return train([(rows["lang"][i], np.asarray(rows["ids"][i]), np.asarray(rows["tf"][i], dtype=float)) for i in order], languages, idf)


def language_id(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Whole texts are read. A text that is null or has no letter is ``und`` with score 0; a null id is not held out.
    Predictions read nothing but the text; repeated rows get the same one. Without labelled rows all are ``und``.
    """
    model = fit(docs.select("doc_id", "lang", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x languages at most, whatever the corpus

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), predict(F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")

"""Toxicity: a weighted lexicon learned from labels, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import small_batches

#: Labelled rows of each class that the lexicon is learned from, by hash of the id; all where there are fewer.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2500, 5000
LONGEST_STEM, SHORTEST_STEM = 12, 3

# Characters read as the Latin letters that they imitate.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ɡ": "g",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
#: Soft hyphen, zero-width characters and byte-order mark.
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _folding() -> dict[int, str | None]:
    import unicodedata

    wide = {c: unicodedata.normalize("NFKC", chr(c)).lower() for c in range(0xFF01, 0xFF5F)}
    return wide | {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(c): None for c in UNSEEN}


class Folder:
    """Words of folded text: lower case, look-alikes and wide forms as Latin letters, digits inside words as letters."""

    def __init__(self):
        import regex

        self.glyphs = _folding()
        self.word = regex.compile(r"[\p{L}\p{M}\p{N}]+")
        self.leet = str.maketrans(DIGITS)
        self.any_leet = regex.compile(r"(?:(?<=\p{L})[0134578@$!|]+(?=\p{L}))|(?:(?<!\S)[0134578@$]+(?=\p{L}))|(?:(?<=\p{L})[013457@$]+(?![\S]))")

    def words(self, text: str) -> list[str]:
        text = text.lower().translate(self.glyphs)
        text = self.any_leet.sub(lambda m: m[0].translate(self.leet), text)
        return self.word.findall(text)


@dataclass
class Lexicon:
    """stems: word start -> weight; exceptions: two-word phrases that cancel the matches inside; slope and bias of the score."""

    stems: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 0.0
    bias: float = -4.0


def unlike(examples: list, bands: int = 3, rows: int = 4) -> list:
    """examples without those whose words agree with an earlier one's in a MinHash band: copies are no evidence of their own."""
    import zlib

    import numpy as np

    mix = np.random.default_rng(7).integers(1, 1 << 32, size=(2, bands * rows), dtype=np.uint64)
    seen: set[tuple] = set()
    kept = []
    for e in examples:
        if e[0]:
            h = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in e[0]), dtype=np.uint64, count=len(e[0]))
            low = ((h[:, None] * (mix[0] | np.uint64(1))[None, :] + mix[1][None, :]) & np.uint64(0xFFFFFFFF)).min(axis=0)
            own = {(e[1], b, *low[b * rows : (b + 1) * rows].tolist()) for b in range(bands)}
            if own & seen:
                continue
            seen |= own
        kept.append(e)
    return kept


def evidence(toxic: int, clean: int, share: float) -> float:
    """Log-likelihood ratio of a stem's rows against the share of toxic rows; 0 if it isn't above that share."""
    n = toxic + clean
    p = toxic / n if n else 0.0
    if p <= share:
        return 0.0
    return toxic * math.log(p / share) + (clean * math.log((1 - p) / (1 - share)) if clean else 0.0)


def learn(examples: list[tuple[list[str], int]], longest: int = LONGEST_STEM) -> Lexicon:
    """A lexicon from (distinct words, label) of labelled rows.

    Of near copies one counts. Stems are taken one by one: the one with most evidence, of equals the longest, among the words that no earlier stem
    matches, while the evidence is too large for chance among all stems of the toxic rows.
    """
    examples = unlike(examples)
    toxic = [e for e in examples if e[1]]
    clean = [e for e in examples if not e[1]]
    if not toxic or not clean:
        return Lexicon()
    share = len(toxic) / len(examples)

    def stems_of(words) -> set[str]:
        return {w[:k] for w in words for k in range(SHORTEST_STEM, min(longest, len(w)) + 1)}

    df = Counter()
    for e in toxic:
        df.update(stems_of(e[0]))
    enough = math.log(len(df) + 1) + 3
    cands = {s for s, n in df.items() if n >= 3 and evidence(n, 0, share) > enough}
    off = Counter()
    for e in clean:
        off.update(stems_of(e[0]) & cands)
    cands = {s for s in cands if evidence(df[s], off[s], share) > enough and off[s] * len(toxic) <= 0.1 * df[s] * len(clean)}
    held = [([w for w in e[0] if not cands.isdisjoint(stems_of([w]))], e[1]) for e in examples]
    held = [x for x in held if x[0]]
    weights: dict[str, float] = {}
    while held:
        count = {0: Counter(), 1: Counter()}
        for words, label in held:
            count[label].update(stems_of(words) & cands)
        best = max(count[1], key=lambda s: (evidence(count[1][s], count[0][s], share), len(s), s), default=None)
        if best is None or evidence(count[1][best], count[0][best], share) <= enough:
            break
        weights[best] = math.log((count[1][best] + 0.5) / (len(toxic) + 1)) - math.log((count[0][best] + 0.5) / (len(clean) + 1))
        held = [(rest, label) for words, label in held if (rest := [w for w in words if not w.startswith(best)])]
    return Lexicon(weights)


def exceptions(phrases: list[tuple[set[str], int]], least: int = 5) -> list[str]:
    """Two-word phrases around matches that stand in ``least`` clean rows and in no toxic one."""
    good = Counter(p for found, label in phrases if not label for p in found)
    bad = Counter(p for found, label in phrases if label for p in found)
    return sorted(p for p, n in good.items() if n >= least and not bad[p])


class Matcher:
    """Aho-Corasick over words joined by spaces; scores are normalised by the logarithm of the length."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.folder = lexicon, Folder()
        self.machine = ahocorasick.Automaton()
        for stem, weight in lexicon.stems.items():
            self.machine.add_word(f" {stem}", (len(stem) + 1, weight))
        for phrase in lexicon.exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(self.machine):
            self.machine.make_automaton()

    def raw(self, words: list[str]) -> float:
        """Sum of the weights of matches outside exception phrases, by the length."""
        if not len(self.machine) or not words:
            return 0.0
        found, spared = [], []
        for end, (size, weight) in self.machine.iter(f" {' '.join(words)} "):
            (spared if weight is None else found).append((end - size + 1, end, weight))
        if spared:
            found = [x for x in found if not any(a <= x[0] and x[1] <= z for a, z, _ in spared)]
        return sum(x[2] for x in found) / (1 + math.log1p(len(words)) / 10)

    def score(self, text: str | None) -> float:
        x = self.lexicon.slope * self.raw(self.folder.words(text or "")) + self.lexicon.bias
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def calibrate(lexicon: Lexicon, examples: list[tuple[list[str], int]], share: float) -> Lexicon:
    """Logistic slope and bias of the normalised sum by Newton steps with a ridge; clean rows weigh as in the corpus."""
    import numpy as np

    matcher = Matcher(Lexicon(lexicon.stems, lexicon.exceptions))
    x = np.array([matcher.raw(w) for w, _ in examples])
    y = np.array([t for _, t in examples], dtype=float)
    if not len(y) or y.min() == y.max():
        return lexicon
    own = y.mean()
    weight = np.where(y > 0, share / own, (1 - share) / (1 - own))
    a = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (weight * (y - p)) - 0.01 * beta
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    lexicon.slope, lexicon.bias = max(0.0, float(beta[0])), float(beta[1])
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN) -> Lexicon:
    """The lexicon from a bounded sample of labelled rows whose crc32(id) mod 5 isn't 0.

    The ids (n_toxic and n_clean at most, by hash) are drawn from the label table alone and broadcast: a bound, not a
    guess. Executors send the sampled texts' folded words. Null labels, texts and ids are left
    out; without both labels nothing is learned and every score is low.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id is not null and toxic in (0, 1)").where(F.crc32(F.col("label_id").cast("string")) % 5 != 0)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("label_id"), F.col("label_id")]
    drawn = known.where("toxic = 1").orderBy(*order).limit(n_toxic).union(known.where("toxic = 0").orderBy(*order).limit(n_clean))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(F.broadcast(drawn), texts.doc_id == drawn.label_id).where("text is not null").select("text", "toxic")

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = Folder()
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "text": [" ".join(folder.words(t)) for t in batch["text"]]})

    got = sorted(((r["toxic"], r["text"]) for r in rows.mapInPandas(folded, "toxic int, text string").toLocalIterator()), reverse=True)
    said = []  # rows of interned words: each distinct word is held once
    while got:
        label, text = got.pop()
        said.append(([sys.intern(w) for w in text.split(" ") if w], label))
    lexicon = learn([(list(dict.fromkeys(w)), label) for w, label in said])
    if lexicon.stems:
        lead = tuple(lexicon.stems)
        phrases = []
        for w, label in said:
            at = [i for i, x in enumerate(w) if x.startswith(lead)]
            phrases.append({" ".join(w[a : a + 2]) for i in at for a in (i - 1, i) if a >= 0 and len(w[a : a + 2]) == 2})
        lexicon.exceptions = exceptions([(p, label) for p, (_, label) in zip(phrases, said, strict=True)])
    total = sum(counts.values())
    return calibrate(lexicon, said, counts.get(1, 0) / total if total else 0.0)


def score_udf(lexicon: Lexicon):
    held: list[Matcher] = []

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Matcher(lexicon))
        return pd.Series([held[0].score(t) for t in texts], dtype="float64")

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    The score is of the whole text alone; null and empty texts get the lexicon's bias. held_out marks ids whose crc32
    mod 5 is 0, which are never learned from; a null id is not held out. Repeated rows score alike.
    """
    lexicon = fit(docs, labels, id_col, text_col)
    scored = docs.select(F.col(f"`{id_col}`").alias("doc_id"), score_udf(lexicon)(F.col(f"`{text_col}`")).alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs whose score stays below 0.5, in their own columns."""
    lexicon = fit(docs, labels, id_col, text_col)
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return row.where(score_udf(lexicon)(F.col(f"row.`{text_col}`")) < 0.5).select("row.*")

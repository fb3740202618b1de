"""Hard negatives, quality rules and the Merkle manifest on small tables: brute force and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyform.llm import hard_negatives, merkle, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, row int, at long, n long"
ODD = [
    (1, "one\ntwo\n", "en", "s", 5, "x", 1, 2, 3), (3, None, None, None, None, None, None, None, None), (4, "", "en", None, 0, "x", 1, 2, 3),
    (None, "no id\n", None, "t", 5, "x", 1, 2, 3), (2, "same\n\n", "en", "s", 5, "x", 1, 2, 3), (2, "same\n\n", "en", "s", 5, "x", 1, 2, 3),
    (2, "other", "en", "s", 5, "x", 1, 2, 3), (7, "word " * 30_000 + "end", "en", "s", 1, "x", 1, 2, 3), (8, " \t\n ", "en", "", 1, "x", 1, 2, 3),
    (9, "é　x  y\r\n\n z", "en", "ß", 1, "x", 1, 2, 3),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


# hard negatives


def mined(rows, anchors):
    """Brute force of (id, label, vector) rows."""
    sound = [r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[2])]
    score = lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=True))
    out = []
    for k, a in enumerate(sound):
        if not anchors(a[0]):
            continue
        others = sorted((-score(a[2], b[2]), b[0], b[1]) for j, b in enumerate(sound) if j != k and len(b[2]) == len(a[2]))
        for p, positive, _ in [x for x in others if x[2] == a[1]][:5]:
            hits = [(i, -s) for s, i, label in others if label != a[1] and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a[0], positive, n + 1, i, -p, s) for n, (i, s) in enumerate(hits[:3])]
    return Counter(out)


def vectors(n, dim, seed, labels=3):
    draw = random.Random(seed)
    return [(k, draw.randrange(labels), [draw.uniform(-1, 1) for _ in range(dim)]) for k in range(n)]


@pytest.mark.parametrize("blocks", [(4096, 512), (16, 3)])
def test_hard_negatives_are_those_of_brute_force(spark, blocks):
    rows = vectors(120, 4, 1) + [(200 + k, k % 2, [0.5, 0.5, 0.25, -0.25]) for k in range(40)]  # a large group of equal vectors
    rows += [(300, 1, [0.0] * 4), (301, 0, [0.0] * 4), (302, 1, [0.0] * 4), (303, 0, [0.0] * 4), (299, 0, [0.0] * 4)]  # scores of zero
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, key string, row int")
    got = hard_negatives.hard_negatives(table, F.col("vec_id") % 5 == 0, block_rows=blocks[0], block_anchors=blocks[1])
    stored = [(r["vec_id"], r["label"], r["embedding"]) for r in table.collect()]
    assert Counter(map(tuple, got.collect())) == mined(stored, lambda i: i % 5 == 0)


def test_hard_negatives_of_odd_rows(spark):
    rows = vectors(30, 3, 2) + [(50, None, [1.0, 0.0, 0.0]), (None, 1, [1.0, 0.0, 0.0]), (55, 1, None), (60, 1, [1.0, None, 0.0]), (65, 1, [1.0, math.nan, 0.0]), (70, 1, [math.inf, 0.0, 0.0])]
    rows += [(75, 1, []), (80, 0, []), (85, 1, [0.5, 0.25]), (90, 1, [0.5, 0.5]), (91, 0, [0.5, 0.0]), (0, 2, [0.3, 0.2, 0.1])]  # unlike lengths, a repeated id
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.hard_negatives(table, F.col("vec_id") % 5 == 0).collect()
    assert Counter(map(tuple, got)) == mined(rows, lambda i: i % 5 == 0)
    assert hard_negatives.hard_negatives(table.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.hard_negatives(table, F.lit(False)).count() == 0


def test_huge_components_are_clipped_not_wrapped(spark):
    rows = [(0, 1, [1e200, 1.0]), (1, 1, [1e200, 0.0]), (2, 0, [0.0, 1e10]), (3, 0, [-1e300, 0.0]), (4, 0, [1e-190, 0.0])]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert all(abs(r["positive_score"]) <= 2**63 - 1 for r in got)


def test_keys_sort_by_anchor_falling_score_and_id():
    draw = random.Random(3)
    parts = [(draw.randrange(3), 7, draw.randrange(-(2**62), 2**62), draw.randrange(-9, 9), k) for k in range(200)]
    assert [hard_negatives.unpack(k) for k in sorted(hard_negatives.pack(*p) for p in parts)] == [(a, b, c, d) for a, b, c, d, _ in sorted(parts, key=lambda p: (p[0], -p[2], p[3], p[4]))]


# quality rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def distance(p, q):
    p, q = ([x / sum(v) for x in v] for v in (p, q))
    return math.sqrt(max(0.0, sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q, strict=True)) / 2))


def histograms(rows):
    """Brute force: class counts of each text, and each language's references."""
    cuts = [re.compile(p.replace(r"\p{L}+", r"[^\W\d_]+")) for p in quality_rules.CLASSES]

    def classes(text):
        out = []
        for cut in cuts:
            rest = cut.sub("", text)
            out.append(len(text) - len(rest))
            text = rest
        return [*out, len(text)]

    of = {}
    for _, text, lang, *_ in rows:
        one = of.setdefault(lang, (Counter(), [0] * (len(cuts) + 1)))
        one[0].update(w for w in WORD.findall(text or ""))
        one[1][:] = [a + b for a, b in zip(one[1], classes(text or ""), strict=True)]
    return classes, of


def prose(draw, n, words):
    return " ".join(draw.choice(words) for _ in range(n))


def test_base_counts(odd):
    got = quality_rules.quality_rules(odd).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == Counter((r[0], *base(r[1])) for r in ODD)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_base_counts_of_random_texts(spark):
    draw = random.Random(5)
    rows = [(k, "".join(draw.choice(["a", "b", "c", " ", " ", "\n", "\t", "é", "|", "#<", "　"]) for _ in range(draw.randrange(120))), "en", "s", 1, "x", 1, 1, 1) for k in range(300)]
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {r[0]: base(r[1]) for r in rows}


def test_verdicts_are_those_of_brute_force(spark):
    draw = random.Random(6)
    common = ["the", "of", "and", "to", "in", "is"]
    rare = ["".join(draw.choice("abcdefghijklm") for _ in range(5)) for _ in range(3000)]
    rows = [(k, prose(draw, 150, common * 80 + rare[:600]), "en", "s", 1, "x", 1, 1, 1) for k in range(40)]
    rows += [(100 + k, prose(draw, 150, rare), "en", "s", 1, "x", 1, 1, 1) for k in range(5)]  # none of the common words
    rows += [(200 + k, prose(draw, 150, common * 80 + rare[:600]).upper().replace(" ", "!!## "), "en", "s", 1, "x", 1, 1, 1) for k in range(5)]
    rows += [(300, prose(draw, 60, rare), "en", "s", 1, "x", 1, 1, 1), (301, prose(draw, 90, rare), "xx", "s", 1, "x", 1, 1, 1), (302, prose(draw, 150, rare), None, "s", 1, "x", 1, 1, 1)]
    classes, of = histograms(rows)
    found = {r["row"]["doc_id"]: r for r in quality_rules.judged(spark.createDataFrame(rows, DOCS)).collect()}
    for doc, text, lang, *_ in rows:
        words, sums = of[lang]
        top = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.COMMON_WORDS]]
        own = Counter(w for w in WORD.findall(text))
        p = [own[w] for w in top] + [sum(own.values()) - sum(own[w] for w in top)]
        q = [words[w] for w in top] + [sum(words.values()) - sum(words[w] for w in top)]
        r = found[doc]
        assert r["class_distance"] == pytest.approx(distance(classes(text), sums), abs=1e-9) and r["word_distance"] == pytest.approx(distance(p, q), abs=1e-9)
        large = sum(words.values()) >= quality_rules.LEAST_LANGUAGE_WORDS
        odd = large and (len(text) >= quality_rules.LEAST_CHARS and r["class_distance"] > quality_rules.MOST_CLASS_DISTANCE or sum(own.values()) >= quality_rules.LEAST_WORDS and r["word_distance"] > quality_rules.MOST_WORD_DISTANCE)
        assert r["kept"] == (not base(text)[5] and not odd)
    kept = {d for d, r in found.items() if r["kept"]}
    assert kept >= set(range(40)) | {300, 301, 302} and not kept & {*range(100, 105), *range(200, 205)}
    assert quality_rules.of_quality(spark.createDataFrame(rows, DOCS)).columns == [c.split()[0] for c in DOCS.split(", ")]


def test_quality_of_an_empty_table(empty):
    assert quality_rules.quality_rules(empty).count() == 0


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def climb(nodes):
    """All levels over the nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, at):
    for nodes in levels[:-1]:
        first = at - at % 3
        yield "".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])
        at //= 3


def manifest(rows):
    """Brute force: rows of the whole tree rebuilt for each tampered leaf alone."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in sources}
    trees = {s: climb([leaf(r, r[1]) for r in of[s]]) for s in sources}
    top = climb([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, r in enumerate(of[s]):
            sides = [*way(trees[s], at), *way(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            new = leaf(r, r[1].replace("\n", "") if hit and r[1] is not None else r[1])
            changed = climb([new if j == at else x for j, x in enumerate(trees[s][0])])[-1][0]
            folded = climb([changed if j == k else x for j, x in enumerate(top[0])])[-1][0]
            out.append((r[0], trees[s][0][at], trees[s][-1][0], top[-1][0], sha(*(a + b for a, b in sides)), folded, folded == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_is_that_of_brute_force(spark, levels):
    draw = random.Random(levels)
    rows = [(k, "line\n" * draw.randrange(3) + str(k), draw.choice(["en", None]), "hot" if k % 3 else f"s{draw.randrange(12)}", k, "x", 1, 1, 1) for k in range(140)]
    rows += [(500, "alone\n", "en", "alone", 1, "x", 1, 1, 1), *ODD[:7]]
    draw.shuffle(rows)
    got = merkle.tampered_manifest(spark.createDataFrame(rows, DOCS), levels=levels).collect()
    assert Counter(tuple(r)[:7] for r in got) == manifest(rows)


def test_a_version_copies_its_path_and_shares_the_rest(spark):
    rows = [(k, f"{k}\n", "en", "s", k, "x", 1, 1, 1) for k in range(40)]
    got = {r["doc_id"]: r for r in merkle.tampered_manifest(spark.createDataFrame(rows, DOCS), levels=2).collect()}
    levels = climb([leaf(r, r[1]) for r in rows])
    base_nodes = {x for nodes in levels for x in nodes}
    for r in rows:
        new = [x if k != r[0] else leaf(r, r[1].replace("\n", "")) for k, x in enumerate(levels[0])]
        version = climb(new)
        if zlib.crc32(str(r[0]).encode()) % 2 == 0:
            assert got[r[0]]["copies"] == [version[k][r[0] // 3**k] for k in range(len(version))] and not got[r[0]]["verified"]
            assert {x for nodes in version for x in nodes} - set(got[r[0]]["copies"]) <= base_nodes  # all else is shared
        else:
            assert got[r[0]]["copies"] == [] and got[r[0]]["verified"]


def test_manifest_of_odd_rows_and_an_empty_table(odd, empty):
    got = merkle.tampered_manifest(odd).collect()
    assert Counter(tuple(r)[:7] for r in got) == manifest(ODD)
    assert merkle.tampered_manifest(empty).count() == 0

"""The ten operators on small tables: brute force, round trips, held-out accuracy, odd rows."""

import hashlib
import os
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyform.llm import chat_format, embedding_dedup, exact_dedup, language_id, line_dedup, mixing, packing, simhash, toxicity, url_filter
from tallyform.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, ROW int"
ODD = [
    (1, "A b c", "en", "s", 5, "x", 1), (2, "a B c", "en", "s", 5, "x", 1), (3, None, None, None, None, None, None), (4, "", "en", None, 0, "x", 1),
    (5, "Ä b c", "de", "t", 5, "x", 1), (6, "ä b c", "de", "t", 5, "x", 1), (None, "a b c", None, "t", 5, "x", 1), (2, "a B c", "en", "s", 5, "x", 1),
    (7, "word " * 30_000 + "end", "en", "s", 1, "x", 1), (8, " \t\n ", "en", "s", 1, "x", 1), (9, "é　x  y\r\n\n z<|endoftext|>", "en", "s", 1, "x", 1),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def roots(n, links):
    """Smallest index reachable."""
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(n)]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("digest", [None, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_exact_dedup(odd, digest):
    got = exact_dedup.exact_dedup(odd, digest=digest).collect()
    assert len(got) == len(ODD) and sum(r["kept"] for r in got) == len({low(r[1]) for r in ODD})
    for r in got:
        same = [x for x in ODD if hashlib.sha256(low(x[1]).encode()).hexdigest() == r["text_sha256"]]
        assert r["group_size"] == len(same) and r["keep_id"] == max((x[0] for x in same if x[0] is not None), default=None)


def test_exact_dedup_keeps_columns(odd, empty):
    kept = exact_dedup.keep_first_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({low(r[1]) for r in ODD})
    assert exact_dedup.keep_first_copies(empty).count() == 0


@pytest.mark.parametrize("digest", [None, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_exact_dedup_in_several_batches(spark, digest, tmp_path):
    rows = [(i, f"text {i % 7}" if i < 60 else f"alone {i}") for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    batches = lambda: set(Path(spark.conf.get("spark.checkpoint.dir")).glob("state-*/batch=*"))
    before = batches()
    got = exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/docs"), digest=digest, batch_bytes=1).collect()
    assert len(batches() - before) > 1
    for r in got:
        same = [i for i, t in rows if t == rows[r["doc_id"]][1]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(same), len(same), r["doc_id"] == max(same))
    assert len(got) == len(rows)


def brute_simhash(texts):
    import xxhash

    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def test_simhash_fingerprints(odd, empty):
    got = {(r["doc_id"], r["fingerprint"]) for r in simhash.simhash_groups(odd).collect()}
    assert got == {(r[0], f"{f:016x}") for r, f in zip(ODD, brute_simhash([r[1] for r in ODD]), strict=True)}
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.one_of_each_group(odd).columns == odd.columns


def test_simhash_links_in_short_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIST_PAIRS", 8)
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 63))
    near = {base ^ sum(1 << int(b) for b in rng.choice(64, size=int(rng.integers(0, 6)), replace=False)) for _ in range(150)}
    tail = {(base & ~0xFFFFFFFF) ^ int(x) for x in rng.integers(0, 1 << 12, size=120)}
    prints = sorted(near | tail | {int(x) for x in rng.integers(0, 1 << 63, size=100)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    got = [(signed.index(r["src"]), signed.index(r["dst"])) for r in simhash.fingerprint_links(df).collect()]
    assert set(map(frozenset, got)) <= set(map(frozenset, links))
    assert roots(len(prints), got) == roots(len(prints), links)


@pytest.mark.parametrize("drop", [simhash.one_of_each_group, simhash.without_near_copies])
def test_near_copies_without_ids_go(spark, drop):
    rows = [(None, "one two three four five six")] * 3 + [(None, "other words of this text here")] * 2 + [(3, "a third text that has an id"), (None, "a third text that has an id")]
    got = [tuple(r) for r in drop(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[3], rows[5]], key=str)


@pytest.mark.parametrize("lists", [2, 16])
def test_near_copies_go(spark, odd, empty, monkeypatch, lists):
    monkeypatch.setattr(simhash, "LIST_SETS", lists)
    monkeypatch.setattr(simhash, "COMMON", 3)
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts, passage = [], words(60)
    for _ in range(12):
        body = words(int(rng.integers(40, 300)))
        texts.append(body)
        for k in range(int(rng.integers(0, 7))):
            copy = list(body)
            for at in rng.integers(0, len(copy), k):
                copy[at] = "changed"
            texts.append(copy)
    texts += [passage + words(int(n)) for n in rng.integers(1, 60, 20)]
    rows = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)] + [(500, "one two"), (501, "One  TWO"), (502, None), (503, " ")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    similar = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4]
    assert len(similar) > 20
    root, least = roots(len(rows), similar), {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, 10**9), rows[i][0])
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert not any(rows[i][0] in got and rows[j][0] in got for i, j in similar)
    assert got == set(least.values())
    assert corpus_pipeline.drop_near_copies(spark, odd, "").columns == odd.columns and corpus_pipeline.drop_near_copies(spark, empty, "").count() == 0


@pytest.mark.parametrize(("n", "lists", "rounds", "common"), [(160, 16, 6, 8), (60, 2, 0, 8), (120, 40, 6, 10_000)])
def test_a_group_of_near_copies_does_not_give_its_square(spark, monkeypatch, n, lists, rounds, common):
    monkeypatch.setattr(simhash, "COMMON", common)
    monkeypatch.setattr(simhash, "LIST_SETS", lists)
    monkeypatch.setattr(simhash, "ROUNDS", rounds, raising=False)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.choice(150, size=(1, 2, 2, 3, 6)[i % 5], replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    checked = []
    real = simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda pairs, *a: checked.append(pairs.distinct().count()) or real(pairs, *a))
    shingles = [{tuple(w[k : k + 5]) for k in range(146)} for w in (t.split() for _, t in rows)]
    alike = [(a, b) for a in range(n) for b in range(a) if len(shingles[a] & shingles[b]) * 5 >= len(shingles[a] | shingles[b]) * 4]
    got = {r["doc_id"] for r in simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(roots(n, alike)) and 1 < len(got) < n
    assert rounds == 0 or sum(checked) <= 10 * n


def test_a_link_whose_first_shingles_are_in_long_lists(spark, monkeypatch):
    """The 13 first shared shingles of two near copies are in lists of three, the others in lists of two, too far back to leave room."""
    monkeypatch.setattr(simhash, "LIST_SETS", 2)
    a = [f"w11a{i}" for i in range(150)]
    b = [f"c11b{i}" if i in (20, 70, 120) else w for i, w in enumerate(a)]
    shared = np.intersect1d(*(simhash.shingle_hashes(" ".join(x).encode(), 5) for x in (a, b)))[:13]
    parts = [" ".join(a[i : i + 5]) for i in range(146) if simhash.shingle_hashes(" ".join(a[i : i + 5]).encode(), 5)[0] in shared]
    rows = [(0, " ".join(a)), (1, " ".join(b)), (2, " ".join(f"{x} f{i} g{i} h{i} j{i} k{i}" for i, x in enumerate(parts)))]
    got = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(parts) == 13 and {r["doc_id"] for r in got} == {0, 2}


def test_vector_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PER_PIVOT", 20)
    rng = np.random.default_rng(3)
    heart = rng.normal(size=(12, 16))
    vecs = [h + rng.normal(size=16) * s for h in heart for s in (0.0, 0.0, 0.05, 0.1, 0.15, 0.2, 0.25)] + list(rng.normal(size=(60, 16)))
    vecs = [[float(x) for x in np.float32(v)] for v in vecs] + [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 0.0], [2.0, 0.0], []]
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<float>")
    good = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for v in vecs]
    links = [(i, j) for i in range(len(vecs)) for j in range(i) if good[i] and good[j] and len(vecs[i]) == len(vecs[j]) and np.dot(vecs[i], vecs[j]) / np.linalg.norm(vecs[i]) / np.linalg.norm(vecs[j]) >= 0.95]
    want = roots(len(vecs), links)
    for block in (8192, 7):
        got = {r["vec_id"]: r for r in embedding_dedup.vector_links(df, block=block).collect()}
        assert len(got) == len(vecs)
        for i in range(len(vecs)):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (sum(i in x for x in links), want[i], want[i] == i)
    assert embedding_dedup.vector_links(df.limit(0)).count() == 0


def test_line_dedup(spark, odd, empty):
    rows = [(i, t) for i, t in enumerate(["a b c d e\nx y", "a b c d e f\nX  Y", "e d c b a\n\nq", None, "", "x y z", "k l m n o p q r s t\nk l m n o p q r s u\nx y"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in line_dedup.line_matches(df).collect()}
    assert got == {0: (2, []), 1: (2, [0, 1]), 2: (2, [0]), 3: (0, []), 4: (0, []), 5: (1, []), 6: (3, [1, 2])}
    clean = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(df).collect()}
    assert clean[0] == rows[0][1] and clean[2] == "\nq" and clean[3] is None
    assert line_dedup.line_matches(odd).where("doc_id = 7").first()["n_lines"] == 1
    assert line_dedup.line_matches(empty).count() == 0
    twice = [(1, "p q r s t"), (1, "u v w x y\na b c d e"), (2, "t s r q p\nu v w x y"), (2, "t s r q p\nu v w x y")]
    assert {r["doc_id"]: (r["n_lines"], r["removed"]) for r in line_dedup.line_matches(spark.createDataFrame(twice, "doc_id long, text string")).collect()} == {1: (3, []), 2: (4, [0, 1])}


def brute_lines(rows):
    """doc_id: (lines with words, removed line numbers), by comparing every line with every earlier one."""
    at = sorted(((d is not None, d or 0, k, frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)) for d, t in rows for k, line in enumerate((t or "").split("\n"))), key=lambda x: x[:3])
    at, out = [x for x in at if x[3]], {d: (0, []) for d, _ in rows}
    for i, (known, d, k, words) in enumerate(at):
        n, gone = out[d if known else None]
        dup = any(len(words & x[3]) * 5 >= len(words | x[3]) * 4 for x in at[:i])
        out[d if known else None] = (n + 1, [*gone, k] if dup else gone)
    return out


@pytest.mark.parametrize("cells", [1 << 15, 4])
def test_line_dedup_is_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(line_dedup, "CELLS", cells)
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ä", "ä", "É", "the"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    lines = []
    for _ in range(220):
        line = [str(x) for x in rng.choice(vocabulary, size=int(rng.choice([1, 2, 3, 4, 5, 6, 9, 12, 20, 40, 90])), p=weights / weights.sum())]
        lines.append(line)
        for _ in range(int(rng.integers(0, 4))):
            copy = list(line)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 1 + len(copy) // 6))):
                copy[at] = str(rng.choice(vocabulary))
            lines.append([str(x) for x in rng.permutation(copy)])
    lines += [[*["k" + str(i) for i in range(20)], f"x{j}", f"y{j}"] for j in range(60)]
    texts = [rng.choice([" ", "  ", "\t", " \r"]).join(x) for x in lines]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    assert len(texts) > 500
    rows, k = [], 0
    while k < len(texts):
        n = int(rng.integers(1, 9))
        rows.append((len(rows) * 7 - 40, "\n".join([*texts[k : k + n], ""])))
        k += n
    rows += [(None, texts[3] + "\n\n" + texts[4]), (99999, None), (99998, " \t\n")]
    monkeypatch.setattr(line_dedup, "FEW", 10 if cells == 4 else 500_000)
    got = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in line_dedup.line_matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_lines(rows)


def test_chat_digests(spark):
    rows = [(1, 0, "user", "</s>[INST] <|im_end|>\n\\x"), (1, 1, "assistant", "<<SYS>>é\\"), (1, 2, "a\nb", None), (1, 3, "assistant", "<"), (2, None, None, "x"), (2, 0, "assistant", "y"), (None, 5, "user", ""), (1, 3, "assistant", "<")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, tree string")
    got = {r["conv_id"]: r for r in chat_format.conversation_digests(df).collect()}
    assert set(got) == {1, 2, None}
    for conv, r in got.items():
        turns = sorted(((-1 if x[1] is None else x[1], x[2] or "", x[3] or "") for x in rows if x[0] == conv))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.conversation_digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["\ufeffab", "\ufeff", "\ufeff\ufeff😀", "\ufffeab", ""])
def test_loss_text_keeps_a_leading_mark(spark, text):
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", text), (1, 2, "user", "so"), (1, 3, "assistant", "x\ufeff")]
    (got,) = chat_format.conversation_digests(spark.createDataFrame(said, "conv_id long, turn int, role string, text string")).collect()
    assert got["loss_chars"] == len(text) + 2 and got["loss_sha256"] == hashlib.sha256((text + "x\ufeff").encode()).hexdigest()


@pytest.mark.parametrize("role", ["r" * 1_000_000, "a\\\n" * 60_000])
def test_long_roles_and_texts(spark, role):
    said = [(1, 0, role, "<|im_end|>\n\\" * 70_000), (1, 1, "assistant", "x" * 1_000_000)]
    (got,) = chat_format.conversation_digests(spark.createDataFrame(said, "conv_id long, turn int, role string, text string")).collect()
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in said).encode()).hexdigest()
    assert (got["n_turns"], got["loss_chars"]) == (2, 1_000_000)


def test_reply_trees_in_any_order_and_circles(spark):
    nodes = [(10, None), (3, 10), (7, 3), (20, 22), (21, 20), (22, 21), (5, 21), (1, 2), (2, 1)]
    df = spark.createDataFrame([("t", n, p, 1.0, "user", f"m{n}") for n, p in nodes], "tree string, node long, parent long, score double, role string, text string")
    paths = {}
    for r in chat_format.best_paths(df, 9).collect():
        paths.setdefault(r["leaf"], []).append((r["depth"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {7: [10, 3, 7], 22: [20, 21, 22], 5: [20, 21, 5], 2: [1, 2]}
    assert chat_format.format_paths(df, 9).count() == 4


def test_reply_trees(spark):
    nodes = [(1, None, 0.0), (2, 1, 5.0), (3, 1, 1.0), (4, 3, 9.0), (5, 2, 1.0), (9, 77, 0.5), (6, 6, 0.0)]
    df = spark.createDataFrame([("t", n, p, s, "user", f"m{n}") for n, p, s in nodes], "tree string, node long, parent long, score double, role string, text string")
    paths = {}
    for r in chat_format.best_paths(df, 3).collect():
        paths.setdefault((r["rank"], r["leaf"]), []).append((r["depth"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {(1, 4): [1, 3, 4], (2, 5): [1, 2, 5], (3, 9): [9]}
    assert [r["formatted"].count("<|im_start|>") for r in chat_format.format_paths(df).collect()] == [3]


def test_language_id(spark, odd):
    rng = np.random.default_rng(1)
    words = {"en": "the quick house stone river".split(), "de": "über straße schön zwischen größe".split()}
    rows = [(i, " ".join(rng.choice(words[lang], size=int(rng.integers(3, 30)))), lang) for i in range(200) for lang in [("en", "de")[i % 2]]] + [(500, None, "en"), (501, "123 !", "en"), (502, "", None), (None, "the stone", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.language_id(df).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in held) for i in range(200))
    assert np.mean([got[i]["lang_pred"] == ("en", "de")[i % 2] for i in held]) > 0.97
    assert [got[i]["lang_pred"] for i in (500, 501, 502, None)] == ["und", "und", "und", "en"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_ngrams_are_whole(monkeypatch):
    text = "abcdefghij" * 7
    whole = language_id.counts_of(text)
    monkeypatch.setattr(language_id, "SPAN", 16)
    assert (language_id.counts_of(text) == whole).all() and whole.sum() == 3 * (len(text) + 2) - 3


def test_packing(odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    tokenizer.encode_special_tokens = True
    want = []
    for r in ODD:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        start, length = 0, len(ids) % 1024 or 1024
        while start < len(ids):
            want.append((r[0], start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
            start, length = start + length, 1024
    got = packing.best_fit_packing(odd, tokenizer_file()).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted([(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=key) == sorted(want, key=key)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(s[-1]) <= 1024
    assert packing.best_fit_packing(empty, tokenizer_file()).count() == 0


def test_best_fit_is_best_fit_decreasing():
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(1, 200, size=400)]
    plan = packing.best_fit(dict(zip(*np.unique(sizes, return_counts=True), strict=True)), 256)
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((256 if fit is None else fit) - s)
    assert len({q + k for s, a, z, q, o in plan for k in range(z - a + 1)}) == len(gaps)
    assert sum(z - a + 1 for _, a, z, _, _ in plan) == len(sizes)


def test_encoder_equals_whole_tokenizer():
    rng = np.random.default_rng(4)
    e = packing.Encoder(tokenizer_file())
    bits = ["a", "Word", "é", "3", "'s", ".", ",", " ", "  ", "\n", "\n\n", "\t", " ", "中", "\0", "<|endoftext|>", "ǅ", "-", "x.", "　"]
    for _ in range(600):
        text = "".join(rng.choice(bits, size=int(rng.integers(1, 14))))
        assert e.encode(text) == e.whole(text), repr(text)


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    plain = [f"w{i}x" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = [str(x) for x in rng.choice(plain, size=40)]
        if i % 4 == 0:
            words[7] = str(rng.choice(["grumpf", "vexulon", "vexulis"]))
        elif i % 40 == 1:
            words[3:5] = ["dear", "grumpf"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None), (901, ""), (902, "gr​umpf w1x " * 3), (903, "VEXUL0N w2x w3x"), (None, "w1x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (7000, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, marks).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(600))
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.98
    assert [got[i]["predicted"] for i in (900, 901, 902, 903, None)] == [0, 0, 1, 1, 0]
    assert toxicity.without_toxic(docs, marks.limit(0)).count() == len(rows)
    assert toxicity.toxicity_scores(docs.limit(0), marks).count() == 0


def test_mixing(spark, odd, empty):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(1, 40)), ["a", "b", "c", None, "d"][min(4, int(rng.integers(0, 9)))]) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    by = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(x[0]["target"] for x in by.values()) - total) < 1e-6 * total
    for x in by.values():
        assert x[0]["target"] <= 3 * x[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= max(r["size"] for r in x)
    taken = lambda x: sorted((r["doc_id"], r["taken"]) for r in x)
    assert taken(got) == taken(mixing.mix(df).collect())
    assert mixing.mixture(df).count() == sum(r["copies"] for r in got)
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0


def test_url_filter(spark):
    entries = spark.createDataFrame([("l", "Bad.org", "add", "2024-01-10"), ("l", "bad.org", "remove", "2024-02-01"), ("l", "bad.org", "add", "2024-01-10"), ("m", "ok.net/p", "add", "2024-01-01"), ("l", None, "add", "2024-01-01"), ("l", "x.y", "boo", "2024-01-01")], "list string, key string, action string, day string")
    rows = [(1, "http://a.bad.org/x", "2024-01-09"), (2, "http://a.BAD.org:80/x", "2024-01-10"), (3, "https://u@bad.org", "2024-01-31"), (4, "http://bad.org/", "2024-02-01"), (5, "http://notbad.org/", "2024-01-15"), (6, "http://ok.net/p?q=1", "2024-03-01"), (7, None, "2024-01-15"), (8, "http://bad.org/", None), (2, "http://a.BAD.org:80/x", "2024-01-10")]
    df = spark.createDataFrame(rows, "page_id long, url string, day string")
    got = sorted((r["page_id"], r["blocked"], r["lists"]) for r in url_filter.as_of_verdicts(df, entries).collect())
    assert got == [(1, False, ""), (2, True, "l"), (2, True, "l"), (3, True, "l"), (4, False, ""), (5, False, ""), (6, True, "m"), (7, False, ""), (8, False, "")]
    assert url_filter.as_of_verdicts(df.limit(0), entries).count() == 0


def test_url_filter_paths_keep_case(spark):
    day = "date '2024-03-01'"
    entries = spark.sql(f"select 'pages' as list, stack(3, 'WWW.A.example/En/X', 'b.example/low', 'C.Example') as key, 'add' as action, {day} as day")
    urls = ["http://www.a.example/En/X", "http://www.a.example/en/x", "http://B.example/low", "http://b.example/LOW", "http://d.c.example/Any"]
    captures = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("day", F.expr(day))
    got = {r["page_id"]: r["blocked"] for r in url_filter.as_of_verdicts(captures, entries).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_pipeline_stages_chain(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"t{x}" for x in rng.integers(0, 5000, size=60)) + (" vilest" if i % 5 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(200)]
    rows += [(1000 + i, rows[i][1].upper(), "en", "s0", 1) for i in range(1, 20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after.append(docs)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [{r["doc_id"] for r in d.collect()} for d in after]
    bad = {i for i, t, *_ in rows if "vilest" in low(t)}
    assert ids[0] == {r[0] for r in rows} - bad
    assert ids[1] == ids[0] - {i for i in range(1, 20) if i % 5}
    assert ids[2] == ids[1]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()
    assert corpus_pipeline.ORACLE_SQL is None


def pieces(texts):
    """(length, crc32) of all pieces of each text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    tokenizer.encode_special_tokens = True
    out = []
    for t in texts:
        ids, start = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], 0
        length, found = len(ids) % 1024 or 1024, []
        while start < len(ids):
            found.append((length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
            start, length = start + length, 1024
        out.append(found)
    return out


def source_targets(sizes):
    """Weights 5, 2, 1 in the order of sources; a target is 3 times its size at most, and the excess goes to the others."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, fixed = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}
    while True:
        free = [s for s in order if s not in fixed]
        left, of = sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / of > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / of for s in free}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_pipeline_is_brute_force(spark, tmp_path):
    """Each stage against its own input, over copies, near copies, nulls, empty and long texts, repeated rows and a clashing column."""
    rng = np.random.default_rng(12)
    words = lambda n: [f"t{x}" for x in rng.integers(0, 5000, n)]
    rows = [(i, " ".join(words(60)) + (" vilest" if i % 5 == 0 else ""), "en", ("a", "b", "c", None)[i % 4], 1, "x") for i in range(160)]
    for i in range(1, 60, 2):
        copy = rows[i][1].split(" ")
        for at in rng.integers(0, 60, i % 3):
            copy[at] = "changed"
        rows.append((1000 + i if i % 4 == 1 else None, " ".join(copy), "en", "a", 1, "x"))
    rows += [(20_000 + i, rows[i][1].upper(), None, "b", None, None) for i in range(61, 80)] + rows[81:90]
    rows += [(30_000, None, None, None, None, None), (30_001, "", "en", "a", 0, "x"), (None, " \n ", None, "b", None, None), (30_002, " ".join(words(3000)), "en", "c", 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, loc_file string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "best_fit_packing" or docs.columns == before.columns
        after.append([tuple(r) for r in docs.collect()] if name != "best_fit_packing" else docs.collect())
    clean, unlike, apart, mixed, packed = after

    def same(got, want):
        assert sorted(got, key=str) == sorted(want, key=str)

    same(clean, [r for r in rows if "vilest" not in low(r[1])])
    groups = {}
    for r in clean:
        groups.setdefault(low(r[1]), []).append(r)
    same([(r[0], low(r[1])) for r in unlike], [(max((x[0] for x in g if x[0] is not None), default=None), t) for t, g in groups.items()])
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (r[1] or "").lower().split()) else set() for r in unlike]
    similar = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4]
    assert len(similar) > 5
    root, least = roots(len(unlike), similar), {}
    for i, r in enumerate(root):
        least.setdefault(r, []).append((unlike[i][0] is None, unlike[i][0]))
    same([r[0] for r in apart], [min(g, key=lambda k: (k[0], k[1] or 0))[1] for g in least.values()])
    size = lambda r: len((r[1] or "").split())
    sizes = {}
    for r in apart:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r)
    for source, target in source_targets(sizes).items():
        assert abs(sum(size(r) for r in mixed if r[3] == source) - target) <= max(size(r) for r in apart if r[3] == source)
    assert set(mixed) <= set(apart) and max(mixed.count(r) for r in set(mixed)) <= 3
    same([(r["doc_id"], r["length"], r["ids_crc32"]) for r in packed], [(m[0], *p) for m, found in zip(mixed, pieces([m[1] for m in mixed]), strict=True) for p in found])
    seqs = {}
    for r in packed:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(s[-1]) <= 1024


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_leave_no_scratch_and_unlike_sets_unread(spark, monkeypatch):
    """Sets of one hot passage meet; what their own parities drop is not read whole, and of all tables only the verdict stays."""
    made, read, real = [], [], simhash.written
    monkeypatch.setattr(simhash, "LIST_SETS", 2)

    def spy(df, name, *a):
        out = real(df, name, *a)
        made.append((name, out[1]))
        if name == "shingles":
            read.extend(r["sid"] for r in out[0].select("sid").collect())
        return out

    monkeypatch.setattr(simhash, "written", spy)
    rng = np.random.default_rng(5)
    own = lambda: [f"w{x}" for x in rng.integers(0, 1 << 30, 2000)]
    hot = [f"hot{i}" for i in range(40)]
    texts = [own() + hot for _ in range(12)]
    texts.append([*texts[0][:-45], "tail"])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    out = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in out.collect()} == set(range(12))
    assert len(set(read)) == 2
    assert [name for name, path in made if os.path.exists(path.removeprefix("file:"))] == ["gone"]

"""SimHash near-dedup over a byte-position inverted index with count filtering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import connected_components, located, remove, scratch, written

#: Differing bits of a link, and so the positional bytes (of 8) that a linked pair shares at least.
MOST_BITS = 2
LEAST_BYTES = 8 - MOST_BITS
#: Four positional bytes make a posting. Whichever two bytes differ, one of these six sets holds neither.
POSTING_BYTES = ((0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7), (2, 3, 4, 5), (2, 3, 6, 7), (4, 5, 6, 7))
#: Longer posting lists are searched by bit flips instead of by their pairs.
LIST_PAIRS = 64
HASH_BLOCK = 1 << 14
#: The corpus stage: words of a shingle, and the Jaccard similarity of shingle sets, as a fraction, from which two texts are near copies.
STAGE_WORDS, NUM, DEN = 5, 4, 5
#: Longer lists of shingles are linked over their leaders first. Texts that the order of shingles is learned from, and how many of them make a shingle common.
LIST_SETS, ORDER_TEXTS, COMMON = 16, 20_000, 8
#: Longs of a set's parities. Rounds of leaders at most, before what is left of long lists meets by its pairs.
PARITY_LONGS, ROUNDS = 8, 6
#: Locators up to which texts meet them by a broadcast.
FEW = 100_000


def shingle_hashes(text: bytes, words: int):
    """XXH64 (seed 42) of each shingle, repeats too; fewer words than a shingle are one shingle, none are none."""
    import numpy as np
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype="<u8")
    joined, starts, ends, at = b" ".join(found), [], [], 0
    for w in found:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    ends = ends[words - 1 :] or [len(joined)]
    return np.fromiter((xxh64_intdigest(joined[a:z], 42) for a, z in zip(starts, ends, strict=False)), dtype="<u8", count=len(ends))


def fingerprint_from(hashes) -> int:
    """Unsigned fingerprint: bit i is 1 if over half of the shingles' hashes have it; 0 without shingles."""
    import numpy as np

    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), HASH_BLOCK):
        ones += np.unpackbits(hashes[k : k + HASH_BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint_of(text: bytes, words: int = 3) -> int:
    return fingerprint_from(shingle_hashes(text, words))


def fingerprint_udf(words: int):
    @F.pandas_udf(T.LongType())
    def fingerprint(texts: pd.Series) -> pd.Series:
        made = [fingerprint_of(t, words) for t in texts]
        return pd.Series([x - (1 << 64) if x >> 63 else x for x in made], dtype="int64")

    return fingerprint


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(src, dst) over distinct ``fp`` (signed longs): links whose components are those of all links of MOST_BITS or fewer.

    Each fingerprint stands in six posting lists, by its bytes at four positions. Lists of up to LIST_PAIRS members
    give all their pairs; a pair stays if it shares LEAST_BYTES positional bytes and then if its bits agree. In a
    longer list each member goes to itself and its 32 one-bit neighbours over the list's other bytes: members that
    meet differ by two bits at most, at most 33 can meet, and each is linked to the smallest. So no list is dropped,
    none is gathered, and none gives its square.
    """
    spark = prints.sparkSession
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    key = lambda at: sum((F.shiftleft(byte(p), 8 * i) for i, p in enumerate(at)), F.lit(0).cast("long"))
    postings = prints.select("fp", F.posexplode(F.array(*map(key, POSTING_BYTES))).alias("at", "key"))
    sizes = postings.groupBy("at", "key").agg(F.count("*").alias("n")).where("n > 1")
    listed, _ = written(postings.join(sizes, ["at", "key"]), "postings")
    short = listed.where(F.col("n") <= LIST_PAIRS).groupBy("at", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = short.select("fps", F.posexplode("fps").alias("i", "src")).select("src", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("dst"))
    unlike = F.col("src").bitwiseXOR(F.col("dst"))
    shared = sum((F.when(F.shiftrightunsigned(unlike, 8 * p).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))
    near = pairs.where(shared >= LEAST_BYTES).where(F.bit_count(unlike) <= MOST_BITS)
    others = F.element_at(F.array(*[F.array(*[F.lit(8 * p + b) for p in range(8) if p not in at for b in range(8)]) for at in POSTING_BYTES]), F.col("at") + 1)
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(others, lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    meets = listed.where(F.col("n") > LIST_PAIRS).select("at", "key", "fp", F.explode(flips).alias("flip")).groupBy("at", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("near")).agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    stars = meets.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).where("src <> dst").where(F.bit_count(unlike) <= MOST_BITS)
    return near.union(stars).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp, fingerprint, component_id, loc_file, loc_row.

    Texts are whole; null and wordless texts have fingerprint 0 and link like any other; texts of fewer words than a
    shingle are one shingle. component_id is the smallest id (nulls aside) of all rows reachable by links. Repeated
    rows share a component. An empty table gives no rows.
    """
    return _groups(located(docs), id_col, text_col, words).drop("component")


def _groups(base: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).cast("binary")
    rows, _ = written(base.select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), fingerprint_udf(words)(text).alias("fp"), "loc_file", "loc_row"), "fingerprints")
    prints, _ = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    joined = connected_components(fingerprint_links(prints.select("fp")))
    reach = prints.join(joined.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    groups = reach.groupBy("component").agg(F.min("least").alias("component_id"))
    named = reach.select("fp", "component").join(groups, "component").select("fp", "component", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "loc_file", "loc_row", "component")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """docs with one row of each near-duplicate group, in their own columns: the smallest id, then the first locator."""
    base = located(docs)
    rows, _ = written(_groups(base, id_col, text_col, words), "groups")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "loc_file", "loc_row")).alias("k"), F.count("*").alias("n")).where("n > 1").select(F.col("k.loc_file").alias("loc_file"), F.col("k.loc_row").alias("loc_row"))
    grouped = rows.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    gone = rows.join(grouped, "component", "left_semi").join(first, ["loc_file", "loc_row"], "left_anti").select("loc_file", "loc_row")
    return base.join(gone, ["loc_file", "loc_row"], "left_anti").select("row.*")


def _sets_udf(words: int, common, ranks):
    """fp, digest, n, parity, bits and prefix of a text's set of shingles; common shingles (sorted, with ranks) come last in its order.

    Bit i of parity tells whether an odd number of the shingles have i as their hash's remainder. bits are such parities
    too, at least as many as the set has shingles: a power of two, so that longer ones fold to shorter ones.
    """

    @F.pandas_udf("fp long, digest binary, n int, parity array<long>, bits binary, prefix array<long>")
    def made(texts: pd.Series) -> pd.DataFrame:
        import hashlib

        import numpy as np

        out = []
        for t in texts:
            h = shingle_hashes(t, words)
            s, rank = np.unique(h), 0
            if len(common) and len(s):
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                rank = np.where(common[at] == s, ranks[at], 0)
            first = s[np.lexsort((s, np.broadcast_to(rank, s.shape)))][: len(s) - -(-len(s) * NUM // DEN) + 1]
            print_ = fingerprint_from(h)
            odd = lambda m: np.packbits((np.bincount((s % np.uint64(m)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little")  # noqa: B023, E731
            bits = odd(max(64, 1 << max(len(s) - 1, 0).bit_length())).tobytes()
            out.append((print_ - (1 << 64) if print_ >> 63 else print_, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), odd(64 * PARITY_LONGS).view("<i8"), bits, first.view("<i8")))
        return pd.DataFrame(out, columns=["fp", "digest", "n", "parity", "bits", "prefix"])

    return made


def _shingles_udf(words: int):
    """A text's set of shingles: sorted hashes, eight bytes each, which take no Python objects on their way."""

    @F.pandas_udf("binary")
    def shingles(texts: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([np.unique(shingle_hashes(t, words)).tobytes() for t in texts], dtype=object)

    return shingles


def _tokens_udf(words: int):
    @F.pandas_udf("array<long>")
    def tokens(texts: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([np.unique(shingle_hashes(t, words)).view("<i8") for t in texts], dtype=object)

    return tokens


def _common_shingles(texts: DataFrame, words: int):
    """Shingles of COMMON or more of about ORDER_TEXTS texts, sorted, and how many have them. They only order the sets: no result depends on them."""
    import numpy as np

    total = texts.count()
    drawn = texts.sample(min(1.0, ORDER_TEXTS / total), seed=7) if total else texts
    found = drawn.select(F.explode(_tokens_udf(words)("text")).alias("token")).groupBy("token").agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= COMMON).toPandas()
    common = found["token"].to_numpy(dtype="<i8").view("<u8")
    order = np.argsort(common)
    return common[order], found["n"].to_numpy(dtype="<i4")[order]


def _fit(a: str, b: str) -> F.Column:
    """Sizes and the places of the common shingle leave enough overlap."""
    n_a, n_b, at_a, at_b = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.at"), F.col(f"{b}.at")
    return (n_a * DEN >= n_b * NUM) & (n_b * DEN >= n_a * NUM) & (F.least(n_a - at_a, n_b - at_b) * (NUM + DEN) >= (n_a + n_b) * NUM)


def _pair(a: str, b: str) -> list:
    return [F.least(f"{a}.sid", f"{b}.sid").alias("a"), F.greatest(f"{a}.sid", f"{b}.sid").alias("b")]


def _near_parities() -> F.Column:
    """Each unshared shingle flips one parity, and a similar pair has (n_a + n_b) (DEN - NUM) / (DEN + NUM) of them at most."""
    flipped = sum((F.bit_count(F.col("a.parity")[i].bitwiseXOR(F.col("b.parity")[i])) for i in range(PARITY_LONGS)), F.lit(0))
    return flipped * (DEN + NUM) <= (F.col("a.n") + F.col("b.n")) * (DEN - NUM)


def _tallied(meets: DataFrame) -> DataFrame:
    """(a, b, c, need, fits): pairs whose sizes fit, how many lists they met in, and how many posted shingles a similar pair shares at least.

    fits tells whether the place in some of these lists leaves enough overlap. A similar pair's first common shingle
    does, which may stand in a list that isn't among these.

    Of the overlap, what isn't posted by both is beyond the postings of one: n NUM / DEN shingles, rounded up, less one.
    """
    n_a, n_b = F.col("a.n"), F.col("b.n")
    need = F.ceil((n_a + n_b) * NUM / (NUM + DEN)) - F.greatest(F.ceil(n_a * NUM / DEN), F.ceil(n_b * NUM / DEN)) + 1
    sized = meets.where((n_a * DEN >= n_b * NUM) & (n_b * DEN >= n_a * NUM)).select(*_pair("a", "b"), need.alias("need"), _fit("a", "b").alias("fits"))
    return sized.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("need").alias("need"), F.max("fits").alias("fits"))


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    import numpy as np

    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
        common = len(np.intersect1d(x, y, assume_unique=True))
        out.append(common * DEN >= (len(x) + len(y) - common) * NUM)
    return pd.Series(out, dtype=bool)


@F.pandas_udf(T.BooleanType())
def _near_bits(n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """What _near_parities tells, by parities that grow with the sets, so that they drop unlike sets of any size; n has both sizes."""
    import numpy as np

    out = []
    for both, x, y in zip(n, a, b, strict=True):
        x, y = sorted((np.frombuffer(v, dtype="<u8") for v in (x, y)), key=len)
        flipped = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x
        out.append(int.from_bytes(flipped.tobytes(), "little").bit_count() * (DEN + NUM) <= int(both) * (DEN - NUM))
    return pd.Series(out, dtype=bool)


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _similar(candidates: DataFrame, sets: DataFrame, base: DataFrame, text, words: int) -> DataFrame:
    """(src, dst): candidates (a, b) whose whole sets of shingles have a Jaccard similarity of NUM / DEN or more.

    Whole sets are made and sent only of pairs that their own parities leave room for.
    """
    of = lambda rows, side, *cols: rows.select(F.col("sid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols])
    met, met_path = written(candidates.where("a <> b").distinct(), "candidates")
    sized = met.join(of(sets, "a", "n", "bits"), "a").join(of(sets, "b", "n", "bits"), "b")
    near, near_path = written(sized.where(_near_bits(F.col("n_a") + F.col("n_b"), "bits_a", "bits_b")).select("a", "b"), "near")
    need, need_path = written(near.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(sets.select("sid", "loc_file", "loc_row"), "sid"), "need")
    whole, path = written(base.select(text.alias("text"), "loc_file", "loc_row").join(_few(need), ["loc_file", "loc_row"]).select("sid", _shingles_udf(words)("text").alias("s")), "shingles", 64)
    out, _ = written(near.join(of(whole, "a", "s"), "a").join(of(whole, "b", "s"), "b").where(_alike("s_a", "s_b")).select(F.col("a").alias("src"), F.col("b").alias("dst")), "similar", 64)
    remove(base.sparkSession, met_path, near_path, need_path, path)
    return out


def _leaders(members: DataFrame, order: F.Column, *within: str) -> DataFrame:
    """The last member of each list (and of each part of it) by ``order``."""
    top = members.groupBy("token", *within).agg(F.max_by(F.struct("sid", "n", "parity"), order).alias("l"))
    return top.select("token", "l.*", *within)


def _led(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """(a, b): members with the leaders of their lists, as far as sizes and parities let them be similar."""
    n_a, n_b = F.col("a.n"), F.col("b.n")
    meets = members.alias("a").join(leaders.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.sid") != F.col("b.sid")) & (n_a * DEN >= n_b * NUM) & (n_b * DEN >= n_a * NUM) & _near_parities())
    return meets.select(*_pair("a", "b")).distinct()


def _linked_in_long_lists(long: DataFrame, edges: DataFrame, similar) -> DataFrame:
    """edges (src, dst) and what joins the components of all similar pairs that meet in long lists; similar checks pairs.

    A large group of copies is linked by few of its pairs. So in rounds, what isn't in its list's largest component meets
    a leader of that component and one of the rest, others each time, for as long as that leaves much fewer pairs of
    different components. All pairs that are left then meet, and parities drop the unlike ones in the join: only the
    comparisons of long lists of unlike sets grow with the square, not what they make.
    """
    size = long.count()
    left = None
    for k in range(ROUNDS + 1 if size else 0):
        joined = connected_components(edges)
        edges = joined.select(F.col("id").alias("src"), F.col("component").alias("dst"))
        placed = long.join(joined.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        placed, _ = written(placed, "placed")
        parts = placed.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token")
        largest = parts.agg(F.max(F.struct("k", "component")).alias("m"), F.sum("k").alias("all")).select("token", F.col("m.component").alias("largest"), F.col("m.k").alias("most"), "all")
        largest, _ = written(largest, "largest")
        before, left = left, largest.agg(F.sum((F.col("all") - F.col("most")) * (F.col("all") + F.col("most")) / 2)).first()[0]
        others = placed.join(largest.select("token", "largest"), "token").where("component <> largest")
        if k == ROUNDS or left <= LIST_SETS * size or before is not None and left > 0.75 * before:
            break
        sides = placed.join(largest.where("most < all").select("token", "largest"), "token").withColumn("rest", F.col("component") != F.col("largest"))
        order = F.struct("k", F.xxhash64("parity")) if k == 0 else F.xxhash64("parity", F.lit(k))
        edges = edges.union(similar(_led(others, _leaders(sides, order, "rest"))))
    if left:
        # a pair that meets in a short list too has been checked; of any other similar pair, the place of the first common shingle fits
        unlinked = F.expr("a.token = b.token and a.component <> b.component and (b.component = a.largest or a.sid < b.sid)")
        rest = others.alias("a").join(placed.alias("b"), unlinked & _fit("a", "b") & _near_parities())
        edges = edges.union(similar(rest.select(*_pair("a", "b"))))
    return edges


def near_copies(base: DataFrame, id_col: str, text_col: str, words: int = STAGE_WORDS) -> DataFrame:
    """(loc_file, loc_row) of all rows of located docs but one of each group linked by similarities of NUM / DEN or more.

    Of a group the smallest id stays, then the first locator; null ids come last. Rows of equal sets are one set.
    The fingerprint index proposes pairs within MOST_BITS. It reaches few of the pairs at 0.8, so sets also meet by
    shingle: rare ones first, a set of n posts n - ceil(n NUM / DEN) + 1, which no similar pair escapes. Lists of up to
    LIST_SETS give their pairs; in longer ones each set meets leaders of the list (see _linked_in_long_lists): no list is
    dropped, and a large group of copies doesn't give its square. The lists that a pair shares are counted; what they
    and the postings leave room for is checked. Each proposed pair is checked on its whole sets.
    """
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).cast("binary")
    common, ranks = _common_shingles(base.select(text.alias("text")), words)
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "loc_file", "loc_row", "sid")
    made = base.select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), "loc_file", "loc_row", _sets_udf(words, common, ranks)(text).alias("s"))
    rows, _ = written(made.select(F.monotonically_increasing_id().alias("sid"), "doc_id", "loc_file", "loc_row", "s.*"), "rows", 64)
    named = rows.select("sid", "doc_id", "loc_file", "loc_row")
    twice = rows.groupBy("digest").agg(F.count("*").alias("k")).where("k > 1").select("digest")
    same, _ = written(rows.select("digest", "sid", "doc_id", "loc_file", "loc_row").join(twice, "digest"), "same")
    firsts = same.groupBy("digest").agg(F.min(key).alias("first")).select("digest", F.col("first.sid").alias("first"))
    again, _ = written(same.join(firsts, "digest").where("sid <> first").select("sid", "loc_file", "loc_row"), "again")
    sets = rows.join(again.select("sid"), "sid", "left_anti")
    posted = sets.select("sid", "n", F.posexplode("prefix").alias("at", "token"))
    listed, listed_path = written(posted.withColumn("size", F.count("*").over(Window.partitionBy("token"))).where("size > 1"), "listed")
    short, long = listed.where(F.col("size") <= LIST_SETS), listed.where(F.col("size") > LIST_SETS)
    near = short.alias("a").join(short.alias("b"), F.expr("a.token = b.token and a.sid < b.sid"))
    longs = long.groupBy("sid").agg(F.count("*").alias("k"))
    of = lambda side: longs.select(F.col("sid").alias(side), F.col("k").alias(f"k_{side}"))
    beyond = F.least(F.coalesce("k_a", F.lit(0)), F.coalesce("k_b", F.lit(0)))
    near = _tallied(near).join(of("a"), "a", "left").join(of("b"), "b", "left").where((F.col("fits") | (beyond > 0)) & (F.col("c") + beyond >= F.col("need"))).select("a", "b")
    long, _ = written(long.join(longs.join(sets.select("sid", "parity"), "sid"), "sid"), "long")
    led = _led(long, _leaders(long, F.struct("k", F.xxhash64("parity"))))
    heads, _ = written(sets.groupBy("fp").agg(F.min("sid").alias("sid")), "heads")
    alike = sets.select("fp", "sid").alias("a").join(heads.alias("b"), "fp").select(*_pair("a", "b"))
    links = fingerprint_links(heads.select("fp"))
    close = links.join(heads.select(F.col("fp").alias("src"), F.col("sid").alias("x")), "src").join(heads.select(F.col("fp").alias("dst"), F.col("sid").alias("y")), "dst").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    edges = _similar(near.union(led).union(alike).union(close), sets, base, text, words)
    remove(base.sparkSession, listed_path)
    edges = _linked_in_long_lists(long, edges, lambda pairs: _similar(pairs, sets, base, text, words))
    linked, _ = written(named.join(connected_components(edges).withColumnRenamed("id", "sid"), "sid"), "linked")
    kept = linked.groupBy("component").agg(F.min(key).alias("k")).select("component", F.col("k.sid").alias("kept"))
    return linked.join(kept, "component").where("sid <> kept").select("loc_file", "loc_row").union(again.select("loc_file", "loc_row"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = STAGE_WORDS) -> DataFrame:
    """docs, in their own columns, without the rows that near_copies names. The scratch tables of the search are gone by then."""
    base = located(docs)
    with scratch(docs.sparkSession) as made:
        gone, path = written(near_copies(base, id_col, text_col, words), "gone")
        made.remove(path)
    return base.join(_few(gone), ["loc_file", "loc_row"], "left_anti").select("row.*")

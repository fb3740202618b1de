"""Merkle manifest: a tree of digests over all rows, whose versions copy only the path above a changed leaf."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import written

#: Children of a node.
FANOUT = 3
#: Levels of an aligned block: FANOUT ** BLOCK_LEVELS leaves are hashed in one group.
BLOCK_LEVELS = 6

GROUP = ["named", "name"]
PATH = "named boolean, name string, at long, lefts array<binary>, rights array<binary>, subroot binary, root binary"


def value_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    """Binary SHA-256 of the values' texts in order."""
    return F.unhex(F.sha2(F.concat(*map(value_text, values)), 256))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ``at``, 0, 1, ... within (named, name) in the order, and ``n``, their group's rows; no group in one task.

    Sorted ranges of all rows are made once, as a table; a row's place is its place in the range plus its group's rows
    in the ranges before. Rows alike in every order column are dealt over ranges by a seeded draw: any order will do
    among them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*GROUP, *order, "_draw"]
    ranged = rows.withColumn("_draw", F.rand(7)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_draw").withColumn("_id", F.monotonically_increasing_id())
    made, _ = written(ranged, "ranges")
    runs = made.groupBy(*GROUP, F.shiftright("_id", 33).alias("_part")).agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    group = Window.partitionBy(*GROUP)
    placed = runs.withColumn("_shift", F.sum("_n").over(group.orderBy("_part")) - F.col("_n") - F.col("_least")).withColumn("n", F.sum("_n").over(group))
    met = made.withColumn("_part", F.shiftright("_id", 33)).join(placed.select(*GROUP, "_part", "_shift", "n"), [*GROUP, "_part"])
    return met.withColumn("at", F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")


def _hash(*parts: bytes) -> bytes:
    """SHA-256 of the digests' hex texts, concatenated."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def block_levels(digests: list[bytes], fanout: int, levels: int | None) -> list[list[bytes]]:
    """All nodes of a block, leaves first: ``levels`` levels up, or (None) until one node is left."""
    made = [digests]
    while len(made[-1]) > 1 if levels is None else len(made) <= levels:
        below = made[-1]
        made.append([_hash(*below[k : k + fanout]) for k in range(0, len(below), fanout)])
    return made


def inner_levels(nodes: pd.DataFrame, fanout: int, levels: int) -> list[list[bytes]]:
    """A block's levels: all of them if its group goes on above, else until one node is left."""
    return block_levels([bytes(d) for d in nodes["digest"]], fanout, levels if nodes["n"].iloc[0] > fanout**levels else None)


def siblings(levels: list[list[bytes]], at: int, fanout: int) -> tuple[list[bytes], list[bytes]]:
    """The other nodes of the run at each level below the block's root: to the left and to the right, as joined digests."""
    lefts, rights = [], []
    for nodes in levels[:-1]:
        first = at - at % fanout
        lefts.append(b"".join(nodes[first:at]))
        rights.append(b"".join(nodes[at + 1 : first + fanout]))
        at //= fanout
    return lefts, rights


def path_copies(digest: bytes, lefts: list[bytes], rights: list[bytes]) -> list[bytes]:
    """A version's own nodes: the changed leaf, then a copy of each ancestor, whose other children are the shared nodes."""
    copies = [digest]
    for left, right in zip(lefts, rights, strict=True):
        copies.append(_hash(left, copies[-1], right))
    return copies


class Tree:
    """A tree per group (named, name) over digests in order, stored as the nodes at block boundaries.

    ``tiers[0]`` holds the leaves with at and n, and whatever columns came along; each later tier the roots of the
    aligned blocks of the one before, until every group has one node left: its root, in ``tiers[-1]``. What lies
    within a block is computed again where it is needed, from at most fanout ** levels nodes, so a tree of any size is
    stored as little more than its leaves, and no group meets in one task.
    """

    def __init__(self, leaves: DataFrame, order: list[str], fanout: int = FANOUT, levels: int = BLOCK_LEVELS):
        self.fanout, self.levels, self.size = fanout, levels, fanout**levels
        self.tiers = [written(numbered(leaves, order), "leaves")[0]]
        n = self.tiers[0].agg(F.max("n")).first()[0] or 0
        while True:
            self.tiers.append(written(self._block_roots(self.tiers[-1]), "roots")[0])
            n = -(-n // self.size)
            if n <= 1:
                return

    def _blocks(self, tier: DataFrame) -> DataFrame:
        return tier.withColumn("block", F.floor(F.col("at") / self.size).cast("long")).withColumn("slot", (F.col("at") % self.size).cast("int"))

    def _block_roots(self, tier: DataFrame) -> DataFrame:
        fanout, levels, size = self.fanout, self.levels, self.size

        def root(nodes: pd.DataFrame) -> pd.DataFrame:
            nodes = nodes.sort_values("slot")
            first = nodes.iloc[0]
            return pd.DataFrame({"named": [bool(first["named"])], "name": [first["name"]], "at": [int(first["block"])], "n": [-(-int(first["n"]) // size)], "digest": [inner_levels(nodes, fanout, levels)[-1][0]]})

        return self._blocks(tier).select(*GROUP, "n", "block", "slot", "digest").groupBy(*GROUP, "block").applyInPandas(root, "named boolean, name string, at long, n long, digest binary")

    def down(self, tier: int, above: DataFrame, each, schema: str, columns: list[str] = []) -> DataFrame:  # noqa: B006
        """``each(nodes, levels, sides, path)`` of every block of a tier: its nodes in order with the named columns, its
        levels, the siblings from each node to the root of all, and its row of ``above``, the paths of the next tier's nodes."""
        fanout, n_levels = self.fanout, self.levels
        nodes = self._blocks(self.tiers[tier]).select(*GROUP, "at", "n", "block", "slot", "digest", *columns)
        paths = above.withColumnRenamed("at", "block")

        def run(nodes: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
            nodes, path = nodes.sort_values("slot").reset_index(drop=True), path.iloc[0]
            levels = inner_levels(nodes, fanout, n_levels)
            up_left, up_right = ([bytes(x) for x in path[side]] for side in ("lefts", "rights"))
            own = (siblings(levels, k, fanout) for k in range(len(nodes)))
            return each(nodes, levels, [(a + up_left, b + up_right) for a, b in own], path)

        return nodes.groupBy(*GROUP, "block").cogroup(paths.groupBy(*GROUP, "block")).applyInPandas(run, schema)

    def paths(self, roots: DataFrame, tier: int = 1) -> DataFrame:
        """PATH of each node of a tier, from that of the groups' roots, tier by tier downwards."""

        def each(nodes: pd.DataFrame, levels: list, sides: list, path: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({"named": nodes["named"], "name": nodes["name"], "at": nodes["at"], "lefts": [a for a, _ in sides], "rights": [b for _, b in sides], "subroot": path["subroot"], "root": path["root"]})

        for k in range(len(self.tiers) - 2, tier - 1, -1):
            roots, _ = written(self.down(k, roots, each, PATH), "paths")
        return roots


class Manifest:
    """A tree per group of leaves under one tree over the groups' roots, the groups in order of (named, name)."""

    def __init__(self, leaves: DataFrame, order: list[str], fanout: int = FANOUT, levels: int = BLOCK_LEVELS):
        """leaves: named boolean, name string (empty where not named), digest binary, the order columns and any others."""
        self.groups = Tree(leaves, order, fanout, levels)
        roots = self.groups.tiers[-1].select(F.lit(True).alias("named"), F.lit("").alias("name"), F.struct("named", "name").alias("group"), "digest")
        self.top = Tree(roots, ["group"], fanout, levels)

    def root(self) -> DataFrame:
        """The root as hex; no row for an empty table."""
        return self.top.tiers[-1].select(F.lower(F.hex("digest")).alias("root"))

    def paths(self) -> DataFrame:
        """PATH of each block of leaves: what stands beside its way to the root at each level, its group's root, and the root."""
        none = F.array().cast("array<binary>")
        top = self.top.paths(self.top.tiers[-1].select(*GROUP, "at", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root")))

        def of_groups(nodes: pd.DataFrame, levels: list, sides: list, path: pd.Series) -> pd.DataFrame:
            group = pd.DataFrame(list(nodes["group"]))
            return pd.DataFrame({"named": group["named"], "name": group["name"], "at": 0, "lefts": [a for a, _ in sides], "rights": [b for _, b in sides], "subroot": nodes["digest"], "root": path["root"]})

        return self.groups.paths(written(self.top.down(0, top, of_groups, PATH, ["group"]), "paths")[0])

    def versions(self, keep: list[str], changed: str = "changed") -> DataFrame:
        """One row per leaf: keep, leaf, subroot, root, proof_sha256, folded_root, verified, copies (digests as hex).

        Each leaf whose ``changed`` digest is another one is a version of the whole tree. copies are its own nodes, from
        leaf to root; all others are the tree's: ancestors within the leaf's aligned block stand on that block's nodes,
        and the version goes on above it over the nodes of the block's path, in as many tasks as there are blocks.
        Leaves that stay as they are fold over the same siblings and have no copies.
        """
        kinds = dict(self.groups.tiers[0].dtypes)

        def each(nodes: pd.DataFrame, levels: list, sides: list, path: pd.Series) -> pd.DataFrame:
            out = []
            for own, new, (lefts, rights) in zip(levels[0], nodes[changed], sides, strict=True):
                new = own if new is None else bytes(new)
                copies = path_copies(new, lefts, rights)
                proof = hashlib.sha256("".join(a.hex() + b.hex() for a, b in zip(lefts, rights, strict=True)).encode()).hexdigest()
                out.append((own.hex(), path["subroot"].hex(), path["root"].hex(), proof, copies[-1].hex(), copies[-1] == path["root"], [c.hex() for c in copies] if new != own else []))
            made = pd.DataFrame(out, columns=["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "copies"])
            return pd.concat([nodes[keep], made], axis=1)

        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copies array<string>"])
        return self.groups.down(0, self.paths(), each, schema, [*keep, changed])


def leaves_of(docs: DataFrame, columns: tuple[str, ...], source_col: str, tampered: dict[str, Column], when: Column) -> DataFrame:
    """Narrow leaves of docs: named, name, id, digest, and changed: the digest with the tampered columns where ``when`` holds."""
    at = {c: docs[f"`{c}`"] for c in columns}
    source = at[source_col].cast("string")
    return docs.select(
        source.isNotNull().alias("named"), F.coalesce(source, F.lit("")).alias("name"), at[columns[0]].alias("id"), leaf_digest(list(at.values())).alias("digest"),
        F.when(when, leaf_digest([tampered.get(c, at[c]) for c in columns])).alias("changed"),
    )


def tampered_manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text", fanout: int = FANOUT, levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, copies.

    Leaves are digests of id, source, language, length and text; within a source they ascend by id (null first, then by
    digest; rows alike throughout may stand either way, with the same digests in the tree). Rows whose id's CRC-32 is
    even are tampered with: their text loses its line feeds. A null id is never tampered with. Null columns count as
    ``-``; a null source is a source of its own, first in order; repeated rows are leaves of their own; other columns
    take no part; an empty table gives no rows.
    """
    id_, text = docs[f"`{id_col}`"], docs[f"`{text_col}`"]
    found = leaves_of(docs, (id_col, source_col, lang_col, chars_col, text_col), source_col, {text_col: F.translate(text, "\n", "")}, F.crc32(id_.cast("string")) % 2 == 0)
    return Manifest(found, ["id", "digest"], fanout, levels).versions(["id"]).withColumnRenamed("id", "doc_id")


_VALUE = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}"))
#: DuckDB has no CRC-32: bit by bit over the id's digits.
_CRC = (
    "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), "
    "lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END)"
)

MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, source IS NOT NULL AS named, coalesce(source, '') AS name, sha256({_LEAF.format('text')}) AS leaf, coalesce(xor({_CRC}, 4294967295) % 2 = 0, false) AS hit,
    sha256({_LEAF.format("replace(text, chr(10), '')")}) AS other FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY named, name ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t AS (SELECT named, name, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY named, name) AS n FROM leaves
      UNION ALL
      SELECT named, name, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY named, name, level, pos // 3),
subroots AS (SELECT named, name, h, row_number() OVER (ORDER BY named, name) - 1 AS pos FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, h, count(*) OVER () AS n FROM subroots
      UNION ALL
      SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY level, pos // 3),
nodes AS (SELECT named, name, level, pos, h, n FROM t UNION ALL SELECT NULL, NULL, level, pos, h, n FROM u),
beside AS (SELECT *, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
             coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
           FROM nodes WINDOW r AS (PARTITION BY named, name, level, pos // 3 ORDER BY pos)),
inner_up AS (SELECT doc_id, leaf, named, name, 0 AS level, pos, '' AS proof, CASE WHEN hit THEN other ELSE leaf END AS f FROM leaves
      UNION ALL
      SELECT doc_id, leaf, p.named, p.name, p.level + 1, p.pos // 3, proof || l || r, sha256(l || f || r) FROM inner_up p JOIN beside b ON b.named = p.named AND b.name = p.name AND b.level = p.level AND b.pos = p.pos WHERE b.n > 1),
rose AS (SELECT doc_id, leaf, s.h AS subroot, s.pos, proof, f FROM inner_up p JOIN t ON t.named = p.named AND t.name = p.name AND t.level = p.level AND t.n = 1 JOIN subroots s ON s.named = p.named AND s.name = p.name),
outer_up AS (SELECT doc_id, leaf, subroot, 0 AS level, pos, proof, f FROM rose
      UNION ALL
      SELECT doc_id, leaf, subroot, p.level + 1, p.pos // 3, proof || l || r, sha256(l || f || r) FROM outer_up p JOIN beside b ON b.named IS NULL AND b.level = p.level AND b.pos = p.pos WHERE b.n > 1)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = u.h AS verified FROM outer_up p JOIN u ON u.n = 1 AND u.level = p.level
"""

"""Embedding near-dedup: an exact metric range join over pivot cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import connected_components, written

#: Vectors of a cell, or of those that reach it, that one task holds of either.
BLOCK = 8192
#: Vectors a pivot stands for, and bounds on the number of pivots of one dimension.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 8192, 8, 4096
CELLS = "uid long, n long, dim int, vec binary, cell int, angle double"
ROWS = 1024


def _unit(cells: pd.Series):
    """Rows of unit length in double precision."""
    import numpy as np

    x = np.frombuffer(b"".join(cells), dtype="<f8").reshape(len(cells), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(x, pivots):
    import numpy as np

    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def near_pairs(own, rep, own_uid, rep_uid, mult, least: float):
    """(links of each own row weighted by mult, forest edges): rows of two blocks with a cosine of ``least`` or more.

    Products in single precision decide all but a band around ``least`` wider than their error; pairs in the band are
    decided in double precision. Hits are folded into a union-find slice by slice, so that a dense block costs a
    slice's bits and gives at most one edge per row.
    """
    import numpy as np

    links = np.zeros(len(own), dtype=np.int64)
    parent = np.arange(len(own) + len(rep))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def unite(pairs) -> None:
        for a, b in pairs:
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)

    a32, b32 = own.astype(np.float32), rep.astype(np.float32)
    band = max(1e-4, own.shape[1] * 2.0**-22)
    for k in range(0, len(own), ROWS):
        s = a32[k : k + ROWS] @ b32.T
        hit = s >= least - band
        rows = np.flatnonzero(hit.any(axis=1))
        if not len(rows):
            continue
        s, hit = s[rows], hit[rows]
        i, j = np.nonzero(hit & (s < least + band))
        if len(i):
            hit[i, j] = np.einsum("ij,ij->i", own[k + rows[i]], rep[j]) >= least
        hit &= own_uid[k + rows][:, None] != rep_uid[None, :]
        rows, hit = rows[any_ := hit.any(axis=1)], hit[any_]
        if not len(rows):
            continue
        links[k + rows] = hit @ mult
        cols = np.flatnonzero(hit.any(axis=0))
        unite(zip((k + rows).tolist(), (len(own) + hit.argmax(axis=1)).tolist(), strict=True))
        unite(zip((len(own) + cols).tolist(), (k + rows[hit[:, cols].argmax(axis=0)]).tolist(), strict=True))
        of = np.array([root(a) for a in (k + rows).tolist()]), np.array([root(len(own) + a) for a in cols.tolist()])
        i, j = np.nonzero(hit[:, cols] & (of[0][:, None] != of[1][None, :]))
        unite(set(zip(of[0][i].tolist(), of[1][j].tolist(), strict=True)))
    uid = np.concatenate([own_uid, rep_uid])
    roots = np.array([root(a) for a in range(len(parent))])
    moved = np.flatnonzero(roots != np.arange(len(parent)))
    return links, np.stack([uid[moved], uid[roots[moved]]], axis=1)


def vector_links(embeddings: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept.

    Vectors link when their cosine, in double precision, is ``least`` or more. Null, empty, zero and non-finite vectors
    (or with null components) link with nothing, nor do vectors of unlike dimension. Equal vectors count as links and
    are compared once. Repeated ids are rows of their own that share a component. component_id is the smallest id
    reachable, the own id without links; a null id stays null unless linked. An empty table gives no rows.

    Each vector belongs to the cell of its nearest pivot. By the triangle inequality a vector within the link angle of
    a member of a cell lies within the cell's radius plus that angle of its pivot, so that is where it is sent besides.
    A cell's members meet what reaches it in blocks of bounded size; each task counts its members' links and gives a
    forest. Pivots are a sample by hash, MOST_PIVOTS at most for a dimension; radii and counts are one row per cell.
    """
    spark = embeddings.sparkSession
    v = F.col(f"`{vec_col}`").cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.when(sound, v).alias("v"))
    unlike = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"))
    unlike, _ = written(unlike.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    counts = {r["dim"]: r["count"] for r in unlike.groupBy(F.size("v").alias("dim")).count().collect()}
    pivots = {}
    for dim, n in counts.items():
        k = max(LEAST_PIVOTS, min(MOST_PIVOTS, n // PER_PIVOT))
        pivots[dim] = [r["v"] for r in unlike.where(F.size("v") == dim).orderBy(F.xxhash64("uid"), "uid").select("v").limit(k).collect()]

    def unit_pivots() -> dict:
        import numpy as np

        return {d: _unit(pd.Series([np.asarray(p, dtype="<f8").tobytes() for p in ps])) for d, ps in pivots.items()}

    base = {}
    for d in sorted(pivots):
        base[d] = sum(len(pivots[x]) for x in pivots if x < d)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        at = unit_pivots()
        for batch in batches:
            for dim, part in batch.groupby(batch["v"].map(len)):
                packed = [np.asarray(x, dtype="<f8").tobytes() for x in part["v"]]
                angle = _angles(_unit(pd.Series(packed)), at[dim])
                near = angle.argmin(axis=1)
                yield pd.DataFrame({"uid": part["uid"].to_numpy(), "n": part["n"].to_numpy(), "dim": dim, "vec": packed, "cell": near + base[dim], "angle": angle[np.arange(len(near)), near]})

    cells, _ = written(unlike.select("uid", "n", "v").mapInPandas(assign, CELLS), "cells", 4096)
    radius = {r["cell"]: (r["r"], r["n"]) for r in cells.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect()}
    reach = math.acos(least) + 1e-6

    def reached(batch: pd.DataFrame, dim: int, at: dict):
        """Booleans (vectors x pivots): own cell or within the cell's radius and the link angle."""
        import numpy as np

        r = np.array([radius.get(base[dim] + p, (-9.0, 0))[0] for p in range(len(pivots[dim]))])
        return _angles(_unit(batch["vec"]), at[dim]) <= r[None, :] + reach

    def count_reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = unit_pivots()
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                n = reached(part, dim, at).sum(axis=0)
                yield pd.DataFrame({"cell": range(base[dim], base[dim] + len(n)), "n": n})

    reps = {r["cell"]: r["n"] for r in cells.select("dim", "vec").mapInPandas(count_reached, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    shape = {c: (-(-n // block), -(-max(reps.get(c, 0), 1) // block)) for c, (_, n) in radius.items()}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        at = unit_pivots()
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                uid, n, vec, cell = (part[c].to_numpy() for c in ("uid", "n", "vec", "cell"))
                mixed = (uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                to = reached(part, dim, at)
                for c in range(to.shape[1]):
                    if base[dim] + c not in shape:
                        continue
                    own_blocks, rep_blocks = shape[base[dim] + c]
                    for rep, here, blocks, others in ((False, np.flatnonzero(cell == base[dim] + c), own_blocks, rep_blocks), (True, np.flatnonzero(to[:, c]), rep_blocks, own_blocks)):
                        if not len(here):
                            continue
                        mine = (mixed[here] % np.uint64(blocks)).astype(np.int64)
                        for o in range(others):
                            i, j = (np.full(len(here), o), mine) if rep else (mine, np.full(len(here), o))
                            yield pd.DataFrame({"cell": base[dim] + c, "i": i, "j": j, "rep": rep, "uid": uid[here], "n": n[here], "vec": vec[here]})

    def match(group: pd.DataFrame) -> pd.DataFrame:
        own, rep = group[~group["rep"]], group[group["rep"]]
        if not len(own) or not len(rep):
            return pd.DataFrame({"uid": [], "links": [], "peer": []}).astype("Int64")
        links, edges = near_pairs(_unit(own["vec"]), _unit(rep["vec"]), own["uid"].to_numpy(), rep["uid"].to_numpy(), rep["n"].to_numpy(), least)
        counted = pd.DataFrame({"uid": own["uid"].to_numpy(), "links": links})[links > 0]
        return pd.concat([counted, pd.DataFrame(edges, columns=["uid", "peer"])])[["uid", "links", "peer"]].astype("Int64")

    found, _ = written(cells.select("uid", "n", "dim", "vec", "cell").mapInPandas(deal, "cell int, i int, j int, rep boolean, uid long, n long, vec binary").groupBy("cell", "i", "j").applyInPandas(match, "uid long, links long, peer long"), "links", 4096)
    linked = connected_components(found.where("peer is not null").select(F.col("uid").alias("src"), F.col("peer").alias("dst")))
    ids = unlike.select("uid", "least_id")
    groups = linked.join(ids, linked.id == ids.uid).groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = linked.join(groups, "component").select(F.col("id").alias("uid"), "component_id")
    sums = found.where("links is not null").groupBy("uid").agg(F.sum("links").alias("links"))
    told = unlike.join(sums, "uid", "left").join(named, "uid", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    out = rows.join(told, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

"""Best-fit packing of token pieces into sequences, in bulk-synchronous supersteps over size classes."""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import class_ranks, salts
from .util import written

#: Entries of each of the two generations of a worker's table of encoded words.
MEMO = 300_000
PIECES = "doc_id long, loc_row long, piece int, start long, length long, ids_crc32 long"


def byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in plain else next(rest) for b in range(256)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by the library's tokenizer.

    Where one space or one line feed stands between two characters that aren't white space, byte-level BPE's own
    split ends a unit (the space belongs to the next one), so the units between are encoded apart and remembered.
    A Latin word is one unit of the split and goes to the tokenizer's model directly; a final full stop or comma is
    a unit of its own; anything else, and lines with other white space at a unit's edge, goes to the whole tokenizer.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.memo: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def unit(self, key: str) -> bytes | None:
        """Ids of a unit, with the space before it; None if it can't be encoded apart."""
        found = self.memo.get(key, self)
        if found is not self:
            return found
        found = self.older.get(key, self)
        if found is self:
            found = self.fresh(key)
        if len(self.memo) >= MEMO:
            self.memo, self.older = {}, self.memo
        self.memo[key] = found
        return found

    def fresh(self, key: str) -> bytes | None:
        own = key[1:] if key[:1] == " " else key
        if not own or own[0].isspace() or own[-1].isspace():
            return None
        if own.isalpha() and max(own) < "\u0250":
            return self.packed([t.id for t in self.model.tokenize(key.encode().decode("latin-1").translate(self.letters))])
        if own[-1] in ".," and own[:-1].isalpha() and max(own) < "\u0250":
            return self.unit(key[:-1]) + self.unit(own[-1])
        return self.whole(key)

    def line(self, line: str) -> bytes:
        keys = line.replace(" ", "\0 ").split("\0") if "\0" not in line else ["", ""]
        try:
            return b"".join(map(self.memo.__getitem__, keys))
        except (KeyError, TypeError):
            found = list(map(self.unit, keys))
        return self.whole(line) if None in found else b"".join(found)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        lines = text.split("\n")
        if any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            return self.whole(text) if len(lines) == 1 else self.loose(lines)
        return self.feed.join(map(self.line, lines))

    def loose(self, lines: list[str]) -> bytes:
        """Joins lines with white space at an edge to their neighbours, and encodes the parts between plain line feeds."""
        parts, held = [], [lines[0]]
        for a, b in zip(lines, lines[1:], strict=False):
            if a and b and not a[-1].isspace() and not b[0].isspace():
                parts.append("\n".join(held))
                held = [b]
            else:
                held.append(b)
        parts.append("\n".join(held))
        return self.feed.join(self.line(p) if "\n" not in p and p and not p[0].isspace() and not p[-1].isspace() else self.whole(p) for p in parts)


@functools.lru_cache(maxsize=2)
def worker_encoder(tokenizer_file: str) -> Encoder:
    """One encoder for a worker process, so that its table serves all of the process's tasks."""
    return Encoder(tokenizer_file)


def token_pieces(docs: DataFrame, tokenizer_file: str, most: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES: a text's ids and end_id, cut from the end into pieces of ``most``; only the first may be shorter."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(tokenizer_file)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            out = []
            for doc_id, at, text in zip(batch["doc_id"], batch["loc_row"], batch["text"], strict=True):
                ids = encoder.encode(text) + end
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - start) % most or most
                    out.append((doc_id, at, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, piece = start + length, piece + 1
            frame = pd.DataFrame(out, columns=["doc_id", "loc_row", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("loc_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, PIECES)


def best_fit(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counted sizes: (size, first rank, last rank, sequence of the first rank, offset).

    One superstep per size, largest first. Gaps are sorted runs of equal gaps over consecutive sequences. A superstep
    sweeps from the size to its successor gaps: the k-th row of the size takes the k-th gap, so no two rows want one
    gap; what a gap has left is a gap again; rows that found none open sequences. The plan has no entry per row: its
    length depends on sizes, of which there are ``most`` at most.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    plan, opened = [], 0
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left, rank = counts[size], 1
        while left:
            gap = next((g for g in range(size, most + 1) if gaps.get(g)), None)
            if gap is None:
                n = -(-left // (most // size))
                gap, run = most, (opened, n)
                opened += n
            else:
                run = gaps[gap].pop()
            first, n = run
            used = min(n, left)
            plan.append((size, rank, rank + used - 1, first, most - gap))
            if used < n:
                gaps.setdefault(gap, []).append((first + used, n - used))
            if gap > size:
                gaps.setdefault(gap - size, []).append((first, used))
            left, rank = left - used, rank + used
    return plan


def pack(pieces: DataFrame, most: int = 1024) -> DataFrame:
    """pieces (PIECES) with sequence_id and offset; the pieces of a sequence lie gapless from 0.

    Sizes are integers up to ``most``, so the range-sort is a counting sort: rows get their rank within their size
    by salted parts, the driver gets ``most`` counts and gives back the plan's runs. Each run joins its rows by size
    and the block of ranks that it overlaps, so neither a common size nor a long run meets in one task.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    n = sum(counts.values())
    runs = best_fit(counts, most)
    block = max(1024, n // 4096)
    cut = [(s, b, a, z, q, o) for s, a, z, q, o in runs for b in range(a // block, z // block + 1)]
    plan = spark.createDataFrame(cut, "length long, block long, first long, last long, seq long, offset long")
    ranked = class_ranks(pieces, ["length"], "doc_id", salts(n), ("piece", "loc_row")).withColumn("block", F.floor(F.col("rank") / block))
    return ranked.join(plan, ["length", "block"]).where("rank between first and last").withColumn("sequence_id", F.col("seq") + F.col("rank") - F.col("first")).drop("rank", "block", "first", "last", "seq")


def best_fit_packing(docs: DataFrame, tokenizer_file: str, most: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every row of docs, placed.

    A null text is empty and is the single end id; a null id is kept; repeated rows are packed as often as they occur;
    an empty table gives no rows. Texts of any length are cut, never dropped.
    """
    pieces, _ = written(token_pieces(docs, tokenizer_file, most, end_id, id_col, text_col), "pieces")
    return pack(pieces, most).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

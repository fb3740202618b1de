"""Chat formatting of reply trees: root-to-leaf paths by iterated self-joins, ranked, one conversation per chosen path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import remove, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Beginnings and whole forms of control strings. Inside texts a backslash follows the first character.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
TRAINED_ROLE = "assistant"


def escaped(text) -> F.Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescaped(text) -> F.Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def linear_tree(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(tree, node, parent, score, role, text): each turn replies to the one before; ties by role, then text; null turns first."""
    role, text = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = turns.select(F.col(f"`{conv_col}`").alias("tree"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
    numbered = rows.withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, depth): the nodes of each tree's ``branches`` best root-to-leaf paths.

    nodes: tree, node, parent, score; a tree's nodes are unique, in any order of ids. A node whose parent is null, itself
    or not in the tree is a root; where parents run in a circle, the circle's smallest node becomes a root. Each self-join
    doubles the distance to the ancestor that a node knows, with the score on the way, and a node that has reached its
    root takes no part any more; the same tables, taken downwards, enumerate the chosen leaves' paths. Joins are on
    single nodes, so a large tree is spread; each round is a table in the shared folder. Leaves rank by total score,
    then depth, then node.
    """
    spark, same = nodes.sparkSession, F.col("tree").eqNullSafe(F.col("t2"))
    bare = nodes.select("tree", "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score"))
    known = bare.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    firm = bare.join(known, same & (F.col("parent") == F.col("n2")), "left")
    now, path = written(firm.select("tree", "node", F.col("n2").alias("anc"), F.when(F.col("n2").isNull(), 0).otherwise(1).cast("long").alias("depth"), "score", F.least("node", "n2").alias("low")), "reach")
    done, open_, jumps, paths = now.where("anc is null"), now.where("anc is not null"), [], [path]
    largest = None
    while open_.limit(1).count():
        if largest is None:
            largest = now.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if 1 << len(jumps) >= 2 * largest:
            # no chain is longer than its tree: who is open still is in a circle or below one, and has seen all of it
            circle = open_.select(F.col("tree").alias("t2"), F.col("anc").alias("n2")).distinct()
            cut, _ = written(open_.join(circle, same & (F.col("node") == F.col("n2")), "left_semi").where("node = low").select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.lit(1).alias("cut")), "cut")
            remove(spark, *paths)
            mended = bare.join(cut, same & (F.col("node") == F.col("n2")), "left").select("tree", "node", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"), "score")
            return best_paths(mended, branches)
        jumps.append(open_.select("tree", "node", "anc"))
        up = open_.union(done).select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("anc").alias("a2"), F.col("depth").alias("d2"), F.col("score").alias("s2"), F.col("low").alias("l2"))
        step = open_.join(up, same & (F.col("anc") == F.col("n2")))
        now, path = written(step.select("tree", "node", F.col("a2").alias("anc"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("score") + F.col("s2")).alias("score"), F.least("low", "l2").alias("low")), "reach")
        done, open_ = done.union(now.where("anc is null")), now.where("anc is not null")
        paths.append(path)
    leaves = done
    if jumps:
        inner = jumps[0].select(F.col("tree").alias("t2"), F.col("anc").alias("p2"))
        leaves = done.join(inner, same & (F.col("node") == F.col("p2")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("depth").desc(), "node"))
    chosen, path = written(leaves.withColumn("rank", rank).where(F.col("rank") <= branches).select("tree", F.col("node").alias("leaf"), "rank", "node", "depth"), "paths")
    distance = 1
    for jump in jumps:
        on = jump.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "anc")
        more = chosen.join(on, same & (F.col("node") == F.col("n2"))).select("tree", "leaf", "rank", F.col("anc").alias("node"), (F.col("depth") - distance).alias("depth"))
        grown, to = written(chosen.union(more), "paths")
        remove(spark, path)
        chosen, path, distance = grown, to, 2 * distance
    remove(spark, *paths)
    return chosen


def format_paths(nodes: DataFrame, branches: int = 1, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans): one conversation for each chosen path.

    A turn is OPEN role, line feed, text, CLOSE; backslashes, control strings and a role's line feeds are escaped, and
    unescaped() reverses that. loss_spans are [start, end) of the trained role's texts, in code points of formatted.
    A conversation is one row, so its turns meet in one task; nothing else of its tree does.
    """
    chosen = best_paths(nodes, branches)
    role, text = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), escaped(F.col("text"))
    told = nodes.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "role", "text")
    turns = chosen.join(told, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2"))).select("tree", "leaf", "rank", "depth", (F.col("role") == trained_role).alias("trained"), F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), text.alias("body"))
    length = F.length("head") + F.length("body") + len(CLOSE)
    end = F.sum(length).over(Window.partitionBy("tree", "leaf", "rank").orderBy("depth")) - len(CLOSE)
    placed = turns.withColumn("end", end).select("tree", "leaf", "rank", F.struct("depth", F.concat("head", "body", F.lit(CLOSE)).alias("turn"), "trained", (F.col("end") - F.length("body")).alias("start"), "end").alias("x"))
    whole = placed.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list("x")).alias("x"))
    spans = F.transform(F.filter("x", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return whole.select("tree", "leaf", "rank", F.array_join(F.transform("x", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(conversations: DataFrame) -> DataFrame:
    """tree, turns (array of role, text) and loss_text, from formatted and loss_spans alone."""
    parts = F.transform(F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != ""), lambda p: F.substr(p, F.lit(len(OPEN) + 1)))
    head = lambda p: F.regexp_extract(p, r"^((?:[^\\\n]++|\\[\s\S])*+)\n", 1)
    turns = F.transform(parts, lambda p: F.struct(unescaped(head(p)).alias("role"), unescaped(F.substr(p, F.length(head(p)) + 2)).alias("text")))
    # as UTF-32 a span is a slice of bytes, so that a long conversation isn't searched once per span; the mark before it is what the decoder drops, not a U+FEFF of the text
    wide = F.encode("formatted", "UTF-32")
    loss = F.transform("loss_spans", lambda s: F.decode(F.concat(F.lit(bytearray(b"\x00\x00\xfe\xff")), F.call_function("substring", F.col("wide"), (s["start"] * 4 + 1).cast("int"), ((s["end"] - s["start"]) * 4).cast("int"))), "UTF-32"))
    return conversations.withColumn("wide", wide).select("tree", "leaf", "rank", "formatted", turns.alias("turns"), F.array_join(F.transform(loss, unescaped), "").alias("loss_text"))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted output.

    Null roles and texts are empty, null turns come first, repeated rows are turns of their own, rows with a null
    conversation are one conversation, an empty table gives no rows, other columns are not read.
    """
    tree, _ = written(linear_tree(turns), "turns")
    back = read_back(format_paths(tree))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


DIGEST_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{TRAINED_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = '{TRAINED_ROLE}'), '')) AS loss_sha256,
       sum({len(OPEN)} + length(replace({_sql_escape("role")}, chr(10), '\\' || chr(10))) + 1 + length({_sql_escape("text")}) + {len(CLOSE)})::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""

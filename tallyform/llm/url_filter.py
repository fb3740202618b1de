"""URL filters in time: dated list entries become validity intervals, an as-of join evaluates each capture at its fetch time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to) of entries (list, key, action add or remove, day).

    An addition holds from its day until the next event of the same list and key (null: it still holds). On one day
    a removal comes after an addition. Keys are hosts (for their subdomains too) or host and path; case counts in paths alone. Null or empty keys,
    null days and other actions are left out; repeated entries change nothing.
    """
    host = F.substring_index("key", "/", 1)
    sound = entries.select(F.col("list"), F.concat(F.lower(host), F.substr("key", F.length(host) + 1)).alias("key"), "action", F.col("day").cast("date").alias("day")).where("key <> '' and day is not null and action in ('add', 'remove')").distinct()
    last = sound.groupBy("list", "key", "day").agg(F.max("action").alias("action"))
    after = F.lead("day").over(Window.partitionBy("list", "key").orderBy("day"))
    return last.withColumn("valid_to", after).where("action = 'add'").select("list", "key", F.col("day").alias("valid_from"), "valid_to")


def host_of(url) -> F.Column:
    """Lower-case host without user, port and trailing dot; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), r"\.$", ""))


def path_of(url) -> F.Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def as_of_verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, day) with host, blocked, n_entries and lists (sorted names) active on the day.

    Verdicts are made once per (host, path, day). The keys of a capture are its host, every parent domain, and host
    with path; they join the intervals by key, and the day picks. Parent domains gather many hosts, so each host is first
    told which of its keys any list holds, from narrow distinct pairs; days join only those. A null or unreadable URL or a null day is not blocked.
    Every capture gives one row, repeated ones too.
    """
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("day").cast("date").alias("day"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    held = intervals(entries)
    listed = held.select("key").distinct()
    deep = listed.where("instr(key, '/') > 0")
    told_hosts = rows.where("host <> ''").select("host").distinct().withColumn("key", F.explode(parents)).join(listed, "key", "left_semi")
    by_host = rows.where("host <> '' and day is not null").select("host", "day").distinct().join(told_hosts, "host")
    by_path = rows.where("host <> '' and path <> '' and day is not null").select("host", "path", "day").distinct().withColumn("key", F.concat("host", "path")).join(deep, "key", "left_semi")
    active = (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    on_host = by_host.join(held, "key").where(active).groupBy("host", "day").agg(F.count("*").alias("n_host"), F.collect_set("list").alias("host_lists"))
    on_path = by_path.join(held, "key").where(active).groupBy("host", "path", "day").agg(F.count("*").alias("n_path"), F.collect_set("list").alias("path_lists"))
    told = rows.join(on_host, ["host", "day"], "left").join(on_path, ["host", "path", "day"], "left")
    n = F.coalesce("n_host", F.lit(0)) + F.coalesce("n_path", F.lit(0))
    names = F.array_sort(F.array_union(F.coalesce("host_lists", F.array().cast("array<string>")), F.coalesce("path_lists", F.array().cast("array<string>"))))
    return told.select("page_id", "host", "day", (n > 0).alias("blocked"), n.alias("n_entries"), F.array_join(names, ",").alias("lists"))


# The dated list that the registered query applies.
ENTRIES = (
    ("adult", "adult-x.example.net", "add", "2024-01-15"), ("adult", "adult-x.example.net", "remove", "2024-06-01"), ("adult", "adult-x.example.net", "add", "2024-09-01"),
    ("spam", "spam-farm.example.org", "add", "2023-11-01"), ("spam", "spam-farm.example.org", "remove", "2024-10-01"),
    ("pharma", "cheap-pills.example.com", "add", "2024-03-01"), ("spam", "cheap-pills.example.com", "add", "2024-05-20"), ("spam", "cheap-pills.example.com", "remove", "2024-07-04"),
    ("network", "example.net", "add", "2024-12-01"), ("network", "example.net", "remove", "2024-12-10"),
    ("pages", "www.ththhe.example.com/en/687", "add", "2024-02-01"), ("pages", "m.ththth.example.net/en/25", "add", "2024-01-01"),
)
_VALUES = ", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in ENTRIES)
ENTRIES_SQL = f"SELECT * FROM (VALUES {_VALUES}) AS e(list, key, action, day)"
#: pages has no fetch time; the query derives a day of 2024 from the page's id.
FETCH_DAY_SQL = "DATE '2024-01-01' + CAST(page_id % 366 AS INT)"

VERDICT_SQL = rf"""
WITH e AS (SELECT list, key, day, max(action) AS action FROM ({ENTRIES_SQL}) GROUP BY ALL),
i AS (SELECT * FROM (SELECT list, key, action, day AS valid_from, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS valid_to FROM e) WHERE action = 'add'),
p AS (SELECT row_number() OVER () AS r, page_id, ({FETCH_DAY_SQL})::DATE AS day,
        lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), '\.$', '')) AS host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT r, count(*) AS n, list(list) AS names FROM p JOIN i ON (('.' || host) LIKE ('%.' || key) OR host || path = key) AND valid_from <= day AND (valid_to IS NULL OR day < valid_to) GROUP BY r)
SELECT page_id, host, day::VARCHAR AS day, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_entries, coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS lists
FROM p LEFT JOIN h USING (r)
"""

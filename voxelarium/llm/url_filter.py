"""URL filters as a temporal list join.

List entries are dated: a list holds a key from the day it was added until the day it was
removed.  Entries of one list and key that overlap are united to validity intervals.  A
key is a host, which stands for its subdomains too, or a host with the start of a path, by
whole segments; letter case counts in the path only.  Every capture asks for the keys its URL can match and is judged by the
entries that were active on the day it was fetched.

The as-of join is an equi-join: time is cut into periods, an interval becomes a row for
each period that it overlaps and in which a capture asks for its key, and a capture looks
only into its own.  A key with a long history, or a host with most captures, is thereby
spread over the periods, and what is left of the skew is split by the join itself.  The
decision depends on URL and day alone, so captures are reduced to distinct pairs first and
joined back, and need no id.

The longest active key decides; of equal keys an allowing entry wins over a blocking one.

Defined results: a null, empty or odd URL, or a null day, matches nothing and is not
blocked; an entry without key or with ``removed`` not after ``added`` is never active;
without ``added`` it was always there, without ``removed`` it stays; repeated captures and
entries do no harm; result columns replace input columns of the same name, other columns
pass through; empty captures or lists give empty or unblocked results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelarium.llm.common import carries, free_name, with_result
from voxelarium.storage import materialise

#: Days of a period of the as-of join.
PERIOD = 90
#: Days that stand for no beginning and no end.
_FIRST, _LAST = -(1 << 30), 1 << 30


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty for anything else."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.regexp_replace(F.lower(host), r"\.+$", ""), F.lit(""))


def url_segments(url: Column) -> Column:
    """Segments of the path, empty ones left out."""
    path = F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.filter(F.split(path, "/"), lambda s: s != "")


def entry_key(host: Column, segments: Column | None = None) -> Column:
    return F.concat_ws("/", host, segments) if segments is not None else host


def matching_keys(host: Column, segments: Column, depth: int) -> Column:
    """Keys that a URL matches: its host and parent domains of two labels or more, its path to ``depth`` segments."""
    labels = F.split(host, r"\.")
    count = F.when(host.rlike(r"^[0-9.]+$|^\[|^$"), 1).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))
    hosts = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    longest = F.least(F.size(segments), F.lit(depth))
    paths = F.when(
        longest > 0,
        F.transform(F.sequence(F.lit(1), longest), lambda i: F.concat_ws("/", host, F.slice(segments, 1, i))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(hosts, paths))


def validity(entries: DataFrame) -> DataFrame:
    """``list, key, allow, start, end`` (days, end exclusive) from ``list, key, allow, added, removed``.

    Same starts are combined first, so a window holds one row a day at most.
    """
    key = F.col("key").cast("string")
    host = F.substring_index(key, "/", 1)
    days = entries.select(
        F.col("list").cast("string").alias("list"),
        F.concat(F.lower(host), F.substring(key, F.char_length(host) + 1, F.char_length(key))).alias("key"),
        F.coalesce(F.col("allow"), F.lit(False)).alias("allow"),
        F.coalesce(F.unix_date("added"), F.lit(_FIRST)).alias("start"),
        F.coalesce(F.unix_date("removed"), F.lit(_LAST)).alias("end"),
    ).filter("key <> '' AND start < end")
    group = ["list", "key", "allow"]
    longest = days.groupBy(*group, "start").agg(F.max("end").alias("end"))
    by_start = Window.partitionBy(*group).orderBy("start")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = longest.withColumn("opens", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    islands = opens.withColumn("island", F.sum("opens").over(by_start))
    return islands.groupBy(*group, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def decisions(visits: DataFrame, entries: DataFrame, period: int = PERIOD) -> DataFrame:
    """For ``url, day`` with an active entry: ``lists``, ``rule`` and ``blocked``."""
    intervals = materialise(validity(entries), "list-intervals")
    depth = intervals.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    asked = visits.select(
        "url",
        "day",
        F.floor(F.col("day") / period).alias("period"),
        F.explode(matching_keys(url_host(F.col("url")), url_segments(F.col("url")), depth)).alias("key"),
    )
    # An interval is told only to the periods in which some capture asks for its key.
    periods = asked.select("key", "period").distinct()
    overlaps = (F.floor(F.col("start") / period) <= F.col("period")) & (F.col("period") <= F.floor((F.col("end") - 1) / period))
    active = materialise(intervals.join(periods, "key").filter(overlaps), "list-periods")
    now = (F.col("start") <= F.col("day")) & (F.col("day") < F.col("end"))
    best = F.max(F.struct(F.char_length("key").alias("size"), "allow", "key"))
    return (
        asked.join(active, ["key", "period"])
        .filter(now)
        .groupBy("url", "day")
        .agg(F.array_sort(F.collect_set("list")).alias("lists"), best.alias("best"))
        .select("url", "day", "lists", F.col("best.key").alias("rule"), (~F.col("best.allow")).alias("blocked"))
    )


@carries("url_column", "fetched_column")
def filter_urls(
    captures: DataFrame,
    entries: DataFrame,
    url_column: str = "url",
    fetched_column: str = "fetched",
    period: int = PERIOD,
) -> DataFrame:
    """``captures`` with ``lists`` (active ones that match, sorted), ``rule`` and ``blocked``."""
    day = free_name(captures.columns, "day_number")
    dated = captures.withColumn(day, F.unix_date(F.col(fetched_column).cast("date")))
    visits = materialise(
        dated.select(F.col(url_column).alias("url"), F.col(day).alias("day"))
        .filter("url IS NOT NULL AND day IS NOT NULL")
        .distinct(),
        "visits",
    )
    url, at, found, rule, blocked = (free_name([*captures.columns, day], f"decided_{c}") for c in ("url", "day", "lists", "rule", "blocked"))
    judged = materialise(decisions(visits, entries, period), "url-decisions").toDF(url, at, found, rule, blocked)
    joined = dated.join(judged, (dated[url_column] == judged[url]) & (dated[day] == judged[at]), "left")
    return with_result(
        joined,
        lists=F.coalesce(found, F.array().cast("array<string>")),
        rule=F.col(rule),
        blocked=F.coalesce(blocked, F.lit(False)),
    ).drop(day, url, at, found, rule, blocked)


#: The test tables have no lists and no fetch times; both are derived from the pages by these rules.
DAYS = 1460


def dated_captures(pages: DataFrame) -> DataFrame:
    offset = (F.col("page_id") * 7919 % DAYS).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2020-01-01").cast("date"), offset).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Three blocking lists (hosts, parent domains, paths) and an allowing one, as if reported by captures."""
    page, host, segments = F.col("page_id"), url_host(F.col("url")), url_segments(F.col("url"))
    kind = page % 50
    named = pages.withColumns({"host": host, "segments": segments}).filter((kind < 7) & (F.col("host") != ""))
    parent = F.regexp_replace("host", r"^[^.]+\.", "")
    name = F.when(kind == 0, "hosts").when(kind == 1, "domains").when(kind < 6, "paths").otherwise("allowed")
    key = (
        F.when(kind == 0, F.col("host"))
        .when(kind == 1, parent)
        .when(kind < 6, F.concat_ws("/", "host", F.slice("segments", 1, 1)))
        .otherwise(F.concat_ws("/", "host", "segments"))
    )
    added = F.date_add(F.lit("2020-01-01").cast("date"), (page * 31 % DAYS).cast("int"))
    removed = F.when(page % 3 != 0, F.date_add(added, (page % 40).cast("int")))
    removed = F.when(kind < 2, F.date_add(added, (page % 5 + 1).cast("int"))).otherwise(removed)
    return named.select(name.alias("list"), key.alias("key"), (kind == 6).alias("allow"), added.alias("added"), removed.alias("removed"))


def page_decisions(pages: DataFrame) -> DataFrame:
    """The registered form."""
    judged = filter_urls(dated_captures(pages), derived_entries(pages))
    return judged.select(
        "page_id",
        "url",
        F.date_format("fetched", "yyyy-MM-dd").alias("fetched"),
        F.array_join("lists", ",").alias("lists"),
        F.coalesce("rule", F.lit("")).alias("rule"),
        "blocked",
    )


_HOST = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '\.+$', '')"
_SEGMENTS = (
    r"list_filter(string_split(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')"
)
SQL = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, url, {_HOST} AS host, {_SEGMENTS} AS segs,
    DATE '2020-01-01' + CAST(page_id * 7919 % {DAYS} AS INTEGER) AS fetched, page_id % 50 AS kind,
    DATE '2020-01-01' + CAST(page_id * 31 % {DAYS} AS INTEGER) AS added FROM pages),
e AS (SELECT CASE WHEN kind = 0 THEN 'hosts' WHEN kind = 1 THEN 'domains' WHEN kind < 6 THEN 'paths' ELSE 'allowed' END AS list,
    CASE WHEN kind = 0 THEN host WHEN kind = 1 THEN regexp_replace(host, '^[^.]+\\.', '')
      WHEN kind < 6 THEN array_to_string([host] || segs[1:1], '/') ELSE array_to_string([host] || segs, '/') END AS key, kind = 6 AS allow, added,
    CASE WHEN kind < 2 THEN added + CAST(page_id % 5 + 1 AS INTEGER)
      WHEN page_id % 3 <> 0 THEN added + CAST(page_id % 40 AS INTEGER) ELSE DATE '9999-01-01' END AS removed
    FROM p WHERE kind < 7 AND host <> ''),
l AS (SELECT *, string_split(host, '.') AS labels FROM p WHERE host <> ''),
k AS (SELECT r, fetched, unnest(list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: array_to_string(labels[i:], '.'))
    || list_transform(range(1, len(segs) + 1), lambda i: array_to_string([host] || segs[1:i], '/'))) AS key FROM l),
m AS (SELECT DISTINCT r, list, e.key AS key, allow FROM k JOIN e ON k.key = e.key AND added <= fetched AND fetched < removed),
d AS (SELECT r, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, arg_max(key, length(key) * 2 + CAST(allow AS INTEGER)) AS rule,
    NOT arg_max(allow, length(key) * 2 + CAST(allow AS INTEGER)) AS blocked FROM m GROUP BY r)
SELECT page_id, url, strftime(fetched, '%Y-%m-%d') AS fetched, coalesce(lists, '') AS lists, coalesce(rule, '') AS rule,
    coalesce(blocked, false) AS blocked FROM p LEFT JOIN d USING (r)"""

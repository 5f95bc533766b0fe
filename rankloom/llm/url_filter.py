"""URL filters by dated lists, in DataFrame operations only.

Dated entries (a pattern is added to or removed from a list) become validity intervals.  A
capture names, by its host and path, the patterns that could match it; those are joined as of
the day of the fetch with the interval that began last, and hold if it has not ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, sized, stored

ENTRY = "list string, effect string, kind string, pattern string, action string, day date"
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)(?::[0-9]*)?([^?#]*)"
_KEY = ["list", "effect", "kind", "pattern"]


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or last dot, an IPv6 address in its brackets; null where the URL has none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def intervals(entries: DataFrame) -> DataFrame:
    """Entries to ``(list, effect, kind, pattern, valid_from, valid_to)``; an open end is null.

    Of entries of one pattern and day a removal counts last.  Repeated additions prolong the
    interval, repeated removals do nothing.  Entries with a null are left out.
    """
    days = entries.dropna(subset=[*_KEY, "action", "day"]).groupBy(*_KEY, "day").agg(F.max(F.col("action") == "remove").alias("off"))
    by_day = Window.partitionBy(*_KEY).orderBy("day")  # at most one row for each day
    turns = days.withColumn("was_off", F.lag("off", 1, True).over(by_day)).where("off <> was_off")
    spans = turns.withColumn("valid_to", F.lead("day").over(by_day)).where("not off")
    return spans.select(*_KEY, F.col("day").alias("valid_from"), "valid_to")


def _candidates(depth: int, labels: int) -> Column:
    """All patterns that could match: the host, the domains above it, and host plus leading folders, as deep as any list goes."""
    parts = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.greatest(F.size(parts) - (labels - 1), F.lit(1)), F.size(parts)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(parts, i, F.size(parts) - i + 1), ".").alias("pattern")))
    folders = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(folders), F.lit(depth + 1))), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.array_join(F.slice(folders, 1, i), "/")).alias("pattern")))
    return F.concat(F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern"))), domains, prefixes)


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures(page_id, url, day)`` with ``host``, ``blocked``, ``blocked_by`` and ``allowed_by``.

    Kinds of pattern: ``host`` (this host), ``domain`` (it and all below), ``prefix`` (host and
    whole leading folders, without a last slash).  A capture is blocked if a blocking list holds
    a pattern for it on its day and no allowing list does.  URLs without a host and captures
    without a day match nothing.  One row per row of ``captures``; other columns stay out.
    Judged are distinct pairs of URL and day; a pattern has one row for each day, so neither a
    common host nor an often changed pattern gathers in one task.
    """
    spans = cut(intervals(entries))
    size = spans.agg(F.max(F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1)), F.max(F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\."))))).first()
    asked = captures.where("day is not null").select("url", "day").distinct().withColumn("host", host_of(F.col("url"))).where("host is not null").withColumn("path", path_of(F.col("url")))
    asked = cut(asked.select("url", "day", F.explode(_candidates(size[0] or 0, max(1, size[1] or 1))).alias("c")).select("url", "day", "c.kind", "c.pattern"))
    listed = spans.select(*_KEY).distinct()
    wanted = asked.select("kind", "pattern", "day").distinct().join(listed, ["kind", "pattern"])
    # As-of join: starts and asked days of one pattern in a row; each asked day sees the start before it.
    marks = spans.select(*_KEY, F.col("valid_from").alias("day"), F.lit(0).alias("asked"), F.struct("valid_to").alias("span")).unionByName(wanted.select(*_KEY, "day", F.lit(1).alias("asked"), F.lit(None).cast("struct<valid_to:date>").alias("span")))
    latest = F.last("span", True).over(Window.partitionBy(*_KEY).orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, 0))
    active = marks.withColumn("latest", latest).where("asked = 1 and latest is not null and (latest.valid_to is null or day < latest.valid_to)")
    active = sized(active.select("kind", "pattern", "day", "list", "effect"))
    hits = asked.join(active, ["kind", "pattern", "day"]).groupBy("url", "day").agg(F.array_sort(F.collect_set(F.when(F.col("effect") == "block", F.col("list")))).alias("block"), F.array_sort(F.collect_set(F.when(F.col("effect") == "allow", F.col("list")))).alias("allow"))
    joined = captures.select("page_id", "url", "day").join(hits, ["url", "day"], "left")
    none = F.array().cast("array<string>")
    return joined.select("page_id", "url", "day", host_of(F.col("url")).alias("host"), ((F.size(F.coalesce("block", none)) > 0) & (F.size(F.coalesce("allow", none)) == 0)).alias("blocked"), F.array_join(F.coalesce("block", none), ",").alias("blocked_by"), F.array_join(F.coalesce("allow", none), ",").alias("allowed_by"))


#: Entries of the query by hand: list, effect, kind, pattern, action, day.
ENTRIES = [
    ("spam", "block", "host", "spam-farm.example.org", "add", "2024-01-01"),
    ("pharma", "block", "domain", "cheap-pills.example.com", "add", "2024-02-01"),
    ("pharma", "block", "domain", "cheap-pills.example.com", "remove", "2024-03-01"),
    ("mirrors", "block", "domain", "example.net", "add", "2024-02-20"),
    ("mirrors", "block", "domain", "example.net", "remove", "2024-02-25"),
    ("mirrors", "block", "domain", "example.net", "add", "2024-02-25"),
    ("partners", "allow", "domain", "tionsh.example.net", "add", "2024-02-22"),
]
#: And by rule, from the places that the pages name, n the least page id of each: list, effect, kind, place, then
#: every how many n; added on day n mod d; removed so many days later for every how many n; added again likewise.
RULES = [
    ("spam", "block", "host", "host", 3, 100, 10, 2, 15, 4),
    ("networks", "block", "domain", "above", 7, 60, 5, 1, 30, 2),
    ("takedown", "block", "prefix", "folder", 2, 90, 7, 6, 30, 12),
    ("reports", "block", "prefix", "page", 5, 110, 12, 3, 14, 9),
    ("partners", "allow", "host", "host", 13, 50, 20, 2, 40, 4),
    ("reviewed", "allow", "prefix", "page", 10, 70, 33, 4, 50, 8),
]
#: Pages carry no fetch time; the query gives page p the day p mod 120 after this one.
FIRST_DAY, DAYS = "2024-01-01", 120


def query_entries(pages: DataFrame) -> DataFrame:
    """The query's dated lists: some by hand, the rest by ``RULES`` from the hosts and paths in ``pages``, so that they grow with it."""
    spark = pages.sparkSession
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host is not null and page_id is not null")
    places = {"host": F.col("host"), "above": F.regexp_replace("host", r"^[^.]*[.]", ""), "folder": F.concat("host", F.lit("/"), F.split_part("path", F.lit("/"), F.lit(2))), "page": F.concat("host", F.rtrim("path", F.lit("/")))}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("place"), v.alias("pattern")) for k, v in places.items()))).alias("x")
    found = stored(named.select("page_id", each).groupBy("x.place", "x.pattern").agg(F.min("page_id").alias("n")))
    rows = ", ".join(f"({', '.join(repr(x) for x in e[:5])}, date '{e[5]}')" for e in ENTRIES)
    out = spark.sql(f"select * from values {rows} as e(list, effect, kind, pattern, action, day)")
    for name, effect, kind, place, every, first, off, off_every, on, on_every in RULES:
        own = found.where((F.col("place") == place) & (F.pmod("n", F.lit(every)) == 0))
        for action, later, which in (("add", 0, 1), ("remove", off, off_every), ("add", on, on_every)):
            day = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.pmod("n", F.lit(first)) + later).cast("int"))
            out = out.unionByName(own.where(F.pmod("n", F.lit(every * which)) == 0).select(F.lit(name).alias("list"), F.lit(effect).alias("effect"), F.lit(kind).alias("kind"), "pattern", F.lit(action).alias("action"), day.alias("day")))
    return out


def _sql_rules() -> str:
    """``RULES`` in SQL over places t(place, pattern, n)."""
    parts = []
    for name, effect, kind, place, every, first, off, off_every, on, on_every in RULES:
        for action, later, which in (("add", 0, 1), ("remove", off, off_every), ("add", on, on_every)):
            parts.append(f"SELECT '{name}', '{effect}', '{kind}', pattern, '{action}', DATE '{FIRST_DAY}' + CAST(n % {first} + {later} AS INTEGER) FROM t WHERE place = '{place}' AND n % {every * which} = 0")
    return "\n  UNION ALL ".join(parts)


SQL = rf"""
WITH u AS (SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '{_URL}', 1)), '\.$', ''), '') AS host, regexp_extract(url, '{_URL}', 2) AS path FROM pages),
t AS (SELECT place, pattern, min(page_id) AS n FROM (
  SELECT page_id, 'host' AS place, host AS pattern FROM u UNION ALL SELECT page_id, 'above', regexp_replace(host, '^[^.]*[.]', '') FROM u
  UNION ALL SELECT page_id, 'folder', host || '/' || split_part(path, '/', 2) FROM u UNION ALL SELECT page_id, 'page', host || rtrim(path, '/') FROM u) WHERE pattern IS NOT NULL GROUP BY ALL),
e(list, effect, kind, pattern, action, day) AS (SELECT * FROM (VALUES {', '.join(f"({', '.join(repr(x) for x in e[:5])}, DATE '{e[5]}')" for e in ENTRIES)})
  UNION ALL {_sql_rules()}),
d AS (SELECT list, effect, kind, pattern, day, max(CASE WHEN action = 'remove' THEN 1 ELSE 0 END) AS off FROM e GROUP BY ALL),
n AS (SELECT *, lead(day) OVER (PARTITION BY list, effect, kind, pattern ORDER BY day) AS until FROM d),
s AS (SELECT * FROM n WHERE off = 0),
p AS (SELECT page_id, url, DATE '{FIRST_DAY}' + CAST(page_id % {DAYS} AS INTEGER) AS day,
  nullif(regexp_replace(lower(regexp_extract(url, '{_URL}', 1)), '\.$', ''), '') AS host, regexp_extract(url, '{_URL}', 2) AS path FROM pages),
h AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) FILTER (effect = 'block') AS b, string_agg(DISTINCT list, ',' ORDER BY list) FILTER (effect = 'allow') AS a
  FROM p JOIN s ON p.day >= s.day AND (until IS NULL OR p.day < until) AND CASE kind
    WHEN 'host' THEN host = pattern WHEN 'domain' THEN host = pattern OR ends_with(host, '.' || pattern)
    ELSE host || path = pattern OR starts_with(host || path, pattern || '/') END GROUP BY page_id)
SELECT page_id, url, day, host, b IS NOT NULL AND a IS NULL AS blocked, coalesce(b, '') AS blocked_by, coalesce(a, '') AS allowed_by FROM p LEFT JOIN h USING (page_id)
"""

"""URL filters: a temporal join of captures with dated list entries.

Dated additions to and removals from lists become validity intervals; every capture is evaluated against the entries
that were active when it was fetched. An entry names a host, a domain (the host or anything below it) or one URL.

Which entries concern a host is found over distinct hosts. A capture then asks each entry that concerns it for its state at the fetch
time: an as-of join, by a union of captures and intervals and a window that carries the last interval on. Both joins deal
the captures of one key over SALTS parts and copy the few rows of the other side to each, so that a host with a third of all
captures isn't one task's work, and no capture carries the history of its host.

Defined results: a null or malformed URL has no host and is on no list; a null fetch time is on no list; an entry added
twice stays active from the first addition; an addition and a removal at one instant leave it inactive; repeated
captures give repeated results. A host of digits and dots is an address and has no domains above it. Columns of the captures that are
named host, matches or blocked stay, as <name>_given. Entries without a pattern or a time are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajframe.llm.common import read, stored

#: Parts over which the captures of one host, URL or entry are dealt.
SALTS = 32
ADDED = ("host", "matches", "blocked")


def host_of(url: Column) -> Column:
    """Host in lower case without user, port and trailing dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r"\.?(?::[0-9]*)?$", "")
    return F.when(host != "", host)


def url_key(url: Column) -> Column:
    """A URL without scheme and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")


def domains_of(host: Column) -> Column:
    """The host and every domain above it; an address of digits and dots stands alone."""
    labels = F.split(host, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.regexp_like(host, F.lit("^[0-9.]+$")), F.array(host)).otherwise(every)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until) from (list, kind, pattern, action add|remove, at); until is null while it lasts.

    At one instant a removal outweighs an addition. Only changes of state open or close an interval.
    """
    at_once = entries.where("pattern IS NOT NULL AND at IS NOT NULL").groupBy("list", "kind", "pattern", "at").agg(F.bool_and(F.col("action") == "add").alias("active"))
    order = Window.partitionBy("list", "kind", "pattern").orderBy("at")
    changes = at_once.withColumn("was", F.coalesce(F.lag("active").over(order), F.lit(False))).where("active <> was")
    spans = changes.withColumn("until", F.lead("at").over(order)).where("active")
    return spans.select("list", "kind", "pattern", F.col("at").alias("since"), "until")


ENTRY = ("list", "kind", "pattern")


def _salted(rows: DataFrame) -> DataFrame:
    """Each row once for every part."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def concerning(narrow: DataFrame, intervals: DataFrame) -> DataFrame:
    """(row, t, salt, list, kind, pattern): every capture with the entries that name its host, a domain above it, or its URL."""
    entries = intervals.select(*ENTRY).distinct()
    hosts = narrow.where("host IS NOT NULL").select("host").distinct()
    probes = hosts.select("host", F.explode(domains_of(F.col("host"))).alias("pattern"))
    by_host = probes.join(entries.where("kind IN ('host', 'domain')"), "pattern").where("kind = 'domain' OR host = pattern")
    by_url = entries.where("kind = 'url'").withColumn("url_key", F.col("pattern"))
    named = [narrow.join(_salted(rules), [key, "salt"]).select("row", "t", "salt", *ENTRY) for key, rules in (("host", by_host), ("url_key", by_url))]
    return named[0].unionByName(named[1])


def active_at(asked: DataFrame, intervals: DataFrame) -> DataFrame:
    """(row, list, kind, pattern, since, until) of the intervals that hold at t, from (row, t, salt, list, kind, pattern).

    The intervals of one entry don't overlap, so the last one that began decides.
    """
    began = _salted(intervals).select(*ENTRY, "salt", F.col("since").alias("t"), F.lit(None).cast("long").alias("row"), F.struct("since", "until").alias("span"))
    both = asked.select(*ENTRY, "salt", "t", "row", F.lit(None).cast("struct<since:timestamp,until:timestamp>").alias("span")).unionByName(began)
    so_far = Window.partitionBy(*ENTRY, "salt").orderBy("t", F.col("row").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = both.withColumn("span", F.last("span", ignorenulls=True).over(so_far)).where("row IS NOT NULL AND span IS NOT NULL")
    return held.where(F.col("span.until").isNull() | (F.col("t") < F.col("span.until"))).select("row", *ENTRY, "span.since", "span.until")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds host, matches (the active entries) and blocked to captures (with url, fetch_time)."""
    names = [f"c{i}" for i in range(len(captures.columns))]
    at = dict(zip(captures.columns, names, strict=True))
    # Written once: the rows need numbers that stay.
    rows = captures.toDF(*names).withColumn("host", host_of(F.col(at["url"]))).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows)
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    narrow = rows.where(F.col(at["fetch_time"]).isNotNull()).select("row", F.col(at["fetch_time"]).cast("timestamp").alias("t"), "host", url_key(F.col(at["url"])).alias("url_key"), salt.alias("salt"))
    intervals = stored(validity_intervals(entries))
    active = active_at(concerning(narrow, intervals), intervals)
    found = active.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*ENTRY, "since", "until"))).alias("matches"))
    none = F.array().cast("array<struct<list:string,kind:string,pattern:string,since:timestamp,until:timestamp>>")
    out = rows.join(found, "row", "left").withColumn("matches", F.coalesce("matches", none))
    given = [F.col(n).alias(f"{c}_given" if c in ADDED else c) for c, n in at.items()]
    return out.select(*given, "host", "matches", (F.size("matches") > 0).alias("blocked"))


#: The dated lists and fetch times that the query derives from the pages table.
START = 1704067200
YEAR = 31536000


def _digit(col: Column, place: int) -> Column:
    return F.conv(F.substring(F.md5(col), 2 * place + 1, 2), 16, 10).cast("long")


def page_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.timestamp_seconds(START + F.pmod(F.col("page_id") * 7919 * 60, F.lit(YEAR))).alias("fetch_time"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A quarter of the hosts are added, most removed and some added again; a few domains and URLs are listed too."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    day = lambda p, place: _digit(p, place) * 86400 + START
    p = F.col("pattern")
    named = hosts.select(F.lit("host").alias("kind"), F.col("host").alias("pattern")).where(_digit(p, 0) < 64)
    parents = hosts.select(F.lit("domain").alias("kind"), F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("pattern")).where((p != "") & (_digit(p, 1) < 32)).distinct()
    urls = pages.select(F.lit("url").alias("kind"), url_key(F.col("url")).alias("pattern")).where(_digit(p, 2) < 16).distinct()
    listed = named.unionByName(parents).unionByName(urls)
    name = F.when(_digit(p, 3) < 128, "spam").otherwise("adult")
    steps = F.array(
        F.struct(F.lit("add").alias("action"), day(p, 4).alias("s")),
        F.struct(F.lit("remove").alias("action"), (day(p, 4) + (_digit(p, 5) + 1) * 43200).alias("s")),
        F.when(_digit(p, 6) < 128, F.struct(F.lit("add").alias("action"), (day(p, 4) + (_digit(p, 5) + 60) * 86400).alias("s"))),
    )
    rows = listed.select(name.alias("list"), "kind", "pattern", F.inline(F.array_compact(steps)))
    return rows.select("list", "kind", "pattern", "action", F.timestamp_seconds("s").alias("at"))


def op6_urls(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    found = filter_urls(page_captures(pages), page_entries(pages))
    return found.select(
        "page_id",
        F.unix_timestamp("fetch_time").alias("fetched"),
        "host",
        "blocked",
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["list"]))), ",").alias("lists"),
        F.size("matches").cast("long").alias("n_matches"),
        F.unix_timestamp(F.array_min(F.transform("matches", lambda m: m["since"]))).alias("since"),
    )


#: In DuckDB: intervals by lead(), matches by range conditions.
_HOST = r"nullif(regexp_replace(regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), '\.?(?::[0-9]*)?$', ''), '')"
_URL = r"regexp_replace(regexp_replace({u}, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
_DIGIT = "CAST('0x' || substr(md5(pattern), {at}, 2) AS BIGINT)"


def _d(place: int) -> str:
    return _DIGIT.format(at=2 * place + 1)


OP6_SQL = rf"""
WITH c AS (SELECT page_id, url, {START} + (page_id * 7919 * 60) % {YEAR} AS fetched, {_HOST.format(u="url")} AS host, {_URL.format(u="url")} AS url_key FROM pages),
named AS (
  SELECT DISTINCT 'host' AS kind, host AS pattern FROM c WHERE host IS NOT NULL
  UNION SELECT 'domain', regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) FROM c WHERE host IS NOT NULL
  UNION SELECT 'url', url_key FROM c),
listed AS (
  SELECT kind, pattern, CASE WHEN {_d(3)} < 128 THEN 'spam' ELSE 'adult' END AS list, {_d(4)} * 86400 + {START} AS s, {_d(5)} AS gap, {_d(6)} AS again
  FROM named WHERE pattern <> '' AND ((kind = 'host' AND {_d(0)} < 64) OR (kind = 'domain' AND {_d(1)} < 32) OR (kind = 'url' AND {_d(2)} < 16))),
spans AS (
  SELECT list, kind, pattern, s AS since, s + (gap + 1) * 43200 AS until FROM listed
  UNION ALL SELECT list, kind, pattern, s + (gap + 60) * 86400, NULL FROM listed WHERE again < 128),
m AS (
  SELECT c.page_id, s.list, s.since FROM c JOIN spans s ON (s.kind = 'host' AND s.pattern = c.host) AND s.since <= c.fetched AND (s.until IS NULL OR c.fetched < s.until)
  UNION ALL SELECT c.page_id, s.list, s.since FROM c JOIN spans s ON s.kind = 'domain' AND (c.host = s.pattern OR (NOT regexp_matches(c.host, '^[0-9.]+$') AND suffix(c.host, '.' || s.pattern))) AND s.since <= c.fetched AND (s.until IS NULL OR c.fetched < s.until)
  UNION ALL SELECT c.page_id, s.list, s.since FROM c JOIN spans s ON (s.kind = 'url' AND s.pattern = c.url_key) AND s.since <= c.fetched AND (s.until IS NULL OR c.fetched < s.until)),
g AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n, min(since) AS since FROM m GROUP BY page_id)
SELECT c.page_id, c.fetched, c.host, g.n IS NOT NULL AS blocked, coalesce(g.lists, '') AS lists, coalesce(g.n, 0) AS n_matches, CAST(g.since AS BIGINT) AS since
FROM c LEFT JOIN g USING (page_id)
"""

"""URL filters as a temporal join: every capture is judged by the list entries active at its time.

List entries are dated additions and removals of a host, a domain or a host with leading path
parts. After one row per key, list and day is kept, each addition becomes a validity interval that
ends at the key's next entry. Captures look up all their keys (the host, its parent domains, the
host with its first path parts) in intervals dealt by key and quarter of a year, so an as-of match
is an equality join with a short range check. Equal captures (url, day) are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import fits_broadcast, let, own
from marketloom.session import materialize

SPAN = 91  # days in a bucket
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    name = F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"^.*@|:[0-9]*$|\.$", "")
    return F.coalesce(name, F.lit(""))


def keys(url: Column, depth: int = 2) -> Column:
    """The host, its parent domains of two or more labels, the host with 1 to ``depth`` path parts."""
    def parents(labels: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))

    def paths(h: Column, parts: Column) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(1), F.lit(max(1, depth))), lambda i: i <= F.least(F.size(parts), F.lit(depth))),
                           lambda i: F.concat(h, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))

    steps = F.filter(F.split(F.regexp_extract(url, URL, 2), "/"), lambda x: x != "")
    return let(host(url), lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(let(F.split(h, r"\."), parents), let(steps, lambda s: paths(h, s))))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until): active from ``since`` up to, not including, ``until`` (or null).

    ``entries``: (list, key, action 'add' or 'remove', day). On one day a removal wins. Rows with a
    null or another action are ignored. Case counts in path parts only. A key's history has one row a day at most, which bounds it."""
    name = F.substring_index("key", "/", 1)
    key = F.concat(F.lower(name), F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)"))
    days = (entries.where("list is not null and key is not null and day is not null "
                          "and action in ('add', 'remove')")
            .groupBy("list", key.alias("key"), F.to_date("day").alias("since"))
            .agg(F.max("action").alias("action")))
    w = Window.partitionBy("list", "key").orderBy("since")
    return (days.withColumn("until", F.lead("since").over(w)).where("action = 'add'")
            .select("list", "key", "since", "until"))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched") -> DataFrame:
    """``captures`` plus blocked, lists (sorted names) and rule (the longest matching key).

    All rows and other columns stay. A null or malformed url, or a null day, matches nothing."""
    captures = captures.drop("blocked", "lists", "rule")
    asked = (captures.select(F.col(url).alias("u"), F.to_date(day).alias("d"))
             .where("u is not null and d is not null").distinct())
    active = materialize(intervals(entries), "intervals")
    depth = active.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0  # of the longest entry
    last = captures.agg(F.max(F.to_date(day))).first()[0]
    epoch = F.lit("1970-01-01").cast("date")

    def bucket(d: Column) -> Column:
        return F.floor(F.datediff(d, epoch) / SPAN)

    end = F.least(F.coalesce(F.date_sub("until", 1), F.lit(last).cast("date")), F.lit(last).cast("date"))
    dealt = active.where(end >= F.col("since")).withColumn(
        "bucket", F.explode(F.sequence(bucket(F.col("since")), bucket(end))))
    small = fits_broadcast(dealt)
    looked = asked.select("u", "d", bucket(F.col("d")).alias("bucket"), F.explode(keys(F.col("u"), depth)).alias("key"))
    found = (looked.join(F.broadcast(dealt) if small else dealt, ["key", "bucket"])
             .where("since <= d and (until is null or d < until)")
             .groupBy("u", "d").agg(
                 F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
                 F.max(F.struct(F.length("key").alias("n"), "key"))["key"].alias("rule")))
    u, d = own("url"), own("day")
    keyed = captures.withColumns({u: F.col(url), d: F.to_date(day)})
    return (keyed.join(found.toDF(u, d, "lists", "rule"), [u, d], "left").drop(u, d)
            .select(*captures.columns, F.col("rule").isNotNull().alias("blocked"),
                    F.coalesce("lists", F.lit("")).alias("lists"), "rule"))


def number(key: Column) -> Column:
    """24 bits of the key's md5."""
    return F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("int")


def dated_captures(pages: DataFrame, start: str = "2024-01-01", days: int = 730) -> DataFrame:
    """Stored pages have no time of capture: one is derived from each page's id and url."""
    seed = F.concat_ws("|", F.col("page_id").cast("string"), F.col("url"))
    return pages.select("page_id", "url").withColumn(
        "fetched", F.date_add(F.lit(start).cast("date"), number(seed) % days))


def derived_entries(pages: DataFrame, start: str = "2024-01-01") -> DataFrame:
    """Lists for trial runs, from the keys of the pages: every third key enters a list, leaves it 100
    days later and, for every second one of these, enters it again after 100 more."""
    found = pages.select(F.explode(keys(F.col("url"))).alias("key")).distinct().withColumn("n", number(F.col("key")))
    found = found.where("n % 3 = 0").withColumn("list", F.when(F.expr("n div 3 % 2 = 0"), "spam").otherwise("adult"))
    first = F.col("n") % 401
    again = F.when(F.expr("n div 7 % 2 = 0"), F.array(F.struct(F.lit("add").alias("action"), (first + 200).alias("at"))))
    steps = F.concat(F.array(F.struct(F.lit("add").alias("action"), first.alias("at")),
                             F.struct(F.lit("remove").alias("action"), (first + 100).alias("at"))),
                     F.coalesce(again, F.array().cast("array<struct<action:string,at:int>>")))
    return (found.withColumn("step", F.explode(steps))
            .select("list", "key", "step.action", F.date_add(F.lit(start).cast("date"), F.col("step.at")).alias("day")))


ORACLE = """
WITH p AS (
  SELECT page_id, url, regexp_replace(lower(regexp_extract(url,
      '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', 1)), '^.*@|:[0-9]*$|\\.$', '', 'g') AS host,
    list_filter(string_split(regexp_extract(url,
      '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', 2), '/'), lambda x: x <> '') AS parts,
    ('0x' || substr(md5(concat_ws('|', page_id::VARCHAR, url)), 1, 6))::INT AS n
  FROM pages),
k AS (
  SELECT page_id, url, n, unnest(list_distinct(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')), 2)),
      lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(list_filter([1, 2], lambda i: i <= len(parts)),
      lambda i: host || '/' || array_to_string(parts[1:i], '/'))))) AS key
  FROM p WHERE host <> ''),
e AS (
  SELECT key, ('0x' || substr(md5(key), 1, 6))::INT AS m FROM (SELECT DISTINCT key FROM k)
  WHERE ('0x' || substr(md5(key), 1, 6))::INT % 3 = 0),
v AS (
  SELECT key, m, m % 401 AS a, m % 401 + 100 AS b FROM e
  UNION ALL SELECT key, m, m % 401 + 200, 1000000 FROM e WHERE m // 7 % 2 = 0),
hit AS (
  SELECT k.page_id, k.url, CASE WHEN v.m // 3 % 2 = 0 THEN 'spam' ELSE 'adult' END AS list, k.key
  FROM k JOIN v ON k.key = v.key AND k.n % 730 >= v.a AND k.n % 730 < v.b),
found AS (
  SELECT page_id, url, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists,
    arg_max(key, (length(key), key)) AS rule
  FROM hit GROUP BY page_id, url)
SELECT p.page_id, p.url, DATE '2024-01-01' + (p.n % 730)::INT AS fetched, rule IS NOT NULL AS blocked,
  coalesce(lists, '') AS lists, rule
FROM p LEFT JOIN found ON p.page_id = found.page_id AND p.url IS NOT DISTINCT FROM found.url
"""

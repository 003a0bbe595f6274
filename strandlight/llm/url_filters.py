"""URL lists over time.

Dated list entries (added, removed) become validity intervals. A capture's URL gives its
host, every parent domain and every path prefix as keys, and an as-of join finds the
entries that were active when the page was fetched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlight.llm.common import broadcast_if_small, cut, fresh, row_key, table


def intervals(entries: DataFrame) -> DataFrame:
    """(entry, since, until): when each entry was on the list; until is exclusive, null while it lasts.

    entries: entry, action (`add` or `remove`), since (date). Of actions on one day a
    removal wins. Repeated additions do not interrupt an interval. Rows with a null are
    passed over, as are other actions.
    """
    day = entries.select(F.col("entry").cast("string").alias("entry"), F.lower("action").alias("action"), F.col("since").cast("date").alias("since")).filter("entry is not null and since is not null and action in ('add', 'remove')")
    state = day.groupBy("entry", "since").agg((F.max("action") == "add").alias("on"))
    by_entry = Window.partitionBy("entry").orderBy("since")
    turns = state.withColumn("was", F.lag("on", 1, False).over(by_entry)).filter(F.col("on") != F.col("was"))
    return turns.withColumn("until", F.lead("since").over(by_entry)).filter("on").select("entry", "since", "until")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host in lower case without user, port and trailing dot; path segments). Without a scheme, the host is empty."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)
    host = F.rtrim(F.lower(F.regexp_extract(rest, r"^(?:[^/@]*@)?([^/:@]*)", 1)), F.lit("."))
    return host, F.filter(F.split(F.regexp_extract(rest, r"^[^/]*/(.*)$", 1), "/"), lambda x: x != "")


def listed_depths(entries: DataFrame) -> tuple[list[int], list[int]]:
    """(numbers of labels of the listed domains, numbers of segments of the listed paths): all that URLs are asked for."""
    kind = F.substring("entry", 1, 2)
    depth = F.when(kind == "d:", F.size(F.split("entry", r"\."))).when(kind == "p:", F.size(F.split("entry", "/")) - 1)
    found = [tuple(x) for x in entries.select(kind, depth).filter(depth.isNotNull()).distinct().collect()]
    return tuple(sorted(d for k, d in found if k == which) for which in ("d:", "p:"))


def url_keys(host: str, segments: str, domains: list[int], paths: list[int]) -> Column:
    """`d:` and each domain of the host, `p:` and the host with each prefix of the path, of the given depths."""
    labels = F.split(host, r"\.")
    none = F.array().cast("array<string>")

    def of(parts: Column, depths: list[int], key: Callable[[Column], Column]) -> Column:
        if not depths:
            return none
        return F.transform(F.filter(F.array(*map(F.lit, depths)), lambda k: (k > 0) & (k <= F.size(parts))), key)

    named = of(labels, domains, lambda k: F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")))
    under = of(F.col(segments), paths, lambda k: F.concat(F.lit("p:"), F.col(host), F.lit("/"), F.array_join(F.slice(F.col(segments), F.lit(1), k), "/")))
    return F.when(F.length(host) == 0, none).otherwise(F.concat(named, under))


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", fetched_col: str = "fetched_on") -> DataFrame:
    """captures with host, active (the sorted entries that held at the fetch) and blocked.

    A URL gives only keys as deep as some entry of the list, so that its keys grow with
    its length and the list's depths alone. Each side is dealt by key and month, so that an entry with a long history, or a host
    with very many captures, meets only what a month of it can match; the adaptive join
    splits months that are still too large, and the list is broadcast while it is small.
    Defined cases: a null URL, one without scheme or host, and a null fetch date match
    nothing; repeated rows give repeated rows; empty tables on either side work; columns
    host, active and blocked are replaced, other columns pass through.
    """
    rest = captures.drop("host", "active", "blocked")
    host, segments = url_parts(F.col(url_col))
    k1, k2 = row_key(id_col, url_col)
    day = F.col(fetched_col).cast("date")
    month = lambda d: F.year(d) * 12 + F.month(d)
    keyed = rest.select(k1, k2, day.alias("day"), host.alias("host"), segments.alias("segments")).filter("day is not null and host <> ''")
    span = keyed.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    held = intervals(entries).join(F.broadcast(span), (F.col("since") <= F.col("last")) & (F.col("until").isNull() | (F.col("until") > F.col("first"))))
    a, z = F.greatest("since", "first"), F.least(F.coalesce(F.date_sub("until", 1), F.col("last")), F.col("last"))
    listed = cut(held.select("entry", "since", "until", F.explode(F.sequence(month(a), month(z))).alias("l_month")))
    probes = keyed.select("k1", "k2", "day", month(F.col("day")).alias("month"), F.explode(url_keys("host", "segments", *listed_depths(listed))).alias("key")).distinct()
    met = probes.join(broadcast_if_small(listed), (F.col("key") == F.col("entry")) & (F.col("month") == F.col("l_month")) & (F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    n1, n2, n_day, n_active = fresh(rest, "k1", "k2", "day", "active")
    active = cut(met.groupBy(F.col("k1").alias(n1), F.col("k2").alias(n2), F.col("day").alias(n_day)).agg(F.array_sort(F.collect_set("key")).alias(n_active)))
    joined = rest.join(broadcast_if_small(active), (k1 == F.col(n1)) & (k2 == F.col(n2)) & (day == F.col(n_day)), "left")
    found = F.coalesce(n_active, F.array().cast("array<string>"))
    return joined.select(*(F.col(f"`{c}`") for c in rest.columns), F.coalesce(host, F.lit("")).alias("host"), found.alias("active"), (F.size(found) > 0).alias("blocked"))


def _number(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


def demo_captures(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch dates: a page's comes from its URL."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (_number(F.coalesce("url", F.lit(""))) % 730).cast("int")).alias("fetched_on"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """No table holds a list: hosts and first path segments of the pages get entries by their digests."""
    host, segments = url_parts(F.col("url"))
    hosts = pages.select(host.alias("host"), segments.alias("segments")).filter("host <> ''")
    keys = hosts.select(F.concat(F.lit("d:"), "host").alias("entry")).unionAll(hosts.filter(F.size("segments") > 0).select(F.concat(F.lit("p:"), "host", F.lit("/"), F.get("segments", F.lit(0))).alias("entry"))).distinct()
    n = _number(F.col("entry"))
    start = F.date_add(F.lit("2024-01-01").cast("date"), (n % 600).cast("int"))
    dated = keys.filter(n % 3 == 0).select("entry", start.alias("d"), n.alias("n"))
    events = F.array(F.struct(F.lit("add").alias("action"), F.col("d").alias("since")), F.struct(F.lit("remove").alias("action"), F.date_add("d", (F.col("n") % 7 * 20).cast("int")).alias("since")), F.struct(F.lit("add").alias("action"), F.date_add("d", (F.col("n") % 5 * 40 + 60).cast("int")).alias("since")))
    return dated.select("entry", F.explode(F.slice(events, F.lit(1), (F.col("n") % 3 + F.col("n") % 2 * 2 + 1).cast("int"))).alias("e")).select("entry", "e.action", "e.since")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = filter_captures(demo_captures(pages), demo_entries(pages))
    return out.select("page_id", "fetched_on", "host", F.array_join("active", " ").alias("active"), "blocked")


ORACLE = r"""
with p as (
  select page_id, url,
         date '2024-01-01' + (('0x' || substr(md5(coalesce(url, '')), 1, 8))::bigint % 730)::int fetched_on,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1) rest
  from pages),
h as (
  select page_id, url, fetched_on,
         coalesce(regexp_replace(lower(regexp_extract(rest, '^(?:[^/@]*@)?([^/:@]*)', 1)), '\.+$', ''), '') host,
         list_filter(string_split(regexp_extract(rest, '^[^/]*/(.*)$', 1), '/'), lambda x: x <> '') seg
  from p),
names as (
  select distinct 'd:' || host entry from h where host <> ''
  union select distinct 'p:' || host || '/' || seg[1] from h where host <> '' and len(seg) > 0),
num as (select entry, ('0x' || substr(md5(entry), 1, 8))::bigint n from names),
dated as (select entry, n, date '2024-01-01' + (n % 600)::int d, n % 3 + n % 2 * 2 + 1 events from num where n % 3 = 0),
ev as (
  select entry, 'add' act, d since from dated where events >= 1
  union all select entry, 'remove', d + (n % 7 * 20)::int from dated where events >= 2
  union all select entry, 'add', d + (n % 5 * 40 + 60)::int from dated where events >= 3),
st as (select entry, since, bool_and(act = 'add') listed from ev group by entry, since),
asof_keys as (
  select page_id, url, fetched_on, 'd:' || array_to_string(list_slice(string_split(host, '.'), i, 99), '.') k
  from h, lateral (select unnest(range(1, len(string_split(host, '.')) + 1)) i) where host <> ''
  union
  select page_id, url, fetched_on, 'p:' || host || '/' || array_to_string(list_slice(seg, 1, i), '/')
  from h, lateral (select unnest(range(1, len(seg) + 1)) i) where host <> ''),
act as (
  select k.page_id, k.url, string_agg(k.k, ' ' order by k.k) active
  from asof_keys k asof join st s on k.k = s.entry and k.fetched_on >= s.since
  where s.listed group by all)
select page_id, fetched_on, host, coalesce(active, '') active, active is not null blocked
from h left join act using (page_id, url)
"""

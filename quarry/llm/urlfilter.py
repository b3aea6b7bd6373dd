"""URL filters over time: an as-of join of captures with dated list entries.

A list is a table of entries (key, at, action, category): from ``at`` on, ``add`` puts a key on the list and
``remove`` takes it off. ``intervals`` turns it into validity intervals [valid_from, valid_to) of active entries:
each entry holds until the key's next one. A key is a host, which stands for its subdomains too, or a host
with a path, which stands for that path and what is below it. Keys are brought to the form of hosts and paths first: lower-case host without last dots, no empty
segments (``//en//`` is ``/en``); percent signs and case of a path stay as written, on both sides. A host in brackets is an IPv6 address.

A capture is checked against the entries that were active when it was fetched: its host and path give the
keys that could list it, and for each an as-of join finds the key's last entry at the fetch time, by one sort of both (``operators.scan``): a key with
thousands of entries makes no more rows than one with one. The
most specific key on the list wins. Captures are reduced to distinct (url, time) first, so one page fetched a million times joins once. Their
hosts meet the listed hosts before any path is written out, and then only paths of the depths that are listed for that host. Every join is
dealt over (key, salt), so a suffix such as com under a third of the crawl is many tasks'; a list that Spark finds small is sent around.

Rows: a null, empty or hostless URL and a null fetch time match nothing and are kept, not blocked. Repeated
captures stay. Entries with a null key, time or action, or a key without a host, are ignored; of entries for one key at one
time the last by action, then category, counts, so ``remove`` beats ``add``. An empty list blocks nothing, an empty table of captures
gives an empty result. URLs of any length count whole; of a host's labels as many are written out as the longest listed host has.
Other columns of the captures are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarry.llm.common import attach
from quarry.operators import asof_join

#: The list of the test query: key, date, action, category.
ENTRIES = [
    ("casino-win.example.com", "2023-06-01", "add", "gambling"),
    ("casino-win.example.com", "2024-04-10", "remove", "gambling"),
    ("casino-win.example.com", "2024-08-01", "add", "gambling"),
    ("free-bets.example.com", "2024-02-15", "add", "gambling"),
    ("free-bets.example.com/en", "2024-01-01", "add", "gambling"),
    ("example.net", "2024-03-01", "add", "spam"),
    ("example.net", "2024-03-20", "remove", "spam"),
    ("tionsh.example.net", "2024-05-05", "add", "malware"),
    ("tionsh.example.net", "2024-06-05", "add", "phishing"),
    ("tionsh.example.net", "2024-07-05", "remove", "phishing"),
    ("tionsh.example.net", "2024-07-05", "add", "phishing"),
    ("blog.ththth.example.org/fr", "2024-01-20", "add", "adult"),
    ("m.casino-win.example.com", "2024-04-20", "add", "gambling"),
    ("example.org", "2024-11-01", "add", "spam"),
    ("never-seen.example.com", "2023-01-01", "add", "spam"),
]
YEAR = 366 * 86_400
#: Slices of time over which a key's captures are dealt.
SLICES = 256
PARTS = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]+)(?::[0-9]*)?([^?#]*)"


def host(url: Column) -> Column:
    """Lower case, without user, port and last dot; null if there is none."""
    found = F.lower(F.rtrim(F.regexp_extract(url, PARTS, 1), F.lit(".")))
    return F.when(found != "", found)


def segments(at: Column) -> Column:
    """The path's segments, empty ones left out."""
    return F.filter(F.split(at, "/"), lambda s: s != "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 2)


def normal(key: Column) -> Column:
    """A list key in the form in which captures are looked up; null without a host."""
    name = F.lower(F.rtrim(F.split(key, "/")[0], F.lit(".")))
    return F.when(name != "", F.array_join(F.concat(F.array(name), segments(F.substr(key, F.length(F.split(key, "/")[0]) + 1))), "/"))


def suffixes(name: Column, most: Column) -> Column:
    """The last ``most`` of a host and the domains above it, each with the number of its labels."""
    labels = F.split(name, r"\.")
    labels = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - most + 1), most)
    return F.transform(labels, lambda _, i: F.struct(F.array_join(F.slice(labels, i + 1, F.size(labels) - i), ".").alias("domain"), (F.size(labels) - i).alias("labels")))


def entries(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    df = spark.createDataFrame(ENTRIES if rows is None else rows, "key string, at string, action string, category string")
    return df.withColumn("at", F.col("at").cast("timestamp_ntz"))


def changes(listed: DataFrame) -> DataFrame:
    """key, valid_from, action and category: what counts for the key from then on."""
    known = listed.withColumn("key", normal(F.col("key"))).where("key IS NOT NULL AND at IS NOT NULL AND action IS NOT NULL")
    last = known.groupBy("key", "at").agg(F.max(F.struct("action", "category")).alias("e"))
    return last.select("key", F.col("at").alias("valid_from"), "e.action", "e.category")


def intervals(listed: DataFrame) -> DataFrame:
    """key, category, valid_from, valid_to (null: still) of the times when a key is on the list."""
    until = F.lead("valid_from").over(Window.partitionBy("key").orderBy("valid_from"))
    return changes(listed).withColumn("valid_to", until).where("action = 'add'").select("key", "category", "valid_from", "valid_to")


def evaluate(captures: DataFrame, listed: DataFrame) -> DataFrame:
    """captures: page_id, url, fetched_at. Adds host, blocked, matched_key, category and valid_from of the entry that counts."""
    each = captures.select("page_id", "url", "fetched_at")
    distinct = each.where("url IS NOT NULL AND fetched_at IS NOT NULL").select("url", "fetched_at").distinct()
    dated = changes(listed)
    depth = F.size(segments(F.col("key"))) - 1
    hosts = dated.groupBy(F.split("key", "/")[0].alias("domain")).agg(F.collect_set(depth).alias("depths"))
    most = F.coalesce(dated.agg(F.max(F.size(F.split(F.split("key", "/")[0], r"\.")))).scalar(), F.lit(0))
    named = distinct.withColumn("host", host(F.col("url"))).where("host IS NOT NULL").withColumns({"segments": segments(path(F.col("url"))), "most": most})
    probes = named.select("url", "fetched_at", "segments", F.explode(suffixes(F.col("host"), F.col("most"))).alias("h")).select("url", "fetched_at", "segments", "h.domain", "h.labels")
    known = attach(probes, hosts, ["domain"], "url")
    key = F.concat_ws("/", F.array("domain"), F.slice("segments", 1, F.col("depth")))
    deep = known.withColumn("depth", F.explode(F.filter("depths", lambda d: d <= F.size("segments"))))
    written = deep.select("url", "fetched_at", "labels", F.col("depth").alias("segments"), key.alias("key"))
    hit = asof_join(written, dated, ["key"], "fetched_at", "valid_from", ["action", "category", "valid_from"], "action", SLICES).where("action = 'add'")
    best = hit.groupBy("url", "fetched_at").agg(F.max(F.struct("labels", "segments", "key", "category", "valid_from")).alias("best"))
    out = attach(each, best, ["url", "fetched_at"], "page_id", "left")
    return out.select(
        "page_id", "url", host(F.col("url")).alias("host"), "fetched_at", F.col("best").isNotNull().alias("blocked"), F.col("best.key").alias("matched_key"), F.col("best.category").alias("category"), F.col("best.valid_from").alias("valid_from")
    )


def fetched(pages: DataFrame) -> DataFrame:
    """The test tables have no fetch time: one is made of page_id, spread over 2024."""
    second = F.pmod(F.col("page_id") * 7_919_003, F.lit(YEAR)).cast("int")
    return pages.select("page_id", "url", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=second)).alias("fetched_at"))


def report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return evaluate(fetched(pages), entries(spark))


def sql(listed: list[tuple] | None = None) -> str:
    """The report in DuckDB's SQL, for ENTRIES or another list of literal entries."""
    rows = ", ".join(f"('{k}', TIMESTAMP '{at}', '{a}', '{c}')" for k, at, a, c in (ENTRIES if listed is None else listed))
    parts = PARTS.replace("'", "''")
    clean = lambda path: f"array_to_string(list_filter(string_split({path}, '/'), lambda x: x <> ''), '/')"
    return rf"""
WITH raw(key, since, action, category) AS (VALUES {rows}),
keyed AS (SELECT lower(rtrim(string_split(key, '/')[1], '.')) AS domain, {clean("substr(key, len(string_split(key, '/')[1]) + 1)")} AS below, since, action, category FROM raw),
listed AS (SELECT domain || CASE WHEN below = '' THEN '' ELSE '/' || below END AS key, domain, below, since, action, category FROM keyed WHERE domain <> ''),
lasts AS (SELECT key, domain, below, since, max({{'action': action, 'category': category}}) AS e FROM listed GROUP BY ALL),
spans AS (SELECT key, domain, below, e.action AS action, e.category AS category, since AS valid_from, lead(since) OVER (PARTITION BY key ORDER BY since) AS valid_to FROM lasts),
c AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_seconds(page_id * 7919003 % {YEAR}) AS fetched_at,
      nullif(lower(rtrim(regexp_extract(url, '{parts}', 1), '.')), '') AS host, {clean(f"regexp_extract(url, '{parts}', 2)")} AS path FROM pages),
hit AS (SELECT c.page_id, key, category, valid_from,
        row_number() OVER (PARTITION BY c.page_id ORDER BY len(string_split(domain, '.')) DESC, len(string_split(key, '/')) DESC, key DESC) AS k
        FROM c JOIN spans ON action = 'add' AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)
        AND (host = domain OR suffix(host, '.' || domain)) AND (below = '' OR starts_with(path || '/', below || '/')))
SELECT c.page_id, url, host, fetched_at, key IS NOT NULL AS blocked, key AS matched_key, category, valid_from FROM c LEFT JOIN hit ON c.page_id = hit.page_id AND k = 1"""

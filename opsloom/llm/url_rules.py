"""URL rules by a sort-merge range join.

A host becomes a canonical key: its labels reversed, each ended by a dot, so a
rule's host and all its subdomains are one interval of keys, and intervals of
different rules are nested or apart. Rules and hosts are sorted together; the
sweep carries the stack of rules that are active after each opening. A host
takes the stack of the last opening before it, without what has closed since,
and its urls then choose the longest rule whose path fits. DataFrame functions
only.

A top-level label with many hosts is swept in several shards, to which its rules
are copied, so a label with most of the hosts is spread; others are one shard.
Only distinct hosts are swept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Distinct hosts in a shard of a top-level label, about.
SHARD_HOSTS = 50_000
#: Verdict where no rule fits.
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """`www.example.com` as `com.example.www.`; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _openings(rules: DataFrame) -> DataFrame:
    """One row for each host with rules: its key, and the stack of it and its enclosing hosts, innermost first.

    A host's ancestors are its own suffixes, so a join on at most its number of labels finds them.
    """
    own = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").where("host <> ''")
    own = own.groupBy("host").agg(F.sort_array(F.collect_set(F.struct("path", "verdict"))).alias("paths"))
    own = own.withColumn("key", key_of(F.col("host")))
    labels = F.split(F.col("host"), r"\.", -1)
    chain = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    up = own.select("key", F.explode(chain).alias("host"))
    frame = F.struct(F.length("parent.key").alias("depth"), F.col("parent.key").alias("key"), F.col("parent.host").alias("host"), F.col("parent.paths").alias("paths"))
    return up.join(own.alias("parent"), up["host"] == F.col("parent.host")).groupBy(up["key"]).agg(F.sort_array(F.collect_list(frame), asc=False).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, shard_hosts: int = SHARD_HOSTS) -> DataFrame:
    """Verdict of the longest fitting rule for each url.

    `rules` has host, path and verdict; a rule fits its host and all subdomains
    if the url's path starts with its path. The longest host wins, then the
    longest path; of equal rules, `block` before `allow`. Returns one row per
    input row: `id_col`, host, path, rule (host and path, null without one) and
    verdict (`default` without a rule). A null url, or one without `://`, has an
    empty host and path and no rule; an empty path fits no rule whose path isn't
    empty. An empty table gives an empty result; without rules, every verdict is
    the default. Equal rows are judged each; other columns are not looked at.
    """
    urls = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    hosts = urls.select("host").distinct().withColumn("key", key_of(F.col("host"))).withColumn("top", F.substring_index("key", ".", 1))
    shards = hosts.groupBy("top").agg(F.ceil(F.count("*") / shard_hosts).cast("int").alias("shards"))
    points = hosts.join(shards, "top").select("top", F.pmod(F.xxhash64("host"), F.col("shards")).cast("int").alias("salt"), "key", F.lit(1).alias("kind"), "host", F.lit(None).alias("stack"))
    opened = _openings(rules).withColumn("top", F.substring_index("key", ".", 1)).join(shards, "top")
    opened = opened.select("top", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("salt"), "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack")
    sweep = Window.partitionBy("top", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = opened.unionByName(points).select("host", "key", "kind", F.last("stack", ignorenulls=True).over(sweep).alias("stack")).where("kind = 1")
    # What has closed since is popped: an opening is active as long as keys start with its own.
    active = F.filter("stack", lambda f: F.startswith(F.col("key"), f["key"]))
    active = swept.select("host", F.flatten(F.transform(active, lambda f: F.transform(f["paths"], lambda p: F.struct(f["depth"].alias("depth"), F.length(p["path"]).alias("length"), p["verdict"].alias("verdict"), f["host"].alias("host"), p["path"].alias("path"))))).alias("active"))
    active = active.where(F.size("active") > 0)
    fits = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(fits)
    found = urls.join(active, "host", "left").select("_id", "host", "path", best.alias("best"))
    return found.select(F.col("_id").alias(id_col), "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    """All urls of `pages` against the fixed rules."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])
    return judge_urls(table(spark, sf_dir, "pages"), spark.range(1).select(F.inline(rows)))


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) AS k
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN f ON f.page_id = u.page_id AND k = 1
"""

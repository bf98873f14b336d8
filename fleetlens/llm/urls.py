"""URL rules by hashed host-suffix and path-prefix expressions (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without :// or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def url_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """All columns of urls with host, path, rule and verdict; columns of these names in urls are replaced.

    A rule (host, path, verdict) fits an url whose host is the rule's or a subdomain of it and whose path starts with the
    rule's. Of the rules that fit, that with the longest host and path together wins, then the one with the longer host, then
    block before allow. rule is the winner's host and path, null without one, and the verdict then is default.

    Method. Each distinct url gives an expression for every suffix of its host of as many labels, and every prefix of its path of
    as many characters, as some rule has, so an url of any length gives few; rules and expressions meet on the first prefix_digits hexadecimal digits of their SHA-256, and the full digests
    confirm. Whether rules or urls are many, the join is on equal short hashes, and Spark broadcasts rules only when they are
    known to be small. Rows that share an url are judged once.

    A null url, or one without ://, has empty host and path and fits no rule unless the rule's host and path are empty. Null
    rule fields count as empty; equal rules count once. Empty tables of urls give no rows, empty rules leave the default.
    """
    shape = rules.agg(F.collect_set(F.length(F.coalesce("path", F.lit("")))), F.collect_set(F.size(F.split(F.coalesce("host", F.lit("")), r"\."))))
    lengths, depths = map(sorted, shape.first())  # at most as many as an url has characters
    known = rules.select(F.coalesce("host", F.lit("")).alias("_r_host"), F.coalesce("path", F.lit("")).alias("_r_path"), F.col("verdict").alias("_r_verdict")).distinct()
    known = known.withColumn("_r_digest", _digest(F.col("_r_host"), F.col("_r_path"))).withColumn("_short", F.substring("_r_digest", 1, prefix_digits))
    each = urls.select(F.col(url_col).alias("_url")).distinct().withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))})
    labels = F.split("_host", r"\.")
    numbers = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")
    suffixes = F.transform(F.filter(numbers(depths), lambda n: n <= F.size("_labels")), lambda n: F.array_join(F.slice("_labels", F.size("_labels") - n + 1, n), "."))
    prefixes = F.transform(F.filter(numbers(lengths), lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))
    each = each.withColumn("_labels", labels)
    parts = each.select("_url", "_host", F.explode(suffixes).alias("_suffix"), prefixes.alias("_prefixes")).select("_url", "_suffix", F.explode("_prefixes").alias("_prefix"))
    parts = parts.withColumn("_digest", _digest(F.col("_suffix"), F.col("_prefix"))).select("_url", "_suffix", "_prefix", "_digest", F.substring("_digest", 1, prefix_digits).alias("_short"))
    met = parts.join(known, "_short").where("_digest = _r_digest and _suffix = _r_host and _prefix = _r_path")
    order = F.struct(F.length("_r_host") + F.length("_r_path"), F.length("_r_host"), F.col("_r_verdict") == "block")
    won = met.groupBy("_url").agg(F.max_by(F.struct(F.concat("_r_host", "_r_path").alias("rule"), F.col("_r_verdict").alias("verdict")), order).alias("_won"))
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    out = urls.join(won, urls[url_col].eqNullSafe(won["_url"]), "left")
    return out.select(*(urls[c] for c in kept), host_of(urls[url_col]).alias("host"), path_of(urls[url_col]).alias("path"), F.col("_won.rule").alias("rule"), F.coalesce("_won.verdict", F.lit(default)).alias("verdict"))


#: The contract's rules.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def contract_rules(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return spark.sql(f"select * from values {values} as t(host, path, verdict)")


ORACLE = (
    r"""
with rules(host, path, verdict) as (values """
    + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    + r"""),
u as (
  select page_id, url,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages),
each as (select distinct url, host, path from u),
won as (
  select e.url, arg_max({'rule': r.host || r.path, 'verdict': r.verdict}, length(r.host || r.path)) as w
  from each e join rules r on (e.host = r.host or ends_with(e.host, '.' || r.host)) and starts_with(e.path, r.path)
  group by e.url)
select u.page_id, u.host, u.path, won.w.rule as rule, coalesce(won.w.verdict, 'allow') as verdict
from u left join won on u.url is not distinct from won.url
"""
)

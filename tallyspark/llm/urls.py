"""URL filtering: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The list becomes a blocked Bloom filter: one row of eight 64-bit words per block, each URL setting one bit per word of
one block. Its number of blocks follows the list up to MAX_BLOCKS, so the broadcast stays under 16 MB whatever the list
holds; a fuller filter only passes more URLs on. URLs that the filter passes go to an exact join on the canonical URL,
which removes false positives; all others never leave their task.

A null URL, or one without `://`, has empty host and path and no canonical form: no rule fits and it isn't listed.
Repeated rows are kept; a repeated or null list entry counts once or not at all; an empty list blocks nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BLOCKS, bloom_filter, bloom_passes, columns_of, free_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: parameters that say where a visitor came from, not what the page is
TRACKING = r"(utm_[^=&]*|ref|gclid|fbclid)(=[^&]*)?"


NEW = ["url_host", "url_path", "url_canonical", "url_rule", "url_listed", "url_verdict"]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_path(df: DataFrame, url_col: str) -> DataFrame:
    """df with _url, _rest, _host, _path; host and path are empty where there is no ://."""
    df = df.withColumn("_url", F.col(url_col)).withColumn("_rest", F.expr("CASE WHEN instr(_url, '://') > 0 THEN substring(_url, instr(_url, '://') + 3) END"))
    host = F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), UPPER, LOWER)
    return df.withColumn("_host", F.coalesce(host, F.lit(""))).withColumn("_path", F.coalesce(F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def canonical() -> Column:
    """Of _rest, _host and _path: no scheme, www., default port, closing slash, fragment or tracking parameter; null without ://."""
    query = F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}$"))), "&")
    host = F.regexp_replace(F.regexp_replace("_host", r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace("_path", r"/+$", "")
    return F.when(F.col("_rest").isNotNull(), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def fits(rule: Rule) -> Column:
    host = F.col("_host")
    return ((host == rule.host) | host.endswith("." + rule.host)) & F.col("_path").startswith(rule.path)


def first_rule(rules: list[Rule], of) -> Column:
    """of(rule) of the longest rule that fits (of equals, one that blocks); else null. Rules are few and stay in the plan."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        out = F.when(fits(rule), F.lit(of(rule))).otherwise(out)
    return out


def bloom(listed: DataFrame) -> tuple[DataFrame, int]:
    """The blocked Bloom filter of listed._canon."""
    return bloom_filter(listed, F.xxhash64("_canon"), MAX_BLOCKS)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """pages with url_host, url_path, url_canonical, url_rule (null if none fits), url_listed and url_verdict.

    Columns that have these names already stay; the new ones get underscores until their names are free.
    """
    listed = host_path(listed.select(F.col(listed_col).alias("_listed")), "_listed").select(canonical().alias("_canon")).where("_canon is not null").distinct()
    words, blocks = bloom(listed)
    # own columns travel in one struct, so that none of their names can clash
    df = host_path(pages.select(F.struct(*columns_of(pages)).alias("_row"), F.col(f"`{url_col}`").alias("_url")), "_url")
    df = df.select("_row", "_host", "_path", canonical().alias("_canon"), first_rule(rules, lambda r: r.name).alias("_rule"), first_rule(rules, lambda r: r.verdict).alias("_said"))
    df = bloom_passes(df, words, blocks, F.xxhash64("_canon"), flag="_maybe")
    df = df.withColumn("_maybe", F.col("_maybe") & F.col("_canon").isNotNull())
    sure = df.where(~F.col("_maybe")).withColumn("_hit", F.lit(False))
    hits = df.where("_maybe").join(listed.withColumn("_in", F.lit(True)), "_canon", "left").withColumn("_hit", F.col("_in").isNotNull()).drop("_in")
    verdict = F.coalesce("_said", F.when(F.col("_hit"), "block").otherwise("allow"))
    new = zip(free_names(pages, NEW), (F.col("_host"), F.col("_path"), F.col("_canon"), F.col("_rule"), F.col("_hit"), verdict), strict=True)
    return sure.unionByName(hits).select("_row.*", *(c.alias(name) for name, c in new))


RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]
#: site names whose pages make up the query's list
LISTED_SITES = r"(^|\.)(adult-x|cheap-pills|free-bets|spam-farm)\."


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url; the list holds every url of the pages on LISTED_SITES."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = host_path(pages, "url").where(F.col("_host").rlike(LISTED_SITES)).select("url")
    out = filter_urls(pages, listed, RULES)
    return out.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"), F.col("url_canonical").alias("canonical"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, rest,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), c AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_full_match(p, '(utm_[^=&]*|ref|gclid|fbclid)(=[^&]*)?'))), '&') AS q
  FROM h
), k AS (
  SELECT page_id, host, path,
    CASE WHEN rest IS NOT NULL THEN regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '')
      || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical
  FROM c
), listed AS (
  SELECT DISTINCT canonical FROM k WHERE canonical IS NOT NULL AND regexp_matches(host, '(^|\.)(adult-x|cheap-pills|free-bets|spam-farm)\.')
), r AS (
  SELECT k.*, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM k
)
SELECT r.page_id, r.host, r.path, r.rule,
  CASE WHEN r.rule IN ('example.com/de/', 'net/') THEN 'block' WHEN r.rule IS NOT NULL THEN 'allow'
    WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  r.canonical
FROM r LEFT JOIN listed l ON r.canonical = l.canonical
"""

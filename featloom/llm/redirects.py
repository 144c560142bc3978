"""URL rules whose block decisions reach every alias of a page.

Pages that redirect to an address, or name it as canonical, are aliases of it. Aliases are the connected
components of these edges over addresses (host, path and query, without scheme and fragment). A url that
a rule fits has that rule's verdict. Any other url is blocked if its component holds a blocked address,
unless the component also holds one that a rule explicitly allows: an explicit allow comes first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm.base import load, named, query
from featloom.llm.components import components
from featloom.session import materialise

# (host, path, verdict); the rules of the query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
TARGET = r"(?is)\burl\s*=\s*['\"]?([^'\"\s>]+)"


def lowered(host: Column) -> Column:
    """A-Z only, as rules compare."""
    return F.translate(host, UPPER, LOWER)


def with_parts(rows: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Adds the host, path and address of a url.

    The host goes from the first ``://`` to ``/``, ``?``, ``#`` or the end, the path on to ``?``, ``#`` or
    the end; both are empty for a null url or one without ``://``. The address is what the urls of one
    page share, host, path and query; null without a host.
    """
    cut = rows.withColumns(
        {
            f"{prefix}host": F.coalesce(lowered(F.regexp_extract(url, PARTS, 1)), F.lit("")),
            f"{prefix}path": F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit("")),
            f"{prefix}rest": F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit("")),
        }
    )
    whole = F.concat(f"{prefix}host", f"{prefix}path", f"{prefix}rest")
    return cut.withColumn(f"{prefix}address", F.when(F.col(f"{prefix}host") != "", whole)).drop(f"{prefix}rest")


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule = verdict = F.when(F.lit(False), F.lit(""))
    for rule_host, rule_path, decision in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = rule.when(fits, F.lit(rule_host + rule_path)), verdict.when(fits, F.lit(decision))
    return rule, verdict


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def links(pages: DataFrame) -> DataFrame:
    """(source, target) urls of canonical links and refreshes in the whole of ``html``."""
    named_links = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select(
        "url", F.explode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("tag")
    )
    tag = F.col("tag")
    target = F.when(tag.rlike(CANONICAL), first_filled(*[F.regexp_extract(tag, HREF, i) for i in (1, 2, 3)])).when(
        tag.rlike(REFRESH), first_filled(F.regexp_extract(tag, TARGET, 1))
    )
    return named_links.select(F.col("url").alias("source"), F.replace(F.trim(target), F.lit("&amp;"), F.lit("&")).alias("target")).where(
        "target IS NOT NULL AND source IS NOT NULL"
    )


def resolved() -> Column:
    """The target as a full url; what it leaves out comes from the source."""
    target, base = F.col("target"), F.concat(F.lit("x://"), F.col("host"))
    folder = F.when(F.col("path") == "", F.lit("/")).otherwise(F.regexp_extract("path", r"(?s)^(.*/)", 1))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("x:"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .when(target.startswith("?"), F.concat(base, F.col("path"), target))
        .when(~target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.concat(base, folder, target))
    )


def edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(a, b) addresses that are aliases; ``redirects`` adds (source, target) urls of a crawl's log."""
    # Written before it is parsed: html is read once, and the plans of the steps stay small.
    found = materialise(links(pages), "links")
    if redirects is not None:
        found = found.unionByName(redirects.select("source", "target"))
    full = materialise(with_parts(found, "source").withColumn("full", resolved()).select("full", "address"), "links")
    ends = materialise(with_parts(full.withColumnRenamed("address", "a"), "full").select("a", F.col("address").alias("b")), "aliases")
    return ends.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def alias_verdicts(edges: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(address, verdict) of the addresses in components that hold a ruled one.

    Each component is reduced to two flags by partial sums, so one of any size is no single task's.
    """
    member = components(edges)
    _, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    parsed = with_parts(member.withColumn("url", F.concat(F.lit("x://"), F.col("node"))), "url")
    flagged = materialise(parsed.select("node", "component", ruled.alias("ruled")), "flagged")
    sums = flagged.where("ruled IS NOT NULL").groupBy("component").agg(F.max((F.col("ruled") == "allow").cast("int")).alias("allowed"))
    decided = sums.select("component", F.when(F.col("allowed") == 1, F.lit("allow")).otherwise(F.lit("block")).alias("verdict"))
    return flagged.where("ruled IS NULL").join(decided, "component").select(F.col("node").alias("address"), "verdict")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A null url, or one without ``://``, has an empty host and path and no address, so only the default,
    allow, is left to it; null html has no links. Repeated rows are judged one by one; a url on many
    rows is one address. Other columns are not looked at. An empty table gives no rows.
    """
    rows = pages.select(named(page_id).alias("page_id"), named("url").alias("url"), named("html").alias("html"))
    aliases = edges(rows, redirects)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = with_parts(rows.select("page_id", "url"), "url").select("page_id", "host", "path", "address", rule.alias("rule"), verdict.alias("ruled"))
    reached = alias_verdicts(aliases, rules).withColumnRenamed("verdict", "inherited")
    met = judged.join(reached, "address", "left")
    return met.select("page_id", "host", "path", "rule", F.coalesce("ruled", "inherited", F.lit("allow")).alias("verdict"))


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)', 2) AS path,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)', 3) AS rest
  FROM pages
), tags AS (
  SELECT host, path, rest, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE host <> ''
), raw AS (
  SELECT host, path, rest, replace(trim(CASE
    WHEN regexp_matches(tag, '(?is)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN
      coalesce(nullif(regexp_extract(tag, '(?is)\bhref\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(tag, '(?is)\bhref\s*=\s*''([^'']*)''', 1), ''), nullif(regexp_extract(tag, '(?is)\bhref\s*=\s*([^\s"''>]+)', 1), ''))
    WHEN regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN nullif(regexp_extract(tag, '(?is)\burl\s*=\s*[''"]?([^''"\s>]+)', 1), '')
  END), '&amp;', '&') AS target FROM tags
), urls AS (
  SELECT host || path || rest AS a, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN target
    WHEN starts_with(target, '//') THEN 'x:' || target
    WHEN starts_with(target, '/') THEN 'x://' || host || target
    WHEN starts_with(target, '?') THEN 'x://' || host || path || target
    WHEN NOT regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN 'x://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END || target
  END AS url FROM raw WHERE target IS NOT NULL
), edge AS (
  SELECT a, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS b
  FROM urls WHERE url IS NOT NULL
), both_ways AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b
), node AS (
  SELECT a AS node, regexp_extract(a, '(?s)^([^/?#]*)([^?#]*)', 1) AS host, regexp_extract(a, '(?s)^([^/?#]*)([^?#]*)', 2) AS path FROM (SELECT DISTINCT a FROM both_ways)
), rules(rule_host, rule_path, decision) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), seed AS (
  SELECT node, arg_max(decision, length(rule_host || rule_path)) AS verdict
  FROM node JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY node
), reach AS (SELECT node, verdict FROM seed UNION SELECT b, verdict FROM reach JOIN both_ways ON node = a
), inherited AS (SELECT node, min(verdict) AS verdict FROM reach GROUP BY node
), own AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(decision, length(rule_host || rule_path)) AS verdict
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, own.rule, coalesce(own.verdict, inherited.verdict, 'allow') AS verdict
FROM p LEFT JOIN own ON own.page_id = p.page_id LEFT JOIN inherited ON p.host <> '' AND inherited.node = p.host || p.path || p.rest
"""


@query("op3_redirect_filter", SQL)
def op3_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"))

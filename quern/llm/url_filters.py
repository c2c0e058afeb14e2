"""URL filters with redirect equivalence.

A rule blocks or allows a host, its subdomains and a path prefix. URLs that are the
same resource (redirects, canonical links, the same address under another scheme or
fragment) form a class; a block spreads to the members of the class that no rule
decides, unless an explicit allow stands in the class. All steps are DataFrame
operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.plans.shared import written

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Patterns of entities in attributes, in the order they are put back.
ENTITIES = (("&(?:quot|#34|#x22);", '"'), ("&(?:apos|#39|#x27);", "'"), ("&(?:#47|#x2f|sol);", "/"), ("&(?:amp|#38|#x26);", "&"))
#: ``rel`` with the word canonical among its words.
CANONICAL = r"""(?is)\brel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The address without scheme, default port and fragment; null without a host."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    return F.when(host != "", F.concat(host, F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; both null where none fits."""
    text = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _decoded(href: Column) -> Column:
    """An attribute's value with the entities that addresses have put back; ``&amp;`` goes last."""
    for entity, sign in ENTITIES:
        href = F.regexp_replace(href, f"(?i){entity}", sign)
    return href


def _target(url: Column, href: Column) -> Column:
    """``href`` as an absolute address, seen from ``url``."""
    href = F.trim(_decoded(href))
    base = F.regexp_extract(url, r"^([^?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^([^?#]*://[^?#]*/)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.startswith("/"), F.concat(base, href))
        .when(href == "", F.lit(None))
        .otherwise(F.concat(F.when(folder == "", F.concat(base, F.lit("/"))).otherwise(folder), href))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """Redirect edges ``url, target`` that the pages state: canonical links and meta refreshes.

    Only the tags of such links are read further; pages without one cost one search.
    """
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    found = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.explode(tags).alias("tag"))
    canonical = F.when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.when(F.col("tag").rlike(r"(?is)http-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    # a generator between the steps keeps the optimizer from copying one expression into the next
    found = found.select("url", F.explode(F.array(F.coalesce(canonical, refresh))).alias("href")).where("href <> ''")
    return found.select("url", F.explode(F.array(_target(F.col("url"), F.col("href")))).alias("target")).where("target is not null")


def judge_urls(pages: DataFrame, edges: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Judge each row of ``pages(page_id, url, html)``.

    ``edges(url, target)`` adds known redirects to those that the pages state. Returns
    ``page_id, host, path, rule, verdict, class_id, decided_by``: ``decided_by`` is
    rule, alias (a block that a class member spread) or default; ``class_id`` is the
    least page_id of the class.

    A null url or one without ``://`` has an empty host and path, is in no class
    (``class_id`` null) and is allowed by default. A null html states no edges. Equal
    urls and repeated rows are each judged, in one class. An empty table gives no rows.
    Other columns are ignored.
    """
    url = F.col("url")
    text, kind = rule_of(F.col("host"), F.col("path"), rules)
    p = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    p = p.withColumns({"rule": text, "own": kind})
    links = alias_edges(pages.select("url", "html"))
    if edges is not None:
        links = links.unionByName(edges.select("url", "target"))
    target = F.col("target")
    links = links.select(node_of(url).alias("a"), node_of(target).alias("b"), host_of(target).alias("host"), path_of(target).alias("path"))
    links = written(links.where("a is not null and b is not null").distinct(), "url-links")
    members = p.where("node is not null").select("node", "page_id", "own")
    if links.isEmpty():
        p = p.withColumn("class", F.col("node"))
        members = members.withColumn("class", F.col("node"))
    else:
        comp = written(connected_components(links), "url-classes").withColumnRenamed("component", "class")
        outside = links.select(F.col("b").alias("node"), F.lit(None).cast(p.schema["page_id"].dataType).alias("page_id"), kind.alias("own"))
        members = members.unionByName(outside).join(comp, "node", "left").withColumn("class", F.coalesce("class", "node"))
        p = p.join(comp, "node", "left").withColumn("class", F.coalesce("class", "node"))
    classes = members.groupBy("class").agg(
        F.min("page_id").alias("class_id"),
        F.bool_or(F.coalesce(F.col("own") == "block", F.lit(False))).alias("blocks"),
        F.bool_or(F.coalesce(F.col("own") == "allow", F.lit(False))).alias("allows"),
    )
    classes = written(classes, "url-verdicts")
    spread = F.col("blocks") & ~F.col("allows")
    return p.join(classes, "class", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(F.col("own").isNotNull(), F.col("own")).when(spread, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
        "class_id",
        F.when(F.col("own").isNotNull(), F.lit("rule")).when(spread, F.lit("alias")).otherwise(F.lit("default")).alias("decided_by"),
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql_rule(what: str) -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    return "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else kind}'" for kind, h, p in order
    ) + " ELSE NULL END"


def _sql_decoded(x: str) -> str:
    for entity, sign in ENTITIES:
        x = f"regexp_replace({x}, '(?i){entity}', '{sign.replace(chr(39), chr(39) * 2)}', 'g')"
    return x


_SQL_SPLIT = rf"""translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail"""
_SQL_NODE = "CASE WHEN host <> '' THEN regexp_replace(host, ':(80|443)$', '') || tail END AS node"
ORACLE = rf"""
WITH RECURSIVE r AS (SELECT page_id, url, html, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, url, html, {_SQL_SPLIT} FROM r),
p AS (SELECT page_id, url, html, host, path, {_SQL_NODE}, {_sql_rule('rule')} AS rule, {_sql_rule('kind')} AS own FROM s),
tags AS (SELECT url, node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
raws AS (SELECT url, node, CASE WHEN regexp_matches(tag, '{CANONICAL.replace("'", "''")}') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?is)http-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS raw FROM tags),
hrefs AS (SELECT url, node, trim({_sql_decoded('raw')}) AS href FROM raws),
targets AS (SELECT node AS a, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN 'http:' || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^([^?#]*://[^/?#]*)', 1) || href WHEN href = '' THEN NULL
  ELSE coalesce(nullif(regexp_extract(url, '^([^?#]*://[^?#]*/)', 1), ''), regexp_extract(url, '^([^?#]*://[^/?#]*)', 1) || '/') || href END AS target FROM hrefs),
rests AS (SELECT a, CASE WHEN strpos(target, '://') = 0 THEN '' ELSE substr(target, strpos(target, '://') + 3) END AS rest FROM targets WHERE target IS NOT NULL AND a IS NOT NULL),
ends AS (SELECT a, {_SQL_SPLIT} FROM rests),
links AS (SELECT DISTINCT a, node AS b, {_sql_rule('kind')} AS own FROM (SELECT a, host, path, {_SQL_NODE} FROM ends) WHERE node IS NOT NULL),
reach(x, y) AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT a, a FROM links UNION SELECT b, b FROM links UNION
  SELECT reach.x, n.y FROM reach JOIN (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links) n ON reach.y = n.x),
comp AS (SELECT x AS node, min(y) AS class FROM reach GROUP BY 1),
members AS (SELECT coalesce(c.class, m.node) AS class, page_id, own FROM (SELECT node, page_id, own FROM p WHERE node IS NOT NULL UNION ALL SELECT b, NULL, own FROM links) m LEFT JOIN comp c USING (node)),
classes AS (SELECT class, min(page_id) AS class_id, bool_or(coalesce(own = 'block', false)) AS blocks, bool_or(coalesce(own = 'allow', false)) AS allows FROM members GROUP BY 1)
SELECT page_id, host, path, rule, CASE WHEN own IS NOT NULL THEN own WHEN blocks AND NOT allows THEN 'block' ELSE 'allow' END AS verdict, class_id,
  CASE WHEN own IS NOT NULL THEN 'rule' WHEN blocks AND NOT allows THEN 'alias' ELSE 'default' END AS decided_by
FROM p LEFT JOIN comp USING (node) LEFT JOIN classes ON classes.class = coalesce(comp.class, p.node)
"""

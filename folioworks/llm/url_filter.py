"""URL verdicts from host and path rules, and from link-graph propagation where no rule speaks. Built-in functions only.

Rules: a rule fits its host and all subdomains of it when the path starts with the rule's; the longest rule wins (ties:
the one that sorts first). Method: hosts are nodes, links between hosts are edges. A host's share of pages that rules
allow seeds a personalised PageRank along the links (trust); its share of blocked pages seeds one against the links
(distrust: who links to blocked hosts). A page without a rule is blocked when its host's distrust exceeds its trust by
``threshold`` or more, both scaled so that an unlinked host has the share that seeded it.

Edges are the absolute links of the pages, and links both ways between a host and the host one label up, where both
have pages.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and the verdict of a host that
nothing is known of (allow); repeated rows are judged alike; urls and pages are read whole, however long; an empty table gives no
rows; without links the seeds alone decide; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, split_join

#: (action, host, path), as the queries use them.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([a-z][a-z0-9+.\-]*://[^\"'\s>]+)"
DAMPING = 0.85
#: A host that more than one page in so many has is looked up in a broadcast table.
COMMON_HOST = 1024
#: Share of what the seeds give that may still be on its way when the rounds end: each round hands on ``DAMPING`` of what is.
RESIDUAL = 0.01
THRESHOLD = 0.5


def rounds_for(residual: float, damping: float = DAMPING) -> int:
    """Rounds after which no more than ``residual`` of the seeds' mass is on its way, whatever the links are."""
    return max(1, math.ceil(math.log(residual) / math.log(damping)))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def suffixes(host: Column) -> Column:
    """The host and everything left of it when labels go from the front."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Per host with any rule: its rules, the longest first. ``rules`` has action, rule_host, rule_path."""
    fits = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("rule_host")).join(rules, "rule_host")
    rule = F.concat("rule_host", "rule_path")
    one = F.struct((-F.length(rule)).alias("order"), rule.alias("rule"), "action", "rule_path")
    return fits.groupBy("host").agg(F.array_sort(F.collect_list(one)).alias("rules"))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, and between a host and its parent where both have pages."""
    targets = F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    links = pages.filter("html is not null").select("host", targets.alias("to")).select(F.col("host").alias("src"), host_of(F.col("to")).alias("dst"))
    links = links.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    up = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("dst"))
    up = up.join(hosts.select(F.col("host").alias("dst")), "dst").select("src", "dst", F.lit(1).cast("long").alias("n"))
    both = links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    return both.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, residual: float = RESIDUAL) -> DataFrame:
    """(kind, host, score) of personalised PageRank, all scores of a kind together less than ``residual`` of its seeds below
    their limits. ``seeds`` has kind, host, seed; kind 1 walks the edges forwards, kind -1 backwards. What reaches a host without
    links stays there and is not handed on."""
    forward = edges.select(F.lit(1).alias("kind"), "src", "dst", "n")
    backward = edges.select(F.lit(-1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    steps = forward.unionByName(backward)
    out = steps.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    steps = materialise(steps.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("out")).alias("share")), "steps")
    given = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("part"))
    scores = given.select("kind", "host", F.col("part").alias("score"))
    for turn in range(rounds_for(residual, damping)):
        moved = steps.join(scores.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("part"))
        scores = given.unionByName(moved).groupBy("kind", "host").agg(F.sum("part").alias("score"))
        if turn % 4 == 3:
            scores = materialise(scores, "ranks")
    return scores


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, damping: float = DAMPING, residual: float = RESIDUAL) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust, distrust."""
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    hosts = materialise(base.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    named = hosts.filter("host <> ''")
    by_host = host_rules(named, rules)
    # Fewer than COMMON_HOST hosts have more than one in so many pages.
    frequent = materialise(hosts.filter(F.col("pages") > base.count() / COMMON_HOST), "frequent-hosts")
    ruled = split_join(base.select("page_id", "host", "path"), by_host, frequent, "host")
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    ruled = materialise(ruled.select("page_id", "host", "path", first.alias("_r")).select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.action").alias("action")), "ruled")
    shares = ruled.filter("action is not null").groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("a"), F.count_if(F.col("action") == "block").alias("b"))
    seeds = shares.join(hosts, "host").select("host", F.explode(F.array(F.struct(F.lit(1).alias("kind"), (F.col("a") / F.col("pages")).alias("seed")), F.struct(F.lit(-1).alias("kind"), (F.col("b") / F.col("pages")).alias("seed")))).alias("s")).select("s.kind", "host", "s.seed")
    seeds = materialise(seeds.filter("seed > 0"), "seeds")
    scores = propagate(seeds, host_edges(base, named), damping, residual)
    wide = scores.groupBy("host").agg(*[F.round(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)) / (1 - damping), 9).alias(name) for k, name in ((1, "trust"), (-1, "distrust"))])
    out = split_join(ruled, wide, frequent, "host").fillna(0.0, ["trust", "distrust"])
    by_method = F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", by_method).alias("verdict"), "trust", "distrust")


def oracle(rules=RULES, damping: float = DAMPING, residual: float = RESIDUAL, threshold: float = THRESHOLD) -> str:
    """The same judgement as DuckDB SQL, one CTE a round."""
    rounds = rounds_for(residual, damping)
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in rules)
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = LINK.replace("'", "''")
    turns = "".join(
        f""", r{i + 1} AS MATERIALIZED (SELECT kind, host, sum(part) AS score FROM (
    SELECT kind, host, part FROM given UNION ALL
    SELECT s.kind, s.dst, r.score * s.share * {damping} FROM steps s JOIN r{i} r ON r.kind = s.kind AND r.host = s.src) AS x GROUP BY kind, host)"""
        for i in range(rounds)
    )
    return rf"""
WITH rules(action, rule_host, rule_path) AS (VALUES {values}),
base AS MATERIALIZED (
  SELECT page_id, {lower(f"regexp_extract(coalesce(url, ''), '{URL}', 1)")} AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path, html FROM pages
), ruled AS MATERIALIZED (
  SELECT page_id, host, path, arg_min(rule, lpad(CAST(1000000 - length(rule) AS VARCHAR), 8, '0') || rule) AS rule,
         arg_min(action, lpad(CAST(1000000 - length(rule) AS VARCHAR), 8, '0') || rule) AS action
  FROM (SELECT b.page_id, b.host, b.path, r.rule_host || r.rule_path AS rule, r.action
        FROM base b LEFT JOIN rules r ON b.host <> '' AND (b.host = r.rule_host OR suffix(b.host, '.' || r.rule_host)) AND prefix(b.path, r.rule_path)) AS m
  GROUP BY page_id, host, path
), hosts AS MATERIALIZED (SELECT host, count(*) AS pages FROM base GROUP BY host),
links AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, {lower(f"regexp_extract(target, '{URL}', 1)")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS target FROM base) AS t) AS u
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), up AS (
  SELECT h.host AS src, p.host AS dst, 1 AS n FROM hosts h JOIN hosts p ON p.host = regexp_extract(h.host, '^[^.]+\.(.+)$', 1) AND p.host <> '' AND h.host <> ''
), edges AS MATERIALIZED (
  SELECT src, dst, sum(n) AS n FROM (SELECT * FROM links UNION ALL SELECT * FROM up UNION ALL SELECT dst, src, n FROM up) AS e GROUP BY src, dst
), steps AS MATERIALIZED (
  SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM (SELECT 1 AS kind, src, dst, n FROM edges UNION ALL SELECT -1, dst, src, n FROM edges) AS e
), shares AS (
  SELECT r.host, count(*) FILTER (action = 'allow') / any_value(h.pages) AS a, count(*) FILTER (action = 'block') / any_value(h.pages) AS b
  FROM ruled r JOIN hosts h USING (host) WHERE action IS NOT NULL GROUP BY r.host
), given AS MATERIALIZED (
  SELECT * FROM (SELECT 1 AS kind, host, a * {1 - damping} AS part FROM shares UNION ALL SELECT -1, host, b * {1 - damping} FROM shares) AS g WHERE part > 0
), r0 AS MATERIALIZED (SELECT kind, host, part AS score FROM given){turns},
wide AS (
  SELECT host, round(coalesce(sum(score) FILTER (kind = 1), 0) / {1 - damping}, 9) AS trust, round(coalesce(sum(score) FILTER (kind = -1), 0) / {1 - damping}, 9) AS distrust
  FROM r{rounds} GROUP BY host
)
SELECT page_id, ruled.host AS host, path, rule, coalesce(action, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM ruled LEFT JOIN wide ON wide.host = ruled.host
"""

"""Operator 2: URL filters by rules and by trust and distrust that spread over the host graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import hot_join, settled

#: (verdict, rule): a host and a path prefix.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host that any rule fits, by itself or as a subdomain, those rules, longest first."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    parted = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substring(rule, locate('/', rule))").alias("path"))
    fit = hosts.select("host", F.explode(suffixes).alias("suffix")).join(parted, "suffix")
    entry = F.struct((-F.length("rule")).alias("order"), "path", "rule", "verdict")
    return fit.groupBy("host").agg(F.sort_array(F.collect_set(entry)).alias("rules"))


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(source, target, links): links between different hosts; a relative link stays on its page's host, whatever base it has, and is none."""
    links = pages.select(host_of(F.col(url_col)).alias("source"), F.explode(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(HREF), F.lit(1))).alias("link"))
    links = links.withColumn("link", F.replace("link", F.lit("&amp;"), F.lit("&")))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    links = links.where(F.col("link").rlike(r"(?i)^([a-z][a-z0-9+.-]*:)?//")).select("source", host_of(absolute).alias("target"))
    return links.where("source <> '' AND target <> '' AND source <> target").groupBy("source", "target").agg(F.count("*").alias("links"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(kind, host, score): personalised PageRank of each kind's seeds (kind, host, seed) over its edges (kind, source, target, share).

    What hosts without edges hold goes back to the seeds. Stops when a round reaches no new host and the scores of all
    hosts together change by less than the tolerance, which takes about log(tolerance) / log(damping) rounds, or as many
    as the farthest host is links away.
    """
    outgoing = edges.select("kind", F.col("source").alias("host")).distinct().withColumn("links", F.lit(True))
    seeds, edges = settled(seeds.join(outgoing, ["kind", "host"], "left")), settled(edges)
    scores = seeds.select("kind", "host", F.col("seed").alias("score"), "links")
    reached = -1
    while True:
        stuck = scores.where("links IS NULL").groupBy("kind").agg(F.sum("score").alias("stuck"))
        moved = scores.join(edges.withColumnRenamed("source", "host"), ["kind", "host"]).select("kind", F.col("target").alias("host"), (F.col("score") * F.col("share") * damping).alias("part"))
        again = seeds.join(stuck, "kind", "left").select("kind", "host", (F.col("seed") * ((1 - damping) + damping * F.coalesce("stuck", F.lit(0.0)))).alias("part"))
        after = moved.unionByName(again).groupBy("kind", "host").agg(F.sum("part").alias("score"))
        after = settled(after.join(outgoing, ["kind", "host"], "left"))
        old = scores.select("kind", "host", F.col("score").alias("old"))
        told = after.join(old, ["kind", "host"], "full").agg(F.coalesce(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))), F.lit(0.0)).alias("change"), F.count("score").alias("hosts")).first()
        scores = after
        if told["change"] < tolerance and told["hosts"] == reached:
            break
        reached = told["hosts"]
    return scores.select("kind", "host", "score")


def host_scores(decided: DataFrame, edges: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(host, trust, distrust): trust runs along the links, distrust against them, from seed to seed weighed alike.

    decided has host and verdict (null: no rule fits) of each page. A host is a seed of trust if rules allow more than
    half of its pages, and of distrust if they block more than half.
    """
    shares = decided.where("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("verdict") == "allow", 1.0).otherwise(0.0)).alias("allowed"), F.avg(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)).alias("blocked"))
    seeds = shares.select("host", F.when(F.col("allowed") > 0.5, "trust").when(F.col("blocked") > 0.5, "distrust").alias("kind")).where("kind IS NOT NULL")
    seeds = settled(seeds)
    counts = seeds.groupBy("kind").agg(F.count("*").alias("n"))
    seeds = seeds.join(counts, "kind").select("kind", "host", (1.0 / F.col("n")).alias("seed"))
    ways = edges.select(F.lit("trust").alias("kind"), "source", "target", "links").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "links"))
    ways = settled(ways)
    total = ways.groupBy("kind", "source").agg(F.sum("links").alias("total"))
    ways = ways.join(total, ["kind", "source"]).select("kind", "source", "target", (F.col("links") / F.col("total")).alias("share"))
    scores = propagated(ways, seeds, damping, tolerance)
    return scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust"))


def judged_pages(
    pages: DataFrame,
    rules: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = 0.85,
    threshold: float = 0.5,
    tolerance: float = 1e-4,
) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, and the host's trust and distrust.

    The longest rule that fits a url decides. Where none does, the host is blocked if distrust makes up more than
    threshold of its trust and distrust together, else allowed; so a host that no seed reaches is allowed. A null url, or
    one without "://", has an empty host and path, no rule, and is allowed. Only the href of an <a> counts as a link. A null html has no links; an empty table
    gives no rows; repeated pages are judged each; a long html is read whole. Other columns are not read.
    """
    spark = pages.sparkSession
    rules = spark.createDataFrame(RULES, "verdict string, rule string") if rules is None else rules
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    hosts = settled(urls.groupBy("host").agg(F.count("*").alias("n")))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    known = settled(hosts.join(host_rules(hosts.select("host"), rules), "host", "left"))
    fits = hot_join(urls, known, ["host"], "n", total).withColumn("hit", F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0)))
    decided = settled(fits.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict")))
    scores = settled(host_scores(decided, settled(host_edges(pages, url_col, html_col)), damping, tolerance))
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(distrust > threshold * (trust + distrust), F.lit("block")).otherwise(F.lit("allow"))
    known = settled(hosts.join(scores, "host", "left"))
    return hot_join(decided, known, ["host"], "n", total).select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def query(spark, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page."""
    return judged_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH RECURSIVE rules(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
parted AS (SELECT verdict, rule, rule[1:strpos(rule, '/') - 1] AS suffix, rule[strpos(rule, '/'):] AS start FROM rules),
p AS (SELECT row_number() OVER () AS r, page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
fit AS (SELECT r, first(rule ORDER BY length(rule) DESC) AS rule, first(verdict ORDER BY length(rule) DESC) AS verdict FROM p JOIN parted ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, start) GROUP BY r),
decided AS (SELECT p.*, rule, verdict FROM p LEFT JOIN fit USING (r)),
shares AS (SELECT host, count(*) FILTER (verdict = 'allow') / count(*) AS allowed, count(*) FILTER (verdict = 'block') / count(*) AS blocked FROM decided WHERE host <> '' GROUP BY 1),
kinds AS (SELECT host, CASE WHEN allowed > 0.5 THEN 'trust' WHEN blocked > 0.5 THEN 'distrust' END AS kind FROM shares),
seeds AS (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS seed FROM kinds WHERE kind IS NOT NULL),
hrefs AS (SELECT host AS source, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS link FROM p),
targets AS (SELECT source, translate(regexp_extract(CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target FROM (SELECT source, replace(link, '&amp;', '&') AS link FROM hrefs) WHERE regexp_matches(link, '(?i)^([a-z][a-z0-9+.-]*:)?//')),
edges AS (SELECT source, target, count(*) AS links FROM targets WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL),
ways AS (SELECT 'trust' AS kind, source, target, links FROM edges UNION ALL SELECT 'distrust', target, source, links FROM edges),
moves AS (SELECT kind, source, target, links / sum(links) OVER (PARTITION BY kind, source) AS share FROM ways),
hosts AS (SELECT kind, host FROM seeds UNION SELECT kind, source FROM ways UNION SELECT kind, target FROM ways),
steps AS (
  SELECT kind, source, target, 0.85::DOUBLE * share AS w FROM moves
  UNION ALL SELECT h.kind, h.host, s.host, (CASE WHEN EXISTS (SELECT 1 FROM moves m WHERE m.kind = h.kind AND m.source = h.host) THEN 0.15 ELSE 1 END)::DOUBLE * seed FROM hosts h JOIN seeds s ON s.kind = h.kind),
ranks AS (
  SELECT 0 AS n, kind, host, seed AS score FROM seeds
  UNION ALL
  SELECT n, kind, host, sum(part) FROM (SELECT ranks.n + 1 AS n, ranks.kind, steps.target AS host, ranks.score * steps.w AS part FROM ranks JOIN steps ON steps.kind = ranks.kind AND steps.source = ranks.host WHERE ranks.n < 80) GROUP BY n, kind, host),
scores AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM ranks WHERE n = 80 GROUP BY 1)
SELECT page_id, d.host, path, rule, coalesce(verdict, CASE WHEN distrust > 0.5 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict FROM decided d LEFT JOIN scores s ON s.host = d.host
"""

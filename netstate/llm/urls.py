"""URL filters: rules, and trust and distrust that spread over a graph of hosts. DataFrame functions only.

Edges are links between hosts (absolute addresses in pages) and the step from a host to its parent domain. Trust is personalised
PageRank from hosts whose pages the rules allow, along edges; distrust starts at hosts whose pages they block and goes against
the edges. Seeds weigh as much as the share of their pages that a rule decides. A host is blocked if its distrust exceeds its
trust by ``threshold`` (in units of what a wholly blocked host without neighbours has).
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.session import discard, materialize

#: (host, beginning of the path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 8, 1 / 3
LINK = r"""(?i)href\s*=\s*["']?[a-z][a-z0-9+.-]*://([^/?#"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def located(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path of ``url``; both empty for null or without ``://``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (pages.withColumn("host", _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)))
            .withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)))


def ruled(located_pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict: of the longest rule whose host is the page's or a parent of it and whose path begins the page's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return located_pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, counted, and one step from each host to its parent domain."""
    links = (pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
             .select("src", _lower(F.col("dst")).alias("dst")).where("src <> dst")
             .groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
    hosts = pages.where("host <> ''").select("host").union(links.select("dst")).distinct()
    labels = F.split("host", "[.]")
    level = hosts.select(labels.alias("l"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("i")).where("i < size(l)")
    parents = level.select(F.array_join(F.slice("l", F.col("i"), F.size("l")), ".").alias("src"),
                           F.array_join(F.slice("l", F.col("i") + 1, F.size("l")), ".").alias("dst"),
                           F.lit(1.0).alias("weight")).distinct()
    return links.union(parents).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def host_scores(pages: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of every host of pages, links and parent domains. ``pages``: rows of ``ruled``."""
    edges = host_edges(pages)
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("into"))
    edges = materialize(edges.join(out, "src").join(into, "dst").select(
        "src", "dst", (F.col("weight") / F.col("out")).alias("along"), (F.col("weight") / F.col("into")).alias("against")), "host-edges")
    share = pages.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("rule_verdict") == "allow", 1.0).otherwise(0.0)).alias("good"),
        F.avg(F.when(F.col("rule_verdict") == "block", 1.0).otherwise(0.0)).alias("bad"))
    nodes = edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(share.select("host")).distinct()
    seeds = materialize(nodes.join(share, "host", "left").fillna(0.0, ["good", "bad"]), "seeds")
    start = seeds.select("host", (F.col("good") * (1 - damping)).alias("trust"), (F.col("bad") * (1 - damping)).alias("distrust"))
    now, tables = start, []
    for k in range(rounds):
        moved = (edges.join(now.withColumnRenamed("host", "src"), "src")
                 .select(F.col("dst").alias("host"), (F.col("trust") * F.col("along")).alias("t"), F.lit(0.0).alias("d"))
                 .union(edges.join(now.withColumnRenamed("host", "dst"), "dst")
                        .select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("against")).alias("d")))
                 .groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d")))
        now = start.join(moved, "host", "left").select(
            "host", (F.col("trust") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            (F.col("distrust") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"))
        if k % 2:                                                  # a short lineage, and scores are computed once
            now = materialize(now, "host-scores")
            tables.append(now)
    discard(*tables[:-1])
    return now


def filtered_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict of every page: the rule's verdict, else that of the host's trust and distrust.

    Pages without a host are allowed. Repeated rows are judged each; extra columns are left behind.
    """
    judged = ruled(located(pages.select("page_id", "url", "html")), rules)
    bad = host_scores(judged).where(F.col("distrust") - F.col("trust") >= threshold * (1 - DAMPING)).select(
        F.col("host").alias("bad_host"))
    return judged.join(bad, judged.host == bad.bad_host, "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def _sql() -> str:
    """The same in SQL, rounds written out one after the other."""
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fit = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for h, p, _ in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fit, rules)) + " END"
    says = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fit, rules)) + " END"
    up, low = string.ascii_uppercase, string.ascii_lowercase
    link = LINK.replace("'", "''")
    parts = [f"""
WITH rest AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
loc AS (SELECT page_id, html, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), '{up}', '{low}') AS host,
  regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
judged AS (SELECT *, {rule} AS rule, {says} AS says FROM loc),
links AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT host AS src,
  translate(unnest(regexp_extract_all(html, '{link}', 1)), '{up}', '{low}') AS dst FROM judged WHERE host <> '') WHERE src <> dst GROUP BY ALL),
hosts AS (SELECT host FROM judged WHERE host <> '' UNION SELECT dst FROM links),
lev AS (SELECT string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')))) AS i FROM hosts),
parents AS (SELECT DISTINCT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst, 1.0::DOUBLE AS weight FROM lev),
raw AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT * FROM parents) GROUP BY ALL),
edges AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS along, weight / sum(weight) OVER (PARTITION BY dst) AS against FROM raw),
share AS (SELECT host, avg(CASE WHEN says = 'allow' THEN 1.0 ELSE 0.0 END) AS good, avg(CASE WHEN says = 'block' THEN 1.0 ELSE 0.0 END) AS bad
  FROM judged WHERE host <> '' GROUP BY host),
nodes AS (SELECT src AS host FROM edges UNION SELECT dst FROM edges UNION SELECT host FROM share),
s0 AS (SELECT host, coalesce(good, 0) * {1 - DAMPING} AS trust, coalesce(bad, 0) * {1 - DAMPING} AS distrust FROM nodes LEFT JOIN share USING (host))"""]
    for k in range(1, ROUNDS + 1):
        parts.append(f"""s{k} AS (SELECT s0.host, s0.trust + {DAMPING} * coalesce(t, 0) AS trust, s0.distrust + {DAMPING} * coalesce(d, 0) AS distrust
  FROM s0 LEFT JOIN (SELECT dst AS host, sum(trust * along) AS t FROM edges JOIN s{k - 1} ON src = host GROUP BY dst) a ON s0.host = a.host
  LEFT JOIN (SELECT src AS host, sum(distrust * against) AS d FROM edges JOIN s{k - 1} ON dst = host GROUP BY src) b ON s0.host = b.host)""")
    return ",\n".join(parts) + f"""
SELECT page_id, judged.host, path, rule, coalesce(says, CASE WHEN distrust - trust >= {THRESHOLD * (1 - DAMPING)} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN s{ROUNDS} ON judged.host = s{ROUNDS}.host"""


SQL = _sql()

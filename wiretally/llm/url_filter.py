"""Host verdicts by trust and distrust over the links between hosts, refined by URL rules.

Trust starts at hosts whose pages an allow rule admits and follows links; distrust starts at
hosts whose pages a block rule rejects and follows links backwards: who links to a blocked host
is suspect. Both are personalised PageRank by a fixed number of rounds. A host is blocked where
its distrust outweighs its trust. Ranks are whole numbers, so results do not depend on the order
of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.session import materialise

#: (verdict, host, path); a rule holds for the host and its subdomains where the path starts so.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Total rank of either kind, share that follows links (in hundredths), rounds.
SCALE = 10**15
FOLLOW = 85
ROUNDS = 10
#: A host is blocked where distrust exceeds this many hundredths of trust.
MARGIN = 100


def host_of(url: Column) -> Column:
    authority = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(authority, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits as text (host and path), and its verdict; both null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule = F.when(fits, domain + start).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct links (src, dst) between different hosts, from the ``href`` values of the pages."""
    links = F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(links)).alias("link"))
    absolute = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return found.select("src", host_of(absolute).alias("dst")).where("dst <> '' AND src <> '' AND src <> dst").distinct()


def _spread(seeds: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """(host, rank): personalised PageRank from ``seeds`` (host, seed) along ``edges`` (src, dst)."""
    degrees = edges.groupBy("src").agg(F.count("*").alias("degree"))
    start = seeds.select("host", (F.col("seed") * (100 - FOLLOW)).alias("base"))
    routes = materialise(edges.join(degrees, "src"), f"{label}-routes")
    rank = seeds.select("host", F.col("seed").alias("rank"))
    if not routes.take(1):
        return start.select("host", F.expr("base div 100").alias("rank"))
    for n in range(ROUNDS):
        sent = routes.join(rank, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), F.expr(f"(rank * {FOLLOW}) div 100 div degree").alias("part"))
        parts = start.select("host", F.expr("base div 100").alias("part")).union(sent)
        rank = parts.groupBy("host").agg(F.sum("part").alias("rank"))
        rank = materialise(rank, f"{label}-rank") if n % 2 else rank
    return rank


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Verdict of every row of ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has an empty host and path and is allowed; null html has
    no links; repeated rows are judged each; an empty table gives no row; other columns are
    ignored. The longest fitting rule decides; else the host's trust (default: allow).
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    named = named.select("*", rule.alias("rule"), verdict.alias("stated"))
    counts = named.where("host <> ''").groupBy("host").agg(F.count_if(F.col("stated") == "allow").alias("good"), F.count_if(F.col("stated") == "block").alias("bad"))
    counts = materialise(counts, "host-seeds")
    total = counts.agg(F.greatest(F.sum("good"), F.lit(1)).alias("goods"), F.greatest(F.sum("bad"), F.lit(1)).alias("bads"))

    def seeds(count: str, whole: str) -> DataFrame:
        share = F.expr(f"CAST({count} AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(17,0)) div {whole}")
        return counts.where(f"{count} > 0").join(F.broadcast(total)).select("host", share.alias("seed"))

    edges = materialise(host_edges(pages), "host-edges")
    trust = _spread(seeds("good", "goods"), edges, "trust").select("host", F.col("rank").alias("trust"))
    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = _spread(seeds("bad", "bads"), backward, "distrust").select("host", F.col("rank").alias("distrust"))
    blocked = distrust.join(trust, "host", "left").where(
        F.col("distrust").cast("decimal(38,0)") * 100 > F.coalesce("trust", F.lit(0)).cast("decimal(38,0)") * MARGIN
    )
    blocked = blocked.select("host", F.lit(True).alias("suspect"))
    return named.join(blocked, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(F.col("stated").isNotNull(), F.col("stated")).when(F.col("suspect"), "block").otherwise("allow").alias("verdict"),
    )


def _oracle_rounds(name: str, seeds: str, edges: str) -> str:
    """Unrolled rounds of :func:`_spread` as common table expressions."""
    steps = [
        f"{name}_degrees AS (SELECT src, count(*) AS degree FROM {edges} GROUP BY src)",
        f"{name}_0 AS (SELECT host, seed AS rank FROM {seeds})",
    ]
    for n in range(ROUNDS):
        steps.append(
            f"""{name}_{n + 1} AS MATERIALIZED (SELECT host, CAST(sum(part) AS BIGINT) AS rank FROM (
  SELECT host, seed * {100 - FOLLOW} // 100 AS part FROM {seeds}
  UNION ALL SELECT e.dst, (r.rank * {FOLLOW}) // 100 // d.degree
  FROM {edges} e JOIN {name}_degrees d USING (src) JOIN {name}_{n} r ON r.host = e.src) GROUP BY host)"""
        )
    return ",\n".join(steps)


def oracle(rules=RULES) -> str:
    """The same for DuckDB, over the table ``pages``."""
    cases = {"rule": [], "stated": []}
    for kind, domain, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = f"WHEN (host = '{domain}' OR host LIKE '%.{domain}') AND starts_with(path, '{start}')"
        cases["rule"].append(f"{fits} THEN '{domain + start}'")
        cases["stated"].append(f"{fits} THEN '{kind}'")
    lower = "translate(coalesce(regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = "CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END"
    return f"""
WITH parts AS (
  SELECT page_id, html, {lower.format("url")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
named AS (
  SELECT *, CASE {" ".join(cases["rule"])} END AS rule, CASE {" ".join(cases["stated"])} END AS stated FROM parts),
counts AS (
  SELECT host, count(*) FILTER (stated = 'allow') AS good, count(*) FILTER (stated = 'block') AS bad
  FROM named WHERE host <> '' GROUP BY host),
totals AS (SELECT greatest(sum(good), 1) AS goods, greatest(sum(bad), 1) AS bads FROM counts),
trusted AS (SELECT host, CAST(CAST(good AS HUGEINT) * {SCALE} // goods AS BIGINT) AS seed FROM counts, totals WHERE good > 0),
blocked AS (SELECT host, CAST(CAST(bad AS HUGEINT) * {SCALE} // bads AS BIGINT) AS seed FROM counts, totals WHERE bad > 0),
found AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS link FROM parts),
ends AS (SELECT src, {lower.format(link)} AS dst FROM found),
edges AS (SELECT DISTINCT src, dst FROM ends WHERE src <> '' AND dst <> '' AND src <> dst),
backward AS (SELECT dst AS src, src AS dst FROM edges),
{_oracle_rounds("trust", "trusted", "edges")},
{_oracle_rounds("distrust", "blocked", "backward")},
suspects AS (
  SELECT d.host FROM distrust_{ROUNDS} d LEFT JOIN trust_{ROUNDS} t USING (host)
  WHERE CAST(d.rank AS HUGEINT) * 100 > CAST(coalesce(t.rank, 0) AS HUGEINT) * {MARGIN})
SELECT page_id, host, path, rule,
  coalesce(stated, CASE WHEN s.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN suspects s USING (host)
"""

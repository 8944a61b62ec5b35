"""URL filters: rules, and where none fits, trust and distrust that spread over host links.

A rule is a host and the beginning of a path; it fits its host and all subdomains, the longest
wins. Host edges are the absolute links in pages, and those of the host tree: a host and the
domain above it vouch for each other, up to the registered domain and not beyond (the last two
labels; public suffixes of two labels are a parameter). Trust starts at hosts by the number of their
pages that rules allow, distrust by those that rules block; both seeds sum to one. Trust spreads along
edges (personalised PageRank), distrust against them (a page that links to blocked hosts is
suspect). Hosts without edges out give their share back to the seeds, which is the same as
scaling the scores to sum to one in the end. A host is blocked where distrust has more than
`threshold` of its two scores together, and more than `least` of an even share of all distrust (one
over the number of hosts), so the number of hosts and pages doesn't matter. Only DataFrame functions are used; each round is two joins on host edges and sums, and is written, so that
lineage stays short.

Defined cases: a null url, or one without `://`, has an empty host and path and is allowed unless a
rule fits; an empty host has no edges; links to the host itself don't count; null html has no
links; repeated pages count as often as they come; a host with neither score is allowed; other
columns are not read. Without any edge the seeds alone decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: LEAST: of an even share of all distrust, what a blocked host has at least.
ROUNDS, DAMPING, THRESHOLD, LEAST = 10, 0.85, 0.5, 0.5
#: Public suffixes of two labels below which domains are registered.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
#: The rules of op4 (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def url_part(url: str, group: int) -> Column:
    """Host (1, in lower case) or path (2) of a url; empty where there is none."""
    part = F.coalesce(F.regexp_extract(url, _PARTS, group), F.lit(""))
    return F.translate(part, _CAPITALS, _SMALL) if group == 1 else part


def ruled(rules: list[tuple[str, str, str]], what: str) -> Column:
    """The rule (`host/path`) or its verdict that fits host and path; null if none does."""
    out = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        out = F.when(fits, F.lit(verdict if what == "verdict" else host + path)).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst) of linked hosts, once each."""
    found = pages.select(url_part("url", 1).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("dst"))
    return found.select("src", F.translate("dst", _CAPITALS, _SMALL).alias("dst")).where("src <> '' and src <> dst").distinct()


def host_tree(hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(src, dst) between each host, and each domain above it, and the next one up, both ways."""
    labels = F.split("host", r"\.")
    top = F.when(F.array_join(F.slice(labels, -2, 2), ".").isin(*suffixes), 3).otherwise(2)
    name = F.filter(labels, lambda x: x != "")
    named = hosts.where((F.size(name) == F.size(labels)) & ~F.col("host").rlike("^[0-9.]+(:[0-9]+)?$")).where(F.size(labels) > top)
    steps = F.transform(F.sequence(F.lit(1), F.size(labels) - top), lambda n: F.struct(F.array_join(F.slice(labels, n, F.size(labels)), ".").alias("low"), F.array_join(F.slice(labels, n + 1, F.size(labels)), ".").alias("high")))
    pairs = named.select(F.explode(steps).alias("s")).select("s.low", "s.high").distinct()
    return pairs.select(F.col("low").alias("src"), F.col("high").alias("dst")).unionByName(pairs.select(F.col("high").alias("src"), F.col("low").alias("dst")))


def host_scores(hosts: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """hosts (host, trust0, distrust0: any amounts) and distinct edges (src, dst) to (host,
    trust, distrust, even), with hosts that only edges know; the scores sum to one each, even is one over their number."""
    edges = common.written(edges)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    seeds = common.written(hosts.join(ends, "host", "full").na.fill(0.0, ["trust0", "distrust0"]))
    sums = seeds.agg(F.sum("trust0").alias("trust"), F.sum("distrust0").alias("distrust")).first()
    out = edges.groupBy("src").agg(F.count("*").alias("n_out"))
    back = edges.groupBy("dst").agg(F.count("*").alias("n_in"))
    weighted = common.written(edges.join(out, "src").join(back, "dst"))
    start = [(F.col(f"{c}0") * ((1 - damping) / sums[c]) if sums[c] else F.lit(0.0)).alias(c) for c in ("trust", "distrust")]
    now = common.written(seeds.select("host", *start, *(c.alias(f"{n}_start") for c, n in zip(start, ("trust", "distrust"), strict=True))))
    for _ in range(rounds):
        given = weighted.join(now.select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (F.col("trust") / F.col("n_out")).alias("gain"), F.lit(0.0).alias("blame"))
        blamed = weighted.join(now.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("gain"), (F.col("distrust") / F.col("n_in")).alias("blame"))
        moved = given.unionByName(blamed).groupBy("host").agg(F.sum("gain").alias("gain"), F.sum("blame").alias("blame"))
        step = [(F.col(f"{c}_start") + damping * F.coalesce(m, F.lit(0.0))).alias(c) for c, m in (("trust", "gain"), ("distrust", "blame"))]
        before, now = now, common.written(now.join(moved, "host", "left").select("host", *step, "trust_start", "distrust_start"))
        common.drop_table(before)
    total = now.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"), F.count("*").alias("n")).first()
    return now.select("host", *((F.col(c) / total[c] if total[c] else F.lit(0.0)).alias(c) for c in ("trust", "distrust")), F.lit(1 / max(1, total["n"])).alias("even"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD, least: float = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict, spread (whether the propagation decides) of every page."""
    rules = RULES if rules is None else rules
    parts = pages.select("page_id", url_part("url", 1).alias("host"), url_part("url", 2).alias("path"))
    parts = parts.withColumns({"rule": ruled(rules, "rule"), "ruled": ruled(rules, "verdict")})
    n = {f"{n}0": F.count_if(F.col("ruled") == v).cast("double") for n, v in (("trust", "allow"), ("distrust", "block"))}
    hosts = common.written(parts.where("host <> ''").groupBy("host").agg(*(c.alias(k) for k, c in n.items())))
    scores = host_scores(hosts, host_links(pages).unionByName(host_tree(hosts)).distinct(), rounds, damping)
    marked = scores.select("host", ((F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))) & (F.col("distrust") > least * F.col("even"))).alias("bad"), (F.col("trust") + F.col("distrust") > 0).alias("scored"))
    out = parts.join(common.small(common.written(marked)), "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"), (F.col("ruled").isNull() & F.coalesce("scored", F.lit(False))).alias("spread"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "pages"))


def _sql() -> str:
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = "".join(f"\n      WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'" for _, h, p in order)
    rule, verdict = fits.format(*(h + p for _, h, p in order)), fits.format(*(v for v, _, _ in order))
    link = _LINK.replace("'", "''")
    steps = "".join(
        f""", n{k + 1} AS (
  SELECT s.host, s.trust + {DAMPING} * coalesce(g.gain, 0) AS trust, s.distrust + {DAMPING} * coalesce(b.blame, 0) AS distrust FROM n0 s
  LEFT JOIN (SELECT dst AS host, sum(trust / n_out) AS gain FROM edges JOIN n{k} ON host = src GROUP BY dst) g USING (host)
  LEFT JOIN (SELECT src AS host, sum(distrust / n_in) AS blame FROM edges JOIN n{k} ON host = dst GROUP BY src) b USING (host))"""
        for k in range(ROUNDS)
    )
    return f"""
WITH parts AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '{_PARTS}', 1), ''), '{_CAPITALS}', '{_SMALL}') AS host, coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path FROM pages
), ruled AS (
  SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS ruled FROM parts
), links AS (
  SELECT DISTINCT src, dst FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_CAPITALS}', '{_SMALL}') AS dst FROM parts) WHERE src <> '' AND src <> dst
), named AS (
  SELECT DISTINCT string_split(host, '.') AS l, CASE WHEN regexp_extract(host, '[^.]*[.][^.]*$') IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) THEN 3 ELSE 2 END AS top
  FROM parts WHERE host <> '' AND NOT regexp_matches(host, '^[0-9.]+(:[0-9]+)?$') AND NOT list_contains(string_split(host, '.'), '')
), tree AS (
  SELECT DISTINCT array_to_string(l[n:], '.') AS low, array_to_string(l[n + 1:], '.') AS high FROM (SELECT l, unnest(range(1, len(l) - top + 1)) AS n FROM named WHERE len(l) > top)
), edges AS (
  SELECT src, dst, count(*) OVER (PARTITION BY src) AS n_out, count(*) OVER (PARTITION BY dst) AS n_in
  FROM (SELECT src, dst FROM links UNION SELECT low, high FROM tree UNION SELECT high, low FROM tree)
), seeds AS (
  SELECT host, CAST(count(*) FILTER (ruled = 'allow') AS DOUBLE) AS trust, CAST(count(*) FILTER (ruled = 'block') AS DOUBLE) AS distrust FROM ruled WHERE host <> '' GROUP BY host
), n0 AS (
  SELECT host, coalesce(trust, 0) * (1 - {DAMPING}) / nullif(sum(trust) OVER (), 0) AS trust, coalesce(distrust, 0) * (1 - {DAMPING}) / nullif(sum(distrust) OVER (), 0) AS distrust
  FROM seeds FULL JOIN (SELECT src AS host FROM edges UNION SELECT dst FROM edges) USING (host)
){steps}, scored AS (
  SELECT host, coalesce(trust / sum(trust) OVER (), 0) AS t, coalesce(distrust / sum(distrust) OVER (), 0) AS d, 1.0 / count(*) OVER () AS even FROM n{ROUNDS}
)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN d > {THRESHOLD} * (t + d) AND d > {LEAST} * even THEN 'block' ELSE 'allow' END) AS verdict, ruled IS NULL AND coalesce(t + d > 0, FALSE) AS spread
FROM ruled r LEFT JOIN scored n ON n.host = r.host
"""


OP4_SQL = _sql()

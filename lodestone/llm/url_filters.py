"""URL filters: rules by host and path, and link-graph propagation for hosts that no rule fits.

Hosts that an allow rule fits are trusted seeds, those that a block rule fits are blocked seeds. Personalised
PageRank carries trust along the links between hosts, and distrust along the reversed links. A seed
starts with the share of its pages that its rule fits. What a host gets from a neighbour is weighed by the share of its
own links that the two have in common (distrust: of the links that it makes, trust: of those that it gets), so that its rank is
the personalised PageRank that walks from the host itself give to the seeds. Neither the number of seeds nor the
number of other hosts that link to one of them dilutes it, at any distance, and one neighbourhood gets one verdict at every size. A host without a
rule is blocked if its distrust is at least LEAST and exceeds its trust. A round is one join and one
aggregation over the distinct host edges; there are ROUNDS of them, fewer only if nothing moves any more.

Edges come from absolute and scheme-relative links of a page, from the host that its copyright line
names, and from names: a host and its parent domain, down to two
labels, are linked both ways. Links inside a host are no edges.

Cases: a null url, or one without ://, has an empty host and path, fits no rule and is allowed; a null or empty
html has no links; ties between rules of one length go to block; repeated pages count their links
again; numbers and names of more than MAX_LABELS labels have no parents; an empty table gives an empty result; extra columns are ignored. Masses are
added as decimals, so the order of sums doesn't show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, join_keyed, scratch

# The rules of the query, (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rules are literals of the plan; more than this many are refused.
MAX_RULES = 1000
#: What the rounds after the last one would bring is under 0.7 ** 16, a third of a percent.
DAMPING, ROUNDS = 0.7, 16
#: A host of which all links go to wholly blocked hosts gets 0.21, one of which all links go to such a host 0.147.
LEAST = 0.05
MAX_LABELS = 127
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = "(?i)(?:href|src)\\s*=\\s*[\"'](?:[a-z][a-z0-9+.-]*:)?//([^\"'/?#\\s]+)"
NAMED = "&copy;\\s*((?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,})"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(h: Column, p: Column, rules: tuple = RULES) -> Column:
    """Struct of rule (host and path as one string) and verdict of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit in a plan")
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2])):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        named = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, named) if out is None else out.when(fits, named)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def _parents(hosts: DataFrame) -> DataFrame:
    """(src, dst) of each of hosts (host) and its parent domain, of that and its own one, and so on; not reversed."""
    bare = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    labels = hosts.select("host", F.split(bare, "\\.").alias("l")).where((F.size("l") <= MAX_LABELS) & F.col("host").rlike("[a-z]"))
    above = labels.where("size(l) > 2").select("host", "l", F.explode(F.sequence(F.lit(1), F.size("l") - 2)).alias("i"))
    name = lambda i: F.array_join(F.slice("l", i + 1, F.size("l")), ".")
    return above.select(F.when(F.col("i") == 1, F.col("host")).otherwise(name(F.col("i") - 1)).alias("src"), name(F.col("i")).alias("dst")).distinct()


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts. pages: host, html."""
    named = F.concat(F.regexp_extract_all("html", F.lit(LINK), 1), F.regexp_extract_all("html", F.lit(NAMED), 1))
    links = pages.select("host", F.explode(named).alias("dst")).select(F.col("host").alias("src"), F.translate("dst", _UPPER, _LOWER).alias("dst"))
    links = cut(links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links")), "links")
    hosts = pages.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    up = cut(_parents(hosts), "parents").where("src <> dst")
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("links", F.lit(1).cast("long"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("links").alias("links"))


def _shares(edges: DataFrame) -> DataFrame:
    """edges (kind, src, dst, links) with the share that each has of the links that reach its destination."""
    reach = edges.groupBy("kind", "dst").agg(F.sum("links").alias("total"))
    return edges.join(reach, ["kind", "dst"]).select("kind", "src", "dst", (F.col("links") / F.col("total")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank): personalised PageRank from seeds (kind, host, mass) along edges (kind, src, dst, share).

    The rank is 1 - damping times the sum of what arrives in each round, damped once more in each.
    """
    mass = cut(seeds.select("kind", "host", "mass"), "mass")
    every = mass
    for _ in range(rounds):
        moved = mass.join(edges, (mass["kind"] == edges["kind"]) & (mass["host"] == edges["src"])).select(edges["kind"], F.col("dst").alias("host"), (F.lit(damping) * F.col("mass") * F.col("share")).cast("decimal(38,18)").alias("part"))
        mass = cut(moved.groupBy("kind", "host").agg(F.sum("part").cast("double").alias("mass")), "mass")
        if mass.isEmpty():
            break
        every = every.unionByName(mass)
    total = F.sum(F.col("mass").cast("decimal(38,18)")).cast("double")
    return every.groupBy("kind", "host").agg(F.round((1 - damping) * total, 6).alias("rank"))


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html")
    judged = parts.withColumn("m", matching_rule(F.col("host"), F.col("path"), rules))
    with scratch(pages.sparkSession) as keep:
        edges = cut(host_edges(parts), "edges")
        urls = keep(cut(judged.select("page_id", "host", "path", "m.rule", "m.verdict"), "urls"))
        hosts = cut(urls.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked")), "hosts")
        seeds = hosts.where("allowed > 0").select(F.lit("trust").alias("kind"), "host", (F.col("allowed") / F.col("n")).alias("mass")).unionByName(hosts.where("blocked > 0").select(F.lit("distrust").alias("kind"), "host", (F.col("blocked") / F.col("n")).alias("mass")))
        reversed_ = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
        shares = cut(_shares(edges.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionByName(reversed_)), "shares")
        rank = propagate(seeds, shares)
        of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("rank"))).alias(kind)
        ranks = hosts.select("host", F.col("n").alias("_n")).join(rank.groupBy("host").agg(of("trust"), of("distrust")), "host", "left").na.fill(0.0, ["trust", "distrust"])
        n_hosts, n = hosts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        out = join_keyed(urls, keep(cut(ranks, "ranks")), "host", n_hosts, n)
    by_graph = F.when((F.col("distrust") >= LEAST) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_graph).alias("verdict"), "trust", "distrust")


def _oracle() -> str:
    cases = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h + p}', 'verdict': '{v}'}}" for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2])))
    link, named = (x.replace("'", "''") for x in (LINK, NAMED))
    return f"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
j AS (SELECT page_id, host, path, html, CASE{cases} END AS m FROM p),
l AS (SELECT host AS src, translate(unnest(list_concat(regexp_extract_all(html, '{link}', 1), regexp_extract_all(html, '{named}', 1))), '{_UPPER}', '{_LOWER}') AS dst FROM p),
e0 AS (SELECT src, dst, count(*) AS links FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
n AS (SELECT host, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l FROM (SELECT host FROM p UNION SELECT dst FROM e0) WHERE regexp_matches(host, '[a-z]')),
u AS (SELECT DISTINCT CASE WHEN i = 1 THEN host ELSE array_to_string(l[i:], '.') END AS src, array_to_string(l[i + 1:], '.') AS dst FROM (SELECT host, l, unnest(range(1, len(l) - 1)) AS i FROM n WHERE len(l) BETWEEN 3 AND {MAX_LABELS})),
e AS (SELECT src, dst, sum(links) AS links FROM (SELECT * FROM e0 UNION ALL SELECT src, dst, 1 FROM u WHERE src <> dst UNION ALL SELECT dst, src, 1 FROM u WHERE src <> dst) GROUP BY src, dst),
f AS MATERIALIZED (SELECT 'trust' AS kind, src, dst, (links / sum(links) OVER (PARTITION BY dst))::DOUBLE AS share FROM e UNION ALL SELECT 'distrust', dst, src, (links / sum(links) OVER (PARTITION BY src))::DOUBLE FROM e),
h AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (m.verdict = 'allow') AS allowed, count(*) FILTER (m.verdict = 'block') AS blocked FROM j GROUP BY host),
s AS MATERIALIZED (SELECT 'trust' AS kind, host, allowed / n AS mass FROM h WHERE allowed > 0 UNION ALL SELECT 'distrust', host, blocked / n FROM h WHERE blocked > 0),
r AS (SELECT 0 AS t, kind, host, mass::DOUBLE AS mass FROM s UNION ALL SELECT t + 1, f.kind, f.dst, sum(({DAMPING}::DOUBLE * mass * share)::DECIMAL(38,18))::DOUBLE FROM r JOIN f ON f.kind = r.kind AND f.src = r.host WHERE t < {ROUNDS} GROUP BY ALL),
k AS (SELECT kind, host, round({1 - DAMPING}::DOUBLE * sum(mass::DECIMAL(38,18))::DOUBLE, 6) AS rank FROM r GROUP BY kind, host)
SELECT page_id, j.host, path, m.rule AS rule, coalesce(m.verdict, CASE WHEN coalesce(d.rank, 0) >= {LEAST} AND coalesce(d.rank, 0) > coalesce(t.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(t.rank, 0.0) AS trust, coalesce(d.rank, 0.0) AS distrust
FROM j LEFT JOIN k t ON t.host = j.host AND t.kind = 'trust' LEFT JOIN k d ON d.host = j.host AND d.kind = 'distrust'
"""


ORACLE = _oracle()

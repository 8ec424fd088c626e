"""URL filter with DataFrame functions only: rules, then trust and distrust propagated over the host graph.

Host: what stands after the first :// up to /, ?, # or the end, A-Z lowered; path: from
there up to ?, # or the end; a null url or one without :// has both empty. A rule fits its
host and all subdomains of it, if the path starts with the rule's path; the longest rule
that fits decides.

Where none fits, the host's standing decides. Nodes are the hosts of pages, the hosts they
link to, and the parent domains of both. A host links to the hosts in its pages' absolute
href and src attributes (weight: number of links), and to and from its parent domain (weight:
half of all). Trust is a personalised PageRank from hosts with allowed pages (by their
number) along links; distrust one from hosts with blocked pages along reversed links.
A host is blocked where its distrust reaches `threshold` of the sum of both, else allowed.

The mass of hosts without any outgoing edge goes back to the seeds: each rank is scaled to
sum to 1 at the end, which is the same. At least `rounds` rounds are run (after 24 of them
0.85 ** 24 = 0.02 of the mass still moves), and more while a host is newly reached, so no
host is too far from a seed. Shares are rounded to 9 places before they are compared, so the
order of sums doesn't decide.

Links are summed per pair of hosts before anything is joined; joins with ranks are plain
equi-joins that adaptive execution can split, so a host with a third of all pages or links
costs its pairs only. Trust and distrust are one table: a round is one join and one sum. Every
few rounds the ranks are written to the shared folder.

Defined cases: null, empty and odd urls have an empty host, which no rule fits, which is no
node and is allowed; null html has no links; a host of more than 253 code points is no name
of the domain system: it is a node without parent domains; a host that nothing reaches is
allowed; without seeds all ranks are 0; repeated pages count each time; empty tables give
empty results; further columns are carried along unchanged, and added columns whose names
the table has already get underscores at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own, restored, saved, split_join

# fixed values: the rules, as (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, ROUNDS, CUT, THRESHOLD, LONGEST = 0.85, 24, 8, 0.5, 253
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s<>]+)"""


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise(F.lit(""))
    rest = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"^([^/]*)", 1)
    return F.translate(host, UPPER, LOWER), F.substr(rest, F.char_length(host) + 1)


def _rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (null: none), and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _ranks(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float) -> DataFrame:
    """edges: kind, a, b, w; seeds: kind, h, s. Returns kind, h, r: a personalised PageRank of each kind, which sums to 1."""
    by_kind = lambda of: F.when(F.col("kind") == 0, F.lit(of.get(0, 1.0))).otherwise(F.lit(of.get(1, 1.0)))
    totals = {r.kind: r.s for r in seeds.groupBy("kind").agg(F.sum("s").cast("double").alias("s")).collect()}  # two rows
    if not totals:
        return seeds.select("kind", "h", F.lit(0.0).alias("r"))
    seeds = seeds.select("kind", "h", (F.col("s") / by_kind(totals)).alias("s"))
    out = edges.groupBy("kind", "a").agg(F.sum("w").alias("t"))
    flow = saved(split_join(edges, out, ["kind", "a"]).select("kind", F.col("a").alias("h"), "b", (F.col("w") / F.col("t") * damping).alias("p")))
    ranks = seeds.select("kind", "h", F.col("s").alias("r"))
    done, reached = 0, -1
    while True:
        for _ in range(CUT):
            moved = split_join(flow, ranks, ["kind", "h"]).select("kind", F.col("b").alias("h"), (F.col("p") * F.col("r")).alias("r"))
            ranks = moved.union(seeds.select("kind", "h", (F.col("s") * (1 - damping)).alias("r"))).groupBy("kind", "h").agg(F.sum("r").alias("r"))
        ranks, done = saved(ranks), done + CUT
        if done + CUT >= rounds:
            now = ranks.groupBy("kind").agg(F.sum("r").alias("r"), F.count(F.lit(1)).alias("n")).collect()  # two rows
            before, reached = reached, sum(r.n for r in now)
            if done >= rounds and reached == before:
                return ranks.withColumn("r", F.col("r") / by_kind({r.kind: r.r for r in now}))


def judge(pages: DataFrame, url: str = "url", html: str = "html", *, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """pages with uf_host, uf_path, uf_rule, uf_verdict and uf_distrust (the host's share of distrust, to 9 places; null: not reached)."""
    df, (url, html) = own(pages, url, html)
    host, path = host_path(F.coalesce(F.col(url), F.lit("")))
    name, verdict = _rule(F.col("uf_host"), F.col("uf_path"), rules)
    ruled = df.withColumn("uf_host", host).withColumn("uf_path", path).withColumn("uf_rule", name).withColumn("uf_ruling", verdict)

    links = ruled.select(F.col("uf_host").alias("a"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("b"))
    links = links.select("a", F.regexp_replace(F.translate("b", UPPER, LOWER), r"\.+$", "").alias("b")).where("a <> '' and b <> '' and a <> b")
    pairs = saved(links.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w")))
    hosts = ruled.where("uf_host <> ''").groupBy(F.col("uf_host").alias("h")).agg(F.count_if(F.col("uf_ruling") == "allow").alias("yes"), F.count_if(F.col("uf_ruling") == "block").alias("no"))
    hosts = saved(hosts)
    nodes = hosts.select("h").union(pairs.select("b")).distinct().where(F.char_length("h") <= LONGEST)
    labels = F.split("h", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    nodes = nodes.select(F.explode(chain).alias("h")).distinct()
    up = nodes.select(F.col("h").alias("a"), F.substr("h", F.locate(".", F.col("h")) + 1).alias("b")).where("locate('.', a) > 0 and locate('.', b) > 0")
    tree = up.select("a", "b").union(up.select("b", "a"))
    share = lambda e: split_join(e, e.groupBy("a").agg(F.sum("w").alias("t")), ["a"]).select("a", "b", (F.col("w") / F.col("t")).alias("w"))
    tree = share(tree.withColumn("w", F.lit(1.0)))  # links and domain edges have half each of what leaves a host
    forth, back = share(pairs), share(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    edges = forth.union(tree).select(F.lit(0).alias("kind"), "a", "b", "w").union(back.union(tree).select(F.lit(1).alias("kind"), "a", "b", "w"))
    seeds = hosts.where("yes > 0").select(F.lit(0).alias("kind"), "h", F.col("yes").alias("s")).union(hosts.where("no > 0").select(F.lit(1).alias("kind"), "h", F.col("no").alias("s")))
    ranks = _ranks(edges, seeds, rounds, damping)
    trust, doubt = F.sum(F.when(F.col("kind") == 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("kind") == 1, F.col("r")).otherwise(0.0))
    standing = ranks.join(hosts.select("h"), "h", "left_semi").groupBy("h").agg(trust.alias("r"), doubt.alias("d"))
    standing = standing.select(F.col("h").alias("uf_h"), F.round(F.try_divide("d", F.col("r") + F.col("d")), 9).alias("uf_distrust"))
    out = ruled.join(standing, F.col("uf_host") == F.col("uf_h"), "left")
    decided = F.coalesce("uf_ruling", F.when(F.col("uf_distrust") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return restored(out.withColumn("uf_verdict", decided), pages.columns, "uf_host", "uf_path", "uf_rule", "uf_verdict", "uf_distrust")


def digest(pages: DataFrame) -> DataFrame:
    df = judge(pages.select("page_id", "url", "html"))
    return df.select("page_id", F.col("uf_host").alias("host"), F.col("uf_path").alias("path"), F.col("uf_rule").alias("rule"), F.col("uf_verdict").alias("verdict"), F.col("uf_distrust").alias("distrust"))


def _rules_sql() -> str:
    longest = sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), r[1:]))
    return " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{kind} {h}{p}'" for kind, h, p in longest)


_SHARES = "SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS w FROM"
DIGEST_SQL = f"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN regexp_extract(url[position('://' IN url) + 3:], '^([^?#]*)', 1) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/]*)', 1), '{UPPER}', '{LOWER}') AS host, rest[length(regexp_extract(rest, '^([^/]*)', 1)) + 1:] AS path FROM u),
r AS (SELECT *, CASE {_rules_sql()} END AS rule FROM p),
l AS (SELECT host AS a, regexp_replace(translate(b, '{UPPER}', '{LOWER}'), '\\.+$', '') AS b FROM (SELECT host, unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)) AS b FROM r)),
pairs AS (SELECT a, b, count(*)::DOUBLE AS w FROM l WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b),
hosts AS (SELECT host AS h, count(*) FILTER (starts_with(rule, 'allow')) AS yes, count(*) FILTER (starts_with(rule, 'block')) AS no FROM r WHERE host <> '' GROUP BY host),
named AS (SELECT h, string_split(h, '.') AS x FROM (SELECT h FROM hosts UNION SELECT b FROM pairs) WHERE length(h) <= {LONGEST}),
nodes AS (SELECT DISTINCT array_to_string(x[i:], '.') AS h FROM (SELECT x, unnest(range(1, greatest(len(x) - 1, 1) + 1)) AS i FROM named)),
up AS (SELECT h AS a, h[position('.' IN h) + 1:] AS b FROM nodes WHERE position('.' IN h) > 0 AND position('.' IN h[position('.' IN h) + 1:]) > 0),
tree AS ({_SHARES} (SELECT a, b, 1.0::DOUBLE AS w FROM up UNION ALL SELECT b, a, 1.0 FROM up)),
edges AS (SELECT 0 AS kind, * FROM ({_SHARES} pairs) UNION ALL SELECT 1, * FROM ({_SHARES} (SELECT b AS a, a AS b, w FROM pairs)) UNION ALL SELECT k, a, b, w FROM tree, (SELECT unnest([0, 1]) AS k)),
flow AS (SELECT kind, a, b, {DAMPING}::DOUBLE * w / sum(w) OVER (PARTITION BY kind, a) AS p FROM edges),
seeds AS (SELECT 0 AS kind, h, yes / sum(yes) OVER () AS s FROM hosts WHERE yes > 0 UNION ALL SELECT 1, h, no / sum(no) OVER () FROM hosts WHERE no > 0),
ranks AS (
  SELECT kind, h, s::DOUBLE AS r, 0 AS i FROM seeds
  UNION ALL SELECT kind, h, sum(r), any_value(i) + 1 FROM (
    SELECT f.kind, f.b AS h, f.p * x.r AS r, x.i FROM ranks x JOIN flow f ON f.kind = x.kind AND f.a = x.h
    UNION ALL SELECT s.kind, s.h, s.s * {1 - DAMPING}::DOUBLE, n.i FROM seeds s, (SELECT DISTINCT i FROM ranks) n)
  WHERE i < {ROUNDS} GROUP BY kind, h),
last AS (SELECT kind, h, r / sum(r) OVER (PARTITION BY kind) AS r FROM ranks WHERE i = {ROUNDS}),
standing AS (SELECT h, round(sum(r) FILTER (kind = 1) / sum(r), 9) AS share, count(*) FILTER (kind = 1) AS n FROM last GROUP BY h)
SELECT page_id, r.host, path, split_part(rule, ' ', 2) AS rule, coalesce(split_part(rule, ' ', 1), CASE WHEN n > 0 AND share >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN n > 0 THEN share ELSE share * 0 END AS distrust
FROM r LEFT JOIN (SELECT h, coalesce(share, 0) AS share, n FROM standing) s ON s.h = r.host
"""

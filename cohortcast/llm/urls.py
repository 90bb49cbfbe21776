"""URL filter: rules first, then trust and distrust that spread over a host graph.

Hosts are linked by the links in their pages (absolute and protocol-relative ones; relative links stay on the host) and
with the domain above them, both ways, down to domains of two labels.  Trust is a personalised PageRank along the links,
whose seeds are the hosts with pages that the rules allow, by number of pages.  Distrust is one against the links
(who links to a bad host is suspect), from the hosts with pages that the rules block.  A host without a rule for a page
is blocked if its distrust, of both together, reaches ``THRESHOLD``; without either it is allowed.

Rank tables have a row per host; each round is a join and a sum in Spark, and every ``STRIDE`` rounds the ranks go to the
shared checkpoint folder and are compared with those before, host by host: the rounds end when trust and distrust have
reached no further host and no host's share of distrust has changed by ``TOLERANCE``.  How many pages other hosts have
doesn't matter for that.

A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed.  A null html has no links.
Repeated pages count as often as they occur.  Input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

DAMPING = 0.75
TOLERANCE = 1e-3
STRIDE = 4
THRESHOLD = 0.5
#: Weight of the link between a host and the domain above it, in links of pages.
KINSHIP = 1.0

LINK = "(?i)href\\s*=\\s*[\"']?(?:https?:)?//([^/?#\"'\\s<>]+)"


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(after, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(after, F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules, each a verdict and a host with a path, that fits; null if none does."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def with_rules(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and rule_verdict (null without a rule)."""
    pages = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    pages = pages.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for v, rule in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(v)).otherwise(verdict)
    return pages.withColumn("rule_verdict", verdict)


def host_graph(pages: DataFrame, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """Of pages with rules: edges (src, dst, w) and hosts (host, good, bad: numbers of pages that the rules judge)."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    links = links.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    good, bad = (F.sum((F.col("rule_verdict") == v).cast("double")) for v in ("allow", "block"))
    own = pages.filter("host <> ''").groupBy("host").agg(F.coalesce(good, F.lit(0.0)).alias("good"), F.coalesce(bad, F.lit(0.0)).alias("bad"))
    own = staged(own, "hosts")
    links = staged(links, "links")
    names = own.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    labels = F.split("host", "\\.")
    above = F.transform(F.sequence(F.lit(0), F.size(labels) - 2),
                        lambda k: F.array_join(F.slice(labels, k + 1, F.size(labels)), "."))
    chain = names.filter(F.size(labels) > 2).select(F.explode(F.arrays_zip(F.slice(above, 1, F.size(above) - 1).alias("low"),
                                                                          F.slice(above, 2, F.size(above)).alias("high"))).alias("p"))
    chain = chain.select(F.col("p.low").alias("low"), F.col("p.high").alias("high")).distinct()
    kin = F.lit(KINSHIP).alias("w")
    edges = (links.unionByName(chain.select(F.col("low").alias("src"), F.col("high").alias("dst"), kin))
             .unionByName(chain.select(F.col("high").alias("src"), F.col("low").alias("dst"), kin))
             .groupBy("src", "dst").agg(F.sum("w").alias("w")))
    edges = staged(edges, "edges")
    every = names.unionByName(edges.select(F.col("src").alias("host"))).distinct()
    hosts = every.join(own, "host", "left").na.fill(0.0, ["good", "bad"])
    return edges, staged(hosts, "graph-hosts")


def spread(edges: DataFrame, hosts: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Trust and distrust of each host (each sums to 1, or to 0 without seeds): personalised PageRank along and against
    the links, where a walk that meets a host without links on starts again at the seeds.

    Such restarts only scale all ranks alike, so the rounds leave them out and the sums are set to 1 at the end."""
    total = hosts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    seeds = staged(hosts.filter("good > 0 or bad > 0").select(
        "host", (F.col("good") / (total.good or 1.0)).alias("t"), (F.col("bad") / (total.bad or 1.0)).alias("d")), "seeds")
    out = edges.groupBy(F.col("src").alias("a")).agg(F.sum("w").alias("out"))
    into = edges.groupBy(F.col("dst").alias("b")).agg(F.sum("w").alias("into"))
    zero = F.lit(0.0)
    along = edges.join(out, F.col("src") == F.col("a")).select("a", F.col("dst").alias("b"), (F.col("w") / F.col("out")).alias("by_t"), zero.alias("by_d"))
    against = edges.join(into, F.col("dst") == F.col("b")).select(F.col("b").alias("a"), F.col("src").alias("b"), zero.alias("by_t"), (F.col("w") / F.col("into")).alias("by_d"))
    ways = staged(along.unionByName(against), "ways")
    restart = seeds.select("host", ((1 - damping) * F.col("t")).alias("t"), ((1 - damping) * F.col("d")).alias("d"))
    ranks = seeds
    while True:
        before = ranks
        for _ in range(STRIDE):  # one join and one shuffle each
            moved = ranks.join(ways, F.col("host") == F.col("a")).select(
                F.col("b").alias("host"), (damping * F.col("t") * F.col("by_t")).alias("t"), (damping * F.col("d") * F.col("by_d")).alias("d"))
            ranks = moved.unionByName(restart).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        ranks = staged(ranks, "ranks")
        if settled(scaled(before), scaled(ranks), tolerance):
            return scaled(ranks).select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))


def scaled(ranks: DataFrame) -> DataFrame:
    """``ranks`` with sums of 1."""
    sums = ranks.agg(F.sum("t").alias("t"), F.sum("d").alias("d")).first()
    return ranks.select("host", (F.col("t") / (sums.t or 1.0)).alias("t"), (F.col("d") / (sums.d or 1.0)).alias("d"))


def share(t: Column, d: Column) -> Column:
    """Of distrust; null where neither came."""
    return F.when(t + d > 0, d / (t + d))


def settled(before: DataFrame, now: DataFrame, tolerance: float) -> bool:
    """No host was newly reached by either rank, and no share changed by ``tolerance`` or more."""
    zero = F.lit(0.0)
    both = before.select("host", F.col("t").alias("t0"), F.col("d").alias("d0"), zero.alias("t"), zero.alias("d")).unionByName(
        now.select("host", zero.alias("t0"), zero.alias("d0"), "t", "d"))
    both = both.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("t0", "d0", "t", "d")])
    reached = ((F.col("t") > 0) != (F.col("t0") > 0)) | ((F.col("d") > 0) != (F.col("d0") > 0))
    moved = F.abs(share(F.col("t"), F.col("d")) - share(F.col("t0"), F.col("d0"))) >= tolerance
    return both.filter(reached | moved).isEmpty()


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD, url: str = "url",
          html: str = "html") -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block)."""
    ruled = with_rules(pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "rule_verdict", "verdict")]), rules, url)
    ranks = spread(*host_graph(ruled, html))
    blocked = ranks.filter((F.col("distrust") > 0) & (share(F.col("trust"), F.col("distrust")) >= threshold)).select("host", F.lit("block").alias("by_host"))
    judged = ruled.join(blocked, "host", "left")
    verdict = F.coalesce("rule_verdict", "by_host", F.lit("allow")).alias("verdict")
    return judged.select(*[c for c in ruled.columns if c != "rule_verdict"], verdict)

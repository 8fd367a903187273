"""URL filter: rules, and trust and distrust propagated over the host graph.

Rules name a host, its subdomains and a path prefix; the longest that fits a
url decides. Where none fits, the host's standing in the link graph does:
personalised PageRank spreads trust from the hosts whose pages rules allow along
the links, and distrust from the hosts whose pages rules block against them
(who links to a bad host is suspect). A host is blocked if distrust makes up at
least ``threshold`` of the two together.

Edges are the absolute links of the pages, weighted by their number, and a
weaker pair of edges between a host and its parent domain, since
subdomains share an owner. Every host of a page or a link brings in its whole
chain of parent domains, with pages of their own or not. Hosts without out-edges keep their mass.
Rounds go on until what is left to change is below a tolerance and no further host is reached.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltext.llm.staging import small_side, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest name of the domain name system.
NAME_LENGTH = 253
STAGED = 6
TOLERANCE = 1e-3
LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: F.Column) -> F.Column:
    """After the first ``://`` up to ``/ ? #``; A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each distinct host the rules of it and of its parent
    domains. Joined by the last k labels for the label counts k that rules have."""
    parts = F.split("host", r"\.")
    counts = [r[0] for r in rules.select(F.size(F.split("rule_host", r"\.")).alias("k")).distinct().collect()]
    ends = F.array(*[F.when(F.size(parts) >= k, F.array_join(F.slice(parts, F.size(parts) - (k - 1), k), ".")) for k in sorted(counts)]) if counts else F.array().cast("array<string>")
    tails = hosts.select("host", F.explode(ends).alias("rule_host")).where("rule_host is not null")
    entry = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict"), F.col("rule_path"),
    )
    return tails.join(small_side(rules), "rule_host").groupBy("host").agg(F.collect_list(entry).alias("rules"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``rule`` and ``rule_verdict`` of the longest
    rule that fits (ties: the longer host, then the rule's text), else null."""
    by_host = stage(host_rules(urls.select("host").distinct(), rules), "trust-host-rules")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    return urls.join(small_side(by_host), "host", "left").withColumn("best", best).select(
        *urls.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict")
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): the links from host to other host, counted."""
    dst = F.explode(F.regexp_extract_all("html", F.lit(LINK), 1))
    links = pages.where(F.col("html").contains("//")).select(host_of(F.col("url")).alias("src"), dst.alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def domain_edges(hosts: DataFrame, weight: float) -> DataFrame:
    """Edges both ways between every host, and every parent domain of two labels or
    more of it, and the next parent domain. A name of more than ``NAME_LENGTH``
    characters is no domain name and has no parents."""
    parts = F.split("host", r"\.")
    domain = lambda k: F.array_join(F.slice(parts, k, F.size(parts)), ".")
    steps = F.when((F.size(parts) >= 3) & (F.length("host") <= NAME_LENGTH), F.transform(F.sequence(F.lit(1), F.size(parts) - 2), lambda k: F.struct(domain(k).alias("host"), domain(k + 1).alias("parent"))))
    pairs = hosts.select(F.explode(steps).alias("s")).select("s.host", "s.parent").distinct()
    return pairs.select(
        F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("parent").alias("dst")), F.struct(F.col("parent").alias("src"), F.col("host").alias("dst")))).alias("e")
    ).select("e.src", "e.dst", F.lit(float(weight)).alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust): two personalised PageRanks.

    ``edges`` (src, dst, weight > 0), parallel ones are added up; ``seeds`` (host,
    good, bad): numbers of pages, one row per host; each column is scaled to a sum of 1. Trust
    follows the edges, distrust their reverse, both from the same join of a round.
    Every ``STAGED`` rounds the ranks are written to the shared folder. A round moves
    at most ``damping`` of what the round before it moved, so after
    ln(tolerance) / ln(damping) rounds all further ones move less than ``tolerance`` of the
    ranks' sum; rounds go on from there as long as they reach further hosts. Without seeds of a kind,
    its rank is 0 everywhere.
    """
    edges = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    both = stage(
        edges.select("src", "dst", F.col("weight").alias("good_w"), F.lit(0.0).alias("bad_w")).unionByName(
            edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("good_w"), F.col("weight").alias("bad_w"))
        ), "trust-edges",
    )
    out = stage(both.groupBy("src").agg(F.sum("good_w").alias("good_out"), F.sum("bad_w").alias("bad_out")), "trust-out")
    stay = seeds.select("host").unionByName(out.select(F.col("src").alias("host"))).distinct().join(out.withColumnRenamed("src", "host"), "host", "left").select(
        F.col("host").alias("src"), F.col("host").alias("dst"),
        F.when(F.coalesce("good_out", F.lit(0.0)) == 0, 1.0).otherwise(0.0).alias("good_p"),
        F.when(F.coalesce("bad_out", F.lit(0.0)) == 0, 1.0).otherwise(0.0).alias("bad_p"),
    ).where("good_p > 0 or bad_p > 0")
    share = lambda w, all_: F.when(F.col(all_) > 0, F.col(w) / F.col(all_)).otherwise(0.0)
    flow = stage(
        both.join(out, "src").select("src", "dst", share("good_w", "good_out").alias("good_p"), share("bad_w", "bad_out").alias("bad_p")).unionByName(stay),
        "trust-flow",
    )
    total = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    start = stage(seeds.select("host", *[((F.col(c) / n) if n else F.lit(0.0)).alias(c) for c, n in (("good", total["g"]), ("bad", total["b"]))]), "trust-seeds")
    rank = start.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    rounds, reached = 0, None
    while True:
        for _ in range(STAGED):
            moved = flow.join(rank.withColumnRenamed("host", "src"), "src").select(
                F.col("dst").alias("host"), (F.lit(damping) * F.col("good_p") * F.col("trust")).alias("trust"), (F.lit(damping) * F.col("bad_p") * F.col("distrust")).alias("distrust")
            )
            jump = start.select("host", (F.lit(1 - damping) * F.col("good")).alias("trust"), (F.lit(1 - damping) * F.col("bad")).alias("distrust"))
            rank = moved.unionByName(jump).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        rank, rounds = stage(rank, "trust-rank"), rounds + STAGED
        if rounds < math.log(tolerance) / math.log(damping):
            continue
        now = rank.agg(F.count_if(F.col("trust") > 0), F.count_if(F.col("distrust") > 0)).first()
        if now == reached:
            return rank
        reached = now


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], threshold: float = 0.5, domain_weight: float = 0.5, damping: float = 0.85, tolerance: float = TOLERANCE) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, trust, distrust) of every page.

    ``pages`` has page_id, url and html; other columns are ignored. ``rules`` are
    (verdict, host, path) with verdict ``allow`` or ``block``; paths begin with
    a slash. A null url, or one without ``://``, has an empty host and path, fits
    no rule, and is allowed. A host that neither trust nor distrust reaches
    is allowed. Null html has no links. Repeated rows are judged alike; an
    empty table gives no rows. Values are rounded to 12 places, sums of doubles
    being free to differ in their last bits.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame([(h.translate(str.maketrans(UPPER, LOWER)), p, v) for v, h, p in rules], "rule_host string, rule_path string, verdict string").distinct()
    urls = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    matched = stage(match_rules(urls, table), "trust-matched")
    known = matched.where("host <> ''")
    seeds = stage(
        known.groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("good"), F.count_if(F.col("rule_verdict") == "block").alias("bad")), "trust-hosts"
    )
    links = stage(link_edges(pages.select("url", "html")), "trust-links")
    hosts = seeds.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    rank = propagate(links.unionByName(domain_edges(hosts, domain_weight)), seeds, damping, tolerance)
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= F.lit(threshold) * (F.col("trust") + F.col("distrust")))
    return matched.join(small_side(rank), "host", "left").select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.round(F.coalesce("trust", F.lit(0.0)), 12).alias("trust"), F.round(F.coalesce("distrust", F.lit(0.0)), 12).alias("distrust"),
    )

"""URL filter: rules by host and path, and trust and distrust that flow along links between hosts.

Pages that a rule allows make their host a trusted seed, pages that a rule blocks a blocked one;
a host is a seed with the share of its pages that the rules decide. Trust is a personalised
PageRank from trusted seeds along links; distrust is one from blocked seeds against them, since
who links to blocked hosts is suspect. A host that gets more distrust than ``share`` of both is
blocked, and with it each of its pages that no rule decides; others are allowed.

An edge joins the host of a page with the host of a link on it, with the number of such links;
relative links keep their part of the rank at home. Masses are integers in units of 1 / UNIT
and flows are rounded down, so reruns and other engines agree. A round is a join of edges with
masses and a sum by host. Edges of a host with many of them are dealt over pieces
(spread.py), as are the pages of a host when they get its masses.

Defined cases: a null url or one without ``://`` has an empty host and path, is no part of the
graph and is allowed; so is a page of a host that no rank reaches. Null html has no links. Hosts
that are only linked to take part. Links of other schemes without ``//`` are left out. Where
two fitting rules are equally long, the one with the longer host wins, then block. Repeated
rows each count and come back; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import spread
from corpusloom.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)<a[\x20\x09-\x0D](?:[^>]*?[\x20\x09-\x0D])?href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?([^"'\x20\x09-\x0D>]+)"""
ELSEWHERE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"

UNIT = 1 << 30
DAMPING = 0.85
ROUNDS = 20
#: Rounds after which a table is written, to keep plans short.
WRITTEN = 5
SHARE = 0.5

Rule = tuple[str, str, str]  # verdict, host, path


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    part = lambda k: F.coalesce(F.regexp_extract(url, URL, k), F.lit(""))
    return _lower(part(1)), part(2)


def ruling(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, links): the links of all pages of one host to another or to itself."""
    link = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
    away = _lower(F.regexp_extract("link", ELSEWHERE, 1))
    dst = F.when(F.col("link").rlike(ELSEWHERE), away).when(F.col("link").rlike(SCHEME), "").otherwise(F.col("src"))
    return link.select("src", dst.alias("dst")).filter("dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def host_ranks(hosts: DataFrame, links: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, mass) for kinds trust and distrust.

    hosts: (host, pages, allowed, blocked); links: (src, dst, links).
    """
    way = lambda kind, a, b: links.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), "links")
    ways = scratch.table(way("trust", "src", "dst").unionByName(way("distrust", "dst", "src")))
    totals = scratch.table(ways.groupBy("kind", "a").agg(F.sum("links").alias("total"), F.count("*").alias("n")))
    hot = scratch.table(spread.hot_keys(totals, "n", "kind", "a"))
    edges = spread.dealt(ways, hot, ["kind", "a"], F.xxhash64("b"))
    shared = spread.copied(totals.drop("n"), hot, ["kind", "a"])
    edges = edges.join(shared, ["kind", "a", "piece"]).select("kind", "a", "piece", "b", (F.col("links").cast("double") / F.col("total").cast("double")).alias("share"))
    # all rounds read the edges dealt alike, so only masses are moved
    parts = int(hosts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = scratch.table(edges).repartition(parts, "kind", "a", "piece").persist(StorageLevel.DISK_ONLY)
    seed = lambda kind, n: hosts.filter(F.col(n) > 0).select(F.lit(kind).alias("kind"), "host", F.expr(f"{UNIT} * {n} div pages").alias("seed"))
    seeds = seed("trust", "allowed").unionByName(seed("distrust", "blocked"))
    rank = scratch.table(seeds.select("kind", "host", F.col("seed").alias("mass"), F.floor(F.lit(1 - DAMPING) * F.col("seed").cast("double")).alias("kept")))
    seeds = rank.select("kind", "host", F.col("kept").alias("mass"))
    for k in range(1, rounds + 1):
        masses = spread.copied(rank.select("kind", F.col("host").alias("a"), "mass"), hot, ["kind", "a"])
        flow = F.floor(F.lit(DAMPING) * F.col("mass").cast("double") * F.col("share"))
        flows = edges.join(masses, ["kind", "a", "piece"]).select("kind", F.col("b").alias("host"), flow.alias("mass"))
        rank = seeds.unionByName(flows).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if k % WRITTEN == 0 or k == rounds:
            rank = scratch.table(rank)
    edges.unpersist()
    return rank


def judge(pages: DataFrame, rules: list[Rule], share: float = SHARE, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    scratch = scratch or Scratch(pages.sparkSession, "links")
    host, path = url_parts(F.col("url"))
    rule, ruled = ruling(F.col("host"), F.col("path"), rules)
    split = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    links = scratch.table(host_links(split))
    judged = split.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    count = lambda kind: F.count_if(F.col("ruled") == kind)
    hosts = judged.filter("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), count("allow").alias("allowed"), count("block").alias("blocked"))
    hosts = scratch.table(hosts)
    mass = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0)).cast("long").alias(kind)
    ranks = scratch.table(host_ranks(hosts, links, scratch).groupBy("host").agg(mass("trust"), mass("distrust")))
    hot = scratch.table(spread.hot_keys(hosts, "pages", "host"))
    rows = spread.dealt(judged, hot, ["host"], F.xxhash64("page_id", "path", F.spark_partition_id()))
    rows = rows.join(spread.copied(ranks, hot, ["host"]), ["host", "piece"], "left")
    rows = rows.withColumns({"trust": F.coalesce("trust", F.lit(0)), "distrust": F.coalesce("distrust", F.lit(0))})
    both = F.col("trust").cast("double") + F.col("distrust").cast("double")
    method = F.when(F.col("distrust").cast("double") > F.lit(share) * both, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")

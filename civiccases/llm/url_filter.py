"""URL filters: explicit rules first, then trust and distrust propagated over the host link graph.

Trust is a personalised PageRank over host -> linked host that restarts at the
hosts of allowed pages; distrust is the same over reversed links (a host that
links to a blocked one is suspect) and restarts at the hosts of blocked pages.
A host is blocked where its distrust exceeds its trust; without any evidence it
is allowed.

Pages are reduced to hosts and weighted host edges before anything is joined,
so a host with a third of all pages is a handful of partial counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiccases.llm.common import clean_text, saved

#: (verdict, host/path): host and subdomains, paths with that prefix; the longest fitting rule wins
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]
DAMPING = 0.85
TOLERANCE = 1e-6
#: a safety bound: the ranks' change shrinks by DAMPING a round, so about 95 rounds meet TOLERANCE on any graph
MAX_ROUNDS = 200
#: distrust over trust from which a host is blocked
RATIO = 1.0
#: verdicts of up to this number of hosts are broadcast to the pages (about 100 bytes each)
BROADCAST_HOSTS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL, both empty if it is null or has no ``://``."""
    url = clean_text(url)
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        own, slash, prefix = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + prefix))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links to other hosts, with the share of the source's links."""
    links = F.regexp_extract_all(
        clean_text("html"), F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"), F.lit(1))
    counted = (pages.select(F.col("host").alias("src"), F.explode(links).alias("dst"))
               .select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
               .where("src != dst and src != ''").groupBy("src", "dst").count())
    total = counted.groupBy("src").agg(F.sum("count").alias("out"))
    return counted.join(total, "src").select("src", "dst", (F.col("count") / F.col("out")).alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING,
              tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) that sum to 1 each (or 0).

    Rank that reaches a host without outgoing links restarts at the seeds.
    Rounds stop when the ranks move by less than ``tolerance`` in all; a
    RuntimeError is raised if ``max_rounds`` rounds do not get there.
    """
    back = edges.groupBy("dst").agg(F.sum("weight").alias("in_weight"))
    reverse = edges.join(back, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                                             (F.col("weight") / F.col("in_weight")).alias("weight"))
    nodes = (edges.select(F.col("dst").alias("host")).unionByName(edges.select(F.col("src").alias("host"))).distinct()
             .join(seeds.select("host"), "host", "left_anti")
             .select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust")))
    start = saved(seeds.select("host", "trust", "distrust").unionByName(nodes), "seeds")
    totals = start.agg(F.sum("trust"), F.sum("distrust")).first()
    rank, change = start, None
    for _ in range(max_rounds):
        given = rank.select(F.col("host").alias("src"), "trust", "distrust")
        arrived = (edges.join(given, "src").select(
            F.col("dst").alias("host"), (F.col("trust") * F.col("weight")).alias("t"), F.lit(0.0).alias("d"))
            .unionByName(reverse.join(given, "src").select(
                F.col("dst").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("weight")).alias("d")))
            .groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d")))
        kept = arrived.agg(F.sum("t"), F.sum("d")).first()
        lost_t, lost_d = (damping * ((total or 0.0) - (k or 0.0)) for total, k in zip(totals, kept, strict=True))

        def moved(seed: str, part: str, total: float | None, lost: float) -> Column:
            restart = (1 - damping) + (lost / total if total else 0.0)
            return F.col(seed) * restart + damping * F.coalesce(F.col(part), F.lit(0.0))

        old = rank.select("host", F.col("trust").alias("old_t"), F.col("distrust").alias("old_d"))
        new = saved(start.join(arrived, "host", "left").join(old, "host").select(
            "host", moved("trust", "t", totals[0], lost_t).alias("trust"),
            moved("distrust", "d", totals[1], lost_d).alias("distrust"), "old_t", "old_d"), "rank")
        change = new.agg(F.sum(F.abs(F.col("trust") - F.col("old_t")) + F.abs(F.col("distrust") - F.col("old_d")))).first()[0]
        rank = new.select("host", "trust", "distrust")
        if not change or change < tolerance:
            return rank
    raise RuntimeError(f"the ranks still move by {change} after {max_rounds} rounds; tolerance {tolerance}")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page.

    A null url, or one without ``://``, has an empty host and path, fits no
    rule, joins no graph and is allowed.  Null html has no links.  Repeated rows
    are judged (and counted) each.  Extra columns are ignored; an empty table
    gives an empty result.
    """
    host, path = url_parts(F.col("url"))
    found = matching_rule(F.col("host"), F.col("path"), rules)
    judged = (pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html"))
              .withColumn("found", found))
    counts = saved(judged.where("host != ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count(F.when(F.col("found.verdict") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("found.verdict") == "block", 1)).alias("blocked")), "hosts")
    total = counts.agg(F.sum("allowed"), F.sum("blocked")).first()
    seeds = counts.select("host", (F.col("allowed") / F.lit(float(total[0] or 1))).alias("trust"),
                          (F.col("blocked") / F.lit(float(total[1] or 1))).alias("distrust"))
    edges = saved(host_edges(judged), "edges")
    rank = propagate(seeds, edges)
    if rank.count() <= BROADCAST_HOSTS:
        rank = F.broadcast(rank)
    by_method = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return (judged.drop("html").join(rank, "host", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", by_method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))

"""Operator 3: URL rules, and trust and distrust propagated over the links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint
from .components import LINKS_EACH

#: (rule, verdict): a host and a path prefix; it holds for the host's subdomains too.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
_HREF = r"""(?is)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Adds host, path, rule (the longest that fits, else null) and rule_verdict."""
    pages = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        site, slash, rest = text.partition("/")
        fits = ((F.col("host") == site) | F.col("host").endswith("." + site)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between hosts: pages' absolute hrefs (counted by page), and those of a host with its parent domain.

    A parent is the host without its first label where two labels are left; these links stand for a
    site's own navigation, which pages write as relative addresses.
    """
    out = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), F.lit(1)))).alias("dst"))
    out = out.select("src", lower_ascii(F.col("dst")).alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select("host").distinct()
    child = hosts.where(F.size(F.split("host", r"\.")) > 2).select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst"), F.lit(1.0).alias("weight"))
    both = child.union(child.select("dst", "src", "weight"))
    return out.union(both).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, check_every: int = 8) -> DataFrame:
    """(kind, host, rank): personalised PageRank of the seeds (kind, host, seed), whose shares should add up to 1, over the links (kind, src, dst, weight), each kind by itself.

    Each round shares a host's rank over its links by weight and mixes in the seeds; a host without links
    gives its rank up. A round is one exchange: ranks lie where their links do, and a hot host's incoming shares are summed before they are
    sent. Links of one task's size (LINKS_EACH) stay in one task, without an exchange. Every few rounds the lineage is cut, and it ends when the last of them has changed no host's rank by more than the tolerance of that
    rank. No later round does then: a change of at most that share of every rank passes on as at most that share of what the ranks pass on. A host that a
    round has only just reached has changed by all its rank, so that chains of links are followed to their ends.
    """
    out = links.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    share = checkpoint(links.join(out, ["kind", "src"]).select("kind", "src", "dst", (damping * F.col("weight") / F.col("total")).alias("share")))
    few = share.count() <= LINKS_EACH

    def together(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if few else df

    share, seeds = together(share), checkpoint(together(seeds.select("kind", "host", "seed")))
    mixed = seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("rank"))
    rank = seeds.withColumnRenamed("seed", "rank")

    def flow(rank: DataFrame) -> DataFrame:
        """Shares of the next ranks, still to be summed by host."""
        given = share.hint("merge").join(together(rank).withColumnRenamed("host", "src"), ["kind", "src"])
        return together(given.select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("rank")).alias("rank")).union(mixed))

    while True:
        for _ in range(check_every - 1):
            rank = flow(rank).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = checkpoint(rank)
        both = flow(rank).select("kind", "host", "rank", F.lit(0.0).alias("old")).union(rank.select("kind", "host", F.lit(0.0), "rank"))
        both = checkpoint(together(both).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")))
        unsettled = both.where(F.abs(F.col("rank") - F.col("old")) > tolerance * F.col("rank")).limit(1).count()
        rank = both.select("kind", "host", "rank")
        if not unsettled:
            return rank


def filter_urls(pages: DataFrame, rules: tuple = RULES, damping: float = 0.85, tolerance: float = 1e-3, threshold: float = 1.0) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of pages.

    Seeds of trust are hosts with pages that a rule allows, those of distrust hosts with pages that one
    blocks, each by its share of such pages. Trust flows along the links, distrust against them (who links
    to blocked hosts is doubtful), each until every host's rank has settled. A page without a rule is blocked if its host's distrust is above
    threshold times its trust, so that hosts that neither reaches are allowed. Null urls have an empty host,
    no seed and the verdict allow; null html has no links; repeated rows are judged alike.
    """
    ruled = with_rule(pages.select("page_id", "url", "html"), rules)
    links = checkpoint(host_links(ruled))
    judged = ruled.groupBy("host").agg(*(F.sum((F.col("rule_verdict") == v).cast("double")).alias(v) for v in ("allow", "block")))
    judged = checkpoint(judged.where("host <> ''").select("host", F.coalesce("allow", F.lit(0.0)).alias("allow"), F.coalesce("block", F.lit(0.0)).alias("block")))
    total = judged.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    kinds = {"allow": "trust", "block": "distrust"}
    seeds = [judged.where(F.col(v) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(v) / F.lit(total[v] or 1.0)).alias("seed")) for v, kind in kinds.items()]
    against = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    ranks = propagate(links.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(against), seeds[0].union(seeds[1]), damping, tolerance)
    ranks = checkpoint(ranks.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in kinds.values())))
    rest = ruled.select("page_id", "host", "path", "rule", "rule_verdict").join(ranks, "host", "left")
    doubtful = F.coalesce(F.col("distrust") > threshold * F.col("trust"), F.lit(False))
    verdict = F.coalesce(F.col("rule_verdict"), F.when(doubtful, F.lit("block")).otherwise(F.lit("allow")))
    return rest.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))

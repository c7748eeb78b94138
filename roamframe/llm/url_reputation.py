"""URL filter: fixed rules, then empirical-Bayes reputation of hosts.

Labelled outcomes of pages (good or bad) are counted by host, registered domain and suffix.
Each level's rate is shrunk to its parent's by a beta-binomial prior, whose strength is
estimated from the spread of the children's rates; a host that has no outcomes of its own
inherits.  A page that no rule covers is blocked only if its host's rate of bad
outcomes exceeds the limit even at the lower bound of its posterior; by default the limit is the rate
over all outcomes, so hosts that are surely worse than the whole are blocked.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamframe.plans.scratch import cut

# Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
    "com.mx", "com.tr", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
)
#: Normal quantile of the posterior bound.
QUANTILE = 1.645
#: Prior strengths, in outcomes, are kept between these.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0


class Rule(NamedTuple):
    """``host`` with all subdomains, ``path`` as a prefix; verdict allow or block."""

    host: str
    path: str
    verdict: str

    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    there = F.coalesce(at > 0, F.lit(False))
    return F.when(there, lower).otherwise(""), F.when(there, path).otherwise("")


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls; of equal length, the first listed."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name())):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name()).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def domain_levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; ports and a trailing dot are left out, addresses are their own."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    two = F.substring_index(bare, ".", -2)
    known = two.isin(*TWO_LABEL_SUFFIXES)
    address = bare.rlike(r"^[0-9.]+$") | bare.startswith("[")
    suffix = F.when(address, "").when(known, two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(address, bare).when(known, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, suffix


def _strength(level: DataFrame) -> DataFrame:
    """level(parent, bad, n, rate) with the strength of each parent's prior, by the method of moments."""
    spread = level.groupBy("parent").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.count("*").alias("k"), F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("rate"), F.lit(2.0))).alias("ss"), F.first("rate").alias("rate"))
    even = F.col("rate") * (1 - F.col("rate"))
    size = F.col("all") - F.col("sq") / F.col("all")
    between = (F.col("ss") - (F.col("k") - 1) * even) / F.greatest(size, F.lit(1e-9))
    strength = F.when((F.col("k") < 2) | (between <= 0) | (even <= 0), MOST_STRENGTH).otherwise(even / between - 1)
    # a parent with one child says nothing about spread: the weakest prior
    return spread.select("parent", F.when(F.col("k") < 2, LEAST_STRENGTH).otherwise(F.least(F.greatest(strength, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))).alias("strength"))


def reputations(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Posterior rates from outcomes(host, bad 0/1): by host, by domain, by suffix, and overall.

    Each table has its key, ``alpha`` and ``beta`` of the posterior over bad outcomes.
    """
    domain, suffix = domain_levels(F.col("host"))
    hosts = cut(outcomes.groupBy("host").agg(F.sum(F.col("bad").cast("double")).alias("bad"), F.count("*").cast("double").alias("n")).withColumn("domain", domain).withColumn("suffix", suffix))
    bad, n = hosts.agg(F.sum("bad"), F.sum("n")).first()
    overall = ((bad or 0.0) + 0.5) / ((n or 0.0) + 2.0)

    def posterior(level: DataFrame, one_parent: bool = False) -> DataFrame:
        strength = _strength(level)
        if one_parent:
            only = strength.first()
            prior = level.withColumn("strength", F.lit(only["strength"] if only else LEAST_STRENGTH))
        else:
            prior = level.join(strength, "parent")
        return prior.withColumn("alpha", F.col("bad") + F.col("strength") * F.col("rate")).withColumn("beta", F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("rate")))

    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    by_suffix = hosts.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).withColumn("parent", F.lit("")).withColumn("rate", F.lit(overall))
    by_suffix = cut(posterior(by_suffix, one_parent=True).select("suffix", "alpha", "beta", mean.alias("mean")))
    by_domain = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    by_domain = by_domain.join(by_suffix.select("suffix", F.col("mean").alias("rate")), "suffix").withColumn("parent", F.col("suffix"))
    by_domain = cut(posterior(by_domain).select("domain", "alpha", "beta", mean.alias("mean")))
    by_host = hosts.join(by_domain.select("domain", F.col("mean").alias("rate")), "domain").withColumn("parent", F.col("domain"))
    return cut(posterior(by_host).select("host", "alpha", "beta")), by_domain, by_suffix, overall


def filter_urls(pages: DataFrame, rules: Sequence[Rule], outcomes: DataFrame, max_bad: float | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_bound`` of every row of ``pages``.

    ``outcomes`` (host, bad 0/1) are labelled page outcomes, whichever pages have one; without
    any, every page that no rule covers is allowed.  ``bad_bound`` is the lower posterior bound on the host's rate of bad
    pages, from a normal posterior of its log odds; ``max_bad`` is the limit on it, None the rate over all outcomes.  Urls that are null or have no ``://`` have an empty host and path and are judged
    like any host.  Repeated rows get a row each, other columns are ignored, and an empty table gives none.
    """
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = split.withColumn("rule", name).withColumn("by_rule", verdict)
    by_host, by_domain, by_suffix, overall = reputations(outcomes)
    domain, suffix = domain_levels(F.col("host"))
    # one row per host of the pages, so that the pages themselves are joined once
    known = judged.select("host").distinct().withColumn("domain", domain).withColumn("suffix", suffix)
    for k, (level, table) in enumerate((("host", by_host), ("domain", by_domain), ("suffix", by_suffix))):
        known = known.join(table.select(level, F.struct("alpha", "beta").alias(f"q{k}")), level, "left")
    q = F.coalesce("q0", "q1", "q2", F.struct(F.lit(2 * overall).alias("alpha"), F.lit(2 * (1 - overall)).alias("beta")))
    odds = F.log(q["alpha"] / q["beta"]) - QUANTILE * F.sqrt(1 / q["alpha"] + 1 / q["beta"])
    bound = 1 / (1 + F.exp(-odds))
    bounds = cut(known.select("host", F.round(bound, 6).alias("bad_bound")))
    out = judged.join(bounds, "host", "left")
    final = F.coalesce("by_rule", F.when(F.col("bad_bound") > (overall if max_bad is None else max_bad), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"), "bad_bound")

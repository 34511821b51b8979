"""URL filter: explicit rules first, then the host's reputation by empirical Bayes. DataFrame functions only.

Reputation: labelled page outcomes (good or not) are counted by host, registered domain and suffix.
Each level's rate is shrunk to the posterior mean of the level above by a beta-binomial prior, whose
strength is estimated from how much the rates of that level scatter (method of moments). A host is
blocked if even the upper bound of its posterior rate of good pages is under a limit, so a host with
few or no labelled pages is judged by its domain, suffix and the whole.

Counts and rates are aggregated, one row a host; pages themselves are shuffled once, without html,
and a host with a third of all pages is a skewed join that Spark splits.

Defined results: a null url or one without ``://`` has an empty host and path, is a host of its own
for reputation, and fits no rule; the registered domain is one label before the suffix, which is the last label or one
of LONG_SUFFIXES (other public suffixes of several labels are not known); IP addresses are domains of their own and share
a suffix; user, port and closing dot belong to the host but not to its domain; without any label nothing but rules blocks; repeated rows are judged alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.session import materialize

BOUND = 1.645  # standard deviations of the posterior bound
LEAST_GOOD = 0.6  # a host whose rate of good pages is surely under this is blocked
SCATTER = (0.001, 0.999)  # limits of the estimated scatter
ADDRESSES = "[ip]"  # the suffix of hosts that are IP addresses

# Public suffixes of two labels that many sites share.
LONG_SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.ph", "com.pl", "com.sg",
    "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in",
    "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz",
    "org.uk", "org.za",
)


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """Without user, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@|:[0-9]*\z", ""), r"\.\z", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^[0-9]+(\.[0-9]+){3}\z") | name.startswith("[")


_LONG = "|".join(s.replace(".", r"\.") for s in LONG_SUFFIXES)


def domain_of(host: Column) -> Column:
    """The suffix and the label before it; an IP address is a domain of its own."""
    name = name_of(host)
    return F.when(is_address(name), name).otherwise(F.regexp_extract(name, rf"([^.]*\.)?({_LONG}|[^.]*)\z", 0))


def suffix_of(host: Column) -> Column:
    """One of the known long suffixes or the last label; IP addresses share one that no name has."""
    name = name_of(host)
    long = F.regexp_extract(name, rf"(?:^|\.)({_LONG})\z", 1)
    return F.when(is_address(name), ADDRESSES).when(long != "", long).otherwise(F.regexp_extract(name, r"[^.]*\z", 0))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``(rule, verdict)`` of the longest rule that fits, or null; the rules are part of the plan."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r)):  # the longest is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, found).otherwise(chosen)
    return chosen


def _shrunk(counts: DataFrame, above: Column) -> DataFrame:
    """``counts`` (key, n, good, ...) with the posterior ``rate`` and ``strength`` of each key; none labelled: the prior.

    With rates p of n pages around the rates m above, the sum of n (p - m)^2 is expected to be the sum of
    m (1 - m) (1 + (n - 1) scatter); the prior's strength is 1 / scatter - 1. One row reaches the driver.
    """
    rows = counts.withColumn("m", above)
    n, good, m = F.col("n"), F.col("good"), F.col("m")
    noise = F.when(n > 0, m * (1 - m))
    off = F.when(n > 0, good / n - m)
    more, weight = rows.agg(F.sum(n * off * off) - F.sum(noise), F.sum((n - 1) * noise)).first()
    scatter = min(max(more / weight if weight else SCATTER[0], SCATTER[0]), SCATTER[1])
    prior = F.lit(1 / scatter - 1)
    return rows.withColumn("rate", (prior * m + good) / (prior + n)).withColumn("strength", prior + n).drop("m")


def reputation(hosts: DataFrame) -> DataFrame:
    """From labelled pages counted by host ``(host, n, good)``: their posterior ``rate`` and ``strength``."""
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    n, good = suffixes.agg(F.sum("n"), F.sum("good")).first()
    by_suffix = _shrunk(suffixes, F.lit(good / n if n else 1.0))
    known = by_suffix.select("suffix", F.col("rate").alias("above"))
    by_domain = _shrunk(domains.join(known, "suffix"), F.col("above"))
    known = by_domain.select("domain", F.col("rate").alias("above"))
    return _shrunk(hosts.join(known, "domain"), F.col("above"))


def surely_poor(rate: Column, strength: Column, bound: float = BOUND, least: float = LEAST_GOOD) -> Column:
    spread = F.sqrt(rate * (1 - rate) / (strength + 1))
    return rate + bound * spread < least


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, bound: float = BOUND, least: float = LEAST_GOOD) -> DataFrame:
    """``pages`` (page_id, url) and ``outcomes`` (page_id, good 0/1) to (page_id, host, path, rule, verdict, n_labelled, n_good).

    ``n_labelled`` and ``n_good`` are the host's own labelled pages.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("fit"))
    known = outcomes.where(F.col("page_id").isNotNull() & F.col("good").isNotNull())
    known = known.groupBy("page_id").agg(F.min("good").cast("long").alias("good"))
    counted = rows.join(known, "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    judged = reputation(materialize(counted, "hosts")).select(
        "host", F.col("n").alias("n_labelled"), F.col("good").alias("n_good"),
        surely_poor(F.col("rate"), F.col("strength"), bound, least).alias("poor"),
    )
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("poor"), "block").otherwise("allow"))
    return rows.join(judged, "host").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "n_labelled", "n_good"
    )


def labelled_pages(labels: DataFrame) -> DataFrame:
    """Outcomes of the given tables. They label documents, not pages, so a label stands for the page of the same number:
    good means of quality and not toxic."""
    return labels.select(
        F.col("doc_id").alias("page_id"),
        F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when(F.col("quality").isNotNull(), 0).alias("good"),
    )

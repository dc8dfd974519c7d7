"""URL filter: rules first, then the reputation of the host by empirical Bayes.

Labelled page outcomes (1 good, 0 bad) are counted by host, registered domain and public suffix. Each level's share of
good pages is shrunk towards the level above by a beta-binomial prior whose weight is fitted by moments: suffix towards
all pages, domain towards suffix, host towards domain. A host is blocked where even the upper bound of its posterior is
below ``min_good``. DataFrame functions only.

Results in special cases: a NULL url or one without ``://`` has an empty host and path, which is a host like any other;
a host without labelled pages has its domain's posterior; without any labelled page every host is allowed; repeated
pages are judged each, repeated outcomes of one page all count; outcomes other than 0 and 1 are left out. Further
columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SUFFIX = r"(?:co|com|org|net|gov|ac|edu)\.[a-z][a-z]|[^.]+"
SUFFIX_PATTERN = rf"(?:^|\.)({SUFFIX})$"
DOMAIN_PATTERN = rf"(?:^|\.)([^.]+\.(?:{SUFFIX}))$"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, URL_PATTERN, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; NULL without one."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))

    def pick(value) -> Column:
        fits = [(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), value(r)) for r in ordered]
        if not fits:
            return F.lit(None).cast("string")
        return reduce(lambda chain, f: chain.when(f[0], F.lit(f[1])), fits[1:], F.when(fits[0][0], F.lit(fits[0][1])))

    return pick(lambda r: r.text), pick(lambda r: r.verdict)


def _weight(children: DataFrame, parent_share: Column) -> Column:
    """Prior weight of a level by moments: 1 / rho - 1, rho the correlation of outcomes within a child."""
    p, n, k = parent_share, F.col("n"), F.col("k")
    noise = p * (1 - p)
    excess = F.sum(n * F.pow(k / n - p, 2) - noise)
    room = F.sum(noise * (n - 1))
    rho = F.when(room > 0, F.least(F.greatest(excess / room, F.lit(0.001)), F.lit(0.999))).otherwise(0.5)
    return children.filter(n > 0).agg((1 / rho - 1).alias("w")).scalar()


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, domain, suffix, n, k, good_mean, good_upper) of every host of ``pages`` (page_id, host)."""
    seen = (
        outcomes.filter(F.col("outcome").isin(0, 1)).groupBy("page_id")
        .agg(F.count("outcome").alias("n"), F.sum("outcome").cast("long").alias("k"))
    )
    hosts = stored(
        pages.select("page_id", "host").join(seen, "page_id", "left").groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
        .withColumn("suffix", F.regexp_extract("host", SUFFIX_PATTERN, 1))
        .withColumn("domain", F.regexp_extract("host", DOMAIN_PATTERN, 1))
        .withColumn("domain", F.when(F.col("domain") == "", F.col("host")).otherwise(F.col("domain"))),
        "hosts",
    )
    total = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("suffix", "domain").agg(*total)
    suffixes = domains.groupBy("suffix").agg(*total)
    overall = hosts.agg(F.when(F.sum("n") > 0, F.sum("k") / F.sum("n")).alias("p")).scalar()

    def raw(level: DataFrame, *names: str) -> DataFrame:
        return level.filter("n > 0").select(*names, (F.col("k") / F.col("n")).alias("up"))

    w_suffix = _weight(suffixes, overall)
    w_domain = _weight(domains.join(raw(suffixes, "suffix"), "suffix"), F.col("up"))
    w_host = _weight(hosts.join(raw(domains, "suffix", "domain"), ["suffix", "domain"]), F.col("up"))
    by_suffix = suffixes.select(
        "suffix", ((F.col("k") + w_suffix * overall) / (F.col("n") + w_suffix)).alias("suffix_mean"))
    by_domain = domains.join(by_suffix, "suffix").select(
        "suffix", "domain",
        ((F.col("k") + w_domain * F.col("suffix_mean")) / (F.col("n") + w_domain)).alias("domain_mean"))
    mean, size = F.col("good_mean"), F.col("n") + w_host
    return (
        hosts.join(by_domain, ["suffix", "domain"])
        .withColumn("good_mean", (F.col("k") + w_host * F.col("domain_mean")) / size)
        .withColumn("good_upper", mean + z * F.sqrt(mean * (1 - mean) / (size + 1)))
        .select("host", "domain", "suffix", "n", "k", "good_mean", "good_upper")
    )


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), min_good: float = 0.5, z: float = 1.645
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``pages`` has page_id and url, ``outcomes`` page_id and outcome.

    A host may own a third of all pages: counts are summed before the shuffle, and the join back to the pages is an
    inner join on the host that adaptive execution splits.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    reputation = host_reputation(parts, outcomes, z).select("host", "good_upper")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("good_upper") < min_good, "block").otherwise("allow")
    return parts.join(reputation, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"))

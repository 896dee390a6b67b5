"""URL filtering by empirical-Bayes host reputation, in DataFrame expressions only.

Labelled page outcomes (bad or not) are counted per host and shrunk down the hierarchy: the corpus rate is
the prior of each suffix, the suffix's posterior mean that of each registered domain, the domain's that of
each host. The strength of each beta prior is estimated from the data: the intra-class correlation of a
beta-binomial, by moments over all units of the level. A host is blocked when the lower end of its
posterior (mean minus ``Z`` standard deviations) is above ``MOST_BAD``; hosts without any outcome are judged
by their domain's prior. Explicit rules go before: of those whose host and path fit, the longest wins.

Counts are partially aggregated before they shuffle, so one host may hold any share of the pages. Only
three numbers, the prior strengths, pass through the driver.

Defined cases: a null url, or one without ``://``, has empty host and path and is judged as the host of
empty name; outcomes for unknown pages are ignored; several outcomes of one page all count; a page listed
twice is judged twice; without any outcome the corpus rate is 0.5 and nothing is blocked by reputation
(the bound stays below). The suffix is the last label, the registered domain the last two (an address of
digits and dots is its own domain). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.storage import stored

MOST_BAD = 0.25
Z = 1.645
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.when(at > 0, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(at > 0, path).otherwise("")


def domain(host: Column) -> Column:
    return F.when(host.rlike(r"^[0-9.]+$"), host).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of ``(host, path, verdict)`` that fits, as text and as verdict; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        text, verdict = F.when(fits, own + start).otherwise(text), F.when(fits, says).otherwise(verdict)
    return text, verdict


def correlation(level: DataFrame) -> float:
    """Intra-class correlation of units ``n, bad`` around their parents' rates ``parent``, between 0.001 and 0.5."""
    n, m = F.col("n").cast("double"), F.col("parent")
    row = level.where("n > 0").agg(
        F.sum(n * (F.col("bad") / n - m) * (F.col("bad") / n - m)).alias("s"), F.sum(m * (1 - m)).alias("v"), F.sum(m * (1 - m) * (n - 1)).alias("w")).first()
    return min(0.5, max(0.001, (row.s - row.v) / row.w)) if row.w else 0.001


def reputations(outcomes: DataFrame) -> DataFrame:
    """``host, mean, bound`` from ``outcomes`` (host, bad 0/1 or null for a page without outcome)."""
    one = F.col("bad").isNotNull().cast("long")
    hosts = stored(outcomes.groupBy("host").agg(F.sum(one).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
                   .withColumn("domain", domain(F.col("host"))).withColumn("suffix", F.substring_index("host", ".", -1)), "hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = total.bad / total.n if total.n else 0.5

    def raw(level: DataFrame) -> Column:
        return F.when(F.col("n") > 0, F.col("bad") / F.col("n")).otherwise(F.lit(rate))

    strength = [1 / correlation(level) - 1 for level in (
        suffixes.withColumn("parent", F.lit(rate)),
        domains.join(suffixes.select("suffix", raw(suffixes).alias("parent")), "suffix"),
        hosts.join(domains.select("domain", "suffix", raw(domains).alias("parent")), ["domain", "suffix"]))]

    def shrunk(k: int, parent: Column) -> Column:
        return (strength[k] * parent + F.col("bad")) / (strength[k] + F.col("n"))

    by_suffix = suffixes.select("suffix", shrunk(0, F.lit(rate)).alias("parent"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", "suffix", shrunk(1, F.col("parent")).alias("parent"))
    mean, weight = shrunk(2, F.col("parent")), strength[2] + F.col("n")
    judged = hosts.join(by_domain, ["domain", "suffix"]).select("host", mean.alias("mean"), weight.alias("weight"))
    return judged.select("host", "mean", (F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, host, path, rule, verdict, mean`` for every page; ``outcomes`` has (key, bad 0/1)."""
    host, path = parts(F.col(url))
    split = pages.select(key, host.alias("host"), path.alias("path"))
    counted = split.select(key, "host").join(outcomes.select(key, "bad"), key, "left").select("host", "bad")
    known = reputations(counted)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    return split.join(known, "host", "left").select(
        key, "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("bound") > MOST_BAD, "block").otherwise("allow")).alias("verdict"), "mean")

"""URL filters: rules first, then the reputation of hosts.

Method: empirical Bayes. Pages with a known outcome (good or not) are counted by
host, registered domain and public suffix. Each level is shrunk towards the one
above it by a beta-binomial prior: its mean is that of the level above, its
weight the one that the spread of the level's rates speaks for (moments, kept
within ``WEIGHTS``). A host's posterior is a beta distribution; a page is
blocked where the upper bound of its host's rate (``Z`` deviations on the logit
scale) stays under ``LEAST_GOOD``, so a host goes only when the evidence is
against it. A host nobody has judged takes its domain's posterior, or its
suffix's if nobody has judged the domain.

Only DataFrame functions: hosts are counted before any shuffle, levels above are
sums of the level below, and the pages meet their host's row in a join that
adaptive execution splits where one host has very many pages.

``rules`` is a list of (verdict, host, path): a rule fits its host and all
subdomains if the page's path starts with the rule's; the longest wins.

Defined results: a null url, or one without ``://``, has empty host and path and
fits no rule; its host is judged like any other. Repeated rows count as often as
they stand. Outcomes other than 0 and 1 are none. Without any outcome nothing
but rules blocks. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblark.llm.common import Scratch, table

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LEAST_GOOD, Z = 0.5, 1.645
WEIGHTS = (1.0, 1000.0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Second-level labels that are public below a country's code.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"(?s)\A([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"(?s)\A[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or two below a country's code; addresses of numbers have none."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$|\.$", "")
    labels = F.split(bare, r"\.")
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    two = (F.length(last) == 2) & (F.size(labels) > 2) & second.isin(SECOND_LEVEL)
    return F.when(bare.rlike(r"^[0-9.]*$|^\["), "").when(two, F.concat(second, F.lit("."), last)).otherwise(last)


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$|\.$", "")
    suffix = suffix_of(host)
    labels = F.split(bare, r"\.")
    taken = F.size(F.split(suffix, r"\.")) + 1
    return F.when(suffix == "", bare).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - taken + 1, F.lit(1)), taken), "."))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    known = F.array(*[F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in ordered])
    fit = F.filter(known, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    first = F.get(fit, 0)
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def prior_weight(n: Column, k: Column, mean: Column) -> Column:
    """An aggregate: the weight of the beta prior under which rates k/n of mean ``mean`` spread as they do."""
    groups, total = F.count_if(n > 0), F.sum(n)
    spread = F.sum(F.when(n > 0, n * (k / n - mean) * (k / n - mean)).otherwise(0.0))
    noise = F.sum(F.when(n > 0, mean * (1 - mean)).otherwise(0.0))
    room = F.sum(F.when(n > 0, (n - 1) * mean * (1 - mean)).otherwise(0.0))
    share = F.when((groups > 0) & (total > groups) & (room > 0), (spread - noise) / room).otherwise(F.lit(None))
    weight = F.when(share > 0, (1 - share) / share).otherwise(WEIGHTS[1])
    # In 4,096ths, so that sums in another order give the same number.
    return F.floor(F.least(F.greatest(weight, F.lit(WEIGHTS[0])), F.lit(WEIGHTS[1])) * 4096 + 0.5) / 4096


def reputation(scratch: Scratch, outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posteriors of hosts, domains and suffixes: the key, judged pages n and good ones k, and the counts a and b of
    the beta distribution. ``outcomes`` has host and good (1 or 0)."""
    judged = outcomes.where("good in (0, 1)").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("good").cast("double").alias("k"))
    hosts = judged.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k")
    hosts = scratch.keep(hosts, "hosts")
    add = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = scratch.keep(add(hosts, "domain", "suffix"), "domains")
    suffixes = scratch.keep(add(domains, "suffix"), "suffixes")
    whole = suffixes.agg(((F.coalesce(F.sum("k"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("above"))
    by_suffix = scratch.keep(shrunk(suffixes.crossJoin(F.broadcast(whole))), "by-suffix")  # one row
    by_domain = scratch.keep(shrunk(domains.join(by_suffix.select("suffix", F.col("mean").alias("above")), "suffix")), "by-domain")
    by_host = scratch.keep(shrunk(hosts.join(by_domain.select("domain", F.col("mean").alias("above")), "domain")), "by-host")
    return by_host, by_domain, by_suffix


def shrunk(level: DataFrame) -> DataFrame:
    """``level`` (n, k and above, the mean one level up) with the posterior's counts a and b and its mean."""
    n, k, above = F.col("n"), F.col("k"), F.col("above")
    weight = level.agg(prior_weight(n, k, above).alias("w"))
    with_weight = level.crossJoin(F.broadcast(weight))  # one row
    a, b = k + F.col("w") * above, n - k + F.col("w") * (1 - above)
    return with_weight.withColumn("a", a).withColumn("b", b).withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))).drop("w", "above")


def upper_bound(a: Column, b: Column, z: float = Z) -> Column:
    """Of a beta distribution, ``z`` deviations above the middle on the logit scale."""
    return 1 / (1 + F.exp(-(F.log(a / b) + z * F.sqrt(1 / a + 1 / b))))


def blocked_hosts(scratch: Scratch, hosts: DataFrame, outcomes: DataFrame, least_good: float = LEAST_GOOD) -> DataFrame:
    """Those of ``hosts`` (host, distinct) whose upper bound is too low: by their own posterior, else their domain's,
    else their suffix's."""
    bound = upper_bound(F.col("a"), F.col("b"))
    levels = reputation(scratch, outcomes)
    found = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    for key, level in zip(("host", "domain", "suffix"), levels, strict=True):
        found = found.join(level.select(key, bound.alias(f"_{key}")), key, "left")
    return found.where(F.coalesce("_host", "_domain", "_suffix") < least_good).select("host")


def judged_pages(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], outcomes: DataFrame | None = None, least_good: float = LEAST_GOOD) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and verdict. ``outcomes`` (host, good) are judged pages; without
    them the pages that a rule fits are, allowed ones being good."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    read = read.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("said"))
    if outcomes is None:
        outcomes = read.where("said is not null").select("host", (F.col("said") == "allow").cast("int").alias("good"))
    scratch = Scratch(spark, "urls")
    blocked = blocked_hosts(scratch, read.where("said is null").select("host").distinct(), outcomes, least_good)
    blocked = scratch.keep(blocked, "blocked").withColumn("by_host", F.lit("block"))
    ruled = read.where("said is not null").select("page_id", "host", "path", "rule", F.col("said").alias("verdict"))
    others = read.where("said is null").join(blocked, "host", "left")
    return ruled.unionByName(others.select("page_id", "host", "path", "rule", F.coalesce("by_host", F.lit("allow")).alias("verdict")))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged, by its rule or by its host's reputation."""
    return judged_pages(spark, table(spark, sf_dir, "pages"), RULES)

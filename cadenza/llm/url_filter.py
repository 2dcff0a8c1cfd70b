"""URL filters: rules on hosts and paths, and the reputation of hosts where no rule fits.

Outcomes of labelled pages are counted for each host. Each host's share of bad pages is a beta-binomial posterior whose prior is
its registered domain's posterior mean, whose prior is its suffix's, whose prior is the share of all pages; how strongly a level
holds to its prior is estimated from all of that level's counts by moments. A host is blocked when the lower bound of its
posterior is over a limit, so a host with few labels keeps what its domain and suffix say. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, written

#: Verdict and rule, a host and the beginning of a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: More rules than this make the plan too large; give them as several filters.
MOST_RULES = 1_000
#: Suffixes of two labels below which domains are registered; all others have one label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.jp", "ne.jp", "co.nz", "co.za", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr")
#: A host is blocked when its share of bad pages is over LIMIT by DEVIATIONS standard deviations of the posterior.
LIMIT, DEVIATIONS = 0.5, 1.645
#: Bounds of the correlation of outcomes within a unit; the prior counts as 1 / correlation - 1 pages.
LEAST_RHO, MOST_RHO = 0.001, 0.5
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://, empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), CAPITALS, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, of equally long ones that of the longer host; null without one."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[1])):
        own = rule[: rule.index("/")]
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(rule[len(own) :]))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def levels_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; ports do not count, an address of numbers is its own domain under the empty suffix."""
    bare = F.regexp_replace(host, r"\.?(:[0-9]*)?$", "")
    number = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$") | bare.startswith("[")
    two = F.substring_index(bare, ".", -2)
    long = two.isin(*suffixes)
    domain = F.when(number, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(two)
    suffix = F.when(number, F.lit("")).when(long, two).otherwise(F.substring_index(bare, ".", -1))
    return domain, suffix


def strength(units: DataFrame, mean: str) -> float:
    """How many pages the prior of a level counts as, by moments of its units (n, bad, and the prior's `mean`).

    Over all units the squared distance of bad from n * mean is compared with what independent pages would give; the excess is the
    correlation of two pages of a unit, held to LEAST_RHO..MOST_RHO, and LEAST_RHO where no unit has two pages.
    """
    n, m = F.col("n").cast("double"), F.col(mean)
    spread = F.sum((F.col("bad") - n * m) * (F.col("bad") - n * m) - n * m * (1 - m))
    pairs = F.sum(n * (n - 1) * m * (1 - m))
    rho = units.agg(F.try_divide(spread, pairs)).first()[0] or 0.0
    return round(1 / min(MOST_RHO, max(LEAST_RHO, rho)) - 1, 6)


def posterior(mean: Column, held: float) -> Column:
    """Posterior mean of a unit with n pages, `bad` of them bad, under a prior of `mean` that counts as `held` pages."""
    return (mean * held + F.col("bad")) / (F.col("n") + F.lit(held))


def host_reputation(pages: DataFrame, outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """host, pages, n, bad, share, low of each host of `pages` (page_id, host): share is the posterior mean, low its lower bound.

    `outcomes` has (page_id, bad); of several outcomes of a page one bad one counts, null outcomes and pages without one do not. With
    no outcome at all the share of all pages is a half.
    """
    known = outcomes.filter(F.col("bad").isNotNull()).groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    met = pages.groupBy("page_id", "host").agg(F.count("*").alias("pages")).join(known, "page_id", "left")
    counts = met.groupBy("host").agg(F.sum("pages").alias("pages"), F.sum(F.when(F.col("bad").isNotNull(), F.col("pages")).otherwise(0)).alias("n"), F.sum(F.coalesce(F.col("bad") * F.col("pages"), F.lit(0))).alias("bad"))
    domain, suffix = levels_of(F.col("host"), suffixes)
    hosts = written(counts.withColumns({"domain": domain, "suffix": suffix, "spread": F.xxhash64("host")}), "hosts")
    summed = [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("units")]
    domains = written(hosts.groupBy("domain", "suffix").agg(*summed).withColumn("spread", F.xxhash64("domain")), "domains")
    tops = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("below")), "suffixes")
    n, bad = tops.agg(F.sum("n"), F.sum("bad")).first()
    tops = tops.withColumn("prior", F.lit((bad + 0.5) / (n + 1) if n else 0.5))
    tops = tops.select("suffix", "below", posterior(F.col("prior"), strength(tops, "prior")).alias("prior"))
    domains = join_groups(domains, tops, "suffix", "below")
    domains = domains.select("domain", "units", posterior(F.col("prior"), strength(domains, "prior")).alias("prior"))
    hosts = join_groups(hosts, domains, "domain", "units")
    held = strength(hosts, "prior")
    share = posterior(F.col("prior"), held)
    deviation = F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("n") + F.lit(held) + 1))
    return hosts.withColumn("share", share).select("host", "pages", "n", "bad", "share", (F.col("share") - DEVIATIONS * deviation).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, share, low of every row of `pages` (page_id, url).

    A null url and one without :// has an empty host and path, which is a host like any other and fits no rule. Rows that repeat are
    judged alike and count as often as they stand; a null page_id has no outcome. Other columns are ignored; an empty table gives
    no rows.
    """
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = written(host_reputation(parts, outcomes), "reputation")
    told = parts.withColumns({"_rule": rule_of(F.col("host"), F.col("path"), rules), "_spread": F.xxhash64("page_id", "path")})
    met = join_groups(told, hosts.select("host", "pages", "share", "low"), "host", "pages")
    verdict = F.coalesce("_rule.verdict", F.when(F.col("low") > limit, "block").otherwise("allow"))
    return met.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "share", "low")


def label_outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, bad) of labels that stand under page numbers: bad is toxic or of quality 0."""
    return labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), True).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), False).alias("bad"))

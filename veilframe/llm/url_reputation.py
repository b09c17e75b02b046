"""URL filter with empirical-Bayes host reputation.

Rules judge a url first: a rule fits its host and all subdomains when the url's path starts with the rule's
path; the longest rule wins.  Urls without a rule are judged by the reputation of their host.

Outcomes are the pages that a rule judged (or any other labels in ``outcome``: 1 bad, 0 good).  Each level of
suffix, registered domain and host has a beta-binomial prior centred on its parent's posterior mean; the
prior's strength is estimated from the spread of the level's rates (method of moments), but is at most
one more than the parent's number of outcomes, so that a prior never claims more evidence than there is.  A host's
posterior mean, less ``z`` posterior standard deviations, is the lower bound of its share of bad pages; above
``limit`` the url is blocked.  Hosts without outcomes take their parent's posterior through the prior.

The registered domain is the suffix and one label more; the suffix is the longest of ``suffixes`` (of two labels) that the
host ends with, else its last label.  A user, a port and a closing dot do not count for these levels; an address of digits
and dots, or in brackets, is a suffix and a domain of its own.

Levels are aggregates of host sums, so a host with a third of all pages is one row per task; only hosts,
not pages, are summed again for domains and suffixes.  The join back to pages is between plain tables,
which adaptive execution can split.

Edge cases: a null url, or one without ``://``, has empty host and path, no rule and the reputation of
the empty host; rows repeat as given; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import drop, materialise


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


# Public suffixes of two labels under which anyone can register; the full public list can be given instead.
SUFFIXES = """co.uk org.uk ac.uk gov.uk me.uk com.au net.au org.au edu.au co.nz org.nz co.za com.br net.br org.br co.jp or.jp ne.jp ac.jp
co.kr or.kr com.cn net.cn org.cn com.tw com.hk com.sg com.my co.in net.in org.in co.id com.tr com.mx com.ar com.ua com.pl co.il""".split()


def levels(host: Column, suffixes: list[str]) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")
    two = F.substring_index(name, ".", -2)
    long = two.isin(suffixes) if suffixes else F.lit(False)
    address = name.rlike(r"^(\[.*\]|[0-9.]+)$")
    suffix = F.when(address, name).when(long, two).otherwise(F.substring_index(name, ".", -1))
    return F.when(address, name).when(long, F.substring_index(name, ".", -3)).otherwise(two), suffix


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    return F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """``field`` of the longest fitting rule, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # later wraps earlier, so the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


def strength(rows: DataFrame, bad: str = "bad", n: str = "n") -> DataFrame:
    """One row: overall mean ``m`` and prior strength ``s`` of the rates in ``rows``."""
    sums = rows.where(f"{n} > 0").agg(
        F.count("*").alias("k"), F.coalesce(F.sum(bad), F.lit(0)).alias("b"), F.coalesce(F.sum(n), F.lit(0)).alias("t"),
        F.coalesce(F.sum(F.col(bad).cast("double") * F.col(bad) / F.col(n)), F.lit(0.0)).alias("q"), F.coalesce(F.sum(F.col(n).cast("double") * F.col(n)), F.lit(0.0)).alias("nn"),
    )
    m = (F.col("b") + 0.5) / (F.col("t") + 1)
    spread = F.col("q") - F.col("b").cast("double") * F.col("b") / F.greatest("t", F.lit(1))  # sum of n (p - mean)^2
    v = m * (1 - m)
    rho = F.try_divide(spread - v * (F.col("k") - 1), v * (F.col("t") - F.col("nn") / F.greatest("t", F.lit(1)) - F.col("k") + 1))
    rho = F.when(F.col("k") > 1, F.least(F.greatest(F.coalesce(rho, F.lit(0.5)), F.lit(0.01)), F.lit(0.9))).otherwise(0.5)
    return sums.select(m.alias("m"), (1 / rho - 1).alias("s"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", outcome: Column | None = None, z: float = 1.645, limit: float = 0.5, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, bad_rate, bound."""
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), *([outcome.cast("int").alias("given")] if outcome is not None else []))
    rows = rows.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    host, path = F.col("host"), F.col("path")
    rows = rows.withColumn("rule", matched(host, path, rules, "text")).withColumn("ruled", matched(host, path, rules, "verdict"))
    bad = F.col("given") if outcome is not None else (F.col("ruled") == "block").cast("int")
    hosts = rows.groupBy("host").agg(F.coalesce(F.sum(bad), F.lit(0)).alias("bad"), F.count(bad).alias("n"))
    domain, suffix = levels(F.col("host"), suffixes)
    hosts = materialise(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "op8-hosts")
    domains = materialise(hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")), "op8-domains")
    suffixes = materialise(domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")), "op8-suffixes")
    top, mid, low = (strength(x).first() for x in (suffixes, domains, hosts))

    def posterior(mean: Column, s: Column) -> Column:
        return (F.col("x.bad") + s * mean) / (F.col("x.n") + s)

    at_suffix = suffixes.alias("x").select(F.col("x.suffix"), F.col("x.n").alias("suffix_n"), posterior(F.lit(top["m"]), F.lit(top["s"])).alias("suffix_rate"))
    s = F.least(F.lit(mid["s"]), F.col("suffix_n") + 1.0)
    at_domain = domains.alias("x").join(at_suffix, "suffix").select("domain", F.col("x.n").alias("domain_n"), posterior(F.col("suffix_rate"), s).alias("domain_rate"))
    s = F.least(F.lit(low["s"]), F.col("domain_n") + 1.0)
    at_host = hosts.alias("x").join(at_domain, "domain").select("host", "n", s.alias("s"), posterior(F.col("domain_rate"), s).alias("bad_rate"))
    bound = F.col("bad_rate") - z * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("n") + F.col("s") + 1))
    known = materialise(at_host.select("host", "bad_rate", bound.alias("bound")), "op8-reputation")
    drop(hosts, domains, suffixes)
    method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return rows.join(known, "host").select("id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "bad_rate", "bound")

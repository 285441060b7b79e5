"""URL filter: explicit prefix rules first, then empirical-Bayes reputation.

Labelled outcomes of pages (1 good, 0 bad) are counted by host, registered
domain and public suffix. Each level is shrunk towards its parent through a
beta-binomial prior whose strength is estimated from the spread between the
level's groups (method of moments). A host is blocked if even the upper
bound of its posterior share of good pages lies below ``min_good``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, unused

#: Public suffixes of two labels.
TWO_LABEL_SUFFIXES = "ac.uk co.in co.jp co.kr co.nz co.uk co.za com.ar com.au com.br com.cn com.mx com.tr gov.uk ne.jp net.au or.jp org.au org.uk".split()

#: (verdict, rule): a rule is a host, which covers its subdomains, and a path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

WEAKEST, STRONGEST = 2.0, 200.0  # bounds of a prior's strength, in pages


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls if none fits. Among
    rules of one length a block goes first. ``rules`` is a configuration list,
    compiled into one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[0] == "block")):
        at = r.find("/") if "/" in r else len(r)
        fits = ((host == r[:at]) | host.endswith("." + r[:at])) & path.startswith(r[at:])
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Public suffix and registered domain of a host, its port dropped."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    suffix = F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))
    domain = F.when(two.isin(*TWO_LABEL_SUFFIXES), F.regexp_extract(name, r"((?:[^.]+\.)?[^.]+\.[^.]+)$", 1)).otherwise(F.when(two != "", two).otherwise(name))
    return suffix, domain


def _strength(groups: DataFrame, mean: float) -> float:
    """Prior strength from the spread of the groups' shares around ``mean``;
    the weakest if the data cannot tell."""
    r = groups.where("n > 0").agg(F.sum(F.try_divide(F.col("k") * F.col("k"), F.col("n"))).alias("q"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("g")).first()
    if not r["n"] or r["n"] <= r["g"] or not 0 < mean < 1:
        return WEAKEST
    spread = (r["q"] - 2 * mean * r["k"] + mean * mean * r["n"]) / (mean * (1 - mean))
    rho = (spread - r["g"]) / (r["n"] - r["g"])
    rho = min(max(rho, 1 / (1 + STRONGEST)), 1 / (1 + WEAKEST))
    return 1 / rho - 1


def host_reputation(hosts: DataFrame) -> DataFrame:
    """``hosts`` has host, k (good) and n (labelled pages), one row a host.
    Adds good_mean and good_sd of each host's posterior."""
    suffix, domain = suffix_and_domain(F.col("host"))
    h = hosts.select("host", "k", "n", suffix.alias("suffix"), domain.alias("domain"))
    domains = h.groupBy("suffix", "domain").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    total = suffixes.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    mean = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)
    m = [_strength(x, mean) for x in (suffixes, domains, h)]
    s = suffixes.select("suffix", ((F.col("k") + m[0] * mean) / (F.col("n") + m[0])).alias("ps"))
    d = domains.join(s, "suffix").select("domain", "suffix", ((F.col("k") + m[1] * F.col("ps")) / (F.col("n") + m[1])).alias("pd"))
    a, b = F.col("k") + m[2] * F.col("pd"), F.col("n") - F.col("k") + m[2] * (1 - F.col("pd"))
    return h.join(d, ["domain", "suffix"]).select("host", (a / (a + b)).alias("good_mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("good_sd"))


def judge(pages: DataFrame, outcome_col: str | None, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, min_good: float = 0.8, z: float = 1.6448536269514722) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    ``outcome_col`` holds 1 (good), 0 (bad) or null (not labelled); any other
    value counts as not labelled. Verdict: the longest fitting rule's, else
    block if the host's posterior mean plus ``z`` deviations is below
    ``min_good``, else allow. Null urls and those without :// have an empty
    host and path and are judged as the host ''. Columns of the four names
    are replaced; rows are kept one to one, repeated ones too."""
    host, path = parts(F.col(url_col))
    d = pages.withColumns({"host": host, "path": path})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    good = F.col(outcome_col).cast("int") if outcome_col else F.lit(None).cast("int")
    hosts = d.groupBy("host").agg(F.count(F.when(good == 1, 1)).alias("k"), F.count(F.when(good.isin(0, 1), 1)).alias("n"))
    blocked = host_reputation(hosts).where(F.col("good_mean") + z * F.col("good_sd") < min_good)
    bad = unused(d, "bad_host")
    d = d.join(blocked.select("host", F.lit(True).alias(bad)), "host", "left")
    d = d.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col(bad), F.lit("block")).otherwise(F.lit("allow")))})
    return d.drop(bad)


def page_outcomes(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``page_outcome``: labels.quality of the document that the
    path names (/<language>/<doc_id>), null where it names none or none is
    labelled. A document labelled more than once counts as its lowest label; labels
    without an id count for none. A column ``page_outcome`` of ``pages`` is replaced;
    all other columns and all rows, repeated ones too, are kept as they are."""
    _, path = parts(F.col(url_col))
    key = unused(pages, "named_doc")
    d = pages.withColumn(key, F.regexp_extract(path, r"^/[a-z]{2}/([0-9]{1,18})(?:[^0-9]|$)", 1).try_cast("long"))
    best = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.min("quality").alias("page_outcome"))
    return d.drop("page_outcome").join(best, key, "left").drop(key)

"""URL filters: explicit rules, then empirical-Bayes reputations of hosts.

Labelled pages give each host a number of pages and of bad ones. A host's rate
is shrunk to its registered domain's, that one's to its suffix's, and that
one's to the overall rate, each step a beta-binomial posterior whose prior
weight is estimated by the method of moments from the spread of the children
around their parents. A page is blocked where the lower posterior bound of its
host's bad rate exceeds ``max_bad``. A host without labels has the posterior
of the nearest ancestor that has some.

For reputations, a host loses its user name, port and closing dots. Its suffix
is the last label, or the last two where these are one of ``SHARED_SUFFIXES``
or a label of ``SECOND_LEVEL`` under a country's two letters; the registered
domain has one label more. An address in numbers is its own domain and suffix.

Counts are combined before they are shuffled, so a hot host costs one row a
task; each level is written once, for the next to read; pages meet reputations
in a join that may be split where it is skewed.

Cases: a null url, or one without ``://``, has an empty host and path and no
rule; an empty host is a host like any other; labels may repeat, each counts;
a null label counts as no evidence of harm; of rules that tie in length the
later one wins; repeated rows are judged alike; without labels nothing but rules
blocks; empty tables give empty results; a very long url is matched by
expressions that are linear in it; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.shared import Scratch

#: Verdict, host and path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
Z = 1.645
MAX_BAD = 0.5
#: Second-level labels that registries of countries share out, and suffixes under which owners of sites differ.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "mil", "ne", "net", "or", "org", "sch")
SHARED_SUFFIXES = (
    "appspot.com", "azurewebsites.net", "blogspot.com", "cloudfront.net", "firebaseapp.com", "fly.dev", "github.io", "gitlab.io", "glitch.me", "herokuapp.com", "id.au", "ltd.uk", "me.uk", "neocities.org",
    "netlify.app", "onrender.com", "pages.dev", "plc.uk", "readthedocs.io", "surge.sh", "vercel.app", "web.app", "weebly.com", "wordpress.com", "workers.dev",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of rule and verdict, null where none fits; the longest rule wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def bare_host(host: Column) -> Column:
    """Without user name, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", ""), r"\.+\z", "")


def _suffix_labels(bare: Column) -> Column:
    """How many labels the suffix has; 0 for an address in numbers."""
    last, second = F.substring_index(bare, ".", -1), F.substring_index(F.substring_index(bare, ".", -2), ".", 1)
    shared = F.substring_index(bare, ".", -2).isin(*SHARED_SUFFIXES) | (last.rlike(r"^[a-z]{2}\z") & bare.contains(".") & second.isin(*SECOND_LEVEL))
    return F.when(bare.rlike(r"(?s)^(?:[0-9.]+|\[.*)\z"), 0).when(shared, 2).otherwise(1)


def suffix(host: Column) -> Column:
    bare = bare_host(host)
    n = _suffix_labels(bare)
    return F.when(n == 0, bare).when(n == 2, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))


def registered_domain(host: Column) -> Column:
    bare = bare_host(host)
    n = _suffix_labels(bare)
    return F.when(n == 0, bare).when(n == 2, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def _prior_weight(children: DataFrame) -> DataFrame:
    """One row ``k``: the prior weight for a level of ``children(n, bad, prior)``.

    The analysis-of-variance estimator of the correlation within children,
    kept between 0.001 and 0.9.
    """
    p, n = F.col("bad") / F.col("n"), F.col("n").cast("double")
    spread = children.agg(
        F.count("*").alias("j"), F.sum(n).alias("total"), F.sum(n * n).alias("squares"), F.sum(n * (p - F.col("prior")) * (p - F.col("prior"))).alias("between"), F.sum(n * F.col("prior") * (1 - F.col("prior"))).alias("within"),
    )
    mean_var = F.col("within") / F.col("total")
    spare = F.col("total") - F.col("squares") / F.col("total") - (F.col("j") - 1)
    rho = F.when((mean_var > 0) & (spare > 0), (F.col("between") - (F.col("j") - 1) * mean_var) / (mean_var * spare)).otherwise(0.0)
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.9), rho))
    return spread.select((1 / rho - 1).alias("k"))


def host_counts(outcomes: DataFrame) -> DataFrame:
    """``host, n, bad`` from labelled pages ``outcomes(host, bad)``."""
    return outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("bad"), F.lit(False)).cast("long")).alias("bad"))


def host_reputations(scratch: Scratch, counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posteriors ``alpha, beta, mean`` by host, domain and suffix and overall, from ``counts(host, n, bad)``."""
    hosts = scratch.put(counts.select("host", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "bad"))
    domains = scratch.put(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = scratch.put(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    overall = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    overall = scratch.put(overall.select((F.col("bad") + 0.5).alias("alpha"), (F.col("n") - F.col("bad") + 0.5).alias("beta")).withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta"))))

    def posterior(level: DataFrame) -> DataFrame:
        level = scratch.put(level)
        k, m = F.col("k"), F.col("prior")
        known = level.crossJoin(F.broadcast(_prior_weight(level)))  # one row
        return scratch.put(known.select(*(c for c in level.columns if c != "prior"), (F.col("bad") + k * m).alias("alpha"), (F.col("n") - F.col("bad") + k * (1 - m)).alias("beta")).withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta"))))

    suffixes = posterior(suffixes.crossJoin(F.broadcast(overall.select(F.col("mean").alias("prior")))))  # one row
    domains = posterior(domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"))
    hosts = posterior(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain"))
    return hosts, domains, suffixes, overall


def lower_bound(alpha: Column, beta: Column, z: float = Z) -> Column:
    """Of a beta posterior, by its mean and deviation."""
    n = alpha + beta
    return alpha / n - z * F.sqrt(alpha * beta / (n * n * (n + 1)))


def judge_urls(pages: DataFrame, outcomes: DataFrame, *, rules=RULES, z: float = Z, max_bad: float = MAX_BAD, page_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_bound`` for every page; ``outcomes(host, bad)`` are labelled pages."""
    scratch = Scratch(pages.sparkSession, "reputation")
    hosts, domains, suffixes, whole = host_reputations(scratch, host_counts(outcomes))
    scratch.drop_all_but(hosts, domains, suffixes, whole)
    judged = pages.select(F.col(page_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    names = judged.groupBy("host").agg(F.count("*").alias("pages"))
    bound = lambda t, key, as_: t.select(key, lower_bound(F.col("alpha"), F.col("beta"), z).alias(as_))
    verdicts = (
        names.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))})
        .join(bound(hosts, "host", "b0"), "host", "left").join(bound(domains, "domain", "b1"), "domain", "left").join(bound(suffixes, "suffix", "b2"), "suffix", "left")
        .crossJoin(F.broadcast(whole.select(lower_bound(F.col("alpha"), F.col("beta"), z).alias("b3"))))
        .select("host", F.coalesce("b0", "b1", "b2", "b3").alias("bad_bound"))
    )
    rule = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return judged.withColumn("_rule", rule).join(verdicts, "host", "left").select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), "bad_bound")

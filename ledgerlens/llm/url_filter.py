"""URL filter by Empirical-Bayes host reputation, under explicit rules.

Outcomes of labelled pages (bad or not) are counted per host. A host's bad
rate is shrunk by beta-binomial priors from the whole set to the public suffix, to
the registered domain (the suffix and one label more), to the host. A suffix is the
last label, or the last two where they are one of ``SUFFIXES``; for both, user
names, ports and closing dots of a host don't count, and an address is its own
domain, under the empty suffix. Each level's posterior mean is the prior mean of the next, with a prior strength that the
data set by the method of moments. A host is blocked when the lower bound of
its posterior is above ``max_bad``. Explicit rules override the verdict.

Everything is DataFrame expressions and aggregates. Only url and id are read.
Hosts are aggregated map-side, so a hot host costs one row a task; the join
back broadcasts the host table behind a check of its size, and otherwise is a
shuffle join of two exchanges whose hot key AQE splits.

Defined results: null url or no ``://``: host and path empty, judged as the
host ''. Labels without a page, null labels: not counted. Repeated labels of a
page: the page is bad if any says so. Repeated pages: one row each, counted each. No labels
at all: every host is allowed. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: (verdict, rule) as the query fixes them.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# FIXED VALUES: public suffixes of two labels under which names are registered.
SUFFIXES = (
    "ac.at", "co.at", "or.at", "com.ar", "org.ar", "com.au", "edu.au", "gov.au", "net.au", "org.au",
    "com.br", "gov.br", "net.br", "org.br", "ac.cn", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "com.co", "com.eg", "com.hk", "org.hk", "co.id", "go.id", "or.id", "ac.il", "co.il", "org.il",
    "ac.in", "co.in", "gov.in", "net.in", "org.in", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp",
    "ac.kr", "co.kr", "go.kr", "or.kr", "com.mx", "gob.mx", "org.mx", "com.my", "com.ng", "ac.nz",
    "co.nz", "govt.nz", "net.nz", "org.nz", "com.pe", "com.ph", "com.pk", "com.pl", "org.pl", "com.sa",
    "com.sg", "edu.sg", "co.th", "or.th", "com.tr", "edu.tr", "org.tr", "com.tw", "edu.tw", "org.tw",
    "com.ua", "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk",
    "sch.uk", "com.ve", "com.vn", "ac.za", "co.za", "gov.za", "org.za")
_ADDRESS = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[(?s:.*)\])\z"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else ''."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """struct(suffix, domain) of a host. A host that is a suffix itself is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, r"^(?s:.*)@", ""), r"\.*(:[0-9]*)?\z", "")
    two = F.regexp_extract(name, r"([^.]*\.)?[^.]*$", 0)
    three = F.regexp_extract(name, r"([^.]*\.)?([^.]*\.)?[^.]*$", 0)
    long = two.isin(*suffixes) if suffixes else F.lit(False)
    address = name.rlike(_ADDRESS)
    suffix = F.when(address, F.lit("")).when(long, two).otherwise(F.regexp_extract(name, r"[^.]*$", 0))
    return F.struct(suffix.alias("suffix"), F.when(address, name).when(long, three).otherwise(two).alias("domain"))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null when none does.

    Of two rules of one length the first in text order wins. The rules are few
    and part of the plan; a rule list of unbounded size would be a table.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        where, slash, rest = rule.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shrunk(children: DataFrame, prior: str) -> DataFrame:
    """Adds the moment estimate of the strength that a parent's rate has as the prior of its children.

    With children of n_i pages and rates p_i around their priors m_i, the
    weighted squared error S = sum n_i (p_i - m_i)^2 has the mean
    sum m_i (1 - m_i) (1 + (n_i - 1) rho); rho = 1 / (strength + 1).
    """
    rate, m = F.col("bad") / F.col("n"), F.col(prior)
    spread = children.where("n > 0").agg(
        F.sum(F.col("n") * (rate - m) * (rate - m)).alias("s"),
        F.sum(m * (1 - m)).alias("base"),
        F.sum(m * (1 - m) * (F.col("n") - 1)).alias("extra"))
    rho = F.least(F.lit(0.5), F.greatest(F.lit(0.002), F.try_divide(F.col("s") - F.col("base"), F.col("extra"))))
    k = spread.select(F.coalesce(F.when(F.col("extra") > 0, 1.0 / rho - 1.0), F.lit(1.0)).alias("k"))
    return children.withColumn("k", k.scalar())


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, max_bad: float = 0.5,
                    suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """host, n, bad, rate (posterior mean), bound (lower posterior bound), blocked for every host of ``pages``.

    ``outcomes`` is (page_id, bad boolean), one row a labelled page. Hosts without labelled pages
    take their domain's posterior, domains without any their suffix's.
    """
    p = pages.select(F.col("page_id").alias("id"), host_of(F.col("url")).alias("host"))
    o = outcomes.select(F.col("page_id").alias("id"), "bad")
    hosts = (p.join(o, "id", "left")
             .groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")))
    hosts = written(hosts.select("host", domain_of(F.col("host"), suffixes).alias("d"), "n", "bad").select(
        "host", "d.domain", "d.suffix", "n", "bad"), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # the whole set's rate, from one page of each outcome more than there are
    top = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m"))

    def posterior(level: DataFrame, name: str) -> DataFrame:
        lv = _shrunk(level, "prior")
        return lv.withColumn(name, (F.col("bad") + F.col("k") * F.col("prior")) / (F.col("n") + F.col("k")))

    s = posterior(suffixes.withColumn("prior", top.scalar()), "rate")
    d = posterior(domains.join(s.select("suffix", F.col("rate").alias("prior")), "suffix"), "rate")
    h = posterior(hosts.join(d.select("suffix", "domain", F.col("rate").alias("prior")), ["suffix", "domain"]), "rate")
    total = F.col("n") + F.col("k")
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (total + 1))
    bound = F.col("rate") - z * sd
    return h.select("host", "n", "bad", "rate", bound.alias("bound"), (bound > max_bad).alias("blocked"))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """page_id, bad from labels: a page is bad when any of its labels calls it low quality or toxic."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return (labels.where(F.col("doc_id").isNotNull())
            .groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
            .where(F.col("bad").isNotNull()))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
               z: float = 1.645, max_bad: float = 0.5, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict ('allow' or 'block'), host_rate, host_bound: one row a page."""
    rep = written(host_reputation(pages, outcomes, z, max_bad, suffixes), "reputation")
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    j = p.join(small(rep.select("host", "rate", "bound", "blocked")), "host", "left")
    r = matching_rule(F.col("host"), F.col("path"), rules)
    return (j.withColumn("r", r)
            .select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                    F.coalesce(F.col("r.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
                    F.round("rate", 9).alias("host_rate"), F.round("bound", 9).alias("host_bound")))


def allowed_pages(pages: DataFrame, outcomes: DataFrame, **kw) -> DataFrame:
    """The rows of ``pages`` (all their columns) whose host and rules allow them."""
    row = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), "page_id", "url")
    rep = written(host_reputation(pages, outcomes, **{k: v for k, v in kw.items() if k != "rules"}), "reputation")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    blocked = rep.where("blocked").select("host")
    r = matching_rule(host, path, kw.get("rules", RULES))
    kept = row.withColumn("host", host).join(small(written(blocked.withColumn("blocked", F.lit(True)), "blocked")), "host", "left")
    verdict = F.coalesce(r["verdict"], F.when(F.col("blocked"), "block").otherwise("allow"))
    return kept.where(verdict == "allow").select("row.*")

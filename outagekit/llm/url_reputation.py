"""URL filter by empirical-Bayes host reputation (operator 5).

Rules come first: a rule ``host/path`` fits its host and all subdomains where
the url's path starts with the rule's; the longest wins.  Every other url is
judged by its host's reputation.  Labelled page outcomes (good or bad) are
counted per host; the bad rate is shrunk through beta-binomial priors from
suffix to registered domain to host, with the strength of each level's prior
estimated from the data by the method of moments (the spread of the bad rate
between groups beyond what counting alone explains).  A host is blocked when
the lower posterior bound of its bad rate (mean minus ``z`` posterior standard
deviations) is above ``max_bad``: one bad page never blocks a host, a long
bad record does, and hosts without labels lean on their domain and suffix.

Defined results: a null url or one without ``://`` has an empty host and
path, fits no rule and is judged as the host ``''``; labels with a null
outcome, and labels of pages that are not there, count nowhere; each row of
labels and of pages counts, repeated ones too; empty tables give an empty
result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outagekit.llm.common import LOWER, UPPER, cut, table

HOST_RE = r"(?s)^.*?://([^/?#]*)"
PATH_RE = r"(?s)^.*?://[^/?#]*([^?#]*)"
# The contract's rules (verdict, host/path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
Z, MAX_BAD = 1.645, 0.5
#: Bounds of the intra-group correlation, which keep a prior's strength finite.
RHO = (0.001, 0.999)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, HOST_RE, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH_RE, 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of the host, without user and port."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    return F.regexp_extract(bare, r"([^.]*\.)?[^.]*$", 0)


def suffix_of(domain: Column) -> Column:
    return F.substring_index(domain, ".", -1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; of
    two equally long ones the one with the longer host."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        h, p = rule[:rule.index("/")], rule[rule.index("/"):]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def prior_strength(counts: DataFrame, key: str) -> float:
    """Pseudo-counts of the prior over the groups ``key`` of ``counts`` (n,
    bad), by moments: strength = 1 / rho - 1 with rho the intra-group
    correlation.  One row of sums reaches the driver."""
    g = counts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    k, total, bads, sq, nn = g.agg(F.count(F.lit(1)), F.sum(n), F.sum(bad), F.sum(bad * bad / n), F.sum(n * n)).first()
    if not total or k < 2 or not 0 < bads < total:
        return round(1 / RHO[0] - 1, 6)
    m = bads / total
    spread = sq - total * m * m - (k - 1) * m * (1 - m)
    room = (total - nn / total) * m * (1 - m)
    rho = min(max(spread / room if room > 0 else RHO[0], RHO[0]), RHO[1])
    return round(1 / rho - 1, 6)


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """Posterior per host of ``pages`` (page_id, host): host, mean, bound -
    of the bad rate.  ``outcomes``: page_id, bad (0 or 1)."""
    seen = outcomes.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull())
    per_page = seen.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = (pages.join(per_page, "page_id", "left").groupBy("host")
             .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    hosts = hosts.withColumn("domain", domain_of(F.col("host")))
    hosts = cut(hosts.withColumn("suffix", suffix_of(F.col("domain"))))
    labelled = hosts.where("n > 0")
    k_host, k_domain, k_suffix = (prior_strength(labelled, k) for k in ("host", "domain", "suffix"))
    n, bad = labelled.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    base = (bad + 1) / (n + 2)

    def shrunk(counts: DataFrame, key: str, prior: Column, strength: float, name: str) -> DataFrame:
        mean = (F.col("bad") + F.lit(strength) * prior) / (F.col("n") + F.lit(strength))
        return counts.select("*", mean.alias(name)).drop("n", "bad")

    by = lambda *k: hosts.groupBy(*k).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = shrunk(by("suffix"), "suffix", F.lit(base), k_suffix, "m_suffix")
    domains = shrunk(by("domain", "suffix").join(suffixes, "suffix"), "domain", F.col("m_suffix"), k_domain, "m_domain")
    joined = hosts.join(domains.select("domain", "m_domain"), "domain")
    a = F.col("bad") + F.lit(k_host) * F.col("m_domain")
    ab = F.col("n") + F.lit(k_host)
    mean = a / ab
    sd = F.sqrt(mean * (F.lit(1.0) - mean) / (ab + F.lit(1.0)))
    return joined.select("host", "n", "bad", mean.alias("mean"), (mean - F.lit(z) * sd).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, z: float = Z,
               max_bad: float = MAX_BAD) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path,
    rule, verdict, mean, bound."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rep = host_reputation(p.select("page_id", "host"), outcomes, z)
    hit = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return (p.join(rep, "host").withColumn("hit", hit)
            .select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                    F.coalesce(F.col("hit.verdict"), own).alias("verdict"), "mean", "bound"))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Labelled outcomes of pages: the label of the document of the same
    number; bad is low quality or toxic."""
    return labels.select(F.col("doc_id").alias("page_id"),
                         ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("long").alias("bad"))


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(table(spark, sf_dir, "pages"), page_outcomes(table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")


def _rule_sql() -> tuple[str, str]:
    fits = [(r, v, f"((host = '{r[:r.index('/')]}' OR ends_with(host, '.{r[:r.index('/')]}')) "
                   f"AND starts_with(path, '{r[r.index('/'):]}'))")
            for v, r in sorted(RULES, key=lambda x: -len(x[1]))]
    return tuple("CASE " + " ".join(f"WHEN {c} THEN '{x[i]}'" for *x, c in fits) + " END" for i in (0, 1))


def _strength_sql(key: str) -> str:
    return f"""(SELECT CASE WHEN total IS NULL OR k < 2 OR bads <= 0 OR bads >= total THEN round(1 / {RHO[0]} - 1, 6)
        ELSE round(1 / least(greatest(CASE WHEN room > 0 THEN spread / room ELSE {RHO[0]} END, {RHO[0]}), {RHO[1]}) - 1, 6) END
      FROM (SELECT *, sq - total * m * m - (k - 1) * m * (1 - m) AS spread, (total - nn / total) * m * (1 - m) AS room
        FROM (SELECT *, bads / total AS m FROM (SELECT count(*) AS k, sum(n) AS total, sum(bad) AS bads, sum(bad * bad / n) AS sq,
          sum(n * n) AS nn FROM (SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM hosts WHERE n > 0 GROUP BY {key})))))"""


OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{HOST_RE}', 1), '{UPPER}', '{LOWER}'), '') AS host,
                  coalesce(regexp_extract(url, '{PATH_RE}', 1), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum((quality = 0 OR toxic = 1)::INT) AS bad FROM labels
      WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY host),
h1 AS (SELECT *, regexp_extract(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '([^.]*\\.)?[^.]*$') AS domain FROM h0),
hosts AS MATERIALIZED (SELECT *, split_part(domain, '.', -1) AS suffix FROM h1),
s AS (SELECT suffix, (sum(bad) + {_strength_sql('suffix')} * (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM hosts))
             / (sum(n) + {_strength_sql('suffix')}) AS m FROM hosts GROUP BY suffix),
d AS (SELECT domain, (sum(bad) + {_strength_sql('domain')} * any_value(m)) / (sum(n) + {_strength_sql('domain')}) AS md
      FROM hosts JOIN s USING (suffix) GROUP BY domain),
r AS (SELECT host, n + k AS ab, (bad + k * md) / (n + k) AS mean FROM hosts JOIN d USING (domain), (SELECT {_strength_sql('host')} AS k))
SELECT page_id, host, path, {_rule_sql()[0]} AS rule,
       coalesce({_rule_sql()[1]}, CASE WHEN mean - {Z} * sqrt(mean * (1 - mean) / (ab + 1)) > {MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN r USING (host)
"""

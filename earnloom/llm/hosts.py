"""Operator 7: empirical-Bayes host reputation over page urls.

Fixed rules judge urls first (block net/, allow example.net/en/, block example.com/de/, allow org/fr/; the
longest fitting one wins). Every page is a labelled outcome: 1 where a rule blocks it, else 0. A host's
rate is drawn towards the rate of its registered domain, that towards the rate of its suffix, that
towards the rate of all pages: at each level the children of a node follow a beta-binomial prior

    Beta(k * m, k * (1 - m)),   m the shrunk rate of the parent,

with k from the moments of the children over the whole table (intraclass correlation r, k = 1 / r - 1). A
page without a rule is blocked if its host's lower posterior bound, mean - z * deviation, is above the
limit: a few bad pages of a small host don't suffice.

Counts of a host are combined before the shuffle and come back by a join both sides of which are plain
shuffles, so a host with a third of all pages is split by adaptive execution. What the driver reads is
four numbers: the overall rate and the three strengths. Null urls, and urls without "://", have an empty host and path, judged like any other host; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from earnloom.llm.registry import query
from earnloom.llm.words import read
from earnloom.session import pinned

# Fixed values: (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
# Suffixes of two labels; all others have one.
TWO_LABEL_SUFFIXES = ("co.uk", "com.au", "co.jp", "com.br")
LIMIT = 0.5
Z = 1.645
LEAST_K, MOST_K = 1.0, 1000.0
LEVELS = ("suffix", "domain", "host")


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | F.endswith(host, F.lit("." + rule[0]))) & F.startswith(path, F.lit(rule[1]))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    chosen = F
    for rule in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        made = F.struct(F.lit(rule[0] + rule[1]).alias("rule"), F.lit(rule[2]).alias("verdict"))
        chosen = chosen.when(_fits(host, path, rule), made)
    return chosen


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path`` and the struct ``_rule``."""
    host, path = host_and_path(F.col(url))
    return pages.withColumns({"host": host, "path": path}).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))


def outcomes(judged_pages: DataFrame) -> DataFrame:
    """One row per host: suffix, registered domain, pages and bad pages."""
    two = F.substring_index("host", ".", -2).isin(*TWO_LABEL_SUFFIXES)
    last = {n: F.substring_index("host", ".", -n) for n in (1, 2, 3)}
    return (
        judged_pages.select("host", F.coalesce(F.col("_rule.verdict") == "block", F.lit(False)).cast("long").alias("bad"))
        .withColumns({"suffix": F.when(two, last[2]).otherwise(last[1]), "domain": F.when(two, last[3]).otherwise(last[2])})
        .groupBy("suffix", "domain", "host")
        .agg(F.count(F.lit(1)).alias("pages"), F.sum("bad").alias("bad"))
    )


def _moments(counts: DataFrame, level: str, mean: float) -> DataFrame:
    rate = F.col("bad") / F.col("pages")
    return counts.agg(
        F.lit(level).alias("level"),
        F.count(F.lit(1)).alias("nodes"),
        F.sum("pages").cast("double").alias("n"),
        (F.sum(F.col("pages").cast("double") * F.col("pages"))).alias("n2"),
        F.sum(F.col("pages") * (rate - F.lit(mean)) * (rate - F.lit(mean))).alias("spread"),
    )


def _strength(row, mean: float) -> float:
    """k of the beta prior of a level, from the intraclass correlation of its nodes' rates."""
    noise = mean * (1 - mean)
    if row is None or row["nodes"] < 2 or noise == 0:
        return MOST_K
    free = row["n"] - row["n2"] / row["n"] - (row["nodes"] - 1)
    if free <= 0:
        return LEAST_K
    r = (row["spread"] - noise * (row["nodes"] - 1)) / (noise * free)
    return min(MOST_K, max(LEAST_K, 1 / r - 1)) if r > 0 else MOST_K


def _sum_up(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad"))


def reputations(hosts: DataFrame, z: float = Z) -> DataFrame:
    """One row per host: ``rate`` (posterior mean) and ``bound`` (lower posterior bound) of bad pages."""
    domains, suffixes = _sum_up(hosts, "suffix", "domain"), _sum_up(hosts, "suffix")
    total = hosts.agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad")).first()
    mean = total["bad"] / total["pages"] if total["pages"] else 0.0
    found = _moments(hosts, "host", mean).unionByName(_moments(domains, "domain", mean)).unionByName(_moments(suffixes, "suffix", mean))
    rows = {r["level"]: r for r in found.collect()}
    k = {level: _strength(rows.get(level), mean) for level in LEVELS}

    def drawn(prior: Column, level: str) -> Column:
        return (F.col("bad") + F.lit(k[level]) * prior) / (F.col("pages") + F.lit(k[level]))

    by_suffix = suffixes.select("suffix", drawn(F.lit(mean), "suffix").alias("_suffix_rate"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", "suffix", drawn(F.col("_suffix_rate"), "domain").alias("_domain_rate"))
    a = F.col("bad") + F.lit(k["host"]) * F.col("_domain_rate")
    b = F.col("pages") - F.col("bad") + F.lit(k["host"]) * (F.lit(1.0) - F.col("_domain_rate"))
    return (
        hosts.join(by_domain, ["suffix", "domain"])
        .withColumns({"_a": a, "_b": b})
        .withColumn("_n", F.col("_a") + F.col("_b"))
        .withColumn("rate", F.col("_a") / F.col("_n"))
        .withColumn("bound", F.col("rate") - F.lit(z) * F.sqrt(F.col("rate") * (F.lit(1.0) - F.col("rate")) / (F.col("_n") + 1)))
        .select("host", "pages", "bad", "rate", "bound")
    )


def filtered(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = LIMIT, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and the host's posterior rate and bound."""
    seen = judged(pages, rules, url)
    hosts = reputations(pinned(outcomes(seen)))
    by_method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return (
        seen.join(hosts.select("host", "rate", "bound"), "host", "left")
        .withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce(F.col("_rule.verdict"), by_method)})
        .drop("_rule")
    )


def _sql() -> str:
    fits = [
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h + p}', 'verdict': '{v}'}}"
        for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    ]
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)

    def moments(level: str, name: str) -> str:
        return f"""
{level}_m AS (
  SELECT count(*) AS nodes, sum(pages)::DOUBLE AS n, sum(pages::DOUBLE * pages) AS n2,
         sum(pages * (bad / pages - mean) * (bad / pages - mean)) AS spread, any_value(mean) AS mean
  FROM {name}, overall),
{level}_r AS (
  SELECT CASE WHEN nodes < 2 OR mean * (1 - mean) = 0 THEN NULL
              ELSE n - n2 / n - (nodes - 1) END AS free,
         spread - mean * (1 - mean) * (nodes - 1) AS extra, mean * (1 - mean) AS noise FROM {level}_m),
{level}_k AS (
  SELECT CASE WHEN free IS NULL THEN {MOST_K}::DOUBLE WHEN free <= 0 THEN {LEAST_K}::DOUBLE
              WHEN extra / (noise * free) <= 0 THEN {MOST_K}::DOUBLE
              ELSE least({MOST_K}::DOUBLE, greatest({LEAST_K}::DOUBLE, 1 / (extra / (noise * free)) - 1)) END AS k
  FROM {level}_r)"""

    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {' '.join(fits)} END AS r FROM split),
labelled AS (
  SELECT *, string_split(host, '.') AS labels,
         CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({two}) THEN 2 ELSE 1 END AS deep FROM ruled),
host AS (
  SELECT host, array_to_string(any_value(labels)[-any_value(deep):], '.') AS suffix,
         array_to_string(any_value(labels)[-(any_value(deep) + 1):], '.') AS domain,
         count(*) AS pages, count(*) FILTER (r.verdict = 'block') AS bad FROM labelled GROUP BY host),
dom AS (SELECT suffix, domain, sum(pages)::BIGINT AS pages, sum(bad)::BIGINT AS bad FROM host GROUP BY ALL),
suf AS (SELECT suffix, sum(pages)::BIGINT AS pages, sum(bad)::BIGINT AS bad FROM host GROUP BY ALL),
overall AS (SELECT sum(bad)::DOUBLE / sum(pages) AS mean FROM host),
{moments('host', 'host')}, {moments('domain', 'dom')}, {moments('suffix', 'suf')},
suf_rate AS (SELECT suffix, (bad + k * mean) / (pages + k) AS rate FROM suf, suffix_k, overall),
dom_rate AS (
  SELECT dom.suffix, domain, (bad + k * rate) / (pages + k) AS rate FROM dom JOIN suf_rate USING (suffix), domain_k),
post AS (
  SELECT host, bad + k * rate AS a, pages - bad + k * (1 - rate) AS b FROM host JOIN dom_rate USING (suffix, domain), host_k),
bound AS (
  SELECT host, a / (a + b) - {Z}::DOUBLE * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM post)
SELECT page_id, host, path, r.rule AS rule,
       coalesce(r.verdict, CASE WHEN bound > {LIMIT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN bound USING (host)
"""


@query("op7_host_reputation", _sql())
def host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filtered(pages).select("page_id", "host", "path", "rule", "verdict")

"""URL filtering by host reputation with empirical-Bayes shrinkage, after explicit rules.

Labelled page outcomes (bad or not) are counted per host. Rates are shrunk level by level: a suffix towards the overall
rate, a registered domain towards its suffix, a host towards its domain, each through a beta prior whose strength is
estimated from the spread of that level's counts by the method of moments for the beta-binomial. A host is blocked
where the lower bound of its posterior (mean less ``Z`` standard deviations) reaches ``BLOCK_RATE``.

The suffix is the longest one of a given table that the host, without user, port and a closing dot, ends with, or its last
label; the registered domain is the suffix and one more label. Very long urls are read whole. Null urls and those without ``://`` have an empty host and path and form a host of their own. Outcomes without
a page and null outcomes are ignored; repeated pages and repeated outcomes of an id count each page once, as bad if
any outcome is. Without outcomes nothing is blocked but by rules. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlens.llm.common import columns, written

#: (verdict, host and path) of the explicit rules of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
Z = 1.645
BLOCK_RATE = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = (("suffix", None), ("domain", "suffix"), ("host", "domain"))


def with_host(pages: DataFrame) -> DataFrame:
    rest = F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return pages.select("page_id", host.alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))


def matched_rule(rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does. Rules are a short list and part of the plan."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, path = rule.split("/", 1)
        fits = ((F.col("host") == at) | F.endswith(F.col("host"), F.lit("." + at))) & F.startswith(F.col("path"), F.lit("/" + path))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def with_domain(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Add suffix and registered domain (the suffix and one more label) to hosts.

    ``suffixes`` has a column suffix, such as ``co.uk``; the longest one that a host ends with counts, and the last label
    where none does or no table is given. A host that is a suffix itself is its own domain.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", ""), "[.]$", "")
    last, two = F.regexp_extract(bare, "([^.]*)$", 1), F.regexp_extract(bare, "([^.]*[.]?[^.]*)$", 1)
    if suffixes is None:
        return hosts.select("*", last.alias("suffix"), two.alias("domain"))
    labels = F.split(bare, "[.]")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    names = suffixes.select(F.lower(F.col("suffix")).alias("tail")).where("tail is not null").distinct()
    found = hosts.select("host").distinct().select("host", F.explode(tails).alias("tail")).join(names, "tail")
    found = found.groupBy("host").agg(F.max_by("tail", F.length("tail")).alias("known"))
    rows = hosts.join(found, "host", "left").withColumn("suffix", F.coalesce("known", last))
    ahead = F.element_at(F.split(F.substring(bare, F.lit(1), F.length(bare) - F.length("known") - 1), "[.]"), -1)
    longer = F.length(bare) > F.length("known")
    return rows.withColumn("domain", F.when(F.col("known").isNull(), two).when(longer, F.concat(ahead, F.lit("."), F.col("known")))
                           .otherwise(F.col("known"))).drop("known")


def reputation(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Posterior of each host. hosts: host, n (labelled pages), k (bad ones). Adds mean and bound."""
    hosts = with_domain(hosts.select("host", "n", "k"), suffixes)
    every = hosts.agg(F.sum("n"), F.sum("k")).first()
    top = ((every[1] or 0) + 0.5) / ((every[0] or 0) + 1.0)
    known: DataFrame | None = None
    for level, above in LEVELS:
        if above is None:
            groups = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("mu", F.lit(top))
        elif level == "domain":
            groups = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("k").alias("k"))
            groups = groups.join(known, "suffix")
        else:
            groups = hosts.join(known, "domain")
        part = groups.where("n > 0").select("n", (F.col("k") / F.col("n")).alias("p"), "mu")
        var = F.col("mu") * (1 - F.col("mu"))
        sums = part.agg(F.sum(F.col("n") * (F.col("p") - F.col("mu")) * (F.col("p") - F.col("mu"))), F.sum(var),
                        F.sum(var * (F.col("n") - 1))).first()
        spread = ((sums[0] or 0.0) - (sums[1] or 0.0)) / sums[2] if sums[2] else 0.5
        strength = 1 / min(0.999, max(0.001, spread)) - 1
        a = F.col("k") + strength * F.col("mu")
        b = F.col("n") - F.col("k") + strength * (1 - F.col("mu"))
        groups = groups.withColumn("a", a).withColumn("b", b).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
        known = groups.select(level, F.col("mean").alias("mu"))
    size = F.col("a") + F.col("b")
    sd = F.sqrt(F.col("a") * F.col("b") / (size * size * (size + 1)))
    return groups.select("host", "n", "k", "mean", (F.col("mean") - Z * sd).alias("bound"))


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
                 id_col: str = "page_id", url_col: str = "url", suffixes: DataFrame | None = None) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict. outcomes: page_id, bad (0 or 1); suffixes: see :func:`with_domain`."""
    rows = with_host(columns(pages, page_id=id_col, url=url_col))
    bad = outcomes.where("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    once = rows.where("page_id is not null").groupBy("page_id", "host").agg(F.lit(1).alias("one"))
    counted = once.join(bad, "page_id", "left").groupBy("host").agg(
        F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("k"))
    # one row per host, written: every level's estimate reads it
    found = reputation(written(counted, "hosts"), suffixes).select("host", (F.col("bound") >= BLOCK_RATE).alias("bad_host"))
    rule, verdict = matched_rule(rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("told"))
    # a host with a third of all pages: the join's large side can be split, the other has one row per host
    return rows.join(found, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("told", F.when(F.col("bad_host"), "block").otherwise("allow")).alias("verdict"))


def label_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes of pages from labels of the same id: bad where the quality is 0 or the text toxic."""
    rows = columns(labels, page_id="doc_id", quality="quality", toxic="toxic")
    return rows.select("page_id", F.greatest(F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0),
                                             F.col("toxic")).cast("int").alias("bad"))


def _level(name: str, groups: str) -> str:
    return f"""
{name}_s as (select least(0.999, greatest(0.001, case when coalesce(sum(mu*(1-mu)*(n-1)), 0) = 0 then 0.5 else
  (sum(n*((k::double/n)-mu)*((k::double/n)-mu)) - sum(mu*(1-mu))) / sum(mu*(1-mu)*(n-1)) end)) as r
  from {groups} where n > 0),
{name}_p as (select g.*, k + (1/r-1)*mu as a, n - k + (1/r-1)*(1-mu) as b from {groups} g, {name}_s)"""


SQL = f"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
x as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
o as (select doc_id as page_id, max(greatest(1 - quality, toxic)) as bad from labels group by 1),
h as (select host, count(bad) as n, coalesce(sum(bad), 0) as k,
  regexp_extract(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]$', ''), '([^.]*)$', 1) as suffix,
  regexp_extract(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]$', ''), '([^.]*[.]?[^.]*)$', 1) as domain
  from x left join o using (page_id) group by host),
t as (select (sum(k) + 0.5::double) / (sum(n) + 1) as top from h),
s0 as (select suffix, sum(n) as n, sum(k) as k, any_value(top) as mu from h, t group by suffix),
{_level('s', 's0')},
d0 as (select domain, sum(h.n) as n, sum(h.k) as k, any_value(a / (a + b)) as mu from h join s_p using (suffix) group by domain),
{_level('d', 'd0')},
h0 as (select h.host, h.n, h.k, a / (a + b) as mu from h join d_p using (domain)),
{_level('h', 'h0')},
bad as (select host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= {BLOCK_RATE} as bad_host from h_p),
m as (select *, """ + "case " + " ".join(
    f"when (host = '{r.split('/', 1)[0]}' or ends_with(host, '.{r.split('/', 1)[0]}')) and starts_with(path, '/{r.split('/', 1)[1]}') then '{r}'"
    for _, r in sorted(RULES, key=lambda r: (-len(r[1]), r[1]))) + """ end as rule from x)
select page_id, host, path, rule, coalesce(case rule """ + " ".join(f"when '{r}' then '{k}'" for k, r in RULES) + """ end,
  case when bad_host then 'block' else 'allow' end) as verdict from m join bad using (host)
"""

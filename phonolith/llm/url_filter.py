"""Operator 6: URL filter by host rules and empirical-Bayes host reputation.

Labelled page outcomes (1 good, 0 bad) are counted by host. Their rates are
shrunk level by level, each level's beta prior being centred on the level above:
all pages -> public suffix -> registered domain (one label more) -> host. Names
are taken without user info and port; an address (four numbers, or one in
brackets) is a suffix by itself; a suffix is the last label, or the last two if
they are one of ``suffixes``.
A level's prior strength comes from its groups by the method of moments: with
rho the share of variance between groups, the prior counts as 1/rho - 1 pages.
A page is blocked if even the upper bound of its host's posterior good rate is
below ``floor``; a fixed rule for the host and path, if one fits, decides instead
(the longest one; of equally long ones the first). The bound is the mean plus z
standard deviations of the beta posterior; against the posterior's 95 % quantile
this is within 0.03 from 20 pages (labels and prior together) on.

Only counts by host are joined, never pages with each other; a host with a
third of all pages is one skewed key of an equi-join, which Spark splits.

Defined results: a null url or one without ``://`` has empty host and path and
is judged like any host; a very long url is like any other; a host without labels gets its domain's, suffix's or
the overall rate; null outcomes and outcomes without a page are ignored; each
outcome of a page counts; repeated pages each get their row; without any
outcome everything not blocked by a rule is allowed; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm.common import LOWER, UPPER, checked, lower_ascii, mark, release, staged, table

#: Fixed values: (rule, verdict); a rule is a host and the beginning of a path.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Public suffixes of two labels (the common ones; a parameter of the operator).
SUFFIXES = ("ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "edu.au", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")


@dataclass(frozen=True)
class Bound:
    z: float = 1.64
    floor: float = 0.5
    #: Limits of rho, the share of variance between a level's groups.
    least_rho: float = 0.001
    most_rho: float = 0.9


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(known, "://") > 0, F.regexp_extract(known, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def matched_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), both null if none does; of equally long ones the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in rules:
        own, _, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{rest}"))
        better = fits & (rule.isNull() | (F.length(rule) < len(text)))
        rule, verdict = F.when(better, F.lit(text)).otherwise(rule), F.when(better, F.lit(says)).otherwise(verdict)
    return rule, verdict


def name_of(host: Column) -> Column:
    """The host without user info, port and the root's dot."""
    bare = F.regexp_replace(host, r"(?s)^.*@", "")
    return F.rtrim(F.regexp_replace(bare, r":[0-9]*$", ""), F.lit("."))


def _is_address(name: Column) -> Column:
    return name.rlike(r"^([0-9.]+|\[.*)$")


def suffix_of(name: Column, suffixes=SUFFIXES) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), name).when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column, suffixes=SUFFIXES) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), name).when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def _strength(groups: DataFrame, bound: Bound) -> float:
    """groups (n, k, p) -> how many pages the prior of these groups counts as."""
    spread = F.col("p") * (1 - F.col("p"))
    within, between = F.sum(spread), F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("p"), F.lit(2)))
    more = F.sum(spread * (F.col("n") - 1))
    rho = groups.where("n > 0").agg(F.try_divide(between - within, more)).first()[0]
    return 1 / max(bound.least_rho, min(bound.most_rho, bound.least_rho if rho is None else rho)) - 1


def _shrunk(groups: DataFrame, bound: Bound, name: str) -> DataFrame:
    """groups with n, k and p (the prior mean), written out: adds m, and q, the posterior mean."""
    groups = staged(groups, name)
    strength = F.lit(_strength(groups, bound))
    return groups.withColumn("m", strength).withColumn("q", (F.col("k") + F.col("m") * F.col("p")) / (F.col("n") + F.col("m")))


def reputation(names: DataFrame, bound: Bound = Bound(), suffixes=SUFFIXES) -> DataFrame:
    """names (name, n, k: labelled and good pages; 0 without labels) -> (name, n, mean, upper)."""
    own = names.select("name", domain_of(F.col("name"), suffixes).alias("domain"), suffix_of(F.col("name"), suffixes).alias("suffix"), "n", "k")
    domains = staged(own.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    overall = domains.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("p")).first()["p"]
    suffixes_ = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("p", F.lit(overall).cast("double"))
    above = _shrunk(suffixes_, bound, "suffixes").select("suffix", F.col("q").alias("p"))
    above = _shrunk(domains.join(above, "suffix"), bound, "domain-rates").select("domain", F.col("q").alias("p"))
    found = _shrunk(own.drop("suffix").join(above, "domain"), bound, "host-rates")
    release(domains)
    spread = F.sqrt(F.col("q") * (1 - F.col("q")) / (F.col("n") + F.col("m") + 1))
    return found.select("name", "n", F.col("q").alias("mean"), (F.col("q") + F.lit(bound.z) * spread).alias("upper"))


def judged(pages: DataFrame, outcomes: DataFrame, *, rules=RULES, bound: Bound = Bound(), suffixes=SUFFIXES, page_id: str = "page_id", url_col: str = "url", outcome_id: str = "page_id", outcome_col: str = "good") -> DataFrame:
    """All rows and columns of pages, and host, path, rule, verdict, n, mean, upper under marked names."""
    host, path = host_and_path(F.col(url_col))
    own = checked(pages).withColumn(mark("host"), host).withColumn(mark("path"), path).withColumn(mark("name"), name_of(F.col(mark("host"))))
    labels = outcomes.where(F.col(outcome_col).isNotNull()).select(F.col(outcome_id).alias("labelled"), (F.col(outcome_col) > 0).cast("long").alias("good"))
    seen = own.select(F.col(page_id).alias("id"), F.col(mark("name")).alias("name"))
    counts = seen.join(labels, F.col("id") == F.col("labelled"), "left").groupBy("name").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    known = reputation(staged(counts, "hosts"), bound, suffixes)
    known = known.select(F.col("name").alias(mark("own")), *[F.col(c).alias(mark(c)) for c in ("n", "mean", "upper")])
    rule, says = matched_rule(F.col(mark("host")), F.col(mark("path")), rules)
    learnt = F.when(F.col(mark("upper")) < bound.floor, "block").otherwise("allow")
    joined = own.join(known, F.col(mark("name")) == F.col(mark("own")), "left")
    return joined.withColumn(mark("rule"), rule).withColumn(mark("verdict"), F.coalesce(says, learnt)).drop(mark("name"), mark("own"))


def keep_allowed(pages: DataFrame, outcomes: DataFrame, **options) -> DataFrame:
    """The pages whose verdict is allow, all columns as they were."""
    return judged(pages, outcomes, **options).where(F.col(mark("verdict")) == "allow").select(*pages.columns)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the quality label with its number."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    found = judged(pages, outcomes)
    return found.select("page_id", *[F.col(mark(c)).alias(c) for c in ("host", "path", "rule", "verdict", "n")], *[F.round(mark(c), 6).alias(c) for c in ("mean", "upper")])


QUERIES = {"op6_url_filters": op6_url_filters}


def _sql() -> str:
    b = Bound()
    fits = lambda rule: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*rule.split("/", 1))
    ordered = sorted(RULES, key=lambda r: -len(r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ordered) + " END"
    says = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in ordered) + " END"
    known = ", ".join(f"'{x}'" for x in SUFFIXES)
    last = lambda n: f"array_to_string(string_split(name, '.')[-{n}:], '.')"
    part = lambda one, two: f"CASE WHEN regexp_matches(name, '^([0-9.]+|\\[.*)$') THEN name WHEN {last(2)} IN ({known}) THEN {last(two)} ELSE {last(one)} END"
    m = lambda t: f"""(SELECT 1e0 / greatest({b.least_rho}e0, least({b.most_rho}e0, coalesce((sum(n * pow(k / n - p, 2)) - sum(p * (1 - p))) / nullif(sum(p * (1 - p) * (n - 1)), 0), {b.least_rho}e0))) - 1 AS m FROM {t} WHERE n > 0)"""
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), o AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), w AS (SELECT *, rtrim(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '.') AS name FROM o
), h AS (
  SELECT name, CAST(count(quality) AS DOUBLE) AS n, CAST(coalesce(sum(CASE WHEN quality > 0 THEN 1 WHEN quality <= 0 THEN 0 END), 0) AS DOUBLE) AS k
  FROM w LEFT JOIN labels ON page_id = doc_id GROUP BY name
), hh AS (SELECT name, n, k, {part(2, 3)} AS domain, {part(1, 2)} AS suffix FROM h
), d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hh GROUP BY ALL
), s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM d) AS p FROM d GROUP BY suffix
), s AS (SELECT suffix, (k + m * p) / (n + m) AS q FROM s0, {m('s0')}
), d0 AS (SELECT domain, n, k, q AS p FROM d JOIN s USING (suffix)
), d1 AS (SELECT domain, (k + m * p) / (n + m) AS q FROM d0, {m('d0')}
), h0 AS (SELECT name, n, k, q AS p FROM hh JOIN d1 USING (domain)
), h1 AS (SELECT name, n, m, (k + m * p) / (n + m) AS q FROM h0, {m('h0')}
), j AS (
  SELECT page_id, host, path, {rule} AS rule, CAST(n AS BIGINT) AS n, q AS mean, q + {b.z}e0 * sqrt(q * (1 - q) / (n + m + 1)) AS upper FROM w JOIN h1 USING (name)
)
SELECT page_id, host, path, rule, coalesce({says}, CASE WHEN upper < {b.floor}e0 THEN 'block' ELSE 'allow' END) AS verdict, n, round(mean, 6) AS mean, round(upper, 6) AS upper FROM j
"""


ORACLE = {"op6_url_filters": _sql()}

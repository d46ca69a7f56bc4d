"""URL filter by empirical-Bayes host reputation, in DataFrame functions.

Labelled page outcomes are counted per host, registered domain and suffix. A beta-binomial prior, whose
strength is estimated from the spread of the children around their parent, shrinks the rate of good pages
from the whole down to the suffix, the registered domain and the host. A host is blocked when the lower
bound of its posterior lies under a limit. Listed rules come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from longitrack.session import materialise

# Fixed rules of the query: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Suffixes of more than one label; a parameter.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
# The bound lies this many standard deviations under the mean; below the limit a host is blocked.
DEVIATIONS = 1.645
LEAST_GOOD = 0.5
# Limits of the estimated correlation inside a group; the prior counts as (1 - r) / r pages.
LEAST_CORRELATION = 0.001
MOST_CORRELATION = 0.5
LEVELS = ("suffix", "domain", "host")


def host_column(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_column(host: Column) -> Column:
    """The last label, or the last two if they are a known long suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_column(host: Column) -> Column:
    """The suffix and one label more, or the host if it has none."""
    return F.when(F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(
        F.substring_index(host, ".", -2))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or a parent of it and the beginning of the path, else null."""
    found = F.lit(None).cast("string")
    for domain, prefix, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        found = F.when(fits, F.lit(domain + prefix)).otherwise(found)
    return found


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, mean, bound) from ``outcomes`` (host, domain, suffix, good): posterior mean and lower bound.

    Rows with a null outcome have no say, but their hosts are rated; counting combines before the shuffle,
    so one host may hold most pages.
    """
    good = F.when(F.col("good").isNotNull(), F.col("good").cast("long"))
    hosts = materialise(outcomes.groupBy(*LEVELS).agg(F.count(good).alias("n"), F.coalesce(F.sum(good), F.lit(0)).alias("k")))
    total = hosts.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("mean"))
    mean = total.first()["mean"]
    parents, columns = None, []
    for level in LEVELS:
        columns.append(level)
        own = hosts.groupBy(*columns).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        own = own.withColumn("prior", F.lit(0.5 if mean is None else mean)) if parents is None else own.join(
            parents.select(*columns[:-1], F.col("mean").alias("prior")), columns[:-1])
        own = materialise(own)
        n, k, p = F.col("n"), F.col("k"), F.col("prior")
        # Var(k) = n p (1 - p) (1 + (n - 1) r), summed over the children.
        spread = own.agg(
            F.sum((k - n * p) * (k - n * p)).alias("square"), F.sum(n * p * (1 - p)).alias("single"), F.sum(n * (n - 1) * p * (1 - p)).alias("double")).first()
        r = (spread["square"] - spread["single"]) / spread["double"] if spread["double"] else MOST_CORRELATION
        r = min(MOST_CORRELATION, max(LEAST_CORRELATION, r))
        strength = (1 - r) / r
        a, b = p * strength + k, (1 - p) * strength + n - k
        parents = own.select(*columns, (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("deviation"))
    return parents.select("host", F.col("mean"), (F.col("mean") - DEVIATIONS * F.col("deviation")).alias("bound"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``pages`` with ``good``: whether the document that the page shows is labelled good and not toxic.

    The number in /<language>/<number> of a path is the document's id. Pages without a label get null.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(
        ((F.max("quality") > 0) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).cast("int").alias("good"))
    doc = F.regexp_extract("path", r"^/[a-z]{2}/([0-9]{1,18})(?:[/.].*)?$", 1)
    numbered = pages.withColumn("_doc", F.when(doc != "", doc).cast("long"))
    return numbered.join(known, "_doc", "left").drop("_doc")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's posterior mean and bound, per row of ``pages``.

    A null url, or one without ://, has an empty host, which is rated like any other host.
    """
    split = pages.select("page_id", host_column(F.col("url")).alias("host"), path_column(F.col("url")).alias("path"))
    split = split.withColumn("domain", domain_column(F.col("host"))).withColumn("suffix", suffix_column(F.col("host")))
    rated = reputations(page_outcomes(split, labels))
    verdict = F.when(F.col("bound") >= LEAST_GOOD, "allow").otherwise("block")
    for domain, prefix, decision in rules:
        verdict = F.when(F.col("rule") == domain + prefix, decision).otherwise(verdict)
    found = split.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules)).join(rated, "host", "left")
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("mean", 6).alias("host_mean"), F.round("bound", 6).alias("host_bound"))


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _level_sql(level: str, columns: list[str], above: str | None) -> str:
    keys = ", ".join(columns)
    prior = "(SELECT mean FROM whole)" if above is None else "any_value(u.mean)"
    source = "hosts h" if above is None else f"hosts h JOIN {above}_post u USING ({', '.join(columns[:-1])})"
    return f"""
{level}_own AS MATERIALIZED (SELECT {keys}, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, {prior} AS p FROM {source} GROUP BY {keys}),
{level}_r AS MATERIALIZED (SELECT CASE WHEN coalesce(d, 0) = 0 THEN {MOST_CORRELATION} ELSE least({MOST_CORRELATION}, greatest({LEAST_CORRELATION}, (s - v) / d)) END AS r FROM (
  SELECT sum((k - n * p) * (k - n * p)) AS s, sum(n * p * (1 - p)) AS v, sum(n * (n - 1) * p * (1 - p)) AS d FROM {level}_own)),
{level}_ab AS (SELECT {keys}, p * (1 - r) / r + k AS a, (1 - p) * (1 - r) / r + n - k AS b FROM {level}_own, {level}_r),
{level}_post AS MATERIALIZED (SELECT {keys}, a / (a + b) AS mean, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS deviation FROM {level}_ab),"""


OP1_SQL = r"""
WITH split AS MATERIALIZED (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
known AS (SELECT doc_id, CASE WHEN max(quality) > 0 AND coalesce(max(toxic), 0) = 0 THEN 1 ELSE 0 END AS good FROM labels GROUP BY doc_id),
parts AS (SELECT *, regexp_extract(host, '[^.]*$') AS suffix, regexp_extract(host, '(?:[^.]*\.)?[^.]*$') AS domain,
  try_cast(regexp_extract(path, '^/[a-z]{2}/([0-9]{1,18})(?:[/.].*)?$', 1) AS BIGINT) AS doc_id FROM split),
hosts AS MATERIALIZED (SELECT suffix, domain, host, count(good) AS n, coalesce(sum(good), 0) AS k FROM parts LEFT JOIN known USING (doc_id) GROUP BY 1, 2, 3),
whole AS MATERIALIZED (SELECT (sum(k) + 1)::DOUBLE / (sum(n) + 2) AS mean FROM hosts),""" + _level_sql("suffix", ["suffix"], None) + _level_sql(
    "domain", ["suffix", "domain"], "suffix") + _level_sql("host", ["suffix", "domain", "host"], "domain") + f"""
ruled AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM split)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
  ELSE CASE WHEN mean - {DEVIATIONS} * deviation >= {LEAST_GOOD} THEN 'allow' ELSE 'block' END END AS verdict,
  round(mean, 6) AS host_mean, round(mean - {DEVIATIONS} * deviation, 6) AS host_bound
FROM ruled JOIN host_post USING (host)
"""

"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix. Each
level's rates are shrunk towards the level above by a beta prior whose strength is fitted by
moments from how much the rates of that level differ. A url is blocked if the lower bound of its
host's posterior is over a limit; a host without outcomes has its domain's, else its suffix's, else the
overall rate. Listed rules come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm.common import keep, table

# Fixed values of the contract: (action, host, path start).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Blocked if the bad share is over LIMIT with about 97.5 percent of the posterior.
LIMIT, DEVIATIONS = 0.5, 1.96
# Suffixes of more than one label that are known without a table of them.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
# A host that is an address, not a name.
_ADDRESS = r"\A([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*)\z"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls."""
    name = action = None
    for act, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    return name, action


def domain_and_suffix(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` (one row per host) with the registered domain, one label more than the suffix, and the suffix.

    ``suffixes`` has a column ``suffix`` of names of several labels, such as a list of public suffixes;
    without it LONG_SUFFIXES count. The longest that ends a host is its suffix, else its last label. User
    names and ports are no part of a domain; an address is a domain of its own with an empty suffix.
    """
    if suffixes is None:
        suffixes = hosts.sparkSession.createDataFrame([(s,) for s in LONG_SUFFIXES], "suffix string")
    name = F.regexp_replace(F.substring_index("host", "@", -1), r":[0-9]*\z", "")
    named = hosts.withColumn("name", name).withColumn("labels", F.split("name", r"\."))
    tail = lambda n: F.array_join(F.slice("labels", F.size("labels") - n + 1, n), ".")
    tails = named.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.struct(n.alias("n"), tail(n).alias("tail")))).alias("t"))
    listed = suffixes.select(F.lower("suffix").alias("tail")).distinct()
    known = tails.select("host", "t.n", "t.tail").filter("n > 1").join(listed, "tail").groupBy("host").agg(F.max("n").alias("n"))
    n = F.coalesce("n", F.lit(1))
    address = F.col("name").rlike(_ADDRESS)
    domain = F.when(address, F.col("name")).otherwise(tail(F.least(n + 1, F.size("labels"))))
    suffix = F.when(address, F.lit("")).otherwise(tail(n))
    return named.join(known, "host", "left").withColumns({"domain": domain, "suffix": suffix}).drop("name", "labels", "n")


def _strength(groups: DataFrame, parent_rate: str) -> float:
    """Prior observations at one level: with n outcomes, k bad and parent rate m, the spread of
    k/n about m is m(1-m)(1/n + (1-1/n)/(s+1)); solved for s over all groups, at least 1."""
    m, n, k = F.col(parent_rate), F.col("n"), F.col("k")
    base = m * (1 - m)
    row = groups.filter("n > 0").agg(
        F.sum(n * F.pow(k / n - m, 2)).alias("seen"), F.sum(base).alias("chance"), F.sum(base * (n - 1)).alias("more")
    ).first()
    if not row["more"]:
        return 1.0
    share = (row["seen"] - row["chance"]) / row["more"]
    if share <= 1e-6:
        return 1e6
    return max(1.0, 1 / min(share, 1.0) - 1)


def reputations(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, bad 0/1 or null) -> host, n, bad, mean, low: posterior mean and lower bound of each host.

    Null is a page without outcome. A host of such pages alone has the mean of the next level with outcomes
    and the spread of all levels below that.

    Three figures and three strengths pass through the driver. Hosts, domains and suffixes are
    summed before they are shuffled, so a host with a third of all pages is one row per task.
    """
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("outcomes"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = keep(domain_and_suffix(counts, suffixes).withColumnRenamed("outcomes", "n"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = ((total["k"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)

    def shrunk(groups: DataFrame, parent: str, to: str) -> tuple[DataFrame, float]:
        """Means of a level; ``open`` grows by the level's spread where it has no outcomes, else is 0."""
        s = _strength(groups, parent)
        wider = F.when(F.col("n") > 0, 0.0).otherwise(1 - (1 - F.col("open")) * (1 - 1 / (s + 1)))
        return groups.withColumns({to: (F.col("k") + s * F.col(parent)) / (F.col("n") + s), "open": wider}), s

    level, _ = shrunk(suffixes.withColumns({"m0": F.lit(overall), "open": F.lit(0.0)}), "m0", "m1")
    level, _ = shrunk(domains.join(level.select("suffix", "m1", "open"), "suffix"), "m1", "m2")
    level, s = shrunk(hosts.join(level.select("domain", "suffix", "m2", "open"), ["domain", "suffix"]), "m2", "mean")
    share = F.when(F.col("n") > 0, 1 / (F.col("n") + s + 1)).otherwise(F.col("open"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) * share)
    return level.select("host", "n", F.col("k").alias("bad"), "mean", (F.col("mean") - DEVIATIONS * sd).alias("low"))


def judge(pages: DataFrame, labels: DataFrame, page_id="page_id", url="url", label_id="doc_id", limit: float = LIMIT, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation (posterior mean; null without a host).

    A page is bad if a label row of its id says toxic = 1 or quality = 0; several rows count as
    one, bad if any is; null labels count as good, null ids match nothing. A url of a host without
    outcomes is judged by its domain, suffix or all; null urls and urls without ``://``, whose host and
    path are empty, are allowed. Repeated pages each have a row. Other columns are ignored. ``suffixes``:
    see ``domain_and_suffix``.
    """
    host, path = host_and_path(F.col("url"))
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    p = p.select("page_id", host.alias("host"), path.alias("path"))
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    known = labels.groupBy(F.col(label_id).alias("page_id")).agg(F.max(bad).alias("bad"))
    scored = reputations(p.filter("host <> ''").join(known, "page_id", "left").select("host", "bad"), suffixes)
    name, action = rule_of(F.col("host"), F.col("path"))
    own = F.when(F.col("low") > limit, "block").otherwise("allow")
    return p.join(scored.select("host", "mean", "low"), "host", "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(action, own).alias("verdict"), F.col("mean").alias("reputation")
    )


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).drop("reputation")


OP10_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), known AS (
  SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), h AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, regexp_replace(string_split(host, '@')[-1], ':[0-9]*\z', '') AS name
  FROM p LEFT JOIN known USING (page_id) WHERE host <> '' GROUP BY host
), hosts AS (
  SELECT host, n, k, two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br') AS long, regexp_matches(name, '\A([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*)\z') AS address,
    CASE WHEN address THEN name WHEN long THEN array_to_string(part[-3:], '.') ELSE two END AS domain,
    CASE WHEN address THEN '' WHEN long THEN two ELSE part[-1] END AS suffix
  FROM (SELECT *, array_to_string(part[-2:], '.') AS two FROM (SELECT *, string_split(name, '.') AS part FROM h))
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
m0 AS (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS m FROM suffixes),
f1 AS (
  SELECT sum(n * (k / n - m) ** 2) AS seen, sum(m * (1 - m)) AS chance, sum(m * (1 - m) * (n - 1)) AS more FROM suffixes, m0 WHERE n > 0
), s1 AS (
  SELECT CASE WHEN more IS NULL OR more = 0 THEN 1 WHEN (seen - chance) / more <= 1e-6 THEN 1e6
    ELSE greatest(1, 1 / least((seen - chance) / more, 1) - 1) END AS s FROM f1
), l1 AS (
  SELECT suffix, (k + s * m) / (n + s) AS m, CASE WHEN n > 0 THEN 0 ELSE 1 / (s + 1) END AS open FROM suffixes, s1, m0
),
d AS (SELECT domains.*, m, open FROM domains JOIN l1 USING (suffix)),
f2 AS (SELECT sum(n * (k / n - m) ** 2) AS seen, sum(m * (1 - m)) AS chance, sum(m * (1 - m) * (n - 1)) AS more FROM d WHERE n > 0),
s2 AS (
  SELECT CASE WHEN more IS NULL OR more = 0 THEN 1 WHEN (seen - chance) / more <= 1e-6 THEN 1e6
    ELSE greatest(1, 1 / least((seen - chance) / more, 1) - 1) END AS s FROM f2
), l2 AS (
  SELECT domain, suffix, (k + s * m) / (n + s) AS m, CASE WHEN n > 0 THEN 0 ELSE 1 - (1 - open) * (1 - 1 / (s + 1)) END AS open FROM d, s2
),
e AS (SELECT hosts.*, m, open FROM hosts JOIN l2 USING (domain, suffix)),
f3 AS (SELECT sum(n * (k / n - m) ** 2) AS seen, sum(m * (1 - m)) AS chance, sum(m * (1 - m) * (n - 1)) AS more FROM e WHERE n > 0),
s3 AS (
  SELECT CASE WHEN more IS NULL OR more = 0 THEN 1 WHEN (seen - chance) / more <= 1e-6 THEN 1e6
    ELSE greatest(1, 1 / least((seen - chance) / more, 1) - 1) END AS s FROM f3
), scored AS (
  SELECT host, (k + s * m) / (n + s) AS mean,
    mean - 1.96 * sqrt(mean * (1 - mean) * CASE WHEN n > 0 THEN 1 / (n + s + 1) ELSE 1 - (1 - open) * (1 - 1 / (s + 1)) END) AS low FROM e, s3
), judged AS (
  SELECT page_id, p.host, path, low,
    CASE WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p LEFT JOIN scored ON p.host = scored.host
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

"""URL rules and empirical-Bayes host reputation.

A page is first judged by explicit rules. Where none fits, the reputation of
its host decides: labelled outcomes (a bad page or a good one) are counted by
host, registered domain and suffix, and each level's posterior mean is the
prior mean of the level below it, with a beta-binomial strength estimated from
the spread between that level's groups. A host is blocked when the lower bound
of its posterior bad rate is above the threshold.

Only counts are aggregated (map-side combined, so a hot host is no burden);
the host table is joined back by sort-merge, which adaptive execution splits
for a hot host. Nothing is broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratalith.llm.keys import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): host, then path prefix.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Suffixes of two labels; any other suffix is the last label.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the first in text order) and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*DOUBLE_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*DOUBLE_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(groups: DataFrame, rate: float) -> float:
    """Beta-binomial prior strength by moments: 1/rho - 1, rho the intra-group correlation, kept in [0.001, 0.5]."""
    g = groups.where("n > 0").agg(
        F.count("*").alias("g"), F.sum("n").alias("w"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(F.col("n") * (F.col("b") / F.col("n") - rate) * (F.col("b") / F.col("n") - rate)).alias("s")
    ).first()
    if not g.g or g.g < 2:
        return 999.0
    room = g.w - g.q / g.w - (g.g - 1)
    rho = (g.s / (rate * (1 - rate)) - (g.g - 1)) / room if room > 0 else 0.5
    return 1 / min(max(rho, 0.001), 0.5) - 1


def reputation(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior bad rate of each host.

    hosts: host, n (labelled pages), b (bad ones), a row for each host, n may be 0.
    Returns host, n_labelled, n_bad, rate, lower.
    """
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    all_ = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    rate = (all_.b + 0.5) / (all_.n + 1.0)
    ks, kd, kh = (_strength(t, rate) for t in (suffixes, domains, hosts))
    mean = lambda prior, k: (prior * k + F.col("b")) / (k + F.col("n"))
    s = suffixes.select("suffix", mean(F.lit(rate), ks).alias("ms"))
    d = domains.join(s, "suffix").select("domain", mean(F.col("ms"), kd).alias("md"))
    m = mean(F.col("md"), kh)
    sd = F.sqrt(m * (1 - m) / (kh + F.col("n") + 1))
    return hosts.join(d, "domain").select("host", F.col("n").alias("n_labelled"), F.col("b").alias("n_bad"), m.alias("rate"), (m - z * sd).alias("lower"))


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", rules=RULES, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """Judge every page's url.

    labels holds id, quality and toxic; a row is bad if toxic is 1 or quality
    is 0, good if it isn't bad and either is given, else no outcome.

    Returns page_id, host, path, rule (null where none fits), verdict (allow or
    block), rate and lower (the host's posterior bad rate and its lower bound).

    A null url, or one without "://", has an empty host and path; all such
    pages share the reputation of the empty host. Null ids match no label and
    come back null. Repeated label rows each count. Other columns are ignored.
    Empty tables give an empty result; with no labels all hosts have the same
    prior rate, and a lower bound under the threshold.
    """
    url = F.col(f"`{url_col}`").cast("string")
    p = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    l = labels.where("toxic is not null or quality is not null").select(F.col(f"`{label_id}`").cast("long").alias("page_id"), bad.cast("long").alias("bad"))
    l = l.groupBy("page_id").agg(F.count("*").alias("ln"), F.sum("bad").alias("lb"))
    hosts = p.select("page_id", "host").join(l, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("ln"), F.lit(0)).alias("n"), F.coalesce(F.sum("lb"), F.lit(0)).alias("b"))
    known = p.join(reputation(hosts, z).select("host", "rate", "lower"), "host")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return known.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("lower") > threshold, "block").otherwise("allow")).alias("verdict"), F.round("rate", 6).alias("rate"), F.round("lower", 6).alias("lower"))


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _strength_sql(name: str) -> str:
    return f"""k_{name} AS (SELECT CASE WHEN g < 2 THEN 999.0 ELSE 1.0 / least(greatest(CASE WHEN w - q / w - (g - 1) > 0
      THEN (s / (m * (1 - m)) - (g - 1)) / (w - q / w - (g - 1)) ELSE 0.5 END, 0.001), 0.5) - 1 END AS k FROM (
      SELECT count(*)::DOUBLE AS g, sum(n)::DOUBLE AS w, sum(n * n)::DOUBLE AS q, sum(n * (b / n::DOUBLE - m) * (b / n::DOUBLE - m)) AS s, max(m) AS m FROM {name}, root WHERE n > 0))"""


def _host_part(kind: str) -> str:
    two = r"regexp_extract(host, '([^.]*\.)?[^.]*$', 0)"
    three = r"regexp_extract(host, '([^.]*\.)?([^.]*\.)?[^.]*$', 0)"
    doubles = ", ".join(f"'{x}'" for x in DOUBLE_SUFFIXES)
    yes, no = (two, r"regexp_extract(host, '[^.]*$', 0)") if kind == "suffix" else (three, two)
    return f"CASE WHEN {two} IN ({doubles}) THEN {yes} ELSE {no} END"


#: The rules are written out here a second time, on purpose: from the contract, not from RULES.
SQL = rf"""
WITH rules(verdict, host_part, path_part) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id AS page_id, count(*) AS ln, sum(CASE WHEN coalesce(toxic = 1, false) OR coalesce(quality = 0, false) THEN 1 ELSE 0 END) AS lb
    FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, coalesce(sum(ln), 0)::BIGINT AS n, coalesce(sum(lb), 0)::BIGINT AS b FROM p LEFT JOIN l USING (page_id) GROUP BY host),
hosts AS (SELECT *, {_host_part('domain')} AS domain, {_host_part('suffix')} AS suffix FROM h0),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(b)::BIGINT AS b FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(b)::BIGINT AS b FROM domains GROUP BY ALL),
root AS (SELECT (coalesce(sum(b), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0)::DOUBLE AS m FROM suffixes),
{_strength_sql('suffixes')}, {_strength_sql('domains')}, {_strength_sql('hosts')},
s AS (SELECT suffix, (m * k + b) / (k + n) AS ms FROM suffixes, root, k_suffixes),
d AS (SELECT domain, (ms * k + b) / (k + n) AS md FROM domains JOIN s USING (suffix), k_domains),
r AS (SELECT host, (md * k + b) / (k + n) AS rate, k, n FROM hosts JOIN d USING (domain), k_hosts),
f AS (SELECT host, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (k + n + 1)) AS lower_ FROM r),
j AS (SELECT host, path, max_by(host_part || path_part, length(host_part || path_part)) AS "rule", max_by(rules.verdict, length(host_part || path_part)) AS decided
    FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON ends_with('.' || host, '.' || host_part) AND starts_with(path, path_part) GROUP BY 1, 2)
SELECT page_id, p.host, p.path, "rule", coalesce(decided, CASE WHEN lower_ > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
    round(rate, 6) AS rate, round(lower_, 6) AS lower FROM p JOIN f ON p.host = f.host LEFT JOIN j ON p.host = j.host AND p.path = j.path
"""

"""Page filter by host reputation: an empirical-Bayes chain of beta-binomial models.

Labelled pages (bad or not) are counted by host, registered domain and suffix. Each level shrinks its counts towards the level
above: a suffix towards all pages, a domain towards its suffix, a host towards its domain. How hard a level shrinks is learned from
the counts by moments: the spread of its groups around their prior means, beyond what binomial chance gives, is the share ``rho`` of
a beta-binomial, and 1 / rho - 1 pages is the weight of the prior. A host is blocked when the lower bound of its posterior bad share
(``z`` standard deviations below the mean) is above ``limit``: few bad pages block a host only if its neighbours are bad too.
Rules (host, path, verdict) come first; the longest that fits wins.

Counts are sums with map-side combine. A host, domain or suffix may hold any share of the rows: keys with more than a thousandth of
them, so fewer than 1,000, are broadcast; the others are joined. The only collected values are totals.

Defined results: a null url, or one without ``://``, has an empty host and path; all such pages count as one host. A host keeps
its port and user part in the column, not for its domain. A null html gives no outcome. Without any labelled page nothing is blocked.
Repeated page ids are judged row by row; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .joins import spread_join

#: Bad share above which a host is blocked, and the standard deviations below the posterior mean at which that is read.
LIMIT, Z = 0.05, 1.64
#: Bounds of rho: a prior weighs between 1 and 999 pages.
RHO = (0.001, 0.5)
#: A page is bad when its runs of three junk symbols are more than a twentieth of its blanks.
JUNK, JUNK_SHARE = ("###", "***", "%%%", "$$$"), 20
#: Public suffixes of two labels; every other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "com.br", "co.in", "co.kr", "com.cn", "com.mx", "co.za")
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; an address of numbers, or a single label, is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    double = two.isin(*SUFFIXES)
    number = name.rlike(r"^[0-9.]+$|^\[")
    suffix = F.when(number, name).when(double, two).otherwise(F.substring_index(name, ".", -1))
    return F.when(number, name).when(double, F.substring_index(name, ".", -3)).otherwise(two), suffix


def bad_html(html: Column) -> Column:
    """Outcome of a page by its own text: 1 if it is full of junk symbols, 0 if not, null without html."""
    count = lambda part: (F.length(html) - F.length(F.replace(html, F.lit(part), F.lit("")))) / len(part)
    return (JUNK_SHARE * sum(map(count, JUNK), F.lit(0)) > count(" ")).cast("int")


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule for the host or a domain above it whose path starts the url's path; null if none fits."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for at, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shrunk(level: DataFrame) -> DataFrame:
    """Adds the posterior pseudo-counts ``a`` (bad) and ``b`` (good) to groups with columns n, bad and ``prior`` (their prior mean)."""
    v = F.col("prior") * (1 - F.col("prior"))
    off = F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) - v).otherwise(0.0)
    sums = level.agg(F.sum(off), F.sum(F.when(F.col("n") > 1, v * (F.col("n") - 1)))).first()
    rho = min(max(sums[0] / sums[1], RHO[0]), RHO[1]) if sums[1] else RHO[0]
    weight = F.lit(1 / rho - 1)
    return level.withColumn("a", weight * F.col("prior") + F.col("bad")).withColumn("b", weight * (1 - F.col("prior")) + F.col("n") - F.col("bad"))


def hosts(outcomes: DataFrame, seen: DataFrame, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """Every host of ``outcomes`` (host, bad 1/0/null) and ``seen`` (host): n labelled pages, n bad ones, posterior pseudo-counts, lower
    bound of the bad share and whether that is above the limit; ``rows`` counts its rows in ``seen``."""
    one = outcomes.select("host", F.col("bad").isNotNull().cast("long").alias("n"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad"), F.lit(0).alias("rows"))
    both = one.unionByName(seen.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"), F.lit(1).alias("rows")))
    domain, suffix = domain_and_suffix(F.col("host"))
    counted = stored(both.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "rows")]).select("*", domain.alias("domain"), suffix.alias("suffix")))

    def grouped(below: DataFrame, by: list[str]) -> DataFrame:
        return below.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("children"))

    domains = stored(grouped(counted, ["domain", "suffix"]))
    suffixes = grouped(domains, ["suffix"])
    all_pages = counted.agg(F.sum("n"), F.sum("bad")).first()
    root = ((all_pages[1] or 0) + limit) / ((all_pages[0] or 0) + 1)
    mean = F.col("a") / (F.col("a") + F.col("b"))

    top = stored(_shrunk(suffixes.withColumn("prior", F.lit(root))))
    middle = stored(_shrunk(spread_join(domains, top.select("suffix", mean.alias("prior"), F.col("children").alias("below")), "suffix", "below")))
    out = _shrunk(stored(spread_join(counted, middle.select("domain", mean.alias("prior"), F.col("children").alias("below")), "domain", "below")))
    both_ab = F.col("a") + F.col("b")
    bound = mean - z * F.sqrt(F.col("a") * F.col("b") / (both_ab * both_ab * (both_ab + 1)))
    return out.select("host", "domain", "suffix", "n", "bad", "a", "b", bound.alias("bound"), (bound > limit).alias("blocked"), "rows")


def judge(pages: DataFrame, outcomes: DataFrame, ids: list[str], url: str = "url", rules: list[tuple[str, str, str]] = RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """One row a page: ``ids``, host, path, rule, verdict, and the labelled and bad pages of its host."""
    host, path = host_and_path(F.col(url))
    parted = pages.select(*[F.col(f"`{c}`") for c in ids], host.alias("host"), path.alias("path"))
    table = stored(hosts(outcomes, parted.select("host"), limit, z))
    judged = spread_join(parted, table.select("host", "blocked", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), "rows"), "host", "rows")
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(rule["verdict"], F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select(*[F.col(f"`{c}`") for c in ids], "host", "path", rule["rule"].alias("rule"), verdict.alias("verdict"), "n_labelled", "n_bad")


def allowed(pages: DataFrame, outcomes: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """The pages, all columns, whose verdict is allow."""
    host, path = host_and_path(F.col(url))
    inner = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), host.alias("host"), path.alias("path"))
    judged = judge(inner.withColumn("_url", F.col("page")[url]), outcomes, ["page"], "_url", rules, limit, z)
    return judged.filter(F.col("verdict") == "allow").select("page.*")


def report(pages: DataFrame) -> DataFrame:
    """Verdicts over a table of pages (page_id, url, html); the outcomes are those of the pages' own html."""
    outcomes = pages.select(host_and_path(F.col("url"))[0].alias("host"), bad_html(F.col("html")).alias("bad"))
    return judge(pages, outcomes, ["page_id"])


def _sql() -> str:
    runs = " + ".join(f"(length(html) - length(replace(html, '{x}', ''))) / {len(x)}" for x in JUNK)
    doubles = ", ".join(f"'{x}'" for x in SUFFIXES)
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    case = lambda at: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[at]}'" for h, p, v in ordered
    )

    def level(name: str, below: str, by: str, prior: str) -> str:
        return f"""
        {name}_0 AS ({below}),
        {name}_1 AS (SELECT *, {prior} AS prior FROM {name}_0),
        {name}_2 AS (SELECT CASE WHEN coalesce(sum(CASE WHEN n > 1 THEN prior * (1 - prior) * (n - 1) END), 0) = 0 THEN {RHO[0]}
          ELSE least({RHO[1]}, greatest({RHO[0]}, sum(CASE WHEN n > 0 THEN n * power(bad / n - prior, 2) - prior * (1 - prior) ELSE 0 END)
            / sum(CASE WHEN n > 1 THEN prior * (1 - prior) * (n - 1) END))) END AS rho FROM {name}_1),
        {name} AS (SELECT {by}, n, bad, (1 / rho - 1) * prior + bad AS a, (1 / rho - 1) * (1 - prior) + n - bad AS b FROM {name}_1, {name}_2)"""

    return f"""
    WITH cut AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
    parted AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
    outcomes AS (SELECT host, ({JUNK_SHARE} * ({runs}) > length(html) - length(replace(html, ' ', '')))::INT AS bad FROM parted),
    named AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM outcomes GROUP BY host),
    split AS (SELECT *, string_split(name, '.') AS l FROM named),
    cases AS (SELECT *, regexp_matches(name, '^[0-9.]+$|^\\[') AS number, array_to_string(l[-2:], '.') AS two FROM split),
    counted AS (SELECT host, n, bad,
      CASE WHEN number THEN name WHEN two IN ({doubles}) THEN array_to_string(l[-3:], '.') ELSE two END AS domain,
      CASE WHEN number THEN name WHEN two IN ({doubles}) THEN two ELSE l[-1] END AS suffix FROM cases),
    root AS (SELECT (coalesce(sum(bad), 0) + {LIMIT}) / (coalesce(sum(n), 0) + 1) AS mean FROM counted),
    {level("s", "SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM counted GROUP BY suffix", "suffix", "(SELECT mean FROM root)")},
    {level("d", "SELECT domain, suffix, sum(c.n) AS n, sum(c.bad) AS bad, any_value(s.a / (s.a + s.b)) AS m FROM counted c JOIN s USING (suffix) GROUP BY domain, suffix", "domain", "m")},
    {level("h", "SELECT host, c.n, c.bad, d.a / (d.a + d.b) AS m FROM counted c JOIN d USING (domain)", "host", "m")},
    judged AS (SELECT host, n, bad, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {LIMIT} AS blocked FROM h)
    SELECT page_id, host, path, {case(0)} END AS rule, {case(1)} WHEN blocked THEN 'block' ELSE 'allow' END AS verdict, n::BIGINT AS n_labelled, bad::BIGINT AS n_bad
    FROM parted JOIN judged USING (host)"""


SQL = _sql()

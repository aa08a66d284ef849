import math
import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from barweave.llm import reputation

PAGES = "page_id bigint, url string, html string"
BAD, GOOD = "<p>a ###b ***c %%%d $$$ e</p>", "<p>plain words on a plain page</p>"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute(outcomes):
    """host -> (n, bad, blocked), by plain loops over one level after the other."""
    names = {h: (re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", h))) for h, _ in outcomes}

    def above(host):
        name = names[host]
        if re.search(r"^[0-9.]+$|^\[", name):
            return name, name
        parts = name.split(".")
        deep = ".".join(parts[-2:]) in reputation.SUFFIXES
        return ".".join(parts[-2 - deep :]), ".".join(parts[-1 - deep :])

    def shrink(groups):
        off = weight = 0
        for n, bad, m in groups.values():
            off += n * (bad / n - m) ** 2 - m * (1 - m) if n else 0
            weight += m * (1 - m) * (n - 1) if n > 1 else 0
        rho = min(max(off / weight, 0.001), 0.5) if weight else 0.001
        return {g: ((1 / rho - 1) * m + bad, (1 / rho - 1) * (1 - m) + n - bad) for g, (n, bad, m) in groups.items()}

    count = defaultdict(lambda: [0, 0])
    for host, bad in outcomes:
        count[host]
        if bad is not None:
            count[host][0] += 1
            count[host][1] += bad
    tops, middles = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for host, (n, bad) in count.items():
        for level, key in ((middles, above(host)), (tops, above(host)[1])):
            level[key][0] += n
            level[key][1] += bad
    root = (sum(b for _, b in count.values()) + 0.05) / (sum(n for n, _ in count.values()) + 1)
    mean = lambda ab: ab[0] / sum(ab)
    s = shrink({k: (*v, root) for k, v in tops.items()})
    d = shrink({k: (*v, mean(s[k[1]])) for k, v in middles.items()})
    h = shrink({k: (*v, mean(d[above(k)])) for k, v in count.items()})
    return {k: (*count[k], mean((a, b)) - 1.64 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) > 0.05) for k, (a, b) in h.items()}


def some_pages():
    rng, out = random.Random(4), []
    for site in range(40):
        suffix = ["com", "net", "co.uk", "org", "de"][site % 5]
        bad = 0.7 if site % 8 == 1 else 0.02
        for _ in range(rng.choice([1, 3, 30])):
            host = f"{rng.choice(['www.', 'A.', ''])}site{site // 2}.{suffix}{rng.choice(['', '', ':80'])}"
            out.append((len(out), f"https://{host}/en/{rng.randrange(9)}?x=/{rng.randrange(3)}", rng.choice([BAD if rng.random() < bad else GOOD] * 4 + [None])))
    out += [(900 + k, f"http://hot.example.com/{k}", GOOD) for k in range(400)]
    urls = ["http://x.org/es/1", "http://X.Org?q", "http://example.org/es/", "http://a.example.org/en/15", "http://example.org/en/2", "http://myexample.org/es/", "http://b.com/fr/", "http://com/de/x",
            "http://c.com/de", "no scheme", "", None, "://", "http://é.COM/FR/", "ftp://u:p@h.net:21/fr/#a?b", "http://10.0.0.1/x", "http://[::1]/x", "http://a\nb.com/fr/\nz?", "http://a.com//fr/"]
    out += [(2000 + k, u, GOOD if k % 2 else BAD) for k, u in enumerate(urls)]
    return out + [(5, "http://twice.net/", GOOD), (5, "http://twice.net/", GOOD), (None, "http://nullid.net/", BAD)]


def test_brute_force_and_sql(spark, clash):
    rows = some_pages()
    pages = spark.createDataFrame(rows, PAGES)
    got = reputation.report(clash(pages))
    have = brute([(split(u)[0], None if h is None else int(h == BAD)) for _, u, h in rows])
    rules = sorted(reputation.RULES, key=lambda r: -len(r[0] + r[1]))
    want = []
    for page_id, url, _ in rows:
        host, path = split(url)
        rule = next((r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), None)
        n, bad, blocked = have[host]
        want.append((page_id, host, path, rule and rule[0] + rule[1], rule[2] if rule else "block" if blocked else "allow", n, bad))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    verdicts = {(w[4], w[3] is None) for w in want}
    assert len(verdicts) == 4, "rules and method both allow and block"

    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert sorted(con.execute(reputation.SQL).fetchall(), key=str) == sorted(want, key=str)


def test_hosts_borrow_from_their_domain(spark):
    """One bad page blocks a host of a bad domain, not a host of a good one; without outcomes nothing is blocked."""
    rows = [(f"{k}.bad.com", 1) for k in range(60)] + [(f"{k}.good.com", int(k == 0)) for k in range(200)] + [("0.good.com", 0)]
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    seen = spark.createDataFrame([("new.bad.com",), ("new.good.com",)], "host string")
    blocked = {r.host: r.blocked for r in reputation.hosts(outcomes, seen).collect()}
    assert blocked["7.bad.com"] and blocked["new.bad.com"] and not blocked["0.good.com"] and not blocked["new.good.com"]
    assert not any(r.blocked for r in reputation.hosts(outcomes.limit(0), seen).collect())


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables_and_kept_columns(spark, clash, n):
    pages = clash(spark.createDataFrame([(1, "http://a.org/x", GOOD)], PAGES)).limit(n)
    assert reputation.report(pages).count() == n
    kept = reputation.allowed(pages.withColumn("host", F.lit(1)), spark.createDataFrame([], "host string, bad int"))
    assert kept.schema.names == [*pages.schema.names, "host"] and kept.count() == n

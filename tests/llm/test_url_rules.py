import random

import numpy as np

from tracewell.llm import url_rules


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_against_brute_force(spark):
    rnd = random.Random(2)
    hosts = ["a.example.net", "Example.NET", "net", "xnet", "b.c.example.com", "example.org", "é.org", "", "x..net", "www.example.com."]
    urls = [None, "", "no scheme.net/", "http://net", "http://net?x=/", "://net/", "http://a.net/#://org/fr/", "http://" + "a." * 3000 + "net/en/", "http://" + "x" * 100_000 + ".example.com/de/", "http://" + "b." * 60_000 + "org/fr/" + "y" * 100_000]
    urls += [f"http{rnd.choice('s ')}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/en', '/de/x?y', '/fr/#z', '?q', '//'])}" for _ in range(200)]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[9], "y"), (3, urls[3], "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    many = [*url_rules.RULES, *((f"h{i}.example.org", "/p" * (i % 3), "block") for i in range(500))]
    for rules in (url_rules.RULES, many):
        got = url_rules.judged(df, url_rules.rule_table(spark, rules)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str((i, *brute(u, rules))) for i, u, _ in rows)
    assert url_rules.judged(df.limit(0), url_rules.rule_table(spark)).count() == 0
    assert {r.verdict for r in url_rules.judged(df, url_rules.rule_table(spark).limit(0)).collect()} == {"allow"}


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    rules = url_rules.listed(url_rules.rule_table(spark, [(f"host{i}.org", "/", "block") for i in range(3000)]))
    filter_ = url_rules.build_filter(rules)
    hashes = np.array([r[0] for r in rules.selectExpr("xxhash64(key)").collect()], np.int64)
    assert url_rules.passes(filter_, hashes).all()
    others = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 20000)
    assert url_rules.passes(filter_, others).mean() < 0.01


def test_a_long_list_shuffles_only_possible_hits(spark, monkeypatch):
    rules = spark.range(200_000).selectExpr("concat('h', id, '.example.org') AS host", "'/' AS path", "'block' AS verdict")
    pages = spark.createDataFrame([(i, f"http://www.h{i}.example.org/x" if i % 10 == 0 else f"http://other{i}.com/") for i in range(2000)], "page_id long, url string")
    got = url_rules.judged(pages, rules)
    assert all((r.rule == f"h{r.page_id}.example.org/") == (r.page_id % 10 == 0) and (r.verdict == "block") == (r.page_id % 10 == 0) for r in got.collect()) and got.count() == 2000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    union = plan.splitlines()[0]
    assert union.startswith("Union")
    branches = plan.split("\n+- ")
    assert "Join" not in branches[-1] and "Aggregate" not in branches[-1] and "Join" in plan and "isnotnull" in plan

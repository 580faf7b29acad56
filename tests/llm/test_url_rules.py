"""URL rules beside a brute-force version."""

from logstrata.llm import url_rules

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("NET", "/fr", "block"), ("a.b.c", "", "block"), ("x.y", "/p", "allow"),
    ("x.y", "/p", "block"), ("ab", "/abc", "block"), ("b.ab", "/a", "allow"), (None, "/", "block"),
]
URLS = [
    None, "", "no scheme/en/", "http://", "http://example.com", "http://EXAMPLE.com/en/x?y#z",
    "https://www.example.com/en/", "https://m.www.example.com/en", "http://notexample.com/en/",
    "http://a.net/french", "http://a.net/fr", "http://q.a.b.c", "http://q.a.b.c?x", "ftp://x.y/path/",
    "http://b.ab/abcd", "http://example.com?/en/", "http://example.com/en/#://b/", "://com/",
    "http://" + "a." * 300 + "com/" + "s/" * 500, "http://Ä.com/ü", "http://com./", "http://.com/",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule_host, rule_path, verdict in RULES:
        if rule_host is None:
            continue
        rule_host = rule_host.lower()
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            rule = rule_host + rule_path
            found = (len(rule), len(rule_host), rule, verdict)
            best = max(best, found) if best else found
    return host, path, best and best[2], best[3] if best else "allow"


def test_all_urls(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = [(i, u, "x", "y", "z") for i, u in enumerate(URLS)]
    rows += [(None, URLS[5], "x", "y", "z")] * 2
    pages = spark.createDataFrame(
        rows, "page_id long, url string, host string, rule string, verdict string"
    )
    got = sorted((tuple(r) for r in url_rules.judge(pages, rules).collect()), key=repr)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)


def test_shuffled_rules_and_empty_tables(spark, monkeypatch):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    few = url_rules.judge(pages, rules).collect()
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", 2)
    assert sorted(map(repr, url_rules.judge(pages, rules).collect())) == sorted(map(repr, few))
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_a_rule_of_many_slashes_is_one_expression(spark):
    deep = "/" + "a/" * 3000
    rules = spark.createDataFrame([("com", deep, "block"), ("com", "/a", "block"), ("com", "/", "allow")],
        "host string, path string, verdict string")
    urls = [f"http://x.com{deep}b", f"http://x.com{deep[:-2]}", "http://x.com/ab", "http://x.com/b", "http://x.com"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_rules.judge(pages, rules)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in found.collect()}
    assert got == {0: ("com" + deep, "block"), 1: ("com/a", "block"), 2: ("com/a", "block"), 3: ("com/", "allow"), 4: (None, "allow")}

from vesselflow.llm import url_rules as U

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("b.example.net", "/e", "block"), ("example.com", "", "allow"), ("x", "/a", "block"), ("x", "/a", "allow")]


def brute(url, rules):
    """Host, path and deciding rule by trying all rules."""
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


URLS = [
    "http://a.example.net/en/1", "http://example.net/en", "HTTP://Example.NET/en/?q#f", "http://net/", "http://net", "http://net?x",
    "http://b.example.net/eñ/1", "http://c.b.example.net/e?/en/", "https://example.com", "https://sub.example.com/de/#t", "x://x/abc",
    "no url", "://", "", None, "http://a..net/", "http://.net/", "http://ÀB.net/É", "http://anexample.net/en/", "http://net/" + "y/" * 2000,
    "http://" + "a." * 500 + "net/z", "a://b://c/d", "http://net\n/x",
]


def test_equals_trying_all_rules(spark):
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(URLS)], "page_id long, url string, rule string, verdict string")
    rules = [r for r in RULES if r != ("x", "/a", "allow")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.apply_url_rules(pages, U.rule_table(spark, RULES)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(URLS)}


def test_shared_digest_prefixes_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(U, "PREFIX_DIGITS", 1)
    rules = [(f"h{k}.net", "/", "block") for k in range(300)]
    pages = spark.createDataFrame([(k, f"http://h{k}.net/") for k in range(250, 350)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.apply_url_rules(pages, U.rule_table(spark, rules)).collect()}
    assert got == {k: "block" if k < 300 else "allow" for k in range(250, 350)}


def test_rows_nulls_repeats_and_empty_tables(spark):
    pages = spark.createDataFrame([(None, "http://net/"), (1, "http://net/"), (1, "http://net/"), (2, None)], "page_id long, url string")
    rules = U.rule_table(spark, [("net", "/", "block"), (None, "/", "block"), ("org", None, "block"), ("", "", "block")])
    got = sorted((r.page_id or 0, r.rule or "") for r in U.apply_url_rules(pages, rules).collect())
    assert got == [(0, "net/"), (1, "net/"), (1, "net/"), (2, "")]
    assert U.apply_url_rules(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in U.apply_url_rules(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_no_python_on_executors(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    plan = U.apply_url_rules(pages, U.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

import random

from textmill.llm import url_filter
from textmill.llm.queries import URL_RULES


def plain(rules, host, path):
    fit = [
        (len(h.split(".")) if h else 0, len(p), v == "block", h + p, v) for v, h, p in rules
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fit)[3:] if fit else None


def test_agrees_with_sql(same, sf_mid):
    same("op2_url_filter", sf_mid)


def test_trie_agrees_with_plain_matching():
    rng = random.Random(3)
    host = lambda n: ".".join(rng.choice(["a", "b", "org", ""]) for _ in range(rng.randint(1, n)))
    path = lambda: "".join(rng.choice(["/", "x", "xy", "/x/"]) for _ in range(rng.randint(0, 5)))
    for _ in range(40):
        rules = [(rng.choice(["allow", "block"]), host(3), path()) for _ in range(12)]
        trie = url_filter.UrlTrie(rules)
        for _ in range(80):
            h, p = host(4), path()
            assert trie.match(h, p) == plain(rules, h, p), (rules, h, p)


def test_split_url():
    assert url_filter.split_url("HTTP://WWW.Exämple.ORG:80/A/b?q#f") == ("www.exämple.org:80", "/A/b")
    assert url_filter.split_url("http://a.org#x/y") == ("a.org", "")
    assert url_filter.split_url("http://a.org?x://b/c") == ("a.org", "")
    assert url_filter.split_url("mailto:x") == url_filter.split_url(None) == url_filter.split_url("") == ("", "")


def test_edges(spark):
    urls = ["http://example.org/en/12", "http://x.example.org/en/2", "http://org/", "http://org", "http://notorg/", None, "",
            "http://example.com/fr/", "http://example.com/de/1", "http://example.com/en/", "http://a.org/" + "z" * 100_000]
    rows = [(i, u, "h", "r", "v", "p") for i, u in enumerate([*urls, urls[0]])] + [(None, urls[0], None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, verdict string, path string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, URL_RULES).collect()}
    assert [got[i] for i in range(10)] == [
        ("example.org/en/1", "block"), ("org/", "allow"), ("org/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
        (None, "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"),
    ]
    assert got[10] == ("org/", "allow") and got[11] == got[None] == got[0] and len(got) == 13
    assert url_filter.filter_urls(df.limit(0), URL_RULES).collect() == []


def test_deep_rules(spark):
    """Thousands of segments and labels, which a tree of objects couldn't be sent with."""
    path, host = "/s" * 3000 + "/", "l." * 3000 + "org"
    rules = [("block", "org", path), ("block", host, "/")]
    df = spark.createDataFrame([(1, f"http://x.org{path}y"), (2, f"http://x.org{path[:-1]}"), (3, f"http://{host}/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(df, rules).collect()} == {1: "block", 2: "allow", 3: "block"}

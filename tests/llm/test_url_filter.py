from maskspark.llm.url_filter import filter_urls, viterbi_split


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    rules = [("net", "/"), ("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/")]
    fit = [h + p for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=len, default=None)


URLS = [None, "", "no scheme", "http://A.NET", "http://a.net/", "http://net/x", "https://x.Example.net/en/1", "https://example.net/en", "http://badexample.net/en/", "http://x.example.com/de/9?x=1", "ftp://y.org/fr/", "http://y.org?q=/fr/", "http://h#f", "a://b://c/d", "http://È.org/fr/é", "http://x\ny.net/"]


def test_hosts_and_rules(spark):
    rows = [(i, u, "<p>words</p>") for i, u in enumerate(URLS)] + [(None, "http://k.io/a", None)] * 2
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule) == brute(URLS[r.page_id]), URLS[r.page_id]
        assert r.verdict in ("allow", "block")
    verdicts = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    assert all(r.verdict == verdicts[r.rule] for r in got if r.rule)
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_split():
    counts = {"best": 50, "pills": 20, "bestp": 1, "news": 40}
    assert viterbi_split("bestpills", counts, 200) == ["best", "pills"]
    assert viterbi_split("xq", counts, 200) == ["xq"] and viterbi_split("", counts, 200) == []


def test_words_decide_the_rest(spark):
    html = "<style>zzz</style><p>" + "cheap pills daily news " * 20 + "</p>"
    rows = [(i, f"http://cheappills{'x' * (i % 2)}.net/buy/{i}", html) for i in range(20)] + [(100 + i, f"http://dailynews.org/fr/read/{i}", html) for i in range(20)]
    rows += [(200, "http://cheappills.io/buy/1", html), (201, "http://dailynews.io/read/1", html)]
    got = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[200], got[201]) == ("block", "allow")

"""URL rules and host reputation against a plain reading of the contract."""

import random

from stratalith.llm import url_filter

#: From the contract, independent of the module's own table.
CONTRACT = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def slow(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), v, h + p) for v, h, p in CONTRACT if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[:0:-1] if fit else (None, None)))


def test_rules_are_those_of_the_contract(spark):
    rnd = random.Random(3)
    parts = ["com", "net", "org", "example", "Example", "COM", "a", "xnet", "b-c"]
    urls = [None, "", "nothing", "://", "http://", "HTTP://net/de/", "x://net/de", "x://net?/de/", "http://example.net/de/8", "http://a.example.net/de/81?q#f", "http://example.net/de/7", "http://example.com/en/7", "http://example.com/en/6", "http://org/es/", "http://org/ES/", "a://b://net/de/", "http://net" + "/de/" + "x" * 300_000]
    urls += ["http://" + ".".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) + rnd.choice(["/en/7", "/en/", "/de/8x", "/de/1", "/es/", "/es", "", "/", "?a=/en/"]) for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, none).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = slow(u)
        assert got[i] == (host, path, rule, verdict or "allow"), u
    assert {v for *_, v in got.values()} == {"allow", "block"}


def test_url_edges(spark):
    urls = ["http://A.Example.COM/en/7x?q", "https://b.net/de/1#z", "http://x.example.net/de/8", "http://org/es/", "http://xorg/es/", "nothing", None, "://", "ftp://u:p@h.co.uk:80", "http://a.com?x=/en/"]
    p = spark.createDataFrame([(i, u, 1, "s") for i, u in enumerate(urls)] + [(None, urls[0], 1, "s")], "page_id long, url string, n int, rule string")
    l = spark.createDataFrame([(5, 0, 1), (5, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(p, l).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[1] == ("b.net", "/de/1", "net/de/", "allow") and got[2][2:] == ("example.net/de/8", "block")
    assert got[3][2] == "org/es/" and got[4][2] is None and got[5][:3] == got[6][:3] == got[7][:3] == ("", "", None)
    assert got[8][:2] == ("u:p@h.co.uk:80", "") and got[9][1:3] == ("", None) and got[None] == got[0]
    assert url_filter.filter_urls(p.where("page_id < 0"), l).collect() == []
    many = spark.createDataFrame([(i, f"http://bad{i % 3}.evil.net/{i}") for i in range(60)] + [(100 + i, f"http://s{i % 4}.good.net/{i}") for i in range(200)], "page_id long, url string")
    marks = spark.createDataFrame([(i, 0, 1) for i in range(59)] + [(100 + i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    v = {r.page_id: r.verdict for r in url_filter.filter_urls(many, marks).collect()}
    assert v[59] == "block" and v[100] == "allow"

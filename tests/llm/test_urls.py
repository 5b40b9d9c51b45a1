import random

from pyspark.sql import functions as F

from tuneframe.llm import urls

CASES = [
    ("http://www.Example.COM/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://blog.example.com/en/?q=1", "blog.example.com", "/en/", "example.com/en/", "block"),
    ("https://example.com/en", "example.com", "/en", "com/", "allow"), ("ftp://a.net/fr/b#c", "a.net", "/fr/b", "net/fr/", "block"),
    ("http://net/es/", "net", "/es/", "net/es/", "block"), ("http://anet/es/", "anet", "/es/", None, None),
    ("http://x.com", "x.com", "", None, None), ("nothing", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
    ("a://b.com?x=/en/", "b.com", "", None, None), ("http://É.com/a://b", "É.com", "/a://b", "com/", "allow"),
]


def test_hosts_paths_and_rules(rows):
    df = rows("i int, url string", [(i, c[0]) for i, c in enumerate(CASES)])
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    got = df.select("i", host.alias("h"), path.alias("p"), urls.rule_of(host, path).alias("r")).orderBy("i").collect()
    for r, (_, h, p, rule, verdict) in zip(got, CASES):
        assert (r["h"], r["p"]) == (h, p)
        assert (r["r"]["rule"] if r["r"] else None, r["r"]["verdict"] if r["r"] else None) == (rule, verdict)


def plain(url):
    """Host, path, rule and its verdict, step by step."""
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_fuzz_against_plain_python(rows):
    rng = random.Random(4)
    parts = ["http", "://", "://", "www.", "Example", "example", ".com", ".COM", ".net", "net", "com", "/", "/en/", "/es/", "/fr/", "/en", "?", "#", "é", "%2F", "@", ":80", " ", "x", ""]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 9))) for _ in range(3000)] + [None]
    df = rows("i int, url string", list(enumerate(texts)))
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    for r in df.select("i", host.alias("h"), path.alias("p"), urls.rule_of(host, path).alias("r")).collect():
        got = (r["h"], r["p"], *((r["r"]["rule"], r["r"]["verdict"]) if r["r"] else (None, None)))
        assert got == plain(texts[r["i"]]), texts[r["i"]]


def test_trees_say_more_than_the_rules(rows):
    """Without the suffixes that rules name, urls that no rule decides get different scores, and the rules still decide theirs."""
    rng = random.Random(6)
    data = []
    for i in range(900):
        host, path = rng.choice([("example.com", "/en/"), ("shop.net", "/es/"), ("a.org", "/"), ("paper.com", "/"), ("b.net", "/fr/"), ("c.net", "/x/")])
        noisy = path in ("/en/", "/es/", "/fr/") and rng.random() < 0.8
        data.append((i, f"http://{host}{path}{rng.randrange(10**9) if noisy else 'page'}{'?q=1&r=22' if noisy else ''}"))
    pages = rows("page_id int, url string", data)
    model = urls.UrlFilter.fit(urls.rule_labels(pages), trees=5, leave_out=urls.RULE_SUFFIXES)
    judged = model.judge(pages).collect()
    assert all((r["rule"], r["verdict"])[0] is None or (r["rule"], r["verdict"]) == plain(data[r["page_id"]][1])[2:] for r in judged)
    free = rows("page_id int, url string", [(1, "http://d.org/page"), (2, "http://d.org/123456789?q=1&r=22")])
    scores = {r["page_id"]: r["block_probability"] for r in model.judge(free).collect()}
    assert scores[2] > scores[1] + 0.2


def test_trees_learn_labels(rows):
    rng = random.Random(2)
    data = []
    for i in range(600):
        bad = i % 2
        host = f"{'cheap-pills' if bad else 'paper'}{rng.randrange(9)}.{'biz' if bad else 'org'}"
        data.append((i, f"http://{host}/{rng.randrange(10**6) if bad else 'page'}{'?a=1&b=2' if bad else ''}", bad))
    labelled = rows("page_id int, url string, label int", data)
    model = urls.UrlFilter.fit(labelled.where("page_id < 450"), trees=5)
    held = model.judge(labelled.where("page_id >= 450"), rules=())
    right = held.where((F.col("verdict") == "block") == (F.col("label") == 1)).count()
    assert right >= 0.95 * held.count()


def test_odd_pages(rows):
    pages = rows("page_id int, url string, host string, rule string", [(1, None, "z", "z"), (2, "", "z", "z"), (3, "http://a.org/" + "x" * 50000, None, None), (3, "http://a.org/", None, None)])
    none = urls.UrlFilter.fit(urls.rule_labels(pages))
    assert none.model is None and {r["verdict"] for r in none.judge(pages).collect()} == {"allow"}
    learned = urls.UrlFilter.fit(rows("url string, label int", [("http://a.net/es/", 1), ("http://a.com/", 0), ("http://b.com/", 0), (None, None)]), trees=2)
    assert learned.judge(pages).count() == 4 and learned.judge(pages.limit(0)).count() == 0

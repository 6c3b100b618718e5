"""URL rules against plain versions; mined rules on planted combinations."""

import itertools
import random
import re

from pyspark.sql import functions as F

from colloquy.llm import urls

CASES = [
    None, "", "no scheme", "http://", "HTTP://Example.COM/en/7", "https://a.example.com/en/6?x=1", "https://a.example.com/en/71#t", "https://xexample.com/en/7",
    "https://www.EXAMPLE.net/de/8", "https://foo.net/de/8", "https://m.example.net/de/9/", "http://example.org/es/1", "http://example.org/fr/1", "//x.com/en/", "ftp://h.com?en/",
    "http://h.com#/en/", "a://b://c/en/", "http://net/de/1", "http://com/en/", "http://x.com/en", "http://É.com/en/é\nq", "http://" + "a" * 5000 + ".com/en/" + "b" * 5000,
]


def slow(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    best = None
    for h, p, v in urls.LISTED:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return (host, path, best[0] if best else None, best[1] if best else "allow")


def test_hosts_paths_and_listed_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(CASES)], "page_id long, url string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = urls.judge_urls(pages, "url", none, ["page_id"]).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [slow(u) for u in CASES]
    assert urls.judge_urls(pages.limit(0), "url", none, ["page_id"]).collect() == []


def planted(n=600):
    r = random.Random(7)
    hosts = ["a.shop.test", "b.news.test", "c.blog.test"]
    rows = []
    for i in range(n):
        host, section, query = r.choice(hosts), r.choice(["win", "read", "en"]), r.choice(["", "?ref=x", "?page=2"])
        rows.append((f"https://{host}/{section}/{i}{query}", host.startswith("a") and section == "win" if r.random() < 0.97 else None))
    return rows


def test_mined_rules_equal_brute_force(spark):
    rows = [x for x in planted() if x[1] is not None]
    df = spark.createDataFrame(rows, "url string, bad boolean").withColumn("tokens", urls.url_tokens(F.col("url")))
    sets = [(frozenset(r.tokens), r.bad) for r in df.collect()]
    tokens = sorted({t for s, _ in sets for t in s})
    frequent = [t for t in tokens if sum(t in s and b for s, b in sets) >= 0.05 * len(sets)]
    want = {}
    for k in range(1, 9):
        for combo in itertools.combinations(frequent, k):
            c = frozenset(combo)
            hits = [b for s, b in sets if c <= s]
            if hits and sum(hits) >= 0.05 * len(sets) and sum(hits) / len(hits) >= 0.6 and not any(p < c and want[p] >= sum(hits) / len(hits) for p in want):
                want[c] = sum(hits) / len(hits)
    got = {frozenset(r.tokens): r.confidence for r in urls.mine_rules(df, "tokens", "bad", 0.05, 0.6, 1).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_mined_rules_block_only_the_combination(spark):
    rows = planted()
    pages = spark.createDataFrame([(i, u, "q") for i, (u, _) in enumerate(rows)] + [(5, rows[5][0], "q"), (None, None, None)], "page_id long, url string, tokens string")
    got = urls.judge_urls(pages, "url", spark.createDataFrame(rows, "url string, bad boolean"), ["page_id", "tokens"], listed=(), min_support=0.02, min_rows=5).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        url = "" if r.page_id is None else rows[r.page_id][0]
        assert (r.verdict == "block") == (r.mined is not None) == url.startswith("https://a.shop.test/win/")


def test_few_labels_make_no_rule(spark):
    r = random.Random(1)
    rows = [(f"http://h{i % 7}.test/{i % 5}/{i}", r.random() < 0.25) for i in range(300)]
    pages = spark.createDataFrame([(u,) for u, _ in rows], "url string")
    got = urls.judge_urls(pages, "url", spark.createDataFrame(rows, "url string, bad boolean"), [], listed=())
    assert got.filter("verdict = 'block'").count() == 0

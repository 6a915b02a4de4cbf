import re

import pytest

from loopstats.llm import common as C, url_rules as U

URLS = [
    None, "", "no scheme", "http://a.net", "http://a.net/", "HTTP://A.NET/x?y", "https://example.net/en/1#t", "http://www.example.net/en", "x://b.example.com/de/?q",
    "http://example.com?a=/de/", "http://sub.fr.org/fr/x", "http://spam-farm.example.com/en/", "http://cheap-pills.org/fr/1", "http://my.casino.info/", "http://ads.x.info/p",
    "http://x.info/a/ads/b", "http://x.info/ads", "http://y.info/wp-login.php", "http://net/", "http://xnet/a", "http://a.net/\nb", "a://b://c.net/d", "http://pornx.info/", "http://a.b.xxx.info/", "http://É.net/é",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for name, verdict in U.BASE:
        h, _, p = name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(name), name, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = any(re.search(p, host + path) for _, _, p, _ in U.METHOD)
    return host, path, None, "block" if bad else "allow"


def test_against_brute_force(spark, folder):
    rows = [(i, u, "x") for i, u in enumerate(URLS * 2)] + [(0, "http://again.net/", "x"), (None, "http://n.net/", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = U.judge_urls(pages, U.rule_table(spark), folder)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(((i, *brute(u)) for i, u, _ in rows), key=repr)


def test_rules_are_filed_under_their_rarest_token(spark, folder):
    pages = spark.createDataFrame([(i, f"http://w{i}.example.com/de/") for i in range(30)] + [(99, "http://q.example.net/en/")], "page_id bigint, url string")
    U.judge_urls(pages, U.rule_table(spark), folder).collect()
    index = {r.rule: r.token for r in spark.read.parquet(f"{folder}/index").collect()}
    assert index["example.net/en/"] in ("en", "net") and index["example.com/de/"] in ("com", "de", "example") and all(index.values())  # no rule runs on every URL


def test_every_token_is_in_every_match():
    for name, verdict, pattern, tokens in [U.host_path_rule(*r) for r in U.BASE] + list(U.METHOD):
        for url in URLS:
            host, path, *_ = brute(url)
            if re.search(pattern, host + path):
                assert set(tokens) <= set(re.split(U.TOKEN, (host + path).lower())), (name, url)


@pytest.mark.parametrize("name,tokens", [("a.b/", ("a", "b")), ("a.b/c/d", ("a", "b", "c")), ("x/long-Path/", ("x", "long", "path"))])
def test_tokens_of_host_path_rules(name, tokens):
    assert U.host_path_rule(name, "block")[3] == tokens


def test_no_rules_and_no_rows(spark, folder):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    none = U.rule_table(spark).limit(0)
    assert [tuple(r) for r in U.judge_urls(pages, none, folder, "block").collect()] == [(1, "a.net", "/", None, "block")]
    assert U.judge_urls(pages.limit(0), U.rule_table(spark), C.scratch(spark)).count() == 0


def test_words_of_each_topic_on_other_hosts(spark, folder):
    bad = [
        "http://adult-films.example.info/", "http://best.nude-pics.info/a", "http://live-xxx", "http://bets.info", "http://www.my-betting-tips.info/",
        "http://poker:8080/", "http://eu-roulette.info/x", "http://x-ads.info/", "http://ads-eu.cdn.info/", "http://tracking.shop.info/p", "http://web-banners.info/",
        "http://buy-viagra-now.info/", "http://replica.watches.info/", "http://AD.info/",
    ]
    good = [
        "http://alphabets.info/", "http://adulthood.info/", "http://essex.info/", "http://downloads.info/", "http://loads-of.info/", "http://pokerface.info/",
        "http://news.info/bets/poker-ads.html", "http://respawn.info/", "http://betsy-ross.info/", "http://x.info?bets.y", "http://add.info/",
    ]
    pages = spark.createDataFrame(list(enumerate(bad + good)), "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in U.judge_urls(pages, U.rule_table(spark), folder).collect()}
    assert [got[i] for i in range(len(got))] == ["block"] * len(bad) + ["allow"] * len(good)
    assert all(r.token in r.rule for r in spark.read.parquet(f"{folder}/index").where("rule like '%:%'").collect())
    assert len({n for n, *_ in U.METHOD}) == len(U.METHOD)

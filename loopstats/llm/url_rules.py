"""URL filters: pattern rules indexed by their rarest literal token. DataFrame functions only.

A rule is a regular expression over `host + path`, with the literal tokens that every match must hold. Tokens are
runs of letters and digits, in lower case. How many URLs hold each rule token is counted; a rule is filed under its
rarest one. A URL fetches the rules filed under its own tokens, and only those run their expressions. Rules without a
literal token are filed under the empty token, which every URL has.

Equal URLs are judged once. Among the rules that match, the kind `base` goes before `method`, then the longest name.

Defined cases: a null URL or one without `://` has an empty host and path and meets only rules without token; rows that
repeat a page are judged each; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

#: Fixed values: (name, verdict).
BASE = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words that block a host in which one of them is a whole piece of a label, by topic.
WORDS = {
    "adult": (
        "adult adults camgirl camgirls erotic erotica escort escorts fetish hardcore hentai milf nsfw nude nudes porn porno pornos "
        "sex sexcam sexcams sexy stripper strippers xxx"
    ),
    "gambling": (
        "baccarat bet bets betting bingo blackjack bookie bookies bookmaker bookmakers casino casinos gamble gambling jackpot "
        "jackpots lotto lottery poker roulette slots sportsbet sportsbook wager wagers"
    ),
    "ads": (
        "ad adclick adclicks adnetwork ads adserv adserver adservers adsrv adsystem adtrack advert advertising adverts affiliate "
        "affiliates banner banners clicktrack doubleclick popunder popup popups sponsored tracker trackers tracking trk"
    ),
    "spam": (
        "ambien cialis counterfeit levitra meds payday phentermine pills replica replicas spam steroids tramadol valium viagra "
        "weightloss xanax"
    ),
}
#: (name, verdict, expression over host + path, literal tokens): advertising paths, machine pages, and hosts by word.
METHOD = (
    ("ads-path", "block", r"^[^/]*/([^/]*/)*ads/", ("ads",)),
    ("login", "block", r"^[^/]*/([^/]*/)*wp-login\.php", ("wp", "login", "php")),
    ("cgi", "block", r"^[^/]*/cgi-bin/", ("cgi", "bin")),
    *((f"{topic}:{w}", "block", rf"^([^/]*[.-])?{w}([.:/\s-]|$)", (w,)) for topic, words in WORDS.items() for w in words.split()),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
TOKEN = "[^a-z0-9]+"


def host(url: Column) -> Column:
    return C.ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_path_rule(name: str, verdict: str) -> tuple[str, str, str, tuple[str, ...]]:
    """A rule `host/path`: the host and all its subdomains, and paths that start with the path."""
    rule_host, slash, rest = name.partition("/")
    quoted = "".join(c if c.isalnum() or c in "/-_" else "\\" + c for c in f"{rule_host}{slash}{rest}")
    whole = f"{rule_host}/{rest[: rest.rfind('/') + 1]}"  # a last piece without a slash may go on in the URL
    tokens = tuple(t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in whole.lower()).split())
    return name, verdict, rf"(?s)^([^/]*\.)?{quoted}", tokens


def rule_table(spark: SparkSession, base: Sequence = BASE, method: Sequence = METHOD) -> DataFrame:
    """(kind, rule, verdict, pattern, tokens)"""
    rows = [("base", *host_path_rule(*r)) for r in base] + [("method", *r) for r in method]
    names = ("kind", "rule", "verdict", "pattern", "tokens")
    texts = lambda t: F.array(*map(F.lit, t)).cast("array<string>")
    structs = [
        F.struct(*((texts(v) if n == "tokens" else F.lit(v)).alias(n) for n, v in zip(names, row))) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def judge_urls(pages: DataFrame, rules: DataFrame, folder: str, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row: `rule` names the base rule, if one fits; else null.

    Without a base rule the method's rules give the verdict, and `default` if none of them matches.
    """
    urls = pages.select("url").where("url is not null").distinct().select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    urls = C.cut(urls.withColumn("target", F.concat("host", "path")), folder, "urls")
    tokens = urls.select(
        "url", "target", F.explode(F.array_distinct(F.array_append(F.split(F.lower("target"), TOKEN), F.lit("")))).alias("token")
    )
    named = rules.select("rule", F.explode_outer("tokens").alias("token")).select("rule", F.coalesce("token", F.lit("")).alias("token"))
    seen = tokens.join(named.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = named.join(seen, "token", "left").groupBy("rule").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).getField("token").alias("token")
    )
    index = C.cut(rules.join(filed, "rule").select("token", "kind", "rule", "verdict", "pattern"), folder, "index")
    fits = tokens.join(index, "token").where(F.regexp_like("target", F.col("pattern")))
    rank = F.struct((F.col("kind") == "base").alias("first"), F.length("rule"), "rule", "kind", "verdict")
    best = fits.groupBy("url").agg(F.max(rank).alias("best")).select(F.col("url").alias("u"), "best")
    out = pages.select("page_id", "url").join(best, F.col("url") == F.col("u"), "left")
    return out.select(
        "page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
        F.when(F.col("best.kind") == "base", F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )

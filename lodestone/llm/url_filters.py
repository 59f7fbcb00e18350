"""URL filters: pattern rules behind an index of their rarest literal tokens.

A rule is a regular expression over "host/path?query" with the literal tokens that any URL it fits must
have. Each rule is filed under the one of its tokens that fewest URLs have; a URL fetches the rules filed
under its own tokens, and only those run their regular expression. A rule without a token is filed under
the empty token, which every URL has. Everything is joins and SQL functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.stored import broadcast_if_small, read, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block. rank: higher wins; of equal ranks the longer name, then the greater one."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0


def site_rule(verdict: str, place: str) -> Rule:
    """A rule for a host with its subdomains and the paths that start with the rule's path: "example.org/es/"."""
    host, slash, path = place.partition("/")
    host_tokens = re.findall(TOKEN, host.lower())
    bounded = re.findall(TOKEN + "(?![A-Za-z0-9])", (slash + path).lower()) if path.endswith("/") else re.findall(TOKEN + "(?=[^a-z0-9])", (slash + path).lower())
    return Rule(place, verdict, rf"^(?:[^/?]*\.)?{re.escape(host)}(?=[/?]|$){re.escape(slash + path)}", (*host_tokens, *bounded), rank=1)


def pattern_rule(verdict: str, pattern: str, tokens: tuple[str, ...] = ()) -> Rule:
    """A rule by regular expression; tokens: lower-case letter and digit runs that stand alone in every URL that fits."""
    return Rule(pattern, verdict, pattern, tokens)


def wildcard_rule(verdict: str, rule: str) -> Rule:
    """A rule "host/path?parameter": a host with its subdomains, then a path, then a parameter of the query, the last two if given.

    A * stands for any run inside the host, a part of the path or a parameter, ** for any run of the path.
    A path that ends with / fits all below it, another one itself alone. Host and tokens are lower-case.
    """
    place, asked, parameter = rule.partition("?")
    host, slash, path = place.partition("/")
    pieces = [r"(?s)^(?:[^/?]*\.)?", *_runs(host, "[^/?]*"), *_runs(slash + path, "[^/?]*")]
    if asked:
        pieces += [r"[^?]*\?(?:.*&)?" if place.endswith("/") or not slash else r"\?(?:.*&)?", *_runs(parameter, "[^&]*"), r"(?:&|\z)"]
    elif not place.endswith("/"):
        pieces.append(r"(?:\?|\z)" if slash else r"(?:[/?]|\z)")
    # a run of letters and digits stands alone unless a * is at its side
    tokens = re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", rule.lower())
    return Rule(rule, verdict, "".join(pieces), tuple(dict.fromkeys(tokens)))


def _runs(part: str, star: str) -> list[str]:
    return ["[^?]*" if piece == "**" else star if piece == "*" else re.escape(piece) for piece in re.split(r"(\*\*?)", part)]


#: The rules of the query, and patterns for what they leave open.
SITE_RULES = [site_rule("allow", "org/"), site_rule("block", "example.org/es/"), site_rule("block", "example.org/en/1"), site_rule("allow", "com/fr/"), site_rule("block", "com/de/")]
#: Words that a host has alone or between hyphens and dots, and words that a part of a path is.
HOST_WORDS = {
    "adult": "escort escorts hentai nude nudes porn porno pornhub sex sexcam xvideos xxx",
    "gambling": "baccarat bet365 betting blackjack casino casinos gambling jackpot lottery poker roulette slots",
    "pharmacy": "cialis pharma-rx pills tramadol viagra xanax",
    "piracy": "crack cracked keygen piratebay serialkey torrent torrents warez",
    "spam": "clickbait freemoney getrich linkfarm paydayloan replica spam",
    "tracking": "adserver adservice clicktrack doubleclick pixel popunder tracker",
}
PATH_WORDS = {"adult": "escort hentai nude porn sex xxx", "gambling": "casino poker", "pharmacy": "viagra", "piracy": "keygen torrent warez", "tracking": "pixel.gif track.gif"}


#: Places that hold no text worth reading, by host, path and parameter.
PLACES = {
    "account": "*/account/sign-in/ */user/login */users/sign_in */wp-admin/ */wp-login.php *?action=login *?do=register *?return_to=*login*",
    "adult": "*-live-cams.* *-sex-cams.* adult-dating*.* free-porn-*.* live-sex-*.* */free/sex/videos/",
    "api": "*/api/v1/** */feed/rss.xml */wp-json/** */xmlrpc.php *?feed=rss2 *?format=json",
    "copies": "*?add-to-cart=* *?phpsessid=* *?print=1 *?replytocom=* *?share=facebook *?share=twitter */print/version/",
    "gambling": "*-poker-online.* *-online-casino.* online-casino-*.* casino-bonus-*.* free-spins-*.* sports-betting-*.* */casino/bonus/",
    "pharmacy": "buy-*-online.* cheap-*-pills.* no-prescription-*.* */order/cheap/viagra/",
    "piracy": "download-*-torrent.* free-movies-*.* */crack/download/ */full-version/keygen/ */torrent/download/*",
    "search": "*/catalogsearch/result/ */search/results?q=* *?orderby=price *?sort_by=price-ascending",
    "spam": "best-essay-writing-*.* make-money-*.* payday-loans-*.* seo-link-*.* work-from-home-*.*",
    "tracking": "ad-server.* ads-track.* click-track.* google-analytics.com/collect google-analytics.com/__utm.gif facebook.com/tr/ */pagead/ads */track/open.gif */pixel.php?id=* *?ad_click_id=*",
}


def host_word(word: str) -> str:
    return rf"^(?:[^/?]*[.-])?{re.escape(word)}(?:[.-][^/?]*)?(?:[/?]|$)"


def path_word(word: str) -> str:
    return rf"^[^/?]*/(?:[^/?]*/)*{re.escape(word)}(?:[/?]|$)"


PATTERN_RULES = [pattern_rule("block", form(word), tuple(re.findall(TOKEN, word))) for table, form in ((HOST_WORDS, host_word), (PATH_WORDS, path_word)) for words in table.values() for word in words.split()]
PLACE_RULES = [wildcard_rule("block", place) for places in PLACES.values() for place in places.split()]


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A to Z lowered; empty for null or without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """The ? that follows host and path, and all up to #; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1), F.lit(""))


def _tokens(place: Column) -> Column:
    return F.array_distinct(F.array_append(F.regexp_extract_all(F.translate(place, UPPER, LOWER), F.lit(f"({TOKEN})"), 1), F.lit("")))


def filter_urls(urls: DataFrame, rules: list[Rule], otherwise: str = "allow") -> DataFrame:
    """The rows of urls with host, path, rule, verdict; of the rules that fit, the highest rank, then the longest name, then the greatest one, decides.

    rule is null unless a rule of rank 1 (a site rule) decides; pattern is the name of another rule that decided. Null urls and those without :// have an empty host and path, which site rules
    never fit. Repeated urls are judged once and answered on each row; columns of urls with the names
    host, path, rule, pattern or verdict are replaced. An empty table gives an empty result.
    """
    spark = urls.sparkSession
    new, key = ["host", "path", "rule", "pattern", "verdict"], ["host", "path", "_query"]
    own = [c for c in urls.columns if c not in new]
    rows = urls.select(*[F.col(f"`{c}`") for c in own]).withColumn("host", host_of(F.col("url").cast("string"))).withColumn("path", path_of(F.col("url").cast("string"))).withColumn("_query", query_of(F.col("url").cast("string")))
    table = spark.createDataFrame([(r.name, r.verdict, r.pattern, list(r.tokens) or [""], r.rank) for r in rules], "name string, verdict string, pattern string, tokens array<string>, rank int")

    places = rows.select(*key).distinct().withColumn("place", F.concat(*key))
    tokens = places.select(*key, "place", F.explode(_tokens(F.col("place"))).alias("token"))
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    frequency = tokens.join(broadcast_if_small(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    by_token = table.withColumn("token", F.explode("tokens")).join(frequency, "token", "left").withColumn("urls", F.coalesce("urls", F.lit(0)))
    index = by_token.groupBy("name", "verdict", "pattern", "rank").agg(F.min_by("token", F.struct("urls", "token")).alias("token"))
    index = broadcast_if_small(stored(index, "index"))

    fits = tokens.join(index, "token").where(F.expr("place rlike pattern"))
    order = F.struct("rank", F.length("name"), F.translate("name", UPPER, LOWER))
    best = fits.groupBy(*key).agg(F.max_by(F.struct("name", "verdict", "rank"), order).alias("best"))
    answered = rows.join(best, key, "left")
    return answered.select(
        *[F.col(f"`{c}`") for c in own],
        "host",
        "path",
        F.when(F.col("best.rank") == 1, F.col("best.name")).alias("rule"),
        F.when(F.col("best.rank") == 0, F.col("best.name")).alias("pattern"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, [*SITE_RULES, *PATTERN_RULES, *PLACE_RULES]).select("page_id", "host", "path", "rule", "verdict", "pattern")


OP1_SQL = r"""
with parts as (
  select page_id,
         case when url like '%://%' then translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
         case when url like '%://%' then regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') else '' end as path,
         case when url like '%://%' then regexp_extract(url, '^.*?://[^?#]*(\?[^#]*)?', 1, 's') else '' end as query
  from pages),
rules(name, verdict, host_end, path_start) as (
  values ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
         ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
ranked as (
  select p.host, p.path, r.name, r.verdict, row_number() over (partition by p.host, p.path order by length(r.name) desc, r.name desc) as k
  from (select distinct host, path from parts) p join rules r
    on (p.host = r.host_end or ends_with(p.host, '.' || r.host_end)) and starts_with(p.path, r.path_start)),
patterns(name, pattern) as (values PATTERNS),
patterned as (
  select p.place, t.name, row_number() over (partition by p.place order by length(t.name) desc, t.name desc) as k
  from (select distinct host || path || query as place from parts) p join patterns t on regexp_matches(p.place, t.pattern))
select p.page_id, p.host, p.path, r.name as rule, coalesce(r.verdict, case when t.name is null then 'allow' else 'block' end) as verdict,
       case when r.name is null then t.name end as pattern
from parts p left join (select * from ranked where k = 1) r on p.host = r.host and p.path = r.path
left join (select * from patterned where k = 1) t on p.host || p.path || p.query = t.place
""".replace("PATTERNS", ", ".join(f"('{r.name}', '{r.pattern}')" for r in [*PATTERN_RULES, *PLACE_RULES]))

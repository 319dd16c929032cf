"""URL filters: host rules, and pattern rules that are looked up by their rarest literal token.

Each pattern rule names, for each of its alternatives, the literal tokens that any URL which the alternative matches
must hold. The rule is kept under the one of them that fewest URLs of the table hold, once for each alternative; a URL's
tokens fetch the rules kept under them, and only those run their regular expression. Tokens are runs of ASCII letters and digits of the URL in lower case. Rules are a parameter, so their number
doesn't follow the data; only the counts of tokens that rules name come to the driver.

Of the host rules that fit, the longest wins, before any pattern. Of patterns, allow wins over block; without any a URL
is allowed. Defined cases: null URLs and those without :// have an empty host and path and are allowed; repeated rows are
judged each; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import parts

#: (verdict, host, path); fixed by the contract of the host rules.
HOSTS = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@dataclass(frozen=True)
class Rule:
    """`tokens`: whole tokens that every URL which `pattern` matches holds, in lower case. Where alternatives of the
    pattern hold different ones, `others` has the tokens of each alternative after the first."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    others: tuple[tuple[str, ...], ...] = ()


RULES = (
    Rule("block", r"[?&]utm_source=feed(&|#|$)", ("utm", "source", "feed")),
    Rule("block", r"[?&]ref=x(&|#|$)", ("ref", "x")),
    Rule("block", r"://(ads|banner|doubleclick)\.", ("ads",), (("banner",), ("doubleclick",))),
    Rule("block", r"://banner\.", ("banner",)),
    Rule("block", r"/(wp-)?login\.php", ("login",)),
    Rule("block", r"\.exe([?#]|$)", ("exe",)),
    Rule("block", r"[?&]sessionid=[0-9a-f]+", ("sessionid",)),
    Rule("allow", r"://www\.[^/]+/en/[0-9]+\.html\?page=[0-9]+&ref=x$", ("www", "en", "html", "page", "ref", "x")),
)
TOKEN = "[a-z0-9]+"

# Words that a host label or a path segment of an unwanted page holds, by topic.
TERMS = {
    "gambling": "bet bets betting bingo blackjack bookmaker casino casinos gamble gambling jackpot lottery lotto poker roulette slot slots sportsbook wager",
    "adult": "adult cams camgirls escort escorts fetish hentai hookup nsfw nude nudes porn porno sex sexy webcams xxx",
    "drugs": "cialis levitra pill pills steroids tramadol viagra xanax",
    "spam": "backlink backlinks clickbait doorway freebies giveaway linkfarm pbn prizes seo spam spammer sweepstakes winbig",
    "advertising": "ads adserver adservice adtrack affiliate banner banners clickserve doubleclick popunder popup sponsored tracker tracking",
    "fraud": "counterfeit crack cracked cracks keygen malware phish phishing ponzi ransomware replica replicas scam serials warez",
    "lending": "bailout cashadvance fastcash loanshark payday paydayloan paydayloans",
}
# Phrases of pages about such topics that aren't such pages.
ABOUT = ("adult-education", "adult-learning", "anti-spam", "responsible-gambling", "problem-gambling", "sex-education", "anti-phishing",
         "malware-removal", "scam-alert", "seo-guide", "drug-safety")
#: Words that in paths belong to ordinary pages too count in host labels alone.
HOST_ONLY = frozenset("ads adult banner banners bet crack cracks pill pills popup prizes replica seo serials sex slot slots tracker tracking".split())


def term_rules(terms: dict[str, str] = TERMS, about: Iterable[str] = ABOUT) -> tuple[Rule, ...]:
    """A rule for each term in a host label, one for each in a path segment, and allow rules for the phrases; each has
    its words as tokens, for they stand between characters that aren't letters or digits."""
    out = []
    for term in sorted({t for words in terms.values() for t in words.split()}):
        out.append(Rule("block", rf"://([^/?#]*[^a-z0-9/?#])?{term}([^a-z0-9]|$)", (term,)))
        if term not in HOST_ONLY:
            out.append(Rule("block", rf"://[^/?#]*/([^?#]*[^a-z0-9?#])?{term}([^a-z0-9]|$)", (term,)))
    return (*out, *(Rule("allow", rf"://[^?#]*[^a-z0-9?#]{phrase}([^a-z0-9]|$)", tuple(phrase.split("-"))) for phrase in about))


#: The rules for whole tables: terms, and of RULES those that aren't about tracking parameters, which clean pages have too.
PRODUCTION = (*term_rules(), *(r for r in RULES if not set(r.tokens) & {"utm", "ref"}))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SMALL = str.maketrans(_UPPER, _UPPER.lower())


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, verdict: bool = False, rules: Iterable[tuple[str, str, str]] = HOSTS) -> Column:
    """The longest rule that fits host and path, or its verdict; null if none does."""
    out = F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, says if verdict else rule_host + rule_path).otherwise(out)
    return out


def frequencies(urls: DataFrame, rules: Iterable[Rule] = RULES) -> dict[str, int]:
    """URLs that hold each token which a rule names, over all rows."""
    named = sorted({t for r in rules for own in (r.tokens, *r.others) for t in own})
    held = F.array_intersect(F.regexp_extract_all(F.lower("url"), F.lit(TOKEN), 0), F.array(*map(F.lit, named)))
    found = urls.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return dict.fromkeys(named, 0) | {r["token"]: r["n"] for r in found.collect()}


def index(rules: Iterable[Rule], often: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules by the rarest of each alternative's tokens; of equally rare ones, the longest and then the first."""
    out: dict[str, list[Rule]] = {}
    for rule in rules:
        for token in {min(own, key=lambda t: (often[t], -len(t), t)) for own in (rule.tokens, *rule.others)}:
            out.setdefault(token, []).append(rule)
    return out


class Judge:
    def __init__(self, by_token: dict[str, list[Rule]]):
        self.by_token = {t: [(r.verdict, re.compile(r.pattern)) for r in rules] for t, rules in by_token.items()}
        self.tokens = re.compile(TOKEN)

    def verdict(self, url: str | None) -> str | None:
        """Of the patterns that match the URL in lower case (A-Z); null if none does."""
        said, url = None, (url or "").translate(_SMALL)
        for token in set(self.tokens.findall(url)):
            for verdict, pattern in self.by_token.get(token, ()):
                if said != verdict and pattern.search(url):
                    if verdict == "allow":
                        return verdict
                    said = verdict
        return said

    def matching(self, url: str | None) -> set[tuple[str, str]]:
        """Verdict and pattern of every rule that matches."""
        url = (url or "").translate(_SMALL)
        fetched = (r for t in set(self.tokens.findall(url)) for r in self.by_token.get(t, ()))
        return {(verdict, pattern.pattern) for verdict, pattern in fetched if pattern.search(url)}


def hits(pages: DataFrame, rules: tuple[Rule, ...] = PRODUCTION) -> DataFrame:
    """How many URLs each rule's pattern matches: verdict, pattern, n; rules that match none are left out."""
    by_token = index(rules, frequencies(pages, rules))
    urls = pages.select(F.col("url").cast("string").alias("url"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged, counts = Judge(by_token), {}
        for batch in batches:
            for url in batch.column(0).to_pylist():
                for found in judged.matching(url):
                    counts[found] = counts.get(found, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in counts], pa.string()), pa.array([p for _, p in counts], pa.string()),
                                          pa.array(list(counts.values()), pa.int64())], names=["verdict", "pattern", "n"])

    return urls.mapInArrow(run, "verdict string, pattern string, n long").groupBy("verdict", "pattern").agg(F.sum("n").alias("n"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "page_id") -> DataFrame:
    """page_id, host, path, rule (the host rule) and verdict of every row."""
    by_token = index(rules, frequencies(pages, rules))
    source = pages.select(F.col(id_column).alias("page_id"), F.col("url").cast("string").alias("url"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = Judge(by_token)
        for batch in parts(batches, 4096):
            said = pa.array([judged.verdict(u) for u in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, said], names=["page_id", "url", "said"])

    kind = source.schema["page_id"].dataType.simpleString()
    out = source.mapInArrow(run, f"page_id {kind}, url string, said string").withColumns(
        {"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    fits = [host_rule(F.col("host"), F.col("path"), v) for v in (False, True)]
    return out.select("page_id", "host", "path", fits[0].alias("rule"), F.coalesce(fits[1], "said", F.lit("allow")).alias("verdict"))

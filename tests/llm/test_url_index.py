"""The index of URL rules on a URL for each alternative."""

import re

import pytest

from panelwright.llm import urls

URLS = ["http://ads.x.com/", "http://banner.x.com/", "http://doubleclick.com/x", "http://a.b/login.php", "http://a.b/login.php5",
        "http://a.b/wp-login.php", "http://a.b/wp-login.php7?x", "http://a.b/c.exe", "http://a.b/c.exe?d", "http://a.b/c.exe#d",
        "http://a.b/?sessionid=0f", "http://a.b/?c&sessionid=0fz", "http://a.b/?utm_source=feed", "http://a.b/?c&utm_source=feed&d",
        "http://a.b/?utm_source=feed#d", "http://a.b/?ref=x", "http://a.b/?c&ref=x&d", "http://a.b/?ref=x#d",
        "http://www.a.b/en/1.html?page=2&ref=x", "http://a.b/"]


@pytest.mark.parametrize("rare", [None, *sorted({t for r in urls.RULES for t in r.tokens} | {"doubleclick", "banner"})])
def test_the_index_finds_every_alternative(rare):
    """Whichever token is the rarest."""
    often = {t: int(t != rare) for r in urls.RULES for own in (r.tokens, *getattr(r, "others", ())) for t in own}
    judge = urls.Judge(urls.index(urls.RULES, often))
    for url in URLS:
        said = {r.verdict for r in urls.RULES if re.search(r.pattern, url)}
        assert judge.verdict(url) == ("allow" if "allow" in said else "block" if said else None), url
    assert all(any(re.search(r.pattern, u) for u in URLS) for r in urls.RULES)


def made() -> list[str]:
    """A URL for each term in a host label, in a path, and inside another word, with capitals and about-phrases."""
    terms = sorted({t for words in urls.TERMS.values() for t in words.split()})
    out = [u for t in terms for u in (f"http://{t}-x.example.org/fr/1", f"http://M.{t.upper()}.example.com/", f"http://a.b/c/{t}_now?x=1",
                                      f"http://x{t}x.example.org/y{t}y", f"http://a.b/?q={t}", f"{t}.no-scheme/x", f"https://{t}")]
    return out + [f"http://casino.example.com/{a}/x" for a in urls.ABOUT] + ["http://a.b/c#casino", "http://a.b/\u017fex/\u212aeygen", "", "://"]


@pytest.mark.parametrize("rare", ["casino", "sex", "education", None])
def test_the_production_table_equals_running_every_pattern(rare):
    often = {t: int(t != rare) for r in urls.PRODUCTION for own in (r.tokens, *r.others) for t in own}
    judge = urls.Judge(urls.index(urls.PRODUCTION, often))
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    compiled = [(r, re.compile(r.pattern)) for r in urls.PRODUCTION]
    for url in made() + URLS:
        fit = {(r.verdict, r.pattern) for r, p in compiled if p.search(url.translate(small))}
        said = {v for v, _ in fit}
        assert judge.verdict(url) == ("allow" if "allow" in said else "block" if said else None), url
        assert judge.matching(url) == fit, url


def test_hits_are_counted_for_each_rule(spark):
    pages = spark.createDataFrame([("http://casino.a/",), ("http://CASINO.b/",), ("http://a.b/viagra",), (None,), ("http://a.b/?ref=x",)], "url string")
    found = {(r["verdict"], r["pattern"]): r["n"] for r in urls.hits(pages.repartition(3)).collect()}
    assert sorted(found.values()) == [1, 2] and all(v == "block" for v, _ in found)
    assert urls.hits(pages.limit(0)).count() == 0
    assert [r["verdict"] for r in urls.judge(pages.withColumn("page_id", pages.url), urls.PRODUCTION).where("path = '/'").orderBy("host").collect()] == ["allow", "block", "block"]

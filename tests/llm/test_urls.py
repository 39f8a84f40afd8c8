"""URL filters against regular expressions, rule by rule."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tripmart.llm import urls

URLS = [None, "", "nothing", "http://", "https://Example.com", "https://example.com/", "http://www.EXAMPLE.com/en/1?q=/es/",
        "http://m.www.example.com/en/", "http://aexample.com/en/x", "http://example.com/EN/x", "http://a.net/es/1", "http://net/fr/",
        "http://a.net/de/#/es/", "http://a.net?/es/", "http://a.net#x://b.com/", "x://y://example.com/en/", "http://a.com:80/en/",
        "http://spam-farm.example.org/en/728", "http://a.org/x.com/spam", "http://a.org/login?next=1", "http://a.org/a\n.exe",
        "http://ä.org/straße/é.zip", "http://a.org/calendar/2024-01-02/x", "http://a.org/calendar/2024-éé-02", "http://xxx.com/",
        "http://a.org/" + "long/" * 30_000 + "a.exe", "http://a.org/" + "é" * 5000, "http://a.org/en/", "http://a.org/en/"]


def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")


def fits(glob, text):
    return re.fullmatch("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob), text, re.S) is not None


def brute(url, rules=urls.RULES):
    host, path = parts(url)
    best = min(((not r.listed, -(len(r.name) if r.listed else r.literals), i) for i, r in enumerate(rules)
                if fits(r.host, "." + host) and fits(r.path, path)), default=None)
    rule = None if best is None else rules[best[2]]
    return (host, path, rule.name if rule and rule.listed else None, rule.name if rule else None,
            rule.verdict if rule else urls.DEFAULT)


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(i, u, "h", 1.5, [i]) for i, u in enumerate(URLS)],
                               "page_id long, url string, host string, `a.b` double, _rule array<int>").repartition(3)
    got = urls.judge(df)
    assert got.columns == [*df.columns, "_host", "path", "rule", "glob", "verdict"]
    rows = {r.page_id: (r._host, r.path, r.rule, r.glob, r.verdict) for r in got.collect()}
    assert rows == {i: brute(u) for i, u in enumerate(URLS)}
    assert {r.host for r in got.collect()} == {"h"}


def test_longest_listed_rule_wins():
    assert brute("http://example.com/en/")[2::2] == ("example.com/en/", "block")
    assert brute("http://x.www.example.com/en/")[2::2] == ("www.example.com/en/", "allow")
    assert brute("http://spam.com/")[2::2] == ("com/", "allow")
    assert brute("http://spam-farm.example.org/en/728")[2:] == (None, "*spam*/", "block")


def test_no_rows(spark):
    assert urls.judge(spark.createDataFrame([], "url string")).collect() == []


def test_no_rules_but_the_default(spark):
    rules = (urls.Rule("allow", "*", "*", "all"),)
    df = spark.createDataFrame([("http://a.b/c",), (None,)], "url string")
    assert [r.verdict for r in urls.judge(df, rules=rules, default="block").collect()] == ["allow", "allow"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab*?é", max_size=6), st.text("ab*?é", max_size=70)), min_size=1, max_size=9),
       st.lists(st.tuples(st.text("abé", max_size=6), st.text("abé", max_size=70)), max_size=6))
def test_automaton(globs, texts):
    automaton = urls.Automaton(tuple(urls.Rule("block", h, p, "") for h, p in globs))
    data = [b"%b%c%b" % (h.encode(), urls.EDGE, p.encode()) for h, p in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    got = automaton.fits(np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [[fits(gh, h) and fits(gp, p) for gh, gp in globs] for h, p in texts]

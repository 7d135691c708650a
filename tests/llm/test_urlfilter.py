import random

import pytest

from pulsegrid.llm import urlfilter
from pulsegrid.llm.urlfilter import Rule

RULES = [Rule.parse(*r) for r in (
    ("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "spam-farm.example.org/"),
    ("block", "org/en*ref"), ("allow", "a.b"), ("block", "/ad/*/x"), ("block", "a.b/ad"), ("allow", "b/a.d+(1)/"), ("allow", "q/*"),
)]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    rest = rest[len(host) :]
    for c in "?#":
        rest = rest.split(c)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest


def starts(path, pattern):
    head, *more = pattern.split("*")
    if not path.startswith(head):
        return False
    at = len(head)
    for piece in more:
        at = path.find(piece, at)
        if at < 0:
            return False
        at += len(piece)
    return True


def plain(url, rules=RULES):
    host, path = plain_parts(url)
    fits = [r for r in rules if (not r.host or host == r.host or host.endswith("." + r.host)) and starts(path, r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host), r.text, r.says), default=None)
    return host, path, best and best.text, best.says if best else "allow"


def urls(n):
    rng = random.Random(3)
    hosts = ["example.net", "EXAMPLE.net", "a.example.com", "xexample.com", "org", "www.org", "spam-farm.example.org", "a.b", "c.a.b", "net", "net.", "é.net", "", "b", "x:8080", "u@a.b", "q", "a.b\n"]
    paths = ["", "/", "/en/1", "/EN/1", "/de/", "/de", "/fr/x", "/en/y/ref", "/enref", "/ad/1/x", "/ad/x", "/adx", "/a.d+(1)/z", "/a.d1/z", "//de/", "/en/\n/ref"]
    tails = ["", "?x=/en/", "#/fr/", "?a#b"]
    return [rng.choice(["http", "", "ftp", "HTTPS"]) + "://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(tails) for _ in range(n)]


def test_equals_all_rules_on_all_urls(spark):
    some = [None, "", "no scheme", "://", "a://b://c/d", "http://net/" + "a/" * 20000, *urls(3000)]
    rows = [(None if i % 50 == 0 else i, u, "h", "r") for i, u in enumerate(some)]
    rows += rows[:100] + rows[:1] * 300  # repeated rows
    out = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, rule string").repartition(5), RULES)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    key = lambda r: tuple((v is not None, v or 0 if i == 0 else v or "") for i, v in enumerate(r))
    assert sorted(map(tuple, out.collect()), key=key) == sorted([(r[0], *plain(r[1])) for r in rows], key=key)


@pytest.mark.parametrize("rules", [[], [Rule.parse("block", "net/")] * 2])
def test_empty_table_no_rules_and_repeated_rules(spark, rules):
    schema = "page_id long, url string"
    assert urlfilter.judge(spark.createDataFrame([], schema), rules).count() == 0
    got = urlfilter.judge(spark.createDataFrame([(1, "http://x.net/a"), (2, None)], schema), rules, otherwise="block").collect()
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in got) == [(1, "net/" if rules else None, "block"), (2, None, "block")]


def test_rules_are_indexed_by_their_rarest_certain_token(spark):
    found = [(Rule.parse("block", t).tokens) for t in ("a.b/c/d", "a.b/c/d/", "/x*y/z/", "/e", "A-b.c")]
    assert found == [[".a", ".b", "/c"], [".a", ".b", "/c", "/d"], ["/z"], [], [".a", ".b", ".c"]]
    rows = spark.createDataFrame([("com", "/ad/x")] * 5 + [("rare.com", "/ad/")], "host string, path string")
    got = {t["token"]: [r["rule"] for r in t["rules"]] for t in urlfilter.index(rows, [Rule.parse("block", t) for t in ("rare.com/ad/", "com/ad/", "/e")]).collect()}
    assert got == {".rare": ["rare.com/ad/"], ".com": ["com/ad/"], ".": ["/e"]}


def test_only_candidates_meet_regular_expressions(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.com/p{i}/") for i in range(200)], "page_id long, url string")
    host, path = urlfilter.parts(pages["url"])
    rows = pages.select(host.alias("host"), path.alias("path"))
    met = rows.selectExpr("host", "path").withColumn("token", urlfilter.F.explode(urlfilter.tokens(rows["host"], rows["path"]))).join(urlfilter.index(rows, [Rule.parse("block", f"h{i}.com/p{i}/") for i in range(100)]), "token")
    assert met.count() == 100

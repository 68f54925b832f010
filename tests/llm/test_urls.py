"""URL rules against a plain reading of each rule on each URL."""

import random

import pytest

from chronofold.llm import queries, urls
from chronofold.llm.urls import Rule


def split(url):
    if url is None or "://" not in url:
        return "", ""
    after = url.split("://", 1)[1]
    cut = min([after.find(c) for c in "/?#" if c in after], default=len(after))
    host, rest = after[:cut], after[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:cut]


def base_rule(host, path):
    fits = []
    for rule in ("net/", "example.net/en/", "example.com/de/", "org/fr/"):
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append(rule)
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme.net/", "http://", "http://net/", "http://net", "http://NET/x", "http://a.net?/", "http://anet/", "https://m.Example.NET/en/1", "https://example.net/EN/1",
    "https://example.net/en", "http://example.com/de/x", "http://xexample.com/de/", "http://www.example.com/de?x", "http://a.org/fr/#top", "http://a.org/fr", "ftp://x://net/", "http://u@b.net:80/", "http://b.net:80/",
    "http://a/b.net/", "http://casino-win.example.com/", "http://x.com/casino", "http://xcasino.com/", "http://CASINO.net.com/?q", "http://a.com/ads/1", "http://a.com/safe-search/x?ads/", "http://é.net/\n?", "http://a\nb.net/é", "http://a.com/" + "x/" * 40_000 + "ads/",
]


def test_verdicts(spark, tmp_path):
    rows = [(i, u, "<html>", "h", "p", 1) for i, u in enumerate(URLS)] + [(None, "http://b.net/", None, None, None, None)] * 2
    spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string, verdict int").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op11_url_filters(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and [r.rule for r in got if r.page_id is None] == ["net/"] * 2
    for r in got:
        if r.page_id is not None:
            host, path = split(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, base_rule(host, path)), URLS[r.page_id]
            if r.rule:
                assert r.verdict == ("block" if r.rule in ("net/", "example.com/de/") else "allow")
    by = {URLS[r.page_id]: r.verdict for r in got if r.page_id is not None}
    assert by["http://casino-win.example.com/"] == by["http://CASINO.net.com/?q"] == by["http://a.com/ads/1"] == by[URLS[-1]] == "block"
    assert by["http://x.com/casino"] == by["http://xcasino.com/"] == by[None] == by[""] == "allow"
    assert by["http://a.com/safe-search/x?ads/"] == "allow", "the longer pattern wins"


@pytest.mark.parametrize("seed", range(3))
def test_index_loses_no_rule(spark, seed):
    """The rules that the tokens fetch hold all that fit, whatever the patterns look like."""
    rng = random.Random(seed)
    piece = lambda: "".join(rng.choice(["a", "b", "ab", ".", "/", "-", "é", "_"]) for _ in range(rng.randint(1, 5)))
    rules = [Rule("||" + piece(), rng.random() < 0.5) for _ in range(15)]
    rules += [Rule("".join(rng.choice(["^", "*", "+", "|", ""]) + piece() for _ in range(rng.randint(1, 2))) + rng.choice(["", "^", "|"]), True) for _ in range(40)] + [Rule("*", False)]
    table = [(i, "http://" + piece() + rng.choice(["", "/", "?"]) + piece()) for i in range(150)]
    frame = spark.createDataFrame(table, "page_id long, url string")
    index = urls.index_rules(rules, urls.token_counts(frame, set().union(*(r.tokens() for r in rules))))
    assert sorted(i for places in index.values() for i in places) == list(range(len(rules)))
    got = {r.page_id: r for r in urls.judge(frame, [], rules).collect()}
    fewer = 0
    for i, url in table:
        place = "".join(split(url))
        fits = [r for r in rules if r.regex().search(place if r.on_host else url)]
        best = max(len(r.name) for r in fits)
        assert len(got[i].pattern) == best and got[i].pattern in {r.name for r in fits}
        assert got[i].verdict == ("block" if any(r.block for r in fits if len(r.name) == best) else "allow")
        fewer += got[i].n_tried < len(rules)
    assert fewer


def test_rarest_token(spark):
    rules = [Rule("||common.rare.com/", True), Rule("^common^-^other^", True), Rule("*free*", True)]
    frame = spark.createDataFrame([(i, f"http://common.{'rare' if i < 2 else 'x'}.com/") for i in range(9)], "page_id long, url string")
    assert urls.index_rules(rules, urls.token_counts(frame, {"common", "rare", "com", "other"})) == {"rare": [0], "other": [1], "": [2]}


def test_host_without_path(spark):
    frame = spark.createDataFrame([(0, "http://a.b.com"), (1, "http://b.com/x"), (2, "http://b.comx/"), (3, "http://bb.com/")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(frame, [Rule("||b.com", True)], []).orderBy("page_id").collect()] == ["block", "block", "allow", "allow"]


def test_empty(spark):
    frame = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(frame).collect() == [] and urls.judge(frame, [], []).collect() == []

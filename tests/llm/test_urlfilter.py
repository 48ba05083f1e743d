from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest

from stratalog.llm import queries, urlfilter

SF = "/root/testdata/sf0.01"


def brute(url: str | None) -> tuple:
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [h + p for _, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=len, default=None)


URLS = [
    "http://a.example.net/en/1?x=/fr/", "https://EXAMPLE.net/de/", "http://example.network/en/", "http://b.org/fr/x#top", "http://x.org", "http://notnet/", "ftp://net/", "http://x.net?q=1", "http://x.net",
    "no scheme", "", None, "http://", "http:///path", "a://b://c/d", "http://ÉXAMPLE.example.com/de/ü", "http://example.com/de", "http://h\nost/pa\nth?", "http://user@x.net:80/en/", "http://x.net/en/",
]


def test_hosts_paths_and_rules_are_the_brute_force(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").selectExpr("*", "1 host", "2 score")
    for r in urlfilter.judge_urls(pages).collect():
        assert (r["host"], r["path"], r["rule"]) == brute(URLS[r["page_id"]])
    kinds = {h + p: k for k, h, p in urlfilter.RULES}
    source = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = queries.op10_url_filter(spark, SF).collect()
    assert len(out) == len(source)
    for r in out:
        assert (r["host"], r["path"], r["rule"]) == brute(source[r["page_id"]])
        assert r["verdict"] == kinds[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block")


def test_unwanted_hosts_are_blocked_and_others_are_not(spark):
    rows = [r for r in queries.op10_url_filter(spark, SF).collect() if not r["rule"]]
    bad = [r for r in rows if re.search("casino|bets|pills|spam|track|adult", r["host"])]
    assert bad and all(r["verdict"] == "block" for r in bad)
    assert sum(r["verdict"] == "block" for r in rows) - len(bad) <= 0.02 * len(rows)


UNWANTED = "casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills"


@pytest.mark.parametrize("site", UNWANTED)
def test_sites_that_no_seed_lists_are_blocked(spark, site):
    """Each in turn is taken off the list: it is found by how it reads, and no other page is blocked."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    seeds = tuple(w for w in urlfilter.SEEDS if w not in site.split("-"))
    rows = [r for r in urlfilter.judge_urls(pages, seeds=seeds).collect() if not r["rule"]]
    found = [r["verdict"] for r in rows if site in r["host"]]
    assert len(found) > 10 and set(found) == {"block"}
    assert all(r["verdict"] == "allow" for r in rows if not re.search("casino|bets|pills|spam|track|adult", r["host"]))


def plain_score(strings: list[tuple[str, int, bool, bool]]) -> dict[str, float]:
    """Scores by the definition of the two models: strings are (shape, weight, accepted, rejected)."""

    def probabilities(learned):
        counts = defaultdict(Counter)
        for shape, weight in learned:
            text = f"^{shape}$"
            for i in range(1, len(text)):
                for k in range(min(i, urlfilter.ORDER) + 1):
                    counts[text[i - k : i]][text[i]] += weight / urlfilter.SCALE

        def p(context, char):
            if context is None:
                return 1 / urlfilter.ALPHABET
            lower = p(context[1:] if context else None, char)
            seen = counts.get(context)
            return (seen[char] + len(seen) * lower) / (sum(seen.values()) + len(seen)) if seen else lower

        return p

    a, r = (probabilities([(s, w) for s, w, *k in strings if k[i]]) for i in (0, 1))
    out = {}
    for shape, *_ in strings:
        text = f"^{shape}$"
        steps = [(text[max(0, i - urlfilter.ORDER) : i], text[i]) for i in range(1, len(text))]
        out[shape] = sum(math.log(r(*x) / a(*x)) for x in steps) / len(steps)
    return out


def test_scores_are_the_brute_force(spark):
    shapes = {r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").limit(40).collect()} | {"", "a", "é漢字x"}
    strings = [(s, 693 + 100 * (i % 5), i % 3 != 0, i % 3 == 0) for i, s in enumerate(sorted(shapes))]
    df = spark.createDataFrame([(*x, i % urlfilter.FOLDS) for i, x in enumerate(strings)], "shape string, weight long, accepted boolean, rejected boolean, fold int")
    got = {r["shape"]: r["score"] for r in urlfilter.score_shapes(df).collect()}
    want = plain_score(strings)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    apart = {r["shape"]: r["score"] for r in urlfilter.score_shapes(df, folds=True).collect()}
    for fold in range(urlfilter.FOLDS):
        others = plain_score([(s, w, a and i % urlfilter.FOLDS != fold, r and i % urlfilter.FOLDS != fold) for i, (s, w, a, r) in enumerate(strings)])
        assert all(abs(apart[s] - others[s]) < 1e-6 for i, (s, *_) in enumerate(strings) if i % urlfilter.FOLDS == fold)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "http://x/"), (1, "http://x/")]])
def test_edges(spark, rows):
    out = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(out) == len(rows) and all(r["verdict"] == "allow" for r in out)


def test_very_long_url(spark):
    out = urlfilter.judge_urls(spark.createDataFrame([(1, "http://x.com/" + "a" * 50_000), (2, "http://casino.com/")], "page_id long, url string"))
    assert out.count() == 2


def test_models_read_the_whole_url(spark):
    good = [f"http://{n}.example.com/news/{i}" for i, n in enumerate(["gardens", "history", "science", "letters"] * 30)]
    bad = [f"http://{n}{i % 3}.example.com/{i}" for i, n in enumerate(["best-casino", "casino-club", "cheap-pills", "poker-bonus"] * 30)]
    asked = ["http://go.example.com/out?to=casino-club", "http://go.example.com/out?to=history-news", "http://go.example.com/out#casino-club", "best-casino club", "history news", None]
    pages = spark.createDataFrame([*enumerate(good + bad), *((1000 + i, u) for i, u in enumerate(asked))], "page_id long, url string")
    score = {r["page_id"]: r["score"] for r in urlfilter.judge_urls(pages, rules=()).collect()}
    assert score[1000] > score[1001] < score[1002] and score[1003] > score[1004]
    assert score[1003] != score[1005] != score[1004]

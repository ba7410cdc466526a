import random
import re

import pytest

from plumbline.llm import url_filter
from plumbline.llm.url_filter import HostRule, PatternRule


@pytest.mark.parametrize(
    ("glob", "tokens", "fits", "not_fits"),
    [
        ("||ads-track.", ["ads", "track"], ["http://ads-track.x.com/", "https://m.ads-track.com"], ["http://xads-track.com/", "http://x.com/ads-track."]),
        ("/casino/", ["casino"], ["http://x.com/casino/1"], ["http://x.com/casinos/"]),
        ("/banner/*/ad_", ["ad", "banner"], ["http://x/banner/1/2/ad_3"], ["http://x/banner/ad_"]),
        ("pop*up^", [], ["http://x/popXup/", "http://x/popup"], ["http://x/popups"]),
        ("|https://x.", ["https", "x"], ["https://x.com/"], ["http://x.com/", "y|https://x."]),
        ("@@/pic.gif|", ["gif", "pic"], ["http://x/pic.gif"], ["http://x/pic.gif?1"]),
        ("||x.com^", ["com", "x"], ["http://x.com", "http://x.com:80/"], ["http://x.community"]),
    ],
)
def test_globs(glob, tokens, fits, not_fits):
    rule = PatternRule(glob)
    assert rule.tokens == tokens
    assert all(re.search(rule.regex, u) for u in fits) and not any(re.search(rule.regex, u) for u in not_fits)


@pytest.mark.parametrize("extra", [(), ("*",), ("@@||b.a.", "h*p")])
def test_index_finds_what_testing_every_rule_finds(spark, monkeypatch, extra):
    hosts = (HostRule("com", "", "allow"), HostRule("a.com", "x/", "block"), HostRule("net", "x/y/", "allow"))
    globs = tuple(map(PatternRule, ("||ads.", "/x/", "track*er", *extra, "q=1")))
    urls = [f"{s}{h}{p}" for s in ("http://", "", "HTTP://") for h in ("a.com", "b.A.com", "ads.net", "net", "x.org", "") for p in ("", "/", "/x/", "/x/y/z?q=1", "?q=1", "/trackXer#x/")] + [None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def by_hand(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        found = [r for r in hosts if host and (host == r.host or host.endswith("." + r.host)) and path.startswith("/" + r.path)]
        if found:
            best = max(found, key=lambda r: len(r.name))
            return best.name, best.verdict
        fits = {g.verdict for g in globs if url is not None and re.search(g.regex, url.lower())}
        return None, "block" if fits == {"block"} else "allow"

    for bound in (50_000, 0):  # broadcast and shuffled index
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", bound)
        rows = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judged(pages, hosts, globs).collect()}
        assert rows == {i: by_hand(u) for i, u in enumerate(urls)}


def test_rarest_token_is_the_key(spark):
    urls = spark.createDataFrame([(f"http://x/{i}", ["t:common", "t:seldom"] if i == 0 else ["t:common"]) for i in range(5)], "url string, __keys array<string>")
    rows = url_filter.index(urls, (), (PatternRule("/common/seldom/"), PatternRule("*a*"))).collect()
    assert {(r["rule"], r["key"]) for r in rows} == {("/common/seldom/", "t:seldom"), ("*a*", "*")}


def test_filter_lists_are_read(spark, tmp_path):
    (tmp_path / "list.txt").write_text("[Adblock Plus 2.0]\n! comment\n||Ads.example^\n@@||ads.example/ok/\nx.com##.banner\n/popup.$third-party\n\n|http://tracker|\n||ads.example^\n*\n")
    rules = url_filter.load_pattern_rules(spark, str(tmp_path / "list.txt"))
    assert [r.glob for r in rules] == ["||ads.example^", "@@||ads.example/ok/", "|http://tracker|"]


def test_thousands_of_rules_equal_testing_each_and_pages_are_not_shuffled(spark):
    rng = random.Random(27)
    word = lambda: rng.choice(["ads", "track", "img", "shop", "news", "pop", "go", "x1", "banner", "cdn"]) + rng.choice(["", "", str(rng.randrange(300))])
    shapes = (lambda: f"||{word()}.{word()}^", lambda: f"/{word()}/{word()}.", lambda: f"/{word()}/*/{word()}^", lambda: f"@@||{word()}.com/{word()}/", lambda: f"{word()}*{word()}0", lambda: f"|http://{word()}.")
    globs = tuple(map(PatternRule, dict.fromkeys(rng.choice(shapes)() for _ in range(3000))))
    hosts = tuple(HostRule(f"{word()}.com", f"{word()}/", rng.choice(["allow", "block"])) for _ in range(200))
    urls = [f"http://{word()}.{word()}.com/{word()}/{word()}/{word()}.gif" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_filter.judged(pages, hosts, globs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "from_json" not in plan
    tested = [(re.compile(g.regex), g.verdict) for g in globs]
    for r in found.collect():
        fits = [h for h in hosts if (r["host"] == h.host or r["host"].endswith("." + h.host)) and r["path"].startswith("/" + h.path)]
        verdicts = {v for regex, v in tested if regex.search(r["url"].lower())}
        if fits:
            longest = max(len(h.name) for h in fits)
            assert len(r["rule"]) == longest and r["verdict"] in {h.verdict for h in fits if len(h.name) == longest}
        else:
            assert r["rule"] is None and r["verdict"] == ("block" if verdicts == {"block"} else "allow")

import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from ruleharbor.llm import url_rules
from ruleharbor.llm.common import table

URLS = [
    "http://a.org/", "HTTP://WWW.Example.ORG/es/1?x=http://b.com/de/", "https://example.org/en/17#f", "http://example.org",
    "http://org/x", "http://notexample.org/es/", "http://xorg/", "http://m.a.com/fr/", "http://com/de/1", "http://a.com/de",
    "no url at all", "", None, "http://", "://x.org/y", "http://a.org:80/", "http://u@a.com/fr/x?de", "http://a.com?q=/fr/",
    "http://É.com/fr/", "a://b://c.org/", "http://x.com/fr/\n/y", "http://x.net/fr/",
]


def by_hand(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None)))


def test_given_rules_by_hand(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rows = {r.page_id: r for r in url_rules.judge(pages).collect()}
    for i, url in enumerate(URLS):
        host, path, rule, verdict = by_hand(url)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), url
        assert rows[i].verdict == verdict if verdict else rows[i].verdict in ("allow", "block")


def rules_by_hand(rows, support, confidence):
    """All rules over items of any length, from the pages themselves: (items, verdict) -> (confidence, support)."""
    labelled = [(tokens, verdict) for tokens, verdict, n in rows if verdict for _ in range(n)]
    baskets = {}
    for i, (tokens, _) in enumerate(labelled):
        for t in tokens:
            baskets.setdefault(t, set()).add(i)
    first = {}
    for t in sorted(baskets):
        first.setdefault(frozenset(baskets[t]), t)
    item = {t: first[frozenset(b)] for t, b in baskets.items()}
    need, both, share = Counter(), Counter(), Counter(v for _, v in labelled)
    for tokens, verdict in labelled:
        own = sorted({item[t] for t in tokens})
        for n in range(1, len(own) + 1):
            for part in combinations(own, n):
                need[part] += 1
                both[part, verdict] += 1
    rules = {}
    for (part, verdict), n in both.items():
        sure = n / need[part]
        if n >= -(-support * len(labelled) // 1) and sure >= confidence and sure > share[verdict] / len(labelled):
            rules[part, verdict] = sure, n / len(labelled)
    kept = {(part, v): x for (part, v), x in rules.items() if not any(
        rules.get((less, v), (-1,))[0] >= x[0] for n in range(1, len(part)) for less in combinations(part, n))}
    return kept, item, max(sorted(share), key=lambda v: share[v]), share


def check_by_hand(spark, pages, support, confidence):
    urls = url_rules.parsed(pages).cache()
    rows = urls.collect()
    kept, item, usual, _ = rules_by_hand([(r.tokens, r.given and r.given.verdict, r.n) for r in rows], support, confidence)
    mined, default, _ = url_rules.mine(urls, support, confidence)
    assert default == usual
    assert {(tuple(r.need), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in mined.collect()} == {
        k: (round(c, 9), round(s, 9)) for k, (c, s) in kept.items()}
    judged = {r.url: r for r in pages.select("page_id", "url").join(url_rules.judge(pages, support, confidence), "page_id").collect()}
    for r in rows:
        if r.given is None:
            own = {item[t] for t in r.tokens if t in item}
            fits = [(x, v) for (part, v), x in kept.items() if set(part) <= own]
            best = max((x for x, _ in fits), default=None)
            assert judged[r.url].verdict in ({v for x, v in fits if x == best} if fits else {default})
    urls.unpersist()
    return kept


def test_mined_rules_and_verdicts_by_brute_force(spark):
    check_by_hand(spark, table(spark, "/root/testdata/sf0.01", "pages"), 0.05, 0.8)


def test_long_rules_and_repeated_urls_by_brute_force(spark, monkeypatch):
    """Rules of four tokens, and a url that a third of all pages carry."""
    monkeypatch.setattr(url_rules, "PAGES", 7)
    paths = ["/".join(x if i >> k & 1 else "" for k, x in enumerate("abcd")) for i in range(16)]
    urls = [f"http://x{i % 3}.com/{'de' if i % 16 == 15 else 'fr'}/{paths[i % 16]}/z" for i in range(96)]
    urls += ["http://x.com/de/a/b/c/d"] * 60 + [f"http://y.net/{p}/z" for p in paths] + ["http://u.net/long/" + "/".join(f"s{k}x" for k in range(30))]
    urls += [f"http://v.com/de/{'/'.join(f's{k}x' for k in range(30))}/{i}" for i in range(12)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    kept = check_by_hand(spark, pages, 0.02, 0.9)
    assert max(len(part) for part, _ in kept) >= 4
    judged = {r.page_id: r.verdict for r in url_rules.judge(pages, 0.02, 0.9).collect()}
    assert judged[96 + 60 + 16] == "block"  # thirty steps in common are one item


def test_odd_pages(spark):
    shape = "page_id long, url string, html string"
    pages = spark.createDataFrame([(1, None, None), (None, "http://a.org/x", None), (None, "http://a.org/x", None),
                                   (2, "", "")], shape).withColumns({"host": F.lit(1), "verdict": F.lit("no"), "tokens": F.lit(2)})
    rows = url_rules.judge(pages).collect()
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in rows) == [
        ("1", "", "", "None", "allow"), ("2", "", "", "None", "allow"),
        ("None", "a.org", "/x", "org/", "allow"), ("None", "a.org", "/x", "org/", "allow")]
    assert url_rules.judge(pages.where("false")).count() == 0


def test_main_path_runs_no_python(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    plan = url_rules.judge(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

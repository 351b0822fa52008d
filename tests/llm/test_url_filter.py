import random

from gavelspark.llm import url_filter as urls
from gavelspark.llm.queries import ALL
from tests.llm.cases import prose

FOLDER = "/root/testdata/sf0.01"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in host), path[:end]


def ruled(host, path):
    fit = []
    for kind, rule in urls.RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fit.append((len(rule), rule, kind))
    return max(fit)[1:] if fit else (None, None)


def check(found, source):
    assert len(found) == len(source)
    for r in found:
        host, path = parts(source[r.page_id])
        text, kind = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, text)
        assert r.verdict == (kind or ("block" if r.score >= 0.5 else "allow"))


def test_query_follows_rules_and_catches_the_rest(spark):
    source = {r.page_id: r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    found = ALL["op8_url_filters"](spark, FOLDER).collect()
    check(found, source)
    free = [r for r in found if r.rule is None]
    assert all((r.verdict == "block") == any(t in r.host for t in ("spam-", "casino-", "pills", "-bets", "adult-", "ads-")) for r in free)


def test_odd_urls(spark):
    rows = [None, "", "nothing", "://", "http://", "http://a.COM", "http://a.com/", "HTTP://WWW.Example.Com/en/x?y=/z#f", "http://example.com/en/", "http://xexample.com/en/",
            "http://b.example.com/en/1", "http://net/es/", "http://c.net/fr/a", "http://c.net/fr", "http://d.net/es?x", "http://a.com:80/en/", "http://a\nb.com/\nx?q://z.net/es/",
            "x://y://z", "http://é.com/é#é", "http://" + "a." * 3000 + "com/" + "p/" * 5000 + "?" + "a=b&" * 3000]
    pages = spark.createDataFrame([(k, u, "h", "p", 1.0) for k, u in enumerate(rows)], "page_id long, url string, host string, path string, score double")
    trees = urls.fit(urls.seeded(spark.createDataFrame([(u,) for u in ["http://a-casino.com/", "http://b.com/", "http://c-bets.org/1", "http://d.org/2"] * 9], "url string")))
    check(urls.judged(pages, trees).collect(), dict(enumerate(rows)))
    assert urls.judged(pages.where("false"), trees).count() == 0


def test_trees_learn_and_hold_out(spark):
    rng = random.Random(1)
    word = lambda k: prose(k, 1).split("x")[0]
    good = [(f"https://{word(k)}.site.org/{word(k + 7)}/{k}", 0.0) for k in range(600)]
    bad = [(f"http://{word(k)}-{k}-win.biz/{'/'.join(str(rng.random()) for _ in range(3))}?a={k}&b=2&c=3", 1.0) for k in range(300)]
    rows = good + bad
    rng.shuffle(rows)
    train = spark.createDataFrame(rows[:600] + [(None, 1.0)], "url string, label double")
    trees = urls.fit(train)
    test = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows[600:])], "page_id long, url string")
    found = {r.page_id: r.verdict for r in urls.judged(test, trees, ()).collect()}
    right = sum((found[k] == "block") == (label == 1.0) for k, (_, label) in enumerate(rows[600:]))
    assert right >= 0.97 * len(found)
    plan = urls.judged(test, trees)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_labels_of_one_kind(spark):
    labelled = spark.createDataFrame([("http://a.com", 0.0)], "url string, label double")
    for given in (labelled, labelled.where("false")):
        found = urls.judged(spark.createDataFrame([(1, "http://x-casino.org")], "page_id long, url string"), urls.fit(given)).collect()
        assert [(r.rule, r.verdict) for r in found] == [(None, "allow")]

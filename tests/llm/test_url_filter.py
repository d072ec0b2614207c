import random

from leaselake.llm import url_filter as U

RULES = [("allow", "com", "/"), ("block", "bad.com", "/en/"), ("allow", "www.bad.com", "/en/"), ("block", "net", "/es/")]


def plain(url):
    """Host, path and rule by the wording."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


URLS = [
    None, "", "no scheme/x", "http://", "http://A.Com/x?y#z", "https://bad.com/en/1", "https://www.bad.com/en/1?a=1&b=2", "https://m.bad.com/fr/",
    "http://x.net/es/", "http://x.net?es/", "http://notcom/", "http://com/", "ftp://a://b.com/x", "http://x.org#/y", "http://É.com/é\n/x", "://com/a",
]


def table(spark, urls):
    return spark.createDataFrame([(i, u, "own rule") for i, u in enumerate(urls)], "page_id long, url string, rule string")


def test_rules(spark):
    rng = random.Random(3)
    urls = URLS + [f"http://{rng.choice(['a.', ''])}{rng.choice(['bad.com', 'com', 'net', 'org'])}{rng.choice(['/en/', '/es/x', '', '?q'])}" for _ in range(100)]
    got = {r.page_id: r for r in U.judge(table(spark, urls), RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")


def test_trees_learn_what_rules_block(spark):
    rng = random.Random(9)
    good = [f"https://site{i % 9}.com/{rng.randint(1, 9)}" for i in range(150)]
    bad = [f"http://x-{rng.getrandbits(60)}-{rng.getrandbits(40)}.net/es/{rng.getrandbits(50)}?a={i}&b=1&c=2" for i in range(150)]
    unknown = [f"https://site{i}.org/{i}" for i in range(9)] + [f"http://x-{rng.getrandbits(60)}-{rng.getrandbits(40)}.org/{rng.getrandbits(50)}?a={i}&b=1&c=2" for i in range(9)]
    got = U.judge(table(spark, good + bad + unknown), RULES).collect()
    verdicts = [r.verdict for r in sorted(got, key=lambda r: r.page_id)][-18:]
    assert verdicts == ["allow"] * 9 + ["block"] * 9


def test_awkward_tables(spark):
    same = U.judge(table(spark, ["http://a.com/", "http://x.org", None]), RULES).collect()
    assert {r.verdict for r in same} == {"allow"}
    assert {r.verdict for r in U.judge(table(spark, ["http://a.net/es/", "http://x.org"]), RULES).collect()} == {"block"}
    assert U.judge(table(spark, URLS).limit(0), RULES).count() == 0
    twice = table(spark, ["http://a.com/"] * 5 + ["http://a.net/es/" + "x" * 50_000] * 5 + ["http://x.org"])
    assert U.judge(twice.withColumn("page_id", twice.page_id * 0), RULES).count() == 11


def test_limit_by_trying_all():
    rng = random.Random(5)
    for n in (2, 5, 40):
        scored = [(rng.randint(0, 20) / 20, float(rng.random() < 0.5)) for _ in range(n)] + [(0.3, 0.0), (0.6, 1.0)]
        quality = lambda t: sum(s >= t for s, y in scored if y) / sum(y for _, y in scored) + sum(s < t for s, y in scored if not y) / sum(1 - y for _, y in scored)
        inner = sorted({s for s, _ in scored})[1:]
        assert abs(quality(U.best_limit(scored)) - max(map(quality, inner))) < 1e-12
    assert U.best_limit([(0.9, 1.0)]) == U.best_limit([]) == 0.5


def test_features_by_hand(spark):
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    urls = ["https://a-b1.example.com/x/y-2?p=1&q=22;r", "", "http://com", "aaaa"]
    host, path = U.parts(F.col("url"))
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumns({"host": host, "path": path})
    got = df.select("url", "host", "path", *[c.cast("double").alias(n) for n, c in U._lexical(F.col("url")).items()]).collect()

    def bits(text):
        return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0

    for r in got:
        want = {
            "length": len(r.url), "host_length": len(r.host), "path_length": len(r.path), "depth": r.path.count("/"), "labels": r.host.count("."),
            "hyphens": r.host.count("-"), "digits": sum(c.isdigit() for c in r.url) / len(r.url) if r.url else 0, "host_digits": sum(c.isdigit() for c in r.host),
            "entropy": bits(r.url), "host_entropy": bits(r.host), "parameters": 1 + r.url.count("&") + r.url.count(";") if "?" in r.url else 0,
        }
        assert all(abs(r[n] - v) < 1e-9 for n, v in want.items()), r


def test_limit_of_a_table_by_the_list(spark):
    rng = random.Random(7)
    for n, parts in ((1, 20), (60, 20), (300, 100_000)):
        scored = [(rng.randint(0, parts) / parts, float(rng.random() < 0.4)) for _ in range(n)] + [(0.0, 0.0), (1.0, 1.0)]
        assert U.limit_of(spark.createDataFrame(scored, "score double, label double")) == U.best_limit(scored)
    for scored in ([(0.9, 1.0)], [(0.5, 1.0), (0.5, 0.0)], []):
        assert U.limit_of(spark.createDataFrame(scored, "score double, label double")) == 0.5


def test_fits_see_all_decided_urls(spark, monkeypatch):
    """More URLs than a fit once took, and more than the limit was once taken from."""
    from pyspark.sql import functions as F

    n = 20_400
    urls = spark.range(n + 7).select(
        F.col("id").alias("page_id"),
        F.when(F.col("id") >= n, "http://x.org/").when(F.col("id") % 3 == 0, F.concat(F.lit("http://a.net/es/"), "id"))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("http://bad.com/en/"), "id")).otherwise(F.concat(F.lit("http://b.com/"), "id")).alias("url"),
    )
    fit, seen, limits = U._fit, [], []

    def counted(rows, names, trees):
        seen.append((trees, rows.count()))
        return fit(rows, names, 1)

    monkeypatch.setattr(U, "_fit", counted)
    limit_of = U.limit_of
    monkeypatch.setattr(U, "limit_of", lambda scored: limits.append(scored.count()) or limit_of(scored))
    assert U.judge(urls, RULES).count() == n + 7
    assert [rows for trees, rows in seen if trees == U.TREES] == [n]
    # Two blocking rules are left out in turn, and the only allowing one half by half: each URL once.
    assert limits == [n] and sum(n - rows for trees, rows in seen if trees == U.LIMIT_TREES) == n

from pyspark.sql import functions as F

from sparkcohort.llm.reputation import host_groups, judge_urls


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")


def test_rules_hosts_and_paths(spark, labels):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.ORG/en/1x?q#f", "http://example.org/es/", "http://example.org", "https://x.com/fr/9", "https://x.com/de/9", "https://x.net/de/9", "http://notexample.org/es/1", "a://b://c/d", "http://h?x/y", "http://h#x/y", "http://É.com/FR/", "http://com/fr/1"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages(spark, urls), labels).collect()}
    want = [("", "", None), ("", "", None), ("", "", None), ("www.example.org", "/en/1x", "example.org/en/1"), ("example.org", "/es/", "example.org/es/"), ("example.org", "", None), ("x.com", "/fr/9", "com/fr/"), ("x.com", "/de/9", "com/de/"), ("x.net", "/de/9", None), ("notexample.org", "/es/1", "org/"), ("b:", "//c/d", None), ("h", "", None), ("h", "", None), ("É.com", "/FR/", None), ("com", "/fr/1", "com/fr/")]
    assert [got[i][:3] for i in range(len(urls))] == want
    assert [got[i][3] for i in (3, 4, 6, 7, 9)] == ["block", "block", "allow", "block", "allow"]


def test_bad_hosts_are_blocked_and_rare_ones_lean_on_their_domain(spark):
    urls, told = [], []
    for h, (good, bad) in {"good.fine.net": (60, 2), "bad.foul.net": (3, 60), "new.fine.net": (0, 0), "one.foul.net": (1, 0), "other.fine.net": (40, 1), "worse.foul.net": (0, 50)}.items():
        for k in range(good + bad):
            told.append((len(told), int(k < good)))
            urls.append(f"http://{h}/en/{len(told) - 1}.html")
    urls.append("http://new.fine.net/en/none")
    labels = spark.createDataFrame([*told, (0, None), (0, 1)], "doc_id long, quality int")
    got = {r.host: r.verdict for r in judge_urls(pages(spark, urls), labels).collect()}
    assert got == {"good.fine.net": "allow", "bad.foul.net": "block", "new.fine.net": "allow", "one.foul.net": "block", "other.fine.net": "allow", "worse.foul.net": "block"}


def test_empty(spark, labels):
    assert judge_urls(pages(spark, ["x"]).limit(0), labels).count() == 0
    assert [r.verdict for r in judge_urls(pages(spark, ["http://a.b/"]), labels.limit(0)).collect()] in (["allow"], ["block"])


def test_ports_suffixes_repeated_pages_and_long_urls(spark, labels):
    hosts = ["a.b.co.uk:8080", "b.co.uk", "x.y.com:80", "com", "", "co.uk"]
    groups = spark.createDataFrame([(h,) for h in hosts], "h string").select(*host_groups(F.col("h"))).collect()
    assert [tuple(r) for r in groups] == [("co.uk", "b.co.uk"), ("co.uk", "b.co.uk"), ("com", "y.com"), ("com", "com"), ("", ""), ("co.uk", "co.uk")]
    urls = ["http://z.net/en/1"] * 3 + ["http://" + "h" * 100_000 + ".net/" + "p" * 100_000, "http://z.net:81/" + "?" * 1000]
    rows = judge_urls(pages(spark, urls).unionByName(pages(spark, urls)), labels).collect()
    assert len(rows) == 10 and len({(r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows}) == 5
    nulls = spark.createDataFrame([(1, None), (None, 1), (None, None)], "doc_id long, quality int")
    assert judge_urls(pages(spark, urls), nulls).count() == 5

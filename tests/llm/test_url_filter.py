import duckdb
from pyspark.sql import functions as F

from phonolith.llm import url_filter as U
from phonolith.llm.common import mark


def judged(spark, urls, outcomes=(), **options):
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame(list(outcomes), "page_id long, good int")
    return {r["page_id"]: r for r in U.judged(pages, labels, **options).collect()}


def test_hosts_paths_and_rules(spark):
    cases = [
        (None, "", "", None),
        ("no scheme/x", "", "", None),
        ("http://A.Com", "a.com", "", None),
        ("http://a.com/", "a.com", "/", "com/"),
        ("http://m.Example.com/en/1?x=/en/#y", "m.example.com", "/en/1", "example.com/en/"),
        ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/"),
        ("https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/"),
        ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/"),
        ("http://a.net/es/q", "a.net", "/es/q", "net/es/"),
        ("http://a.net/EN/q", "a.net", "/EN/q", None),
        ("http://net/fr/", "net", "/fr/", "net/fr/"),
        ("http://u:p@h.org:80?q://z", "u:p@h.org:80", "", None),
        ("http://h.org/a://b", "h.org", "/a://b", None),
        ("http://", "", "", None),
    ]
    got = judged(spark, [c[0] for c in cases])
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i][mark("host")], got[i][mark("path")], got[i][mark("rule")]) == (host, path, rule), cases[i]
        assert got[i][mark("verdict")] == dict(U.RULES).get(rule, "allow")
        assert got[i]["host"] == "kept"


def test_bad_hosts_are_blocked_and_unknown_ones_follow_their_domain(spark):
    urls = [f"http://bad.spam.org/{i}" for i in range(40)] + [f"http://h{i % 8}.fine.org/{i}" for i in range(80)]
    new = ["http://new.spam.org/1", "http://new.fine.org/1", "http://once.fine.org/1"]
    outcomes = [(i, 0) for i in range(40)] + [(i, 1) for i in range(40, 120)] + [(122, 0), (3, None), (999, 0)]
    got = judged(spark, urls + new, outcomes)
    assert {got[i][mark("verdict")] for i in range(40)} == {"block"}
    assert {got[i][mark("verdict")] for i in range(40, 120)} == {"allow"}
    assert got[121][mark("verdict")] == "allow"
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(5, urls[5]), (None, urls[50])], "page_id long, url string")
    kept = U.keep_allowed(pages, spark.createDataFrame(outcomes, "page_id long, good int"))
    assert kept.count() == 81 and kept.columns == ["page_id", "url"]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, good int")
    assert U.judged(pages, labels).count() == 0


def test_registered_domains_and_suffixes(spark):
    cases = {
        "a.b.example.org": ("example.org", "org"),
        "a.example.co.uk": ("example.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "h.org:80": ("h.org", "org"),
        "u:p@x.h.org.:443": ("h.org", "org"),
        "u@v@h.org:": ("h.org", "org"),
        "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1"),
        "[2001:db8::1]:443": ("[2001:db8::1]", "[2001:db8::1]"),
        "localhost": ("localhost", "localhost"),
        "": ("", ""),
    }
    names = spark.createDataFrame([(h,) for h in cases], "host string").withColumn("name", U.name_of(F.col("host")))
    got = {r["host"]: (r["d"], r["s"]) for r in names.select("host", U.domain_of(F.col("name")).alias("d"), U.suffix_of(F.col("name")).alias("s")).collect()}
    assert got == cases


def test_a_bad_domain_is_blocked_but_not_its_public_suffix(spark):
    urls = [f"http://h{i}.spam.co.uk:80/" for i in range(60)] + [f"http://site{i}.co.uk/" for i in range(60)]
    new = ["http://new.spam.co.uk/", "http://other.co.uk/", "http://u@new.spam.co.uk:8080/x"]
    got = judged(spark, urls + new, [(i, 0) for i in range(60)] + [(i, 1) for i in range(60, 120)])
    assert [got[i][mark("verdict")] for i in (120, 121, 122)] == ["block", "allow", "block"]
    assert got[120][mark("n")] == 0 and 0 < got[120][mark("mean")] < got[120][mark("upper")] < 0.5


def test_very_long_urls_and_rules_of_equal_length(spark):
    long = "http://a.net/es/" + "x" * 500_000
    got = judged(spark, [long, "http://" + "b." * 100_000 + "com/", "http://" + ":1" * 100_000, "http://x.com/q/"], rules=(("net/es/", "block"), ("x.com/q/", "allow"), ("x.com/q/", "block")))
    assert [got[i][mark("verdict")] for i in range(4)] == ["block", "allow", "allow", "allow"]
    assert got[0][mark("path")] == long[len("http://a.net") :]


def test_the_query_and_its_sql(spark):
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    want = con.sql(U.ORACLE["op6_url_filters"])
    got = U.op6_url_filters(spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())

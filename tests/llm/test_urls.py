from tallyspark.llm import urls
from tallyspark.llm.common import BITS_PER_KEY
from tallyspark.llm.urls import Rule


def judge(spark, rows, listed, rules=urls.RULES):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(rows)], "page_id long, url string, _host string")
    lists = spark.createDataFrame([(u,) for u in listed], "url string")
    return {r.page_id: r for r in urls.filter_urls(pages, lists, rules).collect()}


def test_rules_by_host_and_path(spark):
    rows = [None, "", "no scheme", "http://A.Net/x", "http://net", "http://net/", "http://x.example.net/en/1", "http://x.example.net/en", "http://notexample.com/de/", "ftp://Example.COM/de/a?b#c", "http://example.com?x=/de/", "http://a.org/fr/9", "x://y://net/"]
    got = judge(spark, rows, [])
    assert [got[i].url_rule for i in range(len(rows))] == [None, None, None, "net/", None, "net/", "example.net/en/", "net/", None, "example.com/de/", None, "org/fr/", None]
    assert (got[9].url_host, got[9].url_path) == ("example.com", "/de/a")
    assert (got[0].url_host, got[2].url_path, got[0].url_verdict) == ("", "", "allow")
    assert got[12].url_host == "y:"
    assert got[3]._host == "x"  # an input column of a clashing name is kept


def test_list_is_exact_for_any_filter_size(spark, monkeypatch):
    listed = [f"https://www.site{i}.com/p/{i}/?utm_source=a" for i in range(3000)] + [None, "junk"]
    rows = [f"http://site{i}.com:80/p/{i}#z" for i in range(6000)] * 2 + [f"http://site{i}.com/p/{i}?q=1" for i in range(50)]
    want = [i % 6000 < 3000 for i in range(12000)] + [False] * 50
    for most in (urls.MAX_BLOCKS, 1):  # one block is full: everything passes on to the join
        monkeypatch.setattr(urls, "MAX_BLOCKS", most)
        got = judge(spark, rows, listed, [])
        assert [got[i].url_listed for i in range(len(rows))] == want


def test_few_false_positives_pass_the_filter(spark):
    listed = spark.range(5000).selectExpr("concat('a.com/', id) as _canon")
    words, blocks = urls.bloom(listed)
    assert blocks * 512 >= 5000 * BITS_PER_KEY and words.count() <= blocks


def test_empty_tables_and_longest_rule(spark):
    assert judge(spark, [], []) == {}
    rules = [Rule("com", "/", "block"), Rule("a.com", "/x/", "allow"), Rule("a.com", "/x/y", "block")]
    got = judge(spark, ["q://a.com/x/z", "q://a.com/x/yy", "q://b.com/"], [], rules)
    assert [got[i].url_verdict for i in range(3)] == ["allow", "block", "block"]


def test_query_against_sql(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = db.execute(urls.ORACLE).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in urls.op7_url_filter(spark, sf_dir).collect())

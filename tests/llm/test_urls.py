"""URL rules by hand, host reputation against SQL."""

import duckdb

from tests.llm.conftest import SF
from visitflow.llm import url_filter
from visitflow.llm.queries import ORACLES, QUERIES, RULES


def run_sql(folder):
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return sorted(map(str, con.sql(ORACLES["op1_url_filter"]).fetchall()))


def test_sql_twin(spark):
    for folder in (SF, "/root/testdata/sf0.01"):
        assert sorted(str(tuple(r)) for r in QUERIES["op1_url_filter"](spark, folder).collect()) == run_sql(folder)


def test_hosts_paths_rules(spark):
    urls = ["HTTP://A.Example.NET/en/1?x", "x://example.net", "ftp://net/", "http://notexample.com/de/", None, "no scheme",
            "https://example.com/de/x#y", "http://É.org/fr/a", "http://org/fr", "a://b://c/d", "x://", "http://h?q/en/"]
    pages = spark.createDataFrame([(i, u, "extra", 1.0) for i, u in enumerate(urls)], "page_id long, url string, host string, n double")
    outcomes = spark.createDataFrame([], "page_id long, outcome int")
    found = {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(pages, outcomes, RULES).collect()}
    assert found == {
        0: ("a.example.net", "/en/1", "example.net/en/", "allow"), 1: ("example.net", "", None, "allow"),
        2: ("net", "/", "net/", "block"), 3: ("notexample.com", "/de/", None, "allow"), 4: ("", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("example.com", "/de/x", "example.com/de/", "block"),
        7: ("É.org", "/fr/a", "org/fr/", "allow"), 8: ("org", "/fr", None, "allow"), 9: ("b:", "//c/d", None, "allow"),
        10: ("", "", None, "allow"), 11: ("h", "", None, "allow")}
    assert url_filter.judge_urls(pages.limit(0), outcomes, RULES).count() == 0


def test_bad_hosts_are_blocked_and_shrunk(spark):
    pages = [(i, f"http://h{i % 10}.bad.com/{i}") for i in range(400)] + [(1000 + i, f"http://g{i % 9}.good.com/{i}") for i in range(400)]
    pages += [(5000, "http://new.bad.com/"), (5001, "http://new.good.com/"), (5001, "http://new.good.com/")]
    outcomes = [(i, int(i % 10 == 0)) for i in range(400)] + [(1000 + i, int(i % 10 != 0)) for i in range(400)] + [(1, None), (2, 7)]
    found = {}
    for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"),
                                   spark.createDataFrame(outcomes, "page_id long, outcome int")).collect():
        found.setdefault(r.host, r.verdict)
    assert found["h1.bad.com"] == "block" and found["g1.good.com"] == "allow" and found["new.good.com"] == "allow"

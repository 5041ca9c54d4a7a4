import datetime as dt
import random

import pytest

import duckdb

from presswork.llm import queries, url_lists

SMALL = "/root/testdata/sf0.001"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def plain(captures, entries):
    """The entry in force at a time, by looking through all entries of each key."""
    result = set()
    for i, url, at, host, keys in captures:
        best = None
        for key in sorted(keys or [], key=lambda k: (-len(k), k)):
            if at is None:
                break
            seen = sorted({(d, url_lists.ACTIONS.index(a)) for k, a, d in entries
                           if k == key and d is not None and a in url_lists.ACTIONS})
            held = {}
            for d, a in seen:
                held.setdefault(d, a)
            past = [d for d in held if d <= at]
            if past and held[max(past)] < 2:
                later = [d for d in held if d > at]
                best = (key, url_lists.ACTIONS[held[max(past)]], max(past),
                        min(later) if later else dt.datetime(9999, 1, 1))
                break
        result.add((i, url, at, host, *(best or (None,) * 4), bool(best and best[1] == "block")))
    return result


URLS = [None, "", "nonsense", "http://", "http://a.b.c.com/x/y?z", "HTTPS://U:p@A.B.C.com:81/X", "http://c.com",
        "http://b.c.com./", "http://1.2.3.4/x", "http://host/x#f", "ftp://c.com/y", "http://c.com//x"]


def test_against_a_plain_search(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(URLS), rng.choice([None, day(rng.randrange(900))]))
            for _ in range(150)] + [(9, "http://c.com/", dt.datetime(2500, 5, 5))]
    seen = spark.createDataFrame([(*r, "x", "y") for r in rows],
                                 "page_id long, url string, fetched_at timestamp_ntz, host string, action string")
    keyed = [tuple(r) for r in url_lists.url_keys(seen.select("page_id", "url", "fetched_at")).collect()]
    names = sorted({k for r in keyed for k in r[4] or []}) + [None, "2.3.4"]
    entries = [(rng.choice(names), rng.choice([*url_lists.ACTIONS, "other", None]),
                rng.choice([None, day(rng.randrange(900))])) for _ in range(400)]
    entries += entries[:20]
    listed = spark.createDataFrame([(*e, "x") for e in entries],
                                   "list_key string, action string, dated timestamp_ntz, month string")
    got = url_lists.filter_urls(seen, listed).collect()
    assert {tuple(r) for r in got} == plain(keyed, entries)
    assert len(got) == len(set(rows)) and sum(r.list_key is not None for r in got) > 10


def test_a_wrong_date_adds_one_month(spark):
    far = [dt.datetime(1, 1, 1), dt.datetime(9998, 12, 31, 23), day(10)]
    seen = spark.createDataFrame([(i, "http://c.com", at) for i, at in enumerate(far)],
                                 "page_id long, url string, fetched_at timestamp_ntz")
    entries = [("c.com", "block", day(0)), ("c.com", "allow", day(5)), ("c.com", "block", dt.datetime(1, 1, 1))]
    listed = spark.createDataFrame(entries, "list_key string, action string, dated timestamp_ntz")
    result = url_lists.filter_urls(seen, listed)
    keyed = [tuple(r) for r in url_lists.url_keys(seen).collect()]
    assert {tuple(r) for r in result.collect()} == plain(keyed, entries)
    made = url_lists.validity(listed).count()
    explode = result._jdf.queryExecution().toString()
    assert "sequence(" not in explode.split("== Optimized Logical Plan ==")[1].split("== Physical")[0].replace(
        "sequence(2", "") and made == 3


def test_keys(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r.url: (r.host, r.keys) for r in url_lists.url_keys(df).collect()}
    assert got["http://a.b.c.com/x/y?z"] == ("a.b.c.com", ["a.b.c.com", "b.c.com", "c.com", "a.b.c.com/x"])
    assert got["HTTPS://U:p@A.B.C.com:81/X"][0] == "a.b.c.com"
    assert got["http://1.2.3.4/x"] == ("1.2.3.4", ["1.2.3.4", "1.2.3.4/x"])
    assert got["http://b.c.com./"] == ("b.c.com", ["b.c.com", "c.com"])
    assert got[None] == got[""] == got["nonsense"] == got["http://"] == (None, None)


def test_empty_tables(spark):
    seen = spark.createDataFrame([(1, "http://c.com", day(1))], "page_id long, url string, fetched_at timestamp_ntz")
    listed = spark.createDataFrame([], "list_key string, action string, dated timestamp_ntz")
    assert [r.blocked for r in url_lists.filter_urls(seen, listed).collect()] == [False]
    assert url_lists.filter_urls(seen.limit(0), listed).collect() == []


@pytest.mark.parametrize("name", queries.SQL)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got

"""Queries against their SQL on rows that the given small tables lack."""

import duckdb
import pandas as pd
import pytest

from tidewire.plans.queries import ORACLES, QUERIES


def both(spark, name, path, table, rows, columns):
    spark.createDataFrame(pd.DataFrame(rows, columns=columns)).coalesce(1).write.parquet(f"{path}/{table}.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(path))
    rel = c.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    return sorted(tuple(r[n] for n in names) for r in df.collect()), sorted(tuple(r) for r in rel.fetchall())


CUT = ("&amp", "a &lt", "&gt;&quot", "it&#x27;s &#x27", "&#x27", "x &amp;amp; &amp;lt &am &a &", "&amp;&amp")


@pytest.mark.parametrize("name", ["s07_s08_main_text", "s09_s10_party_links"])
def test_references_cut_before_their_semicolon(spark, tmp_path, name):
    text = "palavra " * 20
    rows = [(k, f"https://h.example.org/{k}", f"<html><head><title>T</title></head><body><article><h1>Um {x}</h1><p>{text}{x}</p></article></body></html>") for k, x in enumerate(CUT, 1)]
    got, expected = both(spark, name, tmp_path, "pages", rows, ["page_id", "url", "html"])
    assert len(got) == len(CUT) and got == expected


def test_latest_poll_of_equal_shares(spark, tmp_path):
    day = pd.Timestamp("2024-03-01 10:00:00")
    ids = [(k * 7) % 40 for k in range(40)]
    rows = [(k, day, 9, "click", 150.0, "{}") for k in ids]
    got, expected = both(spark, "w05_j09_latest_poll", tmp_path, "events", rows, ["event_id", "ts", "user_id", "event_type", "value", "payload"])
    assert [r[-1] for r in got] == [0, 1, 2, 3, 4] and got == expected

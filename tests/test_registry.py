import math

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
FOLDER = "/root/testdata/sf0.001"
QUICK = ["bars_daily", "sma", "ema", "signal_labels", "time_split", "auc_ovo", "eval_metrics",
         "article_status", "html_main_text", "doc_sentiment", "entity_sentiment", "nearest_ticker",
         "fuzzy_names", "json_lines"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return (None if math.isnan(v) else v + 0.0) if isinstance(v, float) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows),
                  key=lambda r: [(x is None, str(x)) for x in r])


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, FOLDER)
    cur = duck.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), columns)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert len(df.columns) == 20 and df.count() > 0

"""Every operator that hands on its input's columns keeps them, whatever their names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from data import frame
from marketloom.llm import decontaminate, language, mixing, near_dedup, quality, secrets, toxicity, url_filters

NAMES = ["_counts", "_said", "_u", "_d", "_whole", "u", "d", "key", "bin", "rank", "epochs", "h", "n", "n_id", "rep", "a", "b",
         "version", "start", "features", "vector", "words", "sig", "bucket", "component", "list", "since", "until"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["one two three four five six seven", "token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" end", None, "eins zwei drei"]
    df = frame(spark, list(enumerate(texts)))
    return df.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES})


OPERATORS = {
    "toxicity": lambda d: toxicity.score(d, toxicity.ToxicityModel(["badword"], [], [0.1] * 8, -1.0)),
    "quality": lambda d: quality.score(d, quality.fit(d, d.sparkSession.createDataFrame([], "doc_id long, quality int"))),
    "language": lambda d: language.identify(d, language.fit(d)),
    "mixing": mixing.mix,
    "near_dedup": near_dedup.one_of_each,
    "decontaminate": lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")),
    "secrets": lambda d: secrets.redact(d, secrets.scan(d, None)),
    "url_filters": lambda d: url_filters.judge(
        d.withColumns({"url": F.lit("http://b.com/"), "fetched": F.lit(dt.date(2024, 5, 1))}),
        d.sparkSession.createDataFrame([("l", "b.com", "add", dt.date(2024, 1, 1))], "list string, key string, action string, day date")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_stay(docs, name):
    rows = OPERATORS[name](docs).collect()
    assert len(rows) == 4
    for r in rows:
        assert all(r[c] == f"{c}{r.doc_id}" for c in NAMES)

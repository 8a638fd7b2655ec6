"""run() against a brute-force version of the stages that have one, and each stage's contract."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from data import DOCS, frame, prose
from test_near_dedup import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    rows, labels = [], []
    bench = [(k, prose(r, 30, "abcdefghijklmnop")) for k in range(8)]
    for i in range(300):
        text = ". ".join(prose(r, 9, "abcdefghijklmnop").capitalize() for _ in range(6)) + "."
        good = i % 4 > 0
        if not good:
            text = text.replace(" ", "$$$ ")
        elif i % 10 == 1:
            text = rows[-1][1] if rows[-1][0] % 4 else text
        elif i % 10 == 3:
            text += "\n" + bench[i % 8][1]
        elif i % 10 == 5:
            text += " token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" end"
        rows.append((i, text, "en", f"s{i % 3}"))
        labels.append((i, int(good), 0))
    rows += [(500, None), (501, ""), (502, rows[2][1], "en", None), (502, rows[2][1], "en", None), (None, rows[6][1] + " zz yy xx ww vv uu")]
    path = str(tmp_path_factory.mktemp("tables"))
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_follow_each_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, folder)
        path = os.path.join(folder, f"stage{k}")
        out.write.parquet(path)
        before, kept = kept, spark.read.parquet(path)
        seen[name] = (before.collect(), kept.collect())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == docs.columns
    before, after = seen["quality classifier"]
    ids = {x.doc_id for x in after}
    good = {x.doc_id for x in before if x.doc_id is not None and x.doc_id < 300 and x.doc_id % 4}
    assert len(ids & good) >= 0.98 * len(good) and not ids & (set(range(0, 300, 4)))
    before, after = seen["near-dedup"]
    want = brute([(x.doc_id, x.text) for x in before if x.doc_id is not None])
    assert sorted(x.doc_id for x in after if x.doc_id is not None) == sorted(set(want.values()))
    assert any(x.doc_id is None for x in after) == any(x.doc_id is None for x in before)
    before, after = seen["benchmark decontamination"]
    table = [t for _, t in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert [x for x in after] and sorted(map(str, after)) == sorted(
        str(x) for x in before if not any(b in (x.text or "") for b in table))
    before, after = seen["secret scans"]
    assert len(before) == len(after) and not any("1beb58b8af" in (x.text or "") for x in after)
    assert sum("[SECRET]" in (x.text or "") for x in after) == sum("1beb58b8af" in (x.text or "") for x in before)
    before, after = seen["source mixing"]
    assert {x.doc_id for x in after} <= {x.doc_id for x in before} and all(0 < x.taken <= 3 * x.size for x in after)

    def rows(frame_):
        return sorted(map(str, frame_.collect()))

    assert rows(corpus_pipeline.run(spark, folder)) == sorted(map(str, seen["source mixing"][1]))


def test_stages_take_extra_columns_and_nothing(spark, folder):
    docs = spark.createDataFrame([], DOCS).withColumns({"score": F.lit(1), "size": F.lit(1), "kept": F.lit(True)})
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0

import json
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions.lexicon import LexiconScorer
from marketloom.operators import articles, cells, entities, linking
from marketloom.operators.skew import join_dimension, spread_join
from marketloom.plans.pipeline import news_report
from marketloom.schemas import ARTICLE_META
from marketloom.session import scratch_path
from marketloom.sources import news
from marketloom.streaming import articles as stream


def test_flatten_news(spark):
    payload = json.dumps({"status": "ok", "totalResults": 3, "articles": [
        {"title": "t", "author": None, "url": "u", "source": {"id": 1}}, None, {}]})
    df = spark.createDataFrame([(payload,), ('{"articles": []}',), ("broken",)], "payload string")
    assert [tuple(r) for r in news.flatten_news(df).collect()] == [("t", None, "u")]


def test_flatten_symbol_news(spark):
    def item(i):
        return {"content": {"title": f"t{i}", "canonicalUrl": {"url": f"u{i}"}, "provider": {"displayName": "p"}}}
    df = spark.createDataFrame([(json.dumps({"A": [item(1), item(2), item(3)], "B": [], "C": [item(4)]}),)],
                               "payload string")
    every = sorted(tuple(r) for r in news.flatten_symbol_news(df).collect())
    assert every == [("t1", "p", "u1", "A"), ("t2", "p", "u2", "A"), ("t3", "p", "u3", "A"), ("t4", "p", "u4", "C")]
    last = sorted(tuple(r) for r in news.flatten_symbol_news(df, mode="last").collect())
    assert last == [every[2], every[3]]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"title": "t", "author": "a", "url": "u"}\n\n   \n{bad\nnull\n'
                    '{"title": "x", "author": "a", "url": "", "symbol": "S"}\n')
    good, bad = news.read_json_lines(spark, str(path), ARTICLE_META)
    assert sorted((r.title, r.symbol) for r in good.collect()) == [("t", None), ("x", "S")]
    assert sorted(r.line for r in bad.collect()) == ["null", "{bad"]
    kept = articles.valid_articles(good).collect()
    assert [(r.title, r.symbol) for r in kept] == [("t", "unknown")]


@pytest.fixture(scope="module")
def pages(spark):
    html = "<article><p>good gain</p></article>"
    return spark.createDataFrame(
        [("ok", html, 200, None, None), ("gone", html, 404, "http", None),
         ("slow", None, None, "timeout", None), ("odd", html, None, "other", "boom")],
        "url string, html string, http_status int, error_kind string, error_message string")


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame(
        [(f"title {u}", "a", u, "S" if u == "ok" else None)
         for u in ("ok", "gone", "slow", "odd", "absent", "", None)], ARTICLE_META)


def test_scrape(meta, pages):
    got = {r.url: (r.status, r.scraped_content, r.error_details, r.symbol)
           for r in articles.scrape(meta, pages).collect()}
    assert got == {
        "ok": ("success", "good gain", "", "S"), "gone": ("http_error_404", "", "", "unknown"),
        "slow": ("timeout_error", "", "", "unknown"), "odd": ("unexpected_exception", "", "boom", "unknown"),
        "absent": ("network_error", "", "", "unknown")}


def test_news_report(meta, pages):
    report = news_report(meta, pages)
    assert report.sentiment.columns == ["label", "score", "details", "symbol"]
    assert sorted(r.label for r in report.sentiment.collect()) == ["Neutral"] * 4 + ["Positive"]
    assert sorted(r.symbol for r in report.symbols.collect()) == ["S", "unknown"]


def test_incremental_run_resumes(spark, meta, pages):
    src, out, ckpt = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))

    def run():
        s = stream.processed_stream(stream.article_stream(spark, src, 1), pages.select("url", "html"))
        stream.run_incremental(s, out, ckpt).awaitTermination()
        return spark.read.json(out).count()

    news.write_json_lines(meta, src)
    assert run() == 5
    assert run() == 5                       # nothing new
    news.write_json_lines(meta.where("url = 'ok'"), src, mode="append")
    assert run() == 6
    assert spark.read.json(out).where("status = 'success'").count() == 5


def test_bar_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "A", 1, 10.0), ("2024-01-01 05:00:00", "A", 2, 12.0),
            ("2024-01-01 23:00:00", "A", 3, 11.0), ("2024-01-03 00:00:00", "A", 4, 1.0)]
    ticks = spark.createDataFrame(rows, "ts string, k string, id int, px double").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    ticks.write.parquet(str(tmp_path / "t"))
    s = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "t"))
    bars = stream.bar_stream(s, F.col("k"), "ts", "px", "id")
    q = (bars.writeStream.format("memory").queryName("bars").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = [(r.Open, r.High, r.Low, r.Close, r.Volume) for r in spark.table("bars").collect()]
    assert got == [(10.0, 12.0, 10.0, 11.0, 3.0)]


# ---------------------------------------------------------------- joins

@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_equals_join(spark, how):
    left = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
        "id")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 500, 2)], "k string, v int")
    got = spread_join(left, right, ["k"], how, rows_per_task=20)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    big = join_dimension(left, right, ["k"], "left", max_rows=10)
    assert big.exceptAll(left.join(right, "k", "left")).count() == 0


# ---------------------------------------------------------------- entities

DOCS = [(1, "Acme Corp gains big. Paris likes acme corp! No one else."), (2, "Loss at Acme Corp. Loss at Acme Corp."),
        (3, "Nothing here")]
GAZ = [("Acme Corp", "ORG"), ("Paris", "GPE"), ("one", "CARDINAL")]


@pytest.fixture(scope="module")
def mentions(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    return entities.gazetteer_mentions(docs, spark.createDataFrame(GAZ, "entity string, label string"))


def test_mentions(mentions):
    got = sorted((r.doc_id, r.pos, r.word, r.entity, r.label) for r in mentions.collect())
    assert got == [(1, 0, 0, "Acme Corp", "ORG"), (1, 1, 0, "Paris", "GPE"), (1, 1, 2, "Acme Corp", "ORG"),
                   (1, 2, 1, "one", "CARDINAL"), (2, 0, 2, "Acme Corp", "ORG"), (2, 1, 2, "Acme Corp", "ORG")]
    assert entities.financial_mentions(mentions).count() == 5
    assert sorted(tuple(r) for r in entities.org_entities(mentions).collect()) == [(1, "Acme Corp"), (2, "Acme Corp")]


def test_entity_sentences_and_sentiment(mentions):
    kept = entities.financial_mentions(mentions)
    got = {(r.doc_id, r.entity): r.sentences for r in entities.entity_sentences(kept).collect()}
    assert got[1, "Acme Corp"] == ["Acme Corp gains big.", "Paris likes acme corp!"]
    assert got[2, "Acme Corp"] == ["Loss at Acme Corp."] * 2
    s = {(r.doc_id, r.entity): r.label for r in entities.entity_sentiment(kept).collect()}
    assert s == {(1, "Acme Corp"): "Neutral", (1, "Paris"): "Neutral", (2, "Acme Corp"): "Negative"}


def test_documents_hold_each_sentence_once_and_give_the_same(spark):
    docs = spark.createDataFrame([*DOCS, (None, "Acme Corp gains."), (None, "Loss at Acme Corp."), (4, "Paris. One loss."), (4, "Acme Corp. One gain."),
                                  (5, None), (6, "One one. No one and Paris gains. Acme Corp")], "doc_id int, text string")
    known = spark.createDataFrame([*GAZ, ("one", "ORG"), ("One", "GPE")], "entity string, label string")
    rows, found = entities.gazetteer_mentions(docs, known), entities.mentioned_documents(docs, known)
    assert found.count() == 8 and all("sentence" not in x.found.__str__() for x in found.collect())
    columns = rows.columns
    assert sorted(map(str, entities.mention_rows(found).select(columns).collect())) == sorted(map(str, rows.collect()))
    labels = ["ORG", "GPE", "CARDINAL"]
    for f in (entities.entity_sentences, lambda m: entities.entity_sentiment(m).where("doc_id != 4")):
        got, want = (f(entities.financial_mentions(m, labels)).collect() for m in (found, rows))
        assert len(got) > 5 and sorted(map(str, got)) == sorted(map(str, want))


def test_sentences_are_scored_once(mentions):
    scored = entities.scored_mentions(mentions, LexiconScorer())
    assert scored.count() == mentions.count() and scored.where("sentiment is null").count() == 0


def test_embeddings(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, "word " * 900)], "doc_id int, text string")
    got = {r.doc_id: np.array(r.embedding) for r in entities.embed_documents(docs, dim=32).collect()}
    np.testing.assert_allclose(got[1], got[2])
    assert np.linalg.norm(got[1]) == pytest.approx(1.0)
    rows = spark.createDataFrame([("x", [1.0, 3.0]), ("x", [3.0, 5.0]), ("y", [0.0, 1.0])], "k string, embedding array<double>")
    assert {r.k: r.embedding for r in entities.mean_embedding(rows, "k").collect()} == {"x": [2.0, 4.0], "y": [0.0, 1.0]}


# ---------------------------------------------------------------- links

@pytest.mark.parametrize("limit", [64 << 20, 0])
@pytest.mark.parametrize("k", [1, 4])
def test_link_vectors(spark, k, limit):
    """Broadcast and tiled paths against brute force."""
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(60, 8)), rng.normal(size=(90, 8))
    c[7] = c[3]                              # a tie
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q_id int, q_value array<double>")
    cs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "c_id int, c_value array<double>")
    got = linking.link_vectors(qs, cs, k, max_broadcast_bytes=limit, tile_rows=16)
    order = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :k]
    want = {(i, r + 1): order[i, r] for i, r in product(range(60), range(k))}
    rows = {(r.q_id, r["rank"]): r for r in got.collect()}
    assert set(rows) == set(want)
    for key, r in rows.items():
        best = q[key[0]] @ c[want[key]]
        assert r.score == pytest.approx(best) and (r.c_id == want[key] or abs(q[key[0]] @ c[r.c_id] - best) < 1e-12)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_cells_prune_and_stay_exact(spark, limit):
    """Clustered vectors in many cells and blocks: all matches, by both metrics, in each part."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 6)) * 8
    c = centres[rng.integers(20, size=1_500)] + rng.normal(size=(1_500, 6)) + 50
    q = c[:120] + rng.normal(size=(120, 6)) * 0.1
    qs = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(q)], "q_id int, q_value array<double>, part int")
    cs = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(c)], "c_id int, c_value array<double>, part int")
    for metric, scores in ((linking.InnerProduct(), q @ c.T),
                           (linking.NegativeSquaredDistance(), -((q[:, None] - c[None]) ** 2).sum(axis=2))):
        scores = np.where(np.arange(120)[:, None] % 2 == np.arange(1_500)[None] % 2, scores, -np.inf)
        scores[np.arange(120), np.arange(120)] = -np.inf
        order = np.argsort(-scores, axis=1, kind="stable")[:, :3]
        got = cells.best_matches(qs, cs, metric, 3, exclude_same_id=True, max_broadcast_bytes=limit, tile_rows=32, cell_rows=8)
        rows = {(r.q_id, r["rank"]): r.c_id for r in got.collect()}
        assert rows == {(i, r + 1): order[i, r] for i, r in product(range(120), range(3))}


def test_cells_far_from_a_query_are_left_out():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 4)) * 50
    x = centres[rng.integers(30, size=3_000)] + rng.normal(size=(3_000, 4))
    metric, rows = linking.NegativeSquaredDistance(), {"": len(x)}
    parts, made = cells._fit({"": x}, rows, 16)
    cell = cells._assign(x, np.full(len(x), "", object), parts, made)
    stats = cells._statistics(metric, x, cell, parts, made)
    bound, home = cells.bounds(metric, stats, x[:200], np.full(200, "", object), 3)
    floor = np.sort(-((x[:200, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, -3]
    assert (bound >= floor[:, None]).mean() < 0.2
    for i in range(200):
        assert (bound[i][cell] >= -((x[i] - x) ** 2).sum(axis=1) - 1e-6).all()


def test_names_share_letters_or_are_not_aligned(monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(60)]
    names = [" ".join(sorted(rng.choice(words, 3))) for _ in range(400)]
    metric, aligned = linking.NameRatio(), []
    monkeypatch.setattr(linking, "lcs_length", lambda a, b: aligned.append(1) or lcs(a, b))
    side = cells.Side(np.array(names, object), names, metric.features(names))
    i, j, score = metric.top(side, side, 3, np.full(400, -np.inf), False)
    assert len(aligned) < 0.35 * 400 * 400
    for row in range(0, 400, 40):
        want = sorted((-round(200 * lcs(names[row], t) / (len(names[row]) + len(t))) for t in names))[:3]
        assert sorted(-score[i == row])[:3] == want


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_link_names(spark, limit):
    names = ["Apple Inc.", "inc apple", "Micro-soft", "é!?", "Alphabet (Google)"]
    titles = ["APPLE INC", "MICROSOFT CORP", "Alphabet Inc.", "Amazon com", "Meta", "Inc"]
    got = linking.link_names(spark.createDataFrame([(n,) for n in names], "name string"),
                             spark.createDataFrame([(t,) for t in titles], "title string"),
                             k=3, max_broadcast_bytes=limit, tile_rows=2)

    def norm(s):
        s = "".join(ch if ch.isascii() and (ch.isalnum() or ch == "_") else " " if ch.isascii() else "" for ch in s)
        return " ".join(sorted(s.lower().split()))

    for n in names:
        def score(t):
            a, b = norm(n), norm(t)
            return round(200 * lcs(a, b) / (len(a) + len(b))) if a and b else 0
        want = sorted(((score(t), t) for t in titles), key=lambda x: (-x[0], x[1]))[:3]
        rows = got.where(F.col("name") == n).orderBy("rank").collect()
        assert [(r.score, r.title) for r in rows] == want
    assert got.where("name = 'inc apple' and rank = 1").first().score == 100


def test_stream_takes_every_article_once(spark, tmp_path):
    pages = spark.createDataFrame([("http://a", "<p>one</p>"), ("http://b", "<p>two</p>")], "url string, html string")
    texts = stream.extract_pages(pages, str(tmp_path / "texts"))
    files = [["a", "b", "a"], ["b", "c", "a"], ["d"]]
    for n, names in enumerate(files):
        (tmp_path / "in").mkdir(exist_ok=True)
        lines = [json.dumps({"title": x, "url": f"http://{x}", "author": None, "symbol": "S"}) for x in names] + ["{bad"]
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines) + "\n")
        for _ in range(2):
            s = stream.processed_stream(stream.once(stream.article_stream(spark, str(tmp_path / "in"))), texts)
            stream.run_incremental(s, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = sorted((r.title or "", r.status, r.scraped_content) for r in spark.read.json(str(tmp_path / "out")).collect())
    assert got == [("", "malformed_line", ""), ("a", "success", "one"), ("b", "success", "two"), ("c", "network_error", ""), ("d", "network_error", "")]
    assert stream.extract_pages(pages.limit(0), str(tmp_path / "texts")).count() == 2  # made once

import time
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import chunking, lexicon
from marketloom.functions.expressions import (
    analysis_text, days_before, fetch_status, nan_to_null, strip, ticker_text)
from marketloom.functions import html_text
from marketloom.functions.html_text import html_main_text, main_text
from marketloom.functions.lexicon import FINANCE_KEYWORDS, LexiconScorer, model_scorer
from marketloom.operators.sentiment import aggregate_chunk_rows, aggregate_scores, document_sentiment


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


# ---------------------------------------------------------------- chunks

def brute_fixed(text, size, overlap):
    out, at = [], 0
    while True:
        out.append(text[at:at + size])
        if at + size >= len(text):
            return out
        at += size - overlap


@pytest.mark.parametrize("n", [1, 31, 32, 33, 1612, 1613, 3192, 3193, 10_000])
def test_fixed_chunks(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    got = value(spark, chunking.fixed_chunks(F.lit(text)))
    assert got == brute_fixed(text, 1612, 32)


def test_recursive_chunks(spark):
    run = chunking.recursive_chunks(20, 6)
    assert value(spark, run(F.lit("short text"))) == ["short text"]
    assert value(spark, run(F.lit("  \n\n "))) == []
    # paragraphs first, then words; a chunk starts with the words repeated from the previous one
    assert value(spark, run(F.lit("one two three four five six\n\nseven"))) == [
        "one two three four", "four five six", "seven"]
    assert value(spark, run(F.lit("x" * 45))) == ["x" * 20, "x" * 20, "x" * 17]
    assert value(spark, run(F.lit(None).cast("string"))) is None


def test_recursive_chunk_limits():
    text = "\n\n".join(" ".join(f"w{i}{j}" for j in range(i % 70)) for i in range(120))
    chunks = chunking.chunk_text(text, 200, 32, chunking.SEPARATORS)
    assert all(0 < len(c) <= 200 and c == c.strip() for c in chunks)
    missing = set(text.split()) - {w for c in chunks for w in c.split()}
    assert not missing


# ---------------------------------------------------------------- pages

P = "<p> one </p><p></p><p>two</p>"


@pytest.mark.parametrize("html,want", [
    (f"<article>no</article><div class='x story-body'>{P}</div>", "one\ntwo"),
    (f"<div id='content'>{P}</div><div class='post-content'><p>class wins</p></div>", "class wins"),
    (f"<article><p>no</p></article><section id='main'>{P}</section>", "one\ntwo"),
    (f"<p>out</p><article>{P}</article><article><p>second</p></article>", "one\ntwo"),
    ("<article> a <b>bold</b><div>x</div></article>", "a\nbold\nx"),
    ("<h1>Head</h1><p>A <i>b</i></p><ul><li>i1<li>i2</ul><div>no</div>", "Head\nAb\ni1\ni2"),
    ("<article><script>var t='</p><p>';</script><style>p{}</style><p>kept</p><!-- c --></article>", "kept"),
    ("<article><p><b>Title<br><p>first<p>second <b>x</b></article><p>after", "Title\nfirst\nsecond x"),
    ("<article><p>a &amp; b&lt;</p></article>", "a & b<"),
    ("", ""),
])
def test_main_text(spark, html, want):
    assert main_text(html) == want
    assert value(spark, html_main_text(F.lit(html))) == want


# ---------------------------------------------------------------- expressions

@pytest.mark.parametrize("code,kind,want", [
    (200, None, "success"), (404, "http", "http_error_404"), (500, None, "http_error_500"),
    (None, "http", "http_error_unknown"), (None, "timeout", "timeout_error"),
    (None, "network", "network_error"), (None, "odd", "unexpected_exception")])
def test_fetch_status(spark, code, kind, want):
    assert value(spark, fetch_status(F.lit(code).cast("int"), F.lit(kind).cast("string"))) == want


def test_small_expressions(spark):
    assert value(spark, strip(F.lit("\t a b\n "))) == "a b"
    assert value(spark, analysis_text(F.lit("success"), F.lit("c"), F.lit("t"))) == "c"
    assert value(spark, analysis_text(F.lit("timeout_error"), F.lit("c"), F.lit("t"))) == "t"
    assert value(spark, ticker_text(F.lit("A"), F.lit("B"), F.lit("C"))) == "ABC"
    assert value(spark, days_before(F.lit("2024-03-01").cast("date"), 1)) == "2024-02-29"
    df = spark.createDataFrame([(float("nan"), "x"), (1.0, "y")], "v double, s string")
    assert [r.v for r in nan_to_null(df).collect()] == [None, 1.0]


def test_sentences_and_keywords(spark):
    text = F.lit("Profit rose.  Why? Nobody knows! v1.2 shipped")
    assert value(spark, lexicon.sentences(text)) == ["Profit rose.", "Why?", "Nobody knows!", "v1.2 shipped"]
    assert value(spark, lexicon.mentions_finance(F.lit("The PROFIT, again"))) is True
    assert value(spark, lexicon.mentions_finance(F.lit("profitable"))) is False
    assert len(set(FINANCE_KEYWORDS)) == 45


# ---------------------------------------------------------------- sentiment

def chunk_results(spark, labels):
    return spark.createDataFrame([(1, lab, s) for lab, s in labels], "doc_id int, label string, score double")


@pytest.mark.parametrize("labels,label,score", [
    ([("Positive", 0.9), ("Negative", 0.5)], "Positive", 0.7),
    ([("Negative", 0.5), ("Neutral", 1.0)], "Negative", 0.35),
    ([("Neutral", 1.0), ("Neutral", 0.5)], "Neutral", 0.15),
    ([("Negative", 0.5), ("Neutral", 1.0), ("Neutral", 1.0)], "Neutral", 0.3),
])
def test_chunk_aggregation(spark, labels, label, score):
    rows = chunk_results(spark, labels)
    one = aggregate_chunk_rows(rows, "doc_id").first()
    assert (one.label, one.details) == (label, "aggregated") and one.score == pytest.approx(score)
    arr = rows.agg(F.collect_list(F.struct("label", "score")).alias("r")).select(
        aggregate_scores(F.col("r")).alias("v")).first().v
    assert arr.label == label and arr.score == pytest.approx(score)


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["gain gain loss", "x" * 1792, ("gain " * 400).strip(), " " * 2000, "loss " * 500, ""]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_document_sentiment(docs):
    got = {r.doc_id: (r.label, r.details) for r in document_sentiment(docs).collect()}
    assert got == {0: ("Positive", None), 1: ("Neutral", None), 2: ("Positive", "aggregated"),
                   3: ("Neutral", "default"), 4: ("Negative", "aggregated"), 5: ("Neutral", None)}


def test_arrow_scorer_agrees_with_expression(docs):
    words = LexiconScorer()

    def load():
        def score(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for t in texts:
                p = sum(t.split().count(w) for w in words.positive)
                n = sum(t.split().count(w) for w in words.negative)
                label = "Positive" if p > n else "Negative" if n > p else "Neutral"
                rows.append((label, (max(p, n) + 1) / (p + n + 2)))
            return pd.DataFrame(rows, columns=["label", "score"])
        return score

    a = document_sentiment(docs).orderBy("doc_id").collect()
    b = document_sentiment(docs, scorer=model_scorer(load), batched=True).orderBy("doc_id").collect()
    assert [(r.doc_id, r.label, round(r.score, 9), r.details) for r in a] == [
        (r.doc_id, r.label, round(r.score, 9), r.details) for r in b]


def test_pages_cost_the_same_per_tag():
    """Unclosed elements don't slow down what follows them."""
    def took(n, tag):
        page = "<article>" + f"<{tag}>x" * n + "<p>one</p><p>two</p></b></article>"
        start = time.perf_counter()
        text = main_text(page)
        return time.perf_counter() - start, text

    for tag in ("div", "b", "custom"):
        took(2_000, tag)
        small, _ = took(20_000, tag)
        large, text = took(200_000, tag)
        assert text == "one\ntwo" and large < 30 * small + 1 and large < 20


def test_implied_ends_follow_the_open_elements():
    """Against a scan over all open elements, on random tags."""
    import random
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.closed, self.n = [], {}, 0

        def imply(self, tag, barriers):
            for i, (name, _) in enumerate(reversed(self.open)):
                if name == tag:
                    return self.close_to(len(self.open) - 1 - i)
                if name in barriers:
                    return None

        def close_to(self, k):
            for _, e in self.open[k:]:
                self.closed[e] = self.n
            del self.open[k:]

        def handle_starttag(self, tag, attrs):
            if tag in html_text._ENDS_P:
                self.imply("p", html_text._SCOPE)
            if tag in ("li", "td", "th", "tr", "dd", "dt"):
                self.imply(tag, html_text._SCOPE - {"td", "th"} | {"ul", "ol", "dl"})
            self.n += 1
            if tag not in html_text._VOID:
                self.open.append((tag, self.n))

        def handle_endtag(self, tag):
            at = [i for i, (name, _) in enumerate(self.open) if name == tag]
            if at:
                self.close_to(at[-1])

    tags = ["p", "div", "li", "ul", "td", "tr", "table", "b", "br", "object", "dl", "dd", "th", "article"]
    for seed in range(200):
        r = random.Random(seed)
        page = "".join(f"<{'/' if r.random() < 0.35 else ''}{r.choice(tags)}>" for _ in range(80))
        plain, ours = Plain(), html_text._Page()
        plain.feed(page), ours.feed(page)
        assert [e for _, e in plain.open] == [i + 1 for i in ours._open]

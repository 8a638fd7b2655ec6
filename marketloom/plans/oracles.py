"""DuckDB SQL for the registered queries, written independently of the Spark plans."""

from __future__ import annotations

from marketloom.functions.lexicon import FINANCE_KEYWORDS
from marketloom.schemas import FEATURES, FIELDS, INDICATORS


def _r(columns, digits=6, prefix="") -> str:
    return ", ".join(f'round({prefix}"{c}", {digits}) AS "{c}"' for c in columns)


# ---------------------------------------------------------------- panels

_DAILY = """
ticks AS (
  SELECT p_brand AS "Ticker", CAST(l_shipdate AS DATE) AS "Date", l_extendedprice / l_quantity AS px,
         l_quantity AS q, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (
  SELECT "Date", "Ticker", arg_max(px, o) AS "Close", max(px) AS "High", min(px) AS "Low",
         arg_min(px, o) AS "Open", sum(q) AS "Volume"
  FROM ticks GROUP BY 1, 2)"""

_HOURLY = """
bars AS (
  SELECT date_trunc('hour', ts) AS "Date", event_type AS "Ticker",
         arg_max(value, (ts, event_id)) AS "Close", max(value) AS "High", min(value) AS "Low",
         arg_min(value, (ts, event_id)) AS "Open", CAST(count(*) AS DOUBLE) AS "Volume"
  FROM events GROUP BY 1, 2)"""


def _ema(name: str, source: str, value: str, alpha: float, k: str = "k") -> str:
    """Closed form of the recursive mean over rows numbered from 0."""
    return f"""
{name} AS (
  SELECT *, pow(1 - {alpha!r}, {k}) * sum(CASE WHEN {k} = 0 THEN {value}
      ELSE {alpha!r} * {value} * pow(1 - {alpha!r}, -{k}) END)
      OVER (PARTITION BY "Ticker" ORDER BY "Date" ROWS UNBOUNDED PRECEDING) AS {name}_v
  FROM {source})"""


_W = 'OVER (PARTITION BY "Ticker" ORDER BY "Date")'
_FEATURES = f""",
x0 AS (
  SELECT *, row_number() {_W} - 1 AS k,
         "Close" / lag("Close") {_W} - 1 AS ret,
         coalesce(greatest("Close" - lag("Close") {_W}, 0), 0) AS gain,
         coalesce(greatest(lag("Close") {_W} - "Close", 0), 0) AS loss
  FROM bars),
{_ema("e14", "x0", '"Close"', 2 / 15)},
{_ema("e12", "e14", '"Close"', 2 / 13)},
{_ema("e26", "e12", '"Close"', 2 / 27)},
{_ema("up", "e26", "gain", 1 / 14)},
{_ema("dn", "up", "loss", 1 / 14)},
m0 AS (SELECT *, e12_v - e26_v AS m, k - 25 AS mk FROM dn WHERE k >= 25),
{_ema("sig", "m0", "m", 2 / 10, "mk")},
x1 AS (
  SELECT d.*, CASE WHEN d.k >= 33 THEN sig_v END AS sigv, m
  FROM dn d LEFT JOIN sig s ON d."Ticker" = s."Ticker" AND d."Date" = s."Date"),
features AS (
  SELECT "Date", "Ticker", "Close", "High", "Low", "Open", "Volume",
    CASE WHEN k >= 13 THEN e14_v END AS ema,
    CASE WHEN k >= 13 THEN avg("Close") OVER (PARTITION BY "Ticker" ORDER BY "Date"
         ROWS 13 PRECEDING) END AS sma,
    CASE WHEN k >= 13 THEN CASE WHEN dn_v = 0 THEN 100.0 ELSE 100 - 100 / (1 + up_v / dn_v) END END AS rsi,
    m AS macd, m - sigv AS macd_diff, sigv AS macd_signal, 100 * ret AS daily_return,
    ("Close" - lag("Close", 7) {_W}) / lag("Close", 7) {_W} AS momentum,
    CASE WHEN k >= 5 THEN stddev_samp(ret) OVER (PARTITION BY "Ticker" ORDER BY "Date"
         ROWS 4 PRECEDING) END AS volatility,
    100 * (lead("Close", 7) {_W} / "Close" - 1) AS future_return,
    lead("Close") {_W} AS "Close_lag1", lead("Volume") {_W} AS "Volume_lag1"
  FROM x1)"""

_LABELLED = """,
th AS (SELECT quantile_cont(future_return, 0.3) AS lo, quantile_cont(future_return, 0.7) AS hi FROM features),
labelled AS (
  SELECT f.*, CASE WHEN future_return >= hi THEN 1 WHEN future_return <= lo THEN -1 ELSE 0 END AS signal_label
  FROM features f, th)"""

_SIDES = """,
numbered AS (SELECT *, row_number() OVER (ORDER BY "Date", "Ticker") - 1 AS i, count(*) OVER () AS n FROM labelled),
sides AS (SELECT *, CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'test' END AS side FROM numbered)"""


def _scaled(by: str) -> str:
    stats = ", ".join(f'avg("{c}") AS "m_{c}", CASE WHEN stddev_samp("{c}") = 0 THEN 1e-7 '
                      f'ELSE stddev_samp("{c}") END AS "s_{c}"' for c in FEATURES)
    values = ", ".join(f'("{c}" - "m_{c}") / "s_{c}" AS "{c}"' for c in FEATURES)
    on = "x.side = st.side" if by == "self" else "st.side = 'train'"
    return f""",
st AS (SELECT side, {stats} FROM sides GROUP BY side),
scaled AS (SELECT "Date", "Ticker", x.side, signal_label, "High", "Low", "Open", future_return, {values}
           FROM sides x JOIN st ON {on})"""


_ALL = " AND ".join(f'"{c}" IS NOT NULL' for c in [*FIELDS, *INDICATORS])
_VEC = "[" + ", ".join(f'"{c}"' for c in FEATURES) + "]"
_WINDOWS = f""",
full_rows AS (SELECT *, row_number() OVER (PARTITION BY side, "Ticker" ORDER BY "Date") - 1 AS k,
                count(*) OVER (PARTITION BY side, "Ticker") AS cnt FROM scaled WHERE {_ALL}),
wins AS (SELECT *, flatten(list({_VEC}) OVER (PARTITION BY side, "Ticker" ORDER BY "Date" ROWS 6 PRECEDING)) AS v
         FROM full_rows)"""

_PREDICTIONS = """,
s AS (
  SELECT "Date", "Ticker", signal_label AS label, momentum AS m, exp(-abs(momentum)) AS mid,
         exp(-2 * abs(momentum)) AS low, 1.0 + exp(-abs(momentum)) + exp(-2 * abs(momentum)) AS total
  FROM labelled WHERE momentum IS NOT NULL),
p AS (
  SELECT "Date", "Ticker", label, CAST(sign(m) AS INTEGER) AS prediction,
         round(CASE WHEN m < 0 THEN 1.0 ELSE low END / total, 9) AS p0, round(mid / total, 9) AS p1,
         round(CASE WHEN m < 0 THEN low ELSE 1.0 END / total, 9) AS p2
  FROM s)"""

_PRED = f"WITH {_DAILY}{_FEATURES}{_LABELLED}{_PREDICTIONS}"

_BATCHES = """,
b AS (SELECT *, (row_number() OVER (ORDER BY md5('42|' || "Ticker" || '|' || CAST("Date" AS VARCHAR))) - 1) // 64 AS batch_id
      FROM p),
batches AS (
  SELECT batch_id, count(*) AS n, CAST(sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS BIGINT) AS correct,
         100.0 * sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) / count(*) AS accuracy,
         avg(-ln(greatest(CASE label WHEN -1 THEN p0 WHEN 0 THEN p1 ELSE p2 END, 1e-15))) AS loss
  FROM b GROUP BY 1)"""


def _auc(a: int, b: int) -> str:
    """Rank-sum AUC of class a against class b by the score of class a."""
    return f"""(SELECT (sum(CASE WHEN y = {a} THEN r END) - count(CASE WHEN y = {a} THEN 1 END)
        * (count(CASE WHEN y = {a} THEN 1 END) + 1) / 2.0)
        / (count(CASE WHEN y = {a} THEN 1 END) * count(CASE WHEN y = {b} THEN 1 END)) FROM (
        SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r
        FROM (SELECT label + 1 AS y, p{a} AS s FROM p WHERE label + 1 IN ({a}, {b}))))"""


_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}-{b}' AS pair, ({_auc(a, b)} + {_auc(b, a)}) / 2 AS auc"
    for a, b in ((0, 1), (0, 2), (1, 2)))


# ---------------------------------------------------------------- texts

_SPLIT = r"string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_WORDS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_POS = "['the', 'de', 'to', 'der', 'la']"
_NEG = "['of', 'and', 'en', 'die', 'que']"


def _scored(source: str, text: str) -> str:
    """``source`` with label and score of ``text`` by the tone words."""
    w = _WORDS.format(text)
    return f"""(SELECT *, CASE WHEN pc > nc THEN 'Positive' WHEN nc > pc THEN 'Negative' ELSE 'Neutral' END AS label,
      (greatest(pc, nc) + 1.0) / (pc + nc + 2) AS score
    FROM (SELECT *, len(list_filter({w}, lambda w: list_contains({_POS}, w))) AS pc,
                 len(list_filter({w}, lambda w: list_contains({_NEG}, w))) AS nc FROM {source}))"""


_CHUNKS = """chunks AS (
  SELECT doc_id, text, pos, substring(text, CAST(pos * 1580 + 1 AS BIGINT), 1612) AS chunk
  FROM (SELECT doc_id, text, unnest(range(CAST(greatest(ceil((length(text) - 32) / 1580.0), 1) AS BIGINT))) AS pos
        FROM documents))"""

_MAJORITY = """CASE WHEN p >= n AND p >= u AND p > 0 THEN 'Positive' WHEN n >= u AND n > 0 THEN 'Negative'
    ELSE 'Neutral' END"""


def _aggregated(source: str, by: str) -> str:
    return f"""(SELECT {by}, {_MAJORITY} AS label, total / c AS score, 'aggregated' AS details FROM (
    SELECT {by}, count(*) FILTER (label = 'Positive') AS p, count(*) FILTER (label = 'Negative') AS n,
      count(*) FILTER (label = 'Neutral') AS u, count(*) AS c,
      sum(CASE WHEN label = 'Neutral' THEN (1 - 0.8) * score ELSE score END) AS total
    FROM {source} GROUP BY {by}))"""


_SENTENCES = f"""sents AS (
  SELECT doc_id, pos - 1 AS pos, {_STRIP.format("sentence")} AS sentence FROM (
    SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos
    FROM (SELECT doc_id, {_SPLIT.format("text")} AS parts FROM documents))
  WHERE {_STRIP.format("sentence")} <> '')"""

_MENTIONS = f"""{_SENTENCES},
gaz AS (
  SELECT entity, ['ORG', 'MONEY', 'PERSON', 'GPE', 'PRODUCT', 'DATE', 'NORP'][length(entity) % 7 + 1] AS label FROM (
    SELECT DISTINCT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS entity
    FROM (SELECT {_WORDS.format("text")} AS ws FROM benchmark))),
tokens AS (
  SELECT doc_id, pos, sentence, unnest(ws) AS entity, generate_subscripts(ws, 1) - 1 AS word
  FROM (SELECT *, {_WORDS.format("sentence")} AS ws FROM sents)),
runs AS (
  SELECT doc_id, pos, word, entity, sentence FROM tokens
  UNION ALL SELECT a.doc_id, a.pos, a.word, a.entity || ' ' || b.entity, a.sentence
  FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND a.pos = b.pos AND a.word + 1 = b.word),
mentions AS (SELECT doc_id, pos, word, t.entity, label, sentence FROM runs t JOIN gaz USING (entity)),
kept AS (SELECT * FROM mentions WHERE label IN ('ORG', 'MONEY', 'PERSON', 'GPE', 'PRODUCT'))"""


def _hashed(name: str, source: str, key: str, pieces: str, dim: int) -> str:
    """``name``: (key, bucket, v), fixed-point unit vectors of the hashed pieces of each key."""
    return f"""
{name}_c AS (SELECT {key}, ('0x' || substr(md5(w), 1, 7))::INT % {dim} AS bucket, count(*) AS c
  FROM (SELECT {key}, unnest({pieces}) AS w FROM {source}) GROUP BY ALL),
{name} AS (SELECT {key}, bucket, round(1048576 * c / sqrt(sum(c * c) OVER (PARTITION BY {key}))) / 1048576 AS v FROM {name}_c)"""


_GRAMS = "list_transform(range(1, greatest(length({0}) - 2, 1) + 1), lambda i: substring(lower({0}), i, 3))"

_ARTICLES = """articles AS (
  SELECT doc_id, string_split(text, chr(10))[1] AS title, source AS author,
         CASE WHEN n_chars < 150 THEN '' WHEN source = 'src7' THEN NULL
              WHEN lang = 'es' THEN url || '&unknown' ELSE url END AS url,
         CASE WHEN lang <> 'en' THEN lang END AS symbol
  FROM documents LEFT JOIN pages ON page_id = doc_id % (SELECT count(*) FROM pages))"""

_FETCHED = f"""{_ARTICLES},
fetched AS (
  SELECT doc_id, a.title, a.author, a.url, coalesce(a.symbol, 'unknown') AS symbol, html,
    CASE WHEN page_id IS NULL THEN 'network_error' WHEN contains(a.url, '#') THEN 'timeout_error'
         WHEN contains(a.url, 'page=') THEN 'http_error_404' WHEN contains(a.url, '//m.') THEN 'http_error_503'
         WHEN contains(a.url, '//blog.') THEN 'network_error'
         WHEN contains(a.url, '.org/') THEN 'unexpected_exception' ELSE 'success' END AS status, page_id
  FROM articles a LEFT JOIN pages USING (url) WHERE a.url IS NOT NULL AND a.url <> '')"""

# Paragraph texts of the article element of the stored pages. Sound for these pages only: they have
# one article each, none of the listed classes or ids, and every paragraph is ended by a tag of its
# own or by the next paragraph.
_TAGLESS = r"regexp_replace({0}, '<[^>]*>', '', 'g')"
_PLAIN = (r"replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), "
          r"'&#39;', ''''), '&amp;', '&')").replace('\\"', '"')
_PARAGRAPH = _STRIP.format(_PLAIN.format(_TAGLESS.format("string_split(x, '</p>')[1]")))


def _page_text(html: str) -> str:
    body = f"regexp_extract({html}, '(?s)<article>(.*)</article>', 1)"
    return (f"array_to_string(list_filter(list_transform(string_split({body}, '<p>')[2:], "
            f"lambda x: {_PARAGRAPH}), lambda x: x <> ''), chr(10))")


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, one dynamic-programming row per letter of a."""
    zero = f"list_transform(range(length({b}) + 1), lambda j: 0)"
    step = (f"list_transform(range(1, length({b}) + 2), lambda j: list_max(list_transform(range(1, j + 1), "
            f"lambda i: CASE WHEN i = 1 THEN 0 WHEN {b}[i - 1] = acc.c THEN acc.row[i - 1] + 1 ELSE acc.row[i] END)))")
    return (f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: {{'c': {a}[i], 'row': {zero}}}), "
            f"lambda acc0, x: {{'c': x.c, 'row': {step.replace('acc.c', 'x.c').replace('acc.row', 'acc0.row')}}}, "
            f"{{'c': '', 'row': {zero}}}).row[length({b}) + 1]")


def _tokens(name: str) -> str:
    return (rf"array_to_string(list_sort(list_filter(string_split_regex(lower(regexp_replace({name}, "
            rf"'[^A-Za-z0-9_]', ' ', 'g')), ' +'), lambda w: w <> '')), ' ')")


def _indicator(columns, digits) -> str:
    return f'WITH {_DAILY}{_FEATURES} SELECT "Date", "Ticker", {_r(columns, digits)} FROM features'


ORACLES: dict[str, str] = {
    "bars_daily": f'WITH {_DAILY} SELECT "Date", "Ticker", {_r(FIELDS, 8)} FROM bars',
    "bars_hourly": f'WITH {_HOURLY} SELECT "Date", "Ticker", {_r(FIELDS, 8)} FROM bars',
    "csv_roundtrip": f'WITH {_DAILY} SELECT "Date", "Ticker", {_r(FIELDS, 8)} FROM bars',
    "wide_to_long": f"""WITH {_HOURLY}
SELECT d."Date", t."Ticker", {_r(FIELDS, 8, "b.")}
FROM (SELECT DISTINCT "Date" FROM bars) d CROSS JOIN (SELECT DISTINCT "Ticker" FROM bars) t
LEFT JOIN bars b ON b."Date" = d."Date" AND b."Ticker" = t."Ticker" """,
    "one_hot": f"""WITH {_HOURLY} SELECT "Date", round("Close", 8) AS "Close", """ + ", ".join(
        f"CASE WHEN \"Ticker\" = '{v}' THEN 1 ELSE 0 END AS \"Ticker_{v}\""
        for v in ("click", "error", "purchase", "signup", "view")) + " FROM bars",
    "date_range": f"""WITH {_DAILY} SELECT "Date", "Ticker", round("Close", 8) AS "Close" FROM bars
WHERE "Date" >= DATE '1998-10-06' AND "Date" < DATE '1998-11-30'""",
    "ticker_semi_join": f"""WITH {_DAILY} SELECT "Date", "Ticker", round("Close", 8) AS "Close" FROM bars
WHERE "Ticker" IN (SELECT DISTINCT 'Brand#' || substring(source, 4) AS s FROM documents ORDER BY s LIMIT 100)""",
    "sma": _indicator(["sma"], 6),
    "ema": _indicator(["ema"], 4),
    "rsi": _indicator(["rsi"], 4),
    "macd": _indicator(["macd", "macd_signal", "macd_diff"], 4),
    "daily_return": _indicator(["daily_return"], 6),
    "momentum": _indicator(["momentum"], 6),
    "volatility": _indicator(["volatility"], 6),
    "future_return": _indicator(["future_return"], 6),
    "next_values": _indicator(["Close_lag1", "Volume_lag1"], 8),
    "indicators_hourly": f'WITH {_HOURLY}{_FEATURES} SELECT "Date", "Ticker", {_r(INDICATORS, 4)} FROM features',
    "indicators_resumed": f"""WITH {_DAILY}{_FEATURES}
SELECT "Date", "Ticker", {_r(["ema", "sma", "rsi", "macd", "macd_signal", "macd_diff", "daily_return", "volatility"], 4)}
FROM features WHERE "Date" >= DATE '1995-06-17'""",
    "thresholds": f"""WITH {_DAILY}{_FEATURES}
SELECT round(quantile_cont(future_return, 0.3), 6) AS lower, round(quantile_cont(future_return, 0.7), 6) AS upper,
       count(future_return) AS n FROM features""",
    "signal_labels": f"""WITH {_DAILY}{_FEATURES}{_LABELLED}
SELECT "Date", "Ticker", round(future_return, 6) AS future_return, signal_label FROM labelled""",
    "zscore_self": f"""WITH {_DAILY}{_FEATURES}{_LABELLED}{_SIDES}{_scaled("self")}
SELECT "Date", "Ticker", side, {_r(FEATURES, 4)} FROM scaled""",
    "zscore_train": f"""WITH {_DAILY}{_FEATURES}{_LABELLED}{_SIDES}{_scaled("train")}
SELECT "Date", "Ticker", side, {_r(FEATURES, 4)} FROM scaled""",
    "time_split": f"""WITH {_DAILY},
labelled AS (SELECT * FROM bars){_SIDES} SELECT "Date", "Ticker", side FROM sides""",
    "complete_rows": f"""WITH {_DAILY}{_FEATURES}{_LABELLED}
SELECT "Date", "Ticker", signal_label FROM labelled WHERE {_ALL}""",
    "window_samples": f"""WITH {_DAILY}{_FEATURES}{_LABELLED}{_SIDES}{_scaled("self")}{_WINDOWS}
SELECT "Date", "Ticker", side, signal_label, len(v) AS n_values, round(v[1], 4) AS first_close,
       round(v[79], 4) AS last_close, round(list_sum(v), 4) AS total
FROM wins WHERE k >= 6 AND k <= cnt - 2""",
    "train_resumed": f"""WITH {_DAILY}{_FEATURES}{_LABELLED}{_SIDES}{_scaled("train")}{_WINDOWS}
SELECT 4 AS epochs, 0 AS differ, count(*) AS rows, true AS falls FROM wins WHERE side = 'train' AND k >= 6 AND k <= cnt - 2""",
    "model_roundtrip": f"""WITH {_DAILY}{_FEATURES}{_LABELLED}{_SIDES}{_scaled("train")}{_WINDOWS}
SELECT signal_label, count(*) AS n, 0 AS mismatches FROM wins WHERE side = 'test' AND k >= 6 AND k <= cnt - 2 GROUP BY 1""",
    "label_distribution": f"""{_PRED}
SELECT prediction, count(*) AS n, (SELECT count(*) FROM p) AS total FROM p GROUP BY 1""",
    "confusion_matrix": f"""{_PRED}
SELECT label, count(*) FILTER (prediction = -1) AS pred_down, count(*) FILTER (prediction = 0) AS pred_flat,
       count(*) FILTER (prediction = 1) AS pred_up FROM p GROUP BY 1""",
    "class_report": f"""{_PRED},
c AS (SELECT cls, (SELECT count(*) FROM p WHERE label = cls AND prediction = cls) AS tp,
        (SELECT count(*) FROM p WHERE prediction = cls) AS pp, (SELECT count(*) FROM p WHERE label = cls) AS support
      FROM (VALUES (-1), (0), (1)) v(cls)),
m AS (SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS prec,
        CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM c),
f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM m)
SELECT CAST(cls AS VARCHAR) AS name, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6),
  round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(prec * support) / sum(support), 6),
  round(sum(rec * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""",
    "auc_ovo": f"""{_PRED},
pairs AS ({_PAIRS})
SELECT pair, round(auc, 6) AS auc FROM pairs UNION ALL SELECT 'macro', round(avg(auc), 6) FROM pairs""",
    "eval_batches": f"""{_PRED}{_BATCHES}
SELECT batch_id, n, correct, round(accuracy, 6) AS accuracy, round(loss, 6) AS loss FROM batches""",
    "eval_metrics": f"""{_PRED}{_BATCHES}
SELECT CAST(sum(n) AS BIGINT) AS n, round(100.0 * sum(correct) / sum(n), 6) AS accuracy, round(avg(loss), 6) AS loss FROM batches""",
    "smote": f"""WITH {_DAILY}{_FEATURES}{_LABELLED}{_SIDES},
c AS (SELECT signal_label, count(*) AS n FROM sides WHERE side = 'train' GROUP BY 1)
SELECT signal_label, (SELECT max(n) FROM c) AS n, (SELECT max(n) FROM c) - n AS made, 0 AS outside FROM c""",

    "forest_support": f"""WITH {_DAILY}{_FEATURES}{_LABELLED}{_SIDES}
SELECT signal_label, count(*) AS support, count(*) AS valid,
  (SELECT count(DISTINCT "Ticker") FROM sides WHERE side = 'train')::INT + {len(FEATURES) + 2} AS inputs
FROM sides WHERE side = 'test' GROUP BY 1""",
    "smote_folds": f"""WITH {_DAILY}{_FEATURES}{_LABELLED}{_SIDES},
r AS (SELECT signal_label, ('0x' || substr(md5('42|' || "Ticker" || '|' || CAST("Date" AS VARCHAR)), 1, 7))::INT % 3 AS own
  FROM sides WHERE side = 'train'),
c AS (SELECT f AS fold, signal_label, count(*) FILTER (own <> f) AS n, count(*) FILTER (own = f) AS judged
  FROM r, (SELECT unnest([0, 1, 2]) AS f) GROUP BY 1, 2)
SELECT fold::INT AS fold, signal_label, max(n) OVER (PARTITION BY fold) AS fitted, judged FROM c""",
    "news_flatten": f"""WITH {_ARTICLES} SELECT title, author, url, 'good' AS kind FROM articles
UNION ALL SELECT '{{"status":"ok","articles":[{{"title": "' || doc_id, NULL, NULL, 'bad' FROM articles""",
    "symbol_news_all": f"""SELECT unnest({_SPLIT.format("text")}) AS title, lang AS author,
  'http://news.example.com/' || doc_id AS url, source AS symbol, 'good' AS kind FROM documents
UNION ALL SELECT '{{"none": [{{"content": {{"title": "' || doc_id, NULL, NULL, NULL, 'bad' FROM documents""",
    "symbol_news_last": f"""SELECT {_SPLIT.format("text")}[-1] AS title, lang AS author,
  'http://news.example.com/' || doc_id AS url, source AS symbol, 'good' AS kind FROM documents
UNION ALL SELECT '{{"none": [{{"content": {{"title": "' || doc_id, NULL, NULL, NULL, 'bad' FROM documents""",
    "json_lines": f"""WITH {_ARTICLES}
SELECT title, author, url, symbol, 'good' AS kind FROM articles
UNION ALL SELECT 'null', NULL, NULL, NULL, 'bad' FROM articles
UNION ALL SELECT '{{"title": ' || author, NULL, NULL, NULL, 'bad' FROM articles""",
    "article_status": f"WITH {_FETCHED} SELECT doc_id, url, symbol, status FROM fetched",
    "article_text": f"""WITH {_FETCHED}
SELECT doc_id, CASE WHEN status = 'success' THEN html ELSE title END AS text FROM fetched""",
    "scraped_articles": f"""WITH {_FETCHED}
SELECT title, url, author, CASE WHEN status = 'success' THEN {_page_text("html")} ELSE '' END AS scraped_content,
  status, CASE WHEN status = 'unexpected_exception' THEN 'error on page ' || page_id ELSE '' END AS error_details,
  symbol FROM fetched""",
    "html_main_text": f"SELECT page_id, {_page_text('html')} AS content FROM pages",
    "incremental_state": f"""WITH {_FETCHED}
SELECT DISTINCT title, url, author, status, symbol,
  length(CASE WHEN status = 'success' THEN {_page_text("html")} ELSE '' END)::INT AS size
FROM fetched WHERE coalesce(url, '') <> ''""",
    "incremental_articles": f"""WITH {_FETCHED}
SELECT status, symbol, 2 * count(*) AS n FROM fetched GROUP BY 1, 2
UNION ALL SELECT 'malformed_line', NULL, 2 * count(*) FROM documents""",
    "chunks_fixed": f"""WITH {_CHUNKS}
SELECT doc_id, length(text) > 1792 AS is_long, pos, chunk FROM chunks""",
    "chunk_checks": f"""SELECT doc_id, 0 AS too_long, 0 AS "foreign", {_STRIP.format("text")} = '' AS "none", true AS starts, true AS ends
FROM documents WHERE text IS NOT NULL""",
    "doc_sentiment": f"""WITH {_CHUNKS},
long_chunks AS (SELECT * FROM {_scored("(SELECT * FROM chunks WHERE length(text) > 1792 AND regexp_matches(chunk, '[^[:space:]]'))", "chunk")}),
whole AS (SELECT * FROM {_scored("(SELECT * FROM documents WHERE length(text) <= 1792)", "text")})
SELECT doc_id, label, round(score, 6) AS score, NULL AS details FROM whole
UNION ALL SELECT doc_id, label, round(score, 6), details FROM {_aggregated("long_chunks", "doc_id")}""",
    "chunk_rows_sentiment": f"""WITH s AS (SELECT * FROM {_scored("conversations", "text")})
SELECT conv_id, label, round(score, 6) AS score, details FROM {_aggregated("s", "conv_id")}""",
    "finance_sentences": f"""WITH {_SENTENCES} SELECT doc_id, pos, sentence FROM sents
WHERE list_has_any({_WORDS.format("sentence")}, {[*FINANCE_KEYWORDS, "with", "avec", "und", "from"]})""",
    "entity_mentions": f"WITH {_MENTIONS} SELECT doc_id, pos, entity, label FROM kept",
    "org_entities": f"WITH {_MENTIONS} SELECT DISTINCT doc_id, entity FROM mentions WHERE label = 'ORG'",
    "entity_sentences": f"""WITH {_MENTIONS}
SELECT doc_id, entity, count(*) AS n, string_agg(sentence, chr(10) ORDER BY pos, word) AS sentences
FROM kept GROUP BY 1, 2""",
    "entity_sentiment": f"""WITH {_MENTIONS},
last_one AS (SELECT doc_id, entity, arg_max(sentence, (pos, word)) AS sentence FROM kept GROUP BY 1, 2)
SELECT doc_id, entity, label, round(score, 6) AS score FROM {_scored("last_one", "sentence")}""",
    "ticker_vectors": """SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2""",
    "nearest_ticker": """WITH c AS (
  SELECT label, list(v ORDER BY pos) AS m FROM (
    SELECT label, pos, avg(CAST(x AS DOUBLE)) AS v FROM (
      SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id, c.label AS ticker, list_inner_product(CAST(embedding AS DOUBLE[]), m) AS score FROM embeddings CROSS JOIN c)
SELECT vec_id, ticker, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, ticker) AS r FROM s) WHERE r = 1""",
    "fuzzy_names": f"""WITH q AS (SELECT DISTINCT p_name AS name, {_tokens("p_name")} AS a FROM part),
titles AS (SELECT DISTINCT lower(p_type) || ' ' || string_split(p_name, ' ')[2] || ', ' || string_split(p_name, ' ')[1] AS title FROM part),
c AS (SELECT title, {_tokens("title")} AS b FROM titles),
s AS (SELECT name, title, round_even(200.0 * ({_lcs("a", "b")}) / (length(a) + length(b)), 0) AS score FROM q CROSS JOIN c),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, title) AS rank FROM s)
SELECT name, title, score, rank FROM r WHERE rank <= 5""",
    "doc_embedding": f"""WITH {_CHUNKS},{_hashed("v", "chunks", "doc_id, pos", _WORDS.format("chunk"), 64)}
SELECT doc_id, bucket::INT AS pos, round(sum(v) / any_value(n), 6) AS value
FROM v JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) USING (doc_id)
GROUP BY doc_id, bucket HAVING round(sum(v) / any_value(n), 6) <> 0""",
    "learned_vectors": f"""WITH w AS (SELECT doc_id, unnest({_WORDS.format("text")}) AS w FROM documents),
known AS (SELECT w FROM w GROUP BY 1 HAVING count(*) >= 5),
has AS (SELECT DISTINCT doc_id FROM w JOIN known USING (w))
SELECT lang, count(*) AS n, count(h.doc_id) AS unit, count(*) - count(h.doc_id) AS zero, 32 AS dim
FROM documents d LEFT JOIN has h ON d.doc_id = h.doc_id GROUP BY 1""",
    "entity_tickers": f"""WITH {_MENTIONS},
orgs AS (SELECT DISTINCT entity FROM kept WHERE label = 'ORG'),
tick AS (SELECT 'P' || p_partkey AS symbol, 'P' || p_partkey || p_type || p_name AS text FROM part),{_hashed(
    "e", "orgs", "entity", _GRAMS.format("entity"), 256)},{_hashed("t", "tick", "symbol", _GRAMS.format("text"), 256)},
s AS (SELECT entity, symbol, sum(e.v * t.v) AS s FROM e JOIN t USING (bucket) GROUP BY 1, 2),
best AS (SELECT entity, symbol, s FROM s QUALIFY row_number() OVER (PARTITION BY entity ORDER BY s DESC, symbol) = 1),
links AS (SELECT entity, coalesce(symbol, (SELECT min(symbol) FROM tick)) AS ticker, round(coalesce(s, 0.0), 9) AS similarity
  FROM orgs LEFT JOIN best USING (entity))
SELECT doc_id, entity, n, ticker, similarity
FROM (SELECT doc_id, entity, count(*) AS n FROM kept GROUP BY 1, 2) LEFT JOIN links USING (entity)""",
    "ticker_rows": """SELECT 'P' || p_partkey AS symbol, CASE WHEN p_partkey % 7 > 0 THEN p_type || ', "' || p_brand || '"' END AS sector,
  p_name AS sub_industry FROM part""",
    "ticker_texts": "SELECT DISTINCT p_brand || p_type || p_name AS ticker_text FROM part",
    "date_strings": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
  strftime(o_orderdate - INTERVAL 56 DAY, '%Y-%m-%d') AS start,
  strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS "end" FROM orders""",
    "stripped_texts": f"""SELECT conv_id, turn, {_STRIP.format("chr(32) || chr(9) || chr(10) || text || ' ' || chr(10) || ' '")} AS text
FROM conversations""",
}

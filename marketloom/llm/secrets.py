"""Secret scans: candidate strings, a random forest against false positives, redaction.

Candidates are values assigned to a secret-like name, passwords in URLs, tokens of several dotted parts,
long parts of paths, and runs of letters, digits and +/_- with a digit or of mixed case. Their features are length, entropy, character transitions, coverage by
dictionary words, the path, the marks around and the words before. A random forest of Spark ML
trained from labelled findings decides; the built-in findings are planted in excerpts of the given
documents (issuer formats and assignments as secrets; digests, identifiers, placeholders, versions
and file names as false findings).
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import join_narrow, own, slices, text_sample
from marketloom.session import materialize

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
NAME = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?|bearer)"
CANDIDATE = re.compile(
    # a value assigned to a secret-like name
    rf"(?i:\b{NAME}\w*[\"']?\s{{0,3}}(?:[:=]|=>)\s{{0,3}}[\"']?)(?P<value>[^\s\"'<>,;]{{6,}})"
    # the password of a URL's user-info
    r"|(?<=://)[^\s:/@]*:(?P<login>[^\s/@]{3,})(?=@)"
    # tokens with dots: three parts, or two of which one has a digit
    r"|(?<![\w@+-])(?P<dotted>(?=[A-Za-z_.-]*[0-9])[A-Za-z0-9_-]{2,}(?:\.[A-Za-z0-9_=-]{6,}){1,})(?![\w@])"
    # long parts of a path
    r"|(?<=/)(?P<part>(?=[A-Za-z_-]*[0-9]|[A-Z_-]*[a-z][a-z_-]*[A-Z])[A-Za-z0-9_-]{16,}={0,2})(?![\w@])"
    # free runs with a digit, of mixed case or of capitals
    r"|(?<![\w@./+-])(?P<bare>(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{8,}={0,2}|(?:[A-Z]{16,}|(?=[A-Z]*[a-z]+[A-Z])[A-Za-z]{16,}))(?![\w@])")
NEAR_SECRET = re.compile(rf"(?i)\b{NAME}|\bkey\b|aws|ssh|login")
NEAR_OTHER = re.compile(r"(?i)commit|sha-?(?:1|256)|md5|checksum|digest|uuid|guid|\bid\b|version|file|image|https?:|www\.|example|placeholder|sample|build|order|isbn")
LETTERS = re.compile("[a-z]{3,}")
PLACEHOLDER = re.compile(r"(?i)your|example|change|placeholder|xxx|dummy|sample|test|\*\*\*|<|\$\{|redacted|none|null|todo")
TEST_PATH = re.compile(r"(?i)test|example|sample|mock|fixture|docs?/")
FEATURES = ["length", "entropy", "transitions", "digits", "capitals", "symbols", "hex", "covered",
            "longest_word", "path", "assigned", "quoted", "near_secret", "near_other", "placeholder",
            "distinct", "prefix", "dashes", "dots", "in_url", "then_at"]
FOUND = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                   ("lead", pa.string()), ("features", pa.list_(pa.float64()))])


@cache
def dictionary(path: str) -> frozenset[str]:
    """Whole words of at least three letters in a public vocabulary."""
    import sentencepiece
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    words = (p.id_to_piece(i) for i in range(p.get_piece_size()))
    return frozenset(w[1:].lower() for w in words if re.fullmatch("▁[A-Za-z]{3,}", w))


def _coverage(value: str, words: frozenset[str]) -> tuple[float, int]:
    """Share of characters in dictionary words, greedily from the left, and the longest word."""
    low, i, total, longest = value.lower(), 0, 0, 0
    for run in LETTERS.finditer(low):  # no word spans other characters
        i = run.start()
        while i < run.end() - 2:
            for n in range(min(12, run.end() - i), 2, -1):
                if low[i:i + n] in words:
                    total, longest, i = total + n, max(longest, n), i + n
                    break
            else:
                i += 1
    return total / len(low), longest


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(text: str, start: int, end: int, assigned: bool, path: str,
             words: frozenset[str]) -> list[float]:
    value = text[start:end]
    n = len(value)
    counts = {c: value.count(c) for c in set(value)}
    kinds = [_kind(c) for c in value]
    covered, longest = _coverage(value, words)
    before, after = text[max(0, start - 48):start], text[end:end + 2]
    hexed = re.fullmatch(r"[0-9a-fA-F-]+", value) is not None
    return [math.log1p(n), -sum(k / n * math.log2(k / n) for k in counts.values()),
            sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
            kinds.count(2) / n, kinds.count(1) / n, kinds.count(3) / n, float(hexed), covered,
            float(longest), float(bool(TEST_PATH.search(path or ""))), float(assigned),
            float(before[-1:] in "\"'`" and before != ""),
            float(bool(NEAR_SECRET.search(before))), float(bool(NEAR_OTHER.search(before))),
            float(bool(PLACEHOLDER.search(value))), len(counts) / n,
            float(bool(re.match(r"[A-Za-z]{2,6}[-_]|[A-Z]{4}", value))), float(value.count("-")),
            float(value.count(".")), float("://" in before), float(after[:1] == "@")]


def spans(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in CANDIDATE.finditer(text):
        kind = m.lastgroup
        yield m.start(kind), m.end(kind), kind in ("value", "login")


def candidates(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, version, start, length, lead, features): every candidate of every whole text.

    ``version`` is a hash of the text, which tells rows with one doc_id apart; ``lead`` holds the
    first four characters. ``path`` names a column with the place of the text, if there is one."""
    words = dictionary(vocabulary)  # at most the vocabulary's size, sent with the function

    def run(batches):
        for b in slices(batches):
            out = []
            for doc, version, text, where in zip(*(c.to_pylist() for c in b.columns)):
                for s, e, assigned in spans(text):
                    out.append((doc, version, s, e - s, text[s:s + 4],
                                features(text, s, e, assigned, where, words)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], f.type) for i, f in enumerate(FOUND)], schema=FOUND)

    where = F.col(path).cast("string") if path else F.lit("")
    rows = docs.where("text is not null").select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text",
        F.coalesce(where, F.lit("")).alias("path"))
    return rows.mapInArrow(run, "doc_id long, version long, start long, length long, lead string, "
                                "features array<double>")


def _plant(r: random.Random) -> tuple[str, str, int]:
    """(text before, value, label) of one labelled finding."""
    raw = bytes(r.getrandbits(8) for _ in range(40))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    up = "".join(r.choice(letters) for _ in range(16))
    mixed = base64.b64encode(raw).decode()
    digest = hashlib.sha1(raw).hexdigest()
    long = base64.urlsafe_b64encode(raw + raw[::-1]).decode().replace("=", "")
    token = re.sub(r"[^A-Za-z0-9]", "k", mixed)
    word = r.choice(["river", "window", "update", "manager", "central", "picture", "report"])
    name = r.choice(["password", "token", "secret", "api_key", "auth_token", "access-key", "pwd"])
    sign = r.choice(["=", " = ", ": ", '="', " = \"", "='"])
    return r.choice([
        ("", "AKIA" + up, 1), (r.choice(["aws ", "key ", "id "]), "AKIA" + up, 1),
        ("", r.choice(["ghp_", "gho_"]) + re.sub(r"\W", "a", mixed)[:36], 1),
        ("", r.choice(["sk_live_", "xoxb-"]) + digest[:24], 1),
        (name + sign, digest, 1), (name + sign, digest[:r.randint(12, 24)], 1),
        (name + sign, mixed[:r.randint(16, 40)], 1), ("bearer ", mixed[:40].replace("=", "1"), 1),
        (name + sign, re.sub(r"\W", "x", mixed)[:r.randint(9, 20)] + str(r.randint(1, 99)), 1),
        (r.choice(["commit ", "sha1 ", "checksum ", "md5: "]), digest[:r.choice([32, 40])], 0),
        (r.choice(["uuid ", "id ", "guid "]), f"{digest[:8]}-{digest[8:12]}-{digest[12:16]}-{digest[16:20]}-{digest[20:32]}", 0),
        (name + sign, r.choice(["changeme", "YOUR_TOKEN_HERE", "example123", "xxxxxxxxxx", "********",
                                "<password>", "${SECRET}", "placeholder1", "null_value"]), 0),
        (name + sign, r.choice(["required", "optional", "string", "function", "settings.get"]), 0),
        ("", f"{word}-{r.choice(['one', 'large', 'small'])}-{r.randint(1, 9999)}", 0),
        ("file ", f"{word}_{word}_{r.randint(1, 400)}", 0), ("version ", f"{word}-{r.randint(1, 9)}-release-{r.randint(1, 99)}", 0),
        (r.choice(["order ", "", ""]), str(r.randint(10 ** 12, 10 ** 17)), 0),
        ("", f"SG.{token[:22]}.{long[:43]}", 1), (r.choice(["", "jwt ", "cookie "]), f"eyJ{token[:17]}.eyJ{long[:r.randint(30, 60)]}.{long[10:53]}", 1),
        (f"https://hooks.{word}.com/services/T{up[:8]}/B{up[8:]}/", token[:24], 1),
        (r.choice(["postgres", "mysql", "amqp", "https"]) + f"://{word}:", r.choice([digest[:16], token[:14], token[:9] + "!7"]), 1),
        (r.choice(["", "key ", "code "]), token[:r.randint(16, 30)], 1),
        (f"https://www.{word}.com/{word}/", f"{word}-{word}-{r.choice(['story', 'guide', 'page'])}-{r.randint(1, 99)}", 0),
        (f"https://cdn.{word}.org/", f"{word.title()}{word.title()}{r.choice(['Overview', 'Settings'])}", 0),
        ("", f"{word}.{r.choice(['config', 'manager', 'service'])}.{word}{r.randint(1, 9)}", 0), ("", f"{word}{r.randint(1, 9)}.example.com", 0),
        ("version ", f"v{r.randint(1, 9)}.{r.randint(100000, 999999)}.release", 0), ("", f"{word.title()}{word.title()}{word.title()}", 0),
        (r.choice(["", "room ", "item "]), f"{word[:4]}{r.randint(1000, 99999)}", 0), ("ftp://guest:", "guest", 0), ("https://user:", "password", 0),
        ("", f"{r.randint(1000, 9999)}-{r.randint(1000, 9999)}-{r.randint(1000, 9999)}", 0), ("", f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}", 0),
    ])


def findings(docs: DataFrame, documents: int = 1_500, each: int = 8) -> DataFrame:
    """(text, path, start, label): findings planted in excerpts of about ``documents`` texts
    (chosen by hash), ``each`` per text, the same on every run."""
    some = (text_sample(docs, documents).select(F.substring("text", 1, 600).alias("text"))
            .repartition(6, F.xxhash64("text")))

    def run(batches):
        for b in batches:
            out = []
            for text in b["text"]:
                words = text.split()
                r = random.Random(text)
                for _ in range(each):
                    lead, value, label = _plant(r)
                    at = r.randint(0, len(words))
                    head = " ".join([*words[max(0, at - 12):at], lead]) if at else lead
                    end = r.choice(['"', "'"]) if lead[-1:] in "\"'" else "@db.host" if re.search("://.*:$", lead) else ""
                    path = r.choice(["", "", "src/app.py", "tests/data.py"])
                    out.append((f"{head}{value}{end} {' '.join(words[at:at + 12])}", path, len(head), label))
            yield pd.DataFrame(out, columns=["text", "path", "start", "label"])

    return some.mapInPandas(run, "text string, path string, start long, label long")


def fit(found: DataFrame, trees: int = 30, depth: int = 8, seed: int = 1,
        vocabulary: str = VOCABULARY) -> RandomForestClassificationModel | None:
    """A forest on labelled findings (text, path, start, label); a finding that is no candidate is
    left out. None without both labels: then every candidate counts as a secret."""
    # written first, so that no task runs the workers of two steps
    rows = materialize(found.withColumn("doc_id", F.xxhash64("text", "path", "start")), "planted")
    seen = candidates(rows, "path", vocabulary)
    made = materialize(
        rows.select("doc_id", "start", F.col("label").cast("double")).distinct()
        .join(seen, ["doc_id", "start"])
        .select("label", array_to_vector("features").alias("vector")).repartition(6), "findings")
    if made.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees,
                                  maxDepth=depth, seed=seed).fit(made)


def scan(docs: DataFrame, model: RandomForestClassificationModel | None, threshold: float = 0.5,
         path: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, version, start, length, lead, score, is_secret), a row for each candidate.

    Null and empty texts have none; rows repeating a doc_id and text report each row's."""
    rows = candidates(docs, path, vocabulary)
    if model is None:
        scored = rows.withColumn("score", F.lit(1.0)).drop("features")
    else:
        scored = (model.transform(rows.withColumn("vector", array_to_vector("features")))
                  .withColumn("score", vector_to_array("probability")[1])
                  .select("doc_id", "version", "start", "length", "lead", "score"))
    return scored.withColumn("is_secret", F.col("score") >= threshold)


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``found`` replaced by ``mark``; n_chars, where there is one,
    follows the new text. Documents without findings, and all other columns, stay as they are."""
    doc, version, cuts = own("doc"), own("version"), own("cuts")
    narrow = materialize(
        found.where("is_secret").select("doc_id", "version", "start", "length").distinct()
        .groupBy(F.col("doc_id").alias(doc), F.col("version").alias(version))
        .agg(F.sort_array(F.collect_set(F.struct("start", "length")), asc=False).alias(cuts)), "secrets")
    one = F.aggregate(cuts, F.col("text"), lambda t, s: F.concat(
        F.substring(t, F.lit(1), s.start.cast("int")), F.lit(mark),
        F.substring(t, (s.start + s.length + 1).cast("int"), F.length(t))))
    joined = join_narrow(docs, narrow, (docs["doc_id"].cast("long").eqNullSafe(F.col(doc)))
                         & (F.xxhash64(docs["text"]) == F.col(version)), "left")
    out = joined.withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(one))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cuts).isNull(), F.col("n_chars"))
                             .otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)

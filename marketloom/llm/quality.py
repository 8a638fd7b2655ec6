"""Quality classifier: a sparse rule ensemble compiled to column expressions.

Statistics of a text are built-in expressions. A random forest fitted on all labelled rows gives
tree paths; every prefix of a path is a conjunctive rule over statistics. A logistic regression
with an L1 penalty weighs the rules, and the rules left with a weight become one Spark expression
over a constant table of rules, so scoring is a map over the table without Python and its code does
not grow with the rules.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import WORD, labelled_rows, let, own
from marketloom.session import materialize

THRESHOLD = 0.3
PART_ROWS = 20_000  # labelled rows a task of the fit reads
Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", value) in conjunction

STATISTICS = ["chars", "words", "lines", "word_length", "line_words", "letters", "capitals",
              "digits", "marks", "noisy_words", "repeats", "distinct_words", "distinct_lines",
              "sentence_ends"]


def add_statistics(docs: DataFrame, text: str, into: str) -> DataFrame:
    """``docs`` plus a struct column of STATISTICS over the whole text (null counts as empty).

    Counts are divided by their base, an empty base counting as 1, so every value is finite."""
    t, c, l, w = own("t"), own("c"), own("l"), own("w")

    def without(p: str) -> Column:
        return F.length(F.regexp_replace(t, p, ""))

    made = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    made = made.withColumn(w, F.regexp_extract_all(F.lower(t), F.lit(f"({WORD})"), F.lit(1)))
    made = made.withColumn(l, F.split(t, "\n")).withColumn(c, F.struct(
        F.length(t).alias("n"), without(r"\p{L}+").alias("no_letters"),
        without(r"\p{Lu}+").alias("no_capitals"), without(r"[0-9]+").alias("no_digits"),
        without(r"[^\p{L}\p{N}\s.,'-]+").alias("no_marks"),
        F.size(w).alias("w"), F.size(F.array_distinct(w)).alias("dw"),
        F.size(l).alias("l"), F.size(F.array_distinct(l)).alias("dl"),
        F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,'-]{2}")).alias("noisy"),
        F.regexp_count(t, F.lit(r"(?<![^ \n])([^ \n]+) (?=\1(?![^ \n]))")).alias("again"),
        F.regexp_count(t, F.lit(r"\.(?:\s|$)")).alias("ends")))
    g = {k: F.col(f"{c}.{k}").cast("double") for k in
         ("n", "no_letters", "no_capitals", "no_digits", "no_marks", "w", "dw", "l", "dl",
          "noisy", "again", "ends")}
    one = F.lit(1.0)
    n, words = F.greatest(g["n"], one), F.greatest(g["w"], one)
    letters = g["n"] - g["no_letters"]
    values = [F.log1p(g["n"]), F.log1p(g["w"]), F.log1p(g["l"]), g["n"] / words, words / g["l"],
              letters / n, (g["n"] - g["no_capitals"]) / F.greatest(letters, one),
              (g["n"] - g["no_digits"]) / n, (g["n"] - g["no_marks"]) / n, g["noisy"] / words,
              g["again"] / words, g["dw"] / words, g["dl"] / g["l"], g["ends"] / words]
    return made.withColumn(into, F.struct(*[v.alias(k) for k, v in zip(STATISTICS, values)])).drop(
        t, c, l, w)


def tree_rules(debug: str) -> set[Rule]:
    """Every path prefix of the trees in a forest's text form, as a simplified conjunction."""
    rules, path = set(), []
    for line in debug.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-0-9.E]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, (STATISTICS[int(m[3])], m[4], float(m[5])))]
        tight: dict[tuple[str, str], float] = {}
        for _, (name, sign, value) in path:
            have = tight.get((name, sign), value)
            tight[name, sign] = min(have, value) if sign == "<=" else max(have, value)
        rules.add(tuple(sorted((name, sign, value) for (name, sign), value in tight.items())))
    return rules


def rule_table(rules: Iterable[tuple[Rule, float]]) -> Column:
    """Rules and weights as one constant column."""
    rows = [{"tests": [{"at": STATISTICS.index(name) + 1, "upto": sign == "<=", "value": v} for name, sign, v in rule],
             "weight": w} for rule, w in rules]
    return F.from_json(F.lit(json.dumps(rows)),
                       "array<struct<tests array<struct<at int, upto boolean, value double>>, weight double>>")


def statistic_list(struct: str) -> Column:
    return F.array(*[F.col(f"{struct}.{k}") for k in STATISTICS])


def holds(rule: Column, statistics: Column) -> Column:
    """Whether a row of ``rule_table`` holds."""
    return F.forall(rule["tests"], lambda t: (F.element_at(statistics, t["at"]) <= t["value"]) == t["upto"])


@dataclass
class QualityModel:
    intercept: float
    weights: dict[Rule, float]

    def score(self, struct: str) -> Column:
        rules = rule_table(self.weights.items())
        z = let(statistic_list(struct), lambda x: F.aggregate(
            rules, F.lit(self.intercept), lambda z, r: z + F.when(holds(r, x), r["weight"]).otherwise(0.0)))
        return 1.0 / (1.0 + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, trees: int = 20, depth: int = 3, penalty: float = 0.002,
        label: str = "quality") -> QualityModel:
    """Fit on all labelled rows outside fold 0. Without labels the score is 0.5, with one class
    only it is that class's smoothed share."""
    s, v = own("s"), own("v")
    rows = materialize(add_statistics(labelled_rows(docs, labels, label), "text", s)
                       .select("label", F.col(s)), "training")
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    share = (good + 1) / (n + 2)
    prior = math.log(share / (1 - share))
    if good in (0, n):
        return QualityModel(prior, {})
    vectors = rows.select("label", s, array_to_vector(statistic_list(s)).alias(v)).coalesce(4 + n // PART_ROWS)
    forest = RandomForestClassifier(featuresCol=v, labelCol="label", numTrees=trees, maxDepth=depth,
                                    seed=5, subsamplingRate=0.7).fit(vectors)
    rules = sorted(tree_rules(forest.toDebugString))
    if not rules:
        return QualityModel(prior, {})
    marks = vectors.select("label", array_to_vector(let(statistic_list(s), lambda x: F.transform(
        rule_table((r, 0.0) for r in rules), lambda r: holds(r, x).cast("double")))).alias(v))
    fitted = LogisticRegression(featuresCol=v, labelCol="label", elasticNetParam=1.0,
                                regParam=penalty, standardization=False, maxIter=100).fit(marks)
    return QualityModel(float(fitted.intercept), {
        r: float(w) for r, w in zip(rules, fitted.coefficients.toArray()) if abs(w) > 1e-9})


def score(docs: DataFrame, model: QualityModel, into: str = "score") -> DataFrame:
    """``docs`` plus ``into``, the probability of good quality; null text is scored as empty.

    All columns and rows stay, repeated rows get equal scores."""
    s = own("s")
    # generated, so that a filter on it stays above and does not compute the statistics per rule
    return add_statistics(docs, "text", s).withColumn(into, F.explode(F.array(model.score(s)))).drop(s)

"""Quality classifier: a sparse ensemble of rules over text statistics.

A shallow random forest is grown on all labelled rows. Every path from a root to a node is
a conjunctive rule; an L1-penalised logistic regression weighs the rules, and those with a weight are
compiled into one Spark column expression, so scoring is JVM-side and a single pass.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.scale import BROADCAST_ROWS
from .common import materialise
from .text_stats import RATIOS, ratios

Condition = tuple[str, bool, float]  # feature, "greater than", threshold


def paths(debug: str, names: list[str]) -> set[tuple[Condition, ...]]:
    """All root-to-node paths of a tree, from its printed form; tests on one feature and side are merged."""
    out, stack = set(), []
    for line in debug.splitlines():
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, (names[int(m[3])], m[4] == ">", float(m[5]))))
        tight: dict[tuple[str, bool], float] = {}
        for _, (name, above, x) in stack:
            old = tight.get((name, above), x)
            tight[name, above] = max(old, x) if above else min(old, x)
        out.add(tuple(sorted((n, a, x) for (n, a), x in tight.items())))
    return out


def compiled(rule: tuple[Condition, ...]) -> Column:
    """A rule as 0 or 1."""
    cond = F.lit(True)
    for name, above, x in rule:
        cond = cond & ((F.col(name) > F.lit(x)) if above else (F.col(name) <= F.lit(x)))
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


@dataclass
class RuleEnsemble:
    rules: list[tuple[Condition, ...]]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1, from 0 to 1."""
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z = z + compiled(rule) * F.lit(w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(rows: DataFrame, features: list[str], label: str = "label", trees: int = 40, depth: int = 3, penalty: float = 0.0005, seed: int = 7) -> RuleEnsemble:
    """Fit on all ``rows`` (features double, label 0 or 1).

    Without rows of both labels the model is a constant: the smoothed share of label 1 (0.5 without rows).
    """
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0))).first()
    share = (ones + 1) / (n + 2)
    constant = RuleEnsemble([], [], math.log(share / (1 - share)))
    if not 0 < ones < n:
        return constant
    vectors = VectorAssembler(inputCols=features, outputCol="x").transform(rows).select("x", F.col(label).cast("double").alias("y"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5,
                                    featureSubsetStrategy="onethird", seed=seed).fit(vectors)
    rules = sorted(set().union(*[paths(t.toDebugString, features) for t in forest.trees]))
    if not rules:
        return constant
    truth = rows.select(array_to_vector(F.array(*[compiled(r) for r in rules])).alias("x"), F.col(label).cast("double").alias("y"))
    lasso = LogisticRegression(featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=penalty, maxIter=100, standardization=False).fit(materialise(truth))
    weighed = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-6]
    return RuleEnsemble([r for r, _ in weighed], [w for _, w in weighed], float(lasso.intercept))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> RuleEnsemble:
    """Learn from all labelled ids outside the held-out fifth.

    Rows without label or id are not learned from; several labels of one id are averaged. Few labels travel to the texts; many
    meet their statistics, so that no text is shuffled.
    """
    marks = labels.filter(F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("label"))
    marks, texts = materialise(marks), docs.select("doc_id", "text")
    if marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = ratios(texts.join(F.broadcast(marks), "doc_id"), ["doc_id", "label"])
    else:
        known = ratios(texts, ["doc_id"]).join(marks, "doc_id")
    return fit(materialise(known.dropDuplicates(["doc_id"]).select("label", *RATIOS)), RATIOS)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    The score uses statistics of the text alone. Null or empty texts have all statistics 0 and get the score of
    that point; a null id is held out; repeated rows each get a row. No labels: every score is 0.5.
    """
    score = train(docs, labels, label).score()
    scored = ratios(docs, ["doc_id"]).select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not reject."""
    score = train(docs, labels, label).score()
    scored = ratios(docs.select(F.struct("*").alias("_row"), "text"), ["_row"]).select("_row", score.alias("_s"), F.monotonically_increasing_id().alias("_n"))
    # the row number keeps the filter above the statistics, which would else be computed again for every word
    return scored.filter((F.col("_s") >= threshold) & (F.col("_n") >= 0)).select("_row.*")

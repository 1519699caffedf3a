"""Metrics, calibration and error reports from (truth, prediction, scores)."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..core.session import materialise


def topk_labels(scores: Column | str, k: int = 3) -> Column:
    """Best k of an array of (label, score), ties by label."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    keyed = F.transform(scores, lambda s: F.struct((-s["score"]).alias("o"), s["label"].alias("label"), s["score"].alias("score")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: F.struct(s["label"].alias("label"), s["score"].alias("score")))


def temperature_softmax(scores: Column | str, temperature: float = 1.0) -> Column:
    """Probabilities of an array of (label, score): softmax(score / T), shifted by the maximum."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    z = F.transform(scores, lambda s: s["score"] / F.lit(float(temperature)))
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(scores, e, lambda s, x: F.struct(s["label"].alias("label"), (x / total).alias("score")))


def _nll(scores: str, truth: str, t: Column) -> Column:
    z = F.transform(scores, lambda s: s["score"] / t)
    top = F.array_max(z)
    lse = F.log(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top
    own = F.element_at(F.filter(scores, lambda s: s["label"] == F.col(truth)), 1)["score"] / t
    return lse - own


def temperature_fit(df: DataFrame, scores: str, truth: str, resolution: float = 1e-3, low: float = 1 / 50, high: float = 50.0) -> DataFrame:
    """Scalar T that minimises the mean negative log likelihood of softmax(score / T): one row.

    The loss is convex in 1/T, so a coarse lattice on log T brackets the minimum and each pass
    refines it 16-fold: a few aggregations over the data, each with all its temperatures at once
    and one row per temperature and task to shuffle. Rows whose truth has no score are left out.
    """
    from math import ceil, floor, log

    lo, hi = ceil(log(low) / resolution), floor(log(high) / resolution)
    step = 1
    while (hi - lo) / step > 32:
        step *= 16
    points = list(range(lo, hi + 1, step))
    rows = materialise(df.select(scores, truth).filter(F.exists(scores, lambda s: s["label"] == F.col(truth))))
    while True:
        grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(exp(i * resolution)).alias("t")) for i in points]))
        loss = rows.select(scores, truth, grid.alias("_g")).groupBy("_g.i").agg(F.avg(_nll(scores, truth, F.col("_g.t"))).alias("nll"))
        best = loss.agg(F.min(F.struct("nll", "i")).alias("b")).first()["b"]
        if best is None or best["nll"] is None:
            return df.sparkSession.createDataFrame([], "temperature double, nll double")
        if step == 1:
            break
        finer = max(1, step // 16)
        points = list(range(max(lo, best["i"] - step), min(hi, best["i"] + step) + 1, finer))
        step = finer
    return df.sparkSession.createDataFrame([(exp(best["i"] * resolution), best["nll"])], "temperature double, nll double")


def calibration_bins(conf: Column, bins: int = fixed.ECE_BINS) -> Column:
    """Right-closed bins; the first one includes 0."""
    return F.greatest(F.lit(1), F.ceil(conf * bins)).cast("int")


def expected_calibration_error(df: DataFrame, conf: str, hit: str, bins: int = fixed.ECE_BINS) -> DataFrame:
    b = df.groupBy(calibration_bins(F.col(conf), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(hit).cast("double")).alias("acc"), F.avg(conf).alias("c"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("c"))) / F.sum("n")).alias("ece"))


def _top_set(p: str) -> Column:
    return F.array_sort(F.transform(topk_labels(p), lambda s: s["label"]))


def calibration_report(df: DataFrame, before: str, after: str, truth: str, bins: int = fixed.ECE_BINS) -> DataFrame:
    """ECE, mean top probability and share under one half before and after, and how many first
    guesses or top-3 sets change. Two grouped passes over the same projection."""
    r = df.select(
        topk_labels(before, 1)[0].alias("b"), topk_labels(after, 1)[0].alias("a"), F.col(truth).alias("truth"),
        (_top_set(before) != _top_set(after)).alias("set_changed"))
    r = r.select(F.col("b.score").alias("cb"), (F.col("b.label") == F.col("truth")).alias("hb"),
                 F.col("a.score").alias("ca"), (F.col("a.label") == F.col("truth")).alias("ha"),
                 (F.col("b.label") != F.col("a.label")).alias("changed"), "set_changed")
    s = r.agg(F.count(F.lit(1)).alias("n"), F.avg("cb").alias("mean_max_before"), F.avg("ca").alias("mean_max_after"),
              F.avg((F.col("cb") < 0.5).cast("double")).alias("below_half_before"), F.avg((F.col("ca") < 0.5).cast("double")).alias("below_half_after"),
              F.count_if("changed").alias("top1_changed"), F.count_if("set_changed").alias("top3_set_changed"))
    s = s.withColumn("ece_before", expected_calibration_error(r, "cb", "hb", bins).scalar())
    return s.withColumn("ece_after", expected_calibration_error(r, "ca", "ha", bins).scalar())


def confusion_counts(df: DataFrame, true: str, pred: str, labels: list) -> DataFrame:
    """Counts over the whole grid of a fixed label list, zero where a cell is empty."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[true]
    one = spark.range(1).select(F.explode(F.array(*[F.lit(v).cast(kind) for v in labels])).alias(true))
    grid = one.select(true, F.explode(F.array(*[F.lit(v).cast(kind) for v in labels])).alias(pred))
    seen = df.groupBy(true, pred).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(seen, [true, pred], "left").na.fill(0, ["n"])


def class_scores(df: DataFrame, true: str, pred: str, by: list[str] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Per class (and per ``by``): support, predicted, hits, recall and F1.

    With ``labels`` (one column, the fixed label list) every label is listed and absent ones
    score 0; without it the classes met as truth or prediction are listed.
    """
    by = by or []
    cells = df.groupBy(*by, F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    truth = cells.groupBy(*by, F.col("t").alias("cls")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    guess = cells.groupBy(*by, F.col("p").alias("cls")).agg(F.sum("n").alias("n_pred"))
    per = truth.join(guess, [*by, "cls"], "full_outer")
    if labels is not None:
        name = labels.columns[0]
        if by:
            combos = cells.select(*by).distinct()
            listed = labels.agg(F.collect_list(name)).scalar()  # the label list
            combos = combos.select(*by, F.explode(listed).alias("cls"))
        else:
            combos = labels.select(F.col(name).alias("cls"))
        per = combos.join(per, [*by, "cls"], "left")
    per = per.na.fill(0, ["n", "hits", "n_pred"])
    zero = F.lit(0.0)
    recall = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("n").cast("double")), zero)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), (F.col("n") + F.col("n_pred")).cast("double")), zero)
    return per.select(*by, "cls", "n", "n_pred", "hits", recall.alias("recall"), f1.alias("f1"))


def accuracy_macro_f1(df: DataFrame, true: str, pred: str, by: list[str] | None = None, labels: DataFrame | None = None, top3: Column | None = None) -> DataFrame:
    """Accuracy, share of top-3 hits (if given) and macro-F1, per combination of ``by``."""
    by = by or []
    per = class_scores(df, true, pred, by, labels).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    cols = [F.count(F.lit(1)).alias("n"), F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy")]
    if top3 is not None:
        cols.append(F.avg(top3.cast("double")).alias("top3"))
    base = df.groupBy(*by).agg(*cols)
    if by:
        return base.join(per, by)
    return base.withColumn("macro_f1", per.scalar())


def errors_table(df: DataFrame, key: str, truth: str, probs: str, meta: DataFrame | None = None) -> DataFrame:
    """Wrong rows with the two best labels and probabilities, enriched, most confident first."""
    best = topk_labels(probs, 2)
    e = df.select(key, F.col(truth).alias("truth"), best.alias("_b")).filter(F.col("truth") != F.col("_b")[0]["label"])
    e = e.select(key, "truth", F.col("_b")[0]["label"].alias("pred"), F.bround(F.col("_b")[0]["score"], 3).alias("prob"),
                 F.col("_b")[1]["label"].alias("second_guess"), F.bround(F.col("_b")[1]["score"], 3).alias("second_prob"))
    if meta is not None:
        e = e.join(meta, key, "left")
    return e.orderBy(F.desc("prob"), key)


def score_reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-3) -> DataFrame:
    """Both scores per key, their gap and whether it is within the tolerance."""
    both = a.select(*keys, F.col(value).alias("recomputed")).join(b.select(*keys, F.col(value).alias("published")), keys, "full_outer")
    gap = F.abs(F.col("recomputed") - F.col("published"))
    return both.withColumn("gap", gap).withColumn("agrees", F.coalesce(gap < tolerance, F.lit(False)))


def verdict_tier(top1: Column, support: Column) -> Column:
    """confident / supported / low from the top probability and the supporting neighbours."""
    return (F.when(F.coalesce(top1, F.lit(0.0)) >= fixed.LOW_CONFIDENCE, "confident")
            .when(F.coalesce(support, F.lit(0)) >= fixed.SUPPORT_MIN, "supported").otherwise("low"))


def verdict_tiers(predictions: DataFrame, neighbours: DataFrame, key: str) -> DataFrame:
    """Verdict per answer.

    ``predictions``: key, label, prob (first guess; null for an empty answer).
    ``neighbours``: key, label, similarity.
    """
    n = neighbours.select(key, F.col("label").alias("_nl"), "similarity").join(predictions.select(key, "label"), key)
    s = n.groupBy(key).agg(
        F.count_if((F.col("_nl") == F.col("label")) & (F.col("similarity") >= fixed.SUPPORT_SIMILARITY)).alias("support"),
        F.count(F.lit(1)).alias("n_similar"))
    out = predictions.join(s, key, "left").na.fill(0, ["support", "n_similar"])
    return out.select(key, "label", F.coalesce("prob", F.lit(0.0)).alias("top1"), "support", "n_similar", verdict_tier(F.col("prob"), F.col("support")).alias("tier"))


def recall_drop(per_class: DataFrame, scheme: str, version: str, base: str, other: str) -> DataFrame:
    """Recall of two versions side by side per (scheme, class), and the drop."""
    wide = per_class.filter(F.col(version).isin(base, other)).groupBy(scheme, "cls").agg(
        F.max(F.when(F.col(version) == base, F.col("n"))).alias("n"),
        F.max(F.when(F.col(version) == base, F.col("recall"))).alias("recall_base"),
        F.max(F.when(F.col(version) == other, F.col("recall"))).alias("recall_other"))
    return wide.withColumn("drop", F.col("recall_base") - F.col("recall_other"))


def top_flag(df: DataFrame, group: str, order: list[Column], n: int = 5) -> DataFrame:
    """Add ``top``: whether the row is among the first n of its group (one row per class here)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("top", F.row_number().over(w) <= n)

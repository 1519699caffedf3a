"""Model fits with ``pyspark.ml``: distributed gradient passes, coefficients of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.scale import join_small
from ..core.session import materialise
from .probes import Coded, SoftmaxFits, forests
from .sampling import hash_sample_n, stratified_folds


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Add ``_w`` = n / (K * n_class), so that every class weighs the same and weights sum to n."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nk"))
    mean = c.agg(F.sum("_nk") / F.count(F.lit(1)))  # n / K
    w = c.select(label, (mean.scalar() / F.col("_nk")).alias("_w"))
    return join_small(df, w, [label])


class LinearProbe:
    """A fitted balanced multinomial logistic regression; ``score`` adds logits and probabilities."""

    def __init__(self, model, classes: list[str], label_type: str, vec: str):
        self.model, self.classes, self.label_type, self.vec = model, classes, label_type, vec

    def score(self, df: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(c).cast(self.label_type) for c in self.classes])
        x = df.withColumn("_x", array_to_vector(F.col(self.vec).cast("array<double>")))
        pairs = lambda c: F.zip_with(names, vector_to_array(c), lambda a, b: F.struct(a.alias("label"), b.alias("score")))
        out = self.model.transform(x).withColumn("logits", pairs("_raw")).withColumn("probs", pairs("_prob"))
        return out.drop("_x", "_raw", "_prob", "_pred")


def side_by_side(work: list, at_once: int = 8) -> list:
    """Results of calls without arguments, run at the same time: small fits leave most of a cluster idle when they wait for each other."""
    spark = SparkSession.active()
    with ThreadPool(min(at_once, max(1, len(work)))) as pool:
        return pool.map(lambda call: call(), [inheritable_thread_target(spark)(c) for c in work])


def class_table(df: DataFrame, label: str) -> list:
    """``(class, rows)`` in text order: one aggregate, as bounded as the model that has a coefficient per class and feature."""
    return sorted(map(tuple, df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1))).collect()), key=lambda r: str(r[0]))


def _softmax_model(rows: DataFrame, sizes: dict[int, int], C: float, max_iter: int):
    """Balanced multinomial fit of ``_x`` and class number ``_y``; ``sizes`` has the rows of each class number that occurs."""
    n = sum(sizes.values())
    weights = rows.sparkSession.createDataFrame([(float(k), n / len(sizes) / m) for k, m in sizes.items()], "_y double, _w double")
    lr = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", family="multinomial", regParam=1.0 / (C * n), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_pred")
    return lr.fit(rows.join(F.broadcast(weights), "_y").select("_x", "_y", "_w"))


def _numbered(df: DataFrame, label: str, classes: list) -> DataFrame:
    """Add the class number ``_y`` in the order of ``classes``."""
    numbers = df.sparkSession.createDataFrame([(c, float(i)) for i, (c, _) in enumerate(classes)], f"`{label}` {df.schema[label].dataType.simpleString()}, _y double")
    return df.join(F.broadcast(numbers), label)


def linear_probe_fit(df: DataFrame, vec: str, label: str, C: float = 1.0, max_iter: int = 100) -> LinearProbe:
    """Balanced multinomial logistic regression with an L2 penalty.

    The usual objective 0.5 |w|^2 + C sum(w_i loss_i) equals Spark's mean loss + regParam / 2 |w|^2
    at regParam = 1 / (C n), because balanced weights sum to n. Features are not standardised. Rows without label are left out.
    """
    classes = class_table(df, label)
    x = _numbered(df.select(label, array_to_vector(F.col(vec).cast("array<double>")).alias("_x")), label, classes)
    model = _softmax_model(x, {i: m for i, (_, m) in enumerate(classes)}, C, max_iter)
    return LinearProbe(model, [str(c) for c, _ in classes], dict(df.dtypes)[label], vec)


def cv_out_of_fold(df: DataFrame, key: str, vec: str, label: str, folds: int = 5, seed: int = 42, C: float = 1.0, max_iter: int = 100) -> DataFrame:
    """Scores of every row from a model that never saw it.

    Folds come from (id, class); the rows are written once with them. The fits, one per fold, run side by side.
    """
    rows = materialise(stratified_folds(df, label, key, folds, seed))
    sizes = rows.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n")).collect()  # folds x classes
    kind = dict(df.dtypes)[label]

    def scored(f: int) -> DataFrame:
        per: dict = {}
        for r in sizes:
            if r["fold"] != f:
                per[r[label]] = per.get(r[label], 0) + r["n"]
        classes = sorted(per.items(), key=lambda r: str(r[0]))
        train = rows.filter(F.col("fold") != f).select(label, array_to_vector(F.col(vec).cast("array<double>")).alias("_x"))
        model = _softmax_model(_numbered(train, label, classes), {i: m for i, (_, m) in enumerate(classes)}, C, max_iter)
        return LinearProbe(model, [str(c) for c, _ in classes], kind, vec).score(rows.filter(F.col("fold") == f))

    return reduce(DataFrame.unionByName, side_by_side([lambda f=f: scored(f) for f in range(folds)]))


def mixed_feature_probe(df: DataFrame, key: str, label: str, sets: dict[str, tuple[list[str], list[str]]], models: list[str],
                        folds: int = 5, seed: int = 42, trees: int = 200, max_iter: int = 5000, C: float = 1.0) -> DataFrame:
    """Out-of-fold predictions per (feature set, model): key, truth, pred. The logistic model has the L2 penalty of ``linear_probe_fit``.

    The rows are coded once. All logistic models share the passes of Newton's method; forests grow on the counts of binned rows.
    Rows without label are left out; without rows there are none.
    """
    cats, nums = (sorted({c for s in sets.values() for c in s[i]}) for i in (0, 1))
    rows = materialise(stratified_folds(df.filter(F.col(label).isNotNull()).select(key, label, *cats, *nums), label, key, folds, seed))
    classes, kind = class_table(rows, label), dict(df.dtypes)
    if not classes:
        return df.sparkSession.createDataFrame([], f"feature_set string, model string, `{key}` {kind[key]}, truth {kind[label]}, pred {kind[label]}")
    data = Coded(rows, key, label, classes, cats, nums, folds)
    make = {"logistic": lambda: SoftmaxFits(data, sets, C, max_iter).predicted(), "forest": lambda: forests(data, sets, trees, seed)}
    return reduce(DataFrame.unionByName, side_by_side([make[m] for m in models]))


def _softmax_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, penalty: float, max_iter: int, tol: float = 1e-5) -> np.ndarray:
    """Weighted multinomial logistic regression by L-BFGS: (features + 1) x classes, intercepts last and without penalty."""
    n, d = x.shape
    x = np.hstack([x, np.ones((n, 1))])
    hot = np.eye(k)[y]

    def value(v):
        m = v.reshape(d + 1, k)
        z = x @ m
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        total = e.sum(axis=1, keepdims=True)
        free = m.copy()
        free[d] = 0
        loss = float(w @ (np.log(total[:, 0]) - (z * hot).sum(axis=1))) / n + penalty / 2 * float((free * free).sum())
        return loss, (x.T @ ((e / total - hot) * w[:, None]) / n + penalty * free).ravel()

    v, pairs = np.zeros((d + 1) * k), []
    f, g = value(v)
    for _ in range(max_iter):
        if np.abs(g).max() < tol:
            break
        q, back = g.copy(), []
        for s, t, r in reversed(pairs):
            a = r * (s @ q)
            back.append(a)
            q -= a * t
        if pairs:
            s, t, _ = pairs[-1]
            q *= (s @ t) / (t @ t)
        for (s, t, r), a in zip(pairs, reversed(back)):
            q += (a - r * (t @ q)) * s
        slope, step = float(g @ q), 1.0
        while True:
            new_f, new_g = value(v - step * q)
            if new_f <= f - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, t = -step * q, new_g - g
        if step < 1e-10:
            break
        if s @ t > 1e-12:
            pairs = [*pairs[-9:], (s, t, 1 / (s @ t))]
        v, f, g = v + s, new_f, new_g
    return v.reshape(d + 1, k)


def _shuffled_f1(y: np.ndarray, k: int, cats: list[np.ndarray], nums: np.ndarray, folds: int, seed: int, replicate: int, C: float, max_iter: int) -> float:
    """Macro-F1 of out-of-fold predictions after shuffle ``replicate`` of the labels; 0 leaves them as they are."""
    if replicate:
        y = y[np.random.default_rng([seed, replicate]).permutation(len(y))]
    order = np.random.default_rng(seed).permutation(len(y))
    order = order[np.argsort(y[order], kind="stable")]
    first = np.searchsorted(y[order], np.arange(k))
    fold = np.empty(len(y), dtype=int)
    fold[order] = (np.arange(len(y)) - first[y[order]]) % folds
    pred = np.zeros(len(y), dtype=int)
    for f in range(folds):
        train = fold != f
        if train.all():
            continue
        mean, dev = (nums[train].mean(axis=0), nums[train].std(axis=0)) if nums.shape[1] else (0.0, 1.0)
        parts = [(nums - mean) / np.where(dev > 0, dev, 1.0)]
        for c in cats:
            levels = np.unique(c[train])
            parts.append((c[:, None] == levels[None, :]).astype(float))
        x = np.hstack(parts)
        size = np.bincount(y[train], minlength=k)
        w = train.sum() / max(1, (size > 0).sum()) / np.maximum(size, 1)
        m = _softmax_fit(x[train], y[train], w[y[train]], k, 1.0 / (C * train.sum()), max_iter)
        z = x[~train] @ m[:-1] + m[-1]
        z[:, size == 0] = -np.inf
        pred[~train] = z.argmax(axis=1)
    hit = np.bincount(y[y == pred], minlength=k)
    support = np.bincount(y, minlength=k) + np.bincount(pred, minlength=k)
    return float((2 * hit / np.maximum(support, 1))[support > 0].mean())


def permuted_probe(df: DataFrame, key: str, label: str, sets: dict[str, tuple[list[str], list[str]]], folds: int = 5, seed: int = 42,
                   permutations: int = 200, C: float = 1.0, max_iter: int = 5000, rows: int = 20_000) -> DataFrame:
    """Permutation test of the logistic probe's out-of-fold macro-F1, per feature set.

    Every (feature set, replicate) is fitted on its own in a task, on the labels as they are and under
    ``permutations`` shuffles. The test uses at most ``rows`` rows, the first in hash order.
    """
    cats, nums = (sorted({c for s in sets.values() for c in s[i]}) for i in (0, 1))
    picked = hash_sample_n(df.filter(F.col(label).isNotNull()).select(key, label, *cats, *nums), key, rows, seed)
    entry = F.struct(F.col(key).alias("id"), F.col(label).cast("string").alias("y"),
                     F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cats]).cast("array<string>").alias("c"),
                     F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) for c in nums]).cast("array<double>").alias("v"))
    chunk = 5
    table = picked.agg(F.sort_array(F.collect_list(entry)).alias("rows"))  # at most ``rows`` entries
    jobs = table.select("rows", F.explode(F.array(*[F.lit(s) for s in sets])).alias("feature_set")).select(
        "rows", "feature_set", F.explode(F.sequence(F.lit(0), F.lit(permutations // chunk))).alias("part"))
    jobs = jobs.repartition(len(sets) * (permutations // chunk + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part, entries in zip(pdf["feature_set"], pdf["part"], pdf["rows"]):
                out = []
                if len(entries):
                    classes, y = np.unique([e["y"] for e in entries], return_inverse=True)
                    use_c, use_v = [cats.index(c) for c in sets[name][0]], [nums.index(c) for c in sets[name][1]]
                    coded = [np.unique([e["c"][i] for e in entries], return_inverse=True)[1] for i in use_c]
                    v = np.array([[e["v"][i] for i in use_v] for e in entries], dtype=float).reshape(len(entries), len(use_v))
                    for rep in range(part * chunk, min((part + 1) * chunk, permutations + 1)):
                        out.append((name, rep, _shuffled_f1(y, len(classes), coded, v, folds, seed, rep, C, max_iter)))
                yield pd.DataFrame(out, columns=["feature_set", "replicate", "f1"])

    f1 = materialise(jobs.mapInPandas(run, "feature_set string, replicate int, f1 double"))
    seen = f1.filter("replicate = 0").select("feature_set", F.col("f1").alias("_seen"))
    null = f1.filter("replicate > 0").join(seen, "feature_set")
    return null.groupBy("feature_set").agg(
        F.avg("f1").alias("perm_macro_f1_mean"), F.percentile("f1", 0.99).alias("perm_macro_f1_p99"),
        ((1 + F.count_if(F.col("f1") >= F.col("_seen"))) / (F.count(F.lit(1)) + 1)).alias("perm_p"), F.count(F.lit(1)).alias("permutations"))


MOMENT_ROWS = 64  # rows of a moment matrix that travel together


def fold_moments(df: DataFrame, vec: str, target: str) -> DataFrame:
    """Sums of products of (1, vector, target) per ``fold``, as rows of the symmetric matrix: ``fold, i, sums``.

    A task adds up its rows as one matrix product per batch and fold; what is shuffled are matrices of the dimensions.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            m = np.column_stack([np.ones(len(pdf)), np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, 0)), pdf["y"].to_numpy()]) if len(pdf) else None
            for f in np.unique(pdf["fold"]):
                own = m[pdf["fold"].to_numpy() == f]
                total[f] = total.get(f, 0) + own.T @ own
        for f, m in total.items():
            for a in range(0, len(m), MOMENT_ROWS):
                part = m[a:a + MOMENT_ROWS]
                yield pd.DataFrame({"fold": f, "i": np.arange(a, a + len(part)), "sums": list(part)})

    rows = df.select("fold", F.col(vec).cast("array<double>").alias("v"), F.col(target).cast("double").alias("y"))
    parts = rows.mapInPandas(run, "fold int, i int, sums array<double>")
    add = F.aggregate(F.collect_list("sums"), F.first(F.transform("sums", lambda x: F.lit(0.0))), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return parts.groupBy("fold", "i").agg(add.alias("sums"))  # one list entry per task


def ridge_cv_r2(df: DataFrame, key: str, vec: str, target: str, alphas: list[float], folds: int = 5, seed: int = 42) -> DataFrame:
    """Cross-validated R2 of a ridge regression of ``target`` on vectors whose alpha is chosen inside each training set.

    Two passes over the rows, no refits. The first adds up each fold's moments; a training set's are those of all folds
    less its own, and one eigendecomposition of them solves every alpha. The second pass adds up, per fold and alpha, the
    squared leave-one-out errors of the training rows (from their leverages) and the squared errors of the held-out rows. The
    alpha with the least leave-one-out error predicts the fold (ties: the smaller). Returns ``fold, alpha, loo_mse, n, r2``
    with a row per fold and one with null fold for all predictions together. Rows without target or vector are left out.
    """
    kept = df.filter(F.col(target).isNotNull() & F.col(vec).isNotNull()).select(key, vec, target, F.lit("all").alias("_all"))
    rows = materialise(stratified_folds(kept, "_all", key, folds, seed).select("fold", vec, target))
    moments: dict[int, dict] = {}
    for r in fold_moments(rows, vec, target).toLocalIterator():  # folds x dimensions rows
        moments.setdefault(r["fold"], {})[r["i"]] = r["sums"]
    schema = "fold int, alpha double, loo_mse double, n long, r2 double"
    per = {f: np.array([m[i] for i in range(len(m))]) for f, m in moments.items()}
    if len(per) < 2:
        return df.sparkSession.createDataFrame([], schema)
    everything, steps = sum(per.values()), np.array(alphas, dtype=float)
    solved = {}
    for f, own in per.items():
        m = everything - own
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        centred = m[1:, 1:] - n * np.outer(mean, mean)
        values, axes = np.linalg.eigh(centred[:-1, :-1])
        shrunk = 1 / (np.maximum(values, 0)[:, None] + steps[None, :])
        solved[int(f)] = (n, mean[:-1], mean[-1], axes, shrunk, (axes.T @ centred[:-1, -1])[:, None] * shrunk)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {f: np.zeros((2, len(steps))) for f in solved}
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, fold = np.stack(pdf["v"].to_numpy()), pdf["y"].to_numpy(), pdf["fold"].to_numpy()
            for f, (n, mean, level, axes, shrunk, slope) in solved.items():
                z = (x - mean) @ axes
                error = y[:, None] - level - z @ slope
                inside = fold != f
                leverage = 1 / n + (z[inside] ** 2) @ shrunk
                sums[f][0] += ((error[inside] / np.maximum(1 - leverage, 1e-12)) ** 2).sum(axis=0)
                sums[f][1] += (error[~inside] ** 2).sum(axis=0)
        yield pd.DataFrame([(f, float(a), *s) for f, m in sums.items() for a, s in zip(steps, m.T)], columns=["fold", "alpha", "loo", "out"])

    narrow = rows.select("fold", F.col(vec).cast("array<double>").alias("v"), F.col(target).cast("double").alias("y"))
    sums = narrow.mapInPandas(run, "fold int, alpha double, loo double, out double").groupBy("fold", "alpha").agg(F.sum("loo").alias("loo"), F.sum("out").alias("out")).collect()
    spread = lambda m: float(m[-1, -1] - m[0, -1] ** 2 / m[0, 0])
    r2 = lambda out, m: float(1 - out / spread(m)) if spread(m) > 0 else None
    out = []
    for f, own in sorted(per.items()):
        best = min((r for r in sums if r["fold"] == f), key=lambda r: (r["loo"], r["alpha"]))
        out.append((int(f), best["alpha"], float(best["loo"] / solved[f][0]), int(own[0, 0]), r2(best["out"], own), best["out"]))
    whole = (None, None, None, int(everything[0, 0]), r2(sum(r[5] for r in out), everything))
    return df.sparkSession.createDataFrame([*[r[:5] for r in out], whole], schema)


def platt_fit(df: DataFrame, scores: str, truth: str, steps: int = 25) -> dict:
    """Per-class sigmoids p = 1 / (1 + exp(-(a s + b))) on out-of-fold scores with smoothed targets.

    Newton steps for all classes at once: each step is one grouped aggregation that returns one
    row per class.
    """
    long = df.select(F.col(truth).alias("_t"), F.explode(scores).alias("_s")).select(
        F.col("_s.label").alias("cls"), F.col("_s.score").alias("s"), (F.col("_t") == F.col("_s.label")).cast("double").alias("hit"))
    long = materialise(long)
    counts = {r["cls"]: (r["pos"], r["n"] - r["pos"]) for r in long.groupBy("cls").agg(F.sum("hit").alias("pos"), F.count(F.lit(1)).alias("n")).collect()}
    par = {c: np.zeros(2) for c in counts}
    pick = lambda i: F.create_map(*[F.lit(x) for c in par for x in (c, float(par[c][i]))])[F.col("cls")]
    high = F.create_map(*[F.lit(x) for c, (p, _) in counts.items() for x in (c, (p + 1) / (p + 2))])[F.col("cls")]
    low = F.create_map(*[F.lit(x) for c, (_, q) in counts.items() for x in (c, 1 / (q + 2))])[F.col("cls")]
    target = F.when(F.col("hit") == 1, high).otherwise(low)
    for _ in range(steps):
        z = pick(0) * F.col("s") + pick(1)
        p = 1 / (1 + F.exp(-z))
        rows = long.select("cls", "s", (p - target).alias("g"), (p * (1 - p)).alias("h")).groupBy("cls").agg(
            F.sum(F.col("g") * F.col("s")).alias("g0"), F.sum("g").alias("g1"), F.sum(F.col("h") * F.col("s") * F.col("s")).alias("h00"),
            F.sum(F.col("h") * F.col("s")).alias("h01"), F.sum("h").alias("h11")).collect()
        move = 0.0
        for r in rows:
            hess = np.array([[r["h00"], r["h01"]], [r["h01"], r["h11"]]]) + 1e-9 * np.eye(2)
            step = np.linalg.solve(hess, np.array([r["g0"], r["g1"]]))
            step *= min(1.0, 10.0 / max(np.abs(step).max(), 1e-12))
            par[r["cls"]] -= step
            move = max(move, float(np.abs(step).max()))
        if move < 1e-6:
            break
    return {c: tuple(float(x) for x in v) for c, v in par.items()}


def platt_apply(df: DataFrame, scores: str, params: dict, alias: str = "platt") -> DataFrame:
    """Per-class sigmoids of the scores, normalised to sum to one."""
    a = F.create_map(*[F.lit(x) for c, (m, _) in params.items() for x in (c, m)])
    b = F.create_map(*[F.lit(x) for c, (_, k) in params.items() for x in (c, k)])
    raw = F.transform(scores, lambda s: F.struct(s["label"].alias("label"), (1 / (1 + F.exp(-(a[s["label"]] * s["score"] + b[s["label"]])))).alias("score")))
    total = F.aggregate(raw, F.lit(0.0), lambda acc, s: acc + s["score"])
    return df.withColumn("_raw", raw).withColumn(alias, F.transform("_raw", lambda s: F.struct(s["label"].alias("label"), (s["score"] / total).alias("score")))).drop("_raw")


def cluster_silhouette(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Silhouette of given labels of any type for squared Euclidean and cosine distance.

    The mean of either distance from a row to all rows of a class has a closed form in the class's sums, so
    ``ClusteringEvaluator`` gets the pairwise silhouette in one pass without pairs. Rows without label or vector are left out.
    """
    named = df.filter(F.col(label).isNotNull() & F.col(vec).isNotNull())
    named = StringIndexer(inputCol=label, outputCol="prediction", stringOrderType="alphabetAsc").fit(named).transform(named)
    x = named.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"), "prediction")
    rows = [(d, float(ClusteringEvaluator(distanceMeasure=d).evaluate(x))) for d in ("cosine", "squaredEuclidean")]
    return df.sparkSession.createDataFrame(rows, "distance string, silhouette double")


class Projection:
    """Two principal components; new vectors are placed on the same map."""

    def __init__(self, model, vec: str):
        self.model, self.vec = model, vec

    def place(self, df: DataFrame) -> DataFrame:
        """Add x and y (4 decimals); a vector that is not finite gets nulls."""
        finite = F.forall(self.vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        safe = F.when(finite, F.col(self.vec).cast("array<double>"))
        dims = self.model.pc.numRows
        filled = F.coalesce(safe, F.array_repeat(F.lit(0.0), dims))
        out = self.model.transform(df.withColumn("_ok", F.coalesce(finite, F.lit(False))).withColumn("_x", array_to_vector(filled)))
        xy = vector_to_array("_xy")
        at = lambda i: F.when(F.col("_ok"), F.bround(xy[i], 4))
        return out.withColumn("x", at(0)).withColumn("y", at(1)).drop("_x", "_xy", "_ok")


def project_2d(df: DataFrame, vec: str) -> Projection:
    """Fit the 2-D map on finite vectors. Principal components stand in for a neighbour-graph
    layout, which has no distributed form; distances on the map are linear ones."""
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    x = df.filter(finite).select(array_to_vector(F.col(vec).cast("array<double>")).alias("_x"))
    return Projection(PCA(k=2, inputCol="_x", outputCol="_xy").fit(x), vec)

"""Vectors, statistics with replicates and model fits: brute force and invariants."""

import os
from hashlib import md5

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyframe.operators import evaluate, models, sampling, stats, vectors
from tallyframe.streaming import logs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(3)
    m = r.normal(size=(300, 12))
    m[200:] = m[7]  # a third of all rows are copies of one vector
    label = r.integers(0, 4, 300)
    m[:, 0] += label * 2
    df = spark.createDataFrame([(int(i), [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(m, label))], "id long, v array<double>, label int")
    return m, label, df.repartition(6, "id")


def brute(m, k, metric):
    if metric == "cosine":
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        s = u @ u.T
    else:
        s = -np.linalg.norm(m[:, None] - m[None], axis=2)
    out = {}
    for i in range(len(m)):
        order = sorted((j for j in range(len(m)) if j != i), key=lambda j: (-round(float(s[i, j]), 10), j))
        out[i] = order[:k]
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("path", ["broadcast", "rounds"])
def test_topk_equals_brute_force(points, metric, path):
    m, _, df = points
    old = vectors.SIMILARITY_PLACES
    vectors.SIMILARITY_PLACES = 10  # the reference below rounds to 10 places as well
    try:
        kw = {} if path == "broadcast" else {"broadcast_bytes": 3000}
        got = vectors.cosine_topk(df, df, "id", "v", 5, metric, **kw).collect()
    finally:
        vectors.SIMILARITY_PLACES = old
    assert len(got) == 300 * 5
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["neighbour_id"])
    assert by == brute(m, 5, metric)


@pytest.mark.parametrize("kind", ["string", "date", "int", "decimal(12,0)"])
def test_ids_of_any_type(spark, points, kind):
    """Text, date, small and decimal ids find what numbers find; ties go by the ids' own order."""
    m, _, df = points
    cast = {"string": F.format_string("é%05d", "id"), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")), "int": F.col("id").cast("int"),
            "decimal(12,0)": F.col("id").cast("decimal(12,0)")}[kind]
    named = df.withColumn("name", cast)
    back = {r["name"]: r["id"] for r in named.select("id", "name").collect()}
    numbers = {(r["query_id"], r["rank"]): r["neighbour_id"] for r in vectors.cosine_topk(df, df, "id", "v", 3).collect()}
    got = vectors.cosine_topk(named, named.unionByName(named.limit(1).withColumn("name", F.lit(None).cast(kind))), "name", "v", 3)
    assert got.schema["query_id"].dataType.simpleString() == kind
    assert {(back[r["query_id"]], r["rank"]): back[r["neighbour_id"]] for r in got.collect()} == numbers
    imp = vectors.occlusion_importance(named, "name", "v", [1.0] * 4, 8, 0.5, 1)
    assert imp.count() == named.count() and imp.schema["name"].dataType.simpleString() == kind
    assert vectors.paired_cosine(named, named, "name", "v", 2).filter("what = 'worst'").count() == 2
    tied = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [1.0, 0.0])], "id string, v array<double>")
    assert rows(vectors.cosine_topk(tied, tied, "id", "v", 1).select("query_id", "neighbour_id")) == [("a", "b"), ("b", "a"), ("c", "a")]


def test_classes_of_text(spark):
    df = spark.createDataFrame([(n, [x, 1.0]) for n, x in (("a", 0.0), ("a", 0.2), ("b", 1.0), ("b", 1.2), ("c", 9.0), (None, 3.0))], "cls string, v array<double>")
    c = vectors.class_centroids(df, "cls", "v")
    assert [(r["cls"], r["nearest"]) for r in vectors.nearest_other_centroid(c, "cls").orderBy("cls").collect()] == [("a", "b"), ("b", "a"), ("c", "b")]
    assert models.cluster_silhouette(df, "v", "cls").count() == 2


def test_topk_small_corpus_zero_and_null_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "id long, v array<double>")
    assert rows(vectors.cosine_topk(df, df, "id", "v", 5).select("query_id", "neighbour_id")) == [(1, 4), (4, 1)]
    assert vectors.cosine_topk(df.limit(0), df, "id", "v", 5).count() == 0


def test_topk_of_copies_and_distant_vectors(spark, monkeypatch):
    """Equal vectors have distance zero and tie by id, wherever they lie; blocks of any size and precision agree with brute force."""
    rng = np.random.default_rng(5)
    base = np.repeat(rng.normal(size=(40, 6)), 5, axis=0)
    for shift, metric in ((0.0, "cosine"), (0.0, "euclidean"), (1e5, "euclidean"), (1e17, "euclidean")):
        m = base + shift if shift < 1e10 else base * shift
        near = vectors._Nearest(np.arange(200), m, 3, metric)
        monkeypatch.setattr(vectors, "SCORE_CELLS", 2_000)
        for a in range(0, 200, 37):
            near.add(np.arange(a, min(a + 37, 200)), m[a:a + 37])
        assert [near.found[i].tolist() for i in range(200)] == [[j for j in range(i // 5 * 5, i // 5 * 5 + 5) if j != i][:3] for i in range(200)]
        if metric == "euclidean":
            assert (near.sims == 0).all()
    table = near.table()
    assert table.num_rows == 600


def test_topk_compares_few_pairs_exactly(monkeypatch):
    """What is computed pair by pair and put in order does not grow with queries times corpus."""
    rng, seen = np.random.default_rng(6), []
    m = rng.normal(size=(6_000, 16))
    near, exact = vectors._Nearest(np.arange(6_000), m, 5, "cosine"), vectors._Nearest._exact
    monkeypatch.setattr(vectors._Nearest, "_exact", lambda self, r, col, c: seen.append(len(r)) or exact(self, r, col, c))
    for a in range(0, 6_000, 500):
        near.add(np.arange(a, a + 500), m[a:a + 500])
    assert sum(seen) < 6_000 * 50
    assert len(seen) <= 12 * 2


def test_vote_prefers_the_nearest_on_a_tie(spark):
    top = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.7, 3), (2, 11, 0.9, 1), (2, 12, 0.8, 2), (2, 13, 0.7, 3)], "query_id long, neighbour_id long, similarity double, rank int")
    labels = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c"), (13, "c")], "id long, label string")
    assert rows(vectors.knn_vote(top, labels, "id", "label")) == [(1, "a", "a"), (2, "b", "c")]


def test_unit_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0])], "id int, v array<double>")
    assert rows(vectors.l2_normalise(df, "v")) == [(1, [0.6, 0.8])]
    c = vectors.norm_check(df, "v").collect()[0]
    assert (c["n_rows"], c["n_off"]) == (4, 4)


def test_fingerprint_match_equals_brute_force(spark):
    r = np.random.default_rng(5)
    base = [int(x) for x in r.integers(-(2**63), 2**63 - 1, 120)]
    right = base + [base[0]] * 60  # copies
    left = []
    for i, b in enumerate(base):
        x = b & (2**64 - 1)
        for bit in r.choice(64, i % 10, replace=False):
            x ^= 1 << int(bit)
        left.append(x - 2**64 if x >= 2**63 else x)
    L = spark.createDataFrame(list(enumerate(left)), "id long, fp long")
    R = spark.createDataFrame(list(enumerate(right)), "id long, fp long")
    want = []
    for i, a in enumerate(left):
        d, j = min((bin((a ^ b) & (2**64 - 1)).count("1"), j) for j, b in enumerate(right))
        if d <= 6:
            want.append((i, j, d))
    for blocks in (7, 8, 9, None):
        assert rows(vectors.fingerprint_match(L, R, "id", "fp", blocks=blocks)) == sorted(want, key=repr)


def test_shared_bits_do_not_fill_blocks(spark):
    """Fingerprints that share half of their bits: all matches, and few meetings by chance."""
    r = np.random.default_rng(6)
    base = (np.uint64(0xABCD1234 << 32) | r.integers(0, 2**32, 3000, dtype=np.uint64)).view(np.int64).tolist()
    flips = [b ^ sum(1 << int(x) for x in r.choice(32, i % 8, replace=False)) for i, b in enumerate(base)]
    right, left = (spark.createDataFrame(list(enumerate(x)), "id long, fp long") for x in (base, flips))
    a, b = np.array(flips), np.array(base)
    apart = np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64))
    want = [(i, int(apart[i].argmin()), int(apart[i].min())) for i in range(3000) if apart[i].min() <= 6]
    assert rows(vectors.fingerprint_match(left, right, "id", "fp")) == sorted(want, key=repr)
    met = vectors._meetings(left.selectExpr("fp as _f").distinct(), right.selectExpr("fp as _g", "id as _m"), 6).count()
    assert met < 3000 * 3000  # blocks of shared bits would let all pairs meet, and under several keys


def test_candidates_of_a_million_fingerprints(spark):
    """The number of blocks grows with the fingerprints, so random ones hardly meet by chance."""
    n = 1_000_000
    assert vectors.block_count(100, 6) < vectors.block_count(10**5, 6) < vectors.block_count(10**9, 6)
    df = lambda name, seed: spark.range(20_000).select(F.xxhash64("id", F.lit(seed)).alias(name))
    met = vectors._meetings(df("_f", 1), df("_g", 2), 6, vectors.block_count(n, 6)).count()
    assert met * (n / 20_000) ** 2 < 200 * n  # meetings grow with the square, keys with n


def test_separation_thresholds(spark):
    c = spark.createDataFrame([(0, [0.0, 0.0], 1.0), (1, [0.5, 0.0], 0.2), (2, [1.5, 0.0], 1.0), (3, [9.0, 0.0], 1.0)], "label int, centroid array<double>, spread double")
    p = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 8)], "a int, b int")
    assert {(r["b"], r["verdict"]) for r in vectors.pair_separation(c, p, "label").collect()} == {(1, "overlapping"), (2, "adjacent"), (3, "separated")}


# ---------------------------------------------------------------- statistics
def test_f_tail_against_integration():
    def tail(f, d1, d2):
        # mass of the beta law beyond x = d1 f / (d1 f + d2), by the midpoint rule
        x = d1 * f / (d1 * f + d2)
        t = (np.arange(400_000) + 0.5) / 400_000
        w = t ** (d1 / 2 - 1) * (1 - t) ** (d2 / 2 - 1)
        return w[t > x].sum() / w.sum()

    for f, d1, d2 in [(1.0, 4, 20), (3.2, 3, 50), (0.2, 6, 12), (12.0, 2, 8)]:
        assert stats._beta_tail(f, d1, d2) == pytest.approx(tail(f, d1, d2), abs=2e-4)
    assert stats._beta_tail(0.0, 3, 9) == 1.0


def test_eta_and_cramers_against_numpy(spark):
    r = np.random.default_rng(0)
    g = r.integers(0, 3, 400)
    v = r.normal(size=400) + g
    x = np.where(r.random(400) < 0.6, g, r.integers(0, 3, 400))
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(g, v, x)], "g int, v double, x int")
    ssb = sum((g == k).sum() * (v[g == k].mean() - v.mean()) ** 2 for k in range(3))
    e = stats.eta_table(df, ["v"], "g").collect()[0]
    assert e["value"] == pytest.approx(ssb / ((v - v.mean()) ** 2).sum())
    t = np.array([[((g == a) & (x == b)).sum() for b in range(3)] for a in range(3)], float)
    ex = t.sum(1, keepdims=True) * t.sum(0) / 400
    c = stats.cramers_table(df, ["x"], "g").collect()[0]
    assert c["raw_value"] == pytest.approx(np.sqrt(((t - ex) ** 2 / ex).sum() / 400 / 2))


def test_nulls_are_near_chance_and_reproducible(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, "abc"[i % 3], float(x), "uvw"[int(y)]) for i, (x, y) in enumerate(zip(r.normal(size=300), r.integers(0, 3, 300)))], "id int, c string, v double, w string")
    a = rows(stats.permuted_eta(df, "v", "c", "id", 30, 7))
    again = dict(rows(stats.permuted_eta(df.repartition(5), "v", "c", "id", 30, 7)))
    assert again == pytest.approx(dict(a))
    assert np.mean([x[1] for x in a]) == pytest.approx(2 / 299, abs=0.006)  # (groups - 1) / (n - 1)
    s = stats.permutation_summary(stats.permuted_eta(df, "v", "c", "id", 30, 7), stats.eta_table(df, ["v"], "c")).collect()[0]
    assert s["perm_p"] == pytest.approx((1 + sum(x[1] >= s["value"] for x in a)) / 31)
    n = stats.permuted_cramers(df, "w", "c", 50, 7).toPandas()["statistic"]
    assert len(n) == 50 and n.mean() < 0.12


def test_fingerprint_reads_every_element(spark):
    r = np.random.default_rng(11)
    long = r.normal(size=768)
    other = long.copy()
    other[64:] = r.normal(size=704)
    short = r.normal(size=64)
    vecs = [long, other, short]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(3, None)], "id int, v array<double>")
    got = {x["id"]: x["f"] for x in df.select("id", vectors.fingerprint("v").alias("f")).collect()}
    for i, v in enumerate(vecs):
        m = v.reshape(64, -1).mean(axis=1)
        assert got[i] & (1 << 64) - 1 == sum(1 << j for j in range(64) if m[j] > np.sort(m[1:])[31])
    assert got[3] is None and got[0] != got[1]
    with pytest.raises(Exception, match="64 elements"):
        spark.createDataFrame([([1.0] * 63,)], "v array<double>").select(vectors.fingerprint("v").alias("f")).collect()


def test_scores_against_many_classes_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(12)
    m, p = r.normal(size=(70, 6)), r.normal(size=(23, 6))
    df = spark.createDataFrame([(i % 50, [float(x) for x in v]) for i, v in enumerate(m)], "id int, v array<double>")
    protos = spark.createDataFrame([(f"c{i}", [float(x) for x in v]) for i, v in enumerate(p)], "label string, v array<double>")
    whole = vectors.score_against(df, "v", protos, "label").collect()
    monkeypatch.setattr(vectors, "SCORE_BLOCK", 16)
    cut = vectors.score_against(df, "v", protos, "label", broadcast_bytes=6 * 8 * 5)
    assert cut.columns == ["id", "v", "scores"]
    flat = lambda rows_: sorted((x["id"], tuple(x["v"]), tuple((s["label"], round(s["score"], 9)) for s in x["scores"])) for x in rows_)
    assert flat(cut.collect()) == flat(whole) and len(whole[0]["scores"]) == 23


def test_bootstrap_covers_the_point(spark):
    r = np.random.default_rng(2)
    y = r.integers(0, 4, 500)
    p = np.where(r.random(500) < 0.8, y, r.integers(0, 4, 500))
    df = spark.createDataFrame([(int(a), int(b), "x") for a, b in zip(y, p)], "t int, p int, g string")
    b = stats.bootstrap_ci(df, "t", "p", 400, 1, by=["g"]).collect()[0]
    acc = (y == p).mean()
    assert b["accuracy_lo"] < acc < b["accuracy_hi"]
    assert b["accuracy_hi"] - b["accuracy_lo"] == pytest.approx(2 * 1.96 * np.sqrt(acc * (1 - acc) / 500), rel=0.2)
    m = evaluate.accuracy_macro_f1(df, "t", "p").collect()[0]
    assert b["macro_f1_lo"] < m["macro_f1"] < b["macro_f1_hi"]


# ---------------------------------------------------------------- evaluation and fits
def test_macro_f1_with_and_without_absent_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, p string")
    labels = spark.createDataFrame([("a",), ("b",), ("z",)], "label string")
    assert evaluate.accuracy_macro_f1(df, "t", "p").collect()[0]["macro_f1"] == pytest.approx(2 / 3)
    assert evaluate.accuracy_macro_f1(df, "t", "p", labels=labels).collect()[0]["macro_f1"] == pytest.approx(4 / 9)


def test_ece_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0, 1), (0.1, 1), (0.2, 2), (0.25, 3), (1.0, 10)], "c double, b int")
    assert all(r[0] == r[1] for r in df.select(evaluate.calibration_bins(F.col("c")), "b").collect())


def test_temperature_keeps_the_ranking(points):
    _, _, df = points
    s = df.select("id", F.transform("v", lambda x, i: F.struct(i.alias("label"), x.alias("score"))).alias("s"))
    p = s.withColumn("p", evaluate.temperature_softmax("s", 0.3))
    assert p.filter(evaluate.topk_labels("s", 3)[0]["label"] != evaluate.topk_labels("p", 3)[0]["label"]).count() == 0
    assert p.filter(F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x["score"]) - 1) > 1e-9).count() == 0


def test_temperature_recovers_a_known_scale(spark):
    r = np.random.default_rng(4)
    z = r.normal(size=(4000, 3))
    y = [int(r.choice(3, p=np.exp(v) / np.exp(v).sum())) for v in z]
    df = spark.createDataFrame([([(i, float(5 * x)) for i, x in enumerate(v)], t) for v, t in zip(z, y)], "s array<struct<label:int,score:double>>, t int")
    assert evaluate.temperature_fit(df, "s", "t").collect()[0]["temperature"] == pytest.approx(5, rel=0.12)


def test_probe_folds_and_platt(points):
    _, label, df = points
    probe = models.linear_probe_fit(df, "v", "label", max_iter=60)
    s = probe.score(df).select("label", evaluate.topk_labels("probs", 1)[0]["label"].alias("pred"))
    # 100 copies of one vector carry random labels; the other 200 rows can be told apart by one dimension
    assert evaluate.accuracy_macro_f1(s, "label", "pred").collect()[0]["accuracy"] > 0.4
    oof = models.cv_out_of_fold(df, "id", "v", "label", folds=3, max_iter=20)
    assert oof.count() == 300 and oof.select("id").distinct().count() == 300
    params = models.platt_fit(oof, "logits", "label")
    assert set(params) == set(label.tolist())
    total = models.platt_apply(oof, "logits", params).select(F.aggregate("platt", F.lit(0.0), lambda a, x: a + x["score"]).alias("t"))
    assert total.filter(F.abs(F.col("t") - 1) > 1e-9).count() == 0


def test_ridge_equals_refits(spark):
    """Nested choice of alpha: leave one row out of each training set by refitting, then predict the fold."""
    r = np.random.default_rng(8)
    n, d, alphas = 60, 5, [0.01, 1.0, 10.0, 1000.0]
    x = r.normal(size=(n, d)) * [1, 2, 1, 1, 3]
    y = x @ [1.0, 0.5, 0, 0, 0] + r.normal(size=n) * 2 + 5
    df = spark.createDataFrame([(i, [float(v) for v in row], float(t)) for i, (row, t) in enumerate(zip(x, y))] + [(99, None, 1.0), (98, [1.0] * d, None)], "id long, v array<double>, y double")
    folds = {q["id"]: q["fold"] for q in sampling.stratified_folds(df.limit(n).withColumn("c", F.lit("a")), "c", "id", 3, 42).collect()}
    fold = np.array([folds[i] for i in range(n)])

    def ridge(x, y, a, at):
        m, t = x.mean(axis=0), y.mean()
        w = np.linalg.solve((x - m).T @ (x - m) + a * np.eye(d), (x - m).T @ (y - t))
        return (at - m) @ w + t

    got = {q["fold"]: q for q in models.ridge_cv_r2(df, "id", "v", "y", alphas, folds=3).collect()}
    lost = 0.0
    for f in range(3):
        tx, ty = x[fold != f], y[fold != f]
        loo = [np.mean([(ty[i] - ridge(np.delete(tx, i, 0), np.delete(ty, i), a, tx[i])) ** 2 for i in range(len(ty))]) for a in alphas]
        assert (got[f]["alpha"], got[f]["loo_mse"], got[f]["n"]) == (alphas[int(np.argmin(loo))], pytest.approx(min(loo)), int((fold == f).sum()))
        lost += ((y[fold == f] - ridge(tx, ty, got[f]["alpha"], x[fold == f])) ** 2).sum()
    assert got[None]["r2"] == pytest.approx(1 - lost / ((y - y.mean()) ** 2).sum()) and got[None]["n"] == n


def test_folds_fitted_side_by_side_are_those_of_single_fits(points):
    _, _, df = points
    oof = models.cv_out_of_fold(df, "id", "v", "label", folds=3, max_iter=30)
    folds = sampling.stratified_folds(df, "label", "id", 3, 42)
    one = models.linear_probe_fit(folds.filter("fold <> 1"), "v", "label", max_iter=30).score(folds.filter("fold = 1"))
    want = {r["id"]: [x["score"] for x in r["probs"]] for r in one.collect()}
    for r in oof.filter("fold = 1").collect():
        assert [x["score"] for x in r["probs"]] == pytest.approx(want[r["id"]], abs=1e-6)


@pytest.mark.parametrize("sigmas", [5.0, 0.0])
def test_shuffles_rank_a_root_of_the_rows(spark, monkeypatch, sigmas):
    """The shuffles are those of the md5 order; with even hashes few rows are ranked, and repeated ids or missed ends change no result."""
    rng = np.random.default_rng(9)
    n, cls, v = 4_000, rng.integers(0, 3, 4_000), rng.normal(size=4_000)
    ids = [i if i >= 600 else i % 2 for i in range(n)] if sigmas == 0 else list(range(n))
    df = spark.createDataFrame([(ids[i], f"c{cls[i]}", float(v[i])) for i in range(n)], "id long, c string, v double")
    want, ends = {}, np.cumsum(np.bincount(cls))[:-1]
    for rep in range(1, 4):
        order = sorted(range(n), key=lambda i: (md5(f"7|{rep}|{ids[i]}".encode()).hexdigest(), v[i] - v.mean()))
        parts = np.split(v[order], ends)
        want[rep] = sum(len(p) * (p.mean() - v.mean()) ** 2 for p in parts) / (n * v.var())
    kept, segments = [], stats._shuffled_segments
    monkeypatch.setattr(stats, "_shuffled_segments", lambda *a: kept.append(segments(*a)) or kept[-1])
    got = dict(rows(stats.permuted_eta(df, "v", "c", "id", 3, 7, sigmas=sigmas)))
    assert got == pytest.approx(want)
    if sigmas:
        assert kept[0].filter("h is not null").count() < 3 * n / 3


def test_permutation_test_of_the_probe_sees_a_dependence_and_none(spark):
    rng = np.random.default_rng(5)
    rows_ = [(i, "abc"[i % 3], f"s{i % 3 if rng.random() < 0.6 else rng.integers(3)}", float(rng.normal())) for i in range(240)]
    df = spark.createDataFrame(rows_, "id long, label string, s string, x double")
    got = {r["feature_set"]: r for r in models.permuted_probe(df, "id", "label", {"tied": (["s"], ["x"]), "free": ([], ["x"])}, permutations=40).collect()}
    assert got["tied"]["permutations"] == got["free"]["permutations"] == 40
    assert got["tied"]["perm_p"] == 1 / 41 and got["free"]["perm_p"] > 1 / 41
    assert 0.2 < got["tied"]["perm_macro_f1_mean"] < 0.45


def test_registered_counts_are_those_of_the_reference(spark, monkeypatch):
    from tallyframe.operators import stats as st
    from tallyframe.operators import vectors as ve
    from tallyframe.plans import load_all
    from tallyframe.plans.registry import QUERIES

    class Seen(Exception):
        pass

    load_all()

    def count_of(module, name, at, q):
        def stop(*a, **k):
            raise Seen(k[at] if isinstance(at, str) else a[at])

        monkeypatch.setattr(module, name, stop)
        with pytest.raises(Seen) as e:
            QUERIES[q](spark, SF)
        monkeypatch.undo()
        return e.value.args[0]

    assert count_of(st, "permuted_eta", 4, "permutation_null_full") == 1000
    assert count_of(st, "permuted_cramers", 3, "permutation_null_categorical") == 1000
    assert count_of(st, "bootstrap_ci", 3, "bootstrap_ci") == count_of(st, "bootstrap_ci", 3, "variant_scores") == 1000
    assert count_of(ve, "occlusion_importance", 4, "occlusion_importance_full") == 400
    assert len(count_of(models, "ridge_cv_r2", 4, "ridge_cv_r2")) == 13
    assert count_of(models, "mixed_feature_probe", "trees", "mixed_feature_probe") == 200
    assert count_of(models, "cv_out_of_fold", "folds", "variant_scores_retrained") == 5
    assert count_of(models, "cv_out_of_fold", "max_iter", "cv_out_of_fold") == 5000


def test_projection_skips_vectors_that_are_not_finite(spark, points):
    _, _, df = points
    fit = models.project_2d(df, "v")
    bad = spark.createDataFrame([(1, [float("nan")] * 12), (2, [1.0] * 12)], "id long, v array<double>")
    got = {r["id"]: (r["x"], r["y"]) for r in fit.place(bad).collect()}
    assert got[1] == (None, None) and None not in got[2]


# ---------------------------------------------------------------- streams over several batches
def test_latest_state_over_several_batches(spark, tmp_path):
    src = tmp_path / "log"
    for i in range(3):
        spark.createDataFrame([("a", i, i, f"s{i}"), (f"k{i}", 9 - i, i, "x")], "path string, ts int, id int, source string").coalesce(1).write.mode("append").parquet(str(src))
    stream = logs.read_log(spark, str(src), "*.parquet", "path string, ts int, id int, source string", files_per_trigger=1)
    logs.latest_state_stream(stream, ["path"], ["ts", "id"], ["source"], str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows(logs.read_latest(spark, str(tmp_path / "out")).select("path", "source")) == [("a", "s2"), ("k0", "x"), ("k1", "x"), ("k2", "x")]


def test_state_table_of_a_growing_history_keeps_two_versions(spark, tmp_path):
    src, want = tmp_path / "log", {}
    for i in range(7):
        batch = [(f"k{k}", i if (k + i) % 3 else -i, 10 * i + k, f"s{i}") for k in range(0, 40, 1 + i % 3)]
        spark.createDataFrame(batch, "path string, ts int, id int, source string").coalesce(1).write.mode("append").parquet(str(src))
        for k, ts, id_, source in batch:
            want[k] = max(want.get(k, (-99, 0, "")), (ts, id_, source))
    stream = logs.read_log(spark, str(src), "*.parquet", "path string, ts int, id int, source string", files_per_trigger=1)
    out = str(tmp_path / "out")
    logs.latest_state_stream(stream, ["path"], ["ts", "id"], ["source"], out, str(tmp_path / "state"), buckets=4)
    assert {r["path"]: r["source"] for r in logs.read_latest(spark, out).collect()} == {k: v[2] for k, v in want.items()}
    assert len(list((tmp_path / "out").rglob("*.parquet"))) <= 2 * 4


def test_open_windows_and_sessions_are_emitted_at_the_end(spark, tmp_path):
    src = tmp_path / "log"
    times = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 09:00:00", "b"), ("2024-01-02 00:30:00", "a"), ("2024-01-02 00:31:00", "b")]
    for at in range(0, 5, 2):
        rows_ = spark.createDataFrame(times[at:at + 2], "at string, key string").select(F.col("at").cast("timestamp").alias("at"), "key")
        rows_.coalesce(1).write.mode("append").parquet(str(src))
    log = logs.read_log(spark, str(src), "*.parquet", "at timestamp, key string", files_per_trigger=1)
    counts = logs.drain_to_end(log, "at", lambda s: logs.windowed_counts(s, "at", "1 day", "1 day", "key"))
    assert rows(counts.select(F.date_format("start", "dd").alias("d"), "key", "n")) == [("01", "a", 2), ("01", "b", 1), ("02", "a", 1), ("02", "b", 1)]
    spans = logs.drain_to_end(log, "at", lambda s: logs.sessions(s, "at", "1 hour", "1 day", "key"))
    assert rows(spans.select(F.date_format("start", "dd HH:mm").alias("d"), "key", "n")) == [
        ("01 00:10", "a", 2), ("01 09:00", "b", 1), ("02 00:30", "a", 1), ("02 00:31", "b", 1)]


def mixed_rows(n):
    rng = np.random.default_rng(11)
    out = []
    for i in range(n):
        x, s = float(rng.normal(50, 9)), ["p", "q", "r", None][rng.integers(4)]
        y = "abc"[(x > 50) + (s == "q" and x > 45)] if rng.random() < 0.9 else "abc"[rng.integers(3)]
        out.append((i, y if i != 7 else None, "rare" if i == 3 else s, x if i != 5 else None, float(rng.integers(3))))
    return out


def test_probe_of_mixed_features_is_that_of_fits_one_by_one(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from tallyframe.operators.sampling import stratified_folds

    sets = {"both": (["s"], ["x", "z"]), "number": ([], ["x"]), "level": (["s"], [])}
    df = spark.createDataFrame(mixed_rows(900), "id long, y string, s string, x double, z double")
    spark.sparkContext.setJobGroup("probe", "probe")
    got = {(r["feature_set"], r["model"], r["id"]): r["pred"] for r in models.mixed_feature_probe(df, "id", "y", sets, ["logistic", "forest"], trees=40).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("probe"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs < 150  # passes are shared: not some for each of the 30 fits
    assert len(got) == 899 * 6

    folds = {r["id"]: r["fold"] for r in stratified_folds(df.filter("y is not null"), "y", "id", 5, 42).collect()}
    rows_ = [r for r in mixed_rows(900) if r[1] is not None]
    y, fold = np.array(["abc".index(r[1]) for r in rows_]), np.array([folds[r[0]] for r in rows_])
    weights = len(y) / 3 / np.bincount(y)
    for name, (cats, nums) in sets.items():
        hits, forest = 0, 0
        for f in range(5):
            train = fold != f
            v = np.array([[r[{"x": 3, "z": 4}[c]] or 0.0 for c in nums] for r in rows_]).reshape(len(y), len(nums))
            x = (v - v[train].mean(axis=0)) / v[train].std(axis=0, ddof=1) if nums else v
            if cats:
                seen = {r[2] for r, t in zip(rows_, train) if t} - {None}
                x = np.hstack([x, np.array([[float(r[2] == s) for s in sorted(seen)] + [float(r[2] not in seen)] for r in rows_])])
            m = models._softmax_fit(x[train], y[train], weights[y[train]] * train.sum() / weights[y[train]].sum(), 3, 1 / train.sum(), 5000, 1e-8)
            want = (x @ m[:-1] + m[-1]).argmax(axis=1)
            hits += sum(got[name, "logistic", r[0]] == "abc"[w] for r, w, t in zip(rows_, want, train) if not t)
            if name == "both":
                t = spark.createDataFrame([(float(a), float(weights[a]), int(i), bool(b), *map(float, c)) for a, i, b, c in zip(y, range(len(y)), train, x)], ["_y", "_w", "i", "train", *[f"f{k}" for k in range(x.shape[1])]])
                t = VectorAssembler(inputCols=t.columns[4:], outputCol="_x").transform(t)
                fit = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=40, minInstancesPerNode=2, seed=1).fit(t.filter("train"))
                forest += fit.transform(t.filter("not train")).filter("prediction = _y").count()
        assert hits >= len(y) - 2, name
        if name == "both":
            own = sum(got[name, "forest", r[0]] == r[1] for r in rows_)
            assert abs(own - forest) < 0.03 * len(y) and own > 0.8 * len(y)


def test_probe_of_mixed_features_on_few_rows(spark):
    sets = {"n": ([], ["x"]), "c": (["s"], ["x"])}
    for given, want in (([], 0), ([(1, "a", "p", 1.0)], 1), ([(1, "a", None, None), (2, "b", "q", float("nan")), (3, None, "q", 1.0)], 2)):
        df = spark.createDataFrame(given, "id long, y string, s string, x double")
        assert models.mixed_feature_probe(df, "id", "y", sets, ["logistic", "forest"], trees=3).count() == 4 * want

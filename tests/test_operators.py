"""Hand-made edge frames: empty input, nulls, ties, singletons, duplicates."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyframe import fixed
from tallyframe.functions import text, urls, values
from tallyframe.operators import aggregates, checks, evaluate, joins, rules, sampling, stats, windows
from tallyframe.sources import readers, sinks


def col(spark, data, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("c")).alias("o")).collect()]


def test_codes_and_tokens(spark):
    assert col(spark, [" casent01-D01 ", "blf-h2-x", "a-p1-d2", None], text.strip_suffix_code) == ["casent01", "blf-h2-x", "a-p1", None]
    assert col(spark, ["blf2102(14)-8", "a b__c", "é"], text.safe_file_token) == ["blf2102_14_-8", "a_b_c", "_"]
    assert col(spark, ["x_p_1_high.jpg", "x_q_1_", None], urls.url_token_extract) == ["p", None, None]
    assert col(spark, ["x_p_10_high.jpg", "x", "x_d_2_"], urls.url_int_token) == [10, 9999, 2]
    assert col(spark, ["http://A.Example.com:80/x", "https://u@example.com/", "https://badexample.com", "example.com", "//example.com?q"],
               lambda c: urls.host_matches(c, "example.com")) == [False, False, False, False, True]
    assert col(spark, ["https://www.Example.com/a b"], lambda c: urls.host_matches(c, "example.com")) == [True]
    assert col(spark, ["u_high.jpg", "u_big.jpg"], urls.variant_urls) == [["u_med.jpg", "u_high.jpg", "u_low.jpg"], ["u_big.jpg"]]


def test_titles(spark):
    got = col(spark, ["File:Genus x CASENT0451572 profile 2.JPG", "casent01 head.jpeg", "no code", "file:antweb12 dorsal  10"], text.title_parse)
    assert [tuple(g) if g else g for g in got] == [("casent0451572", "p", 2), ("casent01", "h", 1), None, ("antweb12", "d", 10)]


def test_years_labels_lists(spark):
    assert [tuple(r) for r in col(spark, ["(c) 2001 - 2008", "1999", "none", None], text.year_range_parse)] == [(2001, 2008), (1999, 1999), (None, None), (None, None)]
    assert col(spark, ["1998-05/1999", "", "abcd", None], text.year_prefix) == [1998, None, None, None]
    assert col(spark, ["\t Worker ", None], text.normalise_label) == ["worker", ""]
    assert col(spark, ["a;b;c", "c;b", "x"], lambda c: text.list_successor(c, "b")) == ["c", "", ""]
    assert col(spark, ["Camponotus imitator", "Camponotusx", None], lambda c: text.strip_leading_term(c, F.lit("Camponotus"))) == ["imitator", "Camponotusx", None]


def test_marker_counts_bytes(spark):
    far = "é" * 4090 + "cf-chl"  # 8,180 bytes before the marker
    later = "é" * 4096 + "cf-chl"
    assert col(spark, [far, later, "x", None], text.marker_screen) == [True, True, False, None]
    assert col(spark, [far, later, "x"], lambda c: text.marker_screen(c, head=8192)) == [True, False, False]


def test_gate_and_outcomes(spark):
    df = spark.createDataFrame([("image/png", 0), ("IMAGE/x", 11), (None, 5), ("image/x", 10)], "k string, n int")
    assert [r[0] for r in df.select(values.input_gate("k", "n", 10)).collect()] == [422, 413, 400, 200]
    df = spark.createDataFrame([(200, "image/x", True), (200, "text", False), (200, "image/x", False), (404, "", False), (503, "", False), (418, "", False)], "c int, t string, h boolean")
    assert [r[0] for r in df.select(values.attempt_outcome("c", "t", F.col("h"))).collect()] == ["retry", "fail", "ok", "next", "retry", "fail"]


def test_hue_of_primary_colours(spark):
    df = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9), (255, 0, 1)], "r int, g int, b int")
    assert [round(x[0], 2) for x in df.select(values.hue_degrees("r", "g", "b")).collect()] == [0, 120, 240, 0, 359.76]


def test_rule_check_distances(spark):
    df = spark.createDataFrame([(1, 9.5, 0.0), (2, 10.0, 0.0), (3, 12.0, 1.0)], "id int, a double, b double")
    out = rules.rule_check(df, [("only", F.lit(True), [("a", "a", 10.0, ">="), ("b", "b", 0.0, "<=")])])
    got = {r["id"]: (r["accepted"], r["failed"], [c["rel_distance"] for c in r["checks"]]) for r in out.collect()}
    assert got == {1: (False, "a", [0.05, 0.0]), 2: (True, "", [0.0, 0.0]), 3: (False, "b", [0.2, float("inf")])}
    m = {(r["id"], r["test"]): r["decisive"] for r in rules.rule_margins(out, ["id"]).collect()}
    assert m == {(1, "a"): True, (1, "b"): False, (2, "a"): True, (2, "b"): True}


def test_one_to_one(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string")
    assert [(r["k"], r["problem"]) for r in joins.one_to_one_violations(a, b, "k").orderBy("k").collect()] == [(2, "duplicate left"), (3, "missing left")]
    with pytest.raises(ValueError):
        joins.join_one_to_one(a, b, "k")


def test_best_candidate_and_cascade(spark):
    items = spark.createDataFrame([("C1", "p"), ("C2", "p"), ("C3", "d")], "code string, view string")
    titles = spark.createDataFrame([("c1", "p", 2, "a"), ("c1", "p", 1, "z"), ("c1", "p", 1, "b"), ("c2", "d", 1, "q")], "code string, view string, shot int, title string")
    assert rows(joins.best_candidate(items, titles, "code", "view").select("code", "title", "n_candidates")) == [("C1", "b", 3)]
    assert [(r["title"], r["rank"]) for r in joins.candidates(items, titles, "code", "view").orderBy("rank").collect()] == [("b", 1), ("z", 2), ("a", 3)]
    ev = spark.createDataFrame([("a", 1, "unconfirmed", 10), ("a", 2, "exact", 20), ("b", 1, "unconfirmed", 30), ("b", 2, "unconfirmed", 40)], "k string, rank int, conf string, x int")
    assert rows(joins.first_confirmed_candidate(ev, ["k"], "rank", "conf", ["x"])) == [("a", 2, "exact", 20, 2), ("b", 1, "unconfirmed", 30, 2)]


def test_latest_streak_and_attempts(spark):
    log = spark.createDataFrame([("p", 1, 1, "a"), ("p", 2, 1, "b"), ("p", 2, 0, "c")], "path string, ts int, id int, source string")
    assert rows(windows.latest_per_key(log, ["path"], ["ts", "id"], ["source"])) == [("p", 2, 1, "b")]
    a = spark.createDataFrame([("i", 1, "HTTP 404"), ("i", 2, "HTTP 403"), ("i", 3, "HTTP 200"), ("j", 1, "HTTP 404"), ("j", 2, "HTTP 404")], "k string, n int, status string")
    ok = F.col("status") == "HTTP 200"
    out = windows.attempt_sequence(a, ["k"], ["n"], ok, ok | ~F.col("status").contains("404"), "status")
    assert rows(out) == [("i", 2, "HTTP 403", False), ("j", 2, "HTTP 404", False)]


def test_history_rejects_and_trims(spark):
    h = spark.createDataFrame([(1, i, r) for i, r in enumerate(["assistant", "user", "assistant", "user"])] + [(2, 0, "user"), (2, 1, "assistant")], "c int, turn int, role string")
    assert rows(windows.history_tail(h, "c", "turn", "role")) == [(1, 1, "user"), (1, 2, "assistant"), (1, 3, "user")]
    assert rows(windows.history_tail(h, "c", "turn", "role", limit=2)) == [(1, 3, "user")]


def test_profiles_of_sparse_groups(spark):
    df = spark.createDataFrame([("a", None, None, None, None, None), (None, "n", "p", 1.0, 2.0, 3), ("b", "n", "p", 1.0, 2.5, 1999), ("b", "m", "q", None, 3.5, None)],
                               "g string, name string, place string, coord double, m double, year int")
    out = {r["g"]: r.asDict() for r in aggregates.group_profile(df, "g", "name", F.lit(True), "place", "coord", "m", "year").collect()}
    assert set(out) == {"a", "b"}
    assert out["a"]["measure_median"] is None and out["a"]["places"] == "" and out["a"]["n_unnamed"] == 1
    assert (out["b"]["measure_min"], out["b"]["measure_median"], out["b"]["measure_max"], out["b"]["places"]) == (2, 3, 4, "p;q")


def test_flags_and_coverage(spark):
    df = spark.createDataFrame([("empty;large",), ("",), ("large",)], "flags string")
    assert rows(aggregates.flag_counts(df, "flags", ["empty", "large", "none"])) == [("empty", 1), ("large", 2), ("none", 0)]
    assert aggregates.flag_counts(df.limit(0), "flags", ["empty"]).collect()[0]["n"] == 0


def test_table_diff_nulls_and_missing_rows(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "x"), (3, 3.0, "y")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0, None), (2, 2.5, None), (4, 0.0, "z")], "k int, v double, s string")
    assert rows(sampling.table_diff(a, b, ["k"], ["v", "s"], 0.1).select("k", "column", "delta")) == sorted(
        [(2, "v", 0.5), (2, "s", None), (3, "(row)", None), (4, "(row)", None)], key=repr)


def test_upsert_keeps_null_updates(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert rows(joins.upsert(old, new, ["k"])) == [(1, "a", "kept"), (2, None, "replaced"), (3, "c", "added")]


def test_set_overlap_empty_sets(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", None)], "k string, c int")
    b = spark.createDataFrame([("x", 2), ("y", None)], "k string, c int")
    assert rows(stats.set_overlap(a, b, "k", "c").select("k", "iou", "identical")) == [("x", 0.5, False), ("y", 1.0, True)]


def test_bands(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4)], "v double")
    assert [r["band"] for r in stats.quantile_bands(df, "v").orderBy("v").collect()] == ["B1 0-1", "B1 0-1", "B2 1-2", "B3 2-3", "B4 3-4"]
    assert col(spark, [-1.0, 0.0, 250.0, 2200.0, None], lambda c: stats.fixed_bands(c, [0, 250, 2200]), "double") == [None, "[0, 250)", "[250, 2200)", None, None]


def test_wilson_known_values(spark):
    df = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "k int, n int")
    lo, hi = stats.wilson_interval("k", "n")
    got = [tuple(r) for r in df.select(lo, hi).collect()]
    assert got[0] == (None, None)
    assert got[1] == (pytest.approx(0.236590, abs=1e-5), pytest.approx(0.763410, abs=1e-5))
    assert got[2] == (pytest.approx(0.722460, abs=1e-5), pytest.approx(1.0))


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", "train"), (1, "a", "test"), (2, "b", "test")], "id int, c string, split string")
    out = checks.check_suite([checks.unique_key("u", df, ["id"]), checks.disjoint_splits("d", df, "id", "split"), checks.class_in_split("c", df, "c", "split", "train"),
                              checks.row_checks(df, {"split": F.col("split").isin("train", "test"), "null": F.lit(None).cast("boolean")})])
    assert rows(out) == sorted([("u", 1, False), ("d", 1, False), ("c", 1, False), ("split", 0, True), ("null", 3, False)], key=repr)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    f = lambda d: tuple(sinks.table_fingerprint(d, ["k", "v"]).collect()[0])
    assert f(df) == f(df.orderBy(F.desc("k")))
    assert f(df) != f(df.na.fill("b"))
    assert f(df.limit(0))[0] == 0


def test_csv_keeps_text_na(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,b\nNA,1\n"",2\n"q ""z"", w",3\n')
    lit = [r["a"] for r in readers.read_csv(spark, str(p), "a string, b int", literal_na=True).orderBy("b").collect()]
    dflt = [r["a"] for r in readers.read_csv(spark, str(p), "a string, b int").orderBy("b").collect()]
    assert lit == ["NA", "", 'q "z", w'] and dflt == [None, None, 'q "z", w']


def test_csv_files_are_split(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,b\n" + "".join(f"row {i},{i}\n" for i in range(20_000)))
    q = tmp_path / "y.csv"
    q.write_text('a,b\n"two\nlines",1\n')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = readers.read_csv(spark, str(p), "a string, b int")
        assert df.rdd.getNumPartitions() > 2
        assert tuple(df.agg(F.count("a"), F.sum("b")).first()) == (20_000, sum(range(20_000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert readers.read_csv(spark, str(q), "a string, b int", multi_line=True).first()["a"] == "two\nlines"


def test_nested_json_records(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text('{"key":1,"issues":["A","B"],"media":[{"identifier":"https://www.x.org/1"},{"identifier":"https://y.org/2"}]}\n{"key":2,"media":[]}\n{"key":3}\n')
    schema = "key long, issues array<string>, media array<struct<identifier:string>>"
    out = readers.explode_records(readers.read_records(spark, str(p), schema), "media", ["key"], ["identifier"], "identifier", "x.org", "issues")
    assert rows(out) == [(1, "A;B", "https://www.x.org/1")]


def test_parts_with_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2,)], "k int")
    assert rows(readers.stack_parts([a, b])) == [(1, "x"), (2, None)]


def test_verdict_tiers(spark):
    def tier(label, prob, near):
        pred = spark.createDataFrame([(1, label, prob)], "id int, label string, prob double")
        nb = spark.createDataFrame([(1, lab, s) for lab, s in near], "id int, label string, similarity double")
        r = evaluate.verdict_tiers(pred, nb, "id").collect()[0]
        return r["tier"], r["support"]

    near = [("R", 0.90), ("R", 0.88), ("M", 0.861), ("R", 0.85), ("N", 0.858)]
    assert tier("R", 0.997, near) == ("confident", 3)
    assert tier("R", 0.37, near) == ("supported", 3)
    assert tier("R", 0.499, near) == ("supported", 3)
    assert tier("R", 0.5, [("C", 0.9)] * 5) == ("confident", 0)
    assert tier("R", 0.37, near[:2]) == ("low", 2)
    assert tier("R", 0.37, [(a, s - 0.06) for a, s in near]) == ("low", 0)
    assert tier(None, None, []) == ("low", 0)


def test_reliability_text(spark):
    df = spark.createDataFrame([(9, 0.125), (9, 0.075), (4, 0.9), (5, 0.8)], "n int, f1 double")
    assert [r["reliability"] for r in aggregates.kept_reliability(df, "n", "f1").collect()] == ["low (F1 0.13)", "low (F1 0.07)", "low (4 tests)", "high"]


def test_samples_above_the_window_limit(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("g"))
    small = windows.hash_first(df, "g", "id", 900, 1)
    large = windows.hash_first(df, "g", "id", 1200, 1)
    assert large.count() == 2400 and small.join(large, ["id", "k"], "left_anti").count() == 0
    assert windows.first_n_per_group(df, "g", ["id"], 1100).agg(F.max("id")).collect()[0][0] == 3668  # 366 tens with three cold ids each, then 3667 and 3668


@pytest.mark.parametrize("n", [5, 1001])
def test_first_n_keeps_the_null_group(spark, n):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "a") for i in range(30)], "i int, g string")
    got = windows.first_n_per_group(df, "g", ["i"], n).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {None: min(n, 10), "a": min(n, 20)}


def test_markers_are_found_behind_long_heads(spark):
    assert col(spark, ["x" * 9000 + "Just a moment"], lambda c: text.marker_screen(c, ["Just a moment"])) == [True]
    assert col(spark, ["x" * 9000 + "Just a moment"], lambda c: text.marker_screen(c, ["Just a moment"], head=8192)) == [False]


# ---------------------------------------------------------------- files, funnel
def test_manifest_keeps_equal_names_apart_and_reads_in_chunks(spark, tmp_path):
    import hashlib

    data = {"a/x.bin": b"1" * 1000, "b/x.bin": b"2" * 70_000, "b/c/x.bin": b"", "y.bin": b"3"}
    for name, body in data.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    want = sorted((name, hashlib.sha256(body).hexdigest(), len(body)) for name, body in data.items() if body)  # Spark lists no empty files
    assert rows(readers.file_manifest(spark, str(tmp_path))) == want
    assert rows(readers.file_manifest(spark, f"file:{tmp_path}/", "*.bin", whole=500)) == want  # two files are streamed
    then = readers.file_manifest(spark, str(tmp_path)).withColumn("sha256", F.when(F.col("file") != "a/x.bin", F.col("sha256")).otherwise(F.lit("?")))
    got = readers.checksum_verify(readers.file_manifest(spark, str(tmp_path)), then.filter("file <> 'y.bin'"))
    assert rows(got) == [("a/x.bin", "differs"), ("b/x.bin", "match"), ("y.bin", "unrecorded")]


def test_funnel_against_brute_force(spark):
    data = [(i % 7 if i % 11 else None, i % 5, i % 3 > 0, i % 4 > 0 if i % 13 else None) for i in range(200)]
    df = spark.createDataFrame(data, "rec int, item int, a boolean, b boolean")
    got = rows(aggregates.funnel(df, {"all": F.lit(True), "a": F.col("a"), "b": F.col("b")}, "rec", "item"))
    want = []
    for step, (name, keep) in enumerate([("all", lambda r: True), ("a", lambda r: r[2]), ("b", lambda r: r[2] and r[3])]):
        left = [r for r in data if keep(r)]
        want.append((step, name, len(left), len({r[0] for r in left} - {None}), len({r[1] for r in left}), len(left) / len(data)))
    assert got == want
    assert [r[2:] for r in rows(aggregates.funnel(df.limit(0), {"all": F.lit(True)}, "rec", "item"))] == [(0, 0, 0, None)]


def test_words_for_a_missing_csv_value(spark, tmp_path):
    words = [w for w in fixed.CSV_MISSING if w] + ["x", "none", "na"]
    (tmp_path / "a.csv").write_text("id,v\n" + "".join(f"{i},{w}\n" for i, w in enumerate(words)))
    got = readers.read_csv(spark, str(tmp_path), "id int, v string").orderBy("id").collect()
    assert [r["v"] for r in got] == [None] * (len(words) - 3) + ["x", "none", "na"]

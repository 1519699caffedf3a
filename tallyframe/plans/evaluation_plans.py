"""Metrics, calibration and error reports bound to the score fixture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import r6
from ..operators import aggregates as ag
from ..operators import evaluate as ev
from ..operators import sampling as sa
from ..operators import stats as st
from .evaluation_base import FIXTURE, K, logits, scored
from .registry import query
from .vector_plans import TOPK_SQL, top5

# probabilities of the fixture at temperature 0.05, and the ranked labels
PROBS_SQL = f"""
{FIXTURE},
mx as (select vec_id, max(z) as zmax from g group by 1),
ex as (select g.*, exp(z - zmax) as e1, exp((z - zmax) / 0.05::double) as e2 from g join mx using (vec_id)),
pr as (select *, e1 / sum(e1) over (partition by vec_id) as p1, e2 / sum(e2) over (partition by vec_id) as p2 from ex),
rk as (select *, row_number() over (partition by vec_id order by z desc, k) as r from pr)"""
T = 0.05


def with_probs(t) -> DataFrame:
    s = logits(t)
    return s.withColumn("before", ev.temperature_softmax("scores")).withColumn("after", ev.temperature_softmax("scores", T))


@query("topk_labels", f"with {FIXTURE} select vec_id, cast(r as integer) as place, cast(k as integer) as label, round_even(z, 6) + 0.0::double as score from o where r <= 3")
def _(t):
    best = logits(t).select("vec_id", F.posexplode(ev.topk_labels("scores", 3)).alias("place", "b"))
    return best.select("vec_id", (F.col("place") + 1).alias("place"), F.col("b.label").alias("label"), r6("b.score").alias("score"))


@query("temperature_softmax", f"with {PROBS_SQL} select vec_id, cast(k as integer) as label, round_even(p1, 6) as before, round_even(p2, 6) as after from pr")
def _(t):
    p = with_probs(t).select("vec_id", F.explode(F.arrays_zip("before", "after")).alias("p"))
    return p.select("vec_id", F.col("p.before.label").alias("label"), r6("p.before.score").alias("before"), r6("p.after.score").alias("after"))


@query("temperature_fit", """
with g as (select vec_id, label, unnest(range(0, 10)) as k, unnest(embedding[1:10])::double * 30 + case when unnest(range(0, 10)) = label then 1.5::double else 0 end as z from embeddings),
l as (select exp(i * 0.001::double) as t from (select unnest(range(-3912, 3913)) as i)),
x as (select vec_id, label, list(z order by k) as z from g group by all),
n as (select t, avg(ln(list_sum(list_transform(z, lambda v: exp((v - list_max(z)) / t)))) + (list_max(z) - z[label + 1]) / t) as nll from x, l group by t)
select round_even(arg_min(t, nll), 6) as temperature, round_even(min(nll), 6) as nll from n""")
def _(t):
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), (F.get("embedding", F.lit(k)).cast("double") * 30 + F.when(F.col("label") == k, 1.5).otherwise(0.0)).alias("score")) for k in range(K)])
    f = ev.temperature_fit(t.embeddings.select(pairs.alias("scores"), F.col("label").alias("truth")), "scores", "truth", 1e-3)
    return f.select(r6("temperature").alias("temperature"), r6("nll").alias("nll"))


@query("calibration_report", f"""
with {PROBS_SQL},
b as (select vec_id, truth, k as pred, p1, p2 from rk where r = 1),
e1 as (select greatest(1, ceil(p1 * 10)) as bin, count(*) as n, avg(case when truth = pred then 1.0::double else 0 end) as acc, avg(p1) as c from b group by 1),
e2 as (select greatest(1, ceil(p2 * 10)) as bin, count(*) as n, avg(case when truth = pred then 1.0::double else 0 end) as acc, avg(p2) as c from b group by 1)
select count(*) as n, round_even(avg(p1), 6) as mean_max_before, round_even(avg(p2), 6) as mean_max_after, round_even(avg(case when p1 < 0.5 then 1.0::double else 0 end), 6) as below_half_before,
 round_even(avg(case when p2 < 0.5 then 1.0::double else 0 end), 6) as below_half_after, 0::bigint as top1_changed, 0::bigint as top3_set_changed,
 round_even((select sum(n * abs(acc - c)) / sum(n) from e1), 6) as ece_before, round_even((select sum(n * abs(acc - c)) / sum(n) from e2), 6) as ece_after from b""")
def _(t):
    c = ev.calibration_report(with_probs(t), "before", "after", "truth")
    ints = ("n", "top1_changed", "top3_set_changed")
    return c.select(*[F.col(x) if x in ints else r6(x).alias(x) for x in c.columns])


@query("confusion_counts", """
with l as (select unnest([0, 1, 2]) as v), g as (select a.v as quality, b.v as toxic from l a, l b)
select g.quality, g.toxic, count(labels.doc_id) as n from g left join labels on labels.quality = g.quality and labels.toxic = g.toxic group by all""")
def _(t):
    return ev.confusion_counts(t.labels, "quality", "toxic", [0, 1, 2])


_METRICS = """
t as (select truth as cls, count(*) as n, count(*) filter (truth = pred) as hits from s group by 1), q as (select pred as cls, count(*) as np from s group by 1),
l as (select unnest(range(0, 12)) as cls),
c as (select l.cls, coalesce(n, 0) as n, coalesce(np, 0) as np, coalesce(hits, 0) as hits from l left join t on t.cls = l.cls left join q on q.cls = l.cls),
f as (select *, case when n > 0 then hits / n else 0 end as recall, case when n + np > 0 then 2.0::double * hits / (n + np) else 0 end as f1 from c)"""


def _labels(t, n: int = 12) -> DataFrame:
    """The fixed label list: two labels more than the data has, so that absent ones score 0."""
    return t.spark.range(n).select(F.col("id").cast("int").alias("label"))


@query("accuracy_macro_f1", f"""
with {FIXTURE}, {_METRICS}, h as (select s.vec_id, max(case when o.r <= 3 and o.k = s.truth then 1.0::double else 0 end) as top3 from s join o using (vec_id) group by 1)
select count(*) as n, round_even(avg(case when truth = pred then 1.0::double else 0 end), 6) as accuracy, round_even((select avg(top3) from h), 6) as top3, round_even((select avg(f1) from f), 6) as macro_f1 from s""")
def _(t):
    best = ev.topk_labels("scores", 3)
    s = logits(t).select("vec_id", "truth", best[0]["label"].alias("pred"), F.exists(best, lambda b: b["label"] == F.col("truth")).alias("hit3"))
    m = ev.accuracy_macro_f1(s, "truth", "pred", labels=_labels(t), top3=F.col("hit3"))
    return m.select("n", *[r6(x).alias(x) for x in ("accuracy", "top3", "macro_f1")])


@query("per_class_scores", f"""
with {FIXTURE.replace('s as (select', 's0 as (select')}, s as (select vec_id, truth, pred from s0), {_METRICS}
select 'logits' as method, cast(cls as integer) as cls, n, round_even(recall, 3) as recall, round_even(f1, 3) as f1 from f
union all select 'second', cast(l.cls as integer), coalesce(n, 0), round_even(coalesce(h / n, 0), 3), round_even(coalesce(2.0::double * coalesce(h, 0) / nullif(coalesce(n, 0) + coalesce(np, 0), 0), 0), 3)
from (select unnest(range(0, 12)) as cls) l left join (select truth as cls, count(*) as n, count(*) filter (truth = k) as h from o where r = 2 group by 1) a on a.cls = l.cls
 left join (select k as cls, count(*) as np from o where r = 2 group by 1) b on b.cls = l.cls""")
def _(t):
    best = ev.topk_labels("scores", 2)
    s = logits(t).select("truth", F.explode(F.array(
        F.struct(F.lit("logits").alias("method"), best[0]["label"].alias("pred")), F.struct(F.lit("second").alias("method"), best[1]["label"].alias("pred")))).alias("m"))
    c = ev.class_scores(s.select("truth", "m.method", "m.pred"), "truth", "pred", ["method"], _labels(t))
    return c.select("method", "cls", "n", r6("recall", 3).alias("recall"), r6("f1", 3).alias("f1"))


@query("errors_table", f"""
with {PROBS_SQL}
select a.vec_id, a.truth, cast(a.k as integer) as pred, round_even(a.p2, 3) as prob, cast(b.k as integer) as second_guess, round_even(b.p2, 3) as second_prob, 'class ' || a.truth as source
from rk a join rk b on b.vec_id = a.vec_id and b.r = 2 where a.r = 1 and a.truth <> a.k""")
def _(t):
    meta = t.embeddings.select("vec_id", F.concat(F.lit("class "), F.col("label").cast("string")).alias("source"))
    return ev.errors_table(with_probs(t), "vec_id", "truth", "after", meta)


@query("kept_reliability", f"""
with {FIXTURE}, {_METRICS}
select cast(cls as integer) as cls, case when n < 5 then printf('low (%d tests)', n) when f1 < 0.8 then printf('low (F1 %.2f)', case when f1 * 8 = floor(f1 * 8) then round(f1, 2) else f1 end) else 'high' end as reliability, n < 5 or f1 < 0.8 as is_low from f""")
def _(t):
    c = ev.class_scores(scored(t), "truth", "pred", labels=_labels(t))
    return ag.kept_reliability(c, "n", "f1").select("cls", "reliability", "is_low")


@query("score_reconcile", f"""
with {FIXTURE}, {_METRICS}
select cast(cls as integer) as cls, round_even(f1, 6) as recomputed, round_even(case when cls = 3 then f1 + 0.01::double else round_even(f1, 3) end, 6) as published, cls <> 3 as agrees from f""")
def _(t):
    c = ev.class_scores(scored(t), "truth", "pred", labels=_labels(t)).select("cls", "f1")
    other = c.withColumn("f1", F.when(F.col("cls") == 3, F.col("f1") + 0.01).otherwise(F.bround("f1", 3)))
    out = ev.score_reconcile(c, other, ["cls"], "f1")
    return out.select("cls", r6("recomputed").alias("recomputed"), r6("published").alias("published"), "agrees")


# ---------------------------------------------------------------- versions
VERSIONS = ["original", "subject_only", "subject_erased"]


def version_predictions(t) -> DataFrame:
    """Three versions of every row in long form: the logits of a version are ten dimensions of their
    own; later versions carry less of the label, as masking does."""
    def pick(offset: int, boost: float):
        e = F.array(*[F.struct((F.get("embedding", F.lit(offset + k)).cast("double") + F.when(F.col("label") == k, boost).otherwise(0.0)).alias("z"), F.lit(-k).alias("k")) for k in range(K)])
        return -F.array_max(e)["k"]

    rows = F.array(*[F.struct(F.lit(v).alias("version"), pick(10 * i, b).alias("pred")) for i, (v, b) in enumerate(zip(VERSIONS, (0.3, 0.2, 0.0)))])
    partial = (F.get("embedding", F.lit(63)) > 0).alias("partial")
    e = t.embeddings.select("vec_id", F.col("label").alias("truth"), partial, F.explode(rows).alias("r"))
    rows = e.select("vec_id", "truth", "partial", "r.version", "r.pred")
    subset = F.explode(F.when(F.col("partial"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("clean"))))
    return rows.withColumn("subset", subset).drop("partial").withColumn("scheme", F.lit("A_fixed_scores"))


VERSION_SQL = """
vg as (select vec_id, label as truth, v, embedding[64] > 0 as partial, unnest(range(0, 10)) as k, unnest(list_transform(embedding[v * 10 + 1 : v * 10 + 10], lambda x: x::double)) as z0, b from embeddings,
   (select unnest([0, 1, 2]) as v, unnest([0.3, 0.2, 0.0]::double[]) as b)),
vo as (select *, row_number() over (partition by vec_id, v order by z0 + case when k = truth then b else 0 end desc, k) as r from vg),
vp as (select vec_id, truth, partial, ['original', 'subject_only', 'subject_erased'][v + 1] as version, cast(k as integer) as pred from vo where r = 1),
vs as (select *, 'all' as subset from vp union all select *, 'clean' from vp where not partial)"""


@query("variant_accuracy", f"""
with {VERSION_SQL}, t as (select subset, version, truth as cls, count(*) as n, count(*) filter (truth = pred) as h from vs group by all), q as (select subset, version, pred as cls, count(*) as np from vs group by all),
f as (select coalesce(t.subset, q.subset) as subset, coalesce(t.version, q.version) as version, 2.0::double * coalesce(h, 0) / (coalesce(n, 0) + coalesce(np, 0)) as f1 from t full join q on t.subset = q.subset and t.version = q.version and t.cls = q.cls),
m as (select subset, version, avg(f1) as macro_f1 from f group by all)
select 'A_fixed_scores' as scheme, subset, version, count(*) as n, round_even(avg(case when truth = pred then 1.0::double else 0 end), 6) as accuracy, round_even(max(macro_f1), 6) as macro_f1 from vs join m using (subset, version) group by all""")
def _(t):
    m = ev.accuracy_macro_f1(version_predictions(t), "truth", "pred", ["scheme", "subset", "version"])
    return m.select("scheme", "subset", "version", "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query("variant_scores")
def _(t):
    by = ["scheme", "subset", "version"]
    p = version_predictions(t)
    m = ev.accuracy_macro_f1(p, "truth", "pred", by).join(st.bootstrap_ci(p, "truth", "pred", 1000, 42, by), by)
    c = st.chance_levels(t.embeddings, "label")
    n = t.embeddings.agg(F.count(F.lit(1)).alias("n"))
    chance = c.select(F.inline(F.array(
        F.struct(F.lit("chance").alias("scheme"), F.lit("").alias("subset"), F.lit("majority").alias("version"), F.col("majority_accuracy").alias("accuracy"), F.col("majority_macro_f1").alias("macro_f1")),
        F.struct(F.lit("chance").alias("scheme"), F.lit("").alias("subset"), F.lit("class shares").alias("version"), F.col("random_accuracy").alias("accuracy"), F.col("random_macro_f1").alias("macro_f1")))))
    return m.unionByName(chance.withColumn("n", n.scalar()), allowMissingColumns=True)


@query("variant_breakdown", f"""
with {VERSION_SQL}, a as (select * from vs where subset = 'all'),
r as (select truth as cls, version, count(*) as n, count(*) filter (truth = pred) / count(*) as recall from a group by all),
d as (select cls, max(n) filter (version = 'original') as n, max(recall) filter (version = 'original') as rb, max(recall) filter (version = 'subject_only') as ro from r group by 1),
k as (select *, row_number() over (order by round_even(rb - ro, 9) desc, cls) <= 5 as top5 from d)
select '1_class_drop' as section, 'class ' || cls as subject, null::varchar as version, n, round_even(rb - ro, 6) as value, top5 from k
union all select '2_class_versions', 'class 3', version, n, round_even(recall, 6), null from r where cls = 3
union all select '3_group_accuracy', case when vec_id % 2 = 0 then 'even' else 'odd' end, version, count(*), round_even(avg(case when truth = pred then 1.0::double else 0 end), 6), null from a group by all""")
def _(t):
    p = version_predictions(t).filter("subset = 'all'")
    per = ev.class_scores(p, "truth", "pred", ["scheme", "version"])
    drop = ev.recall_drop(per, "scheme", "version", "original", "subject_only")
    drop = ev.top_flag(drop, "scheme", [F.desc(F.bround("drop", 9)), F.col("cls")])
    one = drop.select(F.lit("1_class_drop").alias("section"), F.concat(F.lit("class "), F.col("cls").cast("string")).alias("subject"),
                      F.lit(None).cast("string").alias("version"), "n", r6("drop").alias("value"), F.col("top").alias("top5"))
    two = per.filter("cls = 3").select(F.lit("2_class_versions").alias("section"), F.lit("class 3").alias("subject"), "version", "n", r6("recall").alias("value"))
    group = F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd")
    three = p.groupBy(group.alias("subject"), "version").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("truth") == F.col("pred")).cast("double"))).alias("value"))
    three = three.withColumn("section", F.lit("3_group_accuracy"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one, two, three])


@query("variant_outcomes_side_by_side", f"""
with {VERSION_SQL} select vec_id, max(cast(truth = pred as integer)) filter (version = 'original') as original, max(cast(truth = pred as integer)) filter (version = 'subject_only') as subject_only,
 max(cast(truth = pred as integer)) filter (version = 'original') - max(cast(truth = pred as integer)) filter (version = 'subject_only') as drop_subject_only from vp group by 1""")
def _(t):
    from ..operators.joins import paired_outcomes

    p = version_predictions(t).filter("subset = 'all'")
    return paired_outcomes(p, ["vec_id"], "version", ["original", "subject_only"], F.max((F.col("truth") == F.col("pred")).cast("int")), "original")


@query("verdict_tiers", f"""
with {PROBS_SQL}, {TOPK_SQL.strip()},
b as (select vec_id, k as label, p2 from rk where r = 1),
sv as (select query_id, count(*) filter (nl = label and similarity >= 0.85) as support, count(*) as n_similar from top join b on b.vec_id = query_id group by 1)
select vec_id, cast(label as integer) as label, round_even(p2, 6) as top1, support, n_similar, case when p2 >= 0.5 then 'confident' when support >= 3 then 'supported' else 'low' end as tier from b join sv on sv.query_id = vec_id""")
def _(t):
    best = ev.topk_labels("after", 1)[0]
    pred = with_probs(t).select("vec_id", best["label"].alias("label"), best["score"].alias("prob"))
    near = top5(t).join(t.embeddings.select(F.col("vec_id").alias("neighbour_id"), "label"), "neighbour_id").select(F.col("query_id").alias("vec_id"), "label", "similarity")
    return ev.verdict_tiers(pred, near, "vec_id").withColumn("top1", r6("top1"))

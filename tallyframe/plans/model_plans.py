"""Model fits bound to the driver tables. Fits have no SQL twin; tests check their invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.session import materialise
from ..functions.values import r6
from ..operators import evaluate as ev
from ..operators import models as mo
from ..operators import sampling as sa
from .registry import query
from .vector_plans import split_vectors


@query("linear_probe_fit")
def _(t):
    split = materialise(split_vectors(t))
    probe = mo.linear_probe_fit(split.filter("split = 'train'"), "embedding", "label", C=1.0, max_iter=100)
    s = probe.score(split).select("split", "label", ev.topk_labels("probs", 1)[0]["label"].alias("pred"))
    return ev.accuracy_macro_f1(s, "label", "pred", ["split"])


def out_of_fold(t, max_iter: int = 5000):
    return mo.cv_out_of_fold(t.embeddings, "vec_id", "embedding", "label", folds=5, seed=42, max_iter=max_iter)


@query("cv_out_of_fold")
def _(t):
    s = out_of_fold(t).select("vec_id", "fold", "label", ev.topk_labels("probs", 1)[0]["label"].alias("pred"))
    return s.select("vec_id", "fold", "label", "pred")


#: All features, without the numbers' companion, one kind of number, the names alone, and all with one more name.
FEATURE_SETS = {"numbers": ([], ["n_chars", "n_lines"]), "all": (["source"], ["n_chars", "n_lines"]), "size": ([], ["n_chars"]),
                "source": (["source"], []), "all_and_shape": (["source", "shape"], ["n_chars", "n_lines"])}


@query("mixed_feature_probe")
def _(t):
    docs = t.documents.select("doc_id", "lang", "source", "n_chars", F.size(F.split("text", "\n")).alias("n_lines"))
    docs = docs.withColumn("n_chars", F.col("n_chars").cast("double")).withColumn("n_lines", F.col("n_lines").cast("double"))
    docs = materialise(docs.withColumn("shape", F.when(F.col("n_lines") > 1, "lines").otherwise("one line")))  # the texts are read once
    p = mo.mixed_feature_probe(docs, "doc_id", "lang", FEATURE_SETS, ["logistic", "forest"], folds=5, seed=42, trees=200, max_iter=5000)
    scores = ev.accuracy_macro_f1(p, "truth", "pred", ["feature_set", "model"])
    null = mo.permuted_probe(docs, "doc_id", "lang", FEATURE_SETS, folds=5, seed=42, permutations=200).withColumn("model", F.lit("logistic"))
    return scores.join(null, ["feature_set", "model"], "left")


def _first_from_rest(t):
    return t.embeddings.select("vec_id", F.slice("embedding", 2, 63).alias("rest"), F.get("embedding", F.lit(0)).cast("double").alias("target"))


@query("ridge_cv_r2")
def _(t):
    return mo.ridge_cv_r2(_first_from_rest(t), "vec_id", "rest", "target", [10 ** (i / 2 - 3) for i in range(13)], folds=5)


@query("ridge_moments", """
with e as (select vec_id, list_concat([1.0::double], list_transform(embedding[2:64], lambda x: x::double), [embedding[1]::double]) as v,
 (row_number() over (order by md5('42|' || vec_id), vec_id) - 1) % 5 as fold from embeddings),
l as (select vec_id, fold, unnest(range(0, 65)) as i, unnest(v) as x from e)
select cast(a.fold as integer) as fold, cast(a.i as integer) as i, cast(b.i as integer) as j, round_even(sum(a.x * b.x), 6) as moment
from l a join l b on a.vec_id = b.vec_id and b.i >= a.i group by all""")
def _(t):
    """What the ridge is solved from: the sums of products of (1, features, target) in each fold."""
    rows = sa.stratified_folds(_first_from_rest(t).withColumn("_all", F.lit("all")), "_all", "vec_id", 5, 42)
    m = mo.fold_moments(rows, "rest", "target").select("fold", "i", F.posexplode("sums").alias("j", "moment"))
    return m.filter("j >= i").select("fold", "i", "j", r6("moment").alias("moment"))


@query("platt_compare")
def _(t):
    oof = materialise(out_of_fold(t).select("vec_id", "label", "logits", "probs"))
    params = mo.platt_fit(oof, "logits", "label")
    both = mo.platt_apply(oof, "logits", params)
    return ev.calibration_report(both, "probs", "platt", "label")


@query("temperature_fit_out_of_fold")
def _(t):
    return ev.temperature_fit(out_of_fold(t), "logits", "label", 1e-4)


@query("variant_scores_retrained")
def _(t):
    """The retrained scheme: out-of-fold predictions on each version of the vectors and each subset of the rows, long form."""

    def predicted(subset: str, keep, version: str, first: int):
        e = t.embeddings.filter(keep).select("vec_id", "label", F.slice("embedding", first, 32).alias("v"))
        s = mo.cv_out_of_fold(e, "vec_id", "v", "label", folds=5, seed=42, max_iter=5000)
        return s.select(F.lit("B_retrained_cv").alias("scheme"), F.lit(subset).alias("subset"), F.lit(version).alias("version"),
                        F.col("label").alias("truth"), ev.topk_labels("probs", 1)[0]["label"].alias("pred"))

    work = [lambda a=(subset, keep, version, first): predicted(*a)
            for subset, keep in (("all", F.lit(True)), ("clean", F.get("embedding", F.lit(63)) <= 0))
            for version, first in (("original", 1), ("subject_only", 33), ("subject_erased", 17))]
    parts = reduce(DataFrame.unionByName, mo.side_by_side(work, 3))  # each fits five folds side by side
    return ev.accuracy_macro_f1(parts, "truth", "pred", ["scheme", "subset", "version"])


@query("cluster_silhouette")
def _(t):
    return mo.cluster_silhouette(t.embeddings, "embedding", "label")


@query("project_2d")
def _(t):
    return mo.project_2d(t.embeddings, "embedding").place(t.embeddings).select("vec_id", "label", "x", "y")

"""Vector operators bound to the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import r6
from ..operators import sampling as sa
from ..operators import vectors as ve
from .registry import query

SPLIT_SQL = """
sp as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v, case when k <= greatest(1, cast(round_even(n * 0.2::double, 0) as bigint)) then 'test' else 'train' end as split
  from (select *, row_number() over (partition by label order by md5('42|' || vec_id), vec_id) as k, count(*) over (partition by label) as n from embeddings))"""
TOPK_SQL = SPLIT_SQL + """,
pairs as (select q.vec_id as query_id, q.label as ql, c.vec_id as neighbour_id, c.label as nl,
  round_even(list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 12) as similarity from sp q join sp c on c.split = 'train' and c.vec_id <> q.vec_id),
top as (select * from (select *, row_number() over (partition by query_id order by similarity desc, neighbour_id) as rank from pairs) where rank <= 5)"""


def split_vectors(t):
    return sa.stratified_split(t.embeddings, "label", "vec_id", 0.2, 42)


def top5(t, k: int = 5):
    """Neighbours among train rows of every row."""
    return ve.cosine_topk(t.embeddings, split_vectors(t).filter("split = 'train'"), "vec_id", "embedding", k)


@query("l2_normalise", """
with s as (select vec_id, list_transform(embedding, lambda x: x::double * (1 + vec_id % 3)) as v from embeddings where vec_id % 50 <> 0),
e as (select vec_id, unnest(range(0, len(v))) as dim, unnest(v) / sqrt(list_dot_product(v, v)) as x from s)
select vec_id, cast(dim as integer) as dim, round_even(x, 6) + 0.0::double as x from e""")
def _(t):
    scale = F.when(F.col("vec_id") % 50 == 0, F.lit(0.0)).otherwise((1 + F.col("vec_id") % 3).cast("double"))
    s = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * scale).alias("v"))
    return ve.l2_normalise(s, "v").select("vec_id", F.posexplode("v").alias("dim", "x")).withColumn("x", r6("x"))


@query("norm_check", """
with n as (select sqrt(list_dot_product(v, v)) * case when vec_id % 40 = 7 then 1.01::double else 1 end as n from (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings))
select count(*) as n_rows, count(*) filter (abs(n - 1) > 1e-4) as n_off, round_even(min(n), 6) as min_norm, round_even(max(n), 6) as max_norm from n""")
def _(t):
    off = F.when(F.col("vec_id") % 40 == 7, F.lit(1.01)).otherwise(F.lit(1.0))
    c = ve.norm_check(t.embeddings.select(F.transform("embedding", lambda x: x.cast("double") * off).alias("v")), "v")
    return c.withColumn("min_norm", r6("min_norm")).withColumn("max_norm", r6("max_norm"))


def _perturbed(t):
    """The same vectors with some elements changed by an amount that depends on the id."""
    delta = (F.col("vec_id") % 10).cast("double") / 50
    return t.embeddings.select("vec_id", F.transform("embedding", lambda x, i: x.cast("double") + F.when(i % 7 == 0, delta).otherwise(F.lit(0.0))).alias("embedding"))


_PERTURBED = """
a as (select vec_id, list_transform(embedding, lambda x: x::double) as a from embeddings),
ab as (select vec_id, a, list_transform(a, lambda x, i: x + case when (i - 1) % 7 = 0 then (vec_id % 10)::double / 50 else 0 end) as b from a)"""


@query("paired_cosine", f"""
with {_PERTURBED}, c as (select vec_id, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) as c from ab)
select 'min' as what, null::bigint as id, round_even(min(c), 6) as value from c union all select 'p1', null, round_even(quantile_cont(c, 0.01), 6) from c
union all select 'median', null, round_even(median(c), 6) from c union all (select 'worst', vec_id, round_even(c, 6) from c order by c, vec_id limit 5)""")
def _(t):
    return ve.paired_cosine(t.embeddings, _perturbed(t), "vec_id", "embedding").withColumn("value", r6("value"))


@query("signal_distance", f"""
with {_PERTURBED}, m as (select vec_id, list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len(a) as mse from ab),
p as (select vec_id, mse, case when mse = 0 then 'infinity'::double else 10 * log10(4.0::double / mse) end as psnr_db from m)
select vec_id, round_even(mse, 9) as mse, case when isinf(psnr_db) then psnr_db else round_even(psnr_db, 4) end as psnr_db,
 case when mse = 0 then 'exact' when psnr_db >= 30 and vec_id % 9 <= 6 then 'visual_match' else 'unconfirmed' end as tier from p""")
def _(t):
    d = ve.signal_distance(t.embeddings, _perturbed(t), "vec_id", "embedding", peak=2.0)
    db = F.col("psnr_db")
    return d.select("vec_id", r6("mse", 9).alias("mse"), F.when(db == float("inf"), db).otherwise(F.bround(F.when(db < float("inf"), db), 4)).alias("psnr_db"),
                    ve.evidence_tier(db, F.col("vec_id") % 9, F.col("mse") == 0).alias("tier"))


@query("cosine_topk", f"with {TOPK_SQL} select query_id, neighbour_id, cast(rank as integer) as rank, round_even(similarity, 6) as similarity from top")
def _(t):
    return top5(t).withColumn("similarity", r6("similarity"))


@query("cosine_topk_blocked", f"with {TOPK_SQL} select query_id, neighbour_id, cast(rank as integer) as rank, round_even(similarity, 6) as similarity from top")
def _(t):
    train = split_vectors(t).filter("split = 'train'")
    top = ve.cosine_topk(t.embeddings, train, "vec_id", "embedding", 5, broadcast_bytes=1 << 20)
    return top.withColumn("similarity", r6("similarity"))


@query("cosine_topk_text_ids", f"""
with {TOPK_SQL}, named as (select 'item ' || query_id as query_id, 'item ' || neighbour_id as neighbour_id, similarity from pairs),
best as (select *, row_number() over (partition by query_id order by similarity desc, neighbour_id) as rank from named)
select query_id, neighbour_id, cast(rank as integer) as rank, round_even(similarity, 6) as similarity from best where rank <= 5""")
def _(t):
    """Text ids, as catalogues have them; ties go by text order."""
    named = split_vectors(t).withColumn("vec_id", F.concat(F.lit("item "), F.col("vec_id").cast("string")))
    return ve.cosine_topk(named, named.filter("split = 'train'"), "vec_id", "embedding", 5).withColumn("similarity", r6("similarity"))


@query("similar_cards", f"""
with {TOPK_SQL} select query_id, neighbour_id, nl as label, 'class ' || nl as title, 'https://catalogue.example.org/item/' || neighbour_id as link, round_even(similarity, 6) as similarity from top""")
def _(t):
    meta = t.embeddings.select("vec_id", "label", F.concat(F.lit("class "), F.col("label").cast("string")).alias("title"))
    cards = ve.similar_cards(top5(t), meta, "vec_id", ["label", "title"], "https://catalogue.example.org/item/")
    return cards.select("query_id", "neighbour_id", "label", "title", "link", r6("similarity").alias("similarity"))


@query("knn_vote", f"""
with {TOPK_SQL}, c as (select query_id, nl, count(*) as n, min(rank) as first from top where rank <= 3 group by all)
select query_id, arg_min(nl, first) as top1, first(nl order by n desc, first) as vote from c group by 1""")
def _(t):
    return ve.knn_vote(top5(t), t.embeddings, "vec_id", "label")


@query("prototype_classify", f"""
with {SPLIT_SQL}, d as (select vec_id, label, split, unnest(v) as x, unnest(range(0, len(v))) as dim from sp),
m as (select label as cls, dim, avg(x) as m from d where split = 'train' group by all), w as (select cls, sqrt(sum(m * m)) as norm from m group by 1),
s as (select vec_id, cls, sum(x * m) / max(norm) as score from d join m using (dim) join w using (cls) group by all),
r as (select *, row_number() over (partition by vec_id order by round_even(score, 12) desc, cls) as k from s)
select vec_id, cast(cls as integer) as label, cast(k as integer) as place, round_even(score, 6) as score from r where k <= 3""")
def _(t):
    from ..operators.evaluate import topk_labels

    protos = ve.class_vectors(split_vectors(t).filter("split = 'train'"), "label", "embedding")
    scored = ve.score_against(t.embeddings, "embedding", protos, "label")
    best = scored.select("vec_id", F.posexplode(topk_labels("scores", 3)).alias("place", "b"))
    return best.select("vec_id", (F.col("place") + 1).alias("place"), F.col("b.label").alias("label"), r6("b.score").alias("score"))


@query("prototype_sets_compared", f"""
with {SPLIT_SQL}, d as (select vec_id, label, split, unnest(v) as x, unnest(range(0, len(v))) as dim from sp),
m as (select 'all' as set_name, label as cls, dim, avg(x) as m from d where split = 'train' group by all union all
      select 'first', label, dim, first(x order by vec_id) from d where split = 'train' group by all),
w as (select set_name, cls, sqrt(sum(m * m)) as norm from m group by all),
s as (select set_name, vec_id, label, cls, round_even(sum(x * m) / max(norm), 12) as score from d join m using (dim) join w using (set_name, cls) where split = 'test' group by all),
r as (select *, row_number() over (partition by set_name, vec_id order by score desc, cls) as k from s)
select set_name, count(*) as n, round_even(avg(case when label = cls then 1.0::double else 0.0::double end), 6) as top1 from r where k = 1 group by 1""")
def _(t):
    from ..operators.evaluate import topk_labels

    split = split_vectors(t)
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    sets = {"all": ve.class_vectors(train, "label", "embedding"),
            "first": train.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))}
    parts = []
    for name, protos in sets.items():
        s = ve.score_against(test, "embedding", protos, "label")
        hit = (topk_labels("scores", 1)[0]["label"] == F.col("label")).cast("double")
        parts.append(s.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(hit)).alias("top1")).select(F.lit(name).alias("set_name"), "n", "top1"))
    return parts[0].unionByName(parts[1])


_CENTROIDS = """
d as (select vec_id, label, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as dim from embeddings),
m as (select label, dim, avg(x) as m from d group by all),
g as (select vec_id, label, sqrt(sum((x - m) * (x - m))) as dist from d join m using (label, dim) group by all),
sp as (select label, count(*) as n, avg(dist) as spread from g group by 1)"""


@query("class_centroids", f"""
with {_CENTROIDS} select label, n, round_even(spread, 6) as spread, cast(dim as integer) as dim, round_even(m, 6) + 0.0::double as mean from sp join m using (label)""")
def _(t):
    c = ve.class_centroids(t.embeddings, "label", "embedding")
    return c.select("label", "n", r6("spread").alias("spread"), F.posexplode("centroid").alias("dim", "mean")).withColumn("mean", r6("mean"))


@query("pair_separation", f"""
with {_CENTROIDS}, pr as (select a.label as a, b.label as b from (select distinct label from sp) a join (select distinct label from sp) b on b.label = a.label + 1),
x as (select a, b, sqrt(sum((p.m - q.m) * (p.m - q.m))) as distance from pr join m p on p.label = a join m q on q.label = b and q.dim = p.dim group by all)
select a, b, round_even(distance, 6) as distance, round_even(s1.spread, 6) as spread_a, round_even(s2.spread, 6) as spread_b,
 case when distance < greatest(s1.spread, s2.spread) then 'overlapping' when distance < 2 * greatest(s1.spread, s2.spread) then 'adjacent' else 'separated' end as verdict
from x join sp s1 on s1.label = a join sp s2 on s2.label = b""")
def _(t):
    c = ve.class_centroids(t.embeddings, "label", "embedding")
    labels = t.embeddings.select(F.col("label").alias("a")).distinct()
    pairs = labels.select("a", (F.col("a") + 1).alias("b"))
    out = ve.pair_separation(c, pairs, "label")
    return out.select("a", "b", *[r6(x).alias(x) for x in ("distance", "spread_a", "spread_b")], "verdict")


@query("nearest_other_centroid", f"""
with {_CENTROIDS}, x as (select p.label as label, q.label as nearest, sqrt(sum((p.m - q.m) * (p.m - q.m))) as distance from m p join m q on q.dim = p.dim and q.label <> p.label group by all)
select cast(label as bigint) as label, cast(arg_min(nearest, distance) as bigint) as nearest, round_even(min(distance), 6) as distance from x group by 1""")
def _(t):
    c = ve.class_centroids(t.embeddings, "label", "embedding")
    return ve.nearest_other_centroid(c, "label").withColumn("distance", r6("distance"))


_COMPOSITION = """
e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
g as (select vec_id, label, unnest(range(0, 10)) as k, unnest(v[1:10]) as z from e),
wrong as (select vec_id from (select vec_id, label, k, row_number() over (partition by vec_id order by z desc, k) as r from g) where r = 1 and k <> label),
n as (select q.vec_id as query_id, c.label, row_number() over (partition by q.vec_id order by round_even(-list_distance(q.v, c.v), 12) desc, c.vec_id) as rank from e q join wrong using (vec_id) join e c on c.vec_id <> q.vec_id),
c as (select query_id, label, count(*) as n from n where rank <= 10 group by all),
k as (select *, row_number() over (partition by query_id order by n desc, label) as r from c)"""


@query("neighbour_composition", f"with {_COMPOSITION} select query_id, string_agg(label || ' ' || n, ', ' order by r) as neighbours from k where r <= 3 group by 1")
def _(t):
    from .evaluation_base import scored

    wrong = scored(t).filter("truth <> pred").select("vec_id")
    errors = t.embeddings.join(wrong, "vec_id", "left_semi")
    top = ve.cosine_topk(errors, t.embeddings, "vec_id", "embedding", 10, metric="euclidean")
    return ve.neighbour_composition(top, t.embeddings, "vec_id", "label")


@query("fingerprint_match", """
with b as (select vec_id, list_transform(embedding[1:64], lambda x: x::double > list_sort(embedding[2:64])[32]::double) as f from embeddings),
n as (select vec_id, list_transform(f, lambda x, i: case when i - 1 in (vec_id % 64, (vec_id * 7) % 64, (vec_id * 11) % 64) and vec_id % 3 <> 2 then not x when vec_id % 3 = 2 and i % 2 = 0 then not x else x end) as f from b),
p as (select a.vec_id, c.vec_id as match, len(list_filter(list_zip(a.f, c.f), lambda z: z[1] <> z[2])) as distance from n a join b c on true)
select vec_id, match, cast(distance as integer) as distance from p where distance <= 6 qualify row_number() over (partition by vec_id order by distance, match) = 1""")
def _(t):
    right = t.embeddings.select("vec_id", ve.fingerprint("embedding").alias("fp"))
    one = F.lit(1).cast("bigint")
    bit = lambda c: F.call_function("shiftleft", one, c.cast("int"))
    key = F.col("vec_id")
    few = bit(key % 64).bitwiseOR(bit((key * 7) % 64)).bitwiseOR(bit((key * 11) % 64))
    odd = F.lit(-6148914691236517206).cast("bigint")  # every second bit
    left = right.withColumn("fp", F.col("fp").bitwiseXOR(F.when(key % 3 != 2, few).otherwise(odd)))
    return ve.fingerprint_match(left, right, "vec_id", "fp")


_MASK_W = [((j * 37) % 11 - 5) / 2.0 for j in range(64)]


def _importance_sql(masks: int) -> str:
    return f"""
with w as (select unnest(range(0, 64)) as j, unnest([{", ".join(str(x) for x in _MASK_W)}]::double[]) as w),
k as (select m, j, w, case when cast('0x' || substr(md5('42|' || m || '|' || j), 1, 8) as bigint) / 4294967296.0::double < 0.5 then 1 else 0 end as bit from (select unnest(range(0, {masks})) as m), w),
d as (select vec_id, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as j from embeddings),
p as (select vec_id, m, 1 / (1 + exp(-sum(x * w * bit))) as p from d join k using (j) group by all),
i as (select vec_id, j, sum(p * bit) / greatest(sum(bit), 1e-6) as importance from p join k using (m) group by all)
select vec_id, cast(j as integer) as feature, round_even(importance, 6) as importance from i"""


@query("occlusion_importance", _importance_sql(32))
def _(t):
    return _importance(t, 32)


@query("occlusion_importance_full", _importance_sql(400))
def _(t):
    return _importance(t, 400)


def _importance(t, masks: int):
    imp = ve.occlusion_importance(t.embeddings, "vec_id", "embedding", _MASK_W, masks, 0.5, 42)
    return imp.select("vec_id", F.posexplode("importance").alias("feature", "importance")).withColumn("importance", r6("importance"))


@query("occlusion_summary")
def _(t):
    return ve.occlusion_summary(ve.occlusion_importance(t.embeddings, "vec_id", "embedding", _MASK_W, 400, 0.5, 42), "vec_id")

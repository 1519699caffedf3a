"""Geography and serving tables bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import r6
from ..operators import evaluate as ev
from ..operators import geo as ge
from ..operators import models as mo
from ..operators import vectors as ve
from .evaluation_base import FIXTURE, logits, scored
from .evaluation_plans import PROBS_SQL, T
from .registry import query
from .vector_plans import SPLIT_SQL, TOPK_SQL, split_vectors, top5

_POINTS = """
pt as (select c_custkey, c_nationkey, c_mktsegment, case when c_custkey % 8 <> 3 then (c_custkey * 37) % 1400 / 100.0::double - 25.7::double end as lat, (c_custkey * 53) % 770 / 100.0::double + 43.0::double as lon,
  case when c_custkey % 6 <> 1 then c_acctbal end as elev, case when c_custkey % 5 <> 2 then cast(1990 + c_custkey % 30 as integer) end as year, case when c_custkey % 7 <> 0 then 'place ' || c_custkey % 4 end as place from customer)"""


def points(t):
    k = F.col("c_custkey")
    return t.customer.select(
        "c_custkey", "c_nationkey", "c_mktsegment", F.when(k % 8 != 3, (k * 37) % 1400 / 100.0 - 25.7).alias("lat"), ((k * 53) % 770 / 100.0 + 43.0).alias("lon"),
        F.when(k % 6 != 1, F.col("c_acctbal")).alias("elev"), F.when(k % 5 != 2, (1990 + k % 30).cast("int")).alias("year"),
        F.when(k % 7 != 0, F.concat(F.lit("place "), (k % 4).cast("string"))).alias("place"))


@query("grid_cluster", f"""
with {_POINTS}, p as (select * from pt where lat is not null),
q as (select *, floor((lon / 360 + 0.5::double) * 256 * 64 / 56) as cx, floor((0.5::double - ln((1 + sin(lat * pi() / 180)) / (1 - sin(lat * pi() / 180))) / (4 * pi())) * 256 * 64 / 56) as cy, count(*) over (partition by c_mktsegment) as m from p)
select c_mktsegment, cast(cx as bigint) as cell_x, cast(cy as bigint) as cell_y, round_even(avg(lat), 6) as lat, round_even(avg(lon), 6) as lon, count(*) as n from q where m > 265 group by all
union all select c_mktsegment, cast(cx as bigint), cast(cy as bigint), round_even(lat, 6), round_even(lon, 6), 1 from q where m <= 265""")
def _(t):
    g = ge.grid_cluster(points(t), "c_mktsegment", "lat", "lon", zoom=6, above=265)
    return g.withColumn("lat", r6("lat")).withColumn("lon", r6("lon"))


@query("class_geo_table", f"""
with {_POINTS}, s as (select *, row_number() over (partition by c_nationkey order by case when lat is null then 1 else 0 end, md5('42|' || c_custkey), c_custkey) as k from pt),
pl as (select c_nationkey, place, count(*) as n from pt where place is not null group by all),
pj as (select c_nationkey, '{{' || string_agg('"' || place || '":' || n, ',' order by n desc, place) || '}}' as places from pl group by 1)
select c_nationkey, count(*) as n_rows, count(distinct case when c_mktsegment <> 'MACHINERY' then place end) as n_named, count(*) - count(place) as n_unnamed, any_value(places) as places,
  round_even(min(elev), 6) as measure_min, round_even(median(elev), 6) as measure_median, round_even(max(elev), 6) as measure_max, count(elev) as measure_n, min(year) as year_min, max(year) as year_max,
  count(lat) as n_with_coords, count(lat) > 20 as points_capped, round_even(sum(round_even(lat, 5)) filter (k <= 20), 4) as lat_sum, count(lat) filter (k <= 20) as n_points from s left join pj using (c_nationkey) group by 1""")
def _(t):
    g = ge.class_geo_table(points(t), "c_nationkey", "c_custkey", "place", "lat", "lon", "elev", "year", "place", F.col("c_mktsegment") != "MACHINERY", 20, 42)
    pts = F.from_json("points", "array<array<double>>")
    return g.select("c_nationkey", "n_rows", "n_named", "n_unnamed", "places", *[r6(c).alias(c) for c in ("measure_min", "measure_median", "measure_max")],
                    "measure_n", "year_min", "year_max", "n_with_coords", "points_capped",
                    F.bround(F.aggregate(pts, F.lit(0.0), lambda a, p: a + p[0]), 4).alias("lat_sum"), F.size(pts).cast("long").alias("n_points"))


@query("place_shares", f"""
with {_POINTS}, c as (select c_nationkey, place, count(*) as n from pt where place is not null group by all)
select c_nationkey, place, n, round_even(n / max(n) over (partition by c_nationkey), 6) as share from c""")
def _(t):
    return ge.place_shares(points(t), "c_nationkey", "place").withColumn("share", r6("share"))


@query("near_points", """
with p as (select label, embedding[1]::double as x, embedding[2]::double as y from embeddings),
c as (select label as name, avg(embedding[1]::double) as cx, avg(embedding[2]::double) as cy from embeddings group by 1)
select 'centre ' || name as name, label, count(*) as n from p, c where (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 0.01 group by all""")
def _(t):
    p = t.embeddings.select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    c = p.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).select(F.concat(F.lit("centre "), F.col("label").cast("string")).alias("name"), "cx", "cy")
    return ge.near_points(p, "x", "y", "label", c, 0.1)


@query("class_table", f"""
with {SPLIT_SQL}, {FIXTURE.strip()},
n as (select label, count(*) filter (split = 'train') as n_train, count(*) filter (split = 'test') as n_test, median(v[1]) as mx, median(v[2]) as my from sp group by 1),
f as (select n.label, 2.0::double * count(*) filter (truth = n.label and pred = n.label) / (count(*) filter (truth = n.label) + count(*) filter (pred = n.label)) as f1 from n, s group by 1)
select n.label, n_train, n_test, round_even(f1, 6) as f1, round_even(mx, 6) + 0.0::double as x_median, round_even(my, 6) + 0.0::double as y_median from n join f using (label)""")
def _(t):
    split = split_vectors(t).select("vec_id", "label", "split", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))
    scores = ev.class_scores(scored(t), "truth", "pred").select(F.col("cls").alias("label"), r6("f1").alias("f1"))
    pos = ve.class_median_position(split, "label", "x", "y").select("label", r6("x_median").alias("x_median"), r6("y_median").alias("y_median"))
    return ge.class_table(split, scores, pos, "label")


@query("atlas_table")
def _(t):
    placed = mo.project_2d(t.embeddings, "embedding").place(t.embeddings)
    present = t.documents.select(F.col("doc_id").alias("vec_id"))
    return ge.atlas_table(placed, "vec_id", ["label"], present, {"method": "pca", "components": "2"})


@query("batch_analyze")
def _(t):
    """Top-3 classes, five similar train rows, map position and verdict for every test row."""
    split = split_vectors(t)
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'").select("vec_id", "embedding")
    protos = ve.class_vectors(train, "label", "embedding")
    s = ve.score_against(test, "embedding", protos, "label").withColumn("probs", ev.temperature_softmax("scores", T))
    best = ev.topk_labels("probs", 3)
    pred = s.select("vec_id", best.alias("b"))
    near = ve.cosine_topk(test, train, "vec_id", "embedding", 5).join(train.select(F.col("vec_id").alias("neighbour_id"), "label"), "neighbour_id")
    entry = F.struct("rank", F.format_string("%d (%d, %.3f)", "neighbour_id", "label", "similarity").alias("t"))
    cards = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["t"]), "; ").alias("similar"))
    verdict = ev.verdict_tiers(pred.select("vec_id", F.col("b")[0]["label"].alias("label"), F.col("b")[0]["score"].alias("prob")),
                               near.select(F.col("query_id").alias("vec_id"), "label", "similarity"), "vec_id")
    xy = mo.project_2d(train, "embedding").place(test).select("vec_id", "x", "y")
    text = F.array_join(F.transform("b", lambda x: F.format_string("%d %.3f", x["label"], x["score"])), ", ")
    return pred.select("vec_id", text.alias("top3")).join(cards, "vec_id", "left").join(xy, "vec_id").join(verdict.select("vec_id", "support", "tier"), "vec_id")


@query("evidence_rows", f"""
with {PROBS_SQL}, {TOPK_SQL.strip()},
g3 as (select vec_id, string_agg(k || ' ' || printf('%.3f', p2), ', ' order by r) as top3 from rk where r <= 3 group by 1),
rc as (select query_id, string_agg(neighbour_id || ' (' || nl || ', cosine ' || printf('%.3f', similarity) || ')', '; ' order by rank) as receipts from top group by 1),
b as (select vec_id, truth, avg(z) as baseline from g group by all),
runs as (select vec_id, truth, cast(k as integer) as target, p2 as p_full from rk where r <= 2)
select vec_id, target, printf('%d labelled %d; target %d: P = %.3f over %d masks, baseline %.3f; first guesses %s; receipts %s', vec_id, truth, target, p_full, 400, baseline, top3, receipts) as sentence
from runs join g3 using (vec_id) join rc on rc.query_id = vec_id join b using (vec_id, truth)""")
def _(t):
    s = logits(t).withColumn("probs", ev.temperature_softmax("scores", T))
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x["score"])
    s = s.withColumn("baseline", total / F.size("scores")).withColumn("b", ev.topk_labels("probs", 3))
    runs = s.select("vec_id", "truth", "baseline", F.explode(F.slice("b", 1, 2)).alias("r")).select(
        "vec_id", "truth", "baseline", F.col("r.label").alias("target"), F.col("r.score").alias("p_full"))
    unknown = runs.limit(1).withColumn("vec_id", F.lit(-1).cast("long"))  # an id without evidence gives no row
    receipts = top5(t).join(t.embeddings.select(F.col("vec_id").alias("neighbour_id"), "label"), "neighbour_id").select(
        F.col("query_id").alias("vec_id"), "rank", F.col("neighbour_id").alias("neighbour"), "label", "similarity")
    settings = t.spark.range(1).select(F.lit(400).alias("n_masks"))
    out = ge.evidence_rows(runs.unionByName(unknown), s.select("vec_id", F.col("b").alias("top3")), receipts, settings, "vec_id")
    return out.select("vec_id", "target", "sentence")

"""Sorts, set operations, splits and samples bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import r6
from ..operators import sampling as sa
from .registry import query
from .scalar_plans import LINE_FLAGS_SQL, line_flags


@query("qa_worst", f"""
with f as (select *, {LINE_FLAGS_SQL} as f from lineitem),
s as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, round_even(case when regexp_matches(f, 'empty|large|frame_filling|small') then 10.0::double else 0.0::double end + l_discount + l_tax + least(l_linenumber, 10) / 50.0::double, 4) as qa_score from f)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, qa_score from s order by qa_score desc, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate limit 40""")
def _(t):
    base = t.lineitem.withColumn("flags", line_flags())
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    out = sa.qa_worst(base, F.col("flags").rlike("empty|large|frame_filling|small"), ["l_discount", "l_tax"], "l_linenumber", [*ids, "l_shipdate"], 40)
    return out.select(*ids, "qa_score")


@query("bottom_k", "select l_orderkey, l_partkey, l_extendedprice from lineitem order by l_extendedprice, l_orderkey, l_partkey limit 5")
def _(t):
    return sa.bottom_k(t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice"), "l_extendedprice", ["l_orderkey", "l_partkey"], 5)


@query("ordered_export", "select r_name, n_name, s_suppkey from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey order by all")
def _(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    s = t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "s_suppkey")
    return sa.ordered_export(s, ["r_name", "n_name", "s_suppkey"])


@query("top_n_fold_other", """
with c as (select source, row_number() over (order by count(*) desc, source) as r from documents group by 1)
select case when r <= 8 then source else 'other' end as category, lang, count(*) as n from documents join c using (source) group by all""")
def _(t):
    return sa.top_n_fold_other(t.documents.select("source", "lang"), "source", 8).groupBy("category", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("union_versions", """
select 'v1996' as version, o_orderkey, o_totalprice, null::varchar as o_orderpriority from orders where year(o_orderdate) = 1996
union all select 'v1997', o_orderkey, o_totalprice, o_orderpriority from orders where year(o_orderdate) = 1997""")
def _(t):
    a = t.orders.filter(F.year("o_orderdate") == 1996).select("o_orderkey", "o_totalprice")
    b = t.orders.filter(F.year("o_orderdate") == 1997).select("o_orderkey", "o_totalprice", "o_orderpriority")
    return sa.union_versions({"v1996": a, "v1997": b})


@query("key_set_diff", """
with a as (select distinct o_orderkey as k from orders where o_orderstatus <> 'P'), b as (select distinct l_orderkey as k from lineitem)
select k as key, 'left only' as side from a where k not in (select k from b) union all select k, 'right only' from b where k not in (select k from a)""")
def _(t):
    a = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"))
    return sa.key_set_diff(a, t.lineitem.select(F.col("l_orderkey").alias("key")), "key")


@query("key_intersection", "select l_partkey from lineitem where year(l_shipdate) = 1996 intersect select l_partkey from lineitem where year(l_shipdate) = 1997")
def _(t):
    year = lambda y: t.lineitem.filter(F.year("l_shipdate") == y)
    return sa.key_intersection(year(1996), year(1997), "l_partkey")


def _altered(t):
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    key = F.col("o_orderkey")
    return o, t.orders.filter("o_orderpriority <> '3-MEDIUM'").select(
        "o_orderkey",
        F.when(key % 5 == 0, F.col("o_totalprice") + 0.00001).when(key % 7 == 0, F.col("o_totalprice") + 2).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))


_ALTERED = """
a as (select o_orderkey, o_totalprice, o_orderstatus from orders),
b as (select o_orderkey, case when o_orderkey % 5 = 0 then o_totalprice + 0.00001::double when o_orderkey % 7 = 0 then o_totalprice + 2 else o_totalprice end as o_totalprice,
  case when o_orderkey % 11 <> 0 then o_orderstatus end as o_orderstatus from orders where o_orderpriority <> '3-MEDIUM'),
j as (select a.o_orderkey, a.o_totalprice as ap, b.o_totalprice as bp, a.o_orderstatus as a_s, b.o_orderstatus as b_s, b.o_orderkey is null as gone from a left join b using (o_orderkey)),
d as (select o_orderkey, 'o_totalprice' as "column", round_even(abs(ap - bp), 6) as delta from j where not gone and abs(ap - bp) > 0.001
 union all select o_orderkey, 'o_orderstatus', null from j where not gone and a_s is distinct from b_s union all select o_orderkey, '(row)', null from j where gone)"""


@query("table_diff", f'with {_ALTERED} select o_orderkey, "column", delta from d')
def _(t):
    a, b = _altered(t)
    d = sa.table_diff(a, b, ["o_orderkey"], ["o_totalprice", "o_orderstatus"], 0.001)
    return d.select("o_orderkey", "column", r6("delta").alias("delta"))


@query("table_diff_summary", f'with {_ALTERED} select "column", count(*) as n_changed, max(delta) as max_delta from d group by 1')
def _(t):
    a, b = _altered(t)
    d = sa.diff_summary(sa.table_diff(a, b, ["o_orderkey"], ["o_totalprice", "o_orderstatus"], 0.001))
    return d.withColumn("max_delta", r6("max_delta"))


@query("stratified_split", """
with r as (select doc_id, lang, row_number() over (partition by lang order by md5('42|' || doc_id), doc_id) as k, count(*) over (partition by lang) as n from documents)
select doc_id, lang, case when k <= greatest(1, cast(round_even(n * 0.2::double, 0) as bigint)) then 'test' else 'train' end as split from r""")
def _(t):
    return sa.stratified_split(t.documents.select("doc_id", "lang"), "lang", "doc_id", 0.2, 42)


@query("stratified_folds", """
select vec_id, label, cast((row_number() over (partition by label order by md5('42|' || vec_id), vec_id) - 1) % 5 as integer) as fold from embeddings""")
def _(t):
    return sa.stratified_folds(t.embeddings.select("vec_id", "label"), "label", "vec_id", 5, 42)


@query("capped_sample", """
with r as (select doc_id, lang, row_number() over (partition by lang order by md5('7|' || doc_id), doc_id) as k, count(*) over (partition by lang) as n from documents)
select doc_id, lang, n > 120 as capped from r where k <= 120""")
def _(t):
    return sa.capped_sample(t.documents.select("doc_id", "lang"), "lang", "doc_id", 120, 7)


@query("hash_sample_n", "select doc_id, cast(row_number() over (order by md5('42|' || doc_id), doc_id) as integer) as k from documents qualify k <= 60")
def _(t):
    return sa.hash_sample_n(t.documents.select("doc_id"), "doc_id", 60, 42)


@query("hash_sample_per_group", "select doc_id, lang, cast(row_number() over (partition by lang order by md5('42|' || doc_id), doc_id) as integer) as k from documents qualify k <= 5")
def _(t):
    return sa.hash_sample_n(t.documents.select("doc_id", "lang"), "doc_id", 5, 42, "lang")


@query("quota_sample", """
with b as (select doc_id, source, lang, md5('42|' || doc_id) as h from documents),
q1 as (select source, arg_min(doc_id, h) as doc_id, min(h) as h from b where lang = 'fr' group by 1 order by h limit 4),
q2 as (select source, arg_min(doc_id, h) as doc_id, min(h) as h from b where lang = 'de' and source not in (select source from q1) group by 1 order by h limit 3),
q3 as (select source, arg_min(doc_id, h) as doc_id from b where source not in (select source from q1 union all select source from q2) group by 1),
p as (select source, doc_id, 'french, required' as why from q1 union all select source, doc_id, 'german, required' from q2 union all select source, doc_id, 'one per class' from q3),
x as (select source, doc_id, 'extra' as why, row_number() over (order by h, doc_id) as k from b where doc_id not in (select doc_id from p))
select source, doc_id, why from p union all select source, doc_id, why from x where k <= 30 - (select count(*) from p)""")
def _(t):
    docs = t.documents.select("doc_id", "source", "lang")
    quotas = [(F.col("lang") == "fr", 4, "french, required"), (F.col("lang") == "de", 3, "german, required")]
    return sa.quota_sample(docs, "source", "doc_id", quotas, 30, 42)


@query("ratings_carry_over", """
with s as (select doc_id from documents order by md5('42|' || doc_id), doc_id limit 60)
select doc_id, coalesce(case quality when 1 then 'good' when 0 then 'bad' end, '') as rating from s left join labels using (doc_id)""")
def _(t):
    template = sa.hash_sample_n(t.documents.select("doc_id"), "doc_id", 60, 42).select("doc_id")
    earlier = t.labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("rating"))
    return sa.ratings_carry_over(template, earlier, "doc_id", ["rating"])

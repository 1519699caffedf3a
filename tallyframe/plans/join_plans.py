"""Joins bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as jn
from .registry import query


@query("enrich_left", "select o_orderkey, c_name, c_mktsegment from orders left join (select * from customer where c_acctbal > 2000) on o_custkey = c_custkey")
def _(t):
    cust = t.customer.filter("c_acctbal > 2000").withColumnRenamed("c_custkey", "o_custkey")
    return jn.enrich_left(t.orders.select("o_orderkey", "o_custkey"), cust, ["o_custkey"], ["c_name", "c_mktsegment"]).drop("o_custkey")


@query("enrich_inner", "select l_orderkey, l_linenumber, p_brand, l_quantity from lineitem join part on l_partkey = p_partkey where p_size > 25")
def _(t):
    part = t.part.filter("p_size > 25").withColumnRenamed("p_partkey", "l_partkey")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return jn.enrich_inner(lines, part, ["l_partkey"], ["p_brand"]).drop("l_partkey")


@query("join_one_to_one", """
with l as (select doc_id, quality from labels), d as (select doc_id from documents where lang <> 'de' union all select doc_id from documents where lang = 'es'),
a as (select doc_id, count(*) as n_left from d group by 1), b as (select doc_id, count(*) as n_right from l group by 1)
select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(n_left, 0) as n_left, coalesce(n_right, 0) as n_right,
 case when coalesce(n_left, 0) > 1 then 'duplicate left' when coalesce(n_right, 0) > 1 then 'duplicate right' when n_right is null then 'missing right' else 'missing left' end as problem
from a full join b on a.doc_id = b.doc_id where coalesce(n_left, 0) <> 1 or coalesce(n_right, 0) <> 1""")
def _(t):
    docs = t.documents.select("doc_id", "lang")
    left = docs.filter("lang <> 'de'").unionByName(docs.filter("lang = 'es'")).select("doc_id")
    return jn.one_to_one_violations(left, t.labels.select("doc_id"), "doc_id")


@query("join_one_to_one_checked", "select d.doc_id, l.quality, l.toxic from documents d left join labels l using (doc_id)")
def _(t):
    return jn.join_one_to_one(t.documents.select("doc_id"), t.labels, "doc_id")


@query("align_by_key", """
select vec_id, label, vec_id = case when vec_id % 10 = 3 then vec_id + 1 else vec_id end as in_step from embeddings""")
def _(t):
    left = t.embeddings.select("vec_id", "label", F.col("vec_id").alias("row_a"))
    right = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 10 == 3, F.col("vec_id") + 1).otherwise(F.col("vec_id")).alias("row_b"))
    return jn.align_by_key(left, right, "vec_id", "row_a", "row_b").select("vec_id", "label", "in_step")


@query("keep_present", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def _(t):
    keys = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return jn.keep_present(t.customer.select("c_custkey", "c_name"), keys, ["c_custkey"])


@query("keep_pending", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def _(t):
    keys = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return jn.keep_pending(t.customer.select("c_custkey", "c_name"), keys, ["c_custkey"])


@query("class_parent_lookup", """
select s_suppkey, s_nationkey, case when n_name like '%2' then 'OVERRIDE' when r_name <> 'ASIA' then r_name end as parent
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def _(t):
    first = t.nation.join(t.region.filter("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("parent"))
    second = t.nation.filter("n_name like '%2'").select(F.col("n_nationkey").alias("s_nationkey"), F.lit("OVERRIDE").alias("parent"))
    return jn.class_parent_lookup(t.supplier.select("s_suppkey", "s_nationkey"), "s_nationkey", first, second, "parent")


def _match_inputs(t):
    # wanted: supplier codes with a view; titles: every line names a supplier code, a view, a shot and a part
    items = t.supplier.select("s_suppkey", F.concat(F.lit("SUP"), F.col("s_suppkey").cast("string")).alias("code_text"),
                              F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("R").alias("view_wanted"))
    titles = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("sup"), F.col("l_suppkey").cast("string")).alias("code"), F.col("l_returnflag").alias("view"),
        F.col("l_linenumber").alias("shot"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"))
    return items, titles


_MATCH = """
c as (select s_suppkey, l_linenumber as shot, p_name || ' ' || p_partkey as title from supplier join lineitem on l_suppkey = s_suppkey
  and l_returnflag = case when s_suppkey % 2 = 0 then 'A' else 'R' end join part on l_partkey = p_partkey),
r as (select *, row_number() over (partition by s_suppkey order by shot, title) as rank, count(*) over (partition by s_suppkey) as n_candidates from c)"""


@query("best_candidate", f"with {_MATCH} select s_suppkey, shot, title, n_candidates from r where rank = 1")
def _(t):
    items, titles = _match_inputs(t)
    return jn.best_candidate(items, titles, "code_text", "view_wanted").select("s_suppkey", "shot", "title", "n_candidates")


@query("ranked_candidates", f"with {_MATCH} select s_suppkey, shot, title, rank from r")
def _(t):
    items, titles = _match_inputs(t)
    return jn.candidates(items, titles, "code_text", "view_wanted").select("s_suppkey", "shot", "title", "rank")


@query("first_confirmed_candidate", """
with e as (select l_orderkey, l_linenumber * 1000000 + l_partkey as rank, case when l_returnflag = 'A' then 'exact' when l_returnflag = 'R' and l_tax > 0.04 then 'visual_match' else 'unconfirmed' end as conf, l_suppkey from lineitem),
r as (select *, row_number() over (partition by l_orderkey order by conf = 'unconfirmed', rank, l_suppkey, conf) as k, count(*) over (partition by l_orderkey) as n_candidates from e)
select l_orderkey, rank as candidate_rank, conf as match_confidence, l_suppkey, n_candidates from r where k = 1""")
def _(t):
    conf = F.when(F.col("l_returnflag") == "A", "exact").when((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.04), "visual_match").otherwise("unconfirmed")
    e = t.lineitem.select("l_orderkey", (F.col("l_linenumber") * F.lit(1000000) + F.col("l_partkey")).alias("rank"), conf.alias("conf"), "l_suppkey")
    return jn.first_confirmed_candidate(e, ["l_orderkey"], "rank", "conf", ["l_suppkey"])


@query("paired_outcomes", """
with y as (select o_custkey, year(o_orderdate) as y, count(*) as n from orders group by all)
select o_custkey, max(n) filter (y = 1996) as y1996, max(n) filter (y = 1997) as y1997, max(n) filter (y = 1998) as y1998,
  max(n) filter (y = 1996) - max(n) filter (y = 1997) as drop_y1997, max(n) filter (y = 1996) - max(n) filter (y = 1998) as drop_y1998 from y group by 1""")
def _(t):
    o = t.orders.select("o_custkey", F.concat(F.lit("y"), F.year("o_orderdate").cast("string")).alias("y"))
    n = F.count(F.lit(1))
    return jn.paired_outcomes(o, ["o_custkey"], "y", ["y1996", "y1997", "y1998"], F.when(n > 0, n), "y1996")


@query("upsert_runs", """
with old as (select c_custkey, c_name, c_acctbal from customer where c_mktsegment <> 'BUILDING'),
fresh as (select c_custkey, 'new ' || c_name as c_name, case when c_mktsegment = 'MACHINERY' then null else c_acctbal + 1 end as c_acctbal from customer where c_acctbal > 4000)
select coalesce(f.c_custkey, o.c_custkey) as c_custkey, case when f.c_custkey is not null then f.c_name else o.c_name end as c_name, case when f.c_custkey is not null then f.c_acctbal else o.c_acctbal end as c_acctbal,
 case when f.c_custkey is null then 'kept' when o.c_custkey is null then 'added' else 'replaced' end as state from old o full join fresh f on o.c_custkey = f.c_custkey""")
def _(t):
    cols = ["c_custkey", "c_name", "c_acctbal"]
    old = t.customer.filter("c_mktsegment <> 'BUILDING'").select(*cols)
    fresh = t.customer.filter("c_acctbal > 4000").select(
        "c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal") + 1).alias("c_acctbal"))
    return jn.upsert(old, fresh, ["c_custkey"])


@query("upsert_same_address", """
select o_orderkey, case when o_orderpriority <> '1-URGENT' and o_totalprice <= 300000 then o_orderstatus else 'unknown' end as outcome from orders""")
def _(t):
    prev = t.orders.filter("o_orderpriority <> '1-URGENT'").select("o_orderkey", F.col("o_orderpriority").alias("url"), F.col("o_orderstatus").alias("outcome"))
    url = F.when(F.col("o_totalprice") > 300000, "changed").otherwise(F.col("o_orderpriority"))
    now = t.orders.select("o_orderkey", url.alias("url"))
    return jn.keep_outcome_if_same(prev, now, "o_orderkey", "url", ["outcome"], {"outcome": "unknown"}).select("o_orderkey", "outcome")

"""Group-by reports bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import r6
from ..operators import aggregates as ag
from .evaluation_base import FIXTURE, scored
from .registry import query
from .scalar_plans import LINE_FLAGS_SQL, line_flags


@query("facet_counts", "select c_nationkey, n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by all")
def _(t):
    names = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return ag.facet_counts(t.customer, "c_nationkey", names).orderBy(F.desc("n"), "c_nationkey")


@query("facet_thresholds", """
with c as (select c_nationkey, count(*) as n from customer group by 1)
select count(*) filter (n >= 10) as ge_10, count(*) filter (n >= 60) as ge_60, count(*) filter (n >= 600) as ge_600 from c""")
def _(t):
    return ag.at_least(ag.facet_counts(t.customer, "c_nationkey"), "n", [10, 60, 600])


def _order_facts(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return o.select(
        "c_mktsegment", "o_orderpriority", "o_orderstatus", "o_totalprice", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("place"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("name"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("c_acctbal")).alias("coord"),
        F.when(F.col("o_orderkey") % 11 != 0, F.year("o_orderdate")).alias("year"))


_FACTS = """
f as (select c_mktsegment, o_orderpriority, o_orderstatus, o_totalprice, case when n_nationkey % 5 <> 0 then n_name end as place, case when o_orderkey % 9 <> 0 then o_orderpriority end as name,
  case when o_orderkey % 4 <> 0 then c_acctbal end as coord, case when o_orderkey % 11 <> 0 then year(o_orderdate) end as year
  from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey)"""


@query("group_profile", f"""
with {_FACTS}
select c_mktsegment, count(*) as n_rows, count(distinct name) filter (o_orderstatus in ('F', 'O')) as n_named, count(*) - count(name) as n_unnamed,
  count(distinct place) as n_places, string_agg(distinct place, ';' order by place) as places, count(coord) as n_with_coords,
  cast(round_even(min(o_totalprice), 0) as bigint) as measure_min, cast(round_even(median(o_totalprice), 0) as bigint) as measure_median, cast(round_even(max(o_totalprice), 0) as bigint) as measure_max,
  min(year) as year_min, max(year) as year_max, count(*) - count(year) as n_without_year from f group by 1""")
def _(t):
    return ag.group_profile(_order_facts(t), "c_mktsegment", "name", F.col("o_orderstatus").isin("F", "O"), "place", "coord", "o_totalprice", "year")


@query("place_profile", f"""
with {_FACTS}, p as (select coalesce(place, '(none)') as place, * exclude (place) from f),
c as (select place, o_orderpriority, count(*) as n, row_number() over (partition by place order by count(*) desc, o_orderpriority) as r from p group by 1, 2)
select p.place, count(*) as n_rows, count(distinct o_orderpriority) as n_classes, count(distinct name) filter (o_orderstatus = 'F') as n_named,
  (select string_agg(o_orderpriority || ' ' || n, ';' order by r) from c where c.place = p.place and r <= 3) as top_classes from p group by p.place""")
def _(t):
    return ag.place_profile(_order_facts(t), "place", "o_orderpriority", "name", F.col("o_orderstatus") == "F", top=3)


@query("locality_top", """
with x as (select p_name, p_brand, p_type, l_quantity, l_extendedprice, case when l_discount > 0.02 then l_discount end as d from lineitem join part on l_partkey = p_partkey),
g as (select p_name, count(*) as n_rows, count(distinct p_brand) as n_classes, string_agg(distinct p_type, ';' order by p_type) as places,
 median(l_quantity) as qm, median(l_extendedprice) as em, median(d) as dm from x group by 1)
select p_name, n_rows, n_classes, places, round_even(qm, 5) as l_quantity_median, round_even(em, 5) as l_extendedprice_median, round_even(dm, 5) as d_median from g order by n_rows desc, n_classes desc, p_name limit 20""")
def _(t):
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "p_name", "p_brand", "p_type", "l_quantity", "l_extendedprice", F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("d"))
    out = ag.locality_top(x, "p_name", "p_brand", "p_type", ["l_quantity", "l_extendedprice", "d"], n=20)
    return out.select("p_name", "n_rows", "n_classes", "places", *[r6(f"{m}_median", 5).alias(f"{m}_median") for m in ("l_quantity", "l_extendedprice", "d")])


@query("coverage_gaps", f"""
with {_FACTS}, k as (select *, case when o_orderpriority = '1-URGENT' and place is not null then 'NATION_1' else place end as pl from f),
c as (select o_orderpriority, count(*) as n, count(distinct pl) as np, count(coord) as nc from k group by 1)
select 'rows_per_place' as section, pl as key, count(*) as n from k where pl is not null group by 2
union all select 'classes_per_place', pl, count(distinct o_orderpriority) from k where pl is not null group by 2
union all select 'rows_per_decade', cast(year // 10 * 10 as varchar), count(*) from k where year is not null group by 2
union all select 'single_place_classes', o_orderpriority, n from c where np <= 1
union all select 'without_coords', o_orderpriority, n - nc from c where n > nc""")
def _(t):
    f = _order_facts(t)
    place = F.when((F.col("o_orderpriority") == "1-URGENT") & F.col("place").isNotNull(), "NATION_1").otherwise(F.col("place"))
    return ag.coverage_gaps(f.withColumn("place", place), "o_orderpriority", "place", "year", "coord")


@query("merged_keys_audit", "select p_name, count(distinct p_brand) as n_keys, string_agg(distinct p_brand, ';' order by p_brand) as keys from part group by 1 having count(distinct p_brand) > 1")
def _(t):
    return ag.merged_keys_audit(t.part, "p_name", "p_brand")


@query("counts_of_counts", "with c as (select l_orderkey, count(*) as n_items from lineitem group by 1) select n_items, count(*) as n_records from c group by 1")
def _(t):
    return ag.counts_of_counts(t.lineitem, "l_orderkey")


@query("items_per_record", "with c as (select l_orderkey, count(*) as n from lineitem group by 1) select count(*) as n_records, round_even(avg(n), 6) as mean_items, max(n) as max_items from c")
def _(t):
    s = ag.count_summary(t.lineitem, "l_orderkey")
    return s.select("n_records", r6("mean_items").alias("mean_items"), "max_items")


@query("nested_counts", """
select count(*) as all_rows, count(*) filter (o_orderstatus = 'F') as finished, count(*) filter (o_orderstatus = 'F' and o_totalprice > 200000) as large,
 count(*) filter (o_orderstatus = 'F' and o_totalprice > 200000 and o_orderpriority = '1-URGENT') as urgent,
 count(*) filter (o_orderstatus = 'F' and o_totalprice > 200000 and o_orderpriority = '1-URGENT') <= 1000 as within_guard from orders""")
def _(t):
    return ag.nested_counts(t.orders, {"finished": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 200000,
                                       "urgent": F.col("o_orderpriority") == "1-URGENT"}, guard=1000)


@query("non_null_share", "select round_even(count(quality) / count(*), 6) as share_quality, round_even(count(toxic) / count(*), 6) as share_toxic from documents left join labels using (doc_id)")
def _(t):
    s = ag.non_null_share(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), ["quality", "toxic"])
    return s.select(r6("share_quality").alias("share_quality"), r6("share_toxic").alias("share_toxic"))


_KNOWN = ["empty", "large", "frame_filling", "no_scale", "small"]


@query("flag_counts", f"""
with f as (select {LINE_FLAGS_SQL} as f from lineitem), k as (select unnest(['empty','large','frame_filling','no_scale','small']) as flag)
select flag, count(f) as n from k left join f on list_contains(string_split(f, ';'), flag) group by 1""")
def _(t):
    return ag.flag_counts(t.lineitem.select(line_flags().alias("flags")), "flags", _KNOWN)


@query("candidate_rollup", """
select l_orderkey, count(*) filter (l_returnflag = 'A' and l_tax > 0.03) as card_regions, coalesce(sum(l_quantity) filter (l_returnflag = 'A' and l_tax > 0.03), 0) as card_size,
 count(*) filter (l_returnflag = 'R' and l_tax > 0.03) as pin_regions, coalesce(sum(l_quantity) filter (l_returnflag = 'R' and l_tax > 0.03), 0) as pin_size,
 coalesce(sum(l_quantity) filter (l_tax <= 0.03), 0) as rejected_size, round_even(coalesce(sum(l_discount) filter (l_tax > 0.03), 0), 6) as grown_size,
 round_even(coalesce(sum(l_quantity) filter (l_tax > 0.03), 0) / max(o_totalprice), 4) as removed_share
from (select lineitem.*, o_totalprice, case l_returnflag when 'N' then 'R' else l_returnflag end as k from lineitem join orders on l_orderkey = o_orderkey where l_returnflag <> 'N') group by 1""")
def _(t):
    x = t.lineitem.filter("l_returnflag <> 'N'").join(t.orders.select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.withColumn("kind", F.when(F.col("l_returnflag") == "A", "card").otherwise("pin"))
    out = ag.candidate_rollup(x, "l_orderkey", "kind", ["card", "pin"], F.col("l_tax") > 0.03, "l_quantity", "l_discount", "o_totalprice")
    return out.withColumn("grown_size", r6("grown_size")).withColumn("removed_share", r6("removed_share", 4))


@query("value_distribution", """
with v as (select case when p_partkey % 13 = 0 then null when p_partkey % 13 = 1 then '' else p_type end as v from part)
select coalesce(case when v = '' then '?' else v end, '(none)') as value, count(*) as n from v group by 1""")
def _(t):
    v = F.when(F.col("p_partkey") % 13 == 0, F.lit(None)).when(F.col("p_partkey") % 13 == 1, "").otherwise(F.col("p_type"))
    return ag.value_distribution(t.part.select(v.alias("v")), "v")


@query("value_distribution_top", "select o_orderpriority as value, count(*) as n from orders group by 1 order by n desc, value limit 3")
def _(t):
    return ag.value_distribution(t.orders, "o_orderpriority", top=3)


@query("set_coverage", """
with s as (select l_orderkey, bool_or(l_returnflag = 'A') as a, bool_or(l_returnflag = 'R') as b from lineitem group by 1)
select case when a then 'has A' when b then 'R only' else 'neither' end as coverage, count(*) as n from s group by 1""")
def _(t):
    return ag.set_coverage(t.lineitem, "l_orderkey", "l_returnflag", "A", "R")


@query("category_drop_table", """
with c as (select p_brand, case when p_partkey % 7 = 0 then 'dropped: null' when lower(p_type) in ('economy', 'small') then 'kept (economy/small)' else 'dropped: ' || lower(p_type) end as category from part),
g as (select p_brand, category, count(*) as n from c group by all)
select p_brand, category, n, cast(sum(n) over (partition by p_brand) as bigint) as total from g""")
def _(t):
    v = F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit(" "), "p_type"))
    return ag.category_drop_table(t.part, "p_brand", v, ["economy", "small"])


@query("split_pivot", """
select source, count(*) filter (lang = 'en') as en, count(*) filter (lang = 'fr') as fr, count(*) filter (lang in ('en', 'fr')) as total from documents group by 1""")
def _(t):
    return ag.split_pivot(t.documents, "source", "lang", ["en", "fr"])


@query("split_pivot_three_keys", """
select lang, source, quality, count(*) filter (doc_id % 5 = 0) as test, count(*) filter (doc_id % 5 <> 0) as train, count(*) as total
from documents join labels using (doc_id) group by all""")
def _(t):
    d = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id")
    out = ag.split_pivot(d.withColumn("key", F.struct("lang", "source", "quality")).withColumn(
        "split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")), "key", "split", ["test", "train"])
    return out.select("key.lang", "key.source", "key.quality", "test", "train", "total")


_CROSS = """
x as (select lang, source, count(*) as n from documents group by all),
c as (select *, cast(sum(n) over (partition by lang) as bigint) as row_total, cast(sum(n) over (partition by source) as bigint) as col_total from x),
k as (select source, cast(row_number() over (order by sum(n) desc, source) as integer) as col_rank from x group by 1)"""


@query("crosstab_counts", f"with {_CROSS} select lang, source, n, row_total, col_total, col_rank from c join k using (source)")
def _(t):
    return ag.crosstab_counts(t.documents, "lang", "source")


@query("crosstab_rowpct", f"with {_CROSS} select lang, source, row_total as n, round_even(n * 100.0::double / row_total, 1) as pct from c")
def _(t):
    return ag.crosstab_rowpct(t.documents, "lang", "source")


@query("dominant_value", """
with c as (select p_name, case when p_partkey % 10 < 8 or starts_with(p_name, 'red') then 'main' else p_brand end as who, count(*) as n from part group by all),
s as (select *, cast(sum(n) over (partition by p_name) as bigint) as total, row_number() over (partition by p_name order by n desc, who) as r from c)
select p_name, total as n, who as top_value, round_even(n * 100.0::double / total, 1) as top_share_pct from s where r = 1 and round_even(n * 100.0::double / total, 1) >= 90""")
def _(t):
    who = F.when((F.col("p_partkey") % 10 < 8) | F.col("p_name").startswith("red"), "main").otherwise(F.col("p_brand"))
    return ag.dominant_value(t.part.select("p_name", who.alias("who")), "p_name", "who")


@query("flag_fraction", """
select lang, count(*) as n, count(*) filter (toxic = 1) as n_flag, count(*) filter (quality = 1) as good, count(*) filter (quality = 0) as poor,
 round_even(count(*) filter (toxic = 1) / count(*), 3) as flag_frac from documents join labels using (doc_id) group by 1""")
def _(t):
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return ag.flag_fraction(d, "lang", F.col("toxic") == 1, {"good": F.col("quality") == 1, "poor": F.col("quality") == 0})


@query("group_medians", "select p_brand, count(*) as n, round_even(median(p_retailprice), 4) as p_retailprice_median, round_even(median(p_size), 4) as p_size_median from part group by 1")
def _(t):
    return ag.group_medians(t.part, "p_brand", ["p_retailprice", "p_size"])


@query("funnel", """
with s as (select l_orderkey, l_partkey, l_returnflag in ('A', 'R') as a, l_returnflag in ('A', 'R') and l_quantity > 10 as b, l_returnflag in ('A', 'R') and l_quantity > 10 and l_tax < 0.05 as c from lineitem)
select 0::integer as step, 'harvested' as stage, count(*) as n_rows, count(distinct l_orderkey) as n_records, count(distinct l_partkey) as n_items, 1.0::double as share from s
union all select 1, 'views', count(*), count(distinct l_orderkey), count(distinct l_partkey), round_even(count(*) / (select count(*) from s), 6) from s where a
union all select 2, 'classes', count(*), count(distinct l_orderkey), count(distinct l_partkey), round_even(count(*) / (select count(*) from s), 6) from s where b
union all select 3, 'available', count(*), count(distinct l_orderkey), count(distinct l_partkey), round_even(count(*) / (select count(*) from s), 6) from s where c""")
def _(t):
    stages = {"harvested": F.lit(True), "views": F.col("l_returnflag").isin("A", "R"), "classes": F.col("l_quantity") > 10, "available": F.col("l_tax") < 0.05}
    return ag.funnel(t.lineitem, stages, "l_orderkey", "l_partkey").withColumn("share", r6("share"))


@query("dropped_classes", """
select p_name, count(distinct p_partkey) filter (p_size > 30) as obtained, count(distinct p_partkey) as targeted from part group by 1
having count(distinct p_partkey) filter (p_size > 30) < 10""")
def _(t):
    return ag.dropped_classes(t.part, "p_name", F.col("p_size") > 30, "p_partkey", 10)


@query("failure_rates", "select strftime(ts, '%Y-%m-%d') as key, count(*) as n_rows, count(*) filter (event_type = 'error') as n_failed, round_even(count(*) filter (event_type = 'error') / count(*), 6) as rate from events group by 1")
def _(t):
    r = ag.failure_rates(t.events, F.to_date("ts").cast("string"), F.col("event_type") == "error")
    return r.withColumn("rate", r6("rate"))


@query("failure_rates_by_user", "select user_id as key, count(*) as n_rows, count(*) filter (event_type = 'error' and value > 50) as n_failed, round_even(count(*) filter (event_type = 'error' and value > 50) / count(*), 6) as rate from events group by 1 having n_failed > 0")
def _(t):
    r = ag.failure_rates(t.events, F.col("user_id"), (F.col("event_type") == "error") & (F.col("value") > 50), only_failed=True)
    return r.withColumn("rate", r6("rate"))


@query("error_pairs", f"with {FIXTURE} select truth, pred, count(*) as n from s where truth <> pred group by all order by n desc, truth, pred limit 12")
def _(t):
    return ag.error_pairs(scored(t), "truth", "pred", 12)


@query("errors_to", f"""
with {FIXTURE}, e as (select truth, pred, count(*) as n from s where truth <> pred group by all),
c as (select *, row_number() over (partition by truth order by n desc, pred) as r from e)
select truth, string_agg(pred || ' ' || n, '; ' order by r) as errors_to from c where r <= 3 group by 1""")
def _(t):
    return ag.errors_to(scored(t), "truth", "pred")


@query("quantile_profile", """
with q as (select p_brand, unnest([0.0, 0.01, 0.05, 0.5, 0.95, 1.0]::double[]) as prob, unnest(quantile_cont(p_retailprice, [0.0, 0.01, 0.05, 0.5, 0.95, 1.0])) as value from part group by 1),
s as (select p_brand, count(*) as n, avg(p_retailprice) as mean, min(p_retailprice) as min, max(p_retailprice) as max, count(*) filter (p_retailprice < 920) as below_920, count(*) filter (p_retailprice < 950.5) as below_950_5 from part group by 1)
select p_brand, prob, round_even(value, 6) as value, n, round_even(mean, 6) as mean, min, max, below_920, below_950_5 from q join s using (p_brand)""")
def _(t):
    q = ag.quantile_profile(t.part, "p_brand", "p_retailprice", [0.0, 0.01, 0.05, 0.5, 0.95, 1.0], [920, 950.5])
    return q.withColumn("value", r6("value")).withColumn("mean", r6("mean"))

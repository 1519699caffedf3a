"""Filters and rules bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import r6
from ..operators import rules as ru
from .registry import query


@query("allow_list_filter", "select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def _(t):
    return ru.allow_list(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("min_group_size", """
with g as (select p_brand, count(distinct l_orderkey) as n from part join lineitem on p_partkey = l_partkey group by 1)
select p_partkey, p_brand from part join g using (p_brand) where n >= (select count(*) // 26 from lineitem)""")
def _(t):
    minimum = t.lineitem.count() // 26
    pairs = t.part.select("p_partkey", "p_brand").join(t.lineitem.select("l_partkey", "l_orderkey"), F.col("p_partkey") == F.col("l_partkey"))
    kept = ru.group_sizes(pairs, "p_brand", "l_orderkey", minimum).filter("kept").select("p_brand")
    return t.part.select("p_partkey", "p_brand").join(kept, "p_brand", "left_semi")


@query("min_group_report", """
select p_brand, count(distinct p_partkey) as n_ids, count(distinct p_partkey) >= (select count(*) // 25 from part) as kept from part group by 1""")
def _(t):
    return ru.group_sizes(t.part, "p_brand", "p_partkey", t.part.count() // 25)


@query("complete_rows", """
select count(*) as n_rows, count(quality) as n_complete, count(*) - count(quality) as n_dropped, count(*) - count(quality) as null_quality, count(*) - count(toxic) as null_toxic
from documents left join labels using (doc_id)""")
def _(t):
    return ru.count_incomplete(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), ["quality", "toxic"])


def line_rules(t):
    qty, price, disc = "l_quantity", "l_extendedprice", "l_discount"
    white = [("quantity", qty, 20.0, ">="), ("price", price, 30000.0, ">="), ("discount", disc, 0.05, "<=")]
    cream = [("quantity", qty, 30.0, ">="), ("price", price, F.greatest(F.lit(20000.0), F.col(qty) * 900), ">="), ("tax", "l_tax", 0.04, "<=")]
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", qty, price, disc, "l_tax", "l_returnflag")
    return ru.rule_check(lines, [("white", F.col("l_returnflag") == "A", white), ("cream", F.lit(True), cream)])


_RULES = """
t as (select l_orderkey, l_partkey, l_linenumber, case when l_returnflag = 'A' then 'white' else 'cream' end as tier,
  unnest(case when l_returnflag = 'A' then [{'test': 'quantity', 'value': l_quantity, 'threshold': 20.0::double, 'op': '>='},
     {'test': 'price', 'value': l_extendedprice, 'threshold': 30000.0::double, 'op': '>='}, {'test': 'discount', 'value': l_discount, 'threshold': 0.05::double, 'op': '<='}]
   else [{'test': 'quantity', 'value': l_quantity, 'threshold': 30.0::double, 'op': '>='},
     {'test': 'price', 'value': l_extendedprice, 'threshold': greatest(20000.0::double, l_quantity * 900), 'op': '>='}, {'test': 'tax', 'value': l_tax, 'threshold': 0.04::double, 'op': '<='}] end) as c, rn
  from (select *, row_number() over () as rn from lineitem)),
c as (select *, c.test as test, c.value as value, c.threshold as threshold, c.op as op, case when c.op = '>=' then c.value >= c.threshold else c.value <= c.threshold end as passed,
  abs(c.value - c.threshold) / c.threshold as rel from t),
f as (select rn, count(*) filter (not passed) as n_failed, coalesce(string_agg(test, ',' order by case test when 'quantity' then 1 when 'price' then 2 else 3 end) filter (not passed), '') as failed from c group by rn)"""


@query("rule_check", f"""
with {_RULES}
select distinct on (rn) l_orderkey, l_partkey, l_linenumber, tier, n_failed = 0 as accepted, failed from c join f using (rn)""")
def _(t):
    return line_rules(t).select("l_orderkey", "l_partkey", "l_linenumber", "tier", "accepted", "failed")


@query("rule_margins", f"""
with {_RULES}
select l_orderkey, l_partkey, tier, test, op, value, threshold, round_even(rel, 9) as rel_distance, n_failed = 0 as accepted, n_failed = 0 or failed = test as decisive
from c join f using (rn) where rel <= 0.1""")
def _(t):
    m = ru.rule_margins(line_rules(t), ["l_orderkey", "l_partkey"])
    return m.select("l_orderkey", "l_partkey", "tier", "test", "op", "value", "threshold", r6("rel_distance", 9).alias("rel_distance"), "accepted", "decisive")


@query("facet_search", """
select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey
where r_name = 'ASIA' and (contains(lower(n_name), '2') or contains(lower(r_name), '2'))""")
def _(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return ru.facet_search(places, "r_name", "ASIA", " 2 ", ["n_name", "r_name"]).orderBy("r_name", "n_name")


@query("suffix_record_check", """
with r as (select l_partkey, 'C' || l_orderkey || '_' || l_linenumber || case l_returnflag when 'A' then '-p1' when 'R' then '-D' || l_linenumber else '' end as raw from lineitem),
c as (select regexp_replace(raw, '-[hdpl][0-9]+$', '', 'i') as code, raw, l_partkey from r),
g as (select code, count(distinct l_partkey) as n_records, count(*) as n_items, count(*) filter (raw <> code) as n_suffixed from c group by 1)
select *, case when n_records > 1 and n_suffixed > 0 then 'one record per view' when n_records = 1 then 'one record with all items' else 'inconclusive' end as verdict from g""")
def _(t):
    suffix = F.when(F.col("l_returnflag") == "A", "-p1").when(F.col("l_returnflag") == "R", F.concat(F.lit("-D"), F.col("l_linenumber").cast("string"))).otherwise("")
    raw = F.concat(F.lit("C"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), suffix)
    return ru.suffix_record_check(t.lineitem.select("l_partkey", raw.alias("raw")), "raw", "l_partkey")

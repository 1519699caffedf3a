"""The flagship query, end to end: items of records -> recode -> allow list -> one per key ->
minimum class size -> reproducible split -> class x split table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.session import materialise
from ..functions.values import recode
from ..operators import aggregates as ag
from ..operators import rules as ru
from ..operators import sampling as sa
from ..operators import windows as wn
from .registry import query


def curated_rows(t) -> DataFrame:
    """One representative item per order, with its class."""
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    items = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey")
    rows = rows.withColumn("class", recode("o_orderpriority", {"4-NOT SPECIFIED": "5-LOW"}))
    rows = ru.allow_list(rows, "o_orderstatus", ["F", "O"])
    return wn.pick_one_per_key(rows, "o_orderkey", "l_returnflag", ["A", "R"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_shipdate")])


def curated_split(t, minimum: int = 10, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    rows = materialise(curated_rows(t))  # read by the class sizes, the filter and the split
    kept = ru.min_group_size(rows, "class", "o_orderkey", minimum)
    return sa.stratified_split(kept, "class", "o_orderkey", fraction, seed)


MANIFEST_SQL = """
j as (select o_orderkey, case o_orderpriority when '4-NOT SPECIFIED' then '5-LOW' else o_orderpriority end as class, l_returnflag, l_linenumber, l_partkey, l_suppkey, l_shipdate
  from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus in ('F', 'O') and l_returnflag in ('A', 'R')),
one as (select * from (select *, row_number() over (partition by o_orderkey order by l_returnflag, l_linenumber, l_partkey, l_suppkey, l_shipdate) as rn from j) where rn = 1),
kept as (select one.* from one join (select class from one group by class having count(distinct o_orderkey) >= 10) using (class)),
r as (select *, row_number() over (partition by class order by md5('42|' || o_orderkey), o_orderkey) as k, count(*) over (partition by class) as n from kept),
m as (select *, case when k <= greatest(1, cast(round_even(n * 0.2::double, 0) as bigint)) then 'test' else 'train' end as split from r)"""


@query("curated_manifest", f"""
with {MANIFEST_SQL}
select class, count(*) filter (split = 'train') as train, count(*) filter (split = 'test') as test, count(*) as total from m group by class""")
def _(t):
    return ag.split_pivot(curated_split(t), "class", "split", ["train", "test"])


@query("curated_manifest_rows", f"""
with {MANIFEST_SQL}
select o_orderkey, class, l_partkey, l_linenumber, split from m""")
def _(t):
    return curated_split(t).select("o_orderkey", "class", "l_partkey", "l_linenumber", "split")

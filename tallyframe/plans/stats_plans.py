"""Bands and statistics bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import r6
from ..operators import stats as st
from .evaluation_base import scored
from .registry import query


@query("quantile_bands", """
with e as (select quantile_cont(p_retailprice, [0.0, 0.25, 0.5, 0.75, 1.0]) as e from part),
b as (select p_partkey, e, case when p_retailprice <= e[2] then 1 when p_retailprice <= e[3] then 2 when p_retailprice <= e[4] then 3 else 4 end as i from part, e)
select p_partkey, 'B' || i || ' ' || cast(round_even(e[i], 0) as bigint) || '-' || cast(round_even(e[i + 1], 0) as bigint) as band from b""")
def _(t):
    return st.quantile_bands(t.part.select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "band")


@query("fixed_bands", """
select o_orderkey, case when o_totalprice < 1000 then null when o_totalprice < 50000 then '[1000, 50000)' when o_totalprice < 150000 then '[50000, 150000)' when o_totalprice < 300000 then '[150000, 300000)' end as band,
 case when o_totalprice < 100000 then 'low' when o_totalprice < 250000 then 'middle' else 'high' end as level from orders""")
def _(t):
    return t.orders.select("o_orderkey", st.fixed_bands("o_totalprice", [1000, 50000, 150000, 300000]).alias("band"),
                           st.three_way_band("o_totalprice", 100000, 250000, ("low", "middle", "high")).alias("level"))


@query("wilson_interval", """
with c as (select lang, sum(quality)::double as k, count(*)::double as n from documents join labels using (doc_id) group by 1),
w as (select *, k / n as p, 1.96::double * 1.96::double as z2 from c)
select lang, cast(n as bigint) as n, round_even((p + z2 / (2 * n)) / (1 + z2 / n) - 1.96::double * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 6) as ci_low,
 round_even((p + z2 / (2 * n)) / (1 + z2 / n) + 1.96::double * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 6) as ci_high from w""")
def _(t):
    c = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = st.wilson_interval("k", "n")
    return c.select("lang", "n", r6(lo).alias("ci_low"), r6(hi).alias("ci_high"))


@query("condition_accuracy", """
with d as (select lang, source, n_chars, quality from documents join labels using (doc_id)),
g as (select 'english' as "group", quality from d where lang = 'en' union all select 'other languages', quality from d where lang <> 'en'
 union all select 'long', quality from d where n_chars > 1000 union all select 'english, long', quality from d where lang = 'en' and n_chars > 1000
 union all select 'source 1x', quality from d where source like 'src1%'),
c as (select "group", count(*) as n, cast(sum(quality) as bigint) as correct from g group by 1 union all select 'nobody', 0, 0),
w as (select *, correct / n as p, 1.96::double * 1.96::double as z2 from c)
select "group", n, correct, round_even(p, 6) as rate, round_even((p + z2 / (2 * n)) / (1 + z2 / n) - 1.96::double * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 6) as ci_low,
 round_even((p + z2 / (2 * n)) / (1 + z2 / n) + 1.96::double * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 6) as ci_high
from (select "group", n, correct, case when n > 0 then p end as p, z2 from w)""")
def _(t):
    d = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id")
    en, long = F.col("lang") == "en", F.col("n_chars") > 1000
    groups = {"english": en, "other languages": ~en, "long": long, "english, long": en & long, "source 1x": F.col("source").startswith("src1"), "nobody": F.lit(False)}
    out = st.condition_accuracy(d, groups, F.col("quality") == 1)
    return out.select("group", "n", "correct", r6("rate").alias("rate"), r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


_CRAMER = """
with c as (select lang as x, source as y, count(*)::double as o from documents group by all),
m as (select *, sum(o) over (partition by x) as rx, sum(o) over (partition by y) as cy, sum(o) over () as n from c),
s as (select max(n) as n, sum((o - rx * cy / n) * (o - rx * cy / n) / (rx * cy / n)) as part, count(distinct x)::double as r, count(distinct y)::double as k, sum(rx * cy / n) as seen from m),
p as (select *, (part + (n - seen)) / n as phi2 from s)"""


@query("cramers_v", f"""{_CRAMER}
select 'lang' as variable, cast(n as bigint) as n, cast(r as bigint) as levels, round_even(sqrt(phi2 / greatest(1, least(r, k) - 1)), 6) as raw_value,
 round_even(sqrt(greatest(0, phi2 - (k - 1) * (r - 1) / (n - 1)) / greatest(1e-12, least(r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)) - 1)), 6) as value from p""")
def _(t):
    v = st.cramers_table(t.documents.select("lang", "source"), ["lang"], "source")
    return v.withColumn("raw_value", r6("raw_value")).withColumn("value", r6("value"))


def _eta_sql(table: str, value: str, cls: str) -> str:
    return f"""(with a as (select avg({value}) as mm, count(*) as n from {table}), g as (select {cls}, count(*) as ng, avg({value}) as m from {table} group by 1),
 w as (select sum(({value} - m) * ({value} - m)) as ssw from {table} join g using ({cls})), b as (select sum(ng * (m - mm) * (m - mm)) as ssb, count(*) as groups from g, a)
 select '{value}' as variable, n, groups, ssb / (ssb + ssw) as value, (ssb / (groups - 1)) / (ssw / (n - groups)) as f_stat from a, b, w)"""


@query("eta_squared", f"select variable, n, groups, round_even(value, 6) as value, round_even(f_stat, 5) as f_stat from {_eta_sql('part', 'p_retailprice', 'p_brand')}")
def _(t):
    e = st.eta_table(t.part.select("p_brand", "p_retailprice"), ["p_retailprice"], "p_brand")
    return e.select("variable", "n", "groups", r6("value").alias("value"), r6("f_stat", 5).alias("f_stat"))


@query("eta_squared_p")
def _(t):
    return st.with_f_pvalue(st.eta_table(t.part.select("p_brand", "p_retailprice", "p_size"), ["p_retailprice", "p_size"], "p_brand"))


@query("association_scan", f"""
with e as (select * from {_eta_sql('part', 'p_retailprice', 'p_brand')} union all select * from {_eta_sql('part', 'p_size', 'p_brand')}),
l as (select 'p_type' as variable, p_type as x, p_brand as y from part union all select 'p_name', p_name, p_brand from part),
c as (select variable, x, y, count(*)::double as o from l group by all),
m as (select *, sum(o) over (partition by variable, x) as rx, sum(o) over (partition by variable, y) as cy, sum(o) over (partition by variable) as n from c),
s as (select variable, max(n) as n, sum(o * o / rx / cy) - 1 as phi2, count(distinct x)::double as r, count(distinct y)::double as k from m group by 1),
v as (select variable, n, r, sqrt(phi2 / greatest(1, least(r, k) - 1)) as raw_value, sqrt(greatest(0, phi2 - (k - 1) * (r - 1) / (n - 1)) / greatest(1e-12, least(r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)) - 1)) as value from s)
select variable, 'numeric' as type, n, round_even(value, 6) as value, null::double as raw_value, null::bigint as levels, round_even(sqrt(value), 6) as effect from e
union all select variable, 'categorical', cast(n as bigint), round_even(value, 6), round_even(raw_value, 6), cast(r as bigint), round_even(value, 6) from v""")
def _(t):
    a = st.association_scan(t.part, ["p_type", "p_name"], ["p_retailprice", "p_size"], "p_brand")
    return a.select("variable", "type", "n", r6("value").alias("value"), r6("raw_value").alias("raw_value"), "levels", r6("effect").alias("effect"))


PERMUTED_PRICE = """
with b as (select p_partkey, p_type as c, p_retailprice as v from part),
k as (select c, sum(n) over (order by c) as hi, sum(n) over (order by c) - n as lo from (select c, count(*) as n from b group by 1)),
r as (select rep, v, row_number() over (partition by rep order by md5('42|' || rep || '|' || p_partkey), p_partkey) as rk from b, (select unnest(range(1, REPLICATES + 1)) as rep)),
a as (select avg(v) as mm, var_pop(v) * count(*) as tot from b),
g as (select rep, c, count(*) as n, avg(v) as m from r join k on rk > lo and rk <= hi group by all),
s as (select rep, sum(n * (m - mm) * (m - mm)) / max(tot) as stat from g, a group by 1),
o as (select sum(n * (m - mm) * (m - mm)) / max(tot) as value from (select c, count(*) as n, avg(v) as m from b group by 1), a)
select round_even(max(value), 6) as value, round_even(avg(stat), 6) as null_mean, round_even(quantile_cont(stat, 0.99), 6) as null_p99,
 round_even((1 + count(*) filter (stat >= value)) / (count(*) + 1), 6) as perm_p, count(*) as replicates from s, o"""


@query("permutation_null", PERMUTED_PRICE.replace("REPLICATES", "20"))
def _(t):
    return _permuted_price(t, 20)


@query("permutation_null_full", PERMUTED_PRICE.replace("REPLICATES", "1000"))
def _(t):
    return _permuted_price(t, 1000)


def _permuted_price(t, replicates: int):
    part = t.part.select("p_partkey", "p_type", "p_retailprice")
    null = st.permuted_eta(part, "p_retailprice", "p_type", "p_partkey", replicates, 42)
    seen = st.eta_table(part, ["p_retailprice"], "p_type")
    s = st.permutation_summary(null, seen)
    return s.select(*[r6(c).alias(c) for c in ("value", "null_mean", "null_p99", "perm_p")], "replicates")


@query("permutation_null_categorical")
def _(t):
    docs = t.documents.select("lang", "source")
    return st.permutation_summary(st.permuted_cramers(docs, "lang", "source", 1000, 42), st.cramers_table(docs, ["lang"], "source"))


@query("bootstrap_ci")
def _(t):
    return st.bootstrap_ci(scored(t), "truth", "pred", 1000, 42)


@query("chance_levels", """
with c as (select lang, count(*) as n from documents group by 1), s as (select sum(n) as n, max(n) as top, count(*) as k, sum(n * n) as sq from c)
select round_even(top / n, 6) as majority_accuracy, round_even(2 * (top / n) / (1 + top / n) / k, 6) as majority_macro_f1, round_even(sq / n / n, 6) as random_accuracy, round_even(1 / k, 6) as random_macro_f1 from s""")
def _(t):
    c = st.chance_levels(t.documents, "lang")
    return c.select(*[r6(x).alias(x) for x in c.columns])


@query("chance_levels_simulated")
def _(t):
    return st.simulated_chance(t.documents.select("lang"), "lang", 200, 42)


@query("bbox_extent", """
with p as (select c_nationkey, (c_custkey * 37) % 1400 / 100.0::double - 25.7::double as lat, (c_custkey * 53) % 770 / 100.0::double + 43.0::double as lon from customer),
x as (select c_nationkey, min(lat) as a, max(lat) as b, min(lon) as c, max(lon) as d from p group by 1)
select c_nationkey, round_even(a - 0.15::double * (b - a), 6) as lat_min, round_even(b + 0.15::double * (b - a), 6) as lat_max, round_even(c - 0.15::double * (d - c), 6) as lon_min, round_even(d + 0.15::double * (d - c), 6) as lon_max from x""")
def _(t):
    p = t.customer.select("c_nationkey", ((F.col("c_custkey") * 37) % 1400 / 100.0 - 25.7).alias("lat"), ((F.col("c_custkey") * 53) % 770 / 100.0 + 43.0).alias("lon"))
    b = st.bbox_extent(p, ["c_nationkey"], "lat", "lon", 0.15)
    return b.select("c_nationkey", *[r6(c).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")])


@query("set_overlap", """
with a as (select distinct l_suppkey, l_partkey from lineitem where year(l_shipdate) <= 1999), b as (select distinct l_suppkey, l_partkey from lineitem where year(l_shipdate) >= 1998),
j as (select coalesce(a.l_suppkey, b.l_suppkey) as l_suppkey, a.l_partkey as x, b.l_partkey as y from a full join b on a.l_suppkey = b.l_suppkey and a.l_partkey = b.l_partkey)
select l_suppkey, count(x) as size_1, count(y) as size_2, round_even(count(*) filter (x is not null and y is not null) / count(*), 6) as iou,
 round_even(count(*) filter (x is null or y is null) / (select count(*) from part), 6) as changed_share, count(*) filter (x is null or y is null) = 0 as identical from j group by 1""")
def _(t):
    lines = t.lineitem.select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("y"))
    o = st.set_overlap(lines.filter("y <= 1999"), lines.filter("y >= 1998"), "l_suppkey", "l_partkey", F.lit(t.part.count()))
    return o.withColumn("iou", r6("iou")).withColumn("changed_share", r6("changed_share"))

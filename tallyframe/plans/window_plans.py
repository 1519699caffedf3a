"""Rankings and sequences bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import r6
from ..operators import windows as wn
from .registry import query
from .scalar_plans import attempt_of_event


def seconds(c: str):
    """Seconds since 1970 of a zone-less timestamp, as a double."""
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


@query("pick_one_per_key", """
select l_orderkey, l_linenumber, l_partkey, l_returnflag from (select *, row_number() over (partition by l_orderkey order by case l_returnflag when 'R' then 1 else 2 end, l_linenumber, l_partkey, l_suppkey) as rn
from lineitem where l_returnflag in ('R', 'A')) where rn = 1""")
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return wn.pick_one_per_key(lines, "l_orderkey", "l_returnflag", ["R", "A"], order).drop("l_suppkey")


@query("latest_per_key", """
select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""")
def _(t):
    return wn.latest_per_key(t.events, ["user_id"], ["ts", "event_id"], ["event_type", "value"]).drop("ts")


@query("first_n_per_group", "select doc_id, source, lang from (select *, row_number() over (partition by source order by doc_id) as rn from documents) where rn <= 2")
def _(t):
    return wn.first_n_per_group(t.documents.select("doc_id", "source", "lang"), "source", ["doc_id"], 2)


@query("group_deviation", """
with g as (select p_brand, median(p_retailprice) as m, stddev_samp(p_retailprice) as sd from part group by 1),
d as (select p_partkey, p_brand, p_retailprice, abs(p_retailprice - m) / sd as deviation from part join g using (p_brand)),
o as (select median(deviation) as mid from d)
select p_partkey, round_even(deviation, 6) as deviation, coalesce(deviation > mid, false) as atypical from d, o""")
def _(t):
    out = wn.group_deviation(t.part, "p_brand", "p_retailprice", ["p_partkey"])
    return out.select("p_partkey", r6("deviation").alias("deviation"), "atypical")


@query("below_group_median", """
with g as (select p_brand, median(p_retailprice) as m from part group by 1)
select p_brand, p_retailprice < m as below, count(*) as n, round_even(avg(p_size), 6) as mean_size from part join g using (p_brand) group by all""")
def _(t):
    rows = wn.below_group_median(t.part.select("p_brand", "p_retailprice", "p_size"), "p_brand", "p_retailprice")
    return rows.groupBy("p_brand", "below").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p_size")).alias("mean_size"))


@query("rank_deciles", """
with r as (select event_id, value, event_type, row_number() over (order by value, event_id) as r, count(*) over () as n from events),
b as (select *, greatest(1, (10 * (r - 1) + n - 2) // (n - 1)) as bucket from r)
select bucket, min(value) as min_value, max(value) as max_value, count(*) as n_rows, count(*) filter (event_type = 'error') as n_failed from b group by 1""")
def _(t):
    d = wn.rank_deciles(t.events, [F.col("value"), F.col("event_id")], ["event_id", "value", "event_type"])
    return d.groupBy(F.col("bucket")).agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("event_type") == "error").alias("n_failed"))


@query("pause_sessions", """
with s as (select user_id, epoch_us(ts) / 1e6::double as a, epoch_us(ts) / 1e6::double + value * 100 as b from events),
m as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as seen from s),
g as (select *, case when a - seen > 3600 then a - seen end as pause from m)
select user_id, count(*) as n_spans, 1 + count(pause) as sessions, round_even(coalesce(sum(pause), 0), 3) as paused_s,
  round_even(max(b) - min(a) - coalesce(sum(pause), 0), 3) as active_s from g group by 1""")
def _(t):
    ev = t.events.select("user_id", "ts", "value")
    out = wn.pause_sessions(ev, ["user_id"], seconds("ts"), seconds("ts") + F.col("value") * 100, gap_s=3600)
    return out.select("user_id", "n_spans", "sessions", r6("paused_s", 3).alias("paused_s"), r6("active_s", 3).alias("active_s"))


_BLOCKED = "event_type in ('error', 'view')"


@query("failure_streak_stop", f"""
with e as (select user_id, event_id, {_BLOCKED} as b, row_number() over (partition by user_id order by ts, event_id) as position from events),
r as (select *, max(case when not b then position else 0 end) over (partition by user_id order by position) as reset from e)
select user_id, min(position) as stop_position from r where position - reset = 3 group by 1""")
def _(t):
    ev = t.events.select("user_id", "event_id", "ts", "event_type")
    hour = F.floor(seconds("ts") / 3600)
    return wn.failure_streak_stop(ev, ["user_id"], ["ts", "event_id"], hour, F.expr(_BLOCKED), limit=3)


@query("attempt_sequence", """
with a as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_returnflag = 'A' then 'HTTP 404' when l_returnflag = 'R' and l_tax > 0.04 then 'HTTP 403' when l_returnflag = 'R' then 'HTTP 200' else 'HTTP 404' end as status from lineitem),
o as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as k from a),
s as (select l_orderkey, min(k) filter (status <> 'HTTP 404') as stop from o group by 1),
m as (select o.*, row_number() over (partition by l_orderkey order by k desc) as back, count(*) over (partition by l_orderkey) as attempts from o join s using (l_orderkey) where stop is null or k <= stop)
select l_orderkey, attempts, status as final_status, status = 'HTTP 200' as succeeded from m where back = 1""")
def _(t):
    status = (F.when(F.col("l_returnflag") == "A", "HTTP 404").when((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.04), "HTTP 403")
              .when(F.col("l_returnflag") == "R", "HTTP 200").otherwise("HTTP 404"))
    a = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", status.alias("status"))
    ok = F.col("status") == "HTTP 200"
    return wn.attempt_sequence(a, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ok, ok | ~F.col("status").contains("404"), "status")


@query("attempts_by_outcome", """
with a as (select event_type, [200, 404, 403, 429, 503, 200, 418, 200][cast(event_id % 8 as integer) + 1] as code, event_id % 16 = 5 as ch from events),
b as (select event_type, case when code = 200 and ch then 403 else code end as code from a)
select event_type, case when code = 200 and event_type in ('view', 'click') then 'ok' when code = 200 then 'fail' when code = 404 then 'next'
 when code in (403, 429) or code >= 500 then 'retry' else 'fail' end as outcome, count(*) as n from b group by all""")
def _(t):
    return t.events.groupBy("event_type", attempt_of_event().alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("share_of_max", """
with c as (select r_name, n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all)
select r_name, n_name, n, round_even(n / max(n) over (partition by r_name), 6) as share from c""")
def _(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    c = t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))
    return wn.share_of_max(c, ["r_name"], "n").withColumn("share", r6("share"))


@query("group_pages", "select p_brand, p_partkey, cast(ceil(row_number() over (partition by p_brand order by p_partkey) / 12) as bigint) as page from part")
def _(t):
    return wn.group_pages(t.part.select("p_brand", "p_partkey"), "p_brand", "p_partkey", 12)


@query("history_tail", """
with b as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations),
w as (select * from b where back <= 4),
e as (select conv_id, min(turn) filter (role = 'user') as f, max_by(role, turn) as last_role from w group by 1)
select conv_id, turn, role, text from w join e using (conv_id) where last_role = 'user' and turn >= f""")
def _(t):
    return wn.history_tail(t.conversations.select("conv_id", "turn", "role", "text"), "conv_id", "turn", "role", limit=4)


@query("history_tail_full", """
with b as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations),
w as (select * from b where back <= 12),
e as (select conv_id, min(turn) filter (role = 'user') as f, max_by(role, turn) as last_role from w group by 1)
select conv_id, turn, role, text from w join e using (conv_id) where last_role = 'user' and turn >= f""")
def _(t):
    return wn.history_tail(t.conversations.select("conv_id", "turn", "role", "text"), "conv_id", "turn", "role")


@query("duplicate_keys", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def _(t):
    return wn.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])

"""Data checks bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import r6
from ..operators import checks as ck
from .manifest import MANIFEST_SQL, curated_split
from .registry import query
from .window_plans import seconds


@query("check_suite", f"""
with {MANIFEST_SQL},
c as (select 'unique document' as "check", (select count(*) from (select doc_id from documents group by 1 having count(*) > 1)) as violations
 union all select 'unique line', (select count(*) from (select l_orderkey, l_linenumber from lineitem group by all having count(*) > 1))
 union all select 'labels cover documents', (select count(*) from documents where doc_id not in (select doc_id from labels)) + (select count(*) from labels where doc_id not in (select doc_id from documents))
 union all select 'splits disjoint', (select count(*) from (select o_orderkey from m group by 1 having min(split) <> max(split)))
 union all select 'class in train', (select count(*) from (select class from m group by 1 having count(*) filter (split = 'train') = 0))
 union all select 'finite vectors', (select count(*) from embeddings where len(list_filter(embedding, lambda x: not isfinite(x))) > 0)
 union all select 'allowed status', (select count(*) from orders where o_orderstatus not in ('F', 'O'))
 union all select 'positive price', (select count(*) from orders where not (o_totalprice > 0))
 union all select 'known part', (select count(*) from lineitem where l_partkey not in (select p_partkey from part)))
select "check", violations, violations = 0 as ok from c""")
def _(t):
    split = curated_split(t).select("o_orderkey", "class", "split")
    return ck.check_suite([
        ck.unique_key("unique document", t.documents, ["doc_id"]),
        ck.unique_key("unique line", t.lineitem, ["l_orderkey", "l_linenumber"]),
        ck.equal_key_sets("labels cover documents", t.documents, t.labels, "doc_id"),
        ck.disjoint_splits("splits disjoint", split, "o_orderkey", "split"),
        ck.class_in_split("class in train", split, "class", "split", "train"),
        ck.row_checks(t.embeddings, {"finite vectors": ck.all_finite("embedding")}),
        ck.row_checks(t.orders, {"allowed status": F.col("o_orderstatus").isin("F", "O"), "positive price": F.col("o_totalprice") > 0}),
        ck.paths_exist("known part", t.lineitem, "l_partkey", t.part.select(F.col("p_partkey").alias("path"))),
    ])


@query("progress_rate", """
with e as (select user_id, ts, event_id, epoch_us(ts) / 1e6::double as tick, count(*) over (partition by user_id) as total, row_number() over (partition by user_id order by ts, event_id) as done from events),
s as (select *, tick - min(tick) over (partition by user_id) as elapsed, tick - lag(tick) over (partition by user_id order by ts, event_id) as step from e)
select user_id, event_id, done, round_even(elapsed, 3) as elapsed_s, round_even(step, 3) as step_s, round_even(elapsed / done, 3) as s_per_row, round_even((total - done) * elapsed / done, 3) as eta_s from s""")
def _(t):
    ev = t.events.select("user_id", "ts", "event_id")
    totals = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    out = ck.progress_rate(ev.join(totals, "user_id"), ["user_id"], ["ts", "event_id"], seconds("ts"), F.floor(seconds("ts") / 3600), F.col("total"))
    return out.select("user_id", "event_id", "done", *[r6(c, 3).alias(c) for c in ("elapsed_s", "step_s", "s_per_row", "eta_s")])

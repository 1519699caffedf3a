"""Scalar functions bound to the driver tables (projections only, no shuffle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls as ul
from ..functions import values as vl
from ..functions.values import r6
from ..operators import aggregates as ag
from ..operators import joins as jn
from .registry import query

# a code with a view suffix, in mixed case and padded, from part keys
_CODE = ("'  ' || case when p_partkey % 2 = 0 then 'Casent' else 'blf' end || cast(p_partkey as varchar) || '-' || "
         "substr('hdplxHDPL', cast(p_partkey % 9 as int) + 1, 1) || cast(p_size as varchar) || ' '")


def _codes(t):
    key = F.col("p_partkey")
    return t.part.select(
        "p_partkey",
        F.concat(
            F.lit("  "), F.when(key % 2 == 0, "Casent").otherwise("blf"), key.cast("string"), F.lit("-"),
            F.substring(F.lit("hdplxHDPL"), (key % 9 + 1).cast("int"), F.lit(1)), F.col("p_size").cast("string"), F.lit(" "),
        ).alias("raw"),
    )


@query("strip_suffix_code", f"""
select p_partkey, regexp_replace(trim({_CODE}), '-[hdpl][0-9]+$', '', 'i') as code from part""")
def _(t):
    return _codes(t).select("p_partkey", tx.strip_suffix_code("raw").alias("code"))


@query("url_token_extract", """
select page_id, nullif(regexp_extract(url, '/(en|fr|de)/[0-9]', 1), '') as lang_token from pages""")
def _(t):
    return t.pages.select("page_id", ul.url_token_extract("url", r"/(en|fr|de)/\d").alias("lang_token"))


@query("url_int_token", """
select page_id, coalesce(try_cast(regexp_extract(url, '/[a-z]+/([0-9]+)', 1) as integer), 9999) as token from pages""")
def _(t):
    return t.pages.select("page_id", ul.url_int_token("url", r"/[a-z]+/(\d+)").alias("token"))


@query("host_filter", """
with h as (select page_id, url, lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1)) as host from pages)
select page_id, host from h where host = 'example.com' or host like '%.example.com'""")
def _(t):
    return t.pages.filter(ul.host_matches("url", "example.com")).select("page_id", ul.authority("url").alias("host"))


@query("url_without_query", "select page_id, split_part(url, '?', 1) as clean_url from pages")
def _(t):
    return t.pages.select("page_id", ul.url_without_query("url").alias("clean_url"))


@query("derived_cache_url", """
select page_id, 'https://cache.example.org/v1/image/cache/1024x1024/occurrence/' || page_id || '/media/' || md5(url) as cache_url from pages""")
def _(t):
    return t.pages.select(
        "page_id", ul.derived_cache_url("https://cache.example.org/v1", "page_id", "url", "1024x1024").alias("cache_url"))


@query("safe_file_token", """
select p_partkey, regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')-' || p_size, '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g') as token from part""")
def _(t):
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")-"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", tx.safe_file_token(name).alias("token"))


@query("path_template", """
select p_partkey, 'images/' || p_type || '/' || regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g')
       || '_' || substr(p_name, 1, 1) || '.jpg' as path from part""")
def _(t):
    return t.part.select(
        "p_partkey", tx.path_template("images", "p_type", "p_brand", F.substring("p_name", 1, 1)).alias("path"))


@query("fallback_with_flag", """
select d.doc_id, coalesce(l.quality, cast(d.n_chars % 2 as integer)) as value,
       case when l.quality is null then 1 else 0 end as used_fallback,
       (l.quality is null) <> (l.toxic is null) as disagrees
from documents d left join labels l using (doc_id)""")
def _(t):
    d = t.documents.select("doc_id", (F.col("n_chars") % 2).cast("int").alias("fallback")).join(t.labels, "doc_id", "left")
    value, flag = vl.fallback_with_flag("quality", "fallback")
    return d.select("doc_id", value.alias("value"), flag.alias("used_fallback")
                    , (F.col("quality").isNull() != F.col("toxic").isNull()).alias("disagrees"))


@query("clamped_box", """
with s as (select p_partkey, case p_partkey % 3 when 0 then 'found' when 1 then 'truncated' else 'not_found' end as status,
    (p_size % 11) / 10.0::double as xf, 0.5 + (p_size % 6) / 10.0::double as yf, 40.0 + p_size * 3 as len, 2.0 + p_size % 5 as th,
    600 + p_size * 10 as w, 400 + p_size * 7 as h from part),
m as (select *, w / 1024.0::double as k, xf * w as cx, yf * h as cy from s),
b as (select *, case when status = 'found' then len / 2 else greatest(case when cx < w / 2.0::double then cx else w - cx end, 0.12::double * w / 2) end as half,
    case when status = 'found' then th else 6 * k end as thick from m)
select p_partkey, status,
  case when status <> 'not_found' then cast(trunc(greatest(0.0::double, cx - half - 20 * k)) as integer) end as x0,
  case when status <> 'not_found' then cast(trunc(greatest(0.0::double, cy - thick / 2 - 10 * k)) as integer) end as y0,
  case when status <> 'not_found' then cast(least(w, ceil(cx + half + 20 * k)) as integer) end as x1,
  case when status <> 'not_found' then cast(least(h, ceil(cy + thick / 2 + 50 * k)) as integer) end as y1
from b""")
def _(t):
    size, key = F.col("p_size"), F.col("p_partkey")
    s = t.part.select(
        "p_partkey",
        F.when(key % 3 == 0, "found").when(key % 3 == 1, "truncated").otherwise("not_found").alias("status"),
        ((size % 11) / 10.0).alias("xf"), (0.5 + (size % 6) / 10.0).alias("yf"),
        (40.0 + size * 3).alias("len"), (2.0 + size % 5).alias("th"),
        (600 + size * 10).alias("w"), (400 + size * 7).alias("h"),
    )
    box = vl.clamped_box("status", "xf", "yf", "len", "th", "w", "h")
    return s.select("p_partkey", "status", box.alias("b")).select("p_partkey", "status", "b.x0", "b.y0", "b.x1", "b.y1")


@query("variant_urls", """
with u as (select page_id, split_part(url, '?', 1) || case when page_id % 3 = 0 then '_high.jpg' when page_id % 3 = 1 then '_low.jpg' else '' end as u from pages),
e as (select page_id, u, unnest(range(0, 3)) as pos from u)
select page_id, cast(pos as integer) as pos,
  case when regexp_matches(u, '_(high|med|low)\\.jpg$') then regexp_replace(u, '_(high|med|low)\\.jpg$', '') || '_' || ['med','high','low'][pos + 1] || '.jpg' else u end as variant
from e where pos = 0 or regexp_matches(u, '_(high|med|low)\\.jpg$')""")
def _(t):
    tail = F.when(F.col("page_id") % 3 == 0, "_high.jpg").when(F.col("page_id") % 3 == 1, "_low.jpg").otherwise("")
    u = t.pages.select("page_id", F.concat(ul.url_without_query("url"), tail).alias("u"))
    return u.select("page_id", F.posexplode(ul.variant_urls("u")).alias("pos", "variant"))


_TITLE = """'File:' || p_name || case when p_partkey % 5 = 0 then '' else ' CASENT' || lpad(cast(p_partkey as varchar), 7, '0') end || ' '
 || ['profile','dorsal','head','label','leg'][cast(p_size % 5 as integer) + 1] || case when p_size % 2 = 0 then ' ' || p_size else '' end || '.jpg'"""


@query("title_parse", f"""
with t as (select p_partkey, regexp_replace(lower(regexp_replace({_TITLE}, '^File:', '')), '\\.jpe?g$', '') as t from part),
p as (select p_partkey, regexp_extract(t, '(casent[0-9][0-9a-z_().-]*|antweb[0-9]+)', 1) as code,
  regexp_extract(t, '\\b(profile|dorsal|head|label)\\b', 1) as w,
  coalesce(try_cast(regexp_extract(t, '\\b(profile|dorsal|head|label)\\b\\s+([0-9]+)', 2) as integer), 1) as shot from t)
select p_partkey, code, case w when 'profile' then 'p' when 'dorsal' then 'd' when 'head' then 'h' when 'label' then 'l' end as view, shot
from p where code <> ''""")
def _(t):
    return jn.parsed_titles(_titles(t), "title").select("p_partkey", "code", "view", "shot")


def _titles(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    word = F.element_at(F.array(*[F.lit(w) for w in ("profile", "dorsal", "head", "label", "leg")]), (size % 5 + 1).cast("int"))
    return t.part.select("p_partkey", F.concat(
        F.lit("File:"), "p_name",
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit(" CASENT"), F.lpad(key.cast("string"), 7, "0"))),
        F.lit(" "), word, F.when(size % 2 == 0, F.concat(F.lit(" "), size.cast("string"))).otherwise(""), F.lit(".jpg"),
    ).alias("title"))


@query("year_range_parse", """
with y as (select doc_id, text || case when doc_id % 4 = 0 then ' (c) 2001 - ' || (2002 + doc_id % 20) else '' end as s from documents)
select doc_id,
  cast(case when regexp_matches(s, '[0-9]{4}\\s*-\\s*[0-9]{4}') then regexp_extract(s, '([0-9]{4})\\s*-\\s*([0-9]{4})', 1)
       else nullif(regexp_extract(s, '([0-9]{4})', 1), '') end as integer) as year_start,
  cast(case when regexp_matches(s, '[0-9]{4}\\s*-\\s*[0-9]{4}') then regexp_extract(s, '([0-9]{4})\\s*-\\s*([0-9]{4})', 2)
       else nullif(regexp_extract(s, '([0-9]{4})', 1), '') end as integer) as year_end
from y""")
def _(t):
    tail = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" (c) 2001 - "), (2002 + F.col("doc_id") % 20).cast("string"))).otherwise("")
    years = tx.year_range_parse(F.concat("text", tail))
    return t.documents.select("doc_id", years.alias("y")).select(
        "doc_id", F.col("y.start").alias("year_start"), F.col("y.end").alias("year_end"))


@query("year_prefix", "select o_orderkey, cast(year(o_orderdate) as integer) as year, cast(year(o_orderdate) // 10 * 10 as integer) as decade from orders")
def _(t):
    o = t.orders.select("o_orderkey", tx.year_prefix("o_orderdate").alias("year"))
    return o.select("o_orderkey", "year", tx.decade("year").alias("decade"))


@query("recode_map", """
select p_partkey, p_type as original, case p_type when 'ECONOMY' then 'BUDGET' when 'SMALL' then 'COMPACT' else p_type end as recoded from part""")
def _(t):
    return t.part.select("p_partkey", F.col("p_type").alias("original"),
                         vl.recode("p_type", {"ECONOMY": "BUDGET", "SMALL": "COMPACT"}).alias("recoded"))


@query("recode_counts", """
select p_type as original, case p_type when 'ECONOMY' then 'BUDGET' else 'COMPACT' end as recoded, count(*) as n_rows, count(distinct p_brand) as n_keys
from part where p_type in ('ECONOMY', 'SMALL') group by all""")
def _(t):
    return ag.recode_counts(t.part, "p_type", {"ECONOMY": "BUDGET", "SMALL": "COMPACT"}, "p_brand")


@query("normalise_label", "select p_partkey, lower(p_type) as label from part where p_partkey % 10 <> 0 union all select p_partkey, '' from part where p_partkey % 10 = 0")
def _(t):
    raw = F.when(F.col("p_partkey") % 10 != 0, F.concat(F.lit("  "), F.upper("p_type"), F.lit("\t ")))
    return t.part.select("p_partkey", tx.normalise_label(raw).alias("label"))


@query("list_successor", """
with p as (select page_id, string_split(split_part(url, '?', 1), '/') as parts from pages)
select page_id, case when list_position(parts, 'en') > 0 then coalesce(parts[list_position(parts, 'en') + 1], '') else '' end as successor from p""")
def _(t):
    return t.pages.select("page_id", tx.list_successor(F.replace(ul.url_without_query("url"), F.lit("/"), F.lit(";")), "en").alias("successor"))


@query("blank_to_null", """
select doc_id, case when doc_id % 3 <> 0 then source end as source, case when doc_id % 5 <> 0 then n_chars / 2.0::double end as half from documents""")
def _(t):
    src = F.when(F.col("doc_id") % 3 == 0, F.lit(" \t")).otherwise(F.col("source"))
    num = F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars") / 2.0)
    return t.documents.select("doc_id", tx.blank_to_null(src).alias("source"), tx.blank_to_null(num, numeric=True).alias("half"))


@query("source_class", """
select doc_id, case when lang = 'en' then 'primary' when source like 'src1%' then 'thumbnail' when starts_with(text, 'The') then 'direct' else 'original' end as source_class from documents""")
def _(t):
    rules = [(F.col("lang") == "en", "primary"), (F.col("source").startswith("src1"), "thumbnail"), (F.col("text").startswith("The"), "direct")]
    return t.documents.select("doc_id", tx.source_class(rules, "original").alias("source_class"))


@query("source_resolve", """
with items as (select c_custkey as path, ['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'][cast(c_custkey % 5 as integer) + 1] as url, c_acctbal > 1000 as present from customer),
logged as (select user_id as path, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1),
ok as (select distinct o_custkey as path, o_orderpriority as url from orders where o_orderstatus = 'F')
select i.path, case when not i.present then '' when l.event_type is not null then l.event_type when k.path is not null then 'cache' else 'second' end as source
from items i left join logged l on l.path = i.path left join ok k on k.path = i.path and k.url = i.url""")
def _(t):
    priorities = F.array(*[F.lit(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    items = t.customer.select(
        F.col("c_custkey").alias("path"), F.element_at(priorities, (F.col("c_custkey") % 5 + 1).cast("int")).alias("url"),
        (F.col("c_acctbal") > 1000).alias("present"))
    log = t.events.select(F.col("user_id").alias("path"), F.col("event_type").alias("source"), "ts", "event_id")
    ok = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("url"))
    return jn.source_resolve(items, log, ok, log_order=["ts", "event_id"], cached="cache", default="second").select("path", "source")


@query("prompt_template", "select n_nationkey, 'a photo of ' || n_name || ', a kind of place' as prompt from nation")
def _(t):
    return t.nation.select("n_nationkey", tx.prompt_template("a photo of {x}, a kind of place", "n_name").alias("prompt"))


@query("strip_leading_term", """
with w as (select p_partkey, p_name, case when p_partkey % 4 = 0 then 'zz' else split_part(p_name, ' ', 1) end as term from part)
select p_partkey, case when starts_with(p_name, term || ' ') then substr(p_name, length(term) + 2) else p_name end as rest from w""")
def _(t):
    term = F.when(F.col("p_partkey") % 4 == 0, "zz").otherwise(F.substring_index("p_name", " ", 1))
    return t.part.select("p_partkey", tx.strip_leading_term("p_name", term).alias("rest"))


LINE_FLAGS_SQL = """concat_ws(';', case when l_quantity < 3 then 'empty' end, case when l_quantity > 48 then 'large' end,
 case when l_tax = 0 then 'frame_filling' end, case when l_returnflag = 'N' then 'no_scale' end)"""


def line_flags():
    return tx.flag_list({
        "empty": F.col("l_quantity") < 3, "large": F.col("l_quantity") > 48,
        "frame_filling": F.col("l_tax") == 0, "no_scale": F.col("l_returnflag") == "N"})


@query("flag_list", f"""
with f as (select l_orderkey, l_partkey, l_discount, {LINE_FLAGS_SQL} as f from lineitem)
select l_orderkey, l_partkey, case when l_discount < 0.02 then case when f = '' then 'small' else f || ';small' end else f end as flags from f""")
def _(t):
    base = t.lineitem.select("l_orderkey", "l_partkey", "l_discount", line_flags().alias("f"))
    return base.select("l_orderkey", "l_partkey", tx.add_flag("f", "small", F.col("l_discount") < 0.02).alias("flags"))


@query("colour_measures", """
with c as (select p_partkey, (p_partkey * 7) % 256 as r, (p_partkey * 13 + p_size) % 256 as g, (p_size * 5) % 256 as b from part),
m as (select *, greatest(r, g, b) as mx, greatest(r, g, b) - least(r, g, b) as d from c)
select p_partkey, round_even(r * 0.299::double + g * 0.587::double + b * 0.114::double, 6) as luminance, cast(d as bigint) as chroma, cast(r - b as bigint) as warm_cool,
 round_even(case when d = 0 then 0.0 when mx = r then 60.0 * ((((g - b)::double / d) % 6 + 6) % 6) when mx = g then 60.0 * ((b - r)::double / d + 2)
   else 60.0 * ((r - g)::double / d + 4) end::double, 6) as hue from m""")
def _(t):
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    c = t.part.select("p_partkey", ((key * 7) % 256).alias("r"), ((key * 13 + size) % 256).alias("g"), ((size * 5) % 256).alias("b"))
    return c.select("p_partkey", r6(vl.luminance("r", "g", "b")).alias("luminance"), vl.chroma("r", "g", "b").alias("chroma"),
                    vl.warm_cool("r", "b").alias("warm_cool"), r6(vl.hue_degrees("r", "g", "b")).alias("hue"))


_MARKERS = ["track(1", "spam-farm", "Just a moment"]


@query("marker_screen", """
with m as (select page_id, html, unnest(['track(1', 'spam-farm', 'Just a moment']) as m from pages)
select page_id, bool_or(contains(html, m)) as challenged from m group by page_id""")
def _(t):
    return t.pages.select("page_id", tx.marker_screen("html", _MARKERS).alias("challenged"))


@query("attempt_outcome", """
with a as (select event_id, [200, 404, 403, 429, 503, 200, 418, 200][cast(event_id % 8 as integer) + 1] as code,
  case when event_type in ('view', 'click') then 'image/jpeg' else 'text/html' end as ctype, event_id % 16 = 5 as ch from events),
b as (select event_id, ctype, case when code = 200 and ch then 403 else code end as code from a)
select event_id, case when code = 200 and ctype like 'image%' then 'ok' when code = 200 then 'fail' when code = 404 then 'next'
 when code in (403, 429) or code >= 500 then 'retry' else 'fail' end as outcome from b""")
def _(t):
    return t.events.select("event_id", attempt_of_event().alias("outcome"))


def attempt_of_event():
    """Deterministic attempts from events: code, content type and challenge flag."""
    codes = F.array(*[F.lit(c) for c in (200, 404, 403, 429, 503, 200, 418, 200)])
    return vl.attempt_outcome(
        F.element_at(codes, (F.col("event_id") % 8 + 1).cast("int")),
        F.when(F.col("event_type").isin("view", "click"), "image/jpeg").otherwise("text/html"),
        F.col("event_id") % 16 == 5)


@query("input_gate", """
select doc_id, case when lang = 'de' then 400 when case when doc_id % 9 = 0 then 0 else n_chars end > 2000 then 413 when doc_id % 9 = 0 then 422 else 200 end as code from documents""")
def _(t):
    kind = F.when(F.col("lang") == "de", "text/html").otherwise("Image/PNG")
    size = F.when(F.col("doc_id") % 9 == 0, F.lit(0)).otherwise(F.col("n_chars"))
    return t.documents.select("doc_id", vl.input_gate(kind, size, 2000).alias("code"))

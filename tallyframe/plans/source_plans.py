"""Sources and sinks bound to the driver tables (written to and read back from the shared folder)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import readers as rd
from ..sources import sinks as sk
from .registry import query

_ITEM = "array<struct<identifier:string,title:string,position:int>>"


@query("nested_records_explode", r"""
with links as (select page_id, regexp_extract(url, '^https?://([^/]*)', 1) as host, regexp_extract_all(html, '<a href="([^"]*)"', 1) as hrefs,
   regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang from pages),
e as (select page_id, lang, hrefs, host, unnest(range(0, len(hrefs))) as i from links),
x as (select page_id, lang, cast(i as integer) as position, case when i % 4 = 3 then 'https://elsewhere.org' else 'https://' || host end || hrefs[i + 1] as identifier from e)
select page_id, lang || ';checked' as tags, position, identifier from x
where regexp_matches(identifier, '^https://([^/]*\.)?example\.com(/|$)')""")
def _(t):
    return rd.explode_records(_nested(t), "media", ["page_id"], ["position", "identifier"], "identifier", "example.com", "tags").select(
        "page_id", "tags", "position", "identifier")


def _nested(t):
    """Pages as nested records: one record per page, one item per link, via JSON text."""
    host = F.regexp_extract("url", r"^https?://([^/]*)", 1)
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    p = t.pages.select("page_id", host.alias("host"), links.alias("links"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))
    media = F.transform("links", lambda x, i: F.struct(
        F.concat(F.when(i % 4 == 3, "https://elsewhere.org").otherwise(F.concat(F.lit("https://"), F.col("host"))), x).alias("identifier"),
        x.alias("title"), i.alias("position")))
    record = F.to_json(F.struct("page_id", F.array("lang", F.lit("checked")).alias("tags"), media.alias("media")))
    schema = f"page_id bigint, tags array<string>, media {_ITEM}"
    return p.select(F.from_json(record, schema).alias("r")).select("r.*")


@query("json_field_extract", "select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events")
def _(t):
    return rd.json_fields(t.events, "props", "k int", ["event_id"])


@query("csv_scan", "select n_nationkey, n_name, n_regionkey, case when n_nationkey % 4 = 0 then 'NA' when n_nationkey % 4 = 1 then '' else 'x' end as note_text, case when n_nationkey % 4 >= 2 then 'x' end as note from nation")
def _(t):
    note = F.when(F.col("n_nationkey") % 4 == 0, "NA").when(F.col("n_nationkey") % 4 == 1, "").otherwise("x")
    path = sk.scratch_path(t.spark, "nation-csv")
    t.nation.withColumn("note", note).write.option("header", True).csv(path)
    schema = "n_nationkey int, n_name string, n_regionkey int, note string"
    literal = rd.read_csv(t.spark, path, schema, literal_na=True).select("n_nationkey", "n_name", "n_regionkey", F.col("note").alias("note_text"))
    return literal.join(rd.read_csv(t.spark, path, schema).select("n_nationkey", "note"), "n_nationkey")


@query("parquet_parts_scan", "select o_orderstatus, count(*) as n, round_even(sum(o_totalprice), 2) as total from orders where o_orderstatus in ('F', 'O') group by 1")
def _(t):
    path = sk.scratch_path(t.spark, "orders-parts")
    sk.write_parts(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), path, "o_orderstatus")
    parts = rd.read_parts(t.spark, path).filter(F.col("o_orderstatus").isin("F", "O"))
    return parts.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum("o_totalprice"), 2).alias("total"))


@query("text_lines_scan", "select split_part(url, '?', 1) as line, count(*) as n from pages group by 1")
def _(t):
    path = sk.scratch_path(t.spark, "urls-text")
    t.pages.select(F.substring_index("url", "?", 1).alias("value")).write.text(path)
    return rd.read_lines(t.spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("file_manifest")
def _(t):
    return rd.file_manifest(t.spark, t.dir, "*.parquet")


@query("checksum_verify")
def _(t):
    now = rd.file_manifest(t.spark, t.dir, "*.parquet")
    then = now.withColumn("sha256", F.when(F.col("file") == "part.parquet", F.reverse("sha256")).otherwise(F.col("sha256")))
    return rd.checksum_verify(now, then)


@query("table_fingerprint", """
select count(*) as n_rows, cast(sum(cast('0x' || substr(md5(concat_ws('|', c_custkey, c_name, c_nationkey, c_mktsegment, cast(round(c_acctbal * 100) as bigint))), 1, 15) as bigint)) as varchar) as fingerprint from customer""")
def _(t):
    cents = F.round(F.col("c_acctbal") * 100).cast("long")  # a text that all engines write alike
    return sk.table_fingerprint(t.customer.withColumn("cents", cents), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "cents"])


@query("keyed_append_log", "select event_type, count(*) as n, max(event_id) as last_id from events group by 1")
def _(t):
    path = sk.scratch_path(t.spark, "attempts")
    log = t.events.select("event_id", "event_type", "user_id")
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    sk.append_log(t.events.filter(early).select(*log.columns), path)
    sk.append_log(t.events.filter(~early).select(*log.columns), path)
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


@query("sorted_table_sink", "select c_custkey, c_name, c_acctbal, true as in_order from customer")
def _(t):
    path = sk.scratch_path(t.spark, "customers-sorted")
    sk.write_sorted(t.customer.select("c_custkey", "c_name", "c_acctbal"), path, ["c_custkey"])
    back = t.spark.read.parquet(path)
    # every file covers its own key range: its smallest key exceeds the largest of the files before
    files = back.groupBy(F.input_file_name().alias("f")).agg(F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"), F.count(F.lit(1)).alias("n"))
    before = F.lag("hi").over(Window.partitionBy(F.lit(1)).orderBy("f"))  # one row per file
    overlap = files.withColumn("before", before).agg(F.every(F.coalesce(F.col("lo") > F.col("before"), F.lit(True))).alias("in_order"))
    return back.withColumn("in_order", overlap.scalar())


@query("resume_incremental", """
select o_orderkey, case when o_orderstatus = 'F' then 'carried' else 'pending' end as state from orders where o_orderpriority <> '5-LOW'""")
def _(t):
    inputs = t.orders.filter("o_orderpriority <> '5-LOW'").select("o_orderkey")
    done = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    pending, carried = sk.resume_incremental(inputs, done, ["o_orderkey"])
    return pending.withColumn("state", F.lit("pending")).unionByName(carried.withColumn("state", F.lit("carried")))

"""Dataflows of several operators, sources and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions.python import answer_json, similarity
from inkwell.operators.groups import smallest_label, within_hops
from inkwell.operators.ordered import segments
from inkwell.plans.runtime import table
from inkwell.queries.joining import OCC, PAGES, documents, occurrences, pages
from inkwell.queries.scalars import COMP, companies
from inkwell.sources.readers import html_links, import_key, merge_by_key, sitemap_links
from inkwell.streaming.events import delivered, once, read_events, run, windowed

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return keep


_RANK = "case data_source when 'xdata_nb_high_quality' then 2 when 'xdata_germany' then 1 else 0 end"


def source_rank():
    return F.when(F.col("data_source") == "xdata_nb_high_quality", 2).when(F.col("data_source") == "xdata_germany", 1).otherwise(0)


@query("flow_company_precedence", f"with {COMP} select normalized_name, arg_max(id, ({_RANK}, case when contact_key like '%=%' then 1 else 0 end, -id)) as winner_id, count(*) as rows_merged, count(distinct data_source) as sources from comp where normalized_name <> '' group by normalized_name")
def _(spark, d):
    order = F.struct(source_rank(), F.when(F.col("contact_key").contains("="), 1).otherwise(0), -F.col("id"))
    return companies(spark, d, "normalized_name", "contact_key", "data_source").where("normalized_name <> ''").groupBy("normalized_name").agg(F.max_by("id", order).alias("winner_id"), F.count(F.lit(1)).alias("rows_merged"), F.count_distinct("data_source").alias("sources"))


@query("flow_company_repair", f"with recursive {COMP}, k as (select id, unnest(string_split(contact_key, '|')) as part from comp where contact_key is not null), f as (select id, split_part(part, '=', 1) || '=' || unnest(string_split(split_part(part, '=', 2), ',')) as v from k where contains(part, '=')), e as (select distinct a.id as u, b.id as v from f a join f b on a.v = b.v and a.id <> b.id), r as (select u as vertex, v as label from e union select r.vertex, e.v from r join e on e.u = r.label) select vertex as company_id, least(vertex, min(label)) as group_id from r group by vertex")
def _(spark, d):
    k = companies(spark, d, "contact_key").where("contact_key is not null").select("id", F.explode(F.split("contact_key", r"\|")).alias("part")).where("contains(part, '=')")
    f = k.select("id", F.explode(F.transform(F.split(F.substring_index("part", "=", -1), ","), lambda v: F.concat(F.substring_index("part", "=", 1), F.lit("="), v))).alias("v")).distinct()
    star = f.groupBy("v").agg(F.min("id").alias("low"))
    edges = f.join(star, "v").where("id <> low").select(F.col("id").alias("u"), F.col("low").alias("v"))
    return smallest_label(edges).select(F.col("vertex").alias("company_id"), F.col("label").alias("group_id"))


@query("flow_keyed_merge", f"with {COMP} select contact_key, arg_max(id, ({_RANK}, id % 2, -id)) as id from comp where contact_key is not null group by contact_key")
def _(spark, d):
    c = companies(spark, d, "contact_key", "data_source").where("contact_key is not null").select("contact_key", "id", "data_source")
    merged = merge_by_key(c.where("id % 2 = 0"), c.where("id % 2 = 1"), "contact_key", [source_rank(), F.col("is_new"), -F.col("id")])
    return merged.select("contact_key", "id")


@query("flow_import_key", f"with {OCC} select count(distinct sha256(coalesce(company, '') || chr(31) || coalesce(preview, ''))) as records, count(*) as rows_read from occ")
def _(spark, d):
    o = occurrences(spark, d, "company", "preview").select(F.coalesce("company", F.lit("")).alias("company"), F.coalesce("preview", F.lit("")).alias("preview")).withColumn("key", import_key("company", "preview"))
    return o.agg(F.count_distinct("key").alias("records"), F.count(F.lit(1)).alias("rows_read"))


@query("flow_status_changes", "with s as (select distinct id, status, created_at from ingestion_occurrences), w as (select id, status, created_at, lag(status) over (partition by id order by created_at, status) as before from s) select id, before as old_status, status as new_status from w where before is not null and before <> status and status = 'approved'")
def _(spark, d):
    s = table(spark, d, "ingestion_occurrences").select("id", "status", "created_at").distinct()
    w = Window.partitionBy("id").orderBy("created_at", "status")
    return s.withColumn("old_status", F.lag("status").over(w)).where("old_status <> status and status = 'approved'").select("id", "old_status", F.col("status").alias("new_status"))


@query("flow_page_report", f"with {PAGES}, {OCC}, a as (select page_id, count(*) as ads, max(confidence) as best from occ group by page_id) select p.document_id, count(*) as pages, cast(coalesce(sum(a.ads), 0) as bigint) as ads, count(*) filter (where a.ads is null) as pages_without, max(a.best) as best from pages p left join a on a.page_id = p.id group by p.document_id")
def _(spark, d):
    a = occurrences(spark, d, "document_id", "page_id", "confidence").groupBy("page_id").agg(F.count(F.lit(1)).alias("ads"), F.max("confidence").alias("best"))
    return pages(spark, d, "document_id").select(F.col("id").alias("page_id"), "document_id").join(a, "page_id", "left").groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("ads"), F.lit(0)).alias("ads"), F.count_if(F.col("ads").isNull()).alias("pages_without"), F.max("best").alias("best"))


@query("flow_alignment", f"with {OCC}, x as (select id, page_id, company, cast(json_extract_string(bbox, '$.x') as double) as x from occ where bbox is not null), g as (select *, case when x - lag(x) over (partition by page_id order by x, id) <= 0.08 then 0 else 1 end as fresh from x where x is not null), s as (select *, sum(fresh) over (partition by page_id order by x, id rows unbounded preceding) as c from g), k as (select page_id, c, count(distinct company) as texts, cast(sum(cast(round(x * 1000) as bigint)) // count(*) as bigint) as edge from s group by 1, 2) select page_id, arg_max(edge, (texts, -c)) as edge, max(texts) as texts from k where texts >= 2 group by page_id")
def _(spark, d):
    own = occurrences(spark, d, "page_id", "company", "bbox").where("bbox is not null").select("id", "page_id", "company", F.get_json_object("bbox", "$.x").cast("double").alias("x")).where("x is not null")
    w = Window.partitionBy("page_id").orderBy("x", "id")
    s = segments(own, ["page_id"], ["x", "id"], F.col("x") - F.lag("x").over(w) > 0.08)
    k = s.groupBy("page_id", "segment").agg(F.count_distinct("company").alias("texts"), F.floor(F.sum(F.round(F.col("x") * 1000).cast("bigint")) / F.count(F.lit(1))).alias("edge")).where("texts >= 2")
    return k.groupBy("page_id").agg(F.max_by("edge", F.struct("texts", -F.col("segment"))).alias("edge"), F.max("texts").alias("texts"))


@query("flow_reachable", "with recursive l as (select id as src, id * 2 as dst from ingestion_documents union select id, id * 2 + 1 from ingestion_documents), r(node, depth) as (select 1::bigint, 0 union select l.dst, r.depth + 1 from r join l on l.src = r.node where r.depth < 4) select node, cast(min(depth) as integer) as depth from r group by node")
def _(spark, d):
    x = documents(spark, d)
    links = x.select(F.col("id").alias("src"), (F.col("id") * 2).alias("dst")).unionByName(x.select(F.col("id").alias("src"), (F.col("id") * 2 + 1).alias("dst")))
    return within_hops(links, spark.createDataFrame([(1,)], "node bigint"), 4)


_HTML = [("https://gemeinde.example/amt/index.html", '<a href="plan.pdf">Plan</a> <A class="x" HREF=\'/a/Blatt.PDF?v=2\'>B</A> <a href="https://x.example/c.pdf">c</a><a href="plan.pdf">noch einmal</a><a href="info.html">i</a>'), ("https://leer.example/", "<p>nichts</p>")]


@query("source_html_links", "select * from (values ('https://gemeinde.example/amt/plan.pdf'), ('https://gemeinde.example/a/Blatt.PDF?v=2'), ('https://x.example/c.pdf')) t(link)")
def _(spark, d):
    return html_links(spark.createDataFrame(_HTML, "base string, html string"), "html", "base", ".pdf").select("link")


_MAPS = [('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.example/1.pdf</loc></url><url><loc>https://a.example/2</loc></url></urlset>',), ("<sitemapindex><sitemap><loc>https://a.example/m.xml</loc></sitemap></sitemapindex>",), ("<urlset><url><loc>kaputt",), (None,)]


@query("source_sitemap", "select * from (values ('https://a.example/1.pdf', false), ('https://a.example/2', false), ('https://a.example/m.xml', true)) t(loc, is_index)")
def _(spark, d):
    return sitemap_links(spark.createDataFrame(_MAPS, "xml string"), "xml").select("loc", "is_index")


@query("python_read_answers")
def _(spark, d):
    """Company JSON, whole, cut off or in Python's notation, through the tolerant reader."""
    return companies(spark, d, "canonical_fields_json").select("id", answer_json("canonical_fields_json").alias("value"))


@query("python_similarity")
def _(spark, d):
    """Likeness of names as typed and as normalised, word by word."""
    return companies(spark, d, "name", "normalized_name").select("id", F.round(similarity(F.lower("name"), "normalized_name"), 6).alias("likeness"))


@query("stream_once", "select event_type, count(*) as events, count(distinct event_id) as ids from events group by event_type")
def _(spark, d):
    s = read_events(spark, d)
    return run(once(s.select("event_id", "event_type"), "event_id")).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids"))


@query("stream_windows", "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as hour, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2")
def _(spark, d):
    s = windowed(read_events(spark, d), "ts", ["event_type"], "1 hour", "10 minutes", F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return run(s, "complete").select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "events", F.round("total", 4).alias("total"))


@query("stream_table_join", "with u as (select c_custkey, c_mktsegment from customer) select c_mktsegment, count(*) as events from events join u on c_custkey = user_id group by c_mktsegment")
def _(spark, d):
    u = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    s = read_events(spark, d).select("event_id", "user_id").join(u, F.col("user_id") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("events"))
    return run(s, "complete")


@query("stream_attempts", "with a as (select user_id, event_type, event_id, event_id % 4 = 0 as ok, row_number() over (partition by user_id, event_type order by event_id) as n from events), f as (select user_id, event_type, min(n) filter (where ok) as first_ok, count(*) as n from a group by 1, 2) select user_id, event_type, cast(least(coalesce(first_ok, n), 5, n) as integer) as made, case when first_ok <= 5 then 'delivered' when n >= 5 then 'dead' else 'pending' end as state from f")
def _(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    tries = table(spark, d, "events").select("user_id", "event_type", "event_id").withColumn("n", F.row_number().over(w)).where("n <= 5")  # the fifth decides
    e = tries.groupBy("user_id", "event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id"))), lambda x: x["event_id"] % 4 == 0).alias("a"))
    return e.select("user_id", "event_type", delivered(F.col("a"), 5).alias("r")).select("user_id", "event_type", "r.made", "r.state")


QUERIES, ORACLES = Q, O

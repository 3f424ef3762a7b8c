"""Joins, set operations, sorting and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.geometry import box, intersection
from inkwell.operators.joins import either_key_join, next_greater, within_one_edit
from inkwell.plans.runtime import table

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return keep


def documents(spark, d):
    return table(spark, d, "ingestion_documents")


def pages(spark, d, *columns):
    """One row per page; repeated rows are equal, so only the columns asked for are read and compared."""
    return table(spark, d, "ingestion_pages").select("id", *columns).distinct()


def occurrences(spark, d, *columns):
    """One row per id with the columns asked for: the latest by created_at, status as tie break."""
    o = table(spark, d, "ingestion_occurrences")
    if not columns:
        return o.select("id").distinct()
    newest = F.max_by(F.struct(*columns), F.struct("created_at", F.coalesce("status", F.lit(""))))
    return o.groupBy("id").agg(newest.alias("o")).select("id", "o.*")


PAGES = "pages as (select distinct id, document_id, page_number, text, classification, ad_probability from ingestion_pages)"
OCC = "occ as (select * from ingestion_occurrences qualify row_number() over (partition by id order by created_at desc, coalesce(status, '') desc) = 1)"


@query("join_chain", f"with {PAGES}, {OCC} select o.id as occurrence_id, p.page_number, d.filename from occ o join pages p on p.id = o.page_id join ingestion_documents d on d.id = p.document_id")
def _(spark, d):
    o, p = occurrences(spark, d, "document_id", "page_id"), pages(spark, d, "document_id", "page_number")
    return o.select(F.col("id").alias("occurrence_id"), "page_id").join(p.select(F.col("id").alias("page_id"), "document_id", "page_number"), "page_id").join(documents(spark, d).select(F.col("id").alias("document_id"), "filename"), "document_id").select("occurrence_id", "page_number", "filename")


@query("join_left_counts", f"with {PAGES} select d.id, d.tenant_id, count(p.id) as pages from ingestion_documents d left join pages p on p.document_id = d.id group by d.id, d.tenant_id")
def _(spark, d):
    n = pages(spark, d, "document_id").groupBy("document_id").agg(F.count("id").alias("pages"))  # folded before it is joined
    return documents(spark, d).select("id", "tenant_id").join(n, F.col("id") == F.col("document_id"), "left").select("id", "tenant_id", F.coalesce("pages", F.lit(0)).alias("pages"))


@query("join_left", f"with {PAGES}, {OCC} select o.id, o.status, p.page_number from occ o left join pages p on p.id = o.page_id and p.page_number <= 2")
def _(spark, d):
    p = pages(spark, d, "page_number").where("page_number <= 2").select(F.col("id").alias("page_id"), "page_number")
    return occurrences(spark, d, "page_id", "status").select("id", "status", "page_id").join(p, "page_id", "left").select("id", "status", "page_number")


@query("join_left_composite", f"with {OCC} select distinct o.tenant_id, o.document_id, d.state from occ o left join ingestion_documents d on d.tenant_id = o.tenant_id and d.id = o.document_id and d.state <> 'processed'")
def _(spark, d):
    s = documents(spark, d).where("state <> 'processed'").select("tenant_id", F.col("id").alias("document_id"), "state")
    return occurrences(spark, d, "tenant_id", "document_id").select("tenant_id", "document_id").distinct().join(s, ["tenant_id", "document_id"], "left")


@query("join_either_key", f"with {PAGES}, {OCC}, r as (select id, page_id as a, case when id % 3 = 0 then page_id + 1 end as b from occ), m as (select r.id, p.id as page from r join pages p on p.id = r.a or p.id = r.b) select r.id, m.page as page_id from r left join m on m.id = r.id")
def _(spark, d):
    r = occurrences(spark, d, "page_id").select("id", F.col("page_id").alias("a"), F.when(F.col("id") % 3 == 0, F.col("page_id") + 1).alias("b"))
    return either_key_join(r, pages(spark, d).select("id"), "id", "a", "b", "id").select("id", F.col("r_id").alias("page_id"))


@query("join_null_tolerant", f"with {PAGES} select d.id, p.id as page_id from ingestion_documents d left join (select * from pages where page_number = 2) p on p.document_id = d.id where p.classification = 'editorial' or p.id is null")
def _(spark, d):
    p = pages(spark, d, "document_id", "page_number", "classification").where("page_number = 2").select(F.col("id").alias("page_id"), "document_id", "classification")
    return documents(spark, d).select("id").join(p, F.col("id") == F.col("document_id"), "left").where((F.col("classification") == "editorial") | F.col("page_id").isNull()).select("id", "page_id")


@query("join_anti", f"with {OCC} select d.id from ingestion_documents d where not exists (select 1 from occ o where o.document_id = d.id)")
def _(spark, d):
    used = occurrences(spark, d, "document_id").select(F.col("document_id").alias("id"))
    return documents(spark, d).select("id").join(used, "id", "left_anti")


@query("join_semi", f"with {OCC} select d.id, d.filename from ingestion_documents d where d.id in (select document_id from occ where status = 'approved')")
def _(spark, d):
    used = occurrences(spark, d, "document_id", "status").where("status = 'approved'").select(F.col("document_id").alias("id"))
    return documents(spark, d).select("id", "filename").join(used, "id", "left_semi")


@query("join_aggregate_update", f"with {OCC}, n as (select document_id, count(*) as n, max(page_id) as last_page from occ group by document_id) select d.id, coalesce(n.n, 0) as occurrences, coalesce(n.last_page, -1) as last_page from ingestion_documents d left join n on n.document_id = d.id")
def _(spark, d):
    n = occurrences(spark, d, "document_id", "page_id").groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last_page"))
    return documents(spark, d).select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("occurrences"), F.coalesce("last_page", F.lit(-1)).alias("last_page"))


@query("join_next_greater", "with l as (select distinct tenant_id, id % 10 as level from ingestion_documents), v as (select id, tenant_id, id % 7 as last_level from ingestion_documents) select v.id, (select min(level) from l where l.tenant_id = v.tenant_id and l.level > v.last_level) as next_level from v")
def _(spark, d):
    x = documents(spark, d)
    levels = x.select("tenant_id", (F.col("id") % 10).alias("level")).distinct()
    return next_greater(x.select("id", "tenant_id", (F.col("id") % 7).alias("last_level")), levels, ["tenant_id"], "last_level", "level").select("id", "next_level")


@query("join_fingerprint_carry", "with a as (select distinct id, page_id, company, preview, status, created_at from ingestion_occurrences), f as (select *, left(sha256(concat_ws(chr(31), cast(page_id as varchar), coalesce(lower(trim(regexp_replace(company, '[ \t\r\n]+', ' ', 'g'))), ''), coalesce(lower(trim(regexp_replace(preview, '[ \t\r\n]+', ' ', 'g'))), ''))), 24) as fp from a), old as (select fp, arg_min(status, (created_at, coalesce(status, ''))) as status from f group by fp), new as (select distinct id, fp from f) select new.id, new.fp as fingerprint, coalesce(old.status, 'detected') as status from new left join old using (fp)")
def _(spark, d):
    parts = F.concat_ws("\u001f", F.col("page_id").cast("string"), F.coalesce(T.folded(F.col("company")), F.lit("")), F.coalesce(T.folded(F.col("preview")), F.lit("")))
    a = table(spark, d, "ingestion_occurrences").select("id", "page_id", "company", "preview", "status", "created_at").distinct().withColumn("fingerprint", F.left(F.sha2(parts, 256), F.lit(24)))
    old = a.groupBy("fingerprint").agg(F.min_by("status", F.struct("created_at", F.coalesce("status", F.lit("")))).alias("old"))
    return a.select("id", "fingerprint").distinct().join(old, "fingerprint", "left").select("id", "fingerprint", F.coalesce("old", F.lit("detected")).alias("status"))


_B = "boxed as (select id, page_id, cast(json_extract_string(bbox, '$.x') as double) as x, cast(json_extract_string(bbox, '$.y') as double) as y, cast(json_extract_string(bbox, '$.width') as double) as w, cast(json_extract_string(bbox, '$.height') as double) as h from occ where bbox is not null), b as (select * from boxed where x is not null and y is not null and w is not null and h is not null)"


def boxed(spark, d):
    get = lambda k: F.get_json_object("bbox", f"$.{k}").cast("double")
    return occurrences(spark, d, "page_id", "bbox").where("bbox is not null").select("id", "page_id", get("x").alias("x"), get("y").alias("y"), get("width").alias("w"), get("height").alias("h")).dropna()


@query("join_spatial_owner", f"with {OCC}, {_B} select a.id, arg_min(o.id, (o.w * o.h, o.id)) as owner_id from b a join b o on o.page_id = a.page_id and o.id <> a.id and a.x + a.w / 2 between o.x and o.x + o.w and a.y + a.h / 2 between o.y and o.y + o.h group by a.id")
def _(spark, d):
    b = boxed(spark, d)
    o = b.select("page_id", *[F.col(c).alias(f"o_{c}") for c in ("id", "x", "y", "w", "h")])
    inside = F.expr("o_id <> id and x + w / 2 between o_x and o_x + o_w and y + h / 2 between o_y and o_y + o_h")
    return b.join(o, "page_id").where(inside).groupBy("id").agg(F.min_by("o_id", F.struct(F.col("o_w") * F.col("o_h"), "o_id")).alias("owner_id"))


@query("join_box_overlap", f"with {OCC}, {_B} select a.id as left_id, c.id as right_id from b a join b c on a.page_id = c.page_id and a.id < c.id where greatest(least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x), 0) * greatest(least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y), 0) > 0.2 * least(a.w * a.h, c.w * c.h)")
def _(spark, d):
    b = boxed(spark, d)
    made = b.select("id", "page_id", box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("box"), (F.col("w") * F.col("h")).alias("size"))
    r = made.select(F.col("id").alias("right_id"), "page_id", F.col("box").alias("other"), F.col("size").alias("other_size"))
    share = intersection(F.col("box"), F.col("other")) > 0.2 * F.least("size", "other_size")
    return made.join(r, "page_id").where((F.col("id") < F.col("right_id")) & share).select(F.col("id").alias("left_id"), "right_id")


@query("join_one_edit", "with n as (select distinct normalized_name as n from companies where normalized_name <> '') select a.n as left_name, b.n as right_name from n a join n b on a.n < b.n and abs(length(a.n) - length(b.n)) <= 1 and levenshtein(a.n, b.n) <= 1")
def _(spark, d):
    """Names one edit apart share what is left of them after one deletion: an equi-join instead of all pairs."""
    n = table(spark, d, "companies").where("normalized_name <> ''").select(F.col("normalized_name").alias("name")).distinct()
    left = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.concat(F.substring("name", F.lit(1), i - 1), F.substring("name", i + 1, F.length("name"))))
    ways = n.select("name", F.explode(F.array_distinct(F.concat(left, F.array("name")))).alias("rest"))
    pairs = ways.select(F.col("name").alias("left_name"), "rest").join(ways.select(F.col("name").alias("right_name"), "rest"), "rest").where("left_name < right_name").select("left_name", "right_name").distinct()
    return pairs.where(within_one_edit(F.col("left_name"), F.col("right_name")))


@query("join_shared_feature", "with c as (select distinct id, normalized_name as n, unnest(string_split(contact_key, '|')) as part from companies where normalized_name is not null and contact_key is not null), f as (select distinct id, n, part from c where contains(part, '=')) select distinct a.id as left_id, b.id as right_id from f a join f b on a.n = b.n and a.part = b.part and a.id < b.id")
def _(spark, d):
    c = table(spark, d, "companies").where("normalized_name is not null and contact_key is not null").select("id", F.col("normalized_name").alias("n"), F.explode(F.split("contact_key", r"\|")).alias("part")).where("contains(part, '=')").distinct()
    return c.select(F.col("id").alias("left_id"), "n", "part").join(c.select(F.col("id").alias("right_id"), "n", "part"), ["n", "part"]).where("left_id < right_id").select("left_id", "right_id").distinct()


@query("join_handlers", "with h(event_type, handler) as (values ('click', 'count'), ('click', 'audit'), ('purchase', 'bill'), ('view', 'count')) select h.handler, count(*) as events from events e join h on h.event_type = e.event_type group by h.handler")
def _(spark, d):
    h = spark.createDataFrame([("click", "count"), ("click", "audit"), ("purchase", "bill"), ("view", "count")], "event_type string, handler string")
    return table(spark, d, "events").select("event_type").join(F.broadcast(h), "event_type").groupBy("handler").agg(F.count(F.lit(1)).alias("events"))  # four rows


@query("join_star", "select n_name, r_name, count(*) as customers, cast(sum(cast(c_acctbal as decimal(14, 2))) as decimal(24, 2)) as balance from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by n_name, r_name")
def _(spark, d):
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.sum(F.col("c_acctbal").cast("decimal(14,2)")).cast("decimal(24,2)").alias("balance"))
    return per.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "customers", "balance")


@query("sort_recent", "select id, created_at from ingestion_documents order by created_at desc, id limit 100")
def _(spark, d):
    return documents(spark, d).select("id", "created_at").orderBy(F.desc("created_at"), "id").limit(100)


@query("sort_score", f"with {PAGES} select id, ad_probability from pages order by ad_probability desc nulls last, id limit 500")
def _(spark, d):
    return pages(spark, d, "ad_probability").select("id", "ad_probability").orderBy(F.desc_nulls_last("ad_probability"), "id").limit(500)


@query("sort_keyset_page", "select id, filename from ingestion_documents where id > 40 order by id limit 25")
def _(spark, d):
    return documents(spark, d).where("id > 40").select("id", "filename").orderBy("id").limit(25)


@query("topk_per_group", f"with {OCC} select page_id, id, confidence from occ where confidence is not null qualify row_number() over (partition by page_id order by confidence desc, id) <= 2")
def _(spark, d):
    w = Window.partitionBy("page_id").orderBy(F.desc("confidence"), "id")
    return occurrences(spark, d, "page_id", "confidence").where("confidence is not null").select("page_id", "id", "confidence").withColumn("n", F.row_number().over(w)).where("n <= 2").drop("n")


@query("topk_best_variant", f"with {OCC} select document_id, arg_max(id, (coalesce(confidence, 0), -id)) as best_id, count(*) as variants from occ group by document_id")
def _(spark, d):
    score = F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("id"))
    return occurrences(spark, d, "document_id", "confidence").groupBy("document_id").agg(F.max_by("id", score).alias("best_id"), F.count(F.lit(1)).alias("variants"))


@query("topk_array", "with w as (select id, unnest(string_split(preview, ' ')) as word from (select distinct id, preview from ingestion_occurrences where preview is not null)), r as (select id, word, row_number() over (partition by id order by length(word) desc, word) as n from (select distinct id, word from w)) select id, string_agg(word, '|' order by n) as words from r where n <= 5 group by id")
def _(spark, d):
    o = table(spark, d, "ingestion_occurrences").where("preview is not null").select("id", "preview").distinct()
    ranked = F.transform(F.array_sort(F.transform(F.array_distinct(F.split("preview", " ")), lambda x: F.struct((-F.length(x)).alias("l"), x.alias("w")))), lambda x: x["w"])
    return o.select("id", F.array_join(F.slice(ranked, 1, 5), "|").alias("words"))


_TOK = "regexp_extract_all(lower({}), '([a-z0-9äöüß]+)')"


@query("set_difference_both_ways", f"with {PAGES}, o as (select distinct id, page_id, preview from ingestion_occurrences where preview is not null), j as (select o.id, list_distinct({_TOK.format('o.preview')}) as a, list_distinct({_TOK.format('p.text')}) as b from o join pages p on p.id = o.page_id where p.text is not null) select id, cast(len(list_filter(a, lambda x: not list_contains(b, x))) as integer) as new_words, cast(len(list_filter(b, lambda x: not list_contains(a, x))) as integer) as missing_words from j")
def _(spark, d):
    o = table(spark, d, "ingestion_occurrences").where("preview is not null").select("id", "page_id", "preview").distinct()
    p = pages(spark, d, "text").where("text is not null").select(F.col("id").alias("page_id"), "text")
    a, b = T.words(F.col("preview")), T.words(F.col("text"))
    return o.join(p, "page_id").select("id", F.size(F.array_except(a, b)).alias("new_words"), F.size(F.array_except(b, a)).alias("missing_words"))


@query("set_overlap", "with e as (select distinct id, evidence from ingestion_occurrences where evidence is not null) select id from e where list_has_any(evidence, ['logo', 'border'])")
def _(spark, d):
    e = table(spark, d, "ingestion_occurrences").where("evidence is not null").select("id", "evidence").distinct()
    return e.where(F.arrays_overlap("evidence", F.array(F.lit("logo"), F.lit("border")))).select("id")


@query("set_first_occurrence", "with f as (select filename, min(id) as id from ingestion_documents group by filename) select id, filename from f")
def _(spark, d):
    return documents(spark, d).groupBy("filename").agg(F.min("id").alias("id")).select("id", "filename")


@query("set_union_dedupe", "with u as (select lower(filename) as k, 'upload' as origin, 1 as rank from ingestion_documents where origin = 'upload' union all select lower(filename), 'discovery', 2 from ingestion_documents where origin = 'discovery' union all select lower(filename), 'other', 3 from ingestion_documents where origin not in ('upload', 'discovery')) select k as name, arg_min(origin, rank) as origin from u where k is not null group by k")
def _(spark, d):
    x = documents(spark, d).where("filename is not null")
    part = lambda cond, name, rank: x.where(cond).select(F.lower("filename").alias("name"), F.lit(name).alias("origin"), F.lit(rank).alias("rank"))
    u = part("origin = 'upload'", "upload", 1).unionByName(part("origin = 'discovery'", "discovery", 2)).unionByName(part("origin not in ('upload', 'discovery')", "other", 3))
    return u.groupBy("name").agg(F.min_by("origin", "rank").alias("origin"))


@query("set_backfill", "with x as (select id, filename, tenant_id, source_id, error from ingestion_documents where filename is not null) select filename, arg_min(source_id, id) filter (where source_id is not null) as source_id, arg_min(error, id) filter (where error is not null) as error from x group by filename")
def _(spark, d):
    x = documents(spark, d).where("filename is not null")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    return x.groupBy("filename").agg(first("source_id"), first("error"))


@query("set_multiset_difference", f"with {PAGES}, a as (select classification as c, count(*) as n from pages where page_number = 1 group by 1), b as (select classification as c, count(*) as n from pages where page_number = 2 group by 1) select coalesce(a.c, b.c) as class, coalesce(a.n, 0) - coalesce(b.n, 0) as excess from a full join b on a.c is not distinct from b.c")
def _(spark, d):
    count = lambda n, name: pages(spark, d, "page_number", "classification").where(F.col("page_number") == n).groupBy(F.col("classification").alias("class")).agg(F.count(F.lit(1)).alias(name))
    a, b = count(1, "a"), count(2, "b").withColumnRenamed("class", "other")
    return a.join(b, F.col("class").eqNullSafe(F.col("other")), "full").select(F.coalesce("class", "other").alias("class"), (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("excess"))


@query("set_ranked_merge", "with a as (select id, lower(origin) as k, 1 as r from ingestion_documents where state = 'failed'), b as (select id, lower(mime_type) as k, 2 as r from ingestion_documents where state = 'processed'), u as (select * from a union all select * from b) select k, min(r) as source_rank, arg_min(id, (r, id)) as first_id from u where k is not null group by k")
def _(spark, d):
    x = documents(spark, d)
    a = x.where("state = 'failed'").select("id", F.lower("origin").alias("k"), F.lit(1).alias("r"))
    b = x.where("state = 'processed'").select("id", F.lower("mime_type").alias("k"), F.lit(2).alias("r"))
    return a.unionByName(b).where("k is not null").groupBy("k").agg(F.min("r").alias("source_rank"), F.min_by("id", F.struct("r", "id")).alias("first_id"))


QUERIES, ORACLES = Q, O

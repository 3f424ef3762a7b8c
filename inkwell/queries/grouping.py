"""Aggregations and ordered (window) patterns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import signals as S
from inkwell.functions.geometry import box, suppress
from inkwell.operators.ordered import GENESIS, build_chain, latest, reserve_until, segments, verify_chain
from inkwell.plans.runtime import table
from inkwell.queries.joining import OCC, PAGES, boxed, documents, occurrences, pages

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return keep


def ledger(spark, d):
    """One row per id; the columns that matter here never differ between deliveries."""
    return table(spark, d, "ai_usage_ledger").select("id", "tenant_id", "cost_micros", "created_at").distinct()


LEDGER = "ledger as (select distinct id, tenant_id, cost_micros, created_at from ai_usage_ledger)"
money = lambda c: F.col(c).cast("decimal(14,2)")


@query("agg_sum_or_zero", "select o_orderkey, cast(coalesce(sum(case when l_returnflag = 'R' then cast(l_extendedprice as decimal(14, 2)) end), 0) as decimal(24, 2)) as returned from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def _(spark, d):
    r = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money("l_extendedprice")).alias("s"))
    return table(spark, d, "orders").select("o_orderkey").join(r, "o_orderkey", "left").select("o_orderkey", F.coalesce("s", F.lit(0)).cast("decimal(24,2)").alias("returned"))


@query("agg_exact_subtotal", "select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(12, 2))) as decimal(24, 2)) as quantity, cast(sum(cast(l_extendedprice as decimal(14, 2))) as decimal(24, 2)) as subtotal, count(*) as lines from lineitem group by l_returnflag, l_linestatus")
def _(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("decimal(24,2)").alias("quantity"), F.sum(money("l_extendedprice")).cast("decimal(24,2)").alias("subtotal"), F.count(F.lit(1)).alias("lines"))


@query("agg_max_of_part", "select tenant_id, max(try_cast(nullif(regexp_extract(filename, '([0-9]{4})', 1), '') as integer)) as last_year, max(year(created_at)) as last_created from ingestion_documents group by tenant_id")
def _(spark, d):
    year = F.expr("try_cast(nullif(regexp_extract(filename, '([0-9]{4})', 1), '') as int)")
    return documents(spark, d).groupBy("tenant_id").agg(F.max(year).alias("last_year"), F.max(F.year("created_at")).alias("last_created"))


@query("agg_argmax", "select max(event_id) as last_id, arg_max(event_type, (ts, event_id)) as last_type, max(ts) as last_ts from events")
def _(spark, d):
    return table(spark, d, "events").agg(F.max("event_id").alias("last_id"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("last_ts"))


@query("agg_having_single", "select filename from ingestion_documents where filename is not null group by filename having count(*) = 1")
def _(spark, d):
    return documents(spark, d).where("filename is not null").groupBy("filename").count().where("count = 1").select("filename")


@query("agg_ledger_cost", f"with {LEDGER} select tenant_id, cast(sum(cost_micros) as bigint) as cost, count(*) as calls from ledger group by tenant_id")
def _(spark, d):
    return ledger(spark, d).groupBy("tenant_id").agg(F.sum("cost_micros").alias("cost"), F.count(F.lit(1)).alias("calls"))


@query("agg_per_document", f"with {OCC} select d.id, count(o.id) as ads from ingestion_documents d left join occ o on o.document_id = d.id group by d.id")
def _(spark, d):
    n = occurrences(spark, d, "document_id").groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return documents(spark, d).select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("ads"))


@query("agg_distinct_and_list", f"with {OCC} select document_id, count(distinct page_id) as pages, array_to_string(list_sort(list_distinct(list(page_id))), ',') as page_ids from occ group by document_id")
def _(spark, d):
    o = occurrences(spark, d, "document_id", "page_id").select("document_id", "page_id").distinct()
    return o.groupBy("document_id").agg(F.count("page_id").alias("pages"), F.array_join(F.array_sort(F.collect_set("page_id")), ",").alias("page_ids"))


@query("agg_mode_with_tie", f"with {OCC}, g as (select document_id, coalesce(status, '') as status, count(*) as n, max(coalesce(confidence, 0)) as c from occ group by 1, 2) select document_id, arg_max(status, (n, c, status)) as status, max(n) as votes from g group by document_id")
def _(spark, d):
    g = occurrences(spark, d, "document_id", "status", "confidence").groupBy("document_id", F.coalesce("status", F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("c"))
    return g.groupBy("document_id").agg(F.max_by("status", F.struct("n", "c", "status")).alias("status"), F.max("n").alias("votes"))


@query("agg_consensus_box", f"with {OCC}, b as (select document_id, cast(json_extract_string(bbox, '$.x') as double) as x, cast(json_extract_string(bbox, '$.y') as double) as y, confidence as c, id % 5 as run from occ where bbox is not null), g as (select document_id, sum(cast(round(x * 1000) as bigint)) as x, sum(cast(round(y * 1000) as bigint)) as y, count(*) as n, count(distinct run) / 5.0 as f, avg(c) as c from b where x is not null and y is not null and c is not null group by document_id) select document_id, cast((2 * x + n) // (2 * n) as bigint) as left_px, cast((2 * y + n) // (2 * n) as bigint) as top_px, round((1 - 1.0 / 6) * f + (1.0 / 6) * c, 6) as confidence from g where f > 0.5")
def _(spark, d):
    get = lambda k: F.get_json_object("bbox", f"$.{k}").cast("double")
    b = occurrences(spark, d, "document_id", "bbox", "confidence").where("bbox is not null").select("document_id", get("x").alias("x"), get("y").alias("y"), F.col("confidence").alias("c"), (F.col("id") % 5).alias("run")).dropna()
    g = b.groupBy("document_id").agg(F.sum(F.round(F.col("x") * 1000).cast("bigint")).alias("x"), F.sum(F.round(F.col("y") * 1000).cast("bigint")).alias("y"), F.count(F.lit(1)).alias("n"), (F.count_distinct("run") / 5.0).alias("f"), F.avg("c").alias("c"))
    pixel = lambda c: F.floor((2 * F.col(c) + F.col("n")) / (2 * F.col("n")))  # whole thousandths, halves up
    return g.where("f > 0.5").select("document_id", pixel("x").alias("left_px"), pixel("y").alias("top_px"), F.round((1 - 1 / 6) * F.col("f") + (1 / 6) * F.col("c"), 6).alias("confidence"))


@query("agg_place_mentions", f"with {PAGES}, m as (select document_id, unnest(regexp_extract_all(text, '{S.MENTION}', 1)) as place from pages where text is not null), g as (select document_id, place, count(*) as n from m group by 1, 2) select document_id, place, n as mentions from g qualify row_number() over (partition by document_id order by n desc, place) <= 3")
def _(spark, d):
    m = pages(spark, d, "document_id", "text").where("text is not null").select("document_id", F.explode(F.regexp_extract_all("text", F.lit(S.MENTION), F.lit(1))).alias("place"))
    w = Window.partitionBy("document_id").orderBy(F.desc("mentions"), "place")
    return m.groupBy("document_id", "place").agg(F.count(F.lit(1)).alias("mentions")).withColumn("n", F.row_number().over(w)).where("n <= 3").drop("n")


@query("agg_repeated_values", "with c as (select distinct id, unnest(string_split(contact_key, '|')) as part from companies where contact_key is not null), v as (select id, unnest(string_split(regexp_replace(part, '^[a-z]+=', ''), ',')) as v from c where contains(part, '=')) select v as value, count(distinct id) as companies from v group by v having count(distinct id) >= 2")
def _(spark, d):
    c = table(spark, d, "companies").where("contact_key is not null").select("id", F.explode(F.split("contact_key", r"\|")).alias("part")).where("contains(part, '=')")
    v = c.select("id", F.explode(F.split(F.regexp_replace("part", "^[a-z]+=", ""), ",")).alias("value")).distinct()
    return v.groupBy("value").agg(F.count(F.lit(1)).alias("companies")).where("companies >= 2")


@query("agg_histogram_share", "with h as (select label, count(*) as n from embeddings group by label), t as (select count(*) as t from embeddings) select label, n as members, round(n / t.t, 6) as share from h, t order by n desc, label limit 5")
def _(spark, d):
    h = table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    total = h.agg(F.sum("members").alias("t"))  # one row
    return h.join(F.broadcast(total)).select("label", "members", F.round(F.col("members") / F.col("t"), 6).alias("share")).orderBy(F.desc("members"), "label").limit(5)


@query("agg_grid_coverage", f"with {OCC}, x as (select page_id, cast(json_extract_string(bbox, '$.x') as double) as x, cast(json_extract_string(bbox, '$.y') as double) as y, cast(json_extract_string(bbox, '$.width') as double) as w, cast(json_extract_string(bbox, '$.height') as double) as h from occ where bbox is not null), b as (select * from x where x is not null and y is not null and w is not null and h is not null), g as (select unnest(range(20)) as i), cells as (select c.i / 20.0 as cx, r.i / 20.0 as cy, c.i * 20 + r.i as cell from g c, g r) select page_id, count(distinct cell) as covered from b join cells on greatest(least(cx + 0.05, x + w) - greatest(cx, x), 0) * greatest(least(cy + 0.05, y + h) - greatest(cy, y), 0) >= 0.0025 * 0.25 + 1e-9 group by page_id")
def _(spark, d):
    b = boxed(spark, d)
    # only the cells a box touches are made, from its own edges
    span = lambda lo, size: F.sequence(F.greatest(F.lit(0), F.floor(F.col(lo) * 20)).cast("int"), F.least(F.lit(19), F.floor((F.col(lo) + F.col(size)) * 20)).cast("int"))
    cells = b.withColumn("i", F.explode(span("x", "w"))).withColumn("j", F.explode(span("y", "h")))
    share = F.greatest(F.least(F.col("i") / 20 + 0.05, F.col("x") + F.col("w")) - F.greatest(F.col("i") / 20, F.col("x")), F.lit(0)) * F.greatest(F.least(F.col("j") / 20 + 0.05, F.col("y") + F.col("h")) - F.greatest(F.col("j") / 20, F.col("y")), F.lit(0))
    return cells.where(share >= 0.0025 * 0.25 + 1e-9).select("page_id", (F.col("i") * 20 + F.col("j")).alias("cell")).distinct().groupBy("page_id").agg(F.count(F.lit(1)).alias("covered"))


@query("agg_conditional_counts", "select tenant_id, count(*) as depth, count(*) filter (where state = 'failed') as failed, count(*) filter (where state = 'processed') as processed, count(*) filter (where error is not null) as with_error from ingestion_documents group by tenant_id")
def _(spark, d):
    return documents(spark, d).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("depth"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "processed").alias("processed"), F.count_if(F.col("error").isNotNull()).alias("with_error"))


@query("agg_max_severity", f"with {OCC}, s as (select document_id, case when confidence < 0.4 then 2 when confidence < 0.6 or confidence is null then 1 else 0 end as r from occ) select document_id, case max(r) when 2 then 'abweichung' when 1 then 'unsicher' else 'bestanden' end as verdict from s group by document_id")
def _(spark, d):
    r = F.when(F.col("confidence") < 0.4, 2).when((F.col("confidence") < 0.6) | F.col("confidence").isNull(), 1).otherwise(0)
    return occurrences(spark, d, "document_id", "confidence").groupBy("document_id").agg(F.element_at(F.array(F.lit("bestanden"), F.lit("unsicher"), F.lit("abweichung")), F.max(r) + 1).alias("verdict"))


@query("agg_reason_list", f"with {OCC}, r as (select document_id, id, unnest(list_filter([case when bbox is null then 'no box' end, case when confidence < 0.5 then 'low confidence' end, case when image_key is null then 'no image' end], lambda x: x is not null)) as reason from occ), f as (select document_id, reason, min(id) as first_id from r group by 1, 2) select document_id, string_agg(reason, '; ' order by first_id, reason) as reasons from f group by document_id")
def _(spark, d):
    reasons = F.array_compact(F.array(F.when(F.col("bbox").isNull(), "no box"), F.when(F.col("confidence") < 0.5, "low confidence"), F.when(F.col("image_key").isNull(), "no image")))
    first = occurrences(spark, d, "document_id", "bbox", "image_key", "confidence").select("document_id", "id", F.explode(reasons).alias("reason")).groupBy("document_id", "reason").agg(F.min("id").alias("first_id"))
    return first.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_id", "reason"))), lambda x: x["reason"]), "; ").alias("reasons"))


@query("agg_first_n_extent", f"with {OCC}, x as (select id, page_id, cast(json_extract_string(bbox, '$.x') as double) as x, cast(json_extract_string(bbox, '$.width') as double) as w from occ where bbox is not null), r as (select *, row_number() over (partition by page_id order by id) as n from x where x is not null and w is not null) select page_id, min(x) as left_edge, max(x + w) as right_edge from r where n <= 3 group by page_id")
def _(spark, d):
    get = lambda k: F.get_json_object("bbox", f"$.{k}").cast("double")
    x = occurrences(spark, d, "page_id", "bbox").where("bbox is not null").select("id", "page_id", get("x").alias("x"), get("width").alias("w")).dropna()
    w = Window.partitionBy("page_id").orderBy("id")
    return x.withColumn("n", F.row_number().over(w)).where("n <= 3").groupBy("page_id").agg(F.min("x").alias("left_edge"), F.max(F.col("x") + F.col("w")).alias("right_edge"))


@query("agg_rollup", "select coalesce(origin, 'all') as origin, coalesce(state, 'all') as state, count(*) as n from ingestion_documents where origin is not null and state is not null group by rollup (origin, state)")
def _(spark, d):
    g = documents(spark, d).where("origin is not null and state is not null").rollup("origin", "state").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.coalesce("origin", F.lit("all")).alias("origin"), F.coalesce("state", F.lit("all")).alias("state"), "n")


_CHAIN = "e as (select user_id, event_id, event_type, cast(epoch_us(ts) as varchar) as t from events), s as (select *, row_number() over (partition by user_id order by event_id) as seq from e)"


def chain(spark, d):
    """A chain per user, each stored hash made of the entry and the previous entry's content; every 97th id's content was changed afterwards."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("t"))
    own = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "t"), 256)
    e = e.withColumn("seq", F.row_number().over(w)).withColumn("prev_hash", F.coalesce(F.lag(own).over(w), F.lit(GENESIS)))
    return e


@query("window_chain_check", f"with {_CHAIN}, h as (select *, sha256(concat_ws('|', cast(event_id as varchar), event_type, t)) as hash from s), p as (select *, coalesce(lag(hash) over (partition by user_id order by seq), repeat('0', 64)) as prev, case when event_id % 97 = 0 then sha256('x') else coalesce(lag(hash) over (partition by user_id order by seq), repeat('0', 64)) end as stored from h) select user_id, count(*) as entries, min(case when stored <> prev then seq end) as broken_at from p group by user_id")
def _(spark, d):
    e = chain(spark, d).withColumn("stored", F.when(F.col("event_id") % 97 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("prev_hash")))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("entries"), F.min(F.when(F.col("stored") != F.col("prev_hash"), F.col("seq"))).cast("bigint").alias("broken_at"))


@query("window_chain_verify")
def _(spark, d):
    """Chains built link by link, some entries changed afterwards, and where each breaks; SQL would need recursion to build them."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("t"))
    built = build_chain(e, ["user_id"], "event_id", ["event_type", "t"])
    changed = built.withColumn("event_type", F.when(F.col("event_id") % 997 == 0, "changed").otherwise(F.col("event_type")))
    return verify_chain(changed, ["user_id"], "event_id", ["event_id", "event_type", "t"])


@query("window_numbering", "select id, tenant_id, 'DOC-' || cast(year(created_at) as varchar) || '-' || lpad(cast(row_number() over (partition by tenant_id, year(created_at) order by created_at, id) as varchar), 4, '0') as number from ingestion_documents")
def _(spark, d):
    w = Window.partitionBy("tenant_id", F.year("created_at")).orderBy("created_at", "id")
    return documents(spark, d).select("id", "tenant_id", F.format_string("DOC-%d-%04d", F.year("created_at"), F.row_number().over(w)).alias("number"))


@query("window_positions", "with w as (select id, unnest(string_split(filename, '-')) as part, generate_subscripts(string_split(filename, '-'), 1) as position from ingestion_documents where filename is not null) select id, cast(position as integer) as position, part from w")
def _(spark, d):
    return documents(spark, d).where("filename is not null").select("id", F.posexplode(F.split("filename", "-")).alias("p", "part")).select("id", (F.col("p") + 1).alias("position"), "part")


@query("window_latest", "select source_id, id, state from ingestion_documents where source_id is not null qualify row_number() over (partition by source_id order by created_at desc, id desc) = 1")
def _(spark, d):
    return latest(documents(spark, d).where("source_id is not null").select("source_id", "id", "state", "created_at"), ["source_id"], [F.desc("created_at"), F.desc("id")]).drop("created_at")


@query("window_running", "with l as (select l_orderkey, l_linenumber, cast(sum(cast(l_extendedprice as decimal(14, 2))) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice rows unbounded preceding) as decimal(24, 2)) as paid, cast(o_totalprice as decimal(14, 2)) as total from lineitem join orders on o_orderkey = l_orderkey) select l_orderkey, l_linenumber, paid, case when paid >= total then 'paid' else 'partially_paid' end as status from l")
def _(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), money("o_totalprice").alias("total"))
    x = table(spark, d, "lineitem").join(o, "l_orderkey").withColumn("paid", F.sum(money("l_extendedprice")).over(w).cast("decimal(24,2)"))
    return x.select("l_orderkey", "l_linenumber", "paid", F.when(F.col("paid") >= F.col("total"), "paid").otherwise("partially_paid").alias("status"))


@query("window_keep_latest_n", f"with {OCC} select company, id from occ where company is not null qualify row_number() over (partition by company order by created_at desc, id desc) <= 20")
def _(spark, d):
    w = Window.partitionBy("company").orderBy(F.desc("created_at"), F.desc("id"))
    return occurrences(spark, d, "company", "created_at").where("company is not null").select("company", "id", "created_at").withColumn("n", F.row_number().over(w)).where("n <= 20").select("company", "id")


@query("window_next", f"with {OCC} select id, lead(id) over (partition by document_id order by id) as next_id from occ where status = 'detected'")
def _(spark, d):
    w = Window.partitionBy("document_id").orderBy("id")
    return occurrences(spark, d, "document_id", "status").where("status = 'detected'").select("id", F.lead("id").over(w).alias("next_id"))


@query("window_greedy_suppression")
def _(spark, d):
    """Boxes of a page that survive greedy suppression in order of confidence; SQL would need recursion per page."""
    b = boxed(spark, d).join(occurrences(spark, d, "page_id", "confidence").select("id", "confidence"), "id")
    made = box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    item = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("order"), "id", *[made[k].alias(k) for k in ("left", "top", "right", "bottom")])
    pages_ = b.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("boxes"))  # the adverts of one page
    return pages_.select("page_id", F.explode(suppress(F.col("boxes"), 0.3)).alias("b")).select("page_id", F.col("b.id").alias("id"))


@query("window_sessions", "with g as (select user_id, event_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as fresh from events), s as (select user_id, event_id, ts, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as segment from g) select user_id, cast(segment as bigint) as segment, count(*) as events, min(ts) as first_ts, max(ts) as last_ts from s group by user_id, segment")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("interval 30 minutes")
    s = segments(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], gap)
    return s.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("window_row_clusters", f"with {OCC}, x as (select id, page_id, cast(json_extract_string(bbox, '$.y') as double) as y from occ where bbox is not null), g as (select *, case when y - lag(y) over (partition by page_id order by y, id) <= 0.05 then 0 else 1 end as fresh from x where y is not null), s as (select id, page_id, sum(fresh) over (partition by page_id order by y, id rows unbounded preceding) as r from g) select page_id, id, cast(r as bigint) as row_number from s")
def _(spark, d):
    x = occurrences(spark, d, "page_id", "bbox").where("bbox is not null").select("id", "page_id", F.get_json_object("bbox", "$.y").cast("double").alias("y")).dropna()
    w = Window.partitionBy("page_id").orderBy("y", "id")
    return segments(x, ["page_id"], ["y", "id"], F.col("y") - F.lag("y").over(w) > 0.05).select("page_id", "id", F.col("segment").alias("row_number"))


@query("window_priority_value", "select id, coalesce(nullif(regexp_extract(filename, '(20[0-9]{2})', 1), ''), nullif(regexp_extract(storage_key, '(20[0-9]{2})', 1), ''), cast(year(created_at) as varchar)) as period, case when regexp_extract(filename, '(20[0-9]{2})', 1) <> '' then 'filename' when regexp_extract(storage_key, '(20[0-9]{2})', 1) <> '' then 'key' else 'created' end as source from ingestion_documents")
def _(spark, d):
    year = lambda c: F.nullif(F.regexp_extract(c, "(20[0-9]{2})", 1), F.lit(""))
    ranked = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("period"), F.lit(s).alias("source"))) for v, s in ((year("filename"), "filename"), (year("storage_key"), "key"), (F.year("created_at").cast("string"), "created"))])
    return documents(spark, d).select("id", ranked.alias("r")).select("id", "r.period", "r.source")


@query("window_reservation")
def _(spark, d):
    """Charges of a tenant's day taken in order until the next one's bound would pass the stop; the stop makes it a fold. Each bound is at
    least 500, so no more than 200 charges fit and the 201st is the last one that can matter: the fold's array is bounded."""
    stop, least = 100_000, 500
    w = Window.partitionBy("tenant_id", "day").orderBy("created_at", "id")
    first = ledger(spark, d).where("cost_micros is not null").withColumn("day", F.to_date("created_at")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= stop // least + 1)
    charge = F.struct("n", (F.col("cost_micros") + least).alias("bound"), F.col("cost_micros").alias("reported"))
    per = first.groupBy("tenant_id", "day").agg(F.array_sort(F.collect_list(charge)).alias("charges"))
    return per.select("tenant_id", F.date_format("day", "yyyy-MM-dd").alias("day"), reserve_until(F.col("charges"), stop).alias("r")).select("tenant_id", "day", "r.used", "r.taken", "r.stopped")


QUERIES, ORACLES = Q, O

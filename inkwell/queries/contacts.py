"""Channels, forms, markers, regions, provenance and nested values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import channels as C
from inkwell.functions import signals as S
from inkwell.functions import text as T
from inkwell.plans.runtime import table
from inkwell.queries.joining import OCC, PAGES, documents, occurrences, pages
from inkwell.queries.scalars import COMP, PREV, companies, previews

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return keep


_VALUES = [("Fax 0211 123456",), ("www.facebook.com/haus",), ("https://instagram.com/x",), ("www.haus.de",), ("0211/9999",), ("xing.de/p",), ("Tel.: 0211 55",), ("notfacebook.com",)]


@query("channel_kinds", "with v(value) as (values " + ", ".join(f"('{v}')" for (v,) in _VALUES) + "), k as (select value, case when starts_with(lower(value), 'fax') then 'fax' " + " ".join(f"when regexp_matches(lower(value), '(^|[^a-z0-9_-]){h}\\.') then '{h}'" for h in C.HOSTS) + " when contains(lower(value), 'www.') or contains(lower(value), '.de') then 'website' else 'phone' end as channel from v) select value, channel, case when channel in ('phone', 'fax') then case channel when 'phone' then 'T ' else 'F ' end || regexp_replace(value, '(?i)^\\s*(telefax|fax|telefon|tel\\.?|phone)\\s*[:-]?\\s*', '') when channel = 'website' then value else regexp_replace(trim(value), '(?i)^([a-z]+://)?(www\\.)?', '') end as shown from k")
def _(spark, d):
    v = spark.createDataFrame(_VALUES, "value string").withColumn("channel", C.kind_of(F.col("value")))
    return v.withColumn("shown", C.shown(F.col("channel"), F.col("value")))


@query("channel_lines", f"with {PREV}, l as (select id, unnest(string_split(preview, chr(10))) as line from o), n as (select id, list_filter(regexp_extract_all(regexp_replace(line, '[\\s,;()<>]+', ' ', 'g'), '([0-9][0-9 ./-]*[0-9])'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 6) as n, line from l where regexp_matches(line, '^Tel')) select id, case when contains(lower(line), 'fax') then 'fax' else 'phone' end as channel, 'digits:' || regexp_replace(n[1], '[^0-9]', '', 'g') as key from n where len(n) > 0")
def _(spark, d):
    line = previews(spark, d).select("id", F.explode(F.split("preview", "\n")).alias("line")).where("startswith(line, 'Tel')")
    c = line.select("id", F.explode(C.channels(F.col("line"))).alias("c"))
    return c.select("id", "c.channel", C.normal_key(F.col("c.channel"), F.col("c.value")).alias("key"))


@query("channel_only_lines", f"with {PREV}, l as (select id, unnest(string_split(preview, chr(10))) as line from o) select count(*) filter (where regexp_matches(line, '^Tel\\.?:? *[0-9+() /-]+$') and length(regexp_replace(line, '[^0-9]', '', 'g')) >= 6) as lines from l where regexp_matches(line, '^Tel')")
def _(spark, d):
    line = previews(spark, d).select(F.explode(F.split("preview", "\n")).alias("line")).where("startswith(line, 'Tel')")
    return line.agg(F.count_if(C.only_contacts(F.col("line"))).alias("lines"))


@query("channel_dedupe", f"with {COMP}, k as (select id, unnest(string_split(contact_key, '|')) as part from comp where contact_key is not null), v as (select id, split_part(part, '=', 1) as kind, unnest(string_split(split_part(part, '=', 2), ',')) as v from k where contains(part, '=')), n as (select id, case kind when 'phone' then 'digits:' || regexp_replace(v, '[^0-9]', '', 'g') when 'email' then 'email:' || v else 'address:' || regexp_replace(v, '^www\\.', '') end as key from v) select key, min(id) as first_id, count(distinct id) as companies from n group by key")
def _(spark, d):
    k = companies(spark, d, "contact_key").where("contact_key is not null").select("id", F.explode(F.split("contact_key", r"\|")).alias("part")).where("contains(part, '=')")
    v = k.select("id", F.substring_index("part", "=", 1).alias("kind"), F.explode(F.split(F.substring_index("part", "=", -1), ",")).alias("v"))
    n = v.select("id", C.normal_key(F.col("kind"), F.col("v")).alias("key")).distinct()
    return n.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("companies"))


@query("channel_block", f"with {PREV}, l as (select id, unnest(string_split(preview, chr(10))) as line, generate_subscripts(string_split(preview, chr(10)), 1) as pos from o), k as (select id, pos, regexp_matches(line, '[0-9]{{5}} [A-ZÄÖÜ]') or starts_with(line, 'Tel') as hit from l), g as (select *, sum(case when hit then 0 else 1 end) over (partition by id order by pos rows unbounded preceding) as run from k) select id, cast(min(pos) as integer) as first_line, cast(count(*) as bigint) as lines from g where hit group by id, run")
def _(spark, d):
    line = previews(spark, d).select("id", F.posexplode(F.split("preview", "\n")).alias("p", "line"))
    hit = F.col("line").rlike("[0-9]{5} [A-ZÄÖÜ]") | F.col("line").startswith("Tel")
    w = Window.partitionBy("id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    g = line.select("id", "p", hit.alias("hit")).withColumn("run", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(w))
    return g.where("hit").groupBy("id", "run").agg((F.min("p") + 1).alias("first_line"), F.count(F.lit(1)).alias("lines")).drop("run")


_FORMS = [(1, "Firma: Haus GmbH\nStraße; Am Weg 3\nPLZ/Ort | 12345 Ort am See\nTel.: 0211 55\nE-Mail:\nFirma: zweite"), (2, "nichts davon"), (3, "")]


@query("form_label_rows", "select * from (values (1, 'company', 'Haus GmbH'), (1, 'street', 'Am Weg 3'), (1, 'postal_city', '12345 Ort am See'), (1, 'phone', '0211 55')) t(id, field, value)")
def _(spark, d):
    return spark.createDataFrame(_FORMS, "id int, text string").select("id", F.explode(C.form_rows(F.col("text"))).alias("field", "value"))


_EDGE = "'([^a-zäöüß0-9_])d\\s*i\\s*e([^a-zäöüß0-9_])', '\\1\\2', 'g')"


@query("text_marker_removed", f"with {PREV} select id, trim(regexp_replace(regexp_replace(regexp_replace(' ' || lower(preview) || ' ', {_EDGE}, {_EDGE}, '[ \t\r\n]+', ' ', 'g')) as rest from o")
def _(spark, d):
    return previews(spark, d).select("id", C.without_marker(F.col("preview"), "die").alias("rest"))


@query("text_region_counts", f"with {PAGES}, m as (select document_id, unnest(regexp_extract_all(text, '{S.MENTION}', 1)) as place from pages where text is not null), g as (select document_id, place, count(*) as n from m group by 1, 2), b as (select document_id, arg_max(place, (n, place)) as place, max(n) as n from g group by 1) select document_id, place, n as mentions, case when n > 1 then 0.78 else 0.52 end as confidence from b")
def _(spark, d):
    m = pages(spark, d, "document_id", "text").where("text is not null").select("document_id", F.explode(F.regexp_extract_all("text", F.lit(S.MENTION), F.lit(1))).alias("place"))
    g = m.groupBy("document_id", "place").agg(F.count(F.lit(1)).alias("n"))
    b = g.groupBy("document_id").agg(F.max_by("place", F.struct("n", "place")).alias("place"), F.max("n").alias("mentions"))
    return b.withColumn("confidence", F.when(F.col("mentions") > 1, 0.78).otherwise(0.52).cast("double"))


@query("text_region_source", f"with {PAGES}, f as (select document_id, arg_min(text, id) as t from pages where page_number = 1 and text is not null group by 1), x as (select d.id, nullif(regexp_extract(d.filename, '{S.PLACE}', 1), '') as a, nullif(regexp_extract(f.t, '{S.PLACE}', 1), '') as b from ingestion_documents d left join f on f.document_id = d.id) select id, coalesce(a, b) as place, case when a is not null then 'filename' when b is not null then 'title-page' end as source, a is not null and b is not null and a = b as agree from x")
def _(spark, d):
    first = pages(spark, d, "document_id", "page_number", "text").where("page_number = 1 and text is not null").groupBy("document_id").agg(F.min_by("text", "id").alias("t"))
    place = lambda c: F.nullif(F.regexp_extract(c, S.PLACE, 1), F.lit(""))
    x = documents(spark, d).select("id", "filename").join(first, F.col("id") == F.col("document_id"), "left").select("id", place("filename").alias("a"), place("t").alias("b"))
    return x.select("id", F.coalesce("a", "b").alias("place"), F.when(F.col("a").isNotNull(), "filename").when(F.col("b").isNotNull(), "title-page").alias("source"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("agree"))


@query("json_provenance", f"with {OCC} select id, coalesce(nullif(company, 'Unbekannte Firma'), nullif(trim(string_split(preview, chr(10))[1]), ''), 'unknown') as company, case when company is not null and company <> 'Unbekannte Firma' then 'vision' when trim(string_split(preview, chr(10))[1]) <> '' then 'text_layer' else 'default' end as source from occ")
def _(spark, d):
    ladder = [(F.nullif(F.col("company"), F.lit("Unbekannte Firma")), "vision"), (F.nullif(F.trim(F.split("preview", "\n")[0]), F.lit("")), "text_layer"), (F.lit("unknown"), "default")]
    first = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("company"), F.lit(s).alias("source"))) for v, s in ladder])
    return occurrences(spark, d, "company", "preview").select("id", first.alias("f")).select("id", "f.company", "f.source")


@query("json_leaves", f"with recursive {COMP}, r(id, field, v, depth) as (select id, '', try_cast(canonical_fields_json as json), 0 from comp where try_cast(canonical_fields_json as json) is not null union all select r.id, coalesce(lower(k.key), r.field), k.value, r.depth + 1 from r, (select unnest(json_keys(r.v)) as key, json_extract(r.v, '$.\"' || unnest(json_keys(r.v)) || '\"') as value where json_type(r.v) = 'OBJECT' union all select null, unnest(cast(r.v as json[])) where json_type(r.v) = 'ARRAY') k where json_type(r.v) in ('OBJECT', 'ARRAY')) select field, count(*) as n from r where json_type(v) not in ('OBJECT', 'ARRAY', 'NULL') group by field")
def _(spark, d):
    return C.leaves(companies(spark, d, "canonical_fields_json").where("canonical_fields_json is not null"), "id", "canonical_fields_json").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query("math_affine", "with m as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as a, l_discount as b, l_tax as c, l_quantity / 2 as d, 10.0 as e, 20.0 as f from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(e, a + e, c + e, a + c + e), 6) as left_edge, round(greatest(f, b + f, d + f, b + d + f), 6) as top_edge from m")
def _(spark, d):
    a, b, c, dd, e, f = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 2, F.lit(10.0), F.lit(20.0)
    at = lambda x, y: (a * x + c * y + e, b * x + dd * y + f)
    points = [at(x, y) for x in (0, 1) for y in (0, 1)]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.least(*[p[0] for p in points]), 6).alias("left_edge"), F.round(F.greatest(*[p[1] for p in points]), 6).alias("top_edge"))


@query("agg_health", "with h as (select tenant_id, state, count(*) as n from ingestion_documents where state is not null group by 1, 2) select tenant_id, string_agg(state || '=' || cast(n as varchar), ',' order by state) as states, bool_or(state = 'failed') as unhealthy from h group by tenant_id")
def _(spark, d):
    h = documents(spark, d).where("state is not null").groupBy("tenant_id", "state").agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("tenant_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("state", "n"))), lambda x: F.concat(x["state"], F.lit("="), x["n"].cast("string"))), ",").alias("states"), F.bool_or(F.col("state") == "failed").alias("unhealthy"))


@query("flow_compare_report", f"with {PAGES}, o as (select distinct id, page_id, preview from ingestion_occurrences where preview is not null), w as (select o.id, list_distinct(regexp_extract_all(lower(o.preview), '([a-z0-9äöüß]+)')) as a, list_distinct(regexp_extract_all(lower(coalesce(p.text, '')), '([a-z0-9äöüß]+)')) as b from o left join pages p on p.id = o.page_id), c as (select id, len(list_filter(a, lambda x: not list_contains(b, x))) as missing, len(a) as n from w) select id, cast(missing as integer) as missing, case when missing = 0 then 'bestanden' when missing * 2 < n then 'unsicher' else 'abweichung' end as verdict from c")
def _(spark, d):
    p = pages(spark, d, "text").select(F.col("id").alias("page_id"), "text")
    o = table(spark, d, "ingestion_occurrences").where("preview is not null").select("id", "page_id", "preview").distinct().join(p, "page_id", "left")
    a, b = F.array_distinct(T.words(F.col("preview"))), T.words(F.coalesce("text", F.lit("")))
    c = o.select("id", F.size(F.array_except(a, b)).alias("missing"), F.size(a).alias("n"))
    return c.select("id", "missing", F.when(F.col("missing") == 0, "bestanden").when(F.col("missing") * 2 < F.col("n"), "unsicher").otherwise("abweichung").alias("verdict"))


QUERIES, ORACLES = Q, O

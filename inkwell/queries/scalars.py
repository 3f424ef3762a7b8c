"""Scalar functions over text, numbers, geometry, dates, arrays and JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from inkwell.functions import exact as X
from inkwell.functions import signals as S
from inkwell.functions import text as T
from inkwell.functions.geometry import area, box, iou, pad, to_pixels, union
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


def companies(spark, d, *columns):
    """One row per company; repeated rows are equal."""
    return table(spark, d, "companies").select("id", *columns).distinct()


COMP = "comp as (select distinct * from companies)"
PREV = "o as (select distinct id, company, preview from ingestion_occurrences where preview is not null)"


def previews(spark, d):
    return table(spark, d, "ingestion_occurrences").where("preview is not null").select("id", "company", "preview").distinct()


_PLAIN = f"translate({{}}, '{T.ACCENTED}', '{T.BASE}')"
_NORM = f"trim(regexp_replace(lower(regexp_replace({_PLAIN}, '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


@query("text_normalize_name", f"with {COMP} select id, {_NORM.format('name')} as normal from comp where name is not null")
def _(spark, d):
    return companies(spark, d, "name").where("name is not null").select("id", T.normalize_name(F.col("name")).alias("normal"))


@query("text_contact_key", f"with {COMP}, c as (select id, try_cast(canonical_fields_json as json) as j from comp where try_cast(canonical_fields_json as json) is not null and json_type(try_cast(canonical_fields_json as json)) = 'OBJECT') select id, lower(trim(coalesce(json_extract_string(j, '$.street'), ''))) || '|' || lower(trim(coalesce(json_extract_string(j, '$.zip'), ''))) || '|' || lower(trim(coalesce(json_extract_string(j, '$.city'), ''))) as key from c where json_type(j, '$.street') = 'VARCHAR' and json_type(j, '$.zip') = 'VARCHAR' and json_type(j, '$.city') = 'VARCHAR'")
def _(spark, d):
    get = lambda k: F.expr(f"try_variant_get(j, '$.{k}')")
    c = companies(spark, d, "contact_key", "canonical_fields_json").select("id", F.try_parse_json("canonical_fields_json").alias("j"))
    typed = c.where(reduce(lambda a, b: a & b, [F.schema_of_variant(get(k)) == "STRING" for k in ("street", "zip", "city")]))
    part = lambda k: get(k).cast("string")
    return typed.select("id", T.contact_key(part("street"), part("zip"), part("city")).alias("key"))


@query("text_form_label", f"with {COMP} select id, regexp_replace(lower(translate(replace(name, 'ß', 'ss'), '{T.ACCENTED}', '{T.BASE}')), '[^a-z0-9]', '', 'g') as label from comp where name is not null")
def _(spark, d):
    return companies(spark, d, "name").where("name is not null").select("id", T.form_label(F.col("name")).alias("label"))


@query("text_clean_display", f"with {COMP} select id, regexp_replace(regexp_replace(name, '[ \t\r\n]+', ' ', 'g'), '^[ ,;:|·•-]+|[ ,;:|·•-]+$', '', 'g') as shown from comp where name is not null")
def _(spark, d):
    return companies(spark, d, "name").where("name is not null").select("id", T.clean_display(F.col("name")).alias("shown"))


_FOLD = "lower(trim(regexp_replace({}, '[ \t\r\n]+', ' ', 'g')))"


@query("text_folded", f"with {PREV} select id, {_FOLD.format('preview')} as folded from o")
def _(spark, d):
    return previews(spark, d).select("id", T.folded(F.col("preview")).alias("folded"))


@query("text_content_hash", f"with {PAGES} select id, sha256(text) as sha256, length(text) as chars from pages where text is not null")
def _(spark, d):
    return pages(spark, d, "text").where("text is not null").select("id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("bigint").alias("chars"))


@query("text_weak_key", f"with {COMP} select id, case when contact_key is null or contact_key = '' then 'weak:' || data_source || ':' || sha256(coalesce(canonical_fields_json, '')) else contact_key end as key from comp")
def _(spark, d):
    weak = F.concat(F.lit("weak:"), "data_source", F.lit(":"), F.sha2(F.coalesce("canonical_fields_json", F.lit("")), 256))
    return companies(spark, d, "contact_key", "data_source", "canonical_fields_json").select("id", F.when(F.coalesce("contact_key", F.lit("")) == "", weak).otherwise(F.col("contact_key")).alias("key"))


_TEL = "t as (select id, nullif(trim(regexp_extract(preview, 'Tel\\.[ ]*([0-9+() /-]+)', 1)), '') as raw from o), p as (select id, raw, regexp_replace(raw, '[^0-9]', '', 'g') as d from t where raw is not null)"


@query("text_phone_forms", f"with {PREV}, {_TEL} select id, raw, case when starts_with(raw, '+49') then '+49' || substring(d, 3, 64) when starts_with(raw, '0049') then '+49' || substring(d, 5, 64) else d end as international, case when (starts_with(d, '0049') or starts_with(d, '0043')) and length(d) > 10 then '0' || substring(d, 5, 64) when starts_with(raw, '+43') and length(d) > 8 then '0' || substring(d, 3, 64) when starts_with(d, '49') and length(d) > 8 then '0' || substring(d, 3, 64) else d end as national_form from p")
def _(spark, d):
    raw = F.nullif(F.trim(F.regexp_extract("preview", r"Tel\.[ ]*([0-9+() /-]+)", 1)), F.lit(""))
    t = previews(spark, d).select("id", raw.alias("raw")).where("raw is not null")
    return t.select("id", "raw", T.phone_international(F.col("raw")).alias("international"), T.phone_national(F.col("raw")).alias("national_form"))


@query("text_domain", f"with {COMP}, k as (select id, unnest(string_split(regexp_extract(contact_key, 'domain=([^|]*)', 1), ',')) as v from comp where contact_key is not null) select id, regexp_replace(lower(regexp_replace(regexp_replace(trim('HTTPS://WWW.' || v || '/'), '^(?i)https?://', ''), '/+$', '')), '^www\\.', '') as host from k where v <> ''")
def _(spark, d):
    k = companies(spark, d, "contact_key").where("contact_key is not null").select("id", F.explode(F.split(F.regexp_extract("contact_key", r"domain=([^|]*)", 1), ",")).alias("v")).where("v <> ''")
    return k.select("id", T.domain(F.concat(F.lit("HTTPS://WWW."), "v", F.lit("/")), drop_www=True).alias("host"))


_MAIL = "([A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[A-Za-z]{2,})"


@query("text_contacts", f"with {COMP}, c as (select id, canonical_fields_json as t from comp where canonical_fields_json is not null) select id, nullif(regexp_extract(t, '{_MAIL}', 1), '') as email, nullif(trim(regexp_extract(t, '((?:\\+49|0049|0)[ ]*(?:\\(?[0-9]{{2,5}}\\)?[ ./-]*)[0-9][0-9 ./-]{{4,}})', 1)), '') as phone from c")
def _(spark, d):
    c = companies(spark, d, "canonical_fields_json").where("canonical_fields_json is not null")
    phone = r"((?:\+49|0049|0)[ ]*(?:\(?[0-9]{2,5}\)?[ ./-]*)[0-9][0-9 ./-]{4,})"
    return c.select("id", T.first_email(F.col("canonical_fields_json")).alias("email"), F.nullif(F.trim(F.regexp_extract("canonical_fields_json", phone, 1)), F.lit("")).alias("phone"))


@query("text_address_line", f"with {PREV}, l as (select id, list_filter(list_transform(string_split_regex(preview, '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: regexp_matches(x, '[0-9]{{5}} [A-ZÄÖÜ]')) as l from o) select id, l[1] as address from l where len(l) > 0")
def _(spark, d):
    found = F.filter(T.lines(F.col("preview")), lambda x: x.rlike("[0-9]{5} [A-ZÄÖÜ]"))
    return previews(spark, d).select("id", F.try_element_at(found, F.lit(1)).alias("address")).where("address is not null")


@query("text_contact_score", f"with {PREV} select id, length(regexp_replace(preview, '[^0-9]', '', 'g')) + 3 * cast(contains(preview, '@') as integer) + 2 * cast(regexp_matches(lower(preview), '(www\\.|https?://|\\.de([^a-z0-9_]|$))') as integer) as score from o")
def _(spark, d):
    return previews(spark, d).select("id", T.contact_score(F.col("preview")).cast("bigint").alias("score"))


@query("text_company_guess", f"with {PREV} select id, coalesce(nullif(regexp_extract(preview, '([A-ZÄÖÜ][A-Za-zÄÖÜäöüß.-]+ [A-ZÄÖÜ][A-Za-zÄÖÜäöüß.-]+ (?:GmbH|KG|OHG|UG))', 1), ''), nullif(left(trim(string_split_regex(preview, '\\r\\n|\\n|\\r')[1]), 255), ''), 'Unbekannte Firma') as guess from o")
def _(spark, d):
    form = F.nullif(F.regexp_extract("preview", "([A-ZÄÖÜ][A-Za-zÄÖÜäöüß.-]+ [A-ZÄÖÜ][A-Za-zÄÖÜäöüß.-]+ (?:GmbH|KG|OHG|UG))", 1), F.lit(""))
    first = F.nullif(F.left(F.trim(F.split("preview", r"\r\n|\n|\r")[0]), F.lit(255)), F.lit(""))
    return previews(spark, d).select("id", F.coalesce(form, first, F.lit("Unbekannte Firma")).alias("guess"))


@query("text_line_kinds", f"with {PREV}, l as (select id, unnest(string_split(preview, chr(10))) as line from o), k as (select id, case when regexp_matches(line, '(?:\\+49|0049|0)[ ]*(?:\\(?[0-9]{{2,5}}\\)?[ ./-]*)[0-9][0-9 ./-]{{4,}}') or regexp_matches(line, '{_MAIL}') or regexp_matches(lower(line), '(https?://|www\\.)') then 'contact' when regexp_matches(line, '[0-9]{{5}}') or regexp_matches(lower(line), '(straße|strasse|weg |platz|gasse|allee|ufer)') then 'address' else 'text' end as kind from l) select kind, count(*) as lines from k group by kind")
def _(spark, d):
    line = previews(spark, d).select(F.explode(F.split("preview", "\n")).alias("line"))
    return line.groupBy(F.coalesce(T.communication_kind(F.col("line")), F.lit("text")).alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


_LOWP = "lower(line)"


_LINE = "lower(trim(regexp_replace(line, '[ \t\r\n]+', ' ', 'g')))"


@query("text_forbidden_rules", f"with {PREV}, l as (select id, {_LINE} as line from (select id, unnest(string_split(preview, chr(10))) as line from o)), k as (select id, case when regexp_matches(line, '{S.PRICE}') then 'price_or_currency' when regexp_matches(line, '{S.IBAN}') and regexp_matches(line, '{S.BANK}') then 'bank_details' when regexp_matches(line, '{S.VALIDITY}') and regexp_matches(line, '{S.VALID_FOR}') then 'validity_or_deadline' when regexp_matches(line, '{S.CAMPAIGN}') or (contains(line, 'kostenlos') and contains(line, 'beratungstermin')) then 'campaign_or_offer' end as rule from l) select rule, count(*) as lines, count(distinct id) as records from k where rule is not null group by rule")
def _(spark, d):
    line = previews(spark, d).select("id", F.explode(F.split("preview", "\n")).alias("line"))
    return line.select("id", T.forbidden_content(F.col("line")).alias("rule")).where("rule is not null").groupBy("rule").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("id").alias("records"))


@query("text_anchor_count", f"with {PREV} select id, cast((length(lower(preview)) - length(replace(lower(preview), 'die', ''))) / 3 as integer) as hits from o")
def _(spark, d):
    return previews(spark, d).select("id", T.count_of(F.lower("preview"), F.lit("die")).alias("hits"))


@query("text_tokens", f"with {PREV} select id, cast(len(list_distinct(list_filter(regexp_extract_all(lower(preview), '([a-zäöüß0-9]+(?:[.@+_-][a-zäöüß0-9]+)*)'), lambda t: length(t) > 2))) as integer) as tokens from o")
def _(spark, d):
    return previews(spark, d).select("id", F.size(T.tokens(F.col("preview"))).alias("tokens"))


@query("text_word_counts", f"with {PAGES}, w as (select unnest(regexp_extract_all(lower(text), '([a-z0-9äöüß]+)')) as word from pages where text is not null) select word, count(*) as n from w group by word")
def _(spark, d):
    return pages(spark, d, "text").where("text is not null").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("text_substring_bleed", f"with {OCC}, t as (select id, page_id, {_FOLD.format('company')} as t from occ where company is not null) select a.id, case when exists (select 1 from t b where b.page_id = a.page_id and b.id <> a.id and length(b.t) > length(a.t) and contains(b.t, a.t)) and not regexp_matches(a.t, '[0-9]') then '' else a.t end as kept from t a")
def _(spark, d):
    t = occurrences(spark, d, "page_id", "company", "confidence").where("company is not null").select("id", "page_id", T.folded(F.col("company")).alias("t"))
    other = t.select("page_id", F.col("id").alias("o"), F.col("t").alias("long"))
    hidden = t.join(other, "page_id").where("o <> id and length(long) > length(t) and contains(long, t)").select("id").distinct().withColumn("hit", F.lit(True))
    return t.join(hidden, "id", "left").select("id", F.when(F.col("hit") & ~F.col("t").rlike("[0-9]"), "").otherwise(F.col("t")).alias("kept"))


# Kinds of publication with pattern and confidence, in order.
TYPES = (("kommunales-amtsblatt", "amtsblatt", 0.94), ("stadt-und-gemeindemagazin", "(stadt|gemeinde)[- ]?magazin|[a-zäöüß-]{3,}[- ]magazin", 0.86), ("bürger-und-seniorenwegweiser", "seniorenwegweiser|bürgerwegweiser|wegweiser für (senior|bürger)", 0.95), ("branchenführer", "branchenf(ü|u)hrer", 0.95), ("messekatalog", "messe[- ]?(katalog|führer)", 0.9))
_TYPE = lambda c: "case " + " ".join(f"when regexp_matches(lower({c}), '{p}') then '{n}'" for n, p, _ in TYPES) + " end"
_CONF = "case t " + " ".join(f"when '{n}' then {c}" for n, _, c in TYPES) + " end"


@query("text_publication_type", f"with {PAGES}, f as (select document_id, string_agg(text, chr(10) order by id) as text from pages where page_number = 1 and text is not null group by document_id), x as (select d.id, {_TYPE('d.filename')} as a, {_TYPE('f.text')} as b from ingestion_documents d left join f on f.document_id = d.id), y as (select id, coalesce(a, b) as t, case when a is not null then 'filename' when b is not null then 'title-page' end as source from x) select id, t as type, {_CONF} as confidence, source from y")
def _(spark, d):
    rule = lambda c: T.ladder([(n, F.lower(c).rlike(p)) for n, p, _ in TYPES])
    first = pages(spark, d, "document_id", "page_number", "text").where("page_number = 1 and text is not null").groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n").alias("first"))
    x = documents(spark, d).select("id", "filename").join(first, F.col("id") == F.col("document_id"), "left").select("id", rule("filename").alias("a"), rule("first").alias("b"))
    confidence = reduce(lambda acc, t: acc.when(F.col("type") == t[0], t[2]), TYPES[1:], F.when(F.col("type") == TYPES[0][0], TYPES[0][2]))
    y = x.select("id", F.coalesce("a", "b").alias("type"), F.when(F.col("a").isNotNull(), "filename").when(F.col("b").isNotNull(), "title-page").alias("source"))
    return y.select("id", "type", confidence.cast("double").alias("confidence"), "source")


@query("text_period", "with x as (select id, filename as f from ingestion_documents where filename is not null) select id, case when regexp_matches(f, '20[0-9]{2}\\s*[/-]\\s*20[0-9]{2}') then 'span' when regexp_matches(lower(f), '(ausgabe|edition)\\s*[0-9]{1,3}\\s*[/-]\\s*20[0-9]{2}') then 'edition' when regexp_matches(f, '20[0-9]{2}') then 'year' end as rule, try_cast(nullif(regexp_extract(f, '(20[0-9]{2})', 1), '') as integer) as start_year, case when regexp_matches(f, '20[0-9]{2}\\s*[/-]\\s*20[0-9]{2}') then 0.86 when regexp_matches(lower(f), '(ausgabe|edition)\\s*[0-9]{1,3}\\s*[/-]\\s*20[0-9]{2}') then 0.86 when regexp_matches(f, '20[0-9]{2}') then 0.45 end as confidence from x")
def _(spark, d):
    f = F.col("filename")
    span, edition, year = f.rlike(r"20[0-9]{2}\s*[/-]\s*20[0-9]{2}"), F.lower(f).rlike(r"(ausgabe|edition)\s*[0-9]{1,3}\s*[/-]\s*20[0-9]{2}"), f.rlike("20[0-9]{2}")
    x = documents(spark, d).where("filename is not null")
    return x.select("id", T.ladder([("span", span), ("edition", edition), ("year", year)]).alias("rule"), F.expr("try_cast(nullif(regexp_extract(filename, '(20[0-9]{2})', 1), '') as int)").alias("start_year"), F.when(span | edition, 0.86).when(year, 0.45).cast("double").alias("confidence"))


@query("text_title", f"with {PAGES}, l as (select document_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) >= 5 and not regexp_matches(x, '^[^A-Za-zÄÖÜäöüß]+$')) as l, id from pages where page_number = 1 and text is not null), t as (select document_id, arg_min(l[1], id) as title from l where len(l) > 0 group by document_id) select d.id, coalesce(t.title, regexp_replace(d.filename, '(?i)\\.pdf$', '')) as title, case when t.title is not null then 0.45 else 0.35 end as confidence from ingestion_documents d left join t on t.document_id = d.id where d.filename is not null")
def _(spark, d):
    usable = F.filter(F.transform(F.split("text", r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: (F.length(x) >= 5) & ~x.rlike("^[^A-Za-zÄÖÜäöüß]+$"))
    t = pages(spark, d, "document_id", "page_number", "text").where("page_number = 1 and text is not null").select("document_id", "id", F.try_element_at(usable, F.lit(1)).alias("t")).where("t is not null").groupBy("document_id").agg(F.min_by("t", "id").alias("t"))
    x = documents(spark, d).where("filename is not null").select("id", "filename").join(t, F.col("id") == F.col("document_id"), "left")
    return x.select("id", F.coalesce("t", F.regexp_replace("filename", r"(?i)\.pdf$", "")).alias("title"), F.when(F.col("t").isNotNull(), 0.45).otherwise(0.35).cast("double").alias("confidence"))


@query("text_title_case", "with n as (select distinct n_name from nation) select n_name, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(left(w, 1)) || substring(w, 2)), ' ') as shown from n")
def _(spark, d):
    return table(spark, d, "nation").select("n_name").distinct().select("n_name", T.title_case(F.col("n_name")).alias("shown"))


@query("text_template", "select id, replace(replace('{{state}}: {{name}} ({{state}})', '{{state}}', state), '{{name}}', coalesce(filename, '-')) as line from ingestion_documents")
def _(spark, d):
    fill = {"{{state}}": F.col("state"), "{{name}}": F.coalesce("filename", F.lit("-"))}
    return documents(spark, d).select("id", reduce(lambda acc, k: F.replace(acc, F.lit(k), fill[k]), fill, F.lit("{{state}}: {{name}} ({{state}})")).alias("line"))


@query("text_safe_filename", "with f as (select id, '\\tmp\\..\\' || filename || '\" ' as f from ingestion_documents where filename is not null) select id, left(coalesce(nullif(regexp_replace(replace(list_last(string_split(replace(f, '\\', '/'), '/')), '\"', ''), '^[ .]+|[ .]+$', '', 'g'), ''), 'source.pdf'), 255) as safe from f")
def _(spark, d):
    f = F.concat(F.lit("\\tmp\\..\\"), "filename", F.lit('" '))
    return documents(spark, d).where("filename is not null").select("id", T.safe_filename(f).alias("safe"))


_URLS = [("HTTPS://Gemeinde.Example:443",), ("http://gemeinde.example:80/a?b=1#c",), ("http://gemeinde.example:8080/A/b.pdf",), ("https://GEMEINDE.example/Stadtmagazin-2024.pdf?download=1",), ("https://verein.example/branchenfuehrer",), ("https://x.example/wegweiser/seniorenwegweiser_2023.pdf#s",)]


@query("text_normalize_url", "with u(url) as (values " + ", ".join(f"('{u}')" for (u,) in _URLS) + "), p as (select url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) as s, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) as h, regexp_extract(url, '^[A-Za-z]+://[^/:?#]+:([0-9]+)', 1) as p, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '(\\?[^#]*)', 1) as q from u) select url, s || '://' || h || case when p in ('', '80', '443') then '' else ':' || p end || case when path = '' then '/' else path end || q as normal from p")
def _(spark, d):
    return spark.createDataFrame(_URLS, "url string").select("url", T.normalize_url(F.col("url")).alias("normal"))


@query("text_publication_score", "with f as (select id, lower('https://x.example/' || filename) as u from ingestion_documents where filename is not null) select id, least(100, case when contains(u, '.pdf') then 25 else 0 end + least(50, 15 * (" + " + ".join(f"cast(contains(u, '{t}') as integer)" for t in T.PUBLICATION_TERMS) + ")) + case when regexp_matches(u, '20[0-9]{2}') then 10 else 0 end + case when regexp_matches(u, '(download|publikation|broschu|magazin|wegweiser)') then 10 else 0 end) as score from f")
def _(spark, d):
    return documents(spark, d).where("filename is not null").select("id", T.publication_score(F.concat(F.lit("https://x.example/"), "filename")).alias("score"))


@query("text_year_hint", "with y as (select id, list_transform(regexp_extract_all(coalesce(filename, '') || ' ' || coalesce(storage_key, ''), '(20[0-9]{2})'), lambda x: cast(x as integer)) as y from ingestion_documents) select id, list_max(y) as last_year, case when len(y) = 0 then 'unverified' when list_max(y) >= 2025 - 3 then 'current' else 'outdated' end as hint from y")
def _(spark, d):
    y = F.transform(F.regexp_extract_all(F.concat_ws(" ", F.coalesce("filename", F.lit("")), F.coalesce("storage_key", F.lit(""))), F.lit("(20[0-9]{2})"), F.lit(1)), lambda v: v.cast("int"))
    x = documents(spark, d).select("id", F.array_max(y).alias("last_year"))
    return x.select("id", "last_year", F.when(F.col("last_year").isNull(), "unverified").when(F.col("last_year") >= 2022, "current").otherwise("outdated").alias("hint"))


@query("math_exact", "with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(cast(l_extendedprice as decimal(14, 2)) * 100, 0) as hugeint) as c, cast(round(cast(l_quantity as decimal(12, 2)) * 100, 0) as hugeint) as q, cast(round(cast(l_discount as decimal(5, 2)) * 10000, 0) as hugeint) as r from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast((c * q + 50) // 100 as bigint) as product, cast(-((c * r + 5000) // 10000) as bigint) as rebate from l")
def _(spark, d):
    whole = lambda c, kind, by: (F.col(c).cast(kind) * by).cast("bigint")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", whole("l_extendedprice", "decimal(14,2)", 100).alias("c"), whole("l_quantity", "decimal(12,2)", 100).alias("q"), whole("l_discount", "decimal(5,2)", 10000).alias("r"))
    dec = lambda c: F.col(c).cast("decimal(18,0)")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.times(dec("c"), dec("q")).alias("product"), X.percent(-dec("c"), dec("r")).alias("rebate"))


@query("math_parse_decimal", "with v(t) as (values ('1,50'), ('-0.505'), ('7'), ('+3.4'), ('x'), (''), ('12.345'), ('-1.00')) select t, case when regexp_matches(replace(trim(t), ',', '.'), '^[+-]?[0-9]+(\\.[0-9]{1,2})?$') then cast(try_cast(replace(trim(t), ',', '.') as decimal(30, 2)) * 100 as bigint) end as hundredths from v")
def _(spark, d):
    v = spark.createDataFrame([(t,) for t in ("1,50", "-0.505", "7", "+3.4", "x", "", "12.345", "-1.00")], "t string")
    return v.select("t", X.hundredths(F.col("t")).alias("hundredths"))


@query("math_backoff", "select n as attempt, cast(least(300000.0, 1000 * pow(2.0, greatest(n - 1, 0))) as bigint) as delay_ms from range(0, 15) t(n)")
def _(spark, d):
    return spark.range(15).select(F.col("id").alias("attempt"), X.backoff(F.col("id")).alias("delay_ms"))


@query("math_boxes", f"with {OCC}, r as (select id, cast(json_extract_string(bbox, '$.x') as double) as x, cast(json_extract_string(bbox, '$.y') as double) as y, cast(json_extract_string(bbox, '$.width') as double) as w, cast(json_extract_string(bbox, '$.height') as double) as h from occ where bbox is not null), b as (select id, cast(trunc(greatest(0.0, least(1200.0, x / 1.0 * 1200))) as integer) as l, cast(trunc(greatest(0.0, least(1600.0, y / 1.0 * 1600))) as integer) as t, cast(trunc(greatest(0.0, least(1200.0, (x + w) / 1.0 * 1200))) as integer) as r, cast(trunc(greatest(0.0, least(1600.0, (y + h) / 1.0 * 1600))) as integer) as b from r where x is not null and y is not null and w is not null and h is not null) select id, l as left_px, t as top_px, (r - l) * (b - t) as area, greatest(0, l - 10) as padded_left, least(1600, b + 10) as padded_bottom from b where r - l >= 8 and b - t >= 8")
def _(spark, d):
    px = lambda a, extent: to_pixels(a, extent, 1.0)
    b = boxed(spark, d).select("id", box(px(F.col("x"), 1200), px(F.col("y"), 1600), px(F.col("x") + F.col("w"), 1200), px(F.col("y") + F.col("h"), 1600)).alias("b"))
    b = b.where((F.col("b.right") - F.col("b.left") >= 8) & (F.col("b.bottom") - F.col("b.top") >= 8)).withColumn("p", pad(F.col("b"), 10, 1200, 1600))
    return b.select("id", F.col("b.left").alias("left_px"), F.col("b.top").alias("top_px"), area(F.col("b")).alias("area"), F.col("p.left").alias("padded_left"), F.col("p.bottom").alias("padded_bottom"))


@query("math_iou_pairs", f"with {OCC}, r as (select id, page_id, cast(json_extract_string(bbox, '$.x') as double) as x, cast(json_extract_string(bbox, '$.y') as double) as y, cast(json_extract_string(bbox, '$.width') as double) as w, cast(json_extract_string(bbox, '$.height') as double) as h from occ where bbox is not null), b as (select id, page_id, cast(trunc(x * 1000) as integer) as l, cast(trunc(y * 1000) as integer) as t, cast(trunc((x + w) * 1000) as integer) as r, cast(trunc((y + h) * 1000) as integer) as b from r where x is not null and y is not null and w is not null and h is not null), p as (select a.id as left_id, c.id as right_id, greatest(least(a.r, c.r) - greatest(a.l, c.l), 0) * greatest(least(a.b, c.b) - greatest(a.t, c.t), 0) as i, (a.r - a.l) * (a.b - a.t) + (c.r - c.l) * (c.b - c.t) as s, (greatest(a.r, c.r) - least(a.l, c.l)) * (greatest(a.b, c.b) - least(a.t, c.t)) as hull from b a join b c on a.page_id = c.page_id and a.id < c.id) select left_id, right_id, round(case when s - i > 0 then i / (s - i) else 0 end, 6) as iou, hull from p")
def _(spark, d):
    k = lambda e: (e * 1000).cast("int")
    b = boxed(spark, d).select("id", "page_id", box(k(F.col("x")), k(F.col("y")), k(F.col("x") + F.col("w")), k(F.col("y") + F.col("h"))).alias("b"))
    pairs = b.select(F.col("id").alias("left_id"), "page_id", F.col("b").alias("a")).join(b.select(F.col("id").alias("right_id"), "page_id", F.col("b").alias("c")), "page_id").where("left_id < right_id")
    return pairs.select("left_id", "right_id", F.round(iou(F.col("a"), F.col("c")), 6).alias("iou"), area(union(F.col("a"), F.col("c"))).alias("hull"))


@query("math_page_class", f"with {PAGES}, p as (select id, page_number, length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) as n from pages) select id, case when n = 0 then 'blank' when n / 600.0 < 0.15 then 'ad-page' when page_number = 1 then 'cover' when n / 600.0 > 1.2 then 'editorial' else 'mixed' end as class from p")
def _(spark, d):
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""))
    return pages(spark, d, "page_number", "text").select("id", F.when(n == 0, "blank").when(n / 600 < 0.15, "ad-page").when(F.col("page_number") == 1, "cover").when(n / 600 > 1.2, "editorial").otherwise("mixed").alias("class"))


@query("math_candidate_confidence", f"with {OCC} select id, cast(coalesce(len(evidence), 0) as integer) as signals, cast(floor(100 * least(0.98, 0.45 + 0.1 * coalesce(len(evidence), 0)) + 0.5) as bigint) as percent from occ")
def _(spark, d):
    n = F.coalesce(F.array_size("evidence"), F.lit(0))
    return occurrences(spark, d, "evidence").select("id", n.alias("signals"), F.floor(100 * F.least(F.lit(0.98), 0.45 + 0.1 * n) + 0.5).alias("percent"))


@query("date_floor_days", "select id, cast(floor((epoch_ms(timestamp '2026-01-01 06:00:00') - epoch_ms(created_at)) / 86400000.0) as bigint) as days from ingestion_documents")
def _(spark, d):
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return documents(spark, d).select("id", F.floor((ms(F.expr("timestamp_ntz'2026-01-01 06:00:00'")) - ms(F.col("created_at"))) / F.lit(86_400_000)).alias("days"))


@query("date_due", "select o_orderkey, strftime(cast(o_orderdate as date) + 14, '%Y-%m-%d') as due, year(o_orderdate) as y, quarter(o_orderdate) as q from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 14), "yyyy-MM-dd").alias("due"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))


@query("date_override", "select id, coalesce(case when state = 'failed' then created_at + interval 1 day end, created_at) as effective, case when state = 'failed' then 'manual' else 'derived' end as source from ingestion_documents")
def _(spark, d):
    manual = F.when(F.col("state") == "failed", F.col("created_at") + F.expr("interval 1 day"))
    return documents(spark, d).select("id", F.coalesce(manual, "created_at").alias("effective"), F.when(manual.isNotNull(), "manual").otherwise("derived").alias("source"))


@query("date_parse_iso", "with v(t) as (values ('2025-03-25T21:13:02Z'), ('2025-03-25'), ('gestern'), ('2025-13-01T00:00:00Z'), ('')) select t, cast(epoch_ms(try_cast(replace(replace(t, 'T', ' '), 'Z', '') as timestamp)) as bigint) as ms from v")
def _(spark, d):
    v = spark.createDataFrame([(t,) for t in ("2025-03-25T21:13:02Z", "2025-03-25", "gestern", "2025-13-01T00:00:00Z", "")], "t string")
    return v.select("t", F.unix_millis(F.try_to_timestamp(F.replace(F.replace("t", F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit("")))).alias("ms"))


@query("array_append_once", f"with {OCC} select id, array_to_string(list_sort(list_distinct(list_append(coalesce(evidence, []), 'logo'))), ',') as tags from occ")
def _(spark, d):
    empty = F.array().cast("array<string>")
    return occurrences(spark, d, "evidence").select("id", F.array_join(F.array_sort(F.array_union(F.coalesce("evidence", empty), F.array(F.lit("logo")))), ",").alias("tags"))


@query("json_box_shape", f"with {OCC} select id, json_extract_string(bbox, '$.x') is not null and json_extract_string(bbox, '$.y') is not null and json_extract_string(bbox, '$.width') is not null and json_extract_string(bbox, '$.height') is not null and json_extract_string(bbox, '$.confidence') is not null as complete from occ where bbox is not null")
def _(spark, d):
    schema = "x double, y double, width double, height double, confidence double"
    b = occurrences(spark, d, "bbox", "confidence").where("bbox is not null").select("id", F.from_json("bbox", schema).alias("b"))
    return b.select("id", reduce(lambda a, c: a & c, [F.col(f"b.{k}").isNotNull() for k in ("x", "y", "width", "height", "confidence")]).alias("complete"))


@query("json_paths", f"with {COMP} select id, json_extract_string(j, '$.company') as company, json_extract_string(j, '$.address.city') as city from (select id, try_cast(canonical_fields_json as json) as j from comp) where json_type(j) = 'OBJECT' and (json_type(j, '$.company') = 'VARCHAR' or json_type(j, '$.company') is null) and (json_type(j, '$.address.city') = 'VARCHAR' or json_type(j, '$.address.city') is null)")
def _(spark, d):
    c = companies(spark, d, "canonical_fields_json").select("id", F.try_parse_json("canonical_fields_json").alias("j")).where(F.schema_of_variant("j").startswith("OBJECT"))
    get = lambda p: F.expr(f"try_variant_get(j, '{p}')")
    plain = lambda p: get(p).isNull() | (F.schema_of_variant(get(p)) == "STRING")
    void = lambda p: F.coalesce(F.schema_of_variant(get(p)) != "VOID", F.lit(True))
    return c.where(plain("$.company") & plain("$.address.city") & void("$.company") & void("$.address.city")).select("id", get("$.company").cast("string").alias("company"), get("$.address.city").cast("string").alias("city"))


@query("json_findings", f"with {COMP}, f as (select id, unnest(cast(try_cast(secondary_findings_json as json) as json[])) as f from comp where json_type(try_cast(secondary_findings_json as json)) = 'ARRAY') select id, json_extract_string(f, '$.source') as source, count(*) as findings from f group by 1, 2")
def _(spark, d):
    c = companies(spark, d, "secondary_findings_json").select("id", F.try_parse_json("secondary_findings_json").alias("j")).where(F.schema_of_variant("j").startswith("ARRAY"))
    each = c.select("id", F.explode(F.expr("try_variant_get(j, '$', 'array<variant>')")).alias("f"))
    return each.groupBy("id", F.expr("try_variant_get(f, '$.source', 'string')").alias("source")).agg(F.count(F.lit(1)).alias("findings"))


@query("json_merge_header_wins", "select id, coalesce(nullif(json_extract_string(bbox, '$.confidence'), ''), cast(confidence as varchar)) is not null as has_confidence, case when json_extract_string(bbox, '$.confidence') is not null and confidence is not null and cast(json_extract_string(bbox, '$.confidence') as double) <> confidence then 'confidence' else '' end as conflict from (select distinct id, bbox, confidence from ingestion_occurrences)")
def _(spark, d):
    o = table(spark, d, "ingestion_occurrences").select("id", "bbox", "confidence").distinct()
    header = F.map_from_arrays(F.array(F.lit("confidence")), F.array(F.get_json_object("bbox", "$.confidence").cast("double")))
    advert = F.map_from_arrays(F.array(F.lit("confidence")), F.array("confidence"))
    merged = F.map_zip_with(header, advert, lambda k, h, a: F.struct(F.coalesce(h, a).alias("value"), (h.isNotNull() & a.isNotNull() & (h != a)).alias("clash")))
    m = o.select("id", merged["confidence"].alias("m"))
    return m.select("id", F.col("m.value").isNotNull().alias("has_confidence"), F.when(F.col("m.clash"), "confidence").otherwise("").alias("conflict"))


@query("math_class_probability", f"with {PAGES} select id, case classification when 'ad-page' then 1.0 when 'mixed' then 0.5 else 0.0 end as probability from pages")
def _(spark, d):
    known = F.create_map(F.lit("ad-page"), F.lit(1.0), F.lit("mixed"), F.lit(0.5))
    return pages(spark, d, "classification").select("id", F.coalesce(F.try_element_at(known, F.coalesce("classification", F.lit(""))), F.lit(0.0)).alias("probability"))


@query("text_provenance_warning", f"with {PREV} select id, regexp_matches(lower(preview), '{S.UNCERTAIN}') as uncertain from o")
def _(spark, d):
    return previews(spark, d).select("id", F.lower("preview").rlike(S.UNCERTAIN).alias("uncertain"))


QUERIES, ORACLES = Q, O

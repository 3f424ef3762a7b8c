"""Filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from inkwell.functions import signals as S
from inkwell.plans.runtime import table

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return keep


@query("filter_tenant_scope", "select id, tenant_id, filename, state from ingestion_documents where tenant_id = 1")
def _(spark, d):
    return table(spark, d, "ingestion_documents").where(F.col("tenant_id") == 1).select("id", "tenant_id", "filename", "state")


@query("filter_point_lookup", "select id, tenant_id, filename from ingestion_documents where tenant_id = 1 and id = (select min(id) from ingestion_documents where tenant_id = 1) limit 1")
def _(spark, d):
    own = table(spark, d, "ingestion_documents").where(F.col("tenant_id") == 1).select("id", "tenant_id", "filename")
    return own.orderBy("id").limit(1)


@query("filter_optional_conjunction", "select id, origin, state from ingestion_documents where origin = 'discovery' and state = 'processed' and year(created_at) = 2025 and mime_type = 'application/pdf'")
def _(spark, d):
    wanted = {"origin": "discovery", "state": "processed", "mime_type": "application/pdf", "error": None}
    rules = [F.col(k) == v for k, v in wanted.items() if v is not None] + [F.year("created_at") == 2025]
    return table(spark, d, "ingestion_documents").where(reduce(lambda a, b: a & b, rules)).select("id", "origin", "state")


@query("filter_interval_contains", "with p as (select id, cast(regexp_extract(filename, '(20[0-9]{2})', 1) as varchar) as y from ingestion_documents), q as (select id, try_cast(y as integer) as y from p) select id, y - 1 as period_start, y + 1 as period_end from q where y is not null and 2022 between y - 1 and y + 1")
def _(spark, d):
    y = F.expr("try_cast(regexp_extract(filename, '(20[0-9]{2})', 1) as int)")
    p = table(spark, d, "ingestion_documents").select("id", (y - 1).alias("period_start"), (y + 1).alias("period_end"))
    return p.where(F.col("period_start").isNotNull() & F.lit(2022).between(F.col("period_start"), F.col("period_end")))


_EVENTS = "with e as (select event_id, ts, case when event_id % 3 = 0 then ts end as published_at, event_id % 11 = 0 as dead, case when event_id % 5 = 0 then ts + interval 1 hour end as next_attempt from events)"


@query("filter_pending", _EVENTS + " select event_id from e where published_at is null and not dead and (next_attempt is null or next_attempt <= timestamp '2024-01-01 12:00:00')")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("published_at"), (F.col("event_id") % 11 == 0).alias("dead"), F.when(F.col("event_id") % 5 == 0, F.col("ts") + F.expr("interval 1 hour")).alias("next_attempt"))
    due = F.col("next_attempt").isNull() | (F.col("next_attempt") <= F.expr("timestamp_ntz'2024-01-01 12:00:00'"))
    return e.where(F.col("published_at").isNull() & ~F.col("dead") & due).select("event_id")


@query("filter_claimable", "select event_id, case when event_id % 2 = 0 then 'pending' else 'processing' end as state from events where (event_id % 2 = 0 and ts <= timestamp '2024-01-10') or (event_id % 2 = 1 and ts + interval 1 minute <= timestamp '2024-01-05')")
def _(spark, d):
    state = F.when(F.col("event_id") % 2 == 0, "pending").otherwise("processing")
    e = table(spark, d, "events").select("event_id", "ts", state.alias("state"))
    at = lambda s: F.expr(f"timestamp_ntz'{s}'")
    return e.where(((F.col("state") == "pending") & (F.col("ts") <= at("2024-01-10"))) | ((F.col("state") == "processing") & (F.col("ts") + F.expr("interval 1 minute") <= at("2024-01-05")))).select("event_id", "state")


@query("filter_key_or_null", "select id, source_id from ingestion_documents where source_id = 228 or source_id is null")
def _(spark, d):
    return table(spark, d, "ingestion_documents").where((F.col("source_id") == 228) | F.col("source_id").isNull()).select("id", "source_id")


_URLS = [("http://beispiel.example/a.pdf",), ("https://10.1.2.3/x",), ("ftp://beispiel.example/a",), ("http://127.0.0.1:8080/",), ("https://192.168.0.9/q",), ("http://172.20.1.1/",), ("http://172.40.1.1/",), ("https://169.254.1.1/",), ("http://8.8.8.8/b.pdf",), ("https://localhost/x",), ("http:///kein-host",), ("HTTPS://Gemeinde.example/Plan.PDF",)]


@query("filter_url_policy", "with u(url) as (values " + ", ".join(f"('{u}')" for (u,) in _URLS) + "), p as (select url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) as scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/:]*)', 1)) as host from u) select url, scheme in ('http', 'https') and host <> '' and host <> 'localhost' and not regexp_matches(host, '^(10\\.|127\\.|192\\.168\\.|169\\.254\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|0\\.)') as allowed from p")
def _(spark, d):
    u = spark.createDataFrame(_URLS, "url string")
    scheme, host = F.lower(F.regexp_extract("url", "^([A-Za-z]+)://", 1)), F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/:]*)", 1))
    private = host.rlike(r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.)")
    return u.select("url", (scheme.isin("http", "https") & (host != "") & (host != "localhost") & ~private).alias("allowed"))


_RULES = [("/", True), ("/intern", False), ("/intern/offen", True), ("/tmp", False)]
_PATHS = [("/a.pdf",), ("/intern/x.pdf",), ("/intern/offen/y.pdf",), ("/tmp",), ("/tmpfile",), ("/",)]


@query("filter_longest_prefix_rule", "with r(rule, allow) as (values " + ", ".join(f"('{r}', {a})" for r, a in _RULES) + "), p(path) as (values " + ", ".join(f"('{p}')" for (p,) in _PATHS) + ") select path, arg_max(allow, length(rule)) as allowed from p join r on starts_with(path, rule) group by path")
def _(spark, d):
    rules = spark.createDataFrame(_RULES, "rule string, allow boolean")
    paths = spark.createDataFrame(_PATHS, "path string")
    return paths.join(F.broadcast(rules), F.expr("startswith(path, rule)")).groupBy("path").agg(F.max_by("allow", F.length("rule")).alias("allowed"))  # four rules


@query("filter_array_contains", "select distinct id from ingestion_occurrences where list_contains(evidence, 'logo') and not list_contains(evidence, 'border')")
def _(spark, d):
    o = table(spark, d, "ingestion_occurrences")
    return o.where(F.array_contains("evidence", "logo") & ~F.array_contains("evidence", "border")).select("id").distinct()


@query("filter_regex", "select id, filename from ingestion_documents where regexp_matches(filename, '[0-9]{4}')")
def _(spark, d):
    return table(spark, d, "ingestion_documents").where(F.col("filename").rlike("[0-9]{4}")).select("id", "filename")


_BOX = "b as (select distinct id, cast(json_extract_string(bbox, '$.x') as double) as x, cast(json_extract_string(bbox, '$.y') as double) as y, cast(json_extract_string(bbox, '$.width') as double) as w, cast(json_extract_string(bbox, '$.height') as double) as h, confidence as c from ingestion_occurrences where bbox is not null)"


def boxes(spark, d):
    o = table(spark, d, "ingestion_occurrences").where("bbox is not null")
    get = lambda k: F.get_json_object("bbox", f"$.{k}").cast("double")
    return o.select("id", get("x").alias("x"), get("y").alias("y"), get("width").alias("w"), get("height").alias("h"), F.col("confidence").alias("c")).distinct()


@query("filter_plausible_box", f"with {_BOX} select id from b where w * h >= 0.003 and w * h <= 1 and w / greatest(h, 0.001) between 0.08 and 12")
def _(spark, d):
    b = boxes(spark, d)
    return b.where((F.col("w") * F.col("h")).between(0.003, 1) & (F.col("w") / F.greatest(F.col("h"), F.lit(0.001))).between(0.08, 12)).select("id")


@query("filter_box_gate", f"with {_BOX}, g as (select id, c < 0.7 as low, not (w * h <= 0.75 and y >= 0.12 and y + h <= 0.92 and w <= 0.95 and h <= 0.82) as odd from b where x is not null and y is not null and w is not null and h is not null and c is not null) select id, concat_ws(', ', case when low then 'low confidence' end, case when odd then 'implausible frame' end) as reason from g where low or odd")
def _(spark, d):
    b = boxes(spark, d).dropna()
    low = F.col("c") < 0.7
    odd = ~((F.col("w") * F.col("h") <= 0.75) & (F.col("y") >= 0.12) & (F.col("y") + F.col("h") <= 0.92) & (F.col("w") <= 0.95) & (F.col("h") <= 0.82))
    return b.where(low | odd).select("id", F.concat_ws(", ", F.when(low, "low confidence"), F.when(odd, "implausible frame")).alias("reason"))


@query("filter_signal_probability", f"with o as (select distinct id, preview from ingestion_occurrences where preview is not null), n as (select id, len(regexp_extract_all(lower(preview), '{S.AD}')) as n from o) select id, cast(n as bigint) as signals, least(0.98, 0.08 + 0.08 * n) >= 0.4 as mixed from n")
def _(spark, d):
    o = table(spark, d, "ingestion_occurrences").where("preview is not null").select("id", "preview").distinct()
    n = F.regexp_count(F.lower("preview"), F.lit(S.AD))
    return o.select("id", n.cast("bigint").alias("signals"), (F.least(F.lit(0.98), 0.08 + 0.08 * n) >= 0.4).alias("mixed"))


_FAMILIES = {"contact": S.CONTACT, "phone": S.PHONE, "advertiser": S.ADVERTISER, "editorial": S.EDITORIAL, "public_origin": S.PUBLIC, "directory": S.DIRECTORY}


@query("filter_signal_families", "with o as (select distinct id, preview from ingestion_occurrences where preview is not null) select id, " + ", ".join(f"regexp_matches(lower(preview), '{p}') as {k}" for k, p in _FAMILIES.items()) + " from o")
def _(spark, d):
    o = table(spark, d, "ingestion_occurrences").where("preview is not null").select("id", "preview").distinct()
    return o.select("id", *[F.lower("preview").rlike(p).alias(k) for k, p in _FAMILIES.items()])


@query("filter_acceptance", f"with o as (select distinct id, lower(preview) as t, list_contains(evidence, 'logo') as logo from ingestion_occurrences where preview is not null and evidence is not null) select id from o where logo and regexp_matches(t, '{S.PHONE}') and not regexp_matches(t, '{S.PUBLIC}') and not regexp_matches(t, '{S.DIRECTORY}') and not regexp_matches(t, '{S.EDITORIAL}')")
def _(spark, d):
    o = table(spark, d, "ingestion_occurrences").where("preview is not null and evidence is not null").select("id", F.lower("preview").alias("t"), F.array_contains("evidence", "logo").alias("logo")).distinct()
    t = F.col("t")
    return o.where(F.col("logo") & t.rlike(S.PHONE) & ~t.rlike(S.PUBLIC) & ~t.rlike(S.DIRECTORY) & ~t.rlike(S.EDITORIAL)).select("id")


@query("filter_markings", "select distinct id, company from ingestion_occurrences where lower(trim(company)) in ('anzeige', 'anzeigen', 'werbeanzeige', 'werbeanzeigen')")
def _(spark, d):
    o = table(spark, d, "ingestion_occurrences")
    return o.where(F.lower(F.trim("company")).isin("anzeige", "anzeigen", "werbeanzeige", "werbeanzeigen")).select("id", "company").distinct()


@query("filter_blocklist", "with b(word) as (values ('unbekannte firma'), ('anzeige')) select distinct id from ingestion_occurrences o where company is not null and not exists (select 1 from b where b.word = lower(trim(o.company)))")
def _(spark, d):
    block = spark.createDataFrame([("unbekannte firma",), ("anzeige",)], "word string")
    o = table(spark, d, "ingestion_occurrences").where("company is not null").select("id", F.lower(F.trim("company")).alias("word"))
    return o.join(F.broadcast(block), "word", "left_anti").select("id").distinct()  # two words


_ANCHORS = ("Tel.", "Euro", "Uhr")


@query("filter_missing_anchors", "with o as (select distinct id, preview from ingestion_occurrences where preview is not null) select id, concat_ws(', ', " + ", ".join(f"case when not contains(lower(preview), '{a.lower()}') then '{a}' end" for a in _ANCHORS) + ") as missing from o")
def _(spark, d):
    o = table(spark, d, "ingestion_occurrences").where("preview is not null").select("id", "preview").distinct()
    missing = F.filter(F.array(*map(F.lit, _ANCHORS)), lambda a: ~F.contains(F.lower("preview"), F.lower(a)))
    return o.select("id", F.array_join(missing, ", ").alias("missing"))


@query("filter_validation", "with v as (select id, concat_ws('; ', case when length(filename) > 30 then 'filename too long' end, case when size_bytes is null or size_bytes <= 0 then 'no size' end, case when state = 'failed' and error is null then 'no reason' end, case when source_id is null then 'no source' end) as reasons from ingestion_documents) select id, reasons from v where reasons <> ''")
def _(spark, d):
    rules = [("filename too long", F.length("filename") > 30), ("no size", F.col("size_bytes").isNull() | (F.col("size_bytes") <= 0)), ("no reason", (F.col("state") == "failed") & F.col("error").isNull()), ("no source", F.col("source_id").isNull())]
    v = table(spark, d, "ingestion_documents").select("id", F.concat_ws("; ", *[F.when(rule, text) for text, rule in rules]).alias("reasons"))
    return v.where("reasons <> ''")


@query("filter_safe_paths", "select id, storage_key, regexp_matches(storage_key, '^[A-Za-z0-9/_.-]+$') and not contains(storage_key, '..') and not starts_with(storage_key, '/') as safe from ingestion_documents")
def _(spark, d):
    k = F.col("storage_key")
    return table(spark, d, "ingestion_documents").select("id", "storage_key", (k.rlike("^[A-Za-z0-9/_.-]+$") & ~k.contains("..") & ~k.startswith("/")).alias("safe"))


_NAV = [("crm", "Kunden", 2, "crm:read"), ("ing", "Dokumente", 1, "ing:read"), ("sys", "System", 9, "sys:admin"), ("ing", "Quellen", 1, "ing:read")]


@query("filter_permitted_order", "with n(module, label, place, permission) as (values " + ", ".join(map(str, _NAV)) + "), r as (select module, label, row_number() over (order by place, module, label) as position from n where list_contains(['crm:read', 'ing:read'], permission)) select module, label, cast(position as integer) as position from r")
def _(spark, d):
    from pyspark.sql import Window

    n = spark.createDataFrame(_NAV, "module string, label string, place int, permission string")
    allowed = F.array(F.lit("crm:read"), F.lit("ing:read"))
    w = Window.partitionBy(F.lit(0)).orderBy("place", "module", "label")  # four rows
    return n.where(F.array_contains(allowed, F.col("permission"))).select("module", "label", F.row_number().over(w).alias("position"))


QUERIES, ORACLES = Q, O

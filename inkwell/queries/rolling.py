"""p1: trailing totals of the AI ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators.rolling import bursts, rolling_totals
from inkwell.plans.runtime import table

LEDGER = ("id", "tenant_id", "created_at", "cost_micros")


def p1_rolling_totals(spark, sf_dir):
    r = rolling_totals(table(spark, sf_dir, "ai_usage_ledger"), *LEDGER)
    return r.select("tenant_id", F.date_format("usage_day", "yyyy-MM-dd").alias("usage_day"), "day_number", "day_total", "total_7", "avg_7", "total_30", "avg_30")


def p1_extremes(spark, sf_dir):
    r = rolling_totals(table(spark, sf_dir, "ai_usage_ledger"), *LEDGER, extremes=True)
    return r.select("tenant_id", F.date_format("usage_day", "yyyy-MM-dd").alias("usage_day"), "max_7", "min_7", "max_30", "min_30")


def p1_found(spark, sf_dir):
    return bursts(rolling_totals(table(spark, sf_dir, "ai_usage_ledger"), *LEDGER), "tenant_id")


QUERIES = {"p1_rolling_totals": p1_rolling_totals, "p1_extremes": p1_extremes, "p1_found": p1_found}

_DAYS = """
with calls as (select distinct id, tenant_id, cast(created_at as date) as d, coalesce(cost_micros, 0) as c from ai_usage_ledger where tenant_id is not null and created_at is not null),
active as (select tenant_id, d, sum(c) as t, max(c) as hi, min(c) as lo from calls group by all),
spans as (select tenant_id, min(d) as a, max(d) as b from active group by all),
days as (select tenant_id, cast(unnest(generate_series(a, b, interval 1 day)) as date) as d from spans),
dense as (select days.tenant_id, days.d, coalesce(t, 0) as t, hi, lo from days left join active using (tenant_id, d)),
rolled as (select tenant_id, d, row_number() over w as n, t, sum(t) over (w rows 6 preceding) as t7, sum(t) over (w rows 29 preceding) as t30,
  max(hi) over (w rows 6 preceding) as h7, min(lo) over (w rows 6 preceding) as l7, max(hi) over (w rows 29 preceding) as h30, min(lo) over (w rows 29 preceding) as l30
  from dense window w as (partition by tenant_id order by d))
"""

ORACLES = {
    "p1_rolling_totals": _DAYS + "select tenant_id, strftime(d, '%Y-%m-%d') as usage_day, cast(n as integer) as day_number, cast(t as bigint) as day_total, cast(t7 as bigint) as total_7, cast(t7 as double) / 7 as avg_7, cast(t30 as bigint) as total_30, cast(t30 as double) / 30 as avg_30 from rolled",
    "p1_extremes": _DAYS + "select tenant_id, strftime(d, '%Y-%m-%d') as usage_day, cast(h7 as bigint) as max_7, cast(l7 as bigint) as min_7, cast(h30 as bigint) as max_30, cast(l30 as bigint) as min_30 from rolled",
    "p1_found": _DAYS + "select tenant_id, strftime(d, '%Y-%m-%d') as usage_day from rolled where n >= 30 and 15 * t7 > 7 * t30",
}

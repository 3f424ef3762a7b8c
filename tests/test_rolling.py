from __future__ import annotations

import datetime
import random
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from inkwell.operators.rolling import MONOIDS, TwoStackWindow, bursts, rolling_totals

SCHEMA = "id bigint, tenant_id int, cost_micros int, created_at timestamp_ntz, total_7 string"


def day(n: int, hour: int = 5) -> datetime.datetime:
    return datetime.datetime(2025, 1, 1, hour) + datetime.timedelta(days=n)


def rolled(spark, rows, **more):
    return rolling_totals(spark.createDataFrame(rows, SCHEMA), "id", "tenant_id", "created_at", "cost_micros", **more)


@given(st.lists(st.integers(-50, 50), max_size=60), st.integers(1, 9))
def test_window_folds_like_a_slice(values, size):
    total, high = TwoStackWindow(size, *MONOIDS["total"]), TwoStackWindow(size, *MONOIDS["max"])
    for i, v in enumerate(values):
        part = values[max(0, i + 1 - size) : i + 1]
        assert total.push(v) == sum(part)
        assert high.push(v) == max(part)


def test_days_without_rows_nulls_and_repeats(spark):
    rows = [(1, 1, 10, day(0), "x"), (1, 1, 10, day(0), "y"), (2, 1, None, day(3), None), (3, 1, 7, day(9), ""), (None, 1, 1, day(9), ""), (None, 1, 1, day(9), ""), (4, None, 5, day(1), ""), (5, 2, 5, None, ""), (6, 2, 5, day(4), "")]
    got = {(r["tenant_id"], r["usage_day"].day): r for r in rolled(spark, rows, extremes=True).collect()}
    assert [k for k in sorted(got) if k[0] == 1] == [(1, d) for d in range(1, 11)]
    assert got[1, 1]["total_7"] == 10 and got[1, 7]["total_7"] == 10 and got[1, 8]["total_7"] == 0
    assert got[1, 10]["day_total"] == 9 and got[1, 10]["total_30"] == 19 and got[1, 10]["avg_30"] == pytest.approx(19 / 30)
    assert got[1, 10]["max_7"] == 7 and got[1, 10]["min_7"] == 0 and got[1, 10]["min_30"] == 0
    assert got[2, 5]["day_total"] == 5 and got[2, 5]["max_7"] == 5


def test_empty_table(spark):
    assert rolled(spark, []).count() == 0
    assert bursts(rolled(spark, []), "tenant_id").columns == ["tenant_id", "usage_day"]


def test_against_brute_force_with_one_large_tenant(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for tenant, days in ((1, 70), (2, 3), (3, 1), (4, 45)):
        for d in range(days):
            for _ in range(rng.choice([0, 0, 1, 5]) if tenant != 1 else 9):
                n += 1
                rows.append((n, tenant, rng.choice([0, 1, 1000]), day(d, rng.randrange(24)), None))
    rng.shuffle(rows)
    per = defaultdict(lambda: defaultdict(int))
    for _, t, c, at, _ in rows:
        per[t][at.date()] += c
    expected = set()
    for t, days in per.items():
        first, last = min(days), max(days)
        for k in range((last - first).days + 1):
            d = first + datetime.timedelta(days=k)
            seven = sum(days.get(d - datetime.timedelta(days=i), 0) for i in range(7))
            thirty = sum(days.get(d - datetime.timedelta(days=i), 0) for i in range(30))
            expected.add((t, d, k + 1, seven, thirty))
    got = {(r["tenant_id"], r["usage_day"], r["day_number"], r["total_7"], r["total_30"]) for r in rolled(spark, rows).collect()}
    assert got == expected
    found = {(r[0], r[1]) for r in bursts(rolled(spark, rows), "tenant_id").collect()}
    assert found == {(t, f"{d:%Y-%m-%d}") for t, d, k, s, m in expected if k >= 30 and 15 * s > 7 * m}

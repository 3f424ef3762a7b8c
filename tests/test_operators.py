from __future__ import annotations

import random

from pyspark.sql import functions as F

from inkwell.operators.groups import smallest_label, within_hops
from inkwell.operators.joins import either_key_join, next_greater
from inkwell.operators.ordered import build_chain, reserve_until, segments, verify_chain
from inkwell.plans.runtime import skew_join


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_labels_of_chains_stars_and_noise(spark):
    rng = random.Random(1)
    chain = list(range(100, 220))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1, k) for k in range(2, 60)] + [(5, None), (None, 6), (7, 7), (900, 901), (901, 900), (900, 901)]
    got = {r[0]: r[1] for r in smallest_label(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == components(edges)
    assert smallest_label(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_hops(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3), (4, 1)], "src bigint, dst bigint")
    assert {tuple(r) for r in within_hops(links, spark.createDataFrame([(1,)], "node bigint"), 2).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}


def test_either_key(spark):
    left = spark.createDataFrame([(1, 10, 11), (2, 10, 10), (3, None, None), (4, 99, 12), (5, 99, 98)], "id int, a int, b int")
    right = spark.createDataFrame([(10, "x"), (11, "y"), (12, "z")], "id int, name string")
    got = sorted((r["id"], r["r_name"] or "") for r in either_key_join(left, right, "id", "a", "b", "id").collect())
    assert got == [(1, "x"), (1, "y"), (2, "x"), (3, ""), (4, "z"), (5, "")]


def test_next_greater_with_ties_and_nothing_above(spark):
    left = spark.createDataFrame([(1, 0), (1, 2), (1, 9), (2, 1)], "k int, v int")
    right = spark.createDataFrame([(1, 2), (1, 2), (1, 5)], "k int, level int")
    assert sorted((r["k"], r["v"], r["next_level"] or -1) for r in next_greater(left, right, ["k"], "v", "level").collect()) == [(1, 0, 2), (1, 2, 5), (1, 9, -1), (2, 1, -1)]


def test_skewed_join_loses_and_doubles_nothing(spark):
    n = 30_000
    left = spark.range(n).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 != 0, F.lit("hot")).when(F.col("id") % 300 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("zz", 4)], "k string, v int")
    expected = left.join(right, "k").agg(F.count(F.lit(1)), F.sum("rid"), F.sum("v")).head()
    assert skew_join(left, right, ["k"], "rid").agg(F.count(F.lit(1)), F.sum("rid"), F.sum("v")).head() == expected
    kept = skew_join(left, right.where("v <> 2"), ["k"], "rid", "left")
    assert kept.count() == n and kept.where("v is not null").count() == left.join(right.where("v <> 2"), "k").count()


def test_chain_found_where_it_breaks(spark):
    e = spark.createDataFrame([(k, i, f"e{i}") for k in (1, 2, 3) for i in range(5)] + [(4, 0, None)], "k int, n int, what string")
    built = build_chain(e, ["k"], "n", ["what"])
    assert {(r["k"], r["broken_at"]) for r in verify_chain(built, ["k"], "n", ["n", "what"]).collect()} == {(1, None), (2, None), (3, None), (4, None)}
    bad = built.withColumn("what", F.when((F.col("k") == 2) & (F.col("n") == 3), "changed").otherwise(F.col("what"))).where("not (k = 3 and n = 1)")
    assert {(r["k"], r["broken_at"]) for r in verify_chain(bad, ["k"], "n", ["n", "what"]).collect()} == {(1, None), (2, 3), (3, 2), (4, None)}


def test_segments_and_reservation(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9), ("b", 5)], "k string, t int")
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("k").orderBy("t")) > 3
    assert sorted((r["k"], r["t"], r["segment"]) for r in segments(df, ["k"], ["t"], gap).collect()) == [("a", 1, 1), ("a", 2, 1), ("a", 9, 2), ("b", 5, 1)]
    charge = lambda b, r: F.struct(F.lit(b).alias("bound"), F.lit(r).alias("reported"))
    r = spark.range(1).select(reserve_until(F.array(charge(4, 3), charge(4, 6), charge(4, 1), charge(1, 1)), 12).alias("r")).head()["r"]
    assert (r["used"], r["taken"], r["stopped"]) == (10, 2, True)

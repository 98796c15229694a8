"""Components of chains, stars and random graphs, and joins whose keys are hot."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codequarry.llm import common, simhash_bitsliced


def plain(edges: list[tuple[int, int]]) -> dict[int, int]:
    root = {n: n for e in edges for n in e}

    def find(n: int) -> int:
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("kind", ["chain", "stars", "random", "loops"])
def test_roots_equal_union_find(spark, kind):
    rng = random.Random(7)
    edges = {
        "chain": [(k, k + 1) for k in range(200)],
        "stars": [(k, 1000 + k % 3) for k in range(600)] + [(1000, 5000), (5000, 1001), (-7, 1002)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
    }[kind]
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in simhash_bitsliced.components(frame).collect()} == plain(edges)


def test_no_links(spark):
    assert simhash_bitsliced.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_large_star_spreads_over_tasks(spark):
    """200,000 nodes around a hub that is not the least node: no task of the join holds the hub's rows alone."""
    edges = spark.range(1, 200_001).selectExpr("id + 10 AS a", "cast(5 AS long) AS b").unionByName(spark.createDataFrame([(5, 1)], "a long, b long"))
    found = simhash_bitsliced.components(edges)
    assert found.count() == 200_002 and found.where("root <> 1").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_stay_where_they_are(spark, how):
    many = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")).repartition(8, "v")
    one = common.materialise(many.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("most")).where("k % 5 = 0"))
    made = common.join_one(many, one, ["k"], "n", 100_000, how)
    assert sorted(map(tuple, made.select("k", "v", "most").collect()), key=repr) == sorted(map(tuple, many.join(one, "k", how).select("k", "v", "most").collect()), key=repr)
    sizes = [len(part) for part in made.where("k = 0").rdd.glom().collect() if part]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_written_tables_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "checkpoint_root", lambda _: str(tmp_path))
    assert common.written(spark.range(3), "some").count() == 3 and any(tmp_path.rglob("*.parquet"))
    common.forget(spark)
    assert not any(tmp_path.rglob("*.parquet"))

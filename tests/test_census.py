"""The census moves nothing when its tables meet, and ranks within groups."""

import pytest
from pyspark.sql import functions as F

from helixtable.operators.census import census
from helixtable.operators.planning import ranked_within


def test_census(spark):
    kept = spark.range(500).selectExpr("cast(id % 7 AS int) AS p", "id AS t", "id * 2 AS gain")
    bits = spark.range(0, 500, 3).selectExpr("cast(id % 7 AS int) AS p", "id AS t", "id / 2.0D AS bits")
    domains = spark.range(0, 900, 2).selectExpr("cast(id % 7 AS int) AS p", "id AS t", "id AS n", "'x' AS kind")
    out = census("kept", {"kept": kept, "scores": bits, "domains": domains}, ["p", "t"], 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Broadcast" not in plan
    rows = {r["t"]: r for r in out.collect()}
    assert len(rows) == 500
    for t, r in rows.items():
        assert (r["p"], r["gain"], r["scores_there"], r["scores_bits"]) == (t % 7, 2 * t, t % 3 == 0, t / 2 if t % 3 == 0 else None)
        assert (r["domains_there"], r["domains_n"], r["domains_kind"]) == ((True, t, "x") if t % 2 == 0 else (False, None, None))
    with pytest.raises(Exception, match="stands twice"):
        census("kept", {"kept": kept, "scores": bits.union(bits)}, ["p", "t"], 5).collect()


def test_ranked_within(spark):
    rows = [(None if k % 5 == 0 else f"g{k % 3}", (k * 37) % 101) for k in range(101)]
    out = ranked_within(spark.createDataFrame(rows, "g string, x long").repartition(4), "g", [F.col("x")], "place").collect()
    by = {}
    for g, x in rows:
        by.setdefault(g, []).append(x)
    assert {(r["g"], r["x"]): r["place"] for r in out} == {(g, x): i for g, xs in by.items() for i, x in enumerate(sorted(xs))}

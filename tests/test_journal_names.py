"""Pairs read back with the names of their places: by range, without a shuffle of the pairs."""

from pyspark.sql import functions as F

from helixtable.operators import journal as J
from helixtable.sources.sinks import materialised


def test_names_come_with_the_places(spark):
    targets = spark.range(1, 41).select((F.col("id") * 3).alias("seq"), (F.col("id") % 7 + 1).alias("length"))
    places = materialised(J.numbered(targets, "seq", "length"), "places")
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    rows = spark.createDataFrame([(1, p, "OK", 1) for p in (0, 7, 8, 15, 16, 39)], "k int, place long, route string, stage int")
    packed = materialised(J.blocks(J.entries(rows, "k", keys, places, "route", "stage", F.lit(False), 8), "k", 2), "journal")
    named = J.read_back(packed, "k", places.select("seq", "place"), 8)
    plain = J.read_back(packed, "k").join(places.select("seq", "place"), "place")
    columns = ["k", "place", "seq", "route"]
    got = sorted(tuple(r) for r in named.select(columns).collect())
    assert got == sorted(tuple(r) for r in plain.select(columns).collect()) and len(got) == 80
    assert all(seq == 3 * (place + 1) for _, place, seq, _ in got)
    # the pairs themselves go through no exchange: what is shuffled are blocks and ranges
    text = named._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text.split("Generate explode")[0]

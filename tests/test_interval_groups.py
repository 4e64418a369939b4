"""interval_calls widens a P-value once for all pairs that have it, and counts as if each pair had been widened."""

from pyspark.sql import functions as F

from helixtable.functions import floats as X
from helixtable.operators import provenance as V
from helixtable.plans import exact_queries as E
from helixtable.plans.queries import _first_filter


def test_pairs_of_equal_values_are_counted_together(spark, sf):
    got = E.interval_calls(spark, sf)
    low, high = X.widened(F.col("p"), E.UNITS)
    d = _first_filter(spark, sf).where("p IS NOT NULL").select("profile_ordinal", V.stable_evalue(low, high, F.lit(1.0), 0.02).alias("by_p"), V.stable_evalue(low, high, F.lit(40.0), 10.0).alias("by_e"))
    want = d.groupBy("profile_ordinal").agg(F.count("*").alias("pairs"), F.count_if("by_p").alias("stable"), F.count_if("by_e").alias("stable_e"))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2

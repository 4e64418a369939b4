"""The census of what the first filter keeps, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixtable.operators.census import census
from helixtable.plans import search as P
from helixtable.plans.queries import _PAIRS, query, read
from helixtable.sources import tables as T
from helixtable.sources.sinks import materialised


@query(f"""{_PAIRS}
SELECT f.profile_ordinal, f.seq_ordinal, gain, status, f.length, round(ln(f.length / (f.length + 3.0)), 9) AS lengths_loop, true AS lengths_there,
    CASE WHEN status = 'OK' THEN round(bits, 6) END AS scores_bits, status = 'OK' AS scores_there FROM f WHERE action = 'KEEP'""")
def survivor_census(spark, sf_dir):
    """One row for each pair that the first filter keeps: its gain, what its length says, and its score where it has one."""
    o = P.SearchOptions()
    profiles, targets = T.profile_table(read(spark, sf_dir, "benchmark")), T.targets(read(spark, sf_dir, "documents"))
    chunks = P.loaded(profiles)
    kept = materialised(P.candidates(profiles, targets, chunks, o).select("profile_ordinal", "seq_ordinal", "gain", "status", "length", "bits"), "kept")
    keys, n = ["profile_ordinal", "seq_ordinal"], F.col("length")
    stages = {
        "kept": kept.drop("bits"),
        "lengths": kept.select(*keys, F.round(F.log(n / (n + 3.0)), 9).alias("loop")),
        "scores": kept.where("status = 'OK'").select(*keys, F.round("bits", 6).alias("bits")),
    }
    return census("kept", stages, keys, 16)

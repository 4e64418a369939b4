"""Queries of the journal of a search, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixtable.operators import journal as J
from helixtable.plans import search as P
from helixtable.plans.queries import _PAIRS, query, read
from helixtable.sources import tables as T
from helixtable.sources.sinks import materialised


def _journal(spark, sf_dir):
    """The journal of the first filter: pairs that go on are exceptions, by status; rejected ones are in spans."""
    o = P.SearchOptions()
    profiles, targets = T.profile_table(read(spark, sf_dir, "benchmark")), T.targets(read(spark, sf_dir, "documents"))
    targets = materialised(targets, "targets")  # residues are made once, not by each pass that ranks, scores or joins them
    chunks = P.loaded(profiles)
    kept = P.candidates(profiles, targets, chunks, o)
    places = materialised(J.numbered(targets.where("status = 'OK'"), "seq_ordinal", "length"), "places")
    rows = kept.join(places.select("seq_ordinal", "place"), "seq_ordinal").select("profile_ordinal", "place", "status", (F.col("status") == "OK").cast("int").alias("stage"))
    made = J.entries(materialised(rows, "exceptions"), "profile_ordinal", profiles, places, "status", "stage", F.lit(False))
    return materialised(J.blocks(made, "profile_ordinal"), "journal"), places


@query(f"{_PAIRS} SELECT profile_ordinal, seq_ordinal, CASE WHEN action = 'KEEP' THEN status ELSE 'SPAN' END AS route FROM f")
def journal_routes(spark, sf_dir):
    """The route of every pair, read back from the journal's blocks."""
    packed, places = _journal(spark, sf_dir)
    return J.read_back(packed, "profile_ordinal", places.select("seq_ordinal", "place")).select("profile_ordinal", "seq_ordinal", "route")


_ENTRIES = f"""{_PAIRS},
j1 AS (SELECT profile_ordinal, length, CASE WHEN action = 'KEEP' THEN status ELSE 'SPAN' END AS route, row_number() OVER (PARTITION BY profile_ordinal ORDER BY seq_ordinal) - 1 AS place FROM f),
j2 AS (SELECT *, place // {J.BLOCK * J.FAN} AS range FROM j1),
j3 AS (SELECT *, route <> 'SPAN' OR lag(route <> 'SPAN', 1, true) OVER (PARTITION BY profile_ordinal, range ORDER BY place) AS fresh FROM j2),
j4 AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY profile_ordinal, range ORDER BY place) AS entry FROM j3),
j AS (SELECT profile_ordinal, range, (entry - 1) // {J.BLOCK} AS block, min(place) AS lo, count(*) AS n, min(route) AS route, sum(length) AS residues, sum((route = 'OK')::INT) AS passed FROM j4 GROUP BY profile_ordinal, range, entry)"""


@query(f"""{_ENTRIES}
SELECT profile_ordinal, range, block::BIGINT AS block, min(lo) AS "begin", count(*)::INT AS entries, sum(n)::BIGINT AS targets,
    sha256(concat_ws('|', profile_ordinal, range, block, sum(n), string_agg(lo::VARCHAR, ',' ORDER BY lo), string_agg(n::VARCHAR, ',' ORDER BY lo), string_agg(route, ',' ORDER BY lo), string_agg(residues::VARCHAR, ',' ORDER BY lo), string_agg(passed::VARCHAR, ',' ORDER BY lo))) AS hash
FROM j GROUP BY profile_ordinal, range, block""")
def journal_blocks(spark, sf_dir):
    """The blocks of the journal with the hashes that let a reader check one alone."""
    packed, _ = _journal(spark, sf_dir)
    return packed.select("profile_ordinal", "range", "block", "begin", F.size("begins").alias("entries"), "targets", "hash")

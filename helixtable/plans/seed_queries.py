"""Queries of the certified seeds, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixtable.functions import scores as S
from helixtable.operators import kernels as K
from helixtable.operators import relational as R
from helixtable.operators import seeds as W
from helixtable.plans import search as P
from helixtable.plans.queries import _HIT, _MISS, _PAIRS, _TBM, query, read
from helixtable.sources import tables as T
from helixtable.sources.sinks import materialised

_CUTOFF = S.compiled_cutoff(lambda x: S.gumbel(x, P.SearchOptions().m_mu, P.SearchOptions().rate), P.SearchOptions().f1)[1]


def _core(hits: int) -> str:
    """SQL of whether a hit and those that follow it on its diagonal (s1, s2, ...) are a core of so many hits."""
    alive = [f"{_HIT * k} + {_MISS} * (s{k + 1} - s1 - {k}) > 0" for k in range(1, hits)]
    reach = f"{_HIT * hits} + {_MISS} * (s{hits} - s1 + 1 - {hits}) + {_HIT} * (m - (s{hits} - d)) >= {(hits - 1) * _HIT + 1}"
    return " AND ".join([*alive, reach])


_LEADS = ", ".join(f"lead(t.place, {k}) OVER o AS s{k + 1}" for k in range(1, W.HITS[-1]))


@query(f"""{_PAIRS},
l1 AS (SELECT f.profile_ordinal, f.seq_ordinal, f.action, m, tjb, tbm, least(ceil({K.SCALE_BYTE!r} * ({_CUTOFF * S.LN2 + 3.0!r} + null1)) - 1 + 2 * tjb + tbm + {K.TEC}, tjb + tbm + {K.TEC + 1}, {127 + _MISS}, {255 + _MISS - K.BASE} + tjb + tbm) AS g
    FROM f JOIN (SELECT DISTINCT profile_ordinal, n AS m FROM p) q ON q.profile_ordinal = f.profile_ordinal),
l AS (SELECT *, CASE WHEN tjb + tbm + {K.TEC - _MISS} >= 127 THEN 0 ELSE least({W.HITS[-1]}, ceil(greatest(0, g) / {_HIT}))::INT END AS hits FROM l1),
r AS (SELECT profile_ordinal, seq_ordinal, t.place - p.place AS d, t.place AS s1, {_LEADS} FROM t JOIN p ON t.code = p.code WINDOW o AS (PARTITION BY profile_ordinal, seq_ordinal, t.place - p.place ORDER BY t.place)),
x AS (SELECT DISTINCT profile_ordinal, seq_ordinal FROM r JOIN l USING (profile_ordinal, seq_ordinal) WHERE {" OR ".join(f"(hits = {h} AND {_core(h)})" for h in W.HITS)})
SELECT l.profile_ordinal, count(*) AS pairs, count(*) FILTER (l.hits < {W.HITS[0]}) AS open, count(x.seq_ordinal) AS seeded, count(*) FILTER (l.action = 'KEEP') AS required,
    count(*) FILTER (l.action = 'KEEP' AND x.seq_ordinal IS NULL AND l.hits >= {W.HITS[0]}) AS missed
FROM l LEFT JOIN x ON x.profile_ordinal = l.profile_ordinal AND x.seq_ordinal = l.seq_ordinal GROUP BY l.profile_ordinal""")
def seed_filter(spark, sf_dir):
    """By profile: all pairs, those that no seed may decide, those that share a certified seed, those that the first filter keeps of all, and how many of these the seeds missed (none)."""
    o = P.SearchOptions()
    profiles, targets = T.profile_table(read(spark, sf_dir, "benchmark")), T.targets(read(spark, sf_dir, "documents"))
    chunks = P.loaded(profiles)
    constants = P.profile_constants(profiles, chunks)
    met, fit, opens = P.seeded_diagonals(profiles, targets, chunks, o)
    exact = materialised(P.candidates(profiles, targets, chunks, o).select("profile_ordinal", "seq_ordinal"), "required")
    # pairs alone are counted: no diagonal is scored, and what two counts read is written once
    known, other = met.select("profile_ordinal", "seq_ordinal").distinct(), P.open_pairs(fit, constants, opens, o)
    marks = materialised(known.withColumn("how", F.lit("seeded")).unionByName(other.withColumn("how", F.lit("open"))), "marks")
    missed = R.false_rejects(exact, marks.drop("how")).select("profile_ordinal", F.lit("missed").alias("how"))
    rows = marks.select("profile_ordinal", "how").unionByName(missed).unionByName(exact.select("profile_ordinal", F.lit("required").alias("how")))
    counts = rows.groupBy("profile_ordinal").agg(*[F.count_if(F.col("how") == k).alias(k) for k in ("open", "seeded", "required", "missed")])
    many = targets.where("status = 'OK'").agg(F.count("*").alias("pairs"))
    out = profiles.select("profile_ordinal").join(counts, "profile_ordinal", "left").na.fill(0).crossJoin(F.broadcast(many))  # one row
    return out.select("profile_ordinal", "pairs", "open", "seeded", "required", "missed")

"""Queries of exact numbers, strict JSON and fact bitmaps, and their SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from helixtable.functions import floats as X
from helixtable.operators import facts as B
from helixtable.operators import provenance as V
from helixtable.operators import strict as J
from helixtable.plans import search as P
from helixtable.plans.queries import _PAIRS, query, read
from helixtable.sources import tables as T

UNITS = 4096  # units in the last place that another engine's P-value may be off


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END * l_extendedprice / l_quantity * CASE WHEN l_linenumber % 2 = 0 THEN 1e-310 ELSE 1 END AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, format('{:a}', x::DOUBLE) AS hex, true AS same, true AS between FROM x""")
def hex_floats(spark, sf_dir):
    """Unit prices, every other one subnormal, as hexadecimal text; whether it reads back as the same number, and whether the neighbours enclose it."""
    x = F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(1) * F.col("l_extendedprice") / F.col("l_quantity") * F.when(F.col("l_linenumber") % 2 == 0, F.lit(1e-310)).otherwise(F.lit(1.0))
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x")).withColumn("hex", X.hex_text(F.col("x")))
    x = F.col("x")
    inside = (X.next_below(x) < x) & (x < X.next_above(x)) & (X.next_below(X.next_above(x)) == x)
    return d.select("l_orderkey", "l_linenumber", "hex", (X.from_hex_text(F.col("hex")) == x).alias("same"), inside.alias("between"))


_UNIT = "pow(2.0::DOUBLE, floor(log2(p)) - 52)"


@query(f"""{_PAIRS} SELECT profile_ordinal, count(*) AS pairs, count(*) FILTER ((greatest(0, p - {UNITS} * {_UNIT}) <= 0.02) = (least(1, p + {2 * UNITS} * {_UNIT}) <= 0.02)) AS stable,
    count(*) FILTER ((greatest(0, p - {UNITS} * {_UNIT}) * 40 <= 10) = (least(1, p + {2 * UNITS} * {_UNIT}) * 40 <= 10)) AS stable_e FROM f WHERE p IS NOT NULL GROUP BY profile_ordinal""")
def interval_calls(spark, sf_dir):
    """The first filter's own P-values, widened: how many calls by P and by E-value no value of the interval would change."""
    profiles, targets = T.profile_table(read(spark, sf_dir, "benchmark")), T.targets(read(spark, sf_dir, "documents"))
    chunks = P.loaded(profiles)
    # a P-value follows from profile, length and gain: each is widened once, however many pairs have it
    alike = P.segment_scores(chunks, targets).groupBy("profile_ordinal", "length", "gain").agg(F.count("*").alias("n"))
    d = P.first_filter(alike, P.profile_constants(profiles, chunks), P.SearchOptions()).where("p IS NOT NULL")
    low, high = X.widened(F.col("p"), UNITS)
    d = d.select("profile_ordinal", "n", V.stable_evalue(low, high, F.lit(1.0), 0.02).alias("by_p"), V.stable_evalue(low, high, F.lit(40.0), 10.0).alias("by_e"))
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return d.groupBy("profile_ordinal").agg(F.sum("n").alias("pairs"), of("by_p").alias("stable"), of("by_e").alias("stable_e"))


@query("""SELECT user_id, '$.log[' || (event_id % 2) || ']' AS path, event_type AS name, count(*) AS copies FROM events GROUP BY user_id, event_id % 2, event_type HAVING count(*) > 1""")
def json_faults(spark, sf_dir):
    """A JSON text of each user's events by type, odd and even ones apart: the keys that stand twice in an object."""
    e = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 2).alias("side"), "event_id", F.concat(F.to_json(F.array("event_type")).substr(F.lit(2), F.length(F.to_json(F.array("event_type"))) - 2), F.lit(": "), F.coalesce(F.col("value").cast("string"), F.lit("null"))).alias("pair"))
    one = lambda side: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("event_id", "pair")))), lambda x: x.pair), ", "), F.lit("}"))
    texts = e.groupBy("user_id").agg(F.concat(F.lit('{"log": ['), one(0), F.lit(", "), one(1), F.lit("]}")).alias("text"))
    return J.json_faults(texts, "user_id", "text")


_FACTS = {"HIGH": "value > 20", "LOW": "value < 5", "EVEN": "user_id % 2 = 0", "ODD_EVENT": "event_id % 2 = 1", "LONG": "length(props) > 20"}
_SETS = [("+".join(c), c) for c in combinations(_FACTS, 3)]


@query(" UNION ALL ".join(f"""SELECT event_type AS stage, '{name}' AS name, count(*) FILTER ({' OR '.join(f'coalesce({_FACTS[c]}, false)' for c in of)}) AS any_rows, count(*) FILTER ({' AND '.join(f'coalesce({_FACTS[c]}, false)' for c in of)}) AS all_rows FROM events GROUP BY event_type""" for name, of in _SETS))
def fact_unions(spark, sf_dir):
    """By stage, how many rows have any and how many all of each three facts, from the bitmaps of single facts."""
    facts = F.array_compact(F.array(*[F.when(F.expr(c), name) for name, c in _FACTS.items()]))
    maps = B.fact_bitmaps(read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), "event_id", facts.alias("facts")), "stage", "event_id", "facts")
    sets = spark.createDataFrame([(n, list(c)) for n, c in _SETS], "name string, facts array<string>")
    every = maps.select("stage").distinct().crossJoin(sets.select("name"))  # a row for each stage and set
    out = every.join(B.with_any(maps, "stage", sets).withColumnRenamed("rows", "any_rows"), ["stage", "name"], "left")
    return out.join(B.with_all(maps, "stage", sets).withColumnRenamed("rows", "all_rows"), ["stage", "name"], "left").na.fill(0)

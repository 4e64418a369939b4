"""Registered queries of orders, record selection and work planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixtable.operators import planning as L
from helixtable.plans.queries import LETTERS, letters, query, read
from helixtable.sources import tables as T


@query("""WITH p AS (SELECT item_id, length(coalesce(text, ''))::BIGINT AS length, 'passage' || item_id AS name FROM benchmark)
SELECT item_id, length, name, row_number() OVER (ORDER BY length, name) AS rank, sum(length) OVER (ORDER BY length, name)::BIGINT AS upto FROM p""")
def profiles_by_length(spark, sf_dir):
    """Profiles in the order of (length, name), with running lengths."""
    p = read(spark, sf_dir, "benchmark").select("item_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("length"), F.concat(F.lit("passage"), "item_id").alias("name"))
    return L.ranked(p, [F.col("length"), F.col("name")], ("length",)).select("item_id", "length", "name", "rank", F.col("length_upto").alias("upto"))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 100")
def first_records(spark, sf_dir):
    return L.first_records(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey", 100)


@query("""WITH e AS (SELECT o_custkey, o_orderkey, (round(o_totalprice)::BIGINT % 41) - 20 AS g FROM orders),
u AS (SELECT o_custkey, o_orderkey, g, sum(g) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS upto FROM e),
x AS (SELECT o_custkey, upto - min(upto - g) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x FROM u)
SELECT o_custkey, greatest(max(x), 0)::BIGINT AS best FROM x GROUP BY o_custkey""")
def bounded_gain(spark, sf_dir):
    """The best sum of up to three consecutive orders of a customer."""
    e = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.round("o_totalprice").cast("long") % 41 - 20).alias("g"))
    return L.bounded_gain(e, "o_custkey", "o_orderkey", "g", 3)


@query("""WITH r AS (SELECT conv_id, turn, role || (turn // 3) AS header, turn % 5 <> 4 AS closed FROM conversations),
c AS (SELECT *, count(*) OVER (PARTITION BY conv_id, header) > 1 AS copied FROM r),
w AS (SELECT conv_id, turn + 1 AS turn, role || (turn // 3) AS name FROM conversations)
SELECT w.conv_id AS file, w.turn::BIGINT AS ordinal, c.header, CASE WHEN c.header IS NULL THEN 'MISSING' WHEN NOT closed THEN 'UNTERMINATED' WHEN copied THEN 'DUPLICATE' WHEN c.header <> w.name THEN 'MISMATCH' END AS problem
FROM w LEFT JOIN c ON c.conv_id = w.conv_id AND c.turn = w.turn""")
def select_text_records(spark, sf_dir):
    """Turns as text records of a conversation; each turn asks for the next one by its own name."""
    c = read(spark, sf_dir, "conversations")
    name = F.concat("role", F.expr("cast(turn div 3 as string)"))
    value = F.concat(F.lit("FORMAT\nNAME  "), name, F.lit("\nCOM\n"), F.when(F.col("turn") % 5 != 4, "//").otherwise(""))
    records = c.select(F.col("conv_id").alias("file"), F.col("turn").cast("long").alias("ordinal"), value.alias("value"))
    wanted = c.select(F.lit(0).alias("place"), F.col("conv_id").alias("file"), (F.col("turn") + 1).cast("long").alias("ordinal"), name.alias("name"))
    return L.select_text_records(records, wanted).drop("place")


@query(f"""{LETTERS}, b AS (SELECT sum(length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')))::BIGINT AS m FROM benchmark),
x AS (SELECT source, count(*) AS targets, m * sum(length)::BIGINT AS cells FROM s, b GROUP BY source, m)
SELECT source, targets, cells, ceil(targets / 100.0)::BIGINT AS batches, CASE WHEN cells > 200000000 THEN 'REFUSED' WHEN targets > 100 THEN 'SPLIT' WHEN cells <= 50000000 THEN 'SMALL' ELSE 'WHOLE' END AS route FROM x""")
def work_routes(spark, sf_dir):
    """All profiles against each source's targets: batches, cells and route, by limits that the test tables reach."""
    positions = read(spark, sf_dir, "benchmark").agg(F.sum(F.length(T.residues_of(F.col("text")))).alias("m"))  # one row
    z = letters(spark, sf_dir).groupBy("source").agg(F.count("*").alias("targets"), F.sum("length").alias("residues"))
    x = z.crossJoin(F.broadcast(positions)).select("source", "targets", (F.col("m") * F.col("residues")).alias("cells"))
    return L.work_routes(x, "targets", "cells", 100, 50_000_000, 200_000_000)

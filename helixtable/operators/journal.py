"""The journal of a search: by profile, every target as an exception with its route or in a certified span, in blocks that stand alone.

A span covers the targets between two exceptions: it says how many there are, their residues, and how many of them
passed each stage. Spans and exceptions together are the whole run of a profile, so the route of every pair can be read
back. Entries are packed in blocks of BLOCK: columns as arrays, spans as run lengths, with the place in the run where
the block begins. A block's hash covers its columns and its place; hashes of FAN blocks make a node, and so up to one
root a profile. A reader who holds the root checks one block by its siblings' hashes, without the others.

Spans come from the exceptions and the running residues of the targets: no row is made for a pair that a span covers.
Places of a profile are cut into ranges of BLOCK x FAN targets, so neither a window nor a row holds a whole profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixtable.operators.planning import ranked

BLOCK, FAN = 256, 16
COLUMNS = ("begins", "lengths", "routes", "residues", "passed")


def numbered(targets: DataFrame, order: str, size: str) -> DataFrame:
    """order, place (dense, from 0), before (the residues of earlier places), after (these and its own)."""
    d = ranked(targets.select(order, F.col(size).cast("long").alias("size_")), [F.col(order)], ("size_",))
    return d.select(order, (F.col("rank") - 1).alias("place"), (F.col("size__upto") - F.col("size_")).alias("before"), F.col("size__upto").alias("after"))


def entries(rows: DataFrame, key: str, keys: DataFrame, places: DataFrame, route: str, stage: str, certain: Column, span: int = BLOCK * FAN) -> DataFrame:
    """key, range, entry (from 1), begin, length, route, residues, passed: exceptions and the spans between them, in the order of places.

    rows: key, place, route, stage of the pairs that passed any stage; all other pairs of the keys and places passed none and
    need no row, so the journal of a search costs what the search kept. Rows that `certain` holds for are accounted for in spans.
    A span has the route SPAN and ends with its range.
    """
    d = rows.select(key, "place", F.col(route).alias("route"), F.col(stage).cast("long").alias("stage"), F.coalesce(certain, F.lit(False)).alias("certain")).withColumn("range", F.floor(F.col("place") / span))
    ranges = places.select(F.floor(F.col("place") / span).alias("range"), "place").groupBy("range").agg((F.max("place") + 1).alias("stop"))
    heads = keys.select(key).crossJoin(ranges).select(key, (F.col("range") * span - 1).alias("place"), "range", "stop")  # a row for each key and range of places
    own = Window.partitionBy(key, "range").orderBy("place")
    marks = heads.select(key, "range", "place").unionByName(d.where("NOT certain").select(key, "range", "place")).withColumn("next", F.lead("place").over(own)).withColumn("segment", F.row_number().over(own))
    gaps = marks.join(ranges, "range").select(key, "range", "segment", (F.col("place") + 1).alias("begin"), (F.coalesce("next", "stop") - F.col("place") - 1).alias("length")).where("length > 0")
    # rows that are certain but passed a stage belong to the segment of the mark before them
    loose = marks.select(key, "range", "place", F.lit(1).alias("mark"), F.lit(0).cast("long").alias("stage")).unionByName(d.where("certain AND stage > 0").select(key, "range", "place", F.lit(0).alias("mark"), "stage"))
    passed = loose.withColumn("segment", F.sum("mark").over(own).cast("int")).where("mark = 0").groupBy(key, "range", "segment").agg(F.sum("stage").alias("passed"))
    ends = places.select((F.col("place")).alias("last"), "after")
    gaps = gaps.join(passed, [key, "range", "segment"], "left").join(places.select(F.col("place").alias("begin"), "before"), "begin").withColumn("last", F.col("begin") + F.col("length") - 1).join(ends, "last")
    gaps = gaps.select(key, "range", "begin", "length", F.lit("SPAN").alias("route"), (F.col("after") - F.col("before")).alias("residues"), F.coalesce("passed", F.lit(0)).cast("long").alias("passed"))
    alone = d.where("NOT certain").join(places, "place").select(key, "range", F.col("place").alias("begin"), F.lit(1).cast("long").alias("length"), "route", (F.col("after") - F.col("before")).alias("residues"), F.col("stage").alias("passed"))
    return gaps.unionByName(alone).withColumn("entry", F.row_number().over(Window.partitionBy(key, "range").orderBy("begin")))


def blocks(rows: DataFrame, key: str, many: int = BLOCK) -> DataFrame:
    """key, range, block, begin, targets, the COLUMNS as arrays (of `many` entries at most), hash."""
    d = rows.withColumn("block", F.floor((F.col("entry") - 1) / many))
    fields = {"begins": "begin", "lengths": "length", "routes": "route", "residues": "residues", "passed": "passed"}
    packed = F.array_sort(F.collect_list(F.struct("begin", "length", "route", "residues", "passed")))  # of a block: `many` at most
    d = d.groupBy(key, "range", "block").agg(packed.alias("x"), F.sum("length").alias("targets"))
    d = d.select(key, "range", "block", F.col("x")[0].begin.alias("begin"), "targets", *[F.col(f"x.{f}").alias(c) for c, f in fields.items()])
    return d.withColumn("hash", block_hash(key))


def block_hash(key: str) -> Column:
    """SHA-256 of a block's place and columns."""
    one = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("range").cast("string"), F.col("block").cast("string"), F.col("targets").cast("string"), *[one(c) for c in COLUMNS]), 256)


def _parents(nodes: DataFrame, key: str, fan: int) -> DataFrame:
    up = nodes.groupBy(key, F.floor(F.col("node") / fan).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("x"))  # `fan` at most
    return up.select(key, "node", F.sha2(F.array_join(F.transform("x", lambda e: e.hash), ""), 256).alias("hash"))


def tree(packed: DataFrame, key: str, fan: int = FAN) -> DataFrame:
    """key, level, node, hash: level 0 has the blocks in order, each further level the hashes of `fan` nodes, up to one for each key."""
    blocks_ = packed.select(key, "range", "block", "hash")
    per = blocks_.groupBy(key, "range").agg(F.max("block").alias("last"))
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    per = per.select(key, "range", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("before"))
    level = blocks_.join(per, [key, "range"]).select(key, (F.col("before") + F.col("block")).alias("node"), "hash")
    most = level.agg(F.max("node")).first()[0]
    out, n = level.withColumn("level", F.lit(0)), 0
    while most is not None and most > 0:
        level, n, most = _parents(level, key, fan), n + 1, most // fan
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out.select(key, "level", "node", "hash")


def read_back(packed: DataFrame, key: str, names: DataFrame | None = None, span: int = BLOCK * FAN) -> DataFrame:
    """key, place, route of every pair: entries unpacked, spans opened (their pairs have the route SPAN).

    names: place and one more column, which the pairs then have too. It meets the blocks by range, as an array of `span` names at
    most, so that no row of a pair is shuffled.
    """
    if names is None:
        d = packed.select(key, F.explode(F.arrays_zip("begins", "lengths", "routes")).alias("x"))
        return d.select(key, F.explode(F.sequence(F.col("x.begins"), F.col("x.begins") + F.col("x.lengths") - 1)).alias("place"), F.col("x.routes").alias("route"))
    name = next(c for c in names.columns if c != "place")
    lists = names.groupBy(F.floor(F.col("place") / span).alias("range")).agg(F.array_sort(F.collect_list(F.struct("place", name))).alias("named_"))  # `span` at most
    d = packed.select(key, "range", "begins", "lengths", "routes").join(lists, "range")
    entry = lambda e: F.transform(F.slice("named_", (e.begins - F.col("range") * span + 1).cast("int"), e.lengths.cast("int")), lambda n: F.struct(n["place"].alias("place"), n[name].alias(name), e.routes.alias("route")))
    pairs = F.flatten(F.transform(F.arrays_zip("begins", "lengths", "routes"), entry))
    return d.select(key, F.explode(pairs).alias("x")).select(key, "x.*")


def damaged(packed: DataFrame, key: str) -> DataFrame:
    """Blocks whose columns do not give their hash, or do not follow one another from the block's begin on."""
    follow = F.forall(F.sequence(F.lit(1), F.size("begins") - 1), lambda i: F.get("begins", i) == F.get("begins", i - 1) + F.get("lengths", i - 1))
    broken = F.when(F.size("begins") > 1, ~follow).otherwise(F.lit(False)) | (F.col("begin") != F.col("begins")[0]) | (F.col("targets") != F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))
    return packed.where((F.col("hash") != block_hash(key)) | broken).select(key, "range", "block")


def proof(nodes: DataFrame, key: str, wanted: DataFrame, fan: int = FAN) -> DataFrame:
    """key, node, level, children (the hashes that the wanted block's ancestors on each level are made of): what a reader needs beside
    the block itself. wanted: key, node (of level 0)."""
    top = nodes.agg(F.max("level")).first()[0] or 0
    out = None
    for level in range(1, top + 1):
        mine = wanted.select(key, F.col("node").alias("block"), F.floor(F.col("node") / fan**level).alias("parent"))
        below = nodes.where(F.col("level") == level - 1).select(key, "node", "hash", F.floor(F.col("node") / fan).alias("parent"))
        one = mine.join(below, [key, "parent"]).groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("x"))  # `fan` at most
        one = one.select(key, F.col("block").alias("node"), F.lit(level).alias("level"), F.transform("x", lambda e: e.hash).alias("children"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else wanted.select(key, "node", F.lit(1).alias("level"), F.array().cast("array<string>").alias("children")).where("false")

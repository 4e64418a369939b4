"""Regions of posterior tracks of any length: the state machine as running aggregates over ranges, with carries between them.

A track is off or on. Off, a place that reaches rt1 turns it on; on, a place whose inside less its ends is below rt2
closes the region there. So by what it reaches a place sets the state, resets it, flips it or leaves it, and the state
after any place is that of the last set or reset, flipped as often as places since then flip. These compose: within a
range of places by running windows, between ranges by one row for each range. A region begins at the last place, of
those where the track was off, that comes first after a region or whose inside less its starts is below rt2. Its split
is the largest, over its places, of the smaller of the ends up to a place and the starts from it on, by prefix sums.

No row, task or window holds more than RANGE places of a track or one row for each of its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 4096


def carried(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """rows (with range_) with running values in the order of `order`, this row's included: sums, and last values that are no NULL.

    Each is a running window over a key's range and what the ranges before it carry: a window over one row for each range.
    """
    own = Window.partitionBy(*keys, "range_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = rows.select("*", *[F.sum(c).over(own).alias(f"{k}_in") for k, c in sums.items()], *[F.last(c, True).over(own).alias(f"{k}_in") for k, c in lasts.items()])
    ends = d.groupBy(*keys, "range_").agg(*[F.max_by(f"{k}_in", order).alias(k) for k in (*sums, *lasts)])
    before = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "range_", *[F.sum(k).over(before).alias(f"{k}_from") for k in sums], *[F.last(k, True).over(before).alias(f"{k}_from") for k in lasts])
    d = d.join(ends, [*keys, "range_"])
    done = [(F.coalesce(F.col(f"{k}_from"), F.lit(0)) + F.col(f"{k}_in")).alias(k) for k in sums] + [F.coalesce(f"{k}_in", f"{k}_from").alias(k) for k in lasts]
    return d.select(*rows.columns, *done)


def walked(tracks: DataFrame, key: str, position: str, rt1: float, rt2: float, size: int) -> DataFrame:
    """Places (key, j from 1, starts, ends, inside) with was_on (before the place), closes, begin (of the region that is open or
    would be), region (how many have closed before) and the prefix sums ends_upto, starts_upto."""
    d = tracks.select(key, F.col(position).alias("j"), "starts", "ends", "inside").withColumn("range_", F.floor(F.col("j") / size))
    turns, shuts = F.col("inside") >= rt1, F.col("inside") - F.col("ends") < rt2
    d = d.withColumn("turns", turns).withColumn("shuts", shuts)
    flips = (F.col("turns") & F.col("shuts")).cast("long")
    d = carried(d, [key], "j", {"flips": flips, "ends_upto": F.col("ends"), "starts_upto": F.col("starts")}, {})
    # the last set (turns alone) or reset (shuts alone), with the flips that came before it
    fixed = F.when(F.col("turns") != F.col("shuts"), F.struct(F.col("turns").alias("on"), "flips"))
    d = carried(d, [key], "j", {}, {"fixed": fixed})
    odd = (F.col("flips") - F.coalesce(F.col("fixed.flips"), F.lit(0))) % 2 == 1
    d = d.withColumn("on", F.coalesce(F.col("fixed.on"), F.lit(False)) != odd).drop("fixed")
    # the state before a place follows from the state after it only where the place flips or leaves it, so it is taken from the place before
    own = Window.partitionBy(key, "range_").orderBy("j")
    last = d.groupBy(key, (F.col("range_") + 1).alias("range_")).agg(F.max_by("on", "j").alias("edge"))
    d = d.withColumn("on_ago", F.lag("on").over(own)).join(last, [key, "range_"], "left")
    was_on = F.coalesce("on_ago", "edge", F.lit(False))
    d = d.withColumn("was_on", was_on).withColumn("closes", was_on & F.col("shuts")).drop("on_ago", "edge", "on", "flips")
    d = carried(d, [key], "j", {"closed": F.col("closes").cast("long")}, {})
    d = d.withColumn("region", F.col("closed") - F.col("closes").cast("long")).drop("closed")
    free = ~F.col("was_on")
    low = F.col("inside") - F.col("starts") < rt2
    d = carried(d, [key], "j", {}, {"lowest": F.when(free & low, F.struct("region", "j"))})
    firsts = d.where(free).groupBy(key, "region").agg(F.min("j").alias("first"))
    d = d.join(firsts, [key, "region"], "left")
    begin = F.when(F.col("lowest.region") == F.col("region"), F.col("lowest.j")).otherwise(F.col("first"))
    return d.withColumn("begin", begin).drop("lowest", "first", "turns")


def regions(tracks: DataFrame, key: str, position: str, rt1: float = 0.25, rt2: float = 0.10, size: int = RANGE) -> DataFrame:
    """key, region (from 0), begin, end, split of every closed region."""
    return _split(walked(tracks, key, position, rt1, rt2, size), key)


def _split(places: DataFrame, key: str) -> DataFrame:
    shut = places.where("closes").select(key, "region", "begin", F.col("j").alias("end"), F.col("starts_upto").alias("starts_to"))
    first = places.select(key, F.col("j").alias("begin"), (F.col("ends_upto") - F.col("ends")).alias("ends_from"))
    shut = shut.join(first, [key, "begin"])
    inside = places.select(key, "region", "j", "ends_upto", (F.col("starts_upto") - F.col("starts")).alias("starts_from")).join(shut, [key, "region"]).where("j >= begin AND j <= end")
    split = F.least(F.col("ends_upto") - F.col("ends_from"), F.col("starts_to") - F.col("starts_from"))
    return inside.groupBy(key, "region", "begin", "end").agg(F.round(F.max(split), 9).alias("split"))


def track_routes(tracks: DataFrame, key: str, position: str, rt1: float = 0.25, rt2: float = 0.10, rt3: float = 0.20, guard: float = 2e-4, size: int = RANGE) -> DataFrame:
    """key, n, regions (how many), uncertain (decisions within guard of their threshold), route of each track."""
    places = walked(tracks, key, position, rt1, rt2, size)
    near = lambda x, t: (F.abs(x - t) <= guard).cast("long")
    off = near(F.col("inside"), rt1) + near(F.col("inside") - F.col("starts"), rt2)
    per = places.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.when(F.col("was_on"), near(F.col("inside") - F.col("ends"), rt2)).otherwise(off)).alias("doubts"))
    own = _split(places, key).groupBy(key).agg(F.count("*").alias("regions"), F.sum(near(F.col("split"), rt3)).alias("split_doubts"), F.max("split").alias("most"))
    d = per.join(own, key, "left").withColumn("uncertain", F.col("doubts") + F.coalesce("split_doubts", F.lit(0)))
    route = F.when(F.col("uncertain") > 0, "UNCERTAIN").when(F.col("regions").isNull(), "NO_REGIONS").when(F.col("most") >= rt3, "MULTIDOMAIN").otherwise("SIMPLE")
    return d.select(key, "n", F.coalesce("regions", F.lit(0)).alias("regions"), "uncertain", route.alias("route"))


def overlaps(rows: DataFrame, keys: list[str], begin: str, end: str, buckets: int = RANGE) -> DataFrame:
    """rows with cluster_begin, cluster_end and clustered: how many intervals of a key chain with theirs, each meeting one before it, and reached: the largest
    end before it among the intervals that begin earlier (NULL: none). Intervals are whole numbers, both ends included.

    The running largest end comes by ranges of `buckets` places where intervals begin, and from one row for each range:
    no window holds a whole key. An interval that begins after all ends before it starts a cluster.
    """
    d = rows.withColumn("range_", F.floor(F.col(begin) / buckets)).withColumn("tie_", F.monotonically_increasing_id())
    own = Window.partitionBy(*keys, "range_").orderBy(begin, end, "tie_")
    d = d.withColumn("in_", F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    ends = d.groupBy(*keys, "range_").agg(F.max(end).alias("most_"))
    before = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "range_", F.max("most_").over(before).alias("from_"))
    d = d.join(ends, [*keys, "range_"]).withColumn("reached", F.greatest("in_", "from_"))
    starts = F.col("reached").isNull() | (F.col(begin) > F.col("reached"))
    d = d.withColumn("starts_", F.when(starts, F.col(begin)))
    # the cluster of an interval is the last start up to it: in its range, or the last of an earlier one
    d = d.withColumn("own_", F.last("starts_", True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    lasts = d.groupBy(*keys, "range_").agg(F.max("starts_").alias("last_")).select(*keys, "range_", F.max("last_").over(before).alias("last_"))
    d = d.join(lasts, [*keys, "range_"]).withColumn("cluster_begin", F.coalesce("own_", "last_"))
    sizes = d.groupBy(*keys, "cluster_begin").agg(F.max(end).alias("cluster_end"), F.count("*").alias("clustered"))
    return d.join(sizes, [*keys, "cluster_begin"]).select(*rows.columns, "reached", "cluster_begin", "cluster_end", "clustered")

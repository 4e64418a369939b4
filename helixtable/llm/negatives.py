"""Hard-negative mining by a vertical scan in blocks (BOND: branch and bound on decomposed data).

Components become floor(256 x); a score is the integer inner product of a row with an anchor. Anchors, a stated query
set, are dealt into blocks and all rows into tiles, both of bounded size; a task holds one block and one tile, with
the tile stored by dimension. For an anchor the dimensions are read in descending order of its magnitudes, STEP at a
time. After each step the smallest and the largest that the dimensions still unread can add - from the tile's
extremes by dimension - give each candidate a lower and an upper bound, and the bitmap of candidates loses those that
can be in no answer. Two passes:

1. positives: candidates of the anchor's label; out go those whose upper bound is under the fifth largest lower bound;
2. negatives: candidates of other labels; each positive p has the window 80 p <= 100 s <= 100 p; out go those whose
   bounds miss every window, or that fall short, in each window that they may be in, of the fifth largest lower bound
   among those that are surely in it. What is left at the last dimension has exact scores.

From each tile and anchor (and window) five rows at most go on; Spark keeps five of a task before the shuffle and
five of all after it. No bound is a guess, so nothing is lost, and no label or tile is larger for being frequent.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; components
beyond 2^24 after scaling are held at that; vectors of different lengths never meet; a null id is no anchor and comes
last among ties; rows of equal ids are rows of their own; an anchor without other rows of its label, or a positive whose window
is empty (always so below zero), gives no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixtable.llm.codes import scaled, sound
from helixtable.llm.common import forget, written

SCALE, MOST, FIRST, TILE, BLOCK, STEP, FEW, EVERY = 256, 1 << 24, 5, 1024, 256, 16, 48, 100


def bounds(anchor: np.ndarray, low: np.ndarray, high: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """least, most: what the dimensions from the i-th of the order on can add, for each i (0 after the last)."""
    a = anchor[order]
    x, y = a * low[order], a * high[order]
    tail = lambda v: np.concatenate([np.cumsum(v[::-1])[::-1], [0]])
    return tail(np.minimum(x, y)), tail(np.maximum(x, y))


def scan(anchor: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, candidates: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
    """The candidates (columns of `columns`) that prune leaves, with their scores. prune(lower, upper) tells which may stay."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    least, most = bounds(anchor, low, high, order)
    partial = np.zeros(len(candidates), dtype=np.int64)
    for i in range(0, len(order), STEP):
        if not len(candidates):
            break
        read = order[i : i + STEP]
        partial = partial + anchor[read] @ columns[np.ix_(read, candidates)]
        end = min(i + STEP, len(order))
        if len(candidates) > FEW or end == len(order):  # fewer are read to the end sooner than they are weighed
            stay = prune(partial + least[end], partial + most[end])
            candidates, partial = candidates[stay], partial[stay]
    return candidates, partial


def kth(values: np.ndarray) -> int | None:
    return int(np.partition(values, len(values) - FIRST)[-FIRST]) if len(values) >= FIRST else None


def best_may(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Which may be among the first by score."""
    k = kth(lower)
    return upper >= k if k is not None else np.ones(len(lower), dtype=bool)


def window(score: int) -> tuple[int, int]:
    """The least and the largest score of a positive's negatives."""
    return -((-4 * score) // 5), score


def windows_may(windows: list[tuple[int, int]]):
    least, most = min(lo for lo, _ in windows), max(hi for _, hi in windows)

    def prune(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        stay = (upper >= least) & (lower <= most)
        some = np.flatnonzero(stay)
        if FEW < len(some):
            lower, upper = lower[some], upper[some]
            within = np.zeros(len(some), dtype=bool)
            for lo, hi in windows:
                may = (upper >= lo) & (lower <= hi)
                k = kth(lower[(lower >= lo) & (upper <= hi)])
                within |= may & (upper >= k) if k is not None else may
            stay[some] = within
        return stay

    return prune


def _tile(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows by id (none last), and their vectors by dimension."""
    frame = frame.sort_values("vec_id", kind="stable", na_position="last").reset_index(drop=True)
    return frame, np.ascontiguousarray(np.stack(frame["v"].to_numpy()).astype(np.int64).T)


def _firsts(candidates: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of the first by score, ties by row."""
    return np.lexsort((candidates, -scores))[:FIRST]


class Found:
    """Rows that a task returns, gathered as arrays."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.ids, self.uids = rows["vec_id"].to_numpy(), rows["uid"].to_numpy()
        self.asked, self.places, self.at, self.scores = [], [], [], []

    def add(self, uid: int, place: int, at: np.ndarray, scores: np.ndarray) -> None:
        self.asked.append(np.full(len(at), uid))
        self.places.append(np.full(len(at), place))
        self.at.append(at)
        self.scores.append(scores)

    def frame(self) -> pd.DataFrame:
        one = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        at = one(self.at)
        return pd.DataFrame({"uid": one(self.asked), "place": one(self.places), "other": self.ids[at], "score": one(self.scores), "other_uid": self.uids[at]})


FOUND = "uid long, place int, other {}, score long, other_uid long"
NONE = pd.DataFrame({"uid": [], "place": [], "other": [], "score": [], "other_uid": []})


def _positives(anchors: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
    if not len(anchors) or not len(tile):
        return NONE
    rows, columns = _tile(tile)
    low, high, out = columns.min(axis=1), columns.max(axis=1), Found(rows)
    label, uid = rows["label"].to_numpy(), rows["uid"].to_numpy()
    for a in anchors.itertuples(index=False):
        candidates = np.flatnonzero((label == a.label) & (uid != a.uid))
        candidates, scores = scan(np.asarray(a.v, dtype=np.int64), columns, low, high, candidates, best_may)
        top = _firsts(candidates, scores)
        out.add(a.uid, 0, candidates[top], scores[top])
    return out.frame()


def _negatives(anchors: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
    if not len(anchors) or not len(tile):
        return NONE
    rows, columns = _tile(tile)
    low, high, out, label = columns.min(axis=1), columns.max(axis=1), Found(rows), rows["label"].to_numpy()
    for a in anchors.itertuples(index=False):
        spans = [(place, *window(int(s))) for place, s in enumerate(a.scores, 1)]
        spans = [(place, lo, hi) for place, lo, hi in spans if lo <= hi]
        if spans:
            prune = windows_may([(lo, hi) for _, lo, hi in spans])
            candidates, scores = scan(np.asarray(a.v, dtype=np.int64), columns, low, high, np.flatnonzero(label != a.label), prune)
            for place, lo, hi in spans if len(candidates) else ():
                within = np.flatnonzero((scores >= lo) & (scores <= hi))
                top = within[_firsts(candidates[within], scores[within])]
                out.add(a.uid, place, candidates[top], scores[top])
    return out.frame()


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    """The first by score of each key, ties by id, with their rank. Spark limits the rows of a key in each task before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("other"), "other_uid")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FIRST)


def mine(vectors: DataFrame, anchor: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor (of vec_id, label): which rows are anchors."""
    kinds = dict(vectors.dtypes)
    anchor = F.col("vec_id") % EVERY == 0 if anchor is None else anchor
    fine = vectors.where(F.col("label").isNotNull() & sound())
    rows = fine.select("vec_id", "label", scaled("embedding", SCALE, MOST).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = written(rows.withColumn("n", F.size("v")).withColumn("uid", F.monotonically_increasing_id()), "negative-rows")
    # hashes deal rows evenly, whatever their labels: a tile has TILE rows, a block BLOCK anchors, or little more
    many, asked = rows.count(), rows.where("anchor").count()
    tiles, blocks = max(1, -(-many // TILE)), max(1, -(-asked // BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n))
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    wide = rows.select("n", deal(tiles).alias("tile"), "uid", "vec_id", "label", "v").select("*", each(blocks, "block")).groupBy("n", "block", "tile")

    def meet(asking: DataFrame, function) -> DataFrame:
        grid = asking.withColumn("block", deal(blocks)).select("*", each(tiles, "tile")).groupBy("n", "block", "tile")
        return grid.cogroup(wide).applyInPandas(function, FOUND.format(kinds["vec_id"]))

    of_anchor = written(rows.where("anchor").select("n", "uid", "label", "v"), "anchors")  # a table of its own: both sides of cogroup must not share columns
    positives = _first(meet(of_anchor, _positives), "uid")
    positives = written(positives.select("uid", F.col("rank").alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = positives.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x.positive_score).alias("scores"))  # FIRST at most
    asking = written(of_anchor.join(scores, "uid"), "anchors")
    negatives = _first(meet(asking, _negatives), "uid", "place")
    negatives = written(negatives.select("uid", "place", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")
    ids = rows.where("anchor").select("uid", F.col("vec_id").alias("anchor_id"))
    out = written(negatives.join(positives, ["uid", "place"]).join(ids, "uid").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "hard-negatives")
    forget(rows, of_anchor, positives, asking, negatives)
    return out


def relabelled(vectors: DataFrame) -> DataFrame:
    """The labels of the query: where vec_id is divisible by 7 the next of the ten."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


ORACLE_SQL = f"""
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id
),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {FIRST})
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= {FIRST}
"""
